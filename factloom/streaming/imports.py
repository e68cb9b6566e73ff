"""Streaming import of article files into the pool, and replay over many as-of dates."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.functions import dates as D
from factloom.operators.pool import normalize_articles
from factloom.operators.pool_store import ArticlePool, SharedFolder


def stream_imports(spark: SparkSession, source: str, schema: str, pool_root: str, checkpoint: str,
                   fallback_account: str = "待识别:history", interval: str | None = None, imported_at: str = "",
                   files_per_batch: int | None = None, buckets: int = 64) -> StreamingQuery:
    """Import every new JSON-lines file below ``source`` into the pool, each exactly once.

    The pool's manifest keeps the last batch of the stream, committed together with its rows and its audit, so a batch that
    is run again after a failure changes nothing.  The stream's name is the id in its checkpoint: a new checkpoint is
    a new stream.  Rows carry their order in ``seq`` or arrive in the order of the batch.  Without an interval all waiting
    files are read and the query ends.
    """
    pool = ArticlePool(spark, pool_root, buckets)
    place = SharedFolder(spark, checkpoint)

    def apply(batch: DataFrame, batch_id: int) -> None:
        stream = json.loads(place.read("metadata"))["id"]
        fingerprint = f"{batch_id:064x}"
        rows = normalize_articles(batch, fallback_account, "json_import")
        pool.import_rows(rows, f"stream batch {batch_id}", fingerprint, fingerprint, imported_at, stream=stream, batch=batch_id)

    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    writer = reader.json(source).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def refresh_due(runs: DataFrame, now: int, interval_hours: float = 24.0) -> DataFrame:
    """Whether each source is due for a refresh: after its interval, or after an hour when it failed.

    ``runs`` has source, status and finished_at (ISO text).
    """
    finished = D.iso_epoch("finished_at", D.UTC)
    last = runs.withColumn("_f", finished).groupBy("source").agg(
        F.max("_f").alias("finished"), F.max_by("status", "_f").alias("status"))
    hours = F.greatest(F.lit(0.25), F.when(F.col("status") == "error", F.least(F.lit(1.0), F.lit(interval_hours)))
                       .otherwise(F.lit(interval_hours)))
    due = F.col("finished").isNull() | (F.lit(now) - F.col("finished") >= hours * 3600)
    return last.select("source", "status", "finished", due.alias("due"))


def as_known_on(rows: DataFrame, as_of: str, day: str) -> DataFrame:
    """Rows that were there on an as-of date, so that a replay never reads later data."""
    return rows.filter(F.col(day) <= F.to_date(F.lit(as_of)))
