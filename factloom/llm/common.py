"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one bucket of a hot group may hold before the group is cut into more buckets.
BUCKET_ROWS = 20_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode without one a new folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files that no plan needs any more (after a checkpoint cut them off)."""
    import gc
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def apart(df: DataFrame, own: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """Give all columns but ``own`` names that no operator uses; the new name of every column, in the input's order."""
    names = {c: c if c in own else f"in_{k}" for k, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def together(names: dict[str, str], without: tuple[str, ...] = ()) -> list[Column]:
    """The columns of the input under their own names again (but for those ``without``)."""
    return [F.col(new).alias(old) for old, new in names.items() if old not in without]


def word_count(text: str | Column) -> Column:
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WORD)).cast("long")


def map_rows(df: DataFrame, make: Callable[[], Callable[..., list[tuple]]], schema: str, rows_per_batch: int = 4096) -> DataFrame:
    """Run a row function on the columns of ``df`` (in their order) in Arrow batches inside the tasks.

    ``make`` is called once per task and gives the function; it maps the values of one row to a list of output rows.
    Batches leave the task as soon as they are full, so that memory follows the batch and not the partition.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function, rows = make(), []
        for batch in batches:
            for values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows.extend(function(*values))
                if len(rows) >= rows_per_batch:
                    yield _batch(rows, target)
                    rows = []
        if rows:
            yield _batch(rows, target)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def buckets_for(rows: int) -> int:
    """Number of buckets per group, so that even a group that holds all rows is cut into pieces of bounded size."""
    return max(1, -(-rows // BUCKET_ROWS))


def running_start(df: DataFrame, key: str, order: list[Column], size: Column, name: str, buckets: int) -> DataFrame:
    """Exclusive running sum of ``size`` inside each ``key`` (not null), in an order by hash bucket, then ``order``.

    A hot key is cut into ``buckets`` by a hash of the order columns: rows are summed inside a bucket, and the sums of
    whole buckets (one row per key and bucket) are summed per key.  Rows that tie in ``order`` must be alike.
    """
    cut = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")).withColumn("_amount", size)
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = (cut.groupBy(key, "_bucket").agg(F.sum("_amount").alias("_sum"))
            .select(key, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    return (placed.join(sums, [key, "_bucket"]).withColumn(name, F.col("_before") + F.col("_inside"))
            .drop("_bucket", "_amount", "_before", "_inside"))
