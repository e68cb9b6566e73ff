"""Helpers shared by the operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    A temporary folder is only used in local mode, where no folder is configured.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="spark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame, name: str) -> DataFrame:
    """One element per row: a costly column is computed once, as filters on it stay above this step."""
    return df.select(*[x for x in df.columns if x != name], F.explode_outer(F.array(name)).alias(name))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows to all cores by unique keys before costly work on each: a file of few row groups is read by few tasks, whatever its rows take."""
    session = df.sparkSession
    return df.repartition(max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))), *keys)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the table is checked to be small; else leave the join to the planner."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def constant_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of fixed values, marked for broadcast (its size is known here)."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First row per key by the given order.

    A partial aggregate runs before the shuffle, so many copies of one key never meet in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def first_non_blank(value: str, order: Column) -> Column:
    """Aggregate: the value of the first row where it is not blank; '' when there is none."""
    col = F.col(value)
    return F.coalesce(F.min_by(col, F.when(col.isNotNull() & (col.cast("string") != ""), order)),
                      F.lit("")).alias(value)


def last_non_blank(value: str, order: Column) -> Column:
    """Aggregate: the value of the last row where it is not blank; NULL when there is none."""
    col = F.col(value)
    return F.max_by(col, F.when(col.isNotNull() & (col.cast("string") != ""), order)).alias(value)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], count: int,
                  rank: str = "_rank") -> DataFrame:
    """First ``count`` rows per group; the limit is also applied before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= count)


def indexed(df: DataFrame, order: list[Column], name: str = "index") -> DataFrame:
    """Exact position (from 0) of every row in a total order, without a single-task window.

    Rows are range-partitioned and sorted; a row's position is its place in its partition plus the
    sizes of the partitions before it.  The sorted rows are checkpointed, so that the positions stay
    the same when an executor is lost.  The order must be total (end it with a unique column).
    """
    place = F.monotonically_increasing_id()
    stored = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order)
                          .withColumn("_place", place))
    part = F.shiftright("_place", 33)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    # One row per partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    joined = stored.withColumn("_part", part).join(F.broadcast(starts), "_part")
    local = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn(name, F.col("_start") + local).drop("_part", "_place", "_start")


def ordered_distinct(df: DataFrame, keys: list[str], value: str, *order: Column) -> DataFrame:
    """Distinct values per key with the order of their first appearance (long form)."""
    return (df.filter(F.col(value).isNotNull() & (F.col(value) != ""))
            .groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("first_seen")))


def with_columns_default(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Add missing columns as NULL of the given type."""
    missing = {c: F.lit(None).cast(t) for c, t in defaults.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def beside(df: DataFrame, *one_row: DataFrame) -> DataFrame:
    """Put the columns of one-row tables beside every row: a broadcast join on a constant key."""
    out = df.withColumn("_one", F.lit(1))
    for other in one_row:
        out = out.join(F.broadcast(other.withColumn("_one", F.lit(1))), "_one")
    return out.drop("_one")
