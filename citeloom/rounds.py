"""Rules that go row by row in order, as rounds over whole tables.

A rule decides each row from the decisions on rows before it. Whatever is guessed at first, every round applies the rule to all rows, given the decisions of the round before. Once a round changes nothing, each
row's decision follows from those before it, so the result is the one of the ordered pass; and a row is right for good as soon as those that it depends on are, so the rounds are as many as
the longest chain of dependencies, not as the rows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a new temporary one in local mode where that is unset, an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: its lineage ends there, and a lost executor costs no more than reading it again."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(guess: DataFrame, step: Callable[[DataFrame], DataFrame], key: str, decision: str) -> DataFrame:
    """The fixed point of step, which takes and returns a table of keys and decisions (never null), as a written table."""
    now = written(guess, "round")
    while True:
        then = written(step(now), "round")
        old = now.select(F.col(key).alias("__key"), F.col(decision).alias("__old"))
        if then.join(old, F.col(key) == F.col("__key")).where(F.col(decision) != F.col("__old")).isEmpty():
            return then
        now = then


def numbered(rows: DataFrame, by: str, order: list[Column], into: str) -> DataFrame:
    """rows with their number, from 1, among those of equal `by` (null is a value like others), in an order (of columns by name) without ties.

    The rows are written first, so the pass that finds the ranges does not make them a second time. They are dealt out by ranges of `by` and the order, so many tasks number a group that holds most of them: each row has its place in its range, and the counts of the ranges before, a small table, are added. That table is written too: Spark then knows its size and deals out no rows for it."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = written(rows, "rows").repartitionByRange(n, F.col(by), *order).sortWithinPartitions(F.col(by), *order)
    placed = written(ranged.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    ranges = placed.groupBy(F.col(by).alias("__by"), F.shiftright("__at", 33).alias("__range")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__by").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = written(ranges.withColumn("__before", F.coalesce(before, F.lit(0))), "ranges")
    same = F.col(by).eqNullSafe(F.col("__by")) & (F.shiftright("__at", 33) == F.col("__range"))
    return placed.join(ranges, same).withColumn(into, F.col("__at") - F.col("__first") + F.col("__before") + 1).drop("__at", "__by", "__range", "__first", "__n", "__before")
