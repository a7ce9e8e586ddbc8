"""Jump consistent hashing: stable keys to shards without a ring table.

A key's sequence of jumps is drawn from xxhash64(key, step). Its shard among n is the last
jump below n, so that n + 1 shards see the same sequence and only rows whose next jump is n
move, and only into the new shard. Everything is a built-in expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written


#: Copies of one row that are numbered as one; more are dealt out in steps of so many.
COPIES = 4096


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a key; a null key has a shard like any other value."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    draw = lambda i: (F.shiftrightunsigned(F.xxhash64(key, i), 11) + F.lit(1)) / F.lit(float(2**53))
    start = F.struct(F.lit(0).cast("long").alias("shard"), F.floor(F.lit(1.0) / draw(F.lit(0))).cast("long").alias("jump"))
    step = lambda s, i: F.when(s["jump"] >= shards, s).otherwise(
        F.struct(s["jump"].alias("shard"), F.floor((s["jump"] + F.lit(1)) / draw(i)).cast("long").alias("jump"))
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["shard"]).cast("int")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row for each row of docs: doc_id, size (UTF-8 bytes + 8), text_crc32, law, shard, slot, grown_shard.

    slot numbers a shard's rows from 0 without gaps: distinct rows are ordered within hash buckets of id and text, and a
    bucket starts where the counts of those before it end, so no task holds a whole shard; repeated rows travel as one with their number.
    A null text counts as empty (size 8, crc32 0). A null doc_id hashes like a value of its own.
    Repeated rows get slots of their own. An empty table gives an empty result. Columns other than doc_id and
    text are ignored.
    """
    spark = docs.sparkSession
    key, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text).cast("long") + F.lit(8)).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        jump_hash(key, shards).alias("shard"),
        jump_hash(key, shards + 1).alias("grown_shard"),
    )
    bucket = F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.lit("slot")), F.lit(4 * partitions(spark))).cast("int")
    distinct = written(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", bucket), "sharded")
    counts = distinct.groupBy("shard", "bucket").agg(F.sum("n").alias("k"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("shard").alias("at_shard"), F.col("bucket").alias("at_bucket"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = distinct.withColumn("rank", F.coalesce(F.sum("n").over(within), F.lit(0)))
    placed = ranked.join(starts, (F.col("shard") == F.col("at_shard")) & (F.col("bucket") == F.col("at_bucket")))
    placed = written(placed.select("doc_id", "size", "text_crc32", "shard", "grown_shard", "n", (F.col("rank") + F.col("first")).alias("first")), "placed")

    def slots(df: DataFrame, first: Column, last: Column) -> DataFrame:
        return df.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(F.sequence(first, last)).alias("slot"), "grown_shard")

    # a row with very many copies is dealt out in steps, so that no task and no array holds them all
    last, step = F.col("first") + F.col("n") - 1, F.lit(COPIES).cast("long")
    steps = placed.where(F.col("n") > COPIES).withColumn("step", F.explode(F.sequence("first", last, step))).repartition(4 * partitions(spark), "shard", "step")
    return slots(placed.where(F.col("n") <= COPIES), F.col("first"), last).unionByName(slots(steps, F.col("step"), F.least(F.col("step") + step - 1, last)))
