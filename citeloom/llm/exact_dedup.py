"""Exact deduplication by deterministic block naming.

A text is cut into blocks of fixed size. Distinct blocks are sorted and numbered, adjacent numbers
are paired, distinct pairs sorted and numbered again, until each text has one number. Texts
are identical just when byte length and final number are.

Block contents travel once, in an aggregation that keeps one row per content and task. Rows then
carry a 64-bit key; the naming table counts the contents behind each key, and keys with more than one
content are named by content, so no name rests on a hash. Rows that share a doc_id, or have none, are told
apart by byte length and a 64-bit hash of their texts while their blocks are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts, written

BLOCK_BYTES = 2048


def _numbered(distinct: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys with their integer names: positions in sorted order, with gaps between partitions."""
    return distinct.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _blocks(block_bytes: int) -> Column:
    data = F.encode("text", "UTF-8")
    last = F.greatest(F.lit(0), F.floor((F.octet_length("text") - 1) / block_bytes)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * block_bytes + 1, F.lit(block_bytes)))


def _first_names(rows: DataFrame, block_bytes: int, key_bits: int) -> DataFrame:
    """doc_id, h, n_bytes, pos, name of each block."""
    blocks = rows.select("doc_id", "h", "n_bytes", F.posexplode(_blocks(block_bytes)).alias("pos", "block"))
    key = F.shiftrightunsigned(F.xxhash64("block"), 64 - key_bits) if key_bits < 64 else F.xxhash64("block")
    keyed = blocks.withColumn("k", key)
    contents = keyed.select("block").distinct().withColumn("k", key)
    names = written(_numbered(contents.groupBy("k").agg(F.count(F.lit(1)).alias("contents")), "k"), "block-names")
    light = keyed.select("doc_id", "h", "n_bytes", "pos", "k")
    named = light.join(names.where("contents = 1").select("k", "name"), "k").drop("k")
    if names.where("contents > 1").isEmpty():
        return named
    shared = names.where("contents > 1").select(F.col("k").alias("shared_k"))
    again = contents.join(shared, F.col("k") == F.col("shared_k"), "left_semi").select("block")
    by_content = written(_numbered(again, "block").withColumn("name", -1 - F.col("name")), "content-names")
    return named.unionByName(keyed.join(by_content, "block").select("doc_id", "h", "n_bytes", "pos", "name"))


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, key_bits: int = 64) -> DataFrame:
    """doc_id, h, n_bytes, text_sha256 and name of each row of docs; (n_bytes, name) is the identity of a text."""
    rows = texts(docs).withColumns({"h": F.xxhash64("text"), "n_bytes": F.octet_length("text").cast("long")})
    level = written(_first_names(rows, block_bytes, key_bits).dropDuplicates(["doc_id", "h", "n_bytes", "pos"]), "level")
    # sizes of the texts decide the levels, so a short one is not carried on
    longest = rows.agg(F.max("n_bytes")).first()[0] or 0
    left, done = max(1, -(-longest // block_bytes)), None
    width = block_bytes
    while True:
        ready = level.where(F.col("n_bytes") <= width).select("doc_id", "h", "n_bytes", "name")
        done = ready if done is None else done.unionByName(ready)
        if left <= 1:
            break
        pairs = (
            level.where(F.col("n_bytes") > width)
            .groupBy("doc_id", "h", "n_bytes", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("l"), F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("r"))
        )
        pairs = written(pairs.withColumns({"no_r": F.col("r").isNull(), "r": F.coalesce("r", F.lit(0))}), "pairs")
        names = written(_numbered(pairs.select("l", "r", "no_r").distinct(), "l", "r", "no_r"), "pair-names")
        level = written(pairs.join(names, ["l", "r", "no_r"]).select("doc_id", "h", "n_bytes", "pos", "name"), "level")
        left, width = -(-left // 2), width * 2
    base = rows.select("doc_id", "h", "n_bytes", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))
    d = done.select(F.col("doc_id").alias("d_id"), F.col("h").alias("d_h"), F.col("n_bytes").alias("d_n"), "name")
    same = F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("h") == F.col("d_h")) & (F.col("n_bytes") == F.col("d_n"))
    return base.join(d, same).select("doc_id", "h", "n_bytes", "text_sha256", "name")


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES, key_bits: int = 64) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of identical texts the largest doc_id stays. A null text counts as empty. Rows that repeat a doc_id
    count as rows: each adds to group_size, and all that carry keep_id are kept. Rows with a null doc_id stay only where no
    row of their group has an id (keep_id is then null). An empty table gives an empty result; other columns are ignored.
    key_bits below 64 exists so that tests can force keys to collide.
    """
    named = written(identities(docs, block_bytes, key_bits), "identities")
    groups = written(named.groupBy("n_bytes", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    return named.join(groups, ["n_bytes", "name"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
