"""A corpus from documents to training windows: each stage takes all that the one before it kept.

What holds for all stages: a null text counts as empty. A document with a null or empty text, or with white space alone, is judged like any other by the classifier; the later stages
find nothing in it to remove and leave it as it is. A document that a stage itself empties leaves the corpus. Rows with a null doc_id pass the
filters unjudged; a doc_id that several rows carry is kept or dropped with all of them, and repeated rows repeat. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import common, jaccard_join, line_dedup, packing, quality, queries, suffix_dedup

#: Tables that the stages wrote on the way to their results.
_tables: list[str] = []


def _stage(f: Callable) -> Callable:
    """A stage begins when its predecessor's result is written; the tables behind that one are deleted then."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.discard(spark, _tables)
        with common.collected(_tables):
            return f(spark, docs, sf_dir)

    return run


def _only(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in keep, and those without one."""
    ids = keep.select(F.col("doc_id").alias("__keep")).distinct()
    named = docs.where(docs["doc_id"].isNotNull()).join(ids, docs["doc_id"] == ids["__keep"], "left_semi")
    return named.unionByName(docs.where(docs["doc_id"].isNull()))


def _left_over(removed: Column, text: Column) -> Column:
    """False where something was removed and nothing but white space is left."""
    return (removed == 0) | text.rlike(r"\S")


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts are judged by their site alone."""
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _only(docs, quality.quality_scores(docs, model).where("kept"))


@_stage
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat across documents stay in the largest doc_id. A document that has nothing else goes; null and empty texts become empty and stay."""
    done = line_dedup.line_dedup(docs)
    return common.restored(done.where(_left_over(F.col("n_dropped"), F.col("kept_text"))), docs, "kept_text")


@_stage
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays. Null, empty and wordless texts are like no other and stay."""
    return _only(docs, jaccard_join.jaccard_components(docs).where("component_id = doc_id"))


@_stage
def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; where a cut leaves part of a character, that part goes too. A document that has nothing else goes; null and empty texts become empty
    and stay."""
    done = suffix_dedup.readable(suffix_dedup.remove_repeats(docs))
    return common.restored(done.where(_left_over(F.col("n_removed"), F.col("kept"))), docs, "kept")


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed windows. A null or empty text is its end id alone."""
    return packing.pack_documents(docs, queries.packing_encoder)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_stage),
    ("suffix-array dedup", passage_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
