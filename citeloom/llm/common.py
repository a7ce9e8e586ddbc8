"""What the operators of this subpackage share: input columns, written intermediate tables, batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch may hold: long texts then stay far below a worker's memory.
ARROW_ROWS = 64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id as long and text, null as empty, with more columns on demand; others go. An id that is a long already keeps its attribute, so that equal exchanges of texts are recognised as equal and reused."""
    own = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    return docs.select(own, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def rest_of(docs: DataFrame) -> Column:
    """The columns other than doc_id and text in one struct, which keeps their names apart from an operator's own; null without any."""
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return (F.struct(*own) if own else F.lit(None).cast("struct<none:int>")).alias("rest")


def restored(df: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of docs from doc_id, rest and the changed text; n_chars, where docs has it, counts the changed text."""
    new = {"doc_id": F.col("doc_id"), "text": F.col(text), "n_chars": F.char_length(text).cast("long")}
    return df.select(*(new.get(c, F.col("rest")[c]).alias(c) for c in docs.columns))


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ARROW_ROWS rows, never raises them: plans are lazy, so whatever is built later runs under the same limit."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, a new temporary one, but only in local mode: elsewhere executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
        found = spark.sparkContext.getCheckpointDir()
    return found


#: Where the tables written within collected() are listed; None outside.
_collector: ContextVar[list[str] | None] = ContextVar("collector", default=None)


@contextmanager
def collected(paths: list[str]) -> Iterator[None]:
    """Lists the tables that are written within, so that discard() can delete them when nothing reads them any more."""
    token = _collector.set(paths)
    try:
        yield
    finally:
        _collector.reset(token)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written tables."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while paths:
        at = jvm.org.apache.hadoop.fs.Path(paths.pop())
        at.getFileSystem(conf).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: a lost executor costs no recomputation beyond it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (paths := _collector.get()) is not None:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
