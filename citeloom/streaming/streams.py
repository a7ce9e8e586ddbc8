"""Streams: drop-folder intake, event logs to current state, incremental edges. Each micro-batch is the batch operator on its rows; tables are the state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from citeloom.functions.identifiers import doi_in_filename
from citeloom.functions.names import filename_title
from citeloom.operators.matching import inbox_matches
from citeloom.operators.upkeep import inbox_status


def intake(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of new content, one for each sha256 (the smallest path), that the store has not."""
    one = fresh.groupBy("sha256").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("copies"))
    return one.join(stored.select(F.col("sha256").alias("s")), F.col("sha256") == F.col("s"), "left_anti")


def start_intake(spark: SparkSession, folder: str, store: str, checkpoint: str, glob: str = "*.pdf") -> StreamingQuery:
    """Takes in new files of a folder: hashes are held against the stored table, so no streaming state grows without bound. Batches are numbered; one that is run again overwrites its own part."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).load(folder).select("path", F.sha2("content", 256).alias("sha256"))

    def add(batch: DataFrame, number: int) -> None:
        old = stored_contents(batch.sparkSession, store, number)
        intake(batch, old).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(store)

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def matched_intake(fresh: DataFrame, stored: DataFrame, items: DataFrame) -> DataFrame:
    """New contents (see intake) with the queue item that their file's name leads to: sha256, path, copies, item_id, score, status (matched, candidate, unmatched), bound. A matched file is bound to its item.

    items: item_id, doi, title."""
    name = F.substring_index("path", "/", -1)
    files = intake(fresh, stored).select("sha256", "path", "copies", F.xxhash64("sha256").alias("file_id"), doi_in_filename(name).alias("doi"), filename_title(name).alias("title"))
    found = inbox_matches(files, items).select(F.col("file_id").alias("m_id"), "item_id", "score")
    status = inbox_status(F.coalesce("score", F.lit(0.0)))
    rows = files.join(found, F.col("file_id") == F.col("m_id"), "left").select("sha256", "path", "copies", "item_id", F.coalesce("score", F.lit(0.0)).alias("score"), status.alias("status"))
    return rows.withColumn("bound", F.col("status") == "matched")


def start_inbox(spark: SparkSession, folder: str, store: str, items: Callable[[], DataFrame], checkpoint: str, glob: str = "*.pdf") -> StreamingQuery:
    """The drop folder as a stream: each micro-batch is held against the stored table, matched with the items of its time and bound.

    The store is partitioned by batch, and a batch looks at the parts of the others only: one that is run again after a failure finds what it found before and overwrites its own part, so replays change nothing."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).load(folder).select("path", F.sha2("content", 256).alias("sha256"))
    return files.writeStream.foreachBatch(lambda batch, number: store_batch(batch, number, store, items())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store_batch(batch: DataFrame, number: int, store: str, items: DataFrame) -> None:
    """One step of start_inbox()."""
    rows = matched_intake(batch, stored_contents(batch.sparkSession, store, number), items).withColumn("batch", F.lit(number))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(store)


def stored_contents(spark: SparkSession, store: str, but: int) -> DataFrame:
    """sha256 of all parts of a store but one; none before the first batch."""
    try:
        return spark.read.parquet(store).where(F.col("batch") != but).select("sha256")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], "sha256 string")


def progress(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of events by window and type. Rows later than `late` behind the newest are left out of a stream; a batch has none that are late."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def current_state(log: DataFrame, key: str, value: str) -> DataFrame:
    """The newest value of each key of a log (ts, event_id)."""
    return log.groupBy(key).agg(F.max_by(value, F.struct("ts", "event_id")).alias(value), F.count(F.lit(1)).alias("changes"))


class Newest(StatefulProcessor):
    """The newest value of each key of a log, by time and id, with the number of its rows. A row that is older than what a key holds counts, but changes nothing else. State goes `keep` milliseconds after the newest row, by the watermark;
    a key that comes back afterwards begins anew."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "ts timestamp, event_id long, value string, changes long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.newest.get() if self.newest.exists() else None
        best, changes = (tuple(held[:3]), held[3]) if held else (None, 0)
        for batch in rows:
            changes += len(batch)
            last = batch.sort_values(["ts", "event_id"]).iloc[-1]
            own = (last["ts"].to_pydatetime(), int(last["event_id"]), last["value"])
            best = own if best is None or own[:2] > best[:2] else best
        self.newest.update((*best, changes))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(pd.Timestamp(best[0]).timestamp() * 1000) + self.keep)
        yield pd.DataFrame({"key": [key[0]], "ts": [best[0]], "event_id": [best[1]], "value": [best[2]], "changes": [changes]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def newest_states(log: DataFrame, key: str, value: str, late: str = "2 hours", keep: timedelta = timedelta(days=7)) -> DataFrame:
    """current_state() as a stream: a row for each key and micro-batch in which it changes, key, ts, event_id, value, changes (update mode). log: ts, event_id, key, value. Rows later than `late` behind the newest are left out; a key's state goes after `keep`.

    State is keyed and lives in the session's RocksDB store, which this sets."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = log.select(F.col(key).cast("string").alias("key"), "ts", F.col("event_id").cast("long").alias("event_id"), F.col(value).cast("string").alias("value")).withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(Newest(int(keep.total_seconds() * 1000)), "key string, ts timestamp, event_id long, value string, changes long", "Update", "EventTime")


def start_upserts(source: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs a merge on every micro-batch of a source until it is exhausted: incremental edges, reviews."""
    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
