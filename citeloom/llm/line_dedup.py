"""Line deduplication with two Bloom filters.

Tasks set the bits of each line key in a filter of keys seen once and, where a bit is already set by
another document, in a filter of bits seen twice. Filter segments are merged by segment. Only lines whose bits
are all in the second filter can repeat; just these are shuffled, as 128-bit digests of their keys, for the exact count
and the choice of the document that keeps them.

The filter has a fixed number of bits, so its broadcast has a fixed size. Beyond its capacity more
lines are suspected and shuffled, all of them in the end; that is a row of three integers for each line, whatever its length, and the result is the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, rest_of, small_batches, texts, written

FILTER_BITS = 2**27
SEGMENT_BITS = 2**20
WHITE = " \t\n\x0b\x0c\r"


def keys_of(text: str, least: int) -> list[bytes | None]:
    """A key for each line: stripped, A-Z in lower case; None below the least length."""
    out = []
    for line in text.split("\n"):
        line = line.strip(WHITE)
        out.append(line.encode("utf-8", "surrogatepass").lower() if len(line) >= least else None)
    return out


def _digests(keys: list[bytes]) -> np.ndarray:
    """128 bits of each key, as two integers."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(np.uint64).reshape(-1, 2)


def _bits(h: np.ndarray, bits: int) -> np.ndarray:
    return np.stack([h % np.uint64(bits), (h >> np.uint64(32)) * np.uint64(0x9E3779B1) % np.uint64(bits)])


def _local_filters(least: int, bits: int, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for b in batches:
            found: list[np.ndarray] = []
            for text in b.column("text").to_pylist():
                keys = list({k for k in keys_of(text, least) if k is not None})
                if keys:
                    found.append(np.unique(_bits(_digests(keys)[:, 1], bits)))
            if not found:
                continue
            pos, n = np.unique(np.concatenate(found), return_counts=True)
            pos = pos.astype(np.int64)
            byte, mask = pos >> 3, (1 << (pos & 7)).astype(np.uint8)
            again = (n > 1) | ((once[byte] & mask) != 0)
            np.bitwise_or.at(twice, byte[again], mask[again])
            np.bitwise_or.at(once, byte, mask)
        size = segment // 8
        for s in range(bits // segment):
            a, t = once[s * size : (s + 1) * size], twice[s * size : (s + 1) * size]
            if a.any():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "once": [zlib.compress(a.tobytes(), 1)], "twice": [zlib.compress(t.tobytes(), 1)]})

    return run


def _merged(segment: int):
    """Segments arrive sorted; each is merged as it streams by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, None, None
        row = lambda: pa.RecordBatch.from_pydict({"segment": pa.array([at], pa.int32()), "twice": [zlib.compress(twice.tobytes(), 1)]})
        for b in batches:
            for s, o, t in zip(*(b.column(c).to_pylist() for c in ("segment", "once", "twice")), strict=True):
                if s != at:
                    if at is not None and twice.any():
                        yield row()
                    at, once, twice = s, np.zeros(segment // 8, np.uint8), np.zeros(segment // 8, np.uint8)
                o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, t))
                twice |= t | (once & o)
                once |= o
        if at is not None and twice.any():
            yield row()

    return run


def _suspects(least: int, bits: int, segment: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.zeros(bits // 8, np.uint8)
        for s, blob in shared.value:
            twice[s * segment // 8 : (s + 1) * segment // 8] = np.frombuffer(zlib.decompress(blob), np.uint8)
        for b in batches:
            ids, found = [], [np.zeros((0, 2), np.uint64)]
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = list({k for k in keys_of(text, least) if k is not None})
                if own and i is not None:
                    digests = _digests(own)
                    pos = _bits(digests[:, 1], bits).astype(np.int64)
                    digests = digests[((twice[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1).all(axis=0)]
                    ids += [i] * len(digests)
                    found.append(digests)
            halves = np.concatenate(found).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "hi": halves[:, 0], "lo": halves[:, 1]})

    return run


def _rewritten(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, lines, gone = [], [], []
            for text, drop in zip(b.column("text").to_pylist(), b.column("drop").to_pylist(), strict=True):
                own = text.split("\n")
                lines.append(len(own))
                if drop:
                    drop = {(x["hi"], x["lo"]) for x in drop}
                    keys = keys_of(text, least)
                    digests = _digests([k or b"" for k in keys]).view(np.int64).tolist()
                    own = [x for x, k, d in zip(own, keys, digests, strict=True) if k is None or tuple(d) not in drop]
                    text = "\n".join(own)
                gone.append(lines[-1] - len(own))
                kept.append(text)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), b.column("rest")], ["doc_id", "kept_text", "n_lines", "n_dropped", "rest"])

    return run


def repeated_keys(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id and digest (hi, lo) of each line key that a document loses."""
    spark = docs.sparkSession
    segment = min(SEGMENT_BITS, filter_bits)
    rows = texts(docs)
    local = rows.where("doc_id is not null").select("text").mapInArrow(_local_filters(least_chars, filter_bits, segment), "segment int, once binary, twice binary")
    merged = local.repartition(partitions(spark), "segment").sortWithinPartitions("segment").mapInArrow(_merged(segment), "segment int, twice binary")
    shared = spark.sparkContext.broadcast([(r["segment"], bytes(r["twice"])) for r in merged.collect()])  # filter_bits / 8 bytes at most
    found = written(rows.mapInArrow(_suspects(least_chars, filter_bits, segment, shared), "doc_id long, hi long, lo long").distinct(), "suspects")
    keys = written(found.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep")).where(F.col("n") >= least_docs).select("hi", "lo", "keep"), "repeated")
    return found.join(keys, ["hi", "lo"]).where("doc_id <> keep").select("doc_id", "hi", "lo")


def line_dedup(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row for each row of docs: doc_id, kept_text, n_lines (before), n_dropped, rest (the other columns).

    A text is split at \\n; null and empty texts are one empty line. A line's key is the line stripped of ASCII
    white space, A-Z in lower case. Keys of least_chars code points or more in least_docs documents or more
    lose their lines everywhere but in the largest doc_id that holds them. Rows of one doc_id
    count as one document. Rows with a null doc_id are neither counted nor changed. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    drops = repeated_keys(docs, least_chars, least_docs, filter_bits).groupBy(F.col("doc_id").alias("drop_id")).agg(F.collect_set(F.struct("hi", "lo")).alias("drop"))
    rows = texts(docs, rest_of(docs))
    joined = rows.join(drops, F.col("doc_id") == F.col("drop_id"), "left").select("doc_id", "text", "drop", "rest")
    kinds = T.StructType.fromDDL("doc_id long, kept_text string, n_lines long, n_dropped long")
    return joined.mapInArrow(_rewritten(least_chars), T.StructType([*kinds, rows.schema["rest"]]))
