"""Alignment of two tokenizers' tokens by the places where both end.

A batch of texts becomes two flat Arrow columns of ids with parent indices. Lengths of the tokens' bytes come from the vocabularies; cumulative sums, begun anew for each text, give the
places where tokens end. Links are an Acero hash join of both columns on (text, end). Places where both have an end cut the tokens into groups.

How often ids are linked is counted in each batch by Table.group_by and merged by Spark. One of two linked tokens ends with the other's bytes, so there are at most as many pairs as the
vocabularies have bytes: the merged counts are bounded by that, whatever the corpus, and go to all workers, which join them with each text's links.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts, written
from .packing import long_blank

#: Bytes of text that are aligned at once.
CHUNK_BYTES = 1 << 19
#: Bytes of packed links that are joined or added up at once.
GATHERED_BYTES = 4 << 20


class Vocabulary:
    """The bytes of each id: their lengths, and all of them one after another."""

    def __init__(self, entries: list[bytes]):
        self.lengths = np.array([len(x) for x in entries], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)])
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begins[ids] - (ends - n), n)]


#: A tokenizer: texts -> (flat ids, how many each text has).
Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def _flat(rows: list) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in rows], np.int64)
    return np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in rows)]), sizes


@lru_cache(maxsize=2)
def byte_level(json_path: str, ranks_path: str, pattern: str) -> tuple[Encode, Vocabulary]:
    """The byte-level vocabulary of a tokenizers file, with the same vocabulary as ranks: special tokens' strings are plain text."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    with open(json_path, encoding="utf-8") as f:
        special = {x["id"]: x["content"].encode() for x in json.load(f)["added_tokens"]}
    entries = [b""] * (max([*ranks.values(), *special]) + 1)
    for x, i in [*ranks.items(), *((x, i) for i, x in special.items())]:
        entries[i] = x
    fast = tiktoken.Encoding("alignment", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    own = Tokenizer.from_file(json_path)
    own.encode_special_tokens = True
    own.no_truncation()
    own.no_padding()

    def encode(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat([own.encode(x, add_special_tokens=False).ids if long_blank(x) else fast.encode_to_numpy(x, disallowed_special=()) for x in rows])

    return encode, Vocabulary(entries)


@lru_cache(maxsize=2)
def pieces(model_path: str) -> tuple[Encode, Vocabulary]:
    """A sentencepiece model: U+2581 is a space, <0xHH> the byte HH. The library adds the space at the beginning itself, so encode() takes that off."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=model_path)
    entry = lambda i: bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i) else own.id_to_piece(i).replace("▁", " ").encode()
    return lambda rows: _flat(own.encode([x[1:] for x in rows], num_threads=1)), Vocabulary([entry(i) for i in range(own.get_piece_size())])


def _ends(ids: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Parent indices, and where each token ends within its text: a cumulative sum for each segment."""
    listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids))
    parent = pc.list_parent_indices(listed).to_numpy()
    total = np.cumsum(vocabulary.lengths[pc.list_flatten(listed).to_numpy()])
    before = np.concatenate([[0], total])[np.cumsum(sizes) - sizes]
    return parent.astype(np.int64), total - before[parent]


def _kept(ids: np.ndarray, sizes: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ids[np.repeat(keep, sizes)], np.where(keep, sizes, 0)


def _whole(ids: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary, data: list[bytes]) -> np.ndarray:
    """Of each text: its tokens' bytes joined are its own."""
    n = np.bincount(np.repeat(np.arange(len(sizes)), sizes), vocabulary.lengths[ids], len(sizes)).astype(np.int64)
    want = np.array([len(x) for x in data])
    joined, at = vocabulary.joined(ids).tobytes(), np.concatenate([[0], np.cumsum(n)])
    return np.array([n[i] == want[i] and joined[at[i] : at[i + 1]] == x for i, x in enumerate(data)], bool)


def _grouped(ids: np.ndarray, text: np.ndarray, place: np.ndarray, cut_key: np.ndarray, width: int) -> pa.Array:
    """The ids of each group joined by commas."""
    edge = np.searchsorted(text * width + place, cut_key, side="right")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], edge]), pa.int32()), pc.cast(pa.array(ids), pa.string())), ",")


def aligned(rows: list[str], first: tuple[Encode, Vocabulary], second: tuple[Encode, Vocabulary]) -> tuple[pa.Table, pa.Table]:
    """About each text, n_a, n_b, n_groups, n_links and groups; and the links: text (its place in rows), a, b. Texts are given without the space that is put before them."""
    spaced = [" " + x if x else "" for x in rows]
    data = [x.encode() for x in spaced]
    (a, n_a), (b, n_b) = (encode(spaced) for encode, _ in (first, second))
    keep = np.array([bool(x) for x in rows], bool) & _whole(a, n_a, first[1], data) & _whole(b, n_b, second[1], data)
    (a, n_a), (b, n_b) = _kept(a, n_a, keep), _kept(b, n_b, keep)
    (text_a, end_a), (text_b, end_b) = _ends(a, n_a, first[1]), _ends(b, n_b, second[1])
    left = pa.table({"text": text_a, "end": end_a, "a": a})
    links = left.join(pa.table({"text": text_b, "end": end_b, "b": b}), keys=["text", "end"], join_type="inner", use_threads=False)
    width = 1 + max((len(x) for x in data), default=0)
    cut_key = np.unique(links.column("text").to_numpy() * width + links.column("end").to_numpy())
    cut_text = cut_key // width
    strings = pc.binary_join_element_wise(_grouped(a, text_a, end_a, cut_key, width), _grouped(b, text_b, end_b, cut_key, width), "|")
    n_groups = np.bincount(cut_text, minlength=len(rows))
    groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_groups)]), pa.int32()), strings), ";")
    n_links = np.bincount(links.column("text").to_numpy(), minlength=len(rows))
    about = pa.table({"n_a": n_a, "n_b": n_b, "n_groups": pa.array(n_groups, pa.int64()), "n_links": pa.array(n_links, pa.int64()), "groups": groups})
    return about, links.select(["text", "a", "b"])


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"
BITS = 20


def _packed(key: np.ndarray, n: np.ndarray) -> bytes:
    import zstandard

    data = np.diff(key, prepend=0).astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes() + n.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    rows = len(data) // 9
    steps = np.zeros((rows, 8), np.uint8)
    steps[:, :5] = data[: 5 * rows].reshape(5, rows).T
    return np.cumsum(steps.reshape(-1).view(np.int64)), data[5 * rows :].reshape(4, rows).T.copy().view(np.uint32).reshape(-1).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    for x in batches:
        ids, rows, at = x.column("doc_id").to_pylist(), x.column("text").to_pylist(), 0
        while at < len(rows):
            to, size = at, 0
            while to < len(rows) and (to == at or size + len(rows[to]) <= CHUNK_BYTES):
                size += len(rows[to])
                to += 1
            yield ids[at:to], rows[at:to]
            at = to


def _rows(make):
    """About each text; links holds its distinct pairs (a << BITS | b) and how often it has each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = make()
        for ids, rows in _chunks(batches):
            about, links = aligned(rows, first, second)
            key = pa.array(links.column("a").to_numpy() << BITS | links.column("b").to_numpy())
            counted = pa.table({"text": links.column("text"), "key": key}).group_by(["text", "key"], use_threads=False).aggregate([([], "count_all")]).sort_by([("text", "ascending"), ("key", "ascending")])
            edge = np.searchsorted(counted.column("text").to_numpy(), np.arange(len(rows) + 1))
            key, n = counted.column("key").to_numpy(), counted.column("count_all").to_numpy()
            packed = [_packed(key[i:j], n[i:j]) for i, j in zip(edge, edge[1:], strict=False)]
            hashes = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in about.column("groups").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(about.column(c).combine_chunks() for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(hashes, pa.string()), pa.array(packed, pa.binary())], [c.split()[0] for c in ALIGNED.split(", ")])

    return run


def _together(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = [_unpacked(x) for x in blobs]
    sizes = np.array([len(x) for x, _ in found], np.int64)
    none = np.zeros(0, np.int64)
    return np.repeat(np.arange(len(found)), sizes), np.concatenate([none, *(x for x, _ in found)]), np.concatenate([none, *(n for _, n in found)])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold GATHERED_BYTES."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= GATHERED_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held and sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a task's pairs; between batches only distinct pairs are in memory, which the vocabularies bound."""
    held = pa.table({"key": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    for b in _gathered(batches):
        _, key, n = _together(b.column("links").to_pylist())
        both = pa.concat_tables([held, pa.table({"key": key, "n": n})])
        held = both.group_by("key", use_threads=False).aggregate([("n", "sum")]).rename_columns(["key", "n"])
    yield from held.combine_chunks().to_batches()


def _looked_up(counts):
    """n_best and count_sum of each text, by a join of its pairs with the corpus' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.table(counts.value)
        for b in _gathered(batches):
            text, key, n = _together(b.column("links").to_pylist())
            joined = pa.table({"text": text, "key": key, "n": n}).join(known, keys="key", join_type="inner", use_threads=False)
            weighted = pa.table({"text": joined.column("text"), "best": pc.multiply(joined.column("n"), joined.column("best")), "sum": pc.multiply(joined.column("n"), joined.column("count"))})
            sums = weighted.group_by("text", use_threads=False).aggregate([("best", "sum"), ("sum", "sum")])
            out = np.zeros((2, b.num_rows), np.int64)
            out[:, sums.column("text").to_numpy()] = [sums.column("best_sum").to_numpy(), sums.column("sum_sum").to_numpy()]
            rest = b.drop_columns(["links", "groups_sha256"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(out[0]), pa.array(out[1]), b.column("groups_sha256")], [*rest.schema.names, "n_best", "count_sum", "groups_sha256"])

    return run


def pair_counts(rows: DataFrame) -> DataFrame:
    """a, b, count and best (1 where it is the largest of its b) of all linked pairs of aligned rows."""
    counts = rows.select("links").mapInArrow(_partial_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("count"))
    b = F.col("key").bitwiseAND(F.lit((1 << BITS) - 1))
    top = counts.groupBy(b.alias("t_b")).agg(F.max("count").alias("top"))
    return counts.join(top, b == F.col("t_b")).select("key", F.shiftright("key", BITS).alias("a"), b.alias("b"), "count", (F.col("count") == F.col("top")).cast("long").alias("best"))


def align(docs: DataFrame, make) -> DataFrame:
    """One row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    make() gives a worker its two tokenizers (byte_level(), pieces()). A text that is null or empty, or whose tokens of either side do not join to a space and the text, has no tokens: zeros,
    and '' as hash. Rows with a null doc_id are aligned like others, repeated rows count as often as they occur. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = written(texts(docs).mapInArrow(_rows(make), ALIGNED), "aligned")
    # bounded by the bytes of both vocabularies, see above
    found = pair_counts(rows).select("key", "count", "best").collect()
    counts = spark.sparkContext.broadcast({c: np.array([r[c] for r in found], np.int64) for c in ("key", "count", "best")})
    return rows.mapInArrow(_looked_up(counts), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
