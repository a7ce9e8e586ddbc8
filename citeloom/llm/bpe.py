"""BPE encoding and decoding by a table of distinct words.

Texts are cut into words at white space, block by block; a block keeps the places of its words as numbers into its own list of distinct ones. These lists are dealt out by a hash of the
word, so that all that a word needs is its encoding, once, and one entry for each block that has it, however often it occurs there. The ids return to their blocks and are joined with
the places. Places and words go through one exchange under one key, which both sides read: it is written once, and places stay where it put them. Decoding joins ids with the
id-to-piece table, a batch at a time.

Cutting at the six ASCII white space characters is safe: no merge, normal form or special token of the vocabulary reaches across them.
"""

from __future__ import annotations

import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import partitions, small_batches, texts

#: Bytes of text in a block: the larger, the fewer entries a word has; a task holds one block.
BLOCK_BYTES = 2**22
BUCKETS_PER_PARTITION = 2
LINE_WORDS = 128
#: Bytes of text or numbers of ids that a worker turns into objects at once.
SLICE = 2**20


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in little room: low bytes together, then higher ones."""
    return zstandard.ZstdCompressor(level=3).compress(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(4, -1).T.copy().view(np.uint32).reshape(-1).astype(np.int64)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer of a file, read once for each worker."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return own


def _encoded(own, words: list[bytes]) -> list[bytes]:
    """Ids of each word as 32-bit integers. Words are encoded a line at a time, which costs less than one by one; each id's place in the line tells its word."""
    out: list[bytes] = []
    lines = [words[i : i + LINE_WORDS] for i in range(0, len(words), LINE_WORDS)]
    split = [[w.decode("utf-8") for w in line] for line in lines]
    for line, found in zip(split, own.encode_batch([" ".join(line) for line in split], add_special_tokens=False), strict=True):
        begin = np.cumsum([0, *(len(w) + 1 for w in line)])[:-1]
        at = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
        cut = [*np.searchsorted(at, begin).tolist(), len(found.ids)]
        ids = array.array("i", found.ids).tobytes()
        out += [ids[4 * a : 4 * z] for a, z in zip(cut, cut[1:], strict=False)]
    return out


def _slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `most` bytes or list items in a column, one row at least: Python objects of a slice stay few, however long the texts are."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)) if pa.types.is_string(b.column(column).type) else pc.list_value_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(sizes):
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, side="right")))
            yield b.slice(at, n)
            at += n


def _split(buckets: int):
    """For each block of texts: a row of its documents and of the places of its words, numbers into the block's own list of distinct words, the frequent first, equally frequent ones in order; and
    for each bucket a row with the words that belong there. The key of the first is the block, that of the others below 0: -1 - bucket. A block's number is a hash of its place and content."""
    kinds = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("places", pa.binary()), ("words", pa.binary()), ("numbers", pa.binary())])

    def block(place: int, ids: list, texts: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        split = pc.ascii_split_whitespace(pa.concat_arrays(texts).cast(pa.large_string()))
        flat, owner = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
        full = pc.greater(pc.binary_length(flat), 0)
        coded = pc.dictionary_encode(flat.filter(full))
        counts = np.bincount(owner[full.to_numpy(zero_copy_only=False)], minlength=len(ids)).astype(np.int32)
        at = coded.indices.to_numpy()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        order = order[np.argsort(-np.bincount(at, minlength=len(order))[order], kind="stable")]
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        places = _packed(rank[at])
        words = coded.dictionary.take(pa.array(order)).cast(pa.large_binary()).to_pylist()
        number = xxhash.xxh3_64_intdigest(b"\0".join([b"%d" % place, repr(ids).encode(), counts.tobytes(), places, *words])) >> 1
        yield pa.RecordBatch.from_pylist([{"key": number, "block": number, "docs": ids, "counts": counts.tolist(), "places": places}], kinds)
        deal = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int64, len(words))
        by = np.argsort(deal, kind="stable")
        begin = np.flatnonzero(np.diff(deal[by], prepend=-1))
        for a, z in zip(begin, np.append(begin[1:], len(by)), strict=True) if len(by) else ():
            own = by[a:z]
            yield pa.RecordBatch.from_pylist([{"key": -1 - int(deal[own[0]]), "block": number, "words": zstandard.ZstdCompressor(level=3).compress(b" ".join(words[i] for i in own)), "numbers": _packed(np.diff(own, prepend=0))}], kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, place = [], [], 0, TaskContext.get().partitionId() << 32
        for b in _slices(batches, "text", SLICE):
            ids += b.column("doc_id").to_pylist()
            texts.append(b.column("text"))
            size += b.column("text").nbytes
            if size >= BLOCK_BYTES:
                yield from block(place, ids, texts)
                ids, texts, size, place = [], [], 0, place + 1
        if ids:
            yield from block(place, ids, texts)

    return run


def _encoded_words(path: str):
    """A bucket's distinct words, each encoded once; for each of its blocks, the ids of the block's words. The places of a block give nothing."""

    def run(table: pa.Table) -> pa.Table:
        table = table.filter(pc.is_valid(table.column("words")))
        lists = [zstandard.ZstdDecompressor().decompress(x).split(b" ") for x in table.column("words").to_pylist()]
        words = list(set().union(*lists))
        known = dict(zip(words, _encoded(_tokenizer(path), words), strict=True))
        ids = [[known[w] for w in x] for x in lists]
        sizes = [_packed(np.array([len(y) // 4 for y in x])) for x in ids]
        return pa.table({"block": table.column("block"), "numbers": table.column("numbers"), "sizes": pa.array(sizes, pa.binary()), "ids": pa.array([_packed(np.frombuffer(b"".join(x), np.int32)) for x in ids], pa.binary())})

    return run


def _joined(blocks: pa.Table, words: pa.Table) -> pa.Table:
    """A block's documents with the ids of their words, joined by the words' numbers at each place. The words of a bucket give nothing."""
    blocks = blocks.filter(pc.is_valid(blocks.column("places")))
    none = np.zeros(0, np.int64)
    ints = lambda column: [_unpacked(x) for x in words.column(column).to_pylist()]
    numbers = np.concatenate([none, *(np.cumsum(x) for x in ints("numbers"))])
    sizes, ids = np.concatenate([none, *ints("sizes")]), np.concatenate([none, *ints("ids")])
    first = np.cumsum(sizes) - sizes
    where = np.empty(len(numbers), np.int64)
    where[numbers] = np.arange(len(numbers))
    out = []
    for docs, counts, places in zip(*(blocks.column(c).to_pylist() for c in ("docs", "counts", "places")), strict=True):
        at = _unpacked(places)
        if len(numbers) != at.max(initial=-1) + 1:
            raise ValueError("a block's words are missing: the texts were not the same when they were read again")
        at = where[at]
        n = sizes[at]
        flat = ids[np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
        out.append(pa.table({"doc_id": pa.array(docs, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))}))
    return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))})


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids, array<int>, for each row of docs, as the tokenizers library encodes the text without special tokens added.

    A null or empty text has no ids. Repeated rows repeat, a null doc_id stays null. An empty table gives an empty result; other columns are ignored.
    path names the tokenizer's file, which each worker reads. Spark reads the exchange of places and words twice where docs comes from files; from rows of the session's own it makes it twice.
    """
    spark = docs.sparkSession
    small_batches(spark)
    buckets = BUCKETS_PER_PARTITION * partitions(spark)
    split = texts(docs).mapInArrow(_split(buckets), "key long, block long, docs array<long>, counts array<int>, places binary, words binary, numbers binary").groupBy("key")
    words = split.applyInArrow(_encoded_words(path), "block long, numbers binary, sizes binary, ids binary")
    return split.cogroup(words.groupBy("block")).applyInArrow(_joined, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded, the pieces of the ids in order, special tokens included, as the library's decode() joins them where the file names no decoder: by one space.

    Null ids, like none, give an empty text; ids outside the vocabulary are passed over. A file that names a decoder is refused.
    """
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizer(path)
        if own.decoder is not None:
            raise ValueError("the tokenizer has a decoder of its own")
        vocabulary = own.get_vocab(with_added_tokens=True)
        pieces = [None] * (max(vocabulary.values(), default=-1) + 1)
        for w, i in vocabulary.items():
            pieces[i] = w
        pieces = pa.array(pieces, pa.string())
        for b in _slices(batches, "ids", SLICE):
            ids = b.column("ids")
            flat = ids.flatten()
            inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(pieces)))
            found = pieces.take(pc.if_else(inside, flat, pa.scalar(None, pa.int32())))
            at = pa.array(np.concatenate([[0], np.cumsum(pc.fill_null(ids.value_lengths(), 0).to_numpy(zero_copy_only=False))]).astype(np.int32))
            out = pc.binary_join(pa.ListArray.from_arrays(at, found), " ") if not found.null_count else pa.array([" ".join(x for x in w if x is not None) for w in pa.ListArray.from_arrays(at, found).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), out], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
