"""Packing token ids into windows by multiway differencing.

Documents become ids; full windows are cut off at once and the rest is cut into pieces of bounded length. Pieces are dealt
by a hash of piece and row into groups of bounded size. In a group, Karmarkar-Karp differencing starts with one partial partition for each piece
and always merges the two of the widest spread, largest sums onto smallest, which leaves near-equal
windows. Where the largest exceeds the capacity, the window count rises by one and differencing starts again.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts, written

CAPACITY = 2048
PIECE = 512
GROUP_PIECES = 384
END_ID = 1
#: sequence_id is the group's number times this, plus the window's number in the group.
GROUP_WINDOWS = 1 << 20


#: Texts with runs of white space of so many characters are left to library_encoder(): the faster library looks ahead on its stack, which ends at some hundred thousand.
LONG_BLANK = 100_000
_BLANK_RUN = re.compile(r"\s{%d}" % LONG_BLANK)


def long_blank(text: str) -> bool:
    return len(text) >= LONG_BLANK and _BLANK_RUN.search(text) is not None


def _special(tokenizer_path: str) -> dict[str, int]:
    """Strings that the tokenizers library reads as ids of their own."""
    with open(tokenizer_path, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}


def encoder(tokenizer_path: str, ranks_path: str, pattern: str):
    """texts -> each one's ids as little-endian unsigned 32-bit integers, those that the tokenizers library gives for tokenizer_path without special tokens added.

    They are computed from the same vocabulary in the form of ranks, by a faster library; library_encoder() is the slower way to the same ids, and the one for long runs of white space.
    """
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    names = _special(tokenizer_path)
    own = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=names)

    slow: list = []

    def ids(text: str) -> bytes:
        if long_blank(text):
            slow[:] = slow or [library_encoder(tokenizer_path)]
            return slow[0]([text])[0]
        found = own.encode(text, allowed_special=set(names)) if any(x in text for x in names) else own.encode_ordinary(text)
        return np.array(found, "<u4").tobytes()

    return lambda texts: [ids(t) for t in texts]


def library_encoder(tokenizer_path: str):
    """Like encoder(), by the tokenizers library itself."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path)
    own.no_truncation()
    own.no_padding()
    return lambda texts: [np.array(x.ids, "<u4").tobytes() for x in own.encode_batch_fast(texts, add_special_tokens=False)]


def cuts(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full windows, then near-equal pieces of the rest."""
    full = n // capacity
    out = [(i * capacity, capacity) for i in range(full)]
    rest, at = n - full * capacity, full * capacity
    parts = -(-rest // piece)
    for i in range(parts):
        length = rest // parts + (i < rest % parts)
        out.append((at, length))
        at += length
    return out


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each item, by multiway differencing."""
    if windows == 1:
        return np.zeros(len(sizes), np.int64)
    n = len(sizes)
    left, right = np.full(2 * n * 2, -1), np.full(2 * n * 2, -1)
    made, heap = n, []
    for i, size in enumerate(sizes.tolist()):
        heap.append((-size, i, [size], [i]))  # the windows that hold nothing are left out
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, sums, heads = heapq.heappop(heap)
        _, _, other, others = heapq.heappop(heap)
        # the largest of one meets the smallest of the other; what a list leaves out is empty
        a, b = len(sums), len(other)
        meet = max(0, a + b - windows)
        pairs = list(zip(sums[: a - meet], heads[: a - meet], strict=True)) + list(zip(other[: b - meet], others[: b - meet], strict=True))
        for i in range(meet):
            j, k = a - meet + i, b - 1 - i
            if made == len(left):
                left, right = np.concatenate([left, np.full(len(left), -1)]), np.concatenate([right, np.full(len(right), -1)])
            left[made], right[made] = heads[j], others[k]
            pairs.append((sums[j] + other[k], made))
            made += 1
        pairs.sort(key=lambda x: -x[0])
        sums, heads = [x[0] for x in pairs], [x[1] for x in pairs]
        spread = sums[0] - (sums[-1] if len(sums) == windows else 0)
        heapq.heappush(heap, (-spread, order, sums, heads))
        order += 1
    out = np.zeros(n, np.int64)
    for window, head in enumerate(heap[0][3]):
        todo = [head]
        while todo:
            x = todo.pop()
            if x < n:
                out[x] = window
            else:
                todo += (int(left[x]), int(right[x]))
    return out


def packed(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Windows for items of at most capacity; the count rises while a window exceeds it."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        at = differencing(sizes, windows)
        if np.bincount(at, sizes).max(initial=0) <= capacity:
            return at
        windows += 1


def _pieces(make, capacity: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = make(), struct.pack("<I", END_ID)
        for b in batches:
            rows: list[tuple] = []
            for i, ids in zip(b.column("doc_id").to_pylist(), encode(b.column("text").to_pylist()), strict=True):
                data, n = memoryview(ids + end), len(ids) // 4 + 1
                rows += [(i, start, size, zlib.crc32(data[4 * start : 4 * (start + size)]), n) for start, size in cuts(n, capacity, piece)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def _windows(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        length = group.column("length").to_numpy()
        at = np.zeros(len(length), np.int64)
        part, whole = np.flatnonzero(length < capacity), np.flatnonzero(length >= capacity)
        if len(part):
            at[part] = packed(length[part], capacity)
        at[whole] = (at[part].max() + 1 if len(part) else 0) + np.arange(len(whole))
        order = np.argsort(at, kind="stable")
        ends = np.cumsum(length[order])
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        begin = np.repeat((ends - length[order])[first], np.diff(first, append=len(order)))
        offset = np.empty(len(order), np.int64)
        offset[order] = ends - length[order] - begin
        sequence = group.column("group").to_numpy() * GROUP_WINDOWS + at
        return group.drop_columns(["group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack_documents(docs: DataFrame, make, capacity: int = CAPACITY, piece: int = PIECE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    make() gives a worker its function from texts to ids (as bytes, see encoder()); END_ID follows each document's. Each id lies in exactly one piece, each piece in
    exactly one window of at most capacity ids; window numbers have gaps. A null or empty text is the END_ID alone. Repeated rows are
    packed as often as they occur, rows with a null doc_id like others. An empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = written(texts(docs).mapInArrow(_pieces(make, capacity, piece), kinds), "pieces")
    groups = max(1, pieces.count() // group_pieces)
    # the row's number deals out repeated rows, and rows without an id, like any others
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(_windows(capacity), f"{kinds}, sequence_id long, offset long")
