"""N-gram Jaccard self-join by a partition of the token universe.

Tokens are hashed shingles. Sizes fall into bands; for each band the universe is cut into so many segments that two sets of the
needed similarity differ in fewer tokens than there are segments, so some segments are equal.

1. Equal sets are one class. Every class has a signature for each segment that it touches. Signatures of a few classes give candidate
   pairs, which stay only where they share as many rare signatures as similar sets must. A class whose rare signatures alone outnumber the
   differences that it may have is settled: each of its partners shares one of them.
2. Unsettled classes are compared by richer signatures, segments and their one-deletion neighbourhoods. A segment whose neighbourhood is
   rare as well covers two differences, so fewer segments suffice.
3. What is still unsettled lies in large groups of near copies. Cost decides which of a class's frequent segments are looked up: it
   passes over the largest, as many as it can do without, in one order for all classes, so that two similar ones keep a segment in common. Classes that
   kept segments connect make a neighbourhood. It is cut into blocks, and its first class is compared with all blocks; then those
   that this leaves outside the largest component are. Only links leave a task; pairs inside the component are never formed.

Signatures are hashes and only nominate. Candidates are verified by counting shingles whose words are compared as they are. Links are
closed into components.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, small_batches, texts, written
from .components import components
from .shingles import WORDS, exact_sets, mixed, shingle_sets

SIMILARITY = 80
#: Signatures of more classes than this are frequent.
RARE = 12
RARE_AGAIN = 12
CHUNK_BYTES = 1 << 20
FLUSH_SIGNATURES = 1 << 20
BUCKETS_PER_PARTITION = 2
SPARE = 1.1
#: Bytes of text that one side of a comparison, or one group of pairs, brings together in a task.
BLOCK_BYTES = 1 << 20

_LOW = np.uint64((1 << 48) - 1)


@lru_cache(maxsize=None)
def band(n: int) -> tuple[int, int]:
    """The number of the band of sets of n tokens, and the largest size in the band below (0: none)."""
    i, low, high = 0, 0, 4
    while n > high:
        i, low, high = i + 1, high, high * 25 // 16 + 1
    return i, low


@lru_cache(maxsize=None)
def _top(i: int) -> int:
    high = 4
    for _ in range(i):
        high = high * 25 // 16 + 1
    return high


def differences(total: int, similarity: int = SIMILARITY) -> int:
    """How many tokens two similar sets of `total` tokens together may not share."""
    return total * (100 - similarity) // (100 + similarity)


def partner(n: int, similarity: int = SIMILARITY) -> int:
    """The largest size of a set similar to one of n tokens."""
    return n * 100 // similarity


@lru_cache(maxsize=None)
def families(n: int) -> tuple[tuple[int, int, int] | None, tuple[int, int, int] | None]:
    """(band of the smaller set, segments, differences allowed) of the comparisons that a set of n tokens takes part in: with sets of its own band, and with
    sets of the band below; None where no other set can be similar."""
    i, low = band(n)
    segments = lambda b: int(SPARE * (differences(_top(b) + partner(_top(b))) + 1)) + 3
    own, below = differences(n + partner(n)), differences(n + low)
    return (i, segments(i), own) if n and own else None, (i - 1, segments(i - 1), below) if low and n <= partner(low) else None


def _segments(sets: np.ndarray, begins: np.ndarray, turn: int):
    """Signatures of the segments that each set touches, in its family number `turn`: signature, set, tokens, first token, and the family of each set."""
    sizes = np.diff(begins)
    own = [families(int(n))[turn] for n in sizes]
    kinds = np.array([x[0] if x else -1 for x in own], np.int64)
    m = np.array([x[1] if x else 0 for x in own], np.uint64)
    at = np.repeat(np.arange(len(sizes)), sizes)
    token = np.flatnonzero(kinds[at] >= 0)
    if not len(token):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, own
    at, h = at[token], sets[token]
    segment = ((h >> np.uint64(32)) * m[at]) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (segment[1:] != segment[:-1])]))
    count = np.diff(first, append=len(at))
    place = mixed(segment[first] * np.uint64(64) + kinds[at[first]].astype(np.uint64) + np.uint64(7))
    return np.add.reduceat(mixed(h), first) + place, at[first], count, token[first], own


def _groups(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key with the places that have it."""
    order = np.argsort(keys, kind="stable")
    begin = np.flatnonzero(np.diff(keys[order], prepend=-1)) if len(order) else order
    for a, z in zip(begin, np.append(begin[1:], len(order)), strict=True) if len(begin) else ():
        yield int(keys[order[a]]), order[a:z]


def _chunks(batches: Iterator[pa.RecordBatch], column: str = "doc_id") -> Iterator[tuple[list, list[bytes]]]:
    for b in batches:
        ids, data, at = b.column(column).to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), 0
        while at < len(data):
            to, size = at, 0
            while to < len(data) and (to == at or size + len(data[to]) <= CHUNK_BYTES):
                size += len(data[to])
                to += 1
            yield ids[at:to], data[at:to]
            at = to


def _packed(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unpacked(blobs: list[bytes], width: int) -> np.ndarray:
    found = [np.frombuffer(zlib.decompress(x), np.int64).reshape(-1, width) for x in blobs if x]
    return np.concatenate(found) if found else np.zeros((0, width), np.int64)


def _six_bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six_bytes(blobs: list[bytes]) -> np.ndarray:
    x = b"".join(blobs)
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


#: About a document: doc_id, n, two halves of its set's 128-bit digest, touched segments in each family (-1: no family), the largest size of the band below, the
#: parity of the band. The low 48 bits of the second half name the set in signatures; two sets of one name cost a comparison, no more.
ABOUT = 8


def _signature_rows(buckets: int):
    """Blobs of signatures and set names for each task and bucket; and, in rows without signatures, a line about each document. Equal
    sets of one task send their signatures once."""

    def flush(sig: np.ndarray, name: np.ndarray, about: np.ndarray) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("bucket", pa.int32()), ("sig", pa.binary()), ("name", pa.binary()), ("about", pa.binary())])
        for k, own in _groups(((sig >> np.uint64(48)) % np.uint64(buckets)).astype(np.int64)):
            yield pa.RecordBatch.from_pylist([{"bucket": k, "sig": _six_bytes(sig[own]), "name": _six_bytes(name[own])}], kinds)
        for k, own in _groups((mixed(about[:, 0].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)):
            yield pa.RecordBatch.from_pylist([{"bucket": k, "about": _packed(about[own])}], kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, names, about, size, seen = [], [], [], 0, set()
        for ids, data in _chunks(batches):
            sets, begins = shingle_sets(data)
            digests = [xxhash.xxh3_128_intdigest(sets[a:z].tobytes()) for a, z in zip(begins, begins[1:], strict=False)]
            halves = np.array([(d >> 64, d & (2**64 - 1)) for d in digests], np.uint64).reshape(-1, 2)
            name = halves[:, 1] & _LOW
            lead = np.array([not (d in seen or seen.add(d)) for d in digests], bool)
            lines = np.zeros((len(ids), ABOUT), np.int64)
            lines[:, 0], lines[:, 1], lines[:, 2:4] = ids, np.diff(begins), halves.view(np.int64)
            bands = [band(int(n)) for n in np.diff(begins)]
            lines[:, 6], lines[:, 7] = [x[1] for x in bands], [x[0] & 1 for x in bands]
            for turn in (0, 1):
                sig, at, _, _, own = _segments(sets, begins, turn)
                touched = np.bincount(at, minlength=len(ids)) if len(at) else np.zeros(len(ids), np.int64)
                lines[:, 4 + turn] = np.where([x is None for x in own], -1, touched)
                kind = np.array([x[0] & 1 if x else 0 for x in own], np.uint64)
                keep = lead[at]
                sigs.append(((sig & ~np.uint64(1)) | kind[at])[keep])
                names.append(name[at[keep]])
                size += len(sigs[-1])
            about.append(lines)
            if size >= FLUSH_SIGNATURES:
                yield from flush(np.concatenate(sigs), np.concatenate(names), np.concatenate(about))
                sigs, names, about, size, seen = [], [], [], 0, set()
        if about:
            yield from flush(np.concatenate(sigs), np.concatenate(names), np.concatenate(about))

    return run


def _distinct_rows(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows, sorted by the first column, then the second and so on, and how often each occurs."""
    if not len(columns[0]):
        return list(columns), np.zeros(0, np.int64)
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    begin = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))
    return [c[begin] for c in columns], np.diff(begin, append=len(order))


def _rare_pairs(member: np.ndarray, begin: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (smaller, larger) within groups of at most `most` distinct members, and the number of each pair's group."""
    low, high, group = [], [], []
    for n in range(2, most + 1):
        of = np.flatnonzero(sizes == n)
        if len(of):
            i, j = np.triu_indices(n, 1)
            x, y = member[(begin[of][:, None] + i).reshape(-1)], member[(begin[of][:, None] + j).reshape(-1)]
            low.append(np.minimum(x, y))
            high.append(np.maximum(x, y))
            group.append(np.repeat(of, len(i)))
    if not low:
        return member[:0], member[:0], np.zeros(0, np.int64)
    return np.concatenate(low), np.concatenate(high), np.concatenate(group)


#: Rows of the first round: kind 0 tells of a document or set, kind 1 of a candidate pair, kind 2 counts frequent signatures.
FOUND = "kind int, a long, b long, c long, d long, e long, f long, g long, h long"


def _table(parts: dict[int, np.ndarray]) -> pa.Table:
    kinds = np.concatenate([np.zeros(0, np.int32), *(np.full(len(x), k, np.int32) for k, x in parts.items())])
    rows = np.concatenate([np.zeros((0, ABOUT), np.int64), *(np.pad(x.astype(np.int64), ((0, 0), (0, ABOUT - x.shape[1]))) for x in parts.values())])
    return pa.table({"kind": kinds, **{c: rows[:, i] for i, c in enumerate("abcdefgh")}})


def _first_round(rare: int):
    """Kind 0: about a document; kind 1: names a, b, parity c of the family, d rare signatures that both have in this bucket; kind 2: name a, parity b, c frequent signatures in this bucket."""

    def run(table: pa.Table) -> pa.Table:
        parts = {0: _unpacked(table.column("about").to_pylist(), ABOUT)}
        some = table.filter(table.column("sig").is_valid())
        (sig, name), _ = _distinct_rows(_from_six_bytes(some.column("sig").to_pylist()), _from_six_bytes(some.column("name").to_pylist()).astype(np.int64))
        if len(sig):
            begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            sizes = np.diff(begin, append=len(sig))
            parity = (sig[begin] & np.uint64(1)).astype(np.int64)
            low, high, group = _rare_pairs(name, begin, sizes, rare)
            pairs, shared = _distinct_rows(low, high, parity[group])
            parts[1] = np.column_stack([*pairs, shared])
            often = np.repeat(sizes > rare, sizes)
            counted, times = _distinct_rows(name[often], np.repeat(parity, sizes)[often])
            parts[2] = np.column_stack([*counted, times])
        return _table(parts)

    return run


def _neighbourhoods(sets: np.ndarray, begins: np.ndarray):
    """(signature, set, tag) for segments and their one-deletion neighbourhoods, and needs. tag: 4 x segment number + 2 if it has several tokens + 1 for a deletion, apart for each
    family; needs: of each family and set, the units to spare beyond the differences allowed; rooms: the same in whole segments."""
    out, needs, rooms = [], [], []
    for turn in (0, 1):
        sig, at, count, first, own = _segments(sets, begins, turn)
        units = np.bincount(at, np.where(count > 1, 2, 1), minlength=len(own)).astype(np.int64) if len(at) else np.zeros(len(own), np.int64)
        touched = np.bincount(at, minlength=len(own)).astype(np.int64) if len(at) else units
        needs.append([u - x[2] - 1 if x else 1 << 30 for u, x in zip(units.tolist(), own, strict=True)])
        rooms.append([u - x[2] - 1 if x else 1 << 30 for u, x in zip(touched.tolist(), own, strict=True)])
        number = np.arange(len(at)) * 4 + np.where(count > 1, 2, 0) + (1 << 40) * turn
        out.append((sig, at, number))
        several = np.flatnonzero(count > 1)
        n = count[several]
        token = np.repeat(first[several], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out.append((np.repeat(sig[several], n) - mixed(sets[token]), np.repeat(at[several], n), np.repeat(number[several], n) + 1))
    return (*(np.concatenate(x) for x in zip(*out, strict=True)), needs + rooms)


def _second_rows(buckets: int):
    """Like the first round's rows, with tags; about: the set, what each family has to spare in units and in whole segments, and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("bucket", pa.int32()), ("sig", pa.binary()), ("rows", pa.binary()), ("about", pa.binary())])
        for ids, data in _chunks(batches, "rep"):
            sets, begins = shingle_sets(data)
            ids = np.array(ids, np.int64)
            sig, at, tag, needs = _neighbourhoods(sets, begins)
            about = np.column_stack([ids, *(np.array(x, np.int64) for x in needs), np.diff(begins)])
            for k, own in _groups((mixed(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)):
                yield pa.RecordBatch.from_pylist([{"bucket": k, "about": _packed(about[own])}], kinds)
            for k, own in _groups(((sig >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)):
                yield pa.RecordBatch.from_pylist([{"bucket": k, "sig": sig[own].tobytes(), "rows": _packed(np.column_stack([ids[at[own]], tag[own]]))}], kinds)

    return run


#: Rows of the second round: candidate pairs (a, b), and blobs for a group of sets: about them, and their frequent signatures.
SECOND = "group int, about binary, often binary, a long, b long"
SECOND_ABOUT = 6


def _second_round(rare: int, groups: int):
    """Pairs a, b of rare signatures; what is known of the sets and the frequent signatures (set, tag, signature, sets that have it), packed by groups of sets."""

    def run(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("group", "about", "often", "a", "b")}

        def pack(x: np.ndarray, into: str) -> None:
            for k, own in _groups((mixed(x[:, 0].astype(np.uint64)) % np.uint64(groups)).astype(np.int64)):
                for c in out:
                    out[c].append({"group": k, into: _packed(x[own])}.get(c))

        pack(_unpacked(table.column("about").to_pylist(), SECOND_ABOUT), "about")
        rows = _unpacked(table.column("rows").to_pylist(), 2)
        if len(rows):
            sig = np.frombuffer(b"".join(x for x in table.column("sig").to_pylist() if x), np.uint64)
            (sig, doc, tag), _ = _distinct_rows(sig, rows[:, 0], rows[:, 1])
            # a set may have a signature by several deletions; it counts once
            once = np.concatenate([[True], (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])])
            number = np.cumsum(once) - 1
            begin = np.flatnonzero(np.concatenate([[True], sig[once][1:] != sig[once][:-1]]))
            sizes = np.diff(begin, append=once.sum())
            low, high, _ = _rare_pairs(doc[once], begin, sizes, rare)
            (low, high), _ = _distinct_rows(low, high)
            size = np.repeat(sizes, sizes)[number]
            often = size > rare
            pack(np.column_stack([doc, tag, sig.view(np.int64), size])[often], "often")
            for c, x in (("a", low.tolist()), ("b", high.tolist())):
                out[c] += x
            for c in ("group", "about", "often"):
                out[c] += [None] * len(low)
        return pa.table({c: pa.array(x, t) for (c, x), t in zip(out.items(), (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)})

    return run


def _kept_segments(table: pa.Table) -> pa.Table:
    """sig, doc: the frequent whole segments that unsettled sets look up. A set whose rare segments and neighbourhoods suffice has none. Each of the others passes over its most frequent segments, as
    many as it can do without; the order, by size and signature, is the same for all. Sets of so few segments that even all of them would not do meet in a group of their own size, and the next."""
    about = _unpacked(table.column("about").to_pylist(), SECOND_ABOUT)
    rows = _unpacked(table.column("often").to_pylist(), 4)
    sig, doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(rows):
        # versions of a document count as its poorest
        order = np.argsort(about[:, 0], kind="stable")
        ids, begin = np.unique(about[order, 0], return_index=True)
        known = np.minimum.reduceat(about[order], begin)
        own, tag = np.searchsorted(ids, rows[:, 0]), rows[:, 1]
        turn, segment, whole = tag >> 40, (tag & ((1 << 40) - 1)) >> 2, tag % 2 == 0
        units = np.where(whole & (tag % 4 >= 2), 2, 1)
        by = np.lexsort((segment, turn, own))
        first = np.flatnonzero(np.concatenate([[True], np.any([np.diff(x[by]) != 0 for x in (own, turn, segment)], axis=0)]))
        lost = np.zeros((len(ids), 2), np.int64)
        np.add.at(lost, (own[by[first]], turn[by[first]]), np.maximum.reduceat(units[by], first))
        late = (lost > known[:, 1:3]).any(axis=1)
        at = np.flatnonzero(whole & late[own])
        by = at[np.lexsort((rows[at, 2], rows[at, 3], turn[at], own[at]))[::-1]]
        key = own[by] * 2 + turn[by]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(by) else by
        place = np.arange(len(by)) - np.repeat(begin, np.diff(begin, append=len(by)))
        keep = by[place >= known[own[by], 3 + turn[by]]]
        poor = np.flatnonzero(late & (known[:, 3:5] < 0).any(axis=1))
        size = np.floor(np.log2(np.maximum(1, known[poor, 5])) * 3).astype(np.int64)
        sig, doc = np.concatenate([rows[keep, 2], size, size + 1]), np.concatenate([rows[keep, 0], ids[poor], ids[poor]])
        (sig, doc), _ = _distinct_rows(sig, doc)
    return pa.table({"sig": pa.array(sig, pa.int64()), "doc": pa.array(doc, pa.int64())})


def _numbered_sets(words: int, *columns: pa.ChunkedArray) -> list[list[np.ndarray]]:
    """For each column of texts its sets; shingles are numbered alike in all of them."""
    whole = pa.concat_arrays([c for column in columns for c in column.cast(pa.large_string()).chunks]) if any(len(c) for c in columns) else pa.array([], pa.large_string())
    ids, begins = exact_sets(whole, words)
    sets, out = [ids[a:z] for a, z in zip(begins, begins[1:], strict=False)], []
    for c in columns:
        out.append(sets[: len(c)])
        sets = sets[len(c) :]
    return out


def _linked_pairs(similarity: int, words: int):
    """The pairs (a, b) that are similar. Texts that share a doc_id count as its versions; one similar version will do."""

    def run(pairs: pa.Table, held: pa.Table) -> pa.Table:
        sets: dict[int, list[np.ndarray]] = {}
        for i, x in zip(held.column("rep").to_pylist(), _numbered_sets(words, held.column("text"))[0], strict=True):
            sets.setdefault(i, []).append(x)
        keep = []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
            both = ((len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y)) for x in sets.get(a, []) for y in sets.get(b, []))
            keep.append(any(n and n * 100 >= (total - n) * similarity for n, total in both))
        return pairs.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, held: DataFrame, similarity: int, words: int = WORDS) -> DataFrame:
    """The similar ones of distinct pairs (a, b). Pairs are dealt by the smallest candidate of a, which groups of copies have in common, into groups of bounded bytes; a text
    goes once to each group that needs it."""
    spark = held.sparkSession
    mean = held.agg(F.avg(F.octet_length("text"))).first()[0] or 0
    groups = max(partitions(spark), int(2 * pairs.count() * mean / BLOCK_BYTES) + 1)
    least = pairs.groupBy(F.col("b").alias("of")).agg(F.min("a").alias("hub"))
    dealt = pairs.join(least, F.col("a") == F.col("of"), "left").select("a", "b", F.pmod(F.xxhash64(F.coalesce("hub", "a")), F.lit(groups)).cast("int").alias("deal"))
    wanted = dealt.select("deal", F.col("a").alias("want")).unionByName(dealt.select("deal", F.col("b").alias("want"))).distinct()
    sent = held.join(wanted.hint("merge"), F.col("want") == F.col("rep")).select(F.col("deal").alias("to"), "rep", "text")
    return dealt.groupBy("deal").cogroup(sent.groupBy("to")).applyInArrow(_linked_pairs(similarity, words), "a long, b long")


def _linked_blocks(similarity: int, words: int):
    """(a, b) for each queried set and one similar member of each other component in the block."""

    def run(members: pa.Table, asked: pa.Table) -> pa.Table:
        sets, queries = _numbered_sets(words, members.column("text"), asked.column("text"))
        doc, comp = members.column("doc").to_numpy(), members.column("comp").to_numpy()
        sizes = np.array([len(x) for x in sets], np.int64)
        kinds = 1 + max((int(x.max(initial=0)) for x in (*sets, *queries)), default=0)
        shingle = np.concatenate([np.zeros(0, np.int64), *sets])
        order = np.argsort(shingle, kind="stable")
        owner = np.repeat(np.arange(len(sets)), sizes)[order]
        edge = np.concatenate([[0], np.cumsum(np.bincount(shingle, minlength=kinds))])
        a, b = [], []
        for i, c, x in zip(asked.column("doc").to_pylist(), asked.column("comp").to_pylist(), queries, strict=True):
            n = edge[x + 1] - edge[x]
            place = np.repeat(edge[x], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            shared = np.bincount(owner[place], minlength=len(sets))
            fits = np.flatnonzero((shared > 0) & (shared * 100 >= (len(x) + sizes - shared) * similarity) & (comp != c))
            if len(fits):
                _, first = np.unique(comp[fits], return_index=True)
                a += [i] * len(first)
                b += doc[fits[first]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _compared(members: DataFrame, asked: DataFrame, held: DataFrame, similarity: int, words: int) -> DataFrame:
    """Links between asked (hood, doc, comp) and members (hood, doc, comp, n) of the same neighbourhood and other components. Both are cut into blocks of bounded
    bytes by hash; every pair of blocks is one group."""
    size = lambda x, name: x.groupBy(F.col("hood").alias(f"{name}_hood")).agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias(name))
    texts_of = lambda x: held.select("rep", "text", F.octet_length("text").alias("bytes")).join(x.hint("merge"), F.col("rep") == F.col("doc")).select("hood", "doc", "comp", "bytes", "text")
    members, asked = written(texts_of(members), "members"), written(texts_of(asked), "asked")
    grid = written(size(members, "rows").join(size(asked, "columns"), F.col("rows_hood") == F.col("columns_hood")).select("rows_hood", F.greatest("rows", F.lit(1)).alias("rows"), F.greatest("columns", F.lit(1)).alias("columns")), "grid")
    deal = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members.join(grid, F.col("hood") == F.col("rows_hood")).select("hood", deal("rows").alias("row"), every("columns").alias("column"), "doc", "comp", "text")
    right = asked.join(grid, F.col("hood") == F.col("rows_hood")).select("hood", every("rows").alias("row"), deal("columns").alias("column"), "doc", "comp", "text")
    return left.groupBy("hood", "row", "column").cogroup(right.groupBy("hood", "row", "column")).applyInArrow(_linked_blocks(similarity, words), "a long, b long")


def labelled(rows: DataFrame, labels: DataFrame, node: str, into: str) -> DataFrame:
    own = labels.select(F.col("node").alias("l_node"), F.col("label").alias("l_label"))
    return rows.join(own, F.col(node) == F.col("l_node"), "left").withColumn(into, F.coalesce("l_label", node)).drop("l_node", "l_label")


def large_groups(rows: DataFrame, held: DataFrame, links: DataFrame, similarity: int, words: int = WORDS) -> DataFrame:
    """links and those among sets that share frequent signatures. rows: sig, doc."""
    first = written(rows.groupBy(F.col("sig").alias("f_sig")).agg(F.min("doc").alias("pivot")), "pivots")
    # a class is tied to the first of its pivots, and that one to the others: of these pairs few are distinct
    tied = written(rows.join(first, F.col("sig") == F.col("f_sig")).groupBy("doc").agg(F.collect_set("pivot").alias("pivots")), "tied")
    low = F.array_min("pivots").alias("a")
    hoods = components(tied.select(low, F.col("doc").alias("b")).unionByName(tied.select(low, F.explode("pivots").alias("b"))).distinct())
    members = labelled(hoods.select(F.col("node").alias("doc"), F.col("label").alias("hood")), components(links), "doc", "comp")
    members = written(members, "hoods")
    star = _compared(members, members.where("doc = hood"), held, similarity, words)
    links = written(links.unionByName(star), "links")
    marked = written(labelled(members.drop("comp"), components(links), "doc", "comp"), "marked")
    parts = marked.groupBy("hood", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy(F.col("hood").alias("t_hood")).agg(F.max_by("comp", F.struct("k", "comp")).alias("top"), F.count(F.lit(1)).alias("parts"))
    parts = written(parts.where("parts > 1"), "parts")
    open_ = marked.join(parts, F.col("hood") == F.col("t_hood")).select("hood", "doc", "comp", "top")
    open_ = written(open_, "open")
    return written(links.unionByName(_compared(open_.drop("top"), open_.where("comp <> top").drop("top"), held, similarity, words)), "links")


def _allowed(n: Column, other: Column, similarity: int) -> Column:
    """differences() as a column."""
    return F.floor((n + other) * (100 - similarity) / (100 + similarity)).cast("long")


def _classes(found: DataFrame, similarity: int) -> DataFrame:
    """One row for each distinct set: hi, lo, n, rep (its smallest doc_id), name, parity, and for both families (own, below) the rare segments and the differences allowed; unsettled."""
    about = found.where("kind = 0 and b > 0")
    sets = about.groupBy(F.col("c").alias("hi"), F.col("d").alias("lo"), F.col("b").alias("n")).agg(F.min("a").alias("rep"), *(F.max(x).alias(y) for x, y in zip("efgh", ("touched", "touched_below", "low", "parity"), strict=True)))
    often = found.where("kind = 2").groupBy(F.col("a").alias("o_name")).agg(*(F.sum(F.when(F.col("b") == k, F.col("c")).otherwise(0)).alias(f"often_{k}") for k in (0, 1)))
    named = sets.withColumn("name", F.col("lo").bitwiseAND(F.lit((1 << 48) - 1))).join(often, F.col("name") == F.col("o_name"), "left").fillna(0, ["often_0", "often_1"])
    even = F.col("parity") == 0
    n = F.col("n")
    return named.select(
        "hi", "lo", "n", "rep", "name", "parity",
        (F.col("touched") - F.when(even, F.col("often_0")).otherwise(F.col("often_1"))).alias("own"),
        (F.col("touched_below") - F.when(even, F.col("often_1")).otherwise(F.col("often_0"))).alias("below"),
        F.when(F.col("touched") >= 0, _allowed(n, F.floor(n * 100 / similarity), similarity)).otherwise(-(1 << 30)).alias("own_allowed"),
        F.when(F.col("touched_below") >= 0, _allowed(n, F.col("low"), similarity)).otherwise(-(1 << 30)).alias("below_allowed"),
    ).withColumn("unsettled", (F.col("own") <= F.col("own_allowed")) | (F.col("below") <= F.col("below_allowed")))


def _fits(x: str, y: str, similarity: int) -> Column:
    return (F.col(x) * 100 >= F.col(y) * similarity) & (F.col(y) * 100 >= F.col(x) * similarity)


def _candidates(found: DataFrame, classes: DataFrame, similarity: int) -> DataFrame:
    """Pairs of reps (a, b) whose common rare signatures are as many as similar sets must have."""
    pairs = found.where("kind = 1").groupBy("a", "b", "c").agg(F.sum("d").alias("shared"))
    for side in "ab":
        own = classes.select(*(F.col(c).alias(f"{side}_{c}") for c in ("name", "rep", "n", "parity", "own", "below")))
        pairs = pairs.join(own, F.col(side) == F.col(f"{side}_name"))
    rare = lambda s: F.when(F.col("c") == F.col(f"{s}_parity"), F.col(f"{s}_own")).otherwise(F.col(f"{s}_below"))
    need = F.greatest(rare("a"), rare("b")) - _allowed(F.col("a_n"), F.col("b_n"), similarity)
    pairs = pairs.where(_fits("a_n", "b_n", similarity) & (F.col("a_rep") != F.col("b_rep")) & (F.col("shared") >= need))
    return pairs.select(F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b")).distinct()


def jaccard_components(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, class_id.

    component_id is the smallest doc_id that links lead to, class_id the smallest one with the same set. Null texts and texts without words have
    no shingles and link with nothing. Rows that share a doc_id are versions of one document and have its component in common; repeated rows repeat.
    A row with a null doc_id has null ids and links with nothing. An empty table gives an empty result; other columns are ignored.
    """
    if similarity != SIMILARITY:
        raise ValueError("bands are laid out for a similarity of 80 %")
    spark = docs.sparkSession
    small_batches(spark)
    buckets = BUCKETS_PER_PARTITION * partitions(spark)
    rows = texts(docs)
    named = rows.where("doc_id is not null")
    sent = named.mapInArrow(_signature_rows(buckets), "bucket int, sig binary, name binary, about binary")
    found = written(sent.groupBy("bucket").applyInArrow(_first_round(RARE), FOUND), "found")
    classes = written(_classes(found, similarity), "classes")
    about = found.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n"), F.col("c").alias("hi"), F.col("d").alias("lo"))
    own = classes.select(F.col("hi").alias("k_hi"), F.col("lo").alias("k_lo"), F.col("n").alias("k_n"), "rep")
    known = about.where("n > 0").join(own, (F.col("hi") == F.col("k_hi")) & (F.col("lo") == F.col("k_lo")) & (F.col("n") == F.col("k_n"))).select("doc_id", "n", "rep")
    known = written(known.unionByName(about.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("rep"))), "known")
    pairs = written(_candidates(found, classes, similarity), "candidates")
    involved = pairs.select(F.col("a").alias("want"), F.lit(False).alias("unsettled")).unionByName(pairs.select(F.col("b").alias("want"), F.lit(False).alias("unsettled"))).unionByName(classes.where("unsettled").select(F.col("rep").alias("want"), "unsettled"))
    involved = written(involved.groupBy("want").agg(F.max("unsettled").alias("unsettled")), "involved")
    held = written(named.join(involved.hint("merge"), F.col("doc_id") == F.col("want")).select(F.col("doc_id").alias("rep"), "text", "unsettled"), "texts")
    # second round
    again = held.where("unsettled").select("rep", "text").mapInArrow(_second_rows(buckets), "bucket int, sig binary, rows binary, about binary")
    second = written(again.groupBy("bucket").applyInArrow(_second_round(RARE_AGAIN, max(1, buckets // 8)), SECOND), "second")
    held = held.select("rep", "text")
    spans = classes.groupBy("rep").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    more = second.where("a is not null").select("a", "b").distinct()
    for side in "ab":
        more = more.join(spans.select(F.col("rep").alias(f"{side}_rep"), F.col("lo").alias(f"{side}_lo"), F.col("hi").alias(f"{side}_hi")), F.col(side) == F.col(f"{side}_rep"))
    more = more.where((F.col("a_hi") * 100 >= F.col("b_lo") * similarity) & (F.col("b_hi") * 100 >= F.col("a_lo") * similarity)).select("a", "b")
    links = verified(written(pairs.unionByName(more).distinct(), "pairs"), held, similarity)
    # versions of a document belong together
    several = known.where("n > 0").groupBy(F.col("doc_id").alias("a")).agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    links = written(links.unionByName(several.select(F.col("low").alias("a"), F.col("high").alias("b"))), "links")
    # third round
    kept = written(second.where("group is not null").select("group", "about", "often").groupBy("group").applyInArrow(_kept_segments, "sig long, doc long"), "kept")
    if not kept.isEmpty():
        links = large_groups(kept, held, links, similarity)
    done = labelled(known, components(links), "rep", "component_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("rep").alias("class_id"))
    unnamed = rows.where("doc_id is null").mapInArrow(_sizes, "doc_id long, n_shingles long, component_id long, class_id long")
    return done.unionByName(unnamed)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, data in _chunks(batches):
        none = pa.nulls(len(ids), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(np.diff(shingle_sets(data)[1]), pa.int64()), none, none], ["doc_id", "n_shingles", "component_id", "class_id"])
