"""Removal of repeated passages by suffix sorting, deep-shallow style.

Each window of 50 bytes has one anchor: its 20-byte gram of least hash, the first of equals. Equal windows have equal anchors at equal
places, so windows need comparing only where their anchors agree.

1. Anchors are dealt by hash; those that occur in two documents or more are handed back to their documents.
2. For each such anchor the documents send the stretch of text that its windows cover, equal stretches once for each task.
3. Equal stretches are merged by content: all but their smallest holder lose them whole. Where an anchor has several distinct stretches,
   their windows are sorted: multikey quicksort to a shallow depth of 24 bytes, then blind tries order the groups that remain tied. A
   window is removed where a smaller doc_id has it too.
4. Removed windows return to their documents, whose texts lose the bytes they cover.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, rest_of, small_batches, texts

WINDOW, GRAM = 50, 20
SHALLOW_WORDS = 3
CHUNK_BYTES = 1 << 20
FLUSH_ANCHORS = 1 << 20
FLUSH_STRETCHES = 1 << 17
BUCKETS_PER_PARTITION = 2
#: A bucket's stretches are compared in passes of about so many bytes, and sorted about so many windows at a time, so a task's memory does not follow its bucket. The result doesn't depend on them.
PASS_BYTES = 16 << 20
SORT_WINDOWS = 1 << 19

#: What a document is told of its shared anchors: 32 bits of each hash. A chance agreement sends a stretch too many, no more.
_SHORT = np.uint64((1 << 32) - 1)
_PLACE = np.uint64((1 << 30) - 1)
#: Places in a chunk take 30 bits. A chunk holds one text or less than CHUNK_BYTES.
MOST_BYTES = (1 << 30) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(10).integers(1, 2**63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, CHUNK_BYTES + (1 << 18))
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[:] = both
    return _powers[0][:n], _powers[1][:n]


def anchors(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor of the texts data[begin:end]: its hash, first and last window start, and text number."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none.astype(np.uint64), none, none, none
    up, down = _powers_to(n)
    up, down = up[:n], down[:n]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=total[1:])
    h = (total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    span, need = 1, WINDOW - GRAM + 1
    while span * 2 <= need:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if need > span:
        least = np.minimum(least[: -(need - span)], least[need - span :])
    edge = np.zeros(n + 1, np.int32)
    long = ends - begins >= WINDOW
    np.add.at(edge, begins[long], 1)
    np.add.at(edge, ends[long] - WINDOW + 1, -1)
    starts = np.flatnonzero(np.cumsum(edge[:-1])[: len(least)])
    if not len(starts):
        return none.astype(np.uint64), none, none, none
    place = (least[starts] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    last = np.append(first[1:], len(place)) - 1
    return h[place[first]], starts[first], starts[last], np.searchsorted(begins[long], starts[first], side="right") - 1 if long.all() else np.flatnonzero(long)[np.searchsorted(begins[long], starts[first], side="right") - 1]


def _chunks(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    """data, begins, ends and the other columns of a few rows at a time."""
    for b in batches:
        data = b.column("text").cast(pa.binary()).to_pylist()
        rest = [b.column(c).to_pylist() for c in columns]
        at = 0
        while at < len(data):
            to, size = at, 0
            while to < len(data) and (to == at or size + len(data[to]) <= CHUNK_BYTES):
                size += len(data[to])
                to += 1
            if size > MOST_BYTES:
                raise ValueError(f"a text of {size} bytes; at most {MOST_BYTES} can be read")
            ends = np.cumsum([len(x) for x in data[at:to]])
            yield b"".join(data[at:to]), ends - np.diff(ends, prepend=0), ends, *(x[at:to] for x in rest)
            at = to


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorting order of keys and the places in it where groups begin."""
    order = np.argsort(keys, kind="stable")
    return order, np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]) != 0)


def _packed(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unpacked(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), kind)


def _six_bytes(x: np.ndarray) -> bytes:
    """Hashes cut to 48 bits: within a bucket that is enough to make chance agreements rare, and those cost only a comparison."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six_bytes(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def _by_bucket(bucket: np.ndarray, *columns: np.ndarray):
    order, begin = _grouped(bucket)
    for a, z in zip(begin, np.append(begin[1:], len(order)), strict=True):
        own = order[a:z]
        yield int(bucket[own[0]]), *(c[own] for c in columns)


def _anchor_rows(buckets: int):
    """For each task and bucket: hashes and documents; seen tells of rows that need no further test."""

    def flush(sig: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        order, begin = _grouped(sig)
        sig, doc = sig[order], doc[order]
        low, high = np.minimum.reduceat(doc, begin), np.maximum.reduceat(doc, begin)
        sizes = np.diff(begin, append=len(sig))
        shared = np.repeat(low != high, sizes)
        # one row of each group goes on: the first one of its smallest document
        smallest = np.flatnonzero(doc == np.repeat(low, sizes))
        group = np.repeat(np.arange(len(begin)), sizes)[smallest]
        lead = smallest[np.diff(group, prepend=-1) != 0]
        for seen, own in ((False, lead), (True, np.flatnonzero(shared))):
            if len(own):
                deal = (doc[own].astype(np.uint64) * np.uint64(_BASE) >> np.uint64(33) if seen else sig[own]) % np.uint64(buckets)
                for k, s, d in _by_bucket(deal.astype(np.int64), sig[own], doc[own]):
                    by = np.argsort(d, kind="stable")
                    docs, at = np.unique(d[by], return_index=True)
                    counts = np.diff(at, append=len(d)).astype(np.int32)
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([k], pa.int32()), "seen": [seen], "sig": [_six_bytes(s[by])], "doc": [_packed(np.diff(docs, prepend=0))], "count": [_packed(counts)]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for data, begins, ends, ids in _chunks(batches, ("doc_id",)):
            sig, _, _, text = anchors(np.frombuffer(data, np.uint8), begins, ends)
            if len(sig):
                held.append((sig, np.array(ids, np.int64)[text]))
                size += len(sig)
            if size >= FLUSH_ANCHORS:
                s, d = (np.concatenate(x) for x in zip(*held, strict=True))
                yield from flush(s, d)
                held, size = [], 0
        if held:
            s, d = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from flush(s, d)

    return run


def _rows_of(sigs: list[bytes], docs: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sig = np.concatenate([_from_six_bytes(x) for x in sigs]) if sigs else np.zeros(0, np.uint64)
    doc = [np.repeat(np.cumsum(_unpacked(d, np.int64)), _unpacked(c, np.int32)) for d, c in zip(docs, counts, strict=True)]
    return sig, np.concatenate(doc) if doc else np.zeros(0, np.int64)


def _shared_anchors(buckets: int):
    """The hashes of anchors that other documents have too, dealt by document."""

    def run(table: pa.Table) -> pa.Table:
        parts: dict[bool, tuple[list, list, list]] = {False: ([], [], []), True: ([], [], [])}
        for seen, *row in zip(*(table.column(c).to_pylist() for c in ("seen", "sig", "doc", "count")), strict=True):
            for into, x in zip(parts[seen], row, strict=True):
                into.append(x)
        sig, doc = _rows_of(*parts[False])
        if len(sig):
            order, begin = _grouped(sig)
            low, high = np.minimum.reduceat(doc[order], begin), np.maximum.reduceat(doc[order], begin)
            own = order[np.repeat(low != high, np.diff(begin, append=len(sig)))]
            sig, doc = sig[own], doc[own]
        s, d = _rows_of(*parts[True])
        sig, doc = (np.concatenate([sig, s]) & _SHORT).astype(np.uint32), np.concatenate([doc, d])
        out: tuple[list, list, list] = ([], [], [])
        if len(doc):
            deal = (doc.astype(np.uint64) * np.uint64(_BASE) >> np.uint64(35)) % np.uint64(buckets)
            for k, x, y in _by_bucket(deal.astype(np.int64), sig, doc):
                by = np.argsort(y, kind="stable")
                for into, v in zip(out, (k, x[by].tobytes(), _packed(np.diff(y[by], prepend=0))), strict=True):
                    into.append(v)
        return pa.table({"deal": pa.array(out[0], pa.int32()), "sig": pa.array(out[1], pa.binary()), "doc": pa.array(out[2], pa.binary())})

    return run


def _told(table: pa.Table) -> pa.Table:
    """One row for each document: the hashes of its shared anchors."""
    sig = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("sig").to_pylist()])
    doc = np.concatenate([np.cumsum(_unpacked(x, np.int64)) for x in table.column("doc").to_pylist()])
    by = np.lexsort((sig, doc))
    docs, at = np.unique(doc[by], return_index=True)
    blobs = [np.unique(sig[by[a:z]]).tobytes() for a, z in zip(at, np.append(at, len(doc))[1:], strict=True)]
    return pa.table({"a_id": pa.array(docs, pa.int64()), "sigs": pa.array(blobs, pa.binary())})


def _runs(rows: np.ndarray) -> np.ndarray:
    """Spans (document, hash, begin, end) in order, those that touch as one."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.concatenate([[True], (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)])
    text = np.cumsum(new) << 31
    reach = np.maximum.accumulate(text + rows[:, 3]) - text
    begin = np.flatnonzero(new | np.concatenate([[True], rows[1:, 2] > reach[:-1]]))
    return np.column_stack([rows[begin, :3], reach[np.append(begin[1:], len(rows)) - 1]])


def _stretches(buckets: int):
    """For each task and bucket: distinct stretches of text, and where in which documents they lie; documents that are not the smallest holder of a stretch lose it at once."""

    def flush(found: dict, deal: int) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        gone: dict[int, list] = {}
        for (sig, text), places in found.items():
            low = min(p[0] for p in places)
            by.setdefault(sig % deal, []).append((sig, text, [p for p in places if p[0] == low]))
            for doc, h, at in places:
                if doc != low:
                    gone.setdefault((doc * _BASE >> 33) % deal, []).append((doc, h, at, at + len(text)))
        empty = b""
        for k in by.keys() | gone.keys():
            own, lost = by.get(k, []), np.array(gone.get(k, []), np.int64).reshape(-1, 4)
            row = {"bucket": pa.array([k], pa.int32()), "lost": [_packed(_runs(lost)) if len(lost) else empty]}
            row["sig"] = [np.array([x[0] for x in own], np.uint64).tobytes()]
            row["size"] = [_packed(np.array([len(x[1]) for x in own], np.int32))]
            row["text"] = [zlib.compress(b"".join(x[1] for x in own), 1)]
            row["places"] = [_packed(np.array([(i, *p) for i, x in enumerate(own) for p in x[2]], np.int64).reshape(-1, 4))]
            yield pa.RecordBatch.from_pydict(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, bytes], list] = {}
        size = 0
        for data, begins, ends, ids, hs, sigs in _chunks(batches, ("doc_id", "h", "sigs")):
            sig, first, last, text = anchors(np.frombuffer(data, np.uint8), begins, ends)
            if not len(sig):
                continue
            cut = np.searchsorted(text, np.arange(len(ids) + 1))
            for i, blobs in enumerate(sigs):
                a, z = cut[i], cut[i + 1]
                wanted = np.frombuffer(blobs, np.uint32)
                own = a + np.flatnonzero(np.isin((sig[a:z] & _SHORT).astype(np.uint32), wanted))
                begin = int(begins[i])
                for s, p, q in zip(sig[own].tolist(), first[own].tolist(), last[own].tolist(), strict=True):
                    found.setdefault((s, data[p : q + WINDOW]), []).append((ids[i], hs[i], p - begin))
                size += len(own)
            if size >= FLUSH_STRETCHES:
                yield from flush(found, buckets)
                found, size = {}, 0
        if found:
            yield from flush(found, buckets)

    return run


def multikey_quicksort(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by their first `depth` words, and each sorted row's tie group, by three-way multikey quicksort, all groups a round at a time.

    A group's middle row gives the pivot; rows with a smaller, equal or larger word at the group's depth part into three groups, and the equal one goes a word deeper."""
    n = len(words)
    order, start, level = np.arange(n), np.zeros(n, bool), np.zeros(n, np.int64)
    start[:1] = True
    active = np.arange(n if n > 1 and depth else 0)
    while len(active):
        rows = order[active]
        key = words[rows, level[active]]
        begin = np.flatnonzero(start[active])
        sizes = np.diff(begin, append=len(active))
        pivot = np.repeat(key[begin + sizes // 2], sizes)
        part = np.repeat(np.arange(len(begin)) * 3, sizes) + (key >= pivot) + (key > pivot)
        by = np.argsort(part, kind="stable")
        order[active], part = rows[by], part[by]
        first = np.concatenate([[True], part[1:] != part[:-1]])
        start[active] = first
        level[active] += part % 3 == 1
        sizes = np.diff(np.flatnonzero(first), append=len(active))
        active = active[(np.repeat(sizes, sizes) > 1) & (level[active] < depth)]
    return order, np.cumsum(start) - 1


def blind_tries(rows: np.ndarray, order: np.ndarray, group: np.ndarray, at: int) -> np.ndarray:
    """Splits tie groups until their rows are equal, all groups' tries a level at a time: a node skips to the first byte in which a row differs from the
    group's leader, and its children are that byte's values. Sorted rows keep their places within groups."""
    group = group.copy()
    active = np.flatnonzero(np.bincount(group)[group] > 1) if len(group) else np.zeros(0, np.int64)
    while len(active):
        g = group[active]
        begin = np.flatnonzero(np.diff(g, prepend=-1))
        sizes = np.diff(begin, append=len(g))
        leader = np.repeat(order[active[begin]], sizes)
        differs = rows[order[active], at:] != rows[leader, at:]
        skip = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
        node = np.repeat(np.minimum.reduceat(skip, begin), sizes)
        open_ = node < rows.shape[1] - at
        active, node, g = active[open_], node[open_], g[open_]
        if not len(active):
            break
        byte = rows[order[active], at + node]
        by = np.lexsort((byte, g))
        order[active] = order[active[by]]
        byte = byte[by]
        new = np.concatenate([[False], (np.diff(g) == 0) & (byte[1:] != byte[:-1])])
        step = np.zeros(len(group), np.int64)
        step[active[new]] = 1
        group = np.cumsum(np.concatenate([[0], (np.diff(group) != 0)]) + step)
        # of the groups that were open, those with more than one row stay so
        counts = np.bincount(group)
        active = active[counts[group[active]] > 1]
    return group


def smallest_holders(data: bytes, starts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each window start in data, the smallest of docs over all windows of the same bytes."""
    rows = np.zeros((len(starts), -(-WINDOW // 8) * 8), np.uint8)
    rows[:, :WINDOW] = np.frombuffer(data, np.uint8)[starts[:, None] + np.arange(WINDOW)]
    order, group = multikey_quicksort(rows.view(">u8").astype(np.uint64), SHALLOW_WORDS)
    group = blind_tries(rows[:, :WINDOW], order, group, 8 * SHALLOW_WORDS)
    begin = np.flatnonzero(np.diff(group, prepend=-1))
    low = np.minimum.reduceat(docs[order], begin)
    out = np.empty(len(starts), np.int64)
    out[order] = np.repeat(low, np.diff(begin, append=len(order)))
    return out


def _of_pass(rows: list[tuple], buckets: int, part: int, parts: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct stretches of one pass in order of their anchors, each one's anchor number, and their places. Whatever agrees in its anchor is in one pass."""
    known: dict[tuple[int, bytes], int] = {}
    places = []
    for sig, sizes, text, own in rows:
        mine = np.flatnonzero(sig // np.uint64(buckets) % np.uint64(parts) == part)
        if not len(mine):
            continue
        text, ends = zlib.decompress(text), np.cumsum(sizes)
        number = np.full(len(sig), -1)
        keys = zip(sig[mine].tolist(), (text[z - n : z] for z, n in zip(ends[mine].tolist(), sizes[mine].tolist(), strict=True)), strict=True)
        number[mine] = [known.setdefault(key, len(known)) for key in keys]
        at = _unpacked(own, np.int64).reshape(-1, 4).copy()
        at[:, 0] = number[at[:, 0]]
        places.append(at[at[:, 0] >= 0])
    _, anchor = np.unique(np.array([k[0] for k in known], np.uint64), return_inverse=True)
    by = np.argsort(anchor, kind="stable")
    whole = [k[1] for k in known]
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    at = np.concatenate(places) if places else np.zeros((0, 4), np.int64)
    at[:, 0] = rank[at[:, 0]]
    return [whole[i] for i in by], anchor[by], at


def _slices(weights: np.ndarray, groups: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole groups of sorted rows that weigh `most` together; a group that weighs more is one of its own."""
    begin = np.flatnonzero(np.diff(groups, prepend=-1))
    edge, total = np.append(begin, len(groups)), np.concatenate([[0], np.cumsum(weights)])
    a = 0
    while a < len(begin):
        z = max(a + 1, int(np.searchsorted(total[edge], total[edge[a]] + most, side="right")) - 1)
        yield int(edge[a]), int(edge[z])
        a = z


def _lost(whole: list[bytes], anchor: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """The spans that the places `at` of stretches lose, a slice of anchors at a time."""
    at = at[np.argsort(at[:, 0], kind="stable")]
    sizes = np.array([len(x) for x in whole], np.int64)
    # a place has its stretch's windows, and so has a stretch
    count = np.bincount(at[:, 0], minlength=len(whole))
    for a, z in _slices((sizes - WINDOW + 1) * (count + 1), anchor, SORT_WINDOWS):
        own = at[np.searchsorted(at[:, 0], a) : np.searchsorted(at[:, 0], z)] - np.array([a, 0, 0, 0])
        kinds = sizes[a:z] - WINDOW + 1
        low = np.full(z - a, np.iinfo(np.int64).max)
        np.minimum.at(low, own[:, 0], own[:, 1])
        edge = np.concatenate([[0], np.cumsum(kinds)])
        holder = np.repeat(low, kinds)
        # a stretch that is its anchor's only one needs no sorting
        many = np.flatnonzero(np.bincount(anchor[a:z] - anchor[a])[anchor[a:z] - anchor[a]] > 1)
        if len(many):
            text_at = np.concatenate([[0], np.cumsum(sizes[a:z][many])])[:-1]
            within = np.arange(kinds[many].sum()) - np.repeat(np.cumsum(kinds[many]) - kinds[many], kinds[many])
            into = np.repeat(edge[many], kinds[many]) + within
            holder[into] = smallest_holders(b"".join([whole[a + i] for i in many]), np.repeat(text_at, kinds[many]) + within, holder[into])
        # windows of each place whose holder is a smaller document, in runs
        n = kinds[own[:, 0]]
        row = np.repeat(np.arange(len(own)), n)
        within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        gone = holder[edge[own[row, 0]] + within] < own[row, 1]
        row, within = row[gone], within[gone]
        if len(row):
            begin = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(within, prepend=-2) != 1))
            last = np.append(begin[1:], len(row)) - 1
            r = row[begin]
            yield np.column_stack([own[r, 1], own[r, 2], own[r, 3] + within[begin], own[r, 3] + within[last] + WINDOW])


def _removed(buckets: int):
    """The spans that documents lose, dealt by document. A bucket's stretches stay compressed; those of one pass are taken out at a time."""

    def run(table: pa.Table) -> pa.Table:
        lost = [_unpacked(x, np.int64).reshape(-1, 4) for x in table.column("lost").to_pylist() if x]
        rows = [(np.frombuffer(s, np.uint64), _unpacked(n, np.int32), text, own) for s, n, text, own in zip(*(table.column(c).to_pylist() for c in ("sig", "size", "text", "places")), strict=True)]
        parts = -(-sum(int(n.sum()) for _, n, _, _ in rows) // PASS_BYTES)
        for part in range(parts):
            lost.extend(_lost(*_of_pass(rows, buckets, part, parts)))
        if not lost:
            return pa.table({"bucket": pa.array([], pa.int32()), "spans": pa.array([], pa.binary())})
        rows = _runs(np.concatenate(lost))
        deal = ((rows[:, 0].astype(np.uint64) * np.uint64(_BASE)) >> np.uint64(33)) % np.uint64(buckets)
        out = [(k, _packed(x)) for k, x in _by_bucket(deal.astype(np.int64), rows)]
        return pa.table({"bucket": pa.array([k for k, _ in out], pa.int32()), "spans": pa.array([x for _, x in out], pa.binary())})

    return run


def _merged(table: pa.Table) -> pa.Table:
    """One row for each document: its maximal removed runs."""
    rows = _runs(np.concatenate([_unpacked(x, np.int64).reshape(-1, 4) for x in table.column("spans").to_pylist()]))
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)]))
    blobs = [rows[a:z, 2:].tobytes() for a, z in zip(begin, np.append(begin[1:], len(rows)), strict=True)]
    return pa.table({"r_id": pa.array(rows[begin, 0], pa.int64()), "r_h": pa.array(rows[begin, 1], pa.int64()), "runs": pa.array(blobs, pa.binary())})


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept, sizes, gone, spans = [], [], [], []
        for data, runs in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("runs").to_pylist(), strict=True):
            own = np.frombuffer(runs, np.int64).reshape(-1, 2).tolist() if runs else []
            parts, at = [], 0
            for a, z in own:
                parts.append(data[at:a])
                at = z
            kept.append(b"".join([*parts, data[at:]]) if own else data)
            sizes.append(len(data))
            gone.append(sum(z - a for a, z in own))
            spans.append(len(own))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, gone, spans)), b.column("rest")], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "rest"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, kept (the remaining bytes), n_bytes, n_removed, n_spans, rest (the other columns).

    A byte goes where a 50-byte string that covers it also starts in a document of smaller doc_id. Null texts count as
    empty. Rows that share a doc_id remove nothing from one another. Rows with a null doc_id stay whole and remove nothing.
    An empty table gives an empty result. A text of 1 GiB or more fails the job.
    """
    spark = docs.sparkSession
    small_batches(spark)
    buckets = BUCKETS_PER_PARTITION * partitions(spark)
    rows = texts(docs, rest_of(docs)).withColumn("h", F.xxhash64("text"))
    named = rows.where("doc_id is not null")
    dealt = named.select("doc_id", "text").mapInArrow(_anchor_rows(buckets), "bucket int, seen boolean, sig binary, doc binary, count binary")
    shared = dealt.groupBy("bucket").applyInArrow(_shared_anchors(buckets), "deal int, sig binary, doc binary").groupBy("deal").applyInArrow(_told, "a_id long, sigs binary")
    # both joins deal the texts out by doc_id alone, with the same columns, so that Spark reuses one exchange of them
    marked = named.join(shared, F.col("doc_id") == F.col("a_id")).select("doc_id", "h", "text", "rest", "sigs")
    stretches = marked.mapInArrow(_stretches(buckets), "bucket int, lost binary, sig binary, size binary, text binary, places binary")
    spans = stretches.groupBy("bucket").applyInArrow(_removed(buckets), "bucket int, spans binary")
    runs = spans.groupBy("bucket").applyInArrow(_merged, "r_id long, r_h long, runs binary")
    joined = named.join(runs, (F.col("doc_id") == F.col("r_id")) & (F.col("h").bitwiseXOR(F.col("r_h")) == 0), "left").select("doc_id", "text", "rest", "runs")
    unnamed = rows.where("doc_id is null").select("doc_id", "text", "rest", F.lit(None).cast("binary").alias("runs"))
    kinds = T.StructType.fromDDL("doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
    return joined.unionByName(unnamed).mapInArrow(_kept, T.StructType([*kinds, rows.schema["rest"]]))


def readable(kept: DataFrame) -> DataFrame:
    """kept as text in place of bytes. What a cut leaves of a character is no valid UTF-8 and goes; texts without a cut stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("kept")
            text = pa.array((x.decode("utf-8", "ignore") for x in b.column(at).to_pylist()), pa.string())
            yield b.set_column(at, "kept", text)

    kinds = T.StructType([T.StructField("kept", T.StringType()) if f.name == "kept" else f for f in kept.schema])
    return kept.mapInArrow(run, kinds)
