"""Phrase collocations from a weighted de Bruijn graph of words.

Edges are the longest grams, four words in a row within a piece; they join the overlapping nodes of their first and last three words. Where a piece ends sooner, what is left of the edge
is the correction of its node: every word of the corpus begins exactly one edge or one correction. So a shorter phrase occurs as often as the edges that leave its node, and those
that lead on from them, plus the corrections at it: no shorter gram is ever counted in the texts.

1. Chunks of text become graphs of distinct edges with weights. Their edges are dealt out by their first word; those of a word that holds much of the corpus by the first two, and those
   of such a pair by all four.
2. A bucket adds up its edges and derives the flow of its nodes. A node whose whole flow goes on along one edge shares that edge's weight: such unary paths are one row, from the shortest
   to the longest phrase on it. Paths of words below the least count stay behind, but for the parts of nodes that were dealt out to several buckets, which Spark adds up.
3. What follows (texts of words, cuts, scores, containment, ranks) is joins over phrases of at least the least count.

Words are named by 56-bit hashes with their language; texts of words travel with the edges, and a bucket that meets two texts under one name of a frequent word raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, small_batches, written
from .shingles import _BYTE, _LOWER, _powers_to, mixed

WORDS = 4
LEAST = 30
TOP = 2000
SCALE = 2_000_000
CONTAINED = 80
#: Bytes of text whose graph is built at once, and bytes hashed at once.
CHUNK_BYTES = 6 << 20
SLICE_BYTES = 1 << 20
#: Words whose edges one bucket gets, about.
BUCKET_WORDS = 600_000
#: Words, and pairs, that hold more than this part of a chunk are looked at as frequent; at most twice as many of each are treated so.
FREQUENT = 1024
UNKNOWN = "und"

_NAME = np.uint64((1 << 56) - 1)
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9]] = True


class Words:
    """The words of some texts: names (hashes with the language), whether the next word is in the same piece, places in data, and the language's number."""

    def __init__(self, texts: list[tuple[int, bytes]], salts: np.ndarray):
        names, same, starts, ends, langs, at, to = [], [], [], [], [], 0, 0
        while at < len(texts):
            begin, size = at, 0
            while at < len(texts) and (at == begin or size + len(texts[at][1]) < SLICE_BYTES):
                size += len(texts[at][1]) + 1
                at += 1
            data = _LOWER[np.frombuffer(b"\n".join([*(t for _, t in texts[begin:at]), b""]), np.uint8)]
            breaks = _BREAK[data]
            edge = np.diff((~(breaks | _BLANK[data])).astype(np.int8), prepend=np.int8(0))
            a, z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            up, down = _powers_to(len(data))
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTE[data] * up, out=total[1:])
            text = np.searchsorted(np.cumsum([len(t) + 1 for _, t in texts[begin:at]]), a, side="right")
            lang = np.array([k for k, _ in texts[begin:at]], np.int64)[text]
            name = mixed(mixed((total[z] - total[a]) * down[a] + (z - a).astype(np.uint64)) ^ salts[lang]) & _NAME
            piece = np.cumsum(breaks, dtype=np.int64)[a]
            names.append(np.maximum(name, np.uint64(1)))
            same.append(np.append(piece[1:] == piece[:-1], False)[: len(a)])
            starts.append(a + to)
            ends.append(z + to)
            langs.append(lang)
            to += len(data)
        self.names, self.same = np.concatenate(names), np.concatenate(same)
        self.starts, self.ends, self.langs = np.concatenate(starts), np.concatenate(ends), np.concatenate(langs)
        self.texts = texts

    def spelled(self, which: np.ndarray) -> list[bytes]:
        data = b"\n".join([*(t for _, t in self.texts), b""])
        return [data[a:z].lower() for a, z in zip(self.starts[which].tolist(), self.ends[which].tolist(), strict=True)]


def _parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of about CHUNK_BYTES, cut where pieces end; a longer piece stays whole."""
    while len(text) > CHUNK_BYTES:
        places = _BREAK[np.frombuffer(text, np.uint8)]
        before = np.flatnonzero(places[:CHUNK_BYTES])
        cut = int(before[-1]) + 1 if len(before) else int(places.argmax()) + 1 if places.any() else len(text)
        yield text[:cut]
        text = text[cut:]
    yield text


def _salts(langs: list[str], seed: int) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(x.encode(), seed) for x in langs], np.uint64)


def _chunks(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[list[str], Words]]:
    """The words of some texts at a time, with the names of their languages."""
    langs: dict[str, int] = {}
    held: list[tuple[int, bytes]] = []
    size = 0
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
            for part in _parts(text):
                if held and size + len(part) > CHUNK_BYTES:
                    yield list(langs), Words(held, _salts(list(langs), seed))
                    held, size = [], 0
                held.append((langs.setdefault(lang, len(langs)), part))
                size += len(part) + 1
    if held:
        yield list(langs), Words(held, _salts(list(langs), seed))


#: What the first pass finds: words of a language (kind 0), and frequent words (1) and pairs (2) with their counts.
SURVEY = "kind int, lang string, a long, b long, n long"


def _survey(seed: int):
    kinds = pa.schema([("kind", pa.int32()), ("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, words in _chunks(batches, seed):
            rows = [(0, langs[k], 0, 0, int(n)) for k, n in enumerate(np.bincount(words.langs, minlength=len(langs))) if n]
            least = len(words.names) / FREQUENT
            name, n = np.unique(words.names, return_counts=True)
            rows += [(1, None, int(x), 0, int(k)) for x, k in zip(name[n > least], n[n > least], strict=True)]
            # pairs of frequent words only: no other pair is frequent
            often = np.isin(words.names, name[n > least])
            first = np.flatnonzero(words.same[:-1] & often[:-1] & often[1:]) if len(often) else np.zeros(0, np.int64)
            _, at, n = np.unique(_pair_name(words.names[first], words.names[first + 1]), return_index=True, return_counts=True)
            rows += [(2, None, int(words.names[i]), int(words.names[i + 1]), int(k)) for i, k in zip(first[at[n > least]], n[n > least], strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, x, strict=True)) for x in rows], kinds)

    return run


def _edges(words: Words) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The graph of a chunk: the four words of each distinct edge (0 beyond the end of a piece) in sorted order, their weights, and a place of each edge's first word."""
    name, place, at = np.unique(words.names, return_index=True, return_inverse=True)
    at, bits = at.astype(np.int64) + 1, int(len(name) + 1).bit_length()
    after = np.append(np.where(words.same[:-1], at[1:], 0), 0)[: len(at)]
    pair, at_pair = np.unique(at << bits | after, return_inverse=True)
    on = np.zeros(len(at), np.int64)
    if len(at) > 2:
        on[:-2] = np.where(words.same[:-2] & words.same[1:-1], at_pair[2:].astype(np.int64) + 1, 0)
    edge, weight = np.unique((at_pair.astype(np.int64) + 1) << 32 | on, return_counts=True)
    pair = np.concatenate([[0], pair])
    first, second = pair[edge >> 32], pair[edge & 0xFFFFFFFF]
    low = (1 << bits) - 1
    names = np.concatenate([[np.uint64(0)], name]).astype(np.uint64)
    return [names[first >> bits], names[first & low], names[second >> bits], names[second & low]], weight, place[(first >> bits) - 1]


def _planes(x: np.ndarray, width: int) -> bytes:
    return x.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(x: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(x) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(x, np.uint8).reshape(width, -1).T
    return out.reshape(-1).view(np.uint64)


def _levels(w: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For sorted edges: the first word in which each differs from the one before (1 to 4), and how many words it has."""
    new, level = np.zeros(len(w[0]), bool), np.full(len(w[0]), WORDS, np.uint8)
    for i, x in enumerate(w):
        new |= np.concatenate([[True], x[1:] != x[:-1]])
        level = np.minimum(level, np.where(new, i + 1, WORDS)).astype(np.uint8)
    return level, sum((x != 0).astype(np.uint8) for x in w)


def _packed(w: list[np.ndarray], weight: np.ndarray) -> bytes:
    """Sorted edges in little room: of each only the words in which it differs from the one before."""
    level, depth = _levels(w)
    own = [x[(level <= i + 1) & (depth > i)] for i, x in enumerate(w)]
    parts = [level.tobytes(), depth.tobytes(), _planes(weight, 4), *(x.view(np.uint8).reshape(-1, 8)[:, :7].tobytes() for x in own)]
    head = np.array([len(x) for x in parts], np.uint32).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def _unpacked(blob: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(data[: 4 * (3 + WORDS)], np.uint32)
    parts, at = [], 4 * (3 + WORDS)
    for n in sizes.tolist():
        parts.append(data[at : at + n])
        at += n
    level, depth = (np.frombuffer(x, np.uint8) for x in parts[:2])
    w = []
    for i, x in enumerate(parts[3:]):
        bytes_of = np.frombuffer(x, np.uint8).reshape(-1, 7)
        names = np.zeros((len(bytes_of) + 1, 8), np.uint8)
        names[1:, :7] = bytes_of
        filled = np.cumsum((level <= i + 1) & (depth > i))
        w.append(np.where(depth > i, names.reshape(-1).view(np.uint64)[filled], np.uint64(0)))
    return w, _from_planes(parts[2], 4).astype(np.int64)


def _among(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """x is in some (sorted)."""
    if not len(some):
        return np.zeros(len(x), bool)
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x


def _pair_name(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * np.uint64(0x9E3779B97F4A7C15) + b)


EDGES = "bucket int, edges binary, spelled binary, lang_of binary, langs array<string>"


def _dealt(seed: int, buckets: int, words: np.ndarray, pairs: np.ndarray):
    """The graphs of chunks, a row for each bucket: its edges, and the texts of their first words."""
    kinds = pa.schema([("bucket", pa.int32()), ("edges", pa.binary()), ("spelled", pa.binary()), ("lang_of", pa.binary()), ("langs", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for langs, own in _chunks(batches, seed):
            if not len(own.names):
                continue
            w, weight, place = _edges(own)
            by_pair = _among(w[0], words)
            pair = _pair_name(w[0], w[1])
            by_all = by_pair & _among(pair, pairs)
            deal = np.where(by_all, _pair_name(_pair_name(pair, w[2]), w[3]), np.where(by_pair, pair, w[0]))
            bucket = ((mixed(deal ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            begin = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            for a, z in zip(begin, np.append(begin[1:], len(order)), strict=True):
                some = order[a:z]
                x = [y[some] for y in w]
                first = np.flatnonzero(np.concatenate([[True], x[0][1:] != x[0][:-1]]))
                at = place[some[first]]
                row = {"bucket": int(bucket[some[0]]), "edges": _packed(x, weight[some]), "spelled": pack(b"\n".join(own.spelled(at))), "lang_of": pack(_planes(own.langs[at], 4)), "langs": langs}
                yield pa.RecordBatch.from_pylist([row], kinds)

    return run


PATHS = "a long, b long, c long, d long, low int, high int, n long, lang string, word string"


def _paths(least: int, words: np.ndarray, pairs: np.ndarray):
    """The unary paths of a bucket's graph: a row has the longest phrase of a path (zeros beyond its words); its first `low` to `high` words all have count n. Rows from low = 1 tell the
    language and text of their word. Counts of frequent words, and of frequent pairs and what begins with them, are parts of sums."""

    def run(table: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor().decompress
        found = [_unpacked(x) for x in table.column("edges").to_pylist()]
        firsts = [x[0][np.concatenate([[True], x[0][1:] != x[0][:-1]])] for x, _ in found]
        w, weight = [np.concatenate([x[i] for x, _ in found]) for i in range(WORDS)], np.concatenate([n for _, n in found])
        del found
        order = np.lexsort(w[::-1])
        w, weight = [x[order] for x in w], weight[order]
        new = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in w], axis=0)])
        w, weight = [x[new] for x in w], np.add.reduceat(weight, np.flatnonzero(new))
        level, depth = _levels(w)
        by_pair = _among(w[0], words)
        by_all = by_pair & _among(_pair_name(w[0], w[1]), pairs)
        # the flow of a node: its edges, what leads on from them and its corrections are neighbours in this order
        flows, nodes = [], []
        for k in range(1, WORDS + 1):
            begin = np.flatnonzero(level <= k)
            flow = np.full(len(weight), -1, np.int64)
            flow[begin] = np.add.reduceat(weight, begin)
            node = (level <= k) & (depth >= k)
            flows.append(np.where(node, flow, -1))
            nodes.append(node)
        rows: list[list[np.ndarray]] = []
        for k in range(1, WORDS + 1):
            heads = nodes[k - 1] & ((flows[k - 2] != flows[k - 1]) if k > 1 else True)
            partial = by_pair if k == 1 else by_all if k < WORDS else np.zeros(len(weight), bool)
            heads = np.flatnonzero(heads & (partial | (flows[k - 1] >= least)))
            high = np.full(len(heads), k)
            for j in range(k + 1, WORDS + 1):
                high[(high == j - 1) & (flows[j - 1][heads] == flows[k - 1][heads])] = j
            rows.append([*(np.where(high > i, x[heads], np.uint64(0)) for i, x in enumerate(w)), np.full(len(heads), k), high, flows[k - 1][heads]])
        columns = [np.concatenate([r[i].astype(np.int64) for r in rows]) for i in range(7)]
        known: dict[int, tuple[str, str]] = {}
        wanted = np.unique(rows[0][0].astype(np.uint64))
        for names, spelled, of, langs in zip(firsts, *(table.column(c).to_pylist() for c in ("spelled", "lang_of", "langs")), strict=True):
            texts, lang = open_(spelled).split(b"\n"), _from_planes(open_(of), 4)
            for i in np.flatnonzero(_among(names, wanted)).tolist():
                own = (langs[int(lang[i])], texts[i].decode())
                if known.setdefault(int(names[i]), own) != own:
                    raise ValueError(f"{own} and {known[int(names[i])]} have one name: choose another seed")
        told = [known[x] if low == 1 else (None, None) for x, low in zip(columns[0].tolist(), columns[4].tolist(), strict=True)]
        out = [*(pa.array(x, t) for x, t in zip(columns, (*[pa.int64()] * 4, pa.int32(), pa.int32(), pa.int64()), strict=True)), *(pa.array([x[i] for x in told], pa.string()) for i in (0, 1))]
        return pa.Table.from_arrays(out, ["a", "b", "c", "d", "low", "high", "n", "lang", "word"])

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals). phrases: lang, phrase (words joined by a space), words (1 to 4) and n, how often it occurs, of all phrases with n >= least. totals: lang and all its word occurrences."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    survey = written(rows.mapInArrow(_survey(seed), SURVEY).groupBy("kind", "lang", "a", "b").agg(F.sum("n").alias("n")), "survey")
    totals = survey.where("kind = 0").select("lang", F.col("n").alias("total"))
    total = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    # at most 2 * FREQUENT words and as many pairs have such a count
    often = survey.where(f"kind > 0 and n * {2 * FREQUENT} >= {total}").select("kind", "a", "b").collect()
    words = np.array(sorted(r["a"] for r in often if r["kind"] == 1), np.uint64)
    pairs = np.sort(_pair_name(*(np.array([r[c] for r in often if r["kind"] == 2], np.uint64) for c in "ab")))
    buckets = max(partitions(spark), total // BUCKET_WORDS)
    edges = rows.mapInArrow(_dealt(seed, buckets, words, pairs), EDGES)
    paths = written(edges.groupBy("bucket").applyInArrow(_paths(least, words, pairs), PATHS), "paths")
    k = F.col("k")
    each = paths.select(F.explode(F.sequence("low", "high")).alias("k"), "a", "b", "c", "d", "n", "lang", "word")
    kept = [F.when(k >= i, F.col(c)).otherwise(0).alias(c) for i, c in ((2, "b"), (3, "c"), (4, "d"))]
    grams = each.select("k", "a", *kept, "n", F.when(k == 1, F.col("lang")).alias("lang"), F.when(k == 1, F.col("word")).alias("word"))
    grams = written(grams.groupBy("k", "a", "b", "c", "d").agg(F.sum("n").alias("n"), F.max("lang").alias("lang"), F.max("word").alias("word")).where(F.col("n") >= least), "grams")
    single = grams.where("k = 1").select("a", "lang", "word", "n")
    phrases = single.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "n")
    for size in range(2, WORDS + 1):
        part = grams.where(k == size).select("a", "b", "c", "d", "n")
        for i, c in enumerate("abcd"[:size]):
            own = single.select(F.col("a").alias("x"), F.col("word").alias(f"w{i}"), *([F.col("lang").alias("lang")] if i == 0 else []))
            part = part.join(own, F.col(c) == F.col("x")).drop("x")
        phrases = phrases.unionByName(part.select("lang", F.concat_ws(" ", *(f"w{i}" for i in range(size))).alias("phrase"), F.lit(size).alias("words"), "n"))
    return written(phrases, "phrases"), totals



def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, contained: int = CONTAINED, scale: int = SCALE, seed: int = 0) -> DataFrame:
    """The best phrases of two to four words in each language: lang, rank, phrase, a, l, r, n, score.

    a, l and r are the counts of the phrase, of its first part and of its rest at the cut with the lowest score, floor(scale * a / (l + r)); of equal ones the shortest first part counts. n counts the
    language's words. A phrase that lies in a longer one of at least `contained` percent of its count is left out. A null text is empty, a null lang UNKNOWN; texts without words give
    nothing, repeated rows count as often as they occur, doc_id and other columns are ignored. An empty table gives an empty result.
    """
    phrases, totals = phrase_counts(docs, least, seed)
    candidates = phrases.where("words > 1")
    parts = F.split("phrase", " ")
    cut = F.col("cut")
    cuts = candidates.select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut")).select(
        "lang", "phrase", "words", "a", "cut", F.concat_ws(" ", F.slice(parts, F.lit(1), cut)).alias("first"), F.concat_ws(" ", F.slice(parts, cut + 1, F.col("words") - cut)).alias("rest")
    )
    for side, n in (("first", "l"), ("rest", "r")):
        own = phrases.select(F.col("lang").alias("p_lang"), F.col("phrase").alias("p_phrase"), F.col("n").alias(n))
        cuts = cuts.join(own, (F.col("lang") == F.col("p_lang")) & (F.col(side) == F.col("p_phrase"))).drop("p_lang", "p_phrase")
    score = F.expr(f"(cast(a as decimal(20, 0)) * cast({scale} as decimal(10, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    longer = candidates.where("words > 2").select("lang", "n", "words", parts.alias("w"))
    inner = longer.select("lang", "n", "words", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("k")).select("lang", "n", "w", "k", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("k") + 1)).alias("i"))
    inner = inner.select("lang", F.concat_ws(" ", F.slice("w", F.col("i"), F.col("k"))).alias("phrase"), "n").groupBy(F.col("lang").alias("i_lang"), F.col("phrase").alias("i_phrase")).agg(F.max("n").alias("within"))
    held = best.join(inner, (F.col("lang") == F.col("i_lang")) & (F.col("phrase") == F.col("i_phrase")), "left").where(F.col("within").isNull() | (F.col("within") * 100 < F.col("a") * contained))
    order = Window.partitionBy("lang").orderBy(F.col("best.score").desc(), F.col("a").desc(), "phrase")
    ranked = held.select("lang", "phrase", "a", "best", F.row_number().over(order).cast("long").alias("rank")).where(F.col("rank") <= top)
    of = totals.select(F.col("lang").alias("t_lang"), F.col("total").alias("n"))
    return ranked.join(of, F.col("lang") == F.col("t_lang")).select("lang", "rank", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
