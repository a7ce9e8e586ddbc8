"""Near duplicates by MinHash bands and odd sketches.

1. A document's set of hashed shingles gets SAMPLES minimal hashes. Equal sets are one class, so copies go no further.
2. Bands of ROWS samples nominate: classes with a band in common are candidates. At 80 % similarity a pair has one of BANDS bands in common but for a chance of 2e-10.
3. The samples are folded into a bitmap in which each flips the bit that its number and value choose: samples that two sets share cancel out in the XOR of their bitmaps, so its population count tells the
   similarity, and most precisely where it is high. Candidates whose count is beyond what FAR allows stay behind; a pair of 80 % goes beyond it with a chance of 1e-11.
4. The others are confirmed on the words of their whole texts.

Bands of a few classes give all their pairs. In a band of many, each is a candidate of the first one only; then classes that are still apart in a group of such bands are compared in blocks
(see jaccard_join.large_groups), so that no link between different sets is lost and no group is ever expanded into its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts, written
from .components import components
from .jaccard_join import labelled, large_groups, verified
from .shingles import mixed, shingle_sets

WORDS = 2
SIMILARITY = 80
ROWS = 5
BANDS = 56
SAMPLES = ROWS * BANDS
#: Longs of the bitmap.
SKETCH = 8
#: Samples that two sets may not share before a candidate is dropped: SAMPLES times the distance 0.44.
FAR = 0.44
#: Bands of more classes than this are large.
RARE = 12
CHUNK_BYTES = 1 << 20

_FACTORS = np.random.default_rng(12).integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = np.random.default_rng(13).integers(0, 2**32, SAMPLES, dtype=np.uint32)


def samples(sets: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The minimal hashes of non-empty sets, one row for each."""
    # products of a 32-bit hash keep its lattice; other bits of the hash break that up
    low, high = sets.astype(np.uint32), (sets >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(begins) - 1, SAMPLES), np.uint32)
    for i in range(SAMPLES):
        out[:, i] = np.minimum.reduceat((low * _FACTORS[i]) ^ (high + _SHIFTS[i]), begins[:-1])
    return out


def bands(found: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of samples."""
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(found), BANDS)).copy()
    for i in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + found[:, i::ROWS].astype(np.uint64))
    return key


def odd_sketches(found: np.ndarray) -> np.ndarray:
    """The bitmap of each row of samples: a bit is set where an odd number of them falls."""
    bits = 64 * SKETCH
    at = (mixed((np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)) | found.astype(np.uint64)) >> np.uint64(20)) % np.uint64(bits)
    flat = (at + np.arange(len(found), dtype=np.uint64)[:, None] * np.uint64(bits)).reshape(-1).astype(np.int64)
    odd = (np.bincount(flat, minlength=len(found) * bits) & 1).astype(np.uint8).reshape(len(found), bits)
    return np.packbits(odd, axis=1, bitorder="little").view(np.uint64)


def most_bits(far: float = FAR) -> int:
    """The population count to expect of two sketches whose sets do not share this part of their samples."""
    bits = 64 * SKETCH
    return int(bits / 2 * (1 - (1 - 2 / bits) ** (2 * SAMPLES * far)))


_SKETCH_COLUMNS = [f"s{i}" for i in range(SKETCH)]
SIGNED = f"doc_id long, n long, hi long, lo long, {', '.join(f'{c} long' for c in _SKETCH_COLUMNS)}, bands array<long>"


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """About each document: the size and 128-bit digest of its set, its sketch and its bands. Of equal sets in a chunk only the smallest doc_id has bands."""
    for b in batches:
        ids, data, at = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("text").cast(pa.binary()).to_pylist(), 0
        while at < len(data):
            to, size = at, 0
            while to < len(data) and (to == at or size + len(data[to]) <= CHUNK_BYTES):
                size += len(data[to])
                to += 1
            sets, begins = shingle_sets(data[at:to], WORDS)
            sizes, own = np.diff(begins), ids[at:to]
            digests = [xxhash.xxh3_128_intdigest(sets[a:z].tobytes()) for a, z in zip(begins, begins[1:], strict=False)]
            halves = np.array([(d >> 64, d & (2**64 - 1)) for d in digests], np.uint64).reshape(-1, 2)
            lead: dict[int, int] = {}
            for i in np.argsort(own, kind="stable").tolist():
                lead.setdefault(digests[i], i)
            leads = np.array(sorted(i for i in lead.values() if sizes[i]), np.int64)
            sketch, keys = np.zeros((len(own), SKETCH), np.uint64), [None] * len(own)
            if len(leads):
                n = sizes[leads]
                edge = np.concatenate([[0], np.cumsum(n)])
                found = samples(sets[np.repeat(begins[leads] - edge[:-1], n) + np.arange(edge[-1])], edge)
                sketch[leads] = odd_sketches(found)
                for i, x in zip(leads.tolist(), bands(found).view(np.int64), strict=True):
                    keys[i] = x
            longs = [own, sizes, halves[:, 0].view(np.int64), halves[:, 1].view(np.int64), *(sketch[:, i].view(np.int64) for i in range(SKETCH))]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x), pa.int64()) for x in longs), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "hi", "lo", *_SKETCH_COLUMNS, "bands"])
            at = to


def _apart(left: str, right: str) -> Column:
    """The population count of the XOR of two sketches."""
    out = F.lit(0)
    for c in _SKETCH_COLUMNS:
        out = out + F.bit_count(F.col(f"{left}_{c}").bitwiseXOR(F.col(f"{right}_{c}")))
    return out


def sketched(pairs: DataFrame, sketches: DataFrame, far: float = FAR) -> DataFrame:
    """The candidates (a, b) that their sketches (rep, n, s0...) and sizes leave. Where versions share an id, one near pair of them will do."""
    for side in "ab":
        pairs = pairs.join(sketches.select(F.col("rep").alias(f"{side}_rep"), F.col("n").alias(f"{side}_n"), *(F.col(c).alias(f"{side}_{c}") for c in _SKETCH_COLUMNS)), F.col(side) == F.col(f"{side}_rep"))
    fits = (F.col("a_n") * 100 >= F.col("b_n") * SIMILARITY) & (F.col("b_n") * 100 >= F.col("a_n") * SIMILARITY)
    return pairs.where(fits & (_apart("a", "b") <= most_bits(far))).select("a", "b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id that links lead to; kept tells that it is the row's own. Null texts and texts without words have no shingles and link with nothing. Rows that share a doc_id are
    versions of one document and have its component in common; repeated rows repeat. A row with a null doc_id has a null component, links with nothing and is kept. An
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = texts(docs)
    named = rows.where("doc_id is not null")
    signed = written(named.mapInArrow(_signed, SIGNED), "signed")
    classes = signed.where("n > 0").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("rep"), *(F.max(F.when(F.col("bands").isNotNull(), F.col(c))).alias(c) for c in _SKETCH_COLUMNS))
    classes = written(classes, "classes")
    own = classes.select(F.col("hi").alias("k_hi"), F.col("lo").alias("k_lo"), F.col("n").alias("k_n"), "rep")
    about = signed.select("doc_id", "n", "hi", "lo")
    known = about.where("n > 0").join(own, (F.col("hi") == F.col("k_hi")) & (F.col("lo") == F.col("k_lo")) & (F.col("n") == F.col("k_n"))).select("doc_id", "n", "rep")
    known = written(known.unionByName(about.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("rep"))), "known")
    # bands that several classes have
    reps = classes.select(F.col("rep").alias("of")).distinct()
    nominated = signed.where("bands is not null").select("doc_id", "bands").join(reps, F.col("doc_id") == F.col("of")).select(F.explode("bands").alias("sig"), F.col("doc_id").alias("doc"))
    shared = nominated.groupBy("sig").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("size")).where("first < last")
    shared = written(shared, "bands")
    found = written(nominated.join(shared.select(F.col("sig").alias("g_sig"), "first", "size"), F.col("sig") == F.col("g_sig")).select("sig", "doc", "first", "size").distinct(), "members")
    few = found.where(F.col("size") <= RARE).groupBy("sig").agg(F.sort_array(F.collect_list("doc")).alias("docs"))
    pairs = few.select(F.explode("docs").alias("a"), "docs").select("a", F.explode("docs").alias("b")).where("a < b")
    pairs = pairs.unionByName(found.where((F.col("size") > RARE) & (F.col("doc") > F.col("first"))).select(F.col("first").alias("a"), F.col("doc").alias("b"))).distinct()
    near = written(sketched(pairs, classes), "candidates")
    involved = near.select(F.col("a").alias("want")).unionByName(near.select(F.col("b").alias("want"))).unionByName(found.where(F.col("size") > RARE).select(F.col("doc").alias("want"))).distinct()
    held = written(named.join(involved.hint("merge"), F.col("doc_id") == F.col("want")).select(F.col("doc_id").alias("rep"), "text"), "texts")
    links = verified(near, held, SIMILARITY, WORDS)
    several = known.where("n > 0").groupBy(F.col("doc_id").alias("a")).agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    links = written(links.unionByName(several.select(F.col("low").alias("a"), F.col("high").alias("b"))), "links")
    # classes that the links so far leave apart though they share a large band
    large = found.where(F.col("size") > RARE).select("sig", "doc")
    open_ = labelled(large, components(links), "doc", "comp").groupBy(F.col("sig").alias("o_sig")).agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    rest = written(large.join(open_.select("o_sig"), F.col("sig") == F.col("o_sig")).select("sig", "doc"), "open")
    if not rest.isEmpty():
        links = large_groups(rest, held, links, SIMILARITY, WORDS)
    done = labelled(known, components(links), "rep", "component_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    unnamed = rows.where("doc_id is null").mapInArrow(_sizes, "doc_id long, n_shingles long, component_id long, kept boolean")
    return done.unionByName(unnamed)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = [len(shingle_sets([x], WORDS)[0]) for x in b.column("text").cast(pa.binary()).to_pylist()]
        none = pa.nulls(len(n), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(n, pa.int64()), none, pa.array([True] * len(n))], ["doc_id", "n_shingles", "component_id", "kept"])
