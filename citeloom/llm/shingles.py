"""Sets of word shingles, hashed or numbered, a chunk of texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(1).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n, 1 << 21), base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[:] = both
    return _powers[0][:n], _powers[1][:n]


def shingle_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The texts' sets one after another, each sorted, and where each begins (one more entry at the end).

    Words are runs without ASCII white space, A-Z in lower case. A set has the distinct shingles of `words` words; with
    fewer words, the whole sequence; without words, nothing.
    """
    data = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    inside = ~_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers_to(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=total[1:])
    word = mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    text = np.searchsorted(ends_of, starts, side="right")
    count = np.bincount(text, minlength=len(texts))
    parts, owners = [], []
    if len(word) >= words:
        whole = np.flatnonzero(text[words - 1 :] == text[: len(text) - words + 1])
        h = np.zeros(len(whole), np.uint64)
        for j in range(words):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + word[whole + j])
        parts.append(h)
        owners.append(text[whole])
    first = np.cumsum(count) - count
    short = [(i, word[first[i] : first[i] + count[i]]) for i in np.flatnonzero((count > 0) & (count < words))]
    if short:
        h = []
        for _, own in short:
            x = np.array([len(own)], np.uint64)
            for w in own:
                x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + w)
            h.append(x[0])
        parts.append(np.array(h, np.uint64))
        owners.append(np.array([i for i, _ in short]))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    h, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(texts)))])


def exact_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Like shingle_sets, with numbers in place of hashes: equal shingles of these texts have equal numbers, different ones different numbers."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = pc.list_flatten(split)
    owner = pc.list_parent_indices(split).to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(flat)
    word, kinds, owner = coded.indices.to_numpy().astype(np.int64)[full] + 1, len(coded.dictionary) + 1, owner[full]
    count = np.bincount(owner, minlength=len(texts))
    # short texts are filled with the number 0, which no word has
    missing = np.where(count > 0, np.maximum(0, words - count), 0)
    at = np.repeat(np.cumsum(count), missing)
    word, owner = np.insert(word, at, 0), np.insert(owner, at, np.repeat(np.arange(len(texts)), missing))
    if len(word) < words:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    key = word[: len(word) - words + 1]
    for j in range(1, words):
        _, key = np.unique(key * kinds + word[j : len(word) - words + 1 + j], return_inverse=True)
    whole = owner[words - 1 :] == owner[: len(owner) - words + 1]
    key, owner = key[whole], owner[: len(whole)][whole]
    most = int(key.max(initial=0)) + 1
    distinct = np.unique(owner * most + key)
    return distinct % most, np.concatenate([[0], np.cumsum(np.bincount(distinct // most, minlength=len(texts)))])
