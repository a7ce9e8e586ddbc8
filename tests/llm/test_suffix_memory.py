"""Passages of a bucket are compared a part at a time, with the result of a plain version."""

import random

import pyarrow as pa
import pytest

from citeloom.llm import suffix_dedup as S


def _texts(seed, n):
    """Texts of shared passages in differing surroundings: most anchors have several stretches."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(3, 8)))
    passages = [" ".join(word() for _ in range(14)) for _ in range(8)]
    return {i: " ".join(x for _ in range(rng.randint(2, 6)) for x in (word(), rng.choice(passages)[rng.randint(0, 25) :], word())).encode() for i in range(1, n + 1)}


def _plain(texts):
    """Removed runs of each text: bytes under a 50-byte string that a smaller id has too."""
    first, out = {}, {}
    for i, t in texts.items():
        gone = set()
        for a in range(len(t) - S.WINDOW + 1):
            if first.setdefault(t[a : a + S.WINDOW], i) < i:
                gone.update(range(a, a + S.WINDOW))
        ends = sorted(gone)
        runs = [[a, a + 1] for a in ends if a - 1 not in gone]
        for r in runs:
            while r[1] in gone:
                r[1] += 1
        if runs:
            out[i] = [tuple(r) for r in runs]
    return out


def _found(texts):
    """The removed runs as one bucket finds them, with every anchor taken for shared."""
    data = b"".join(texts.values())
    sizes = S.np.array([len(t) for t in texts.values()])
    ends = S.np.cumsum(sizes)
    sig, _, _, text = S.anchors(S.np.frombuffer(data, S.np.uint8), ends - sizes, ends)
    sigs = [S.np.unique((sig[text == i] & S._SHORT).astype(S.np.uint32)).tobytes() for i in range(len(texts))]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(list(texts), pa.int64()), "text": [t.decode() for t in texts.values()], "h": pa.array([0] * len(texts), pa.int64()), "sigs": pa.array(sigs, pa.binary())})
    parts = S._removed(1)(pa.Table.from_batches(S._stretches(1)(iter([batch]))))
    rows = S._merged(parts).to_pydict()
    return {i: [tuple(r) for r in S.np.frombuffer(x, S.np.int64).reshape(-1, 2).tolist()] for i, x in zip(rows["r_id"], rows["runs"], strict=True)}


@pytest.mark.parametrize(("pass_bytes", "windows"), [(1 << 12, 1 << 10), (1 << 14, 1 << 12), (1 << 30, 1 << 30)])
def test_a_bucket_is_sorted_in_parts(monkeypatch, pass_bytes, windows):
    sorted_at_once, most = [], S.smallest_holders
    monkeypatch.setattr(S, "PASS_BYTES", pass_bytes, raising=False)
    monkeypatch.setattr(S, "SORT_WINDOWS", windows, raising=False)
    monkeypatch.setattr(S, "smallest_holders", lambda data, starts, docs: sorted_at_once.append(len(starts)) or most(data, starts, docs))
    texts = _texts(pass_bytes, 120)
    got = _found(texts)
    assert got == _plain(texts) and len(got) > 60
    # one anchor's stretches stay together
    assert windows == 1 << 30 or (len(sorted_at_once) > 3 and max(sorted_at_once) < sum(sorted_at_once) / 3)


def test_touching_spans_of_a_text_leave_as_one():
    spans = S.np.array([(2, 0, 5, 60), (1, 0, 0, 50), (1, 0, 100, 150), (1, 0, 20, 80), (1, 0, 30, 60), (1, 0, 80, 90), (2, 1, 0, 50)], S.np.int64)
    assert S._runs(spans).tolist() == [[1, 0, 0, 90], [1, 0, 100, 150], [2, 0, 5, 60], [2, 1, 0, 50]]
