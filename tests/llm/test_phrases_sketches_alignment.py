"""Collocations, odd sketches and alignment of tokenizers against brute force; very long texts and runs of white space."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from citeloom.llm import alignment, bpe, collocations, jaccard_join, line_dedup, media, near_dedup, packing, queries, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = "doc_id long, text string, lang string, n long, a long, phrase string, rep string, sig string, end string"


def _table(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, g, 1, 2, "x", "y", "z", "w") for i, t, g in rows], CLASHING).repartition(parts)


def _phrases(rows, least, contained=80, scale=2_000_000, top=2000):
    """The contract's result, phrase by phrase."""
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in kept.items():
            score, k = min((scale * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            if not any(100 * b >= contained * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in kept.items() if len(q) > len(p)):
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p.decode(), -a, x, y, n[lang], -s) for rank, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def spoken():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ünï", "été", "w\x1fx", " "]
    rows = [(1, None, "en"), (2, "", "en"), (3, " .,; \n", None), (4, "one", "en"), (5, "One two", "en"), (5, "one two", "en"), (None, "one two three", "en")]
    for i in range(200):
        text = ""
        for _ in range(rng.integers(1, 30)):
            x = rng.random()
            text += "hot pair " if x < 0.2 else "a fixed phrase of words " if x < 0.3 else vocabulary[int(rng.integers(44) ** 2 / 44)] + str(rng.choice([" ", "  ", "\t", ". ", ",", "\r\n", "! "]))
        rows.append((100 + i, text.upper() if i % 9 == 0 else text, [None, "en", "de"][i % 3]))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_collocations(spark, spoken, small, monkeypatch):
    if small:  # several chunks, buckets, and frequent words and pairs that are dealt out
        for name, value in (("CHUNK_BYTES", 600), ("SLICE_BYTES", 150), ("BUCKET_WORDS", 100), ("FREQUENT", 30)):
            monkeypatch.setattr(collocations, name, value)
    for least, top in ((3, 2000), (10, 5)):
        got = collocations.collocations(_table(spark, spoken), least=least, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
        assert sorted(map(tuple, got)) == _phrases(spoken, least, top=top)
    got = collocations.phrase_counts(_table(spark, spoken), 1)[0].where("words = 4").count()
    assert got == len({(g or "und", *w[i : i + 4]) for _, t, g in spoken for p in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)) for w in [re.findall(r"[^\x20\x09]+", p)] for i in range(len(w) - 3)})


def test_flows_make_unary_paths():
    """What one edge takes on whole is one row from the shortest to the longest phrase."""
    held = collocations.Words([(0, b"a b c d. a b c d. x y. x z")], np.array([1], np.uint64))
    w, weight, place = collocations._edges(held)
    again = collocations._unpacked(collocations._packed(w, weight))
    assert all((x == y).all() for x, y in zip(w, again[0], strict=True)) and (weight == again[1]).all()
    assert sorted(weight.tolist()) == [1, 1, 1, 1, 2, 2, 2, 2] and int(weight.sum()) == len(held.names)
    level, depth = collocations._levels(w)
    assert sorted(depth.tolist()) == [1, 1, 1, 2, 2, 2, 3, 4] and level.min() == 1


def test_collocations_are_exact_beyond_64_bits(spark):
    score = spark.sql("select (cast(a as decimal(20, 0)) * cast(2000000 as decimal(10, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0))) as s from values (90000000000000L, 95000000000001L, 94999999999998L) as t(a, l, r)").first()["s"]
    assert score == 2_000_000 * 90000000000000 // (95000000000001 + 94999999999998)


def _components(rows, size, similarity=80):
    sets, versions = {}, defaultdict(list)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        versions[i].append(sets[i])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            for x in versions[a]:
                for y in versions[b]:
                    both = len(x & y)
                    if both and 100 * both >= similarity * (len(x) + len(y) - both):
                        p, q = find(a), find(b)
                        root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("rare", [12, 3])
def test_near_duplicates(spark, rare, monkeypatch):
    """Copies, chains of near copies, groups whose members meet only through others, very small sets, nulls, versions and repeated rows."""
    monkeypatch.setattr(near_dedup, "RARE", rare)
    rng = np.random.default_rng(8)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 3000, n)]
    rows = [(7, None), (8, ""), (9, " \t\n"), (10, "one"), (11, "ONE"), (12, "one two"), (13, "two one"), (14, "one two"), (14, "one two")]
    for g in range(5):
        w = word(150)
        for i in range(50):
            if i % 6 == 0:
                w[rng.integers(150)] = f"step{g}x{i}"
            own = list(w)
            for _ in range(int(rng.integers(0, 9))):
                own[rng.integers(150)] = f"own{g}x{i}x{rng.integers(9999)}"
            rows.append((1000 * g + 100 + i, " ".join(own)))
    rows += [(9000 + n, " ".join(f"s{k}" for k in range(n))) for n in range(1, 30)]
    rows += [(9100 + n, " ".join(word(60))) for n in range(60)]
    got = near_dedup.near_duplicates(_table(spark, [(i, t, None) for i, t in [*rows, (None, "a row without an id")]]))
    want = _components(rows, 2)
    assert got.count() == len(rows) + 1
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect() if r["doc_id"] is not None} == want
    assert got.where("doc_id is null").select("n_shingles", "component_id", "kept").first() == (4, None, True)
    versions = [(1, "a b c d e f"), (1, "p q r s t u"), (2, "a b c d e f"), (3, "p q r s t u")]
    got = near_dedup.near_duplicates(spark.createDataFrame(versions, "doc_id long, text string"))
    assert {r["component_id"] for r in got.collect()} == {1}


def test_sketches_tell_the_similarity():
    rng = np.random.default_rng(4)
    for shared, low, high in ((0.9, 0.85, 0.95), (0.8, 0.72, 0.88), (0.3, 0.0, 0.5)):
        n = 2000
        common = int(2 * n * shared / (1 + shared))
        x = np.sort(rng.integers(1, 2**63, 2 * n - common, dtype=np.uint64))
        rng.shuffle(x)
        a, b = np.sort(x[:n]), np.sort(x[n - common :])
        found = near_dedup.samples(np.concatenate([a, b]), np.array([0, n, 2 * n]))
        odd = np.unpackbits((np.bitwise_xor(*near_dedup.odd_sketches(found))).view(np.uint8)).sum()
        estimate = 1 + 512 / (4 * near_dedup.SAMPLES) * np.log(max(1e-9, 1 - 2 * odd / 512))
        assert low <= estimate <= high
        assert abs((found[0] == found[1]).mean() - shared) < 0.1
        if shared >= 0.8:
            assert odd <= near_dedup.most_bits() and len(np.intersect1d(*near_dedup.bands(found)))


def _aligned(rows):
    """The contract's result, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
    out, links = [], []
    for i, t in rows:
        row, own = [i, 0, 0, 0, 0, ""], []
        if t:
            a, b = first.encode(" " + t, add_special_tokens=False).ids, second.encode(t)
            bytes_a = [bytes(byte_of[c] for c in first.id_to_token(x)) for x in a]
            bytes_b = [bytes([int(second.id_to_piece(x)[3:5], 16)]) if second.is_byte(x) else second.id_to_piece(x).replace("▁", " ").encode() for x in b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
                ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
                at_b = dict(zip(ends_b.tolist(), b, strict=True))
                own = [(x, at_b[e]) for x, e in zip(a, ends_a.tolist(), strict=True) if e in at_b]
                cuts = [e for e in ends_a.tolist() if e in at_b]
                group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
                parts = [[[], []] for _ in cuts]
                for side, ids, group in ((0, a, group_a), (1, b, group_b)):
                    for x, g in zip(ids, group.tolist(), strict=True):
                        parts[g][side].append(str(x))
                said = ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in parts)
                row = [i, len(a), len(b), len(cuts), len(own), hashlib.sha256(said.encode()).hexdigest()]
        out.append(row)
        links.append(own)
    count = Counter(x for own in links for x in own)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return sorted(((*row[:5], sum(count[x] == best[x[1]] for x in own), sum(count[x] for x in own), row[5]) for row, own in zip(out, links, strict=True)), key=repr)


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("small", [False, True])
def test_alignment(spark, small, monkeypatch):
    if small:
        monkeypatch.setattr(alignment, "CHUNK_BYTES", 50)
        monkeypatch.setattr(alignment, "GATHERED_BYTES", 1)
    odd = [None, "", " ", "  two  spaces ", "<|endoftext|> a <s> </s> <unk>", "▁x", "a\x00b", "\U0001f600 ünï", "ﬁ ligature", "tab\tnew\nline\r\n ", "ends ", "é" * 50, "<0x41>", "it's 12 x12's", "﻿ ĳ ſ İ ​ x"]
    rng = np.random.default_rng(6)
    rows = [(i, t) for i, t in enumerate(odd)] + [(100 + i, " ".join("".join(rng.choice(list("aeithnor"), rng.integers(1, 9))) for _ in range(rng.integers(1, 80)))) for i in range(60)]
    rows += [rows[-1], rows[-1], (None, "a row without an id")]
    got = alignment.align(_table(spark, [(i, t, None) for i, t in rows]), queries.alignment_tokenizers).select(*ALIGNED).collect()
    assert sorted(map(tuple, got), key=repr) == _aligned(rows)


def test_counts_are_bounded_by_the_vocabularies():
    """A linked pair has one token that ends with the other's bytes, so pairs are no more than the bytes of both vocabularies."""
    first, second = queries.alignment_tokenizers()
    ends: dict[bytes, int] = Counter(second[1].data[a:z].tobytes() for a, z in zip(second[1].begins, second[1].begins[1:], strict=False) if z > a)
    assert max(ends.values()) <= 2
    assert 2 * (len(first[1].data) + len(second[1].data)) < 2_000_000 and max(len(first[1].lengths), len(second[1].lengths)) < 1 << alignment.BITS


def test_empty_tables(spark):
    empty = _table(spark, []).limit(0)
    assert collocations.collocations(empty).count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0
    assert alignment.align(empty, queries.alignment_tokenizers).count() == 0
    blank = _table(spark, [(1, None, None), (2, "", "en"), (3, " \n", None)])
    assert collocations.collocations(blank).count() == 0
    assert near_dedup.near_duplicates(blank).where("n_shingles = 0 and kept").count() == 3
    assert alignment.align(blank, queries.alignment_tokenizers).where("groups_sha256 = '' and n_a = 0").count() == 2


BLANKS = {"spaces": " " * 1_200_000, "newlines": "\n" * 1_200_000, "tabs": "\t" * 1_200_000, "mixed": " \n" * 600_000, "between": "a word" + " " * 1_200_000 + "another", "mixed between": "a" + " \n\t" * 400_000 + "b"}


def test_long_runs_of_white_space(spark, tmp_path):
    """Windows hold the ids of the library, and the pipeline goes through."""
    import corpus_pipeline

    library = packing.library_encoder(queries.tokenizer_file("byte_bpe_50k.json"))
    docs = spark.createDataFrame(list(enumerate(BLANKS.values())), "doc_id long, text string").repartition(3)
    rows = packing.pack_documents(docs, queries.packing_encoder).collect()
    for i, text in enumerate(BLANKS.values()):
        ids = library([text])[0] + np.array([packing.END_ID], "<u4").tobytes()
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist() and sum(r["length"] for r in own) == len(ids) // 4
        assert all(r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) for r in own)
    whole = docs.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars")
    whole.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() >= 1
    short = _table(spark, [(i, t[:300_000], None) for i, t in enumerate(BLANKS.values())])
    assert alignment.align(short, queries.alignment_tokenizers).where("n_a > 0").count() == len(BLANKS)


def test_one_very_long_text(spark):
    """Some megabytes in one text, through the operators on texts."""
    from tokenizers import Tokenizer

    rng = np.random.default_rng(9)
    words = " ".join(rng.choice([f"w{i}" for i in range(5000)], 400_000)) + "\nthe last line, which is long enough to count as one"
    docs = spark.createDataFrame([(1, words), (2, words + " more"), (3, words[: len(words) // 2]), (4, "short")], "doc_id long, text string")
    for found, size in ((jaccard_join.jaccard_components(docs), 5), (near_dedup.near_duplicates(docs), 2)):
        assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {1: 1, 2: 1, 3: 3, 4: 4}, size
    assert media.media_features(media.media_column(docs)).where("doc_id = 1").first()["n_bytes"] == len(words.encode())
    path = queries.tokenizer_file("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    got = bpe.bpe_decode(bpe.bpe_encode(docs, path), path).where("doc_id = 1").first()
    assert got["ids"] == own.encode(words, add_special_tokens=False).ids and got["decoded"] == own.decode(got["ids"], skip_special_tokens=False)
    assert {r["doc_id"]: r["n_lines"] for r in line_dedup.line_dedup(docs).collect()} == {1: 2, 2: 2, 3: 1, 4: 1}
    assert packing.pack_documents(docs, queries.packing_encoder).agg({"length": "sum"}).first()[0] > 1_000_000
    told = docs.selectExpr("doc_id", "text", "'en' as lang")
    found = {r["words"]: (r["count"], r["n"]) for r in collocations.phrase_counts(told, 1)[0].groupBy("words").agg({"*": "count", "n": "sum"}).withColumnsRenamed({"count(1)": "count", "sum(n)": "n"}).collect()}
    grams = [Counter(), Counter(), Counter(), Counter()]
    for r in told.collect():
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", r["text"]):
            w = piece.split()
            for k in range(4):
                grams[k].update(zip(*(w[j:] for j in range(k + 1)), strict=False))
    assert found == {k + 1: (len(x), sum(x.values())) for k, x in enumerate(grams)}


def test_automaton_against_edit_distance():
    """Words of the lexicon at no more than one edit, for random words near and far."""
    rng = np.random.default_rng(11)
    terms = sorted({"".join(rng.choice(list("abcde"), rng.integers(5, 9))) for _ in range(60)})
    lexicon = toxicity.Lexicon({t: 1.0 for t in terms})

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]

    def edited(word):
        w = list(word)
        for _ in range(rng.integers(0, 3)):
            i, c = rng.integers(len(w)), str(rng.choice(list("abcdef")))
            w[i : i + int(rng.integers(2))] = [c] if rng.random() < 0.7 else []
            w = w or ["a"]
        return "".join(w)

    words = [edited(terms[rng.integers(len(terms))]) for _ in range(3000)] + ["".join(rng.choice(list("abcde"), rng.integers(1, 10))) for _ in range(1000)]
    for w in words:
        found = lexicon.match(w)
        if w in terms:
            assert found == w
        elif found is not None:
            assert found.endswith("~") and near(w, found[:-1]), w
        elif w[:1] in {t[:1] for t in terms}:
            assert not any(near(w, t) and w[0] == t[0] for t in terms), w
