"""Operators on small tables: nulls, empty inputs, ties, precedence, streams against batches."""

import itertools
import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from citeloom.functions import identifiers as I
from citeloom.functions import names as N
from citeloom.operators import anchors, answers, cards, evaluation, evidence, graph, inference, matching, queue, upkeep
from citeloom.sources import readers
from citeloom.streaming import streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_functions(spark):
    cases = [
        (N.norm_title_ws(F.lit("  A  B\n c ")), "a b c"),
        (N.norm_title_alnum(F.lit("深度 学习")), ""),
        (N.norm_title_alnum(F.lit(None).cast("string")), ""),
        (N.venue_tier(F.lit("Signature Methods")), "A"),
        (N.venue_tier(F.lit(None).cast("string")), "unknown"),
        (N.author_list(F.lit("A. Sandy; B and C,, D")), ["A. Sandy", "B", "C", "D"]),
        (N.year_in_text(F.lit("vol 2021x")), 2021),
        (N.year_in_text(F.lit("none")), None),
        (N.json_list(F.lit("not json")), []),
        (N.confidence(F.lit("7")), 1.0),
        (I.doi_key(F.lit(" HTTPS://doi.org/10.1/AB ")), "10.1/ab"),
        (I.doi_key(F.lit("")), None),
        (I.doi_in_filename(F.lit("10.1145_3494975.pdf")), "10.1145/3494975"),
        (I.arxiv_in(F.lit("https://arxiv.org/pdf/1706.03762v5.pdf")), "1706.03762v5"),
        (I.arxiv_in(F.lit("1706.03762")), None),
        (I.arxiv_in(F.lit("paper 1706.03762.pdf"), bare=True), "1706.03762"),
        (I.arxiv_in(F.lit("10.1145/1706.03762"), bare=True), None),
        (I.work_id(F.lit("https://openalex.org/W12")), "W12"),
        (anchors.has_marker(F.lit("as in [3, 5-7]"), F.lit("6")), True),
        (anchors.has_marker(F.lit("as in [7]–[3]"), F.lit("5")), True),
        (anchors.has_marker(F.lit("as in [3]"), F.lit("5")), False),
        (anchors.has_marker(F.lit("[1-99999999]"), F.lit("5")), True),
        (anchors.markers(F.lit("[1-99999999], [2]")), [1, 2, 99999999]),
        (anchors.markers(F.lit(None).cast("string")), []),
        (anchors.is_grouped(F.lit("[3]")), False),
    ]
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(cases))).first()
    for got, (column, want) in zip(row, cases, strict=True):
        assert got == want, column


def test_scores_keep_their_thresholds(spark):
    s = lambda q, k, st, m: one(spark, evidence.score_finding(F.lit(q), F.lit(k), F.lit(st), F.lit(m)))
    assert s("", "method_foundation", "positive", "x")["strength"] == "none"
    assert s("q" * 80, "method_foundation", "positive", "x")["strength"] == "strong"
    assert s("q", "method_foundation", "neutral", "x")["score"] == 0.75
    assert s("q", "method_foundation", "positive", "grouped_citation")["score"] == 0.25


def test_resolution_prefers_ids_and_merges_a_batch(spark):
    known = spark.createDataFrame([(1, "W1", "10.1/a", "T one", 2000), (2, None, "10.1/b", "T two", 2001)], "publication_id long, work_id string, doi string, title string, year int")
    new = spark.createDataFrame([(1, "W1", "10.1/b", "x", 1), (2, None, "DOI:10.1/B", "x", 1), (3, None, None, " t  ONE", 2000), (4, None, "10.1/n", "N", 1), (5, None, "10.1/N", "M", 1), (6, None, None, None, None)], "ordinal long, work_id string, doi string, title string, year int")
    got = {r["ordinal"]: (r["publication_id"], r["matched_by"]) for r in graph.resolve_publications(new, known).collect()}
    assert got == {1: (1, "work_id"), 2: (2, "doi"), 3: (1, "title_year"), 4: (-4, "new"), 5: (-4, "doi"), 6: (-6, "new")}


def test_rebuild_keeps_what_users_set(spark):
    q = spark.createDataFrame([(1, 1, "pending"), (1, 2, "pending")], "cited_id long, citing_id long, queue_status string")
    old = spark.createDataFrame([(1, 2, "skipped", "important", "n")], "cited_id long, citing_id long, queue_status string, user_review_status string, user_note string")
    once = queue.rebuild(q, old)
    twice = queue.rebuild(once, once)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.select(once.columns).collect()))
    assert {r["citing_id"]: r["queue_status"] for r in once.collect()} == {1: "pending", 2: "skipped"}


def test_queue_without_authors_is_ambiguous(spark):
    edges = spark.createDataFrame([("s", 1, 2, "need_pdf", "t", "d", "c", None, None, [], "pending")], "session_id string, cited_id long, citing_id long, pdf_readiness_status string, cited_title string, cited_doi string, citing_title string, venue string, year int, citing_authors array<string>, queue_status string")
    r = queue.build_queue(edges, spark.createDataFrame([], "cited_id long, author string"), 2020).first()
    assert (r["third_party_status"], r["priority_score"], [x["reason"] for x in r["reasons"]]) == ("ambiguous", 0.0, ["ambiguous_third_party_status"])


def test_title_join_finds_what_the_ratio_finds(spark):
    words = "red green blue fast slow deep wide thin novel robust sparse dense".split()
    titles = [f"{a} {b} networks for {c} sensing {i}" for i, (a, b, c) in enumerate((words[i % 12], words[(i * 5 + 1) % 12], words[(i * 7 + 3) % 12]) for i in range(60))]
    left, right = titles[:30], [t.replace("for", "of") for t in titles[:15]] + titles[30:]
    df = lambda ts: spark.createDataFrame(list(enumerate(ts)), "id long, title string")
    got = {(r["left_id"], r["right_id"]) for r in matching.title_similarity_join(df(left), df(right), 0.9).collect()}
    want = {(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if SequenceMatcher(None, a, b).ratio() >= 0.9}
    assert got <= want and len(got) >= 0.9 * len(want) and want


def _ratio_pairs(left, right, least):
    return {(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if SequenceMatcher(None, a, b).ratio() >= least}


@pytest.mark.parametrize("least", [0.65, 0.8, 0.9])
def test_title_join_loses_nothing_where_every_word_is_common(spark, least):
    words = "red green blue fast slow deep wide".split()
    right = [" ".join(p) for p in itertools.islice(itertools.permutations(words), 0, None, 4)]  # 1,260 titles of the same seven words
    left = [right[0], right[700], "red green blue fast slow deep wide thing", "blue", "x" * 70 + " red green blue"]
    right += ["blue x", "x" * 71 + " red green blue", "x" * 260 + " red"]
    df = lambda ts: spark.createDataFrame(list(enumerate(ts)), "id long, title string")
    rows = matching.title_similarity_join(df(left), df(right), least).collect()
    want = _ratio_pairs(left, right, least)
    assert len(rows) == len(want) and {(r["left_id"], r["right_id"]) for r in rows} == want and len(want) >= 4
    assert all(r["score"] == SequenceMatcher(None, left[r["left_id"]], right[r["right_id"]]).ratio() for r in rows)


def test_title_join_finds_titles_without_a_shared_word(spark):
    left, right = ["recognition", "ab", "deep learning"], ["recognision", "abc", "depe learnings", "other"]
    df = lambda ts: spark.createDataFrame(list(enumerate(ts)), "id long, title string")
    got = {(r["left_id"], r["right_id"]) for r in matching.title_similarity_join(df(left), df(right), 0.8).collect()}
    assert got == _ratio_pairs(left, right, 0.8) == {(0, 0), (1, 1), (2, 2)}


def _edited(rng, title, most):
    """title with up to so many letters put in, taken out or replaced."""
    t = list(title)
    for _ in range(rng.randint(0, most)):
        at = rng.randrange(len(t) + 1)
        t[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "z", " ", "7"])
    return "".join(t)


@pytest.mark.parametrize("least", [0.95, 0.97, 0.99])
def test_pieces_lose_no_pair(spark, least):
    """Against all pairs: edits at any place, one title for many, repeated letters, lengths down to those that only an equal title reaches."""
    rng = random.Random(int(least * 100))
    words = "graph citation impact of on the learning deep networks analysis survey large scale".split()
    seeds = [" ".join(rng.choices(words, k=rng.randint(1, 14))) for _ in range(60)] + ["a" * 45, "ab " * 30, "x"]
    left = [t for t in (_edited(rng, rng.choice(seeds), 4) for _ in range(150)) if t.strip()]
    right = [t for t in (_edited(rng, rng.choice(seeds), 4) for _ in range(250)) if t.strip()]
    tidy = lambda ts: [" ".join(t.split()) for t in ts]
    left, right = tidy(left), tidy(right)
    df = lambda ts: spark.createDataFrame([(i, t, "s") for i, t in enumerate(ts)], "id long, title string, session_id string")
    rows = matching.title_similarity_join(df(left), df(right), least, "session_id").collect()
    want = _ratio_pairs(left, right, least)
    assert len(rows) == len(want) and {(r["left_id"], r["right_id"]) for r in rows} == want
    assert len([1 for i, j in want if left[i] != right[j]]) > 5


def test_pieces_in_blocks(spark, monkeypatch):
    """A piece that all titles share fills many blocks; the result is the same."""
    monkeypatch.setattr(matching, "BLOCK_TITLES", 4)
    titles = [f"a common beginning that every title of this table has and then number {i:03d}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    rows = matching.title_similarity_join(df, df, 0.97).collect()
    want = _ratio_pairs(titles, titles, 0.97)
    assert len(rows) == len(want) > 600 and {(r["left_id"], r["right_id"]) for r in rows} == want


def test_token_overlap_is_lossless(spark):
    a = ["a b c d", "a b c x", "q", "", "a b c d e f g h"]
    df = spark.createDataFrame(list(enumerate(a)), "id long, title string")
    got = {(r["left_id"], r["right_id"]) for r in matching.token_overlap_join(df, df).collect()}
    sets = [set(x.split()) for x in a]
    assert got == {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if x and y and len(x & y) / max(len(x), len(y)) >= 0.75}


def test_quotes_are_merged_greedily_in_order(spark):
    long = "one two three four five six seven"
    rows = [(1, "t", 1, long, "", 0.0), (1, "t", 2, long.upper() + "!", "accepted", 0.0), (1, "t", 3, long + " eight nine", "", 0.9), (1, "u", 4, long, "", 0.0), (1, "t", 5, "", "", 0.0), (1, "t", 6, None, None, None)]
    df = spark.createDataFrame(rows, "item_id long, card_type string, evidence_id long, quote string, review_status string, score double")
    assert {(r["evidence_id"], r["copies"]) for r in cards.distinct_quotes(df).collect()} == {(2, 3), (4, 1), (5, 1), (6, 1)}


def test_verdicts_guard_and_group(spark):
    """Strong, candidate and none; a grouped citation is a candidate until the model attributes it."""
    kinds = "template_id int, session_id string, template_type string, name string, goal string, user_defined boolean, enabled boolean, aspects array<string>, allowed_types array<string>, positive array<string>, negative array<string>, required array<string>, require_marker boolean, min_chars int, min_words int"
    t = spark.createDataFrame([(2, "s", "detailed_comparison", "compared", "", False, True, [], [], [], [], [], None, 0, 0), (3, "s", "baseline_or_benchmark", "off", "", False, False, [], [], [], [], [], None, 0, 0)], kinds)
    text = "We compare with [3] in experiments. We report higher accuracy than the others do."
    row = lambda i, quote, status="matched", group=False, ids=(), inherited=False: (i, "s", quote.replace("[3]", "[3, 4]") if group else quote, "", "detailed_comparison", "", "", [], status, "3", "A title", inherited, "review", list(ids), True)
    rows = [row(1, text), row(2, text, group=True), row(3, text, group=True, ids=[2]), row(4, text, status="mismatch"), row(5, ""), row(6, text.replace("[3]", "it")), row(7, text.replace("[3]", "it"), inherited=True), row(8, "We compare with [3]."), row(9, "A title [3]")]
    f = spark.createDataFrame(rows, "evidence_id long, session_id string, citation_text string, context string, claim_type string, mention_type string, reasoning string, keywords array<string>, reference_match_status string, target_marker string, title string, inherited boolean, recommendation string, model_ids array<int>, model_satisfied boolean")
    got = {r["evidence_id"]: (r["template_match_level"], list(r["template_ids"])) for r in evaluation.together(evaluation.evaluations(f, t), t).collect()}
    level = {1: "strong", 2: "candidate", 3: "strong", 4: "none", 5: "none", 6: "none", 7: "strong", 8: "candidate", 9: "none"}
    assert got == {i: (x, [] if x == "none" else [2]) for i, x in level.items()}


def test_answers_are_salvaged_or_quarantined(spark):
    good = '{"evidence_type": "x", "stance": "y", "keep": true, "confidence": 0.5}'
    rows = [(1, good), (2, f"<think>hm</think>```json\n{good}\n```"), (3, f"so: {{bad}} {good}."), (4, "nothing"), (5, None)]
    got = {r["item_id"]: r["status"] for r in inference.salvaged(spark.createDataFrame(rows, "item_id long, response string")).collect()}
    assert got[1] == "parsed" and got[3] == "salvaged" and got[4] == got[5] == "quarantined" and got[2] in ("parsed", "salvaged")


def test_types_stances_and_mentions_of_quotes(spark):
    """The first type wins; words are parts of longer ones, without accents; a type is positive or negative by its words."""
    rows = [
        ("We compare with the first such study", "none of it", "first_or_seminal_claim", "positive", "other"),
        ("A COMPARISON with a baseline", "other", "detailed_comparison", "neutral", "comparison"),
        ("the strong bench\tmark set", "x", None, "neutral", "other"),
        ("It builds\n on  theory and fails", "other", "method_foundation", "negative", "method_use"),
        ("a théorétical view", "x", "theoretical_foundation", "neutral", "method_use"),
        ("An extension of Deep  Nets", "deep nets", "application_extension", "neutral", "explicit_target"),
        ("robustness", None, "positive_evaluation", "positive", "explicit_target"),
        ("a weakness", "zz", "limitation_or_negative", "negative", "other"),
        ("", "zz", None, "neutral", "other"), (None, None, None, "neutral", "explicit_target"),
    ]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, quote string, title string")
    got = {r["i"]: tuple(r["x"]) for r in df.select("i", evidence.inferred(F.col("quote"), F.col("title")).alias("x")).collect()}
    assert got == {i: r[2:] for i, r in enumerate(rows)}
    assert {r["x"]["mention_type"] for r in df.select(evidence.inferred(F.col("quote")).alias("x")).collect()} == {"other", "comparison", "method_use"}


def test_findings_of_answers_in_any_shape(spark):
    f = {"evidence_type": "background", "stance": "neutral", "mention_type": "m", "reasoning": "r", "citation_text": "c {d} [1]"}
    named = lambda name, *rows: json.dumps({name: rows})
    shapes = [
        (named("findings", f, f), "parsed", None, 2),
        (json.dumps([f]), "parsed", None, 1),
        (named("evidence", f), "parsed", None, 1),
        (named("evidence", f) + ",", "quarantined", "no_json", 0),  # begins like JSON and is none
        ("<THINK>\n{}</think>" + named("findings", f), "parsed", None, 1),
        ("<think>no end " + named("findings", f), "quarantined", "no_json", 0),
        ("so {bad} [x] " + named("findings", f) + " or {}", "salvaged", None, 1),
        ("first " + named("findings", f) + " then " + named("findings", f, f), "salvaged", None, 2),
        ("```\n" + named("findings", f) + "```\n" + named("findings"), "salvaged", None, 1),  # a fence before what stands free
        ("a list: " + json.dumps([1, 2]), "quarantined", "finding", 0),
        (named("findings", dict(f, stance="odd")), "quarantined", "stance", 0),
        (named("findings", f, dict(f, evidence_type=None)), "quarantined", "evidence_type", 0),
        (named("findings", {k: v for k, v in f.items() if k != "mention_type"}), "quarantined", "mention_type", 0),
        (named("findings", dict(f, reasoning=5)), "quarantined", "reasoning", 0),
        (named("findings", dict(f, keywords="k")), "quarantined", "keywords", 0),
        (named("findings", dict(f, matched_template_ids=["x"])), "quarantined", "matched_template_ids", 0),
        (named("findings", 1), "quarantined", "finding", 0),
        (json.dumps({"findings": 3}), "quarantined", "not_findings", 0),
        ("No relevant\n evidence FOUND", "no_evidence", None, 0),
        ("No relevant evidence found.", "quarantined", "no_json", 0),
        ("{}", "parsed", None, 0), ("[]", "parsed", None, 0), ("", "quarantined", "no_json", 0), (None, "quarantined", "no_json", 0),
        ("x" * 300_000 + "{" * 300 + named("findings", f), "salvaged", None, 1),
    ]
    df = answers.answers(spark.createDataFrame([(str(i), x[0]) for i, x in enumerate(shapes)], "item_id string, response string")).cache()
    got = {int(r["item_id"]): (r["status"], r["reason"], len(r["findings"])) for r in df.collect()}
    assert got == {i: x[1:] for i, x in enumerate(shapes)}
    assert {(r["evidence_type"], r["citation_text"], r["keep"]) for r in answers.findings(df).collect()} == {("background", "c {d} [1]", True)}
    assert answers.answers(df.sparkSession.createDataFrame([], "item_id long, response string")).collect() == []


def test_other_names_and_escapes(spark):
    rows = [
        (1, json.dumps([{"evidence_type": "", "aspect": None, "type": "precision_claim", "category": "background", "stance": "mixed", "mention_type": "m", "reason": "r", "evidence_quote": "q", "text": "t", "highlight_keywords": ["k"], "keep": False, "matched_template_ids": [3, 4]}])),
        (2, r"""[{"evidence_type": "background", "stance": "mixed", "mention_type": "a\'b \\'c", "reasoning": "r"}]"""),
    ]
    got = {r["item_id"]: r for r in answers.findings(answers.answers(spark.createDataFrame(rows, "item_id long, response string"))).collect()}
    assert tuple(got[1])[2:] == ("precision_claim", "mixed", "m", "r", "q", ["k"], False, [3, 4], "", None, None)
    assert got[2]["mention_type"] == "a'b \\'c" and got[2]["citation_text"] is None


def test_failed_batches_become_rows(spark):
    def broken(prompts):
        raise RuntimeError("down")

    p = spark.createDataFrame([(1, "a"), (2, "b")], "item_id long, prompt string")
    assert {r["error"] for r in inference.infer(p, broken).collect()} == {"RuntimeError: down"}
    assert {r["response"] for r in inference.infer(p, lambda ps: [x * 2 for x in ps]).collect()} == {"aa", "bb"}


def test_document_pool(spark):
    """Ties by id, items and links without a document, a document without either, an empty pool."""
    assets = spark.createDataFrame([(1, "web", "extracted"), (2, "web", "pending"), (3, None, None)], "asset_id long, source_type string, extract_status string")
    links = spark.createDataFrame([(5, 1, "b", "B"), (4, 1, None, "A"), (6, None, "x", "X")], "link_id long, asset_id long, doi string, raw_title string")
    items = spark.createDataFrame([(1, 1, 9, "old"), (2, 1, 10, "tie"), (3, 1, 10, "last"), (4, None, 11, "none"), (5, 2, None, None)], "item_id long, asset_id long, updated_at long, citing_title string")
    usage = upkeep.asset_usage(assets, links, items)
    assert sorted(tuple(r)[0:1] + tuple(r)[3:] for r in usage.collect()) == [(1, None, "A", 2, 3, "last"), (2, None, None, 0, 1, ""), (3, None, None, 0, 0, "")]
    assert tuple(upkeep.pool_summary(usage).first()) == (3, 1, 2, 4) and [r["asset_id"] for r in upkeep.recent_assets(usage, 2).collect()] == [3, 2]
    assert tuple(upkeep.pool_summary(upkeep.asset_usage(assets.limit(0), links, items)).first()) == (0, 0, 0, 0)


def test_citation_list_from_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Title,Authors,Year,Source,Publisher,DOI,ArticleURL,GSRank\n"A ""b"" c","X; Y",in 2019,,P,DOI:10.1/Q,u,3\n', encoding="utf-8")
    r = readers.read_citation_list(spark, str(tmp_path / "a.csv")).first()
    assert (r["title"], r["authors"], r["year"], r["venue"], r["doi"], r["rank"]) == ('A "b" c', ["X", "Y"], 2019, "", "10.1/q", 3)


def test_honours_need_their_columns(spark, tmp_path):
    (tmp_path / "h.csv").write_text("Citing Author\nA\n")
    with pytest.raises(ValueError, match="Honor/Category"):
        readers.read_honours(spark, str(tmp_path / "h.csv"))


def test_sessions_are_replaced_and_others_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "annotations")
    df = lambda *rows: spark.createDataFrame(list(rows), "session_id string, note_id long, text string")
    files = lambda: {p.relative_to(path): p.stat().st_mtime_ns for p in (tmp_path / "annotations").rglob("*.parquet")}
    rows = lambda: sorted((tuple(r) for r in readers.stored_sessions(spark, path, df().schema).collect()), key=str)
    readers.store_sessions(df(("a", 1, "x"), ("a", 2, None), ("b/c = d", 3, "y"), (None, 4, "z"), ("e", 5, "w")), path)
    before = files()
    for _ in range(2):  # once more, as after a failure
        readers.store_sessions(df(("a", 7, "n"), (None, 8, "n")), path, spark.createDataFrame([("a",), ("e",), ("new",)], "session_id string"))
        assert rows() == sorted([("a", 7, "n"), ("b/c = d", 3, "y"), (None, 8, "n")], key=str)
    kept = {p: at for p, at in before.items() if "d" in str(p.parent).split("=", 1)[1] and "DEFAULT" not in str(p)}
    assert len(kept) == 1 and all(files().get(p) == at for p, at in kept.items())
    readers.store_sessions(df(), path)
    assert len(rows()) == 3
    plan = readers.stored_sessions(spark, path, df().schema).where("session_id = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(session_id" in plan
    with pytest.raises(Exception, match="without a name"):
        readers.store_sessions(df(("", 1, "x")), path)


def test_library_scan_and_validation(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "10.1145_3494975.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "A_good_title.pdf").write_bytes(b"nope")
    (tmp_path / "note.txt").write_text("x")
    got = {r["filename"]: (r["doi"], r["normalized_title"]) for r in readers.read_library(spark, str(tmp_path)).collect()}
    assert got == {"10.1145_3494975.pdf": ("10.1145/3494975", "10 1145 3494975 pdf"), "A_good_title.pdf": (None, "a good title")}


def test_profile_from_xml(spark, tmp_path):
    (tmp_path / "p.xml").write_text("<d><article><title>A title.</title><year>2020</year><journal>J</journal><ee>https://doi.org/10.1145/12</ee><author>X</author></article></d>")
    r = readers.read_profile(spark, str(tmp_path / "p.xml")).first()
    assert (r["title"], r["year"], r["venue"], r["doi"]) == ("A title", 2020, "J", "10.1145/12")


def test_intake_stream_equals_batch(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    for n, data in (("a.pdf", b"1"), ("b.pdf", b"1"), ("c.pdf", b"2")):
        (folder / n).write_bytes(data)
    streams.start_intake(spark, str(folder), store, str(tmp_path / "ck")).awaitTermination()
    (folder / "d.pdf").write_bytes(b"2")
    (folder / "e.pdf").write_bytes(b"3")
    streams.start_intake(spark, str(folder), store, str(tmp_path / "ck")).awaitTermination()
    files = spark.read.format("binaryFile").load(str(folder)).select("path", F.sha2("content", 256).alias("sha256"))
    batch = streams.intake(files, spark.createDataFrame([], "sha256 string"))
    assert sorted(r["sha256"] for r in spark.read.parquet(store).collect()) == sorted(r["sha256"] for r in batch.collect())


def test_inbox_stream_matches_and_binds(spark, tmp_path):
    """Two batches equal the batch operator on all files; a batch that is run again, or late, changes nothing."""
    folder, store, ck = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "ck")
    folder.mkdir()
    items = spark.createDataFrame([(1, None, "A study of warm rivers in spring"), (2, "10.1145/3494975", "Another thing"), (3, None, "Stones and how they fall down slowly")], "item_id long, doi string, title string")
    put = lambda files: [(folder / n).write_bytes(d) for n, d in files]
    put([("a_study_of_warm_rivers_in_spring.pdf", b"1"), ("z copy.pdf", b"1"), ("10.1145_3494975.pdf", b"2")])
    streams.start_inbox(spark, str(folder), store, lambda: items, ck).awaitTermination()
    put([("copy_of_1.pdf", b"1"), ("stones and how they fall down.pdf", b"3"), ("nothing known.pdf", b"4")])
    streams.start_inbox(spark, str(folder), store, lambda: items, ck).awaitTermination()
    view = lambda: sorted((r["sha256"], r["path"].split("/")[-1], r["item_id"], r["status"], r["bound"]) for r in spark.read.parquet(store).collect())
    files = spark.read.format("binaryFile").load(str(folder)).select("path", F.sha2("content", 256).alias("sha256"))
    batch = streams.matched_intake(files, spark.createDataFrame([], "sha256 string"), items)
    assert view() == sorted((r["sha256"], r["path"].split("/")[-1], r["item_id"], r["status"], r["bound"]) for r in batch.collect())
    assert sorted((x[2], x[3], x[4]) for x in view() if x[2]) == [(1, "matched", True), (2, "matched", True), (3, "candidate", False)]
    for number in (1, 0, 1):  # replays, out of order
        names = ["copy_of_1.pdf", "stones and how they fall down.pdf", "nothing known.pdf"] if number else ["a_study_of_warm_rivers_in_spring.pdf", "z copy.pdf", "10.1145_3494975.pdf"]
        before = view()
        streams.store_batch(files.where(F.substring_index("path", "/", -1).isin(names)), number, store, items)
        assert view() == before


def test_newest_states_stream_equals_batch(spark, tmp_path):
    """Shuffled files, rows that come late: the last row of each key is its state in the batch. State goes after its time."""
    import random
    from datetime import datetime, timedelta

    rng, start = random.Random(2), datetime(2024, 1, 1)
    rows = [(i, f"u{rng.randint(0, 6)}", start + timedelta(minutes=rng.randint(0, 300)), rng.choice("abc")) for i in range(200)]
    rng.shuffle(rows)
    kind, src, out = "event_id long, user string, ts timestamp, state string", str(tmp_path / "src"), str(tmp_path / "out")
    for k in range(4):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], kind).coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(src)
        keep = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)
        streams.newest_states(stream, "user", "state", late="10 hours", keep=timedelta(days=1)).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        return {r["key"]: (r["value"], r["changes"]) for r in spark.read.parquet(out).groupBy("key").agg(F.max_by(F.struct("value", "changes"), "batch").alias("m")).select("key", "m.*").collect()}

    want = {r["user"]: (r["state"], r["changes"]) for r in streams.current_state(spark.createDataFrame(rows, kind), "user", "state").collect()}
    assert run() == want
    for day in (5, 6):  # time goes on for another key; then u0 comes back and begins anew
        spark.createDataFrame([(900 + day, "other", start + timedelta(days=day), "z")], kind).coalesce(1).write.mode("append").parquet(src)
        run()
    spark.createDataFrame([(990, "u0", start + timedelta(days=6), "back")], kind).coalesce(1).write.mode("append").parquet(src)
    assert run()["u0"] == ("back", 1)


def test_progress_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(i, f"2024-01-01 0{i % 5}:30:00", "x" if i % 2 else "y", float(i)) for i in range(40)], "event_id long, t string, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    path = str(tmp_path / "events")
    events.coalesce(1).write.parquet(path)
    stream = streams.progress(spark.readStream.schema(events.schema).parquet(path))
    q = stream.writeStream.format("memory").queryName("progress").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("progress").collect())) == sorted(map(tuple, streams.progress(events).collect()))


def test_incremental_edges_equal_batch(spark, tmp_path):
    schema = "session_id string, cited_id long, citing_id long, ordinal long, meta map<string,string>"
    rows = [("s", 1, 2, 1, {"a": "1"}), ("s", 1, 3, 2, {"a": "1", "b": None}), ("s", 1, 2, 3, {"a": "2", "b": "x"})]
    src, store = str(tmp_path / "src"), str(tmp_path / "edges")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    empty = spark.createDataFrame([], "session_id string, cited_id long, citing_id long, meta map<string,string>")

    def merge(batch, number):
        graph.upsert_edges(empty, batch).write.mode("overwrite").parquet(store)

    streams.start_upserts(spark.readStream.schema(schema).parquet(src), merge, str(tmp_path / "ck")).awaitTermination()
    got = {r["citing_id"]: r["meta"] for r in spark.read.parquet(store).collect()}
    assert got == {2: {"a": "2", "b": "x"}, 3: {"a": "1"}}
