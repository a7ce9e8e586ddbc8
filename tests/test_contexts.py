"""Windows, previews, anchors, greedy quote merging and honour matching on hand-made cases and against brute force."""

import random
from difflib import SequenceMatcher

import pytest

from citeloom.functions import names as N
from citeloom.operators import anchors as A
from citeloom.operators import cards as C
from citeloom.operators import contexts as X
from citeloom.operators import matching as M

REFERENCES = "\nReferences\n[5] J. Lee, A. Kim. Small widget: a study. Journal of Tests, 2001.\n"


def _table(spark, rows, kinds):
    return spark.createDataFrame(rows, kinds)


def test_markers_near_the_beginning_count_and_references_do_not(spark):
    text = "1 Introduction\nas shown in [5] this holds. " + "word " * 400 + "Again [3], [5] and [4]-[7]." + REFERENCES
    rows = [(1, text, "5"), (2, text, "9"), (3, "", "5"), (4, None, "5"), (5, "The equation of [5] holds.", "5"), (6, "see [5]. " * 500, "5"), (7, text, None)]
    found = sorted(X.target_contexts(_table(spark, rows, "doc_id long, marked string, target_marker string")).collect())
    of = lambda i: [x for x in found if x["doc_id"] == i]
    assert [(x["ordinal"], x["start"], x["kind"], x["heading"]) for x in of(1)] == [(0, 0, "exact_marker", "1 Introduction"), (1, text.index("[3]") - 600, "grouped_marker", "1 Introduction"), (2, text.index("[4]-") - 600, "range_marker", "1 Introduction")]
    assert all(x["stop"] <= text.index("\nReferences") + 1 and x["text"] == text[x["start"] : x["stop"]].strip() for x in of(1)) and not of(2) and not of(3) and not of(4) and not of(7)
    assert of(5)[0]["kind"] == "formula_nearby" and len(of(6)) == 10 and [x["ordinal"] for x in of(6)] == list(range(10))


def test_aliases_in_any_case(spark):
    rows = [(1, "A heat\\E box (new). a HEAT\\E BOX. " + "w " * 900 + "Lee et al. 2022 said.", ["Heat\\E Box", "", "lee et al."]), (2, None, ["x"]), (3, "x", None)]
    found = sorted(X.alias_contexts(_table(spark, rows, "doc_id long, text string, aliases array<string>")).collect())
    assert [(x["doc_id"], x["ordinal"], x["label"], x["kind"]) for x in found] == [(1, 0, "Heat\\E Box", "alias_context"), (1, 1, "Heat\\E Box", "alias_context"), (1, 2, "lee et al.", "alias_context")]


def test_references_are_found_without_a_heading(spark):
    entries = [f"[{i}] A. Author, B. Other. A title of some length. Journal of Tests, {1990 + i}.\n" for i in range(1, 5)]
    two = "[1] one\n[2] two\n"
    jump = entries[0] + entries[1] + "[9] A. Author, B. Other. A title. Journal of Tests, 1990.\n" + "[10] A. Author. Journal, 1991.\n[12] A. Author. Journal, 1992.\n"
    texts = {1: "Body that cites [2].\n" + "".join(entries), 2: two, 3: "x\n" + jump, 4: "x\nReferences\n" + two, 5: None, 6: "[1] A. Author, 2001 no. 3\n" * 4}
    df = _table(spark, list(texts.items()), "doc_id long, text string")
    ends = {r["doc_id"]: r["body_end"] for r in A.body_ends(df).collect()}
    assert ends == {1: texts[1].index("[1]"), 2: len(two), 3: texts[3].index("[9]"), 4: 2, 5: 0, 6: len(texts[6])}
    got = {(r["doc_id"], r["marker"]): r["entry"] for r in A.reference_entries(df).collect()}
    assert got == {(1, str(i + 1)): x.strip() for i, x in enumerate(entries)} | {(3, n): next(x for x in jump.splitlines() if x.startswith(f"[{n}]")) for n in ("9", "10", "12")} | {(4, "1"): "[1] one", (4, "2"): "[2] two"}
    cited = X.target_contexts(df.selectExpr("doc_id", "text as marked", "'2' as target_marker")).collect()
    assert [(r["doc_id"], r["kind"]) for r in cited if r["doc_id"] == 1] == [(1, "exact_marker")]


def test_quotes_are_located_in_one_pass(spark):
    far = "w " * 1000
    texts = {
        1: "Café\u00a0au lait 😀 is the quo-\nted one.", 2: f"heat [5]{far}[5] heat{far}[5] box heat{far}[5] box heat", 3: "[5][5]", 4: None, 5: "no marker", 6: "x" + REFERENCES + "Heat [5] and heat.", 7: "a.b [5] Heat `it`", 8: "😀😀 [5]",
        9: "Body.\n" + "".join(f"[{i}] A. Author, B. Other. A title of some length. Journal of Tests, {1990 + i}.\n" for i in range(1, 5)),
    }
    quotes = [
        (1, 1, "CAFE AU LAIT \U0001f600 IS THE QUOTED", "[5]", None), (2, 2, "heat zq", " [5] ", ["Box"]), (3, 3, None, "[5]", ["x"]), (4, 4, "heat", "[5]", None), (5, 5, "heat", "[5]", None), (6, 6, "Heat zq", "[5]", None), (7, 7, "heat 'IT'", "[5]", None), (8, 8, "zq", "[5]", None),
        (9, 9, "A title of some length", None, None), (10, 7, " [5]\n", "", None), (11, 99, "x", "[5]", None), (12, None, "x", "[5]", None), (13, 5, "", "", None),
    ]
    given = _table(spark, quotes, "item_id long, doc_id long, quote string, marker string, terms array<string>")
    found = X.located_quotes(given, _table(spark, list(texts.items()), "doc_id long, text string"))
    third = texts[2].index("[5] box")
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0, texts[1].index(" one"), "normalised"), (2, third, third + 3, "marker"), (3, 0, 3, "marker"), (7, 8, 17, "normalised"), (8, 3, 6, "marker"), (10, 4, 7, "exact")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 3 and plan.count("instr(body") == 1


def test_of_texts_without_entries_only_the_length_travels(spark):
    df = _table(spark, [(1, "text\n[1] one\ntwo\n[2] three"), (2, "text")], "doc_id long, text string")
    entries = A.numbered_entries(df)
    assert sorted(tuple(r) for r in entries.collect()) == [(1, 1, 5, "1", "[1] one\ntwo\n"), (1, 2, 17, "2", "[2] three")]
    under = entries._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("Exchange")[1]
    assert "CASE WHEN" in under and "AS entry" in under


def test_headings(spark):
    text = "2 Method\nplain words here\nRESULTS\nlower\n" + "x" * 200 + "\nend"
    rows = [text, text[:20], "lower\n", "A Plain: heading\nnot a heading, as it ends so.", "", None]
    got = [r[0] for r in _table(spark, [(x,) for x in rows], "t string").select(X.nearest_heading(X.F.col("t"))).collect()]
    assert got == ["RESULTS", "2 Method", "", "A Plain: heading", "", ""]


def test_preview(spark):
    text = "1 Intro\n\nFirst part.\n\nIt was shown by Lee [5] that heat\nrises. More follows here.\n\nLast part." + REFERENCES
    long = "a b. " * 2000 + "the quote" + " c d." * 2000
    rows = [(1, text, "shown BY lee [5]", "5"), (2, text, "not in the text", "5"), (3, text, "not in the text", ""), (4, long, "the quote", ""), (5, None, None, None)]
    got = {r["evidence_id"]: r for r in X.previews(_table(spark, rows, "evidence_id long, text string, quote string, marker string")).collect()}
    one = got[1]
    assert one["sentence"] == "It was shown by Lee [5] that heat rises." and one["paragraph"].startswith("It was") and one["paragraph"].endswith("here.")
    assert one["start"] == 0 and "References" not in one["shown"]
    assert got[2]["sentence"] == "It was shown by Lee [5] that heat rises." and set(got) == {1, 2, 4}
    assert got[4]["stop"] - got[4]["start"] == X.PREVIEW_CHARS and got[4]["start"] <= long.index("the quote") <= got[4]["stop"]


def test_inherited_anchors(spark):
    cases = [
        ("A Heat-Box is warm.", "In [5] a tool called Heat-Box was shown. A Heat-Box is warm.", (True, "same_paragraph_named_method:Heat-Box")),
        ("A Heat-Box is warm [5].", "In [5] a tool called Heat-Box was shown. A Heat-Box is warm [5].", (False, "")),
        ("A Heat-Box is warm [4].", "x", (False, "quote_contains_other_reference_marker")),
        ("A Heat-Box is warm.", "x", (False, "quote_not_located_in_context")),
        ("A Heat-Box is warm.", "A Heat-Box is warm. [5]", (False, "target_marker_not_before_quote")),
        ("A Heat-Box is warm.", "In [5] a tool called Heat-Box was shown.\n\nA Heat-Box is warm.", (False, "target_marker_in_different_paragraph")),
        ("A Heat-Box is warm.", "In [5] a tool called Heat-Box was shown [6]. A Heat-Box is warm.", (False, "other_reference_marker_between_anchor_and_quote")),
        ("It is warm.", "In [5] a tool called Heat-Box was shown. It is warm.", (False, "no_unique_named_method_link")),
        (None, "x", (False, "")),
    ]
    rows = _table(spark, [(i, q, x, "5") for i, (q, x, _) in enumerate(cases)], "evidence_id long, quote string, context string, marker string")
    assert [tuple(r)[1:] for r in sorted(X.inheritances(rows).collect())] == [want for *_, want in cases]


def test_identities_of_entries(spark):
    cases = [
        ("[1] A. Kim, Different. doi 10.1145/ABC.1.", "10.1145/abc.1", "", False, ("matched", "exact_doi_match", 1.0)),
        ("[1] A. Kim, Different. doi 10.1145/ABC.1.", None, "x doi:10.1145/abc.1", False, ("matched", "exact_doi_match", 1.0)),
        ("[1] A. Kim, S m a l l WID-\nGET - Ä Study. 2001.", "", "", False, ("matched", "normalized_title_match", 0.98)),
        ("[1] J. Lee, Small thing widget study. 1999.", "", "", False, ("matched", "title_author_year_match", 0.95)),
        ("[1] A. Kim, Small thing widget study, 2001.", "", "", False, ("matched", "title_author_year_match", 0.95)),
        ("[1] A. Kim, Small thing widget study. 1999.", "", "", False, ("mismatch", "mismatch", 1.0)),
        ("[1] A. Kim, Heat. 1999.", "", "[9] Entirely other words about rivers and mountains", True, ("mismatch", "marker_resolver_match", None)),
        ("[1] A. Kim, Heat. 1999.", "", "[1] A Kim Heat 1999", True, ("matched", "marker_resolver_match", 1.0)),
        (None, "", "", True, ("unresolved", "", 0.0)),
    ]
    rows = _table(spark, [(i, e, "Small widget: a study", d, o, ["J. Lee", None], 2001, r) for i, (e, d, o, r, _) in enumerate(cases)], "evidence_id long, entry string, title string, doi string, own_entry string, authors array<string>, year int, resolved boolean")
    for r, (*_, want) in zip(sorted(X.identities(rows).collect()), cases, strict=True):
        assert (r["status"], r["method"]) == want[:2] and (want[2] is None or r["score"] == want[2]), r


def test_attributed_quotes(spark):
    far = " " + "z" * 700 + " "
    cases = [("It is  warm.", "Small widget: a study said. It is\nwarm.", True), ("It is warm.", "Small widget: a study said." + far + "It is warm.", False), ("In SMALL widget, a study, all.", "nothing", True), ("It is warm.", "x\nReferences\nSmall widget: a study. It is warm.", False), (None, "Small widget: a study", False), ("absent", "Small widget: a study", False)]
    rows = _table(spark, [(i, q, t, "Small widget: a study") for i, (q, t, _) in enumerate(cases)], "evidence_id long, quote string, text string, title string")
    assert [r["attributed"] for r in sorted(X.attributions(rows).collect())] == [want for *_, want in cases]


def test_compact_text(spark):
    text = "Title\nAbstract\nWe do it.\n\nMethods\nx\n" + "y" * 9000 + REFERENCES
    rows = [(1, text, [("H", "c" * 5000)], " e "), (2, "z" * 300_000, [], ""), (3, None, None, None)]
    df = _table(spark, rows, "doc_id long, text string, contexts array<struct<heading:string,text:string>>, entry string")
    out = {r["doc_id"]: r["compact"] for r in X.compact_texts(df).collect()}
    assert out[1].startswith("## TITLE_ABSTRACT_INTRO_RELATED_CONCLUSION\n## BEGINNING\nTitle") and "\n\nAbstract" in out[1]
    assert out[1].endswith("## TARGET_REFERENCE_ENTRY\ne") and out[1].count("c" * 1800) == 1 and "c" * 1801 not in out[1]
    assert out[2].count("z") == 4000 and out[3] == "" and all(len(r["compact"]) <= 50 for r in X.compact_texts(df, budget=50).collect())


def test_letters_closed_up_by_columns_as_by_the_plain_form(spark):
    rows = ["R e f e r e n c e s of a b", "a b c", "x y", "well-\nknown É a  b\tc d1", "an a b c d", None]
    got = [r[0] for r in _table(spark, [(x,) for x in rows], "t string").select(A.ascii_key(X.F.col("t"))).collect()]
    assert got == [A.ascii_form(x) for x in rows]


def test_sentences_have_their_places(spark):
    texts = ["One. Two!  Three?? Four", "", None, "...", "a.b", "  lead. tail "]
    rows = A.sentences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        assert texts[r["doc_id"]][r["start"] : r["stop"]].strip(" ") == r["sentence"]
    assert [r["sentence"] for r in rows if r["doc_id"] == 0] == ["One.", "Two!", "Three?", "Four"]


def test_quotes_of_any_length_are_located(spark):
    texts = [(1, "a short one and a much longer quote in here"), (2, "nothing"), (3, None), (4, "x a short one")]
    quotes = [(1, "a short one"), (2, "x"), (3, "much longer quote in here"), (4, ""), (5, None), (6, "much longer quote in hers")]
    got = A.quote_location(spark.createDataFrame(quotes, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string"))
    want = {(i, d, t.index(q)) for i, q in quotes if q for d, t in texts if t and q in t}
    assert {tuple(r) for r in got.collect()} == want


def test_quote_keys_lose_accents(spark):
    rows = ["Élan naïve, señor!", "ＡＢＣ ² x", "İstanbul", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(N.canonical_quote_key(N.F.col("x"))).collect()]
    assert got == ["elan naive senor", "abc 2 x", "istanbul", ""]


def _agree(a, b):
    if not a or not b:
        return False
    if a in b or b in a:
        return True
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    return sum(w in set(long.split()) for w in short.split()) >= max(5, len(short.split()) - 2)


def _greedy(rows):
    """The rule, as it is stated."""
    kept = []
    for r in sorted(rows, key=lambda r: r[2]):
        same = next((i for i, k in enumerate(kept) if k[0][:2] == r[:2] and _agree(_key(k[0][3]), _key(r[3]))), None)
        if same is None:
            kept.append([r, 1])
        else:
            prefer = lambda x: (x[4] == "important", x[4] == "accepted", x[5] or 0, len(x[3] or ""), x[2])
            kept[same][1] += 1
            if prefer(r) > prefer(kept[same][0]):
                kept[same][0] = r
    return {(k[0], k[1], k[2], n) for k, n in kept}


def _key(x):
    import re

    return " ".join(re.findall("[a-z0-9]+", (x or "").lower()))[:220]


QUOTES = "item_id long, card_type string, evidence_id long, quote string, review_status string, score double"


@pytest.mark.parametrize("seed", [3, 4])
def test_distinct_quotes_against_the_plain_rule(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(12)]
    rows = []
    for i in range(400):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        quote = rng.choice([" ".join(w), " ".join(w[1:]), " ".join(w)[1:-1], "", None, "w1", "2 w"]) if i % 5 == 0 else " ".join(w)
        rows.append((rng.randint(1, 3) if rng.random() < 0.9 else None, rng.choice("ab"), i, quote, rng.choice(["important", "accepted", "x", None]), rng.choice([0.1, 0.5, None])))
    assert {tuple(r) for r in C.distinct_quotes(spark.createDataFrame(rows, QUOTES).repartition(5)).collect()} == _greedy(rows)


def test_agreements_are_all_found(spark):
    rng = random.Random(9)
    keys = {" ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 9))) for _ in range(120)} | {"b c", "a b cd", "a b c d e f x", "f e d c b a yy z", ""}
    got = {(r["kept"], r["new"]) for r in C.agreements(spark.createDataFrame([("g", k) for k in keys], "grp string, key string")).collect()}
    assert got == {(a, b) for a in keys for b in keys if _agree(a, b)}


def test_one_item_with_all_quotes_spreads(spark):
    """No task sees more than a share of an item's rows, though all are of one item and most agree."""
    rows = [(1, "t", i, f"the same quote of some words with number {i % 3}" if i % 2 else f"a quote of its own {i} {i * 7} {i * 13} {i * 17} {i * 19} x", "", i / 1000) for i in range(1500)]
    df = spark.createDataFrame(rows, QUOTES).repartition(4)
    assert {tuple(r) for r in C.distinct_quotes(df).collect()} == _greedy(rows)
    plan = C.distinct_quotes(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "Window" not in plan


def test_honours_against_every_pair(spark):
    rng = random.Random(5)
    words = "heat small widget study of the river model for large stone data on fast".split()
    title = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(3, 7)))
    items = [(i, f"s{i % 3}", title(), title(), [f"Ann {i % 4}"]) for i in range(60)]
    rows = []
    for i in range(80):
        own = rng.choice(items)
        text = own[2] if i % 3 else own[2][:-2] + "zz"
        rows.append((i, own[1] if i % 7 else "s9", text if i % 5 else title(), own[3] if i % 2 else title(), f"ANN {i % 4}"))
    n = lambda x: " ".join("".join(ch if ch.isalnum() else " " for ch in x.lower()).split())
    ratio = lambda a, b: 1.0 if n(a) == n(b) else SequenceMatcher(None, n(a), n(b)).ratio()
    want = {}
    for r in rows:
        for i in items:
            if r[1] == i[1]:
                s = round(min(1.0, 0.85 * ratio(r[2], i[2]) + 0.15 * ratio(r[3], i[3]) + (0.05 if n(r[4]) in map(n, i[4]) else 0)), 4)
                s = 1.0 if n(r[2]) == n(i[2]) and n(r[3]) == n(i[3]) else s
                if s >= 0.75:
                    want[r[0], i[0]] = s
    a = spark.createDataFrame(rows, "row_id long, session_id string, citing_title string, cited_title string, author string")
    b = spark.createDataFrame(items, "item_id long, session_id string, citing_title string, cited_title string, authors array<string>")
    got = {(r["row_id"], r["item_id"]): r["score"] for r in M.honour_scores(a, b).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-4 for k in want)
    status = {r["row_id"]: (r["item_id"], r["status"]) for r in M.honour_decisions(M.honour_scores(a, b), a).collect()}
    for r in rows:
        own = sorted(((-s, i) for (x, i), s in got.items() if x == r[0]))
        if not own:
            assert status[r[0]] == (None, "unmatched")
        else:
            best, close = -own[0][0], len(own) > 1 and (own[1][0] - own[0][0] < 0.05 - 1e-9 or -own[0][0] < 0.95 - 1e-9)
            assert status[r[0]] == (own[0][1], "ambiguous" if close or best < 0.9 - 1e-9 else "matched")


def test_inbox(spark):
    files = spark.createDataFrame([(1, "10.1/A", "x"), (2, None, "a small widget study"), (3, None, "nothing like it at all")], "file_id long, doi string, title string")
    items = spark.createDataFrame([(7, "10.1/a", "other"), (8, None, "a small widget studies"), (9, None, "a small widget study")], "item_id long, doi string, title string")
    assert {(r["file_id"], r["item_id"]) for r in M.inbox_matches(files, items).collect()} == {(1, 7), (2, 9)}


def test_library_scan_leaves_links_out(spark, tmp_path):
    from citeloom.sources import readers

    (tmp_path / "sub").mkdir()
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "sub" / "a.PDF").write_bytes(b"%PDF-2")
    (tmp_path / "c.txt").write_bytes(b"no")
    (tmp_path / "link.pdf").symlink_to(tmp_path / "b.pdf")
    assert sorted(r["filename"] for r in readers.read_library(spark, str(tmp_path)).collect()) == ["a.PDF", "b.pdf"]
    assert readers.read_library(spark, str(tmp_path), 1).count() == 1
