"""Promotion of findings: rules in their order, nulls, widened quotes, verdicts."""

from pyspark.sql import functions as F

from citeloom.operators import promotion as P

ROW = "evidence_id long, doc_id long, citation_text string, evidence_type string, stance string, mention_type string, keep boolean, reasoning string, marker string, aliases array<string>, title string, self_citation_status string, scope string"
TEXT = "Heat rises. The pump cools\nwater as in [5]! Else [7] does. A heat box [5] has a drawback. We compare the heat box.\nReferences\n[5] Lee, J. A heat box. Proc. 2001."


def judged(spark, rows, verdicts=None):
    base = {"doc_id": 1, "stance": "neutral", "mention_type": "direct_citation", "keep": True, "reasoning": "", "marker": "[5]", "aliases": ["heat box"], "title": "A heat box", "self_citation_status": "", "scope": "candidate_spans", "evidence_type": "method_foundation"}
    names = [x.split()[0] for x in ROW.split(", ")]
    findings = spark.createDataFrame([tuple({**base, "evidence_id": i, **r}.get(n) for n in names) for i, r in enumerate(rows)], ROW)
    texts = spark.createDataFrame([(1, TEXT), (2, None)], "doc_id long, text string")
    return [r.asDict() for r in P.promoted(findings, texts, verdicts).orderBy("evidence_id").collect()]


def test_rules_in_order(spark):
    long_quote = "water as in [5] " + "x" * 80
    cases = [
        ({"citation_text": "in [5]", "keep": False}, "keep_false"),
        ({"citation_text": " \n"}, "no_citation_text"),
        ({"citation_text": None}, "no_citation_text"),
        ({"citation_text": "in [5]", "mention_type": "reference_only"}, "reference_only"),
        ({"citation_text": "in [7]"}, "cited_other_reference_marker"),
        ({"citation_text": "Heat rises"}, "target_anchor_missing"),
        ({"citation_text": "in [5]", "marker": None, "aliases": None}, "no_target_reference_marker_available"),
        ({"citation_text": "in [5, 7]", "mention_type": "grouped_citation", "evidence_type": "positive_evaluation"}, "grouped_citation_not_promoted_to_strong_claim"),
        ({"citation_text": "in [5, 7]", "mention_type": "grouped_citation"}, "grouped_citation_saved_for_review"),
        ({"citation_text": "in [5, 7]", "mention_type": "grouped_citation", "evidence_type": "other"}, "grouped_citation_too_ambiguous"),
        ({"citation_text": "[5] Lee, J. A heat box. Proc. 2001.", "scope": P.DIRECT}, "reference_entry"),
        ({"citation_text": "Lee, J. The heat box, Proc. 1999", "scope": P.DIRECT}, "reference_entry"),
        ({"citation_text": "in [5]", "evidence_type": "background", "reasoning": "a drawback", "scope": P.DIRECT}, "background_neutral"),
        ({"citation_text": "in [5]", "evidence_type": "background", "reasoning": "a drawback"}, "saved"),
        ({"citation_text": "in [5]", "evidence_type": "background", "mention_type": "related_work", "reasoning": "an example"}, "saved"),
        ({"citation_text": "in [5]", "evidence_type": "background", "reasoning": None}, "background_neutral"),
        ({"citation_text": "in [5]", "evidence_type": "other"}, "low_strength"),
        ({"citation_text": "in [5]", "evidence_type": None, "stance": None, "mention_type": None}, "low_strength"),
        ({"citation_text": long_quote, "self_citation_status": "self_citation"}, "saved"),
        ({"citation_text": "in [5]", "doc_id": 2}, "saved"),
    ]
    got = judged(spark, [r for r, _ in cases])
    assert [r["reason"] for r in got] == [w for _, w in cases]
    by = {i: r for i, r in enumerate(got)}
    assert (by[13]["decision"], by[13]["evidence_type"], by[13]["stance"], by[13]["mention_type"], by[13]["strength"], by[13]["review"]) == ("saved_background_anchor_upgrade", "limitation_or_negative", "negative", "comparison", "moderate", True)
    assert (by[14]["decision"], by[14]["evidence_type"], by[14]["score"]) == ("saved_representative_review", "representative_work", 0.65)
    assert (by[18]["score"], by[18]["strength"]) == (0.6, "moderate") and by[5]["score"] is None


def test_quotes_are_widened_to_their_sentence(spark):
    got = judged(spark, [{"citation_text": "water as", "aliases": []}, {"citation_text": "The pump", "aliases": []}, {"citation_text": "Else", "aliases": []}, {"citation_text": "not there", "aliases": []}])
    assert [(r["citation_text"], r["expanded"]) for r in got] == [("water as in [5]!", True), ("The pump", False), ("Else", False), ("not there", False)]


def test_entries_need_initials_or_words_of_the_title(spark):
    titles = ["63.222.238.152 Den d", "4643287092793072 One", "A box to Den d"]
    got = judged(spark, [{"citation_text": f"Smith, J. {t} Proc. 1999.", "title": t, "aliases": ["den d", "4643287092793072 one"], "scope": P.DIRECT} for t in titles])
    assert [r["reason"] for r in got] == ["saved", "reference_entry", "reference_entry"]


def test_verdicts_join(spark):
    verdicts = spark.createDataFrame([(0, "strong")], "evidence_id long, template_match_level string")
    got = judged(spark, [{"citation_text": "in [5]"}, {"citation_text": "in [5]"}], verdicts)
    assert [r["template_match_level"] for r in got] == ["strong", None]


def test_no_findings(spark):
    texts = spark.createDataFrame([], "doc_id long, text string")
    assert P.promotion_counts(P.promoted(spark.createDataFrame([], ROW), texts)).count() == 0


def test_long_texts(spark):
    text = "a" * 3_000_000 + " here [5]" + "b" * 3_000_000
    df = spark.createDataFrame([(text,)], "t string").select(F.length(P.sentence_around(F.col("t"), F.lit(" here"))).alias("n"))
    assert df.first()["n"] == len(text)
