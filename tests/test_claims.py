"""Kinds of claims, case by case."""

from citeloom.operators import claims as M

ROW = "n long, evidence_quote string, context string, card_type string, stance string, mention_type string, strength string, template_reason string, template_failure string, template_satisfied boolean, anchor_status string, key_phrases array<string>, label_of_mine string"
CASES = [
    ({"anchor_status": "invalid", "template_reason": "RFID"}, "invalid_anchor", M.EXCLUDE, "low", ["anchor"]),
    ({"template_reason": "RFID", "template_satisfied": True, "context": "at mm–level"}, "direct_submm", M.INCLUDE, "high", []),
    ({"template_reason": "RFID", "template_satisfied": True, "context": "Through Wall, of speaker vibration"}, "through_wall", M.REVIEW, "medium", ["candidate"]),
    ({"template_failure": "亚毫米", "template_satisfied": True, "evidence_quote": "speaker\n vibration", "mention_type": "grouped_citation"}, "loudspeaker_vibration", M.INCLUDE, "medium", ["grouped"]),
    ({"template_reason": "RFID", "template_satisfied": True}, "plain_related", M.REVIEW, "low", ["candidate"]),
    ({"template_reason": "RFID", "evidence_quote": "related work"}, "plain_related", M.REVIEW, "low", ["candidate"]),
    ({"template_reason": "RFID", "template_satisfied": False}, "mismatch", M.EXCLUDE, "low", ["candidate"]),
    ({"template_reason": "RFID", "template_satisfied": True, "stance": "mixed", "context": "sub-mm"}, "limitation", M.REVIEW, "medium", ["candidate"]),
    ({"template_reason": "the first", "template_satisfied": True, "evidence_quote": "The FIRST one"}, "first_satisfied", M.INCLUDE, "high", ["scope"]),
    ({"template_satisfied": True, "evidence_quote": "at first"}, "first_scope_unclear", M.EXCLUDE, "low", ["scope"]),
    ({"stance": "negative", "card_type": "representative_work", "mention_type": "grouped_citation"}, "negative", M.REVIEW, "medium", ["grouped", "ordinary", "negative"]),
    ({"card_type": "weak_mention", "strength": "weak"}, "ordinary", M.REVIEW, "low", ["ordinary"]),
    ({"card_type": "representative_work", "strength": "strong"}, "ordinary", M.REVIEW, "medium", ["ordinary"]),
    ({"strength": "moderate"}, "typed", M.INCLUDE, "high", []),
    ({"strength": "strong", "mention_type": "grouped_citation"}, "typed", M.REVIEW, "medium", ["grouped"]),
    ({"strength": None, "card_type": None, "evidence_quote": None, "stance": None}, "typed", M.REVIEW, "medium", []),
]


def claimed(spark, rows):
    names = [x.split()[0] for x in ROW.split(", ")]
    base = {"evidence_quote": "q", "card_type": "method_foundation", "stance": "neutral", "strength": "weak", "label_of_mine": "kept"}
    df = spark.createDataFrame([tuple({**base, "n": i, **r}.get(x) for x in names) for i, r in enumerate(rows)], ROW)
    return M.interpreted(df).orderBy("n").collect()


def test_kinds(spark):
    got = claimed(spark, [r for r, *_ in CASES])
    assert [(r.claim_kind, r.recommendation, r.confidence, list(r.risks)) for r in got] == [tuple(x) for _, *x in CASES]
    assert got[11].label == M.ORDINARY_LABEL and got[12].label == M.LABELS["representative_work"] and got[13].label == M.LABELS["method_foundation"] and got[15].label == "" and got[0].label_of_mine == "kept"


def test_key_phrases(spark):
    text = "rfid TAG and RFID tag; our Small heat model, sub mm, Sub-mm. " + " ".join(f"The {w}{w} system." for w in ("red", "blue", "grey", "pink", "gold", "teal"))
    (row,) = claimed(spark, [{"evidence_quote": text, "key_phrases": [" own ", "OWN", "", "SUB MM"]}])
    assert list(row.key_phrases) == ["own", "SUB MM", "Sub-mm", "rfid TAG", "our Small heat model", "The redred system", "The blueblue system", "The greygrey system", "The pinkpink system"]


def test_cards_without_optional_columns(spark):
    df = spark.createDataFrame([("first", "x", "neutral", "", "strong")], "evidence_quote string, card_type string, stance string, mention_type string, strength string")
    assert M.interpreted(df).first().claim_kind == "first_scope_unclear" and M.interpreted(df.limit(0)).count() == 0


def test_phrases_take_whole_words_as_the_reference_does(spark):
    """Accents are letters: a word is not cut at one."""
    import re

    from pyspark.sql import functions as F

    texts = ["aga ciónjaga RFID tag vibration sensing method", "Êeux RFID tag vibration sensing method", "enbeö RFID tag vibration sensing method", "er éçéier RFID tag"]
    found = lambda t: [x.group(0).strip() for p in M.PHRASES for x in re.finditer(p, t, re.IGNORECASE)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    assert [r[0] for r in df.select(M.key_phrases(F.array().cast("array<string>"), F.col("t"))).collect()] == [found(t) for t in texts]
