"""Templates of sessions and their matches, against plain versions that go row by row."""

import random

import pytest

from citeloom.operators import templates as T

KINDS = [b.kind for b in T.BUILT_IN]


def replay(log):
    """What the log leaves: (session, template_id) -> (name, type, enabled)."""
    held = {}
    for session, _, action, number, kind in sorted(log, key=lambda r: r[1]):
        known = held.get((session, number))
        if action == "create":
            if number > len(KINDS) and known is None:
                others = sum(on for (s, _), (_, _, on) in held.items() if s == session)
                kind = kind or "custom"
                held[session, number] = (f"custom_{kind}_{session}_{others + 1}", kind, True)
        elif number <= len(KINDS):
            held[session, number] = (KINDS[number - 1], KINDS[number - 1], action == "enable")
        elif known:
            held[session, number] = (*known[:2], action == "enable")
    return held


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_log_of_templates(spark, seed):
    r = random.Random(seed)
    log = [(r.choice("ab"), i, r.choice(["enable", "disable", "create", "create"]), r.choice([1, 5, 12, 20, 21, 22, 23]), r.choice([None, "", "tone"])) for i in range(60)]
    df = spark.createDataFrame(log, "session_id string, ordinal long, action string, template_id long, template_type string").repartition(4)
    rows = T.session_templates(T.builtin_templates(spark), df).collect()
    assert {(x.session_id, x.template_id): (x.name, x.template_type, x.enabled) for x in rows} == replay(log)
    assert all(x.aspects == ([x.template_type] if x.user_defined else list(T.BUILT_IN[x.template_id - 1].aspects)) for x in rows)


def test_templates_of_an_empty_log(spark):
    log = spark.createDataFrame([], "session_id string, ordinal long, action string, template_id long")
    assert T.session_templates(T.builtin_templates(spark), log).count() == 0


def plainly(text, t):
    """matched, score of one text and template."""
    text = text or ""
    if t["template_type"] == T.LONG_CONTEXT:
        if len(text) < t["min_chars"] or len(text.split()) < t["min_words"] or (t["require_marker"] and "[" not in text):
            return [], 0
        found = [f"min_citation_chars>={t['min_chars']}"] * (t["min_chars"] > 0) + [f"min_citation_words>={t['min_words']}"] * (t["min_words"] > 0) + ["require_target_marker"] * t["require_marker"]
        return found, min(30, 10 + 5 * len(found))
    found = {}
    for term in (" ".join(x.split()) for x in (*t["positive"], *t["required"], *t["aspects"])):
        if term and term.lower() in text.lower():
            found.setdefault(term.lower(), term)
    return list(found.values()), min(30, 10 * len(found))


def test_matches(spark):
    r = random.Random(7)
    words = ["Heat", "heat", "HEAT  pump", " pump ", "", "box", "Größe", "首次"]
    templates = []
    for s in "ab":
        for i in range(6):
            kind = T.LONG_CONTEXT if i >= 4 else "own"
            pick = lambda: [r.choice(words) for _ in range(r.randint(0, 3))]
            templates.append({"session_id": s, "template_id": i, "name": f"t{i}", "template_type": kind, "positive": pick(), "required": pick(), "aspects": pick(), "min_chars": r.choice([0, 12]), "min_words": r.choice([0, 3]), "require_marker": r.random() < 0.5, "enabled": i != 3})
    texts = [(s, k * 2 + (s == "b"), t) for s in "ab" for k, t in enumerate(["a heat pump [3]", "HEAT\tpump", None, "", "größe box", "该工作首次 [1] x y z w", "[", "box " * 500])] + [("c", 99, "heat")]
    kind = "session_id string, template_id long, name string, template_type string, positive array<string>, required array<string>, aspects array<string>, min_chars int, min_words int, require_marker boolean, enabled boolean"
    got = T.term_matches(spark.createDataFrame(texts, "session_id string, k long, text string"), spark.createDataFrame(templates, kind), "k").collect()
    want = {}
    for s, k, text in texts:
        for t in templates:
            found, score = plainly(text, t)
            if t["session_id"] == s and t["enabled"] and found:
                want[k, t["template_id"]] = (found, float(score))
    assert {(x.k, x.template_id): (list(x.matched_terms), x.match_score) for x in got} == want and len(got) == len(want) > 10
    assert all(x.reason.endswith(", ".join(x.matched_terms)) for x in got)


def test_few_sessions_do_not_gather_texts(spark):
    log = spark.createDataFrame([("a", 1, "enable", 3)], "session_id string, ordinal long, action string, template_id long")
    texts = spark.createDataFrame([("a", i, f"We compare {i}" if i % 2 else None) for i in range(40)], "session_id string, k long, text string")
    found = T.term_matches(texts, T.session_templates(T.builtin_templates(spark), log), "k")
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.k, r.template_id, tuple(r.matched_terms)) for r in found.collect()) == [(i, 3, ("compare",)) for i in range(1, 40, 2)]
