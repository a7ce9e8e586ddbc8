"""Templates judged against findings and decisions of a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.operators import contexts as X
from citeloom.operators import decisions as D
from citeloom.operators import evaluation as V
from citeloom.operators import queue as Q
from citeloom.operators import templates as T

from .evidence_plans import EVIDENCE_TEXT, MATCHED, evidence_texts, template_log
from .fixtures import Source

c = F.col
TITLE = "Small widget: a study"
#: What findings say, each with the rules that it is to pass or fail; the text around some is a whole document.
QUOTES = [
    "Smith [5] was the first to describe this, and we list it.",
    "Compared with [5], our error is lower. It needs a table.",
    "We compare ours to [5].",
    "The baseline [5] is used in all experiments.",
    "A benchmark named by [5].",
    "The method of [5] is effective and robust.",
    "However, [5] cannot run alone and is limited.",
    "We build on the model of [5], based on its equation.",
    "We adopt the approach of [5] and use it.",
    "They describe a tool in [5].",
    "Small widget: a study [5]",
    "See the references [5].",
    "",
    "The tool of [7] measures heat.",
    "It measures heat [5, 8] and detects it with a tool.",
    "The earliest of these, unlike the tool that was shown, is [5].",
    "A forbidden tool [5] measures heat.",
    "In work on heat small widgets are seminal: Small Widget is one.",
]
CLAIMS = ["detailed_comparison", "baseline_or_benchmark", "positive_evaluation", "limitation_feedback", "theoretical_foundation", "method_use", "method_summary", "ordinary_reference", "first_or_seminal_claim", "other", ""]
#: template_id, type, name, goal, user_defined, aspects, positive, negative, required, min_chars, min_words.
TEMPLATES = [
    *((i + 1, kind, f"built {i + 1}", "", False, [], [], [], [], 0, 0) for i, kind in enumerate(V.CONTRACTS)),
    (20, "tone", "neutral words", "a neutral description", False, ["background"], [], [], [], 0, 0),
    (21, "custom", "own words", "heat", True, [], ["measures heat", "tool"], ["forbidden"], ["tool"], 12, 4),
    (22, "focus", "a focus", "", False, ["method_use", "other"], ["approach", "tool"], [], [], 0, 0),
]
TEMPLATE_ROW = "template_id int, template_type string, name string, goal string, user_defined boolean, aspects array<string>, positive array<string>, negative array<string>, required array<string>, min_chars int, min_words int"


def templates(s: Source):
    """The templates of every session."""
    rows = s.spark.createDataFrame(TEMPLATES, TEMPLATE_ROW)
    own = F.broadcast(rows.withColumn("one", F.lit(1)))  # a table of the plan, as long as TEMPLATES
    out = s.fx_evidence.select("session_id").distinct().withColumn("one", F.lit(1)).join(own, "one").drop("one")
    return out.withColumns({"allowed_types": F.array().cast("array<string>"), "require_marker": F.lit(None).cast("boolean"), "enabled": F.lit(True)})


def _pick(values: list[str], k):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (k % len(values) + 1).cast("int"))


def findings(s: Source):
    """A finding for each document, in the words of QUOTES; an English document is the context of every third."""
    k = c("doc_id")
    return s.documents.select(
        k.alias("evidence_id"), k.alias("item_id"), F.concat(F.lit("S"), (k % 7).cast("string")).alias("session_id"), _pick(QUOTES, k).alias("citation_text"),
        F.when((k % 3 == 0) & (c("lang") == "en"), c("text")).otherwise("").alias("context"), _pick(CLAIMS, F.floor(k / len(QUOTES))).alias("claim_type"),
        F.lit("").alias("mention_type"), F.when(k % 17 == 0, "listed as related work").otherwise("").alias("reasoning"), F.array(F.lit("tool"), F.lit("heat")).alias("keywords"),
        F.when(k % 13 == 0, "mismatch").otherwise("matched").alias("reference_match_status"), F.lit("[5]").alias("target_marker"), F.lit(TITLE).alias("title"), (k % 11 == 0).alias("inherited"),
        F.when(k % 2 == 0, "include").otherwise("review").alias("recommendation"), F.when(k % 5 == 0, F.array(F.lit(21), F.lit(3))).otherwise(F.array().cast("array<int>")).alias("model_ids"), (k % 10 != 0).alias("model_satisfied"),
    )


def _text(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(map(_text, values)) + "]" if values else "[]::varchar[]"


def _says(expr: str, cue: str) -> str:
    words, more = V.CUES[cue]
    return f"regexp_matches({expr}, {_text(rf'(?i)\b(?:{words})\b' + (f'|{more}' if more else ''))})"


PLAIN = r"trim(regexp_replace(lower({0}), '[^a-z0-9\x{{4e00}}-\x{{9fff}}]+', ' ', 'g'))"
BARE = PLAIN.format(r"regexp_replace(q, '\[[^\]]+\]', '', 'g')")
ALLOWED = "case type " + " ".join(f"when {_text(k)} then {_list(v)}" for k, v in V.CONTRACTS.items()) + " else case when own then []::varchar[] else aspects end end"
KNOWN = "type in (" + ", ".join(map(_text, V.CONTRACTS)) + ")"
BAD_TYPE = "'evidence type ' || case when claim = '' then 'unknown' else claim end || ' is not allowed by the template'"


def _in(types: list[str]) -> str:
    return "claim in (" + ", ".join(map(_text, types)) + ")"


def _rule(kind: str, types: str, need: str, lacking: str, strong: str, candidate: str, blocked: str = "") -> str:
    failure = f"case when guard is not null then guard when not ({types}) then {BAD_TYPE} {blocked} when not ({need}) then {_text(lacking)} end"
    return f"when claim <> '' and type = '{kind}' then {{'f': {failure}, 's': {strong}, 'c': {candidate}}}"


DESCRIBED = f"({_says('q', 'statement')} or {_says('q', 'action')})"
JUDGED = f"""
    f as (select doc_id as evidence_id, 'S' || doc_id % 7 as session_id, ({_list(QUOTES)})[doc_id % {len(QUOTES)} + 1] as q, case when doc_id % 3 = 0 and lang = 'en' then text else '' end as cx, ({_list(CLAIMS)})[(doc_id // {len(QUOTES)}) % {len(CLAIMS)} + 1] as claim,
          case when doc_id % 17 = 0 then 'listed as related work' else '' end as reasoning, doc_id % 13 = 0 as mismatch, doc_id % 11 = 0 as inherited, doc_id % 2 = 0 as included, doc_id % 5 = 0 as named, doc_id % 10 <> 0 as satisfied from documents),
    t as (select * from (values {", ".join(f"({i}, {_text(kind)}, {_text(name)}, {_text(goal)}, {str(own).lower()}, {_list(aspects)}, {_list(pos)}, {_list(neg)}, {_list(req)}, {mc}, {mw})" for i, kind, name, goal, own, aspects, pos, neg, req, mc, mw in TEMPLATES)}) as v(template_id, type, name, goal, own, aspects, pos, neg, req, min_chars, min_words)),
    x0 as (select *, q || ' ' || cx as both_, {BARE} as bare, lower(q) as low, {ALLOWED} as allowed, named and satisfied and template_id in (21, 3) as by_model,
          contains(q, '[5]') or contains(lower(q), 'small widget') as anchored from f, t),
    x1 as (select *, bare = '' or bare = 'small widget a study' or (contains(bare, 'small widget a study') and len(string_split(bare, ' ')) <= 7) or {_says('q', 'reference_only')} as title_only,
          contains(lower(q || ' ' || reasoning || '  ' || claim), 'related work') or contains(lower(q || ' ' || reasoning || '  ' || claim), 'listed') or contains(lower(q || ' ' || reasoning || '  ' || claim), 'ordinary reference') as mention,
          len(list_distinct(regexp_extract_all(array_to_string(regexp_extract_all(q, '\\[[^\\]]+\\]'), ' '), '\\d+'))) > 1 and contains(q, '[5') as grouped_ from x0),
    x2 as (select *, case when trim(q) = '' then 'no citation_text body evidence' when mismatch then 'reference mismatch' when title_only then 'title-only or reference-only evidence does not satisfy the template'
          when {KNOWN} and not anchored and not inherited then 'citation_text does not anchor to target paper' end as guard from x1),
    x3 as (select *, list_filter({_list(V.FIRST)}, lambda w: contains(trim(regexp_replace(low, '\\s+', ' ', 'g')), w)) as first_terms,
          list_filter([instr(q, '[5]') - 1, instr(low, 'small widget') - 1, instr(low, 'small widget: a study') - 1], lambda p: p >= 0) as places,
          {PLAIN.format("q || ' ' || case when cx = '' then q else cx end")} as words from x2),
    x4 as (select *, list_filter(pos, lambda w: contains(words, w)) as has_pos, list_filter(req, lambda w: contains(words, w)) as has_req, list_filter(neg, lambda w: contains(words, w)) as has_neg,
          list_filter(['tool', 'heat'], lambda k: len(list_filter(list_concat(pos, req), lambda w: contains(k, w) or contains(w, k))) > 0) as has_key,
          not own and claim <> '' and list_contains(allowed, claim) as typed,
          len(list_filter(list_filter(list_transform(first_terms, lambda w: instr(low, trim(w)) - 1), lambda p: p >= 0), lambda a: len(list_filter(places, lambda b: abs(a - b) <= {V.FIRST_REACH} and not regexp_matches(substring(low, least(a, b) + 1, abs(a - b)), '{"|".join(V.PARTING)}'))) > 0)) > 0 as near from x3),
    x5 as (select *, case when trim(q) = '' then 'no citation_text body evidence' when mismatch then 'reference mismatch' when title_only then 'title-only or reference-only evidence does not satisfy the template'
          when ({KNOWN} or own) and not anchored then 'citation_text does not anchor to target paper' when min_chars > 0 and length(q) < min_chars then 'citation_text shorter than min_citation_chars=' || min_chars
          when min_words > 0 and len(string_split(trim(q), ' ')) < min_words then 'citation_text shorter than min_citation_words=' || min_words when len(has_neg) > 0 then 'matched exclusion terms: ' || array_to_string(has_neg, ', ')
          when own and len(req) > 0 and len(has_req) = 0 then 'no required evidence pattern matched' when len(allowed) > 0 and claim <> '' and not list_contains(allowed, claim) then {BAD_TYPE}
          when mention and not {_says('q', 'action')} then 'plain related work without a substantive target-specific claim'
          when not (by_model or typed or len(has_req) > 0 or len(list_filter(has_pos, lambda w: contains(w, ' ') or length(w) >= 8)) > 0) then 'no substantive configured concept matched in body evidence' end as own_f from x4),
    x6 as (select *, case
      when type like 'first_or_%' then {{'f': case when guard is not null then guard when len(first_terms) = 0 then 'no explicit first/pioneering expression in body text' when len(places) = 0 then 'first/pioneering expression has no target title or reference marker anchor' when not near then 'explicit first/pioneering expression does not modify the target paper' end, 's': true, 'c': false}}
      {_rule("detailed_comparison", _in(V.COMPARED), _says("both_", "comparison"), "no explicit comparison expression in body text", f"{_says('both_', 'detail')} and (len(list_filter(regexp_split_to_array(regexp_replace(both_, '([.!?])\\s+', '\\1' || chr(1), 'g'), '[\\r\\n\\x01]+'), lambda z: trim(z) <> '')) >= 2 or length(cx) >= 220)", "true")}
      {_rule("baseline_or_benchmark", _in(V.MEASURED), _says("both_", "baseline"), "target paper is not explicitly used as a baseline or benchmark", _says("both_", "evaluation"), "true")}
      {_rule("positive_evaluation", _in(V.PRAISED), f"{_says('both_', 'praise')} or {DESCRIBED}", "no target-specific capability, contribution, effect, or value statement", _says("both_", "praise"), DESCRIBED, f"when {_says('both_', 'spoiled')} then 'limitation feedback cannot satisfy positive evaluation'")}
      {_rule("limitation_or_negative", _in(V.CONTRACTS["limitation_or_negative"]), f"{_says('q', 'limitation')} or {_says('cx', 'limitation')}", "no explicit target-specific limitation or negative evaluation", _says("q", "limitation"), "true")}
      {_rule("theoretical_foundation", _in(V.CONTRACTS["theoretical_foundation"]), _says("both_", "theory"), "no target-specific model, theory, equation, mechanism, or derivation statement", _says("both_", "theory_use"), "true")}
      {_rule("method_foundation", _in(V.CONTRACTS["method_foundation"]), DESCRIBED, "no concrete target-specific method description", f"{_says('both_', 'method_use')} and claim <> 'method_summary'", "true")}
      {_rule("method_or_capability_summary", _in(V.CONTRACTS["method_or_capability_summary"]), _says("both_", "statement"), "no concrete method, mechanism, capability, or contribution statement", "true", "false", f"when mention and not {_says('both_', 'action')} then 'plain related work without a substantive target-specific claim'")}
      when claim <> '' and type = 'tone' then {{'f': case when mismatch then 'reference mismatch' when not anchored and not inherited then 'citation_text does not anchor to target paper' when title_only then 'title-only or reference-only evidence does not satisfy the template'
        when {_says('q', 'not_neutral')} then 'explicit positive evaluation is not neutral evidence' when {_says('q', 'negative')} then 'limitation or negative evaluation is not neutral evidence' when not {_in(V.NEUTRAL)} then 'evidence type ' || claim || ' is not neutral evidence' end, 's': {DESCRIBED} and claim <> 'ordinary_reference', 'c': true}}
      else {{'f': case when own_f is null and grouped_ and not by_model then 'grouped citation attribution awaits model judgment' else own_f end, 's': own_f is null and not (grouped_ and not by_model), 'c': false}} end as v from x5),
    x7 as (select *, type not like 'first_or_%' and (claim = '' or type in ('custom', 'focus')) as own_rule, (by_model or typed or len(has_req) > 0 or len(has_pos) >= 2 or len(has_key) >= 2) and not regexp_matches(coalesce(own_f, ''), '^(no citation_text|reference mismatch|title-only|citation_text does not anchor|citation_text shorter|matched exclusion terms|plain related work)') as support from x6),
    x8 as (select *, case when own_rule then case when v.f is null then 'strong' when (own_f is null and grouped_ and not by_model) or support then 'candidate' else 'none' end when v.f is not null then 'none' when v.s then 'strong' when v.c then 'candidate' else 'none' end as raw from x7),
    judged as (select *, case when raw = 'strong' and grouped_ and not (by_model or (included and case type {" ".join(f"when {_text(k)} then {_in(v)}" for k, v in V.ATTRIBUTED.items())} else false end)) then 'candidate' else raw end as level,
          case when own_rule then case when raw = 'none' then coalesce(v.f, '') else '' end when type = 'tone' and v.f is null and not {DESCRIBED} then 'neutral mention lacks a substantive target-specific description' else coalesce(v.f, '') end as failure from x8)"""


def _evaluated(s: Source):
    return V.evaluations(findings(s), templates(s))


def _of(*kinds: str):
    quoted = ", ".join(map(_text, kinds))
    return (
        lambda s: V.evaluations(findings(s), templates(s).where(c("template_type").isin(*kinds))).select("evidence_id", "template_id", "level", "failure"),
        f"with {JUDGED} select evidence_id, template_id, level, failure from judged where type in ({quoted})",
    )


def _items(s: Source):
    return s.fx_edge.join(s.fx_citing.select(c("publication_id").alias("k"), c("title").alias("citing_title"), "venue", "author"), c("citing_id") == c("k")).join(s.fx_cited.select(c("publication_id").alias("p"), c("title").alias("cited_title")), c("cited_id") == c("p"))


def _reapplied(s: Source):
    own = findings(s).withColumn("old_level", F.when(c("evidence_id") % 4 == 0, "strong").otherwise("none"))
    cards = s.documents.where("doc_id % 2 = 0").select((c("doc_id") * 10).alias("card_id"), c("doc_id").alias("card_evidence"))
    return V.reapplied(own, templates(s), cards)[1]


#: Model's findings in states that open or bar each way to a recommendation, by remainders of the id.
def _direct(s: Source):
    k = c("doc_id")
    return s.documents.select(
        k.alias("evidence_id"), (k % 50).alias("item_id"), (k % 50 * 10 + F.floor(k / 50) % 3).alias("result_id"), F.concat(F.lit("S"), (k % 50 % 7).cast("string")).alias("session_id"), _pick(["include", "review", "exclude"], k).alias("recommendation"),
        _pick(["positive_evaluation", "limitation_feedback", "method_use", "false_positive"], F.floor(k / 3)).alias("claim_type"), _pick(["", "Mixed", "unknown"], F.floor(k / 12)).alias("stance"),
        F.when(k % 7 == 3, "unresolved").otherwise("verified").alias("grounding_status"), F.when(k % 7 == 3, "unresolved").when(k % 7 == 5, "mismatch").otherwise("matched").alias("reference_match_status"), (k % 19 == 0).alias("attribution_conflict"),
        F.when(k % 23 == 0, "missing").otherwise("direct_marker").alias("target_anchor_status"), F.when(k % 29 == 0, "reference_only").otherwise("").alias("notes"),
    )


def _named(s: Source):
    k = c("doc_id")
    one = s.documents.where("doc_id % 4 <> 0").select(k.alias("evidence_id"), _pick(["6", "5", "20"], F.floor(k / 4)).cast("int").alias("template_id"), F.when(k % 4 == 1, "strong").otherwise("candidate").alias("level"))
    return one.unionByName(s.documents.where("doc_id % 8 = 1").select(k.alias("evidence_id"), F.lit(99).alias("template_id"), F.lit("strong").alias("level")))


DECIDED = """
    e as (select doc_id as k, doc_id % 50 as item_id, doc_id % 50 * 10 + (doc_id // 50) % 3 as result_id, 'S' || doc_id % 50 % 7 as session_id, ['include', 'review', 'exclude'][doc_id % 3 + 1] as rec, ['positive_evaluation', 'limitation_feedback', 'method_use', 'false_positive'][(doc_id // 3) % 4 + 1] as claim,
          ['', 'mixed', 'unknown'][(doc_id // 12) % 3 + 1] as st, case when doc_id % 7 = 3 then 'unresolved' when doc_id % 7 = 5 then 'mismatch' else 'matched' end as status,
          doc_id % 7 in (3, 5) or doc_id % 19 = 0 or doc_id % 23 = 0 or doc_id % 29 = 0 or (doc_id // 3) % 4 = 3 as barred, doc_id % 4 <> 0 as said, doc_id % 4 = 1 as strong, [6, 5, 20][(doc_id // 4) % 3 + 1] as t from documents),
    d0 as (select *, case when said and barred then case when status = 'unresolved' then 'review' else 'exclude' end when said and strong then 'include' when said then 'review' else rec end as r1 from e),
    d as (select k as evidence_id, item_id, result_id, session_id, case when r1 = 'include' and not (said and strong) then 'review' else r1 end as final_recommendation, claim as claim_type,
          case when claim = 'limitation_feedback' then 'negative' when st = 'mixed' then 'mixed' when said and strong and t = 6 then 'negative' when said and strong and t = 5 then 'positive' when said and strong and t = 20 then 'neutral' when claim = 'positive_evaluation' then 'positive' else 'neutral' end as stance,
          case when said and strong and not barred then 'strong' when said then 'candidate' else 'none' end as level, case when said then [t] else []::int[] end as template_ids from d0)"""
LATEST = "l as (select item_id, max(result_id) as result_id from e where result_id % 10 <> 2 or item_id % 2 = 0 group by 1)"


def _results(s: Source):
    return s.documents.select((c("doc_id") % 50).alias("item_id"), (c("doc_id") % 50 * 10 + F.floor(c("doc_id") / 50) % 3).alias("result_id")).distinct().select("result_id", "item_id", F.concat(F.lit("S"), (c("item_id") % 7).cast("string")).alias("session_id"), F.when((c("result_id") % 10 == 2) & (c("item_id") % 2 == 1), "failed").otherwise("success").alias("status"), c("result_id").alias("created_at"))


#: Cases of the check against a reference list: what a quote cites, and what its entry says.
CHECKED = [
    ("Lee [5] shows heat.", "", "include", "[5] J. Lee, A. Kim. Small widget: a study. Journal of Tests, 2001."),
    ("Kim [5] shows heat.", "", "include", "[5] J. Lee, A. Kim. Small widget: a study. Journal of Tests, 2001."),
    ("Lee [7] shows heat.", "", "include", "[7] A. Other. Different things. 1999."),
    ("It shows heat.", "", "include", "[5] J. Lee, A. Kim. Small widget: a study. Journal of Tests, 2001."),
    ("A Heat-Box is warm.", "As is known, in [5] a tool called Heat-Box was shown. A Heat-Box is warm.", "include", "[5] J. Lee, A. Kim. Small widget: a study. Journal of Tests, 2001."),
    ("Lee [5] shows heat.", "", "include", "[5] Q. Zed, On quite another matter. 1987."),
    ("Lee [5, 6] show heat.", "", "exclude", "[5] J. Lee, A. Kim. Small widget: a study. Journal of Tests, 2001."),
    ("[5] J. Lee. Small widget. Journal of Tests, vol. 3, 2001.", "", "include", "[5] J. Lee, A. Kim. Small widget: a study. Journal of Tests, 2001."),
    ("Lee [5] shows heat.", "", "include", ""),
]
CHECKED_CLAIMS = ["method_summary", "ordinary_reference", "positive_evaluation"]
#: What the rules decide for each case, by hand: recommendation (for method_summary, ordinary_reference, positive_evaluation), claim kept, status, anchor, conflict, grouped, grounding.
CHECK_ANSWERS = [
    (["include", "review", "include"], True, "matched", "direct_marker", False, False, "verified"),
    (["review", "review", "review"], True, "matched", "direct_marker", True, False, "attribution_conflict"),
    (["exclude"] * 3, False, "mismatch", "missing", False, False, "mismatch"),
    (["exclude"] * 3, False, "matched", "missing", False, False, "mismatch"),
    (["include", "review", "include"], True, "matched", "inherited_named_method", False, False, "verified"),
    (["exclude"] * 3, False, "mismatch", "direct_marker", True, False, "attribution_conflict"),
    (["review", "exclude", "exclude"], True, "matched", "direct_marker", False, True, "verified"),
    (["exclude"] * 3, False, "matched", "direct_marker", False, False, "mismatch"),
    (["review"] * 3, True, "unresolved", "direct_marker", False, False, "unresolved"),
]


def _checked(s: Source):
    k = c("doc_id")
    case = F.element_at(F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(("q", "cx", "rec", "entry"), row, strict=True))) for row in CHECKED)), (k % len(CHECKED) + 1).cast("int"))
    rows = s.documents.select(k, "text", case.alias("w"))
    e = rows.select(
        k.alias("evidence_id"), k.alias("item_id"), c("w.q").alias("citation_text"), F.when(c("w.cx") != "", F.concat(c("w.cx"), F.lit("\n\n"), "text")).otherwise("").alias("context"), c("w.rec").alias("recommendation"), _pick(CHECKED_CLAIMS, F.floor(k / len(CHECKED))).alias("claim_type"),
        F.lit("").alias("semantic_relation"), F.lit("5").alias("marker"), F.lit(TITLE).alias("title"), F.lit("").alias("doi"), F.lit("").alias("own_entry"), F.array(F.lit("J. Lee")).alias("authors"), F.lit(2001).alias("year"), F.lit(False).alias("resolved"),
    )
    entries = rows.where("w.entry <> ''").select(k.alias("item_id"), F.regexp_extract("w.entry", r"^\[(\d+)\]", 1).alias("marker"), c("w.entry").alias("entry"))
    return D.normalised(e, entries).select("evidence_id", "final_recommendation", (c("final_claim_type") != "false_positive").alias("kept"), "reference_match_status", "target_anchor_status", "attribution_conflict", "grouped", "grounding_status")


def _answers() -> str:
    rows = [f"({i}, {j}, {_text(a[0][j])}, {str(a[1]).lower()}, {_text(a[2])}, {_text(a[3])}, {str(a[4]).lower()}, {str(a[5]).lower()}, {_text(a[6])})" for i, a in enumerate(CHECK_ANSWERS) for j in range(3)]
    names = "i, j, final_recommendation, kept, reference_match_status, target_anchor_status, attribution_conflict, grouped, grounding_status"
    return f"select doc_id as evidence_id, {names.split(', ', 2)[2]} from documents join (values {', '.join(rows)}) as v({names}) on i = doc_id % {len(CHECKED)} and j = (doc_id // {len(CHECKED)}) % 3"


def _match_texts(s: Source):
    return Q.template_match_text(_items(s).select("session_id", "cited_id", "citing_id", "citing_title", "cited_title", "venue", F.array("author").alias("authors"), F.array(F.concat(F.lit("as in "), "author")).alias("contexts"), F.lit("target").alias("target_title")))


def _persisted(s: Source):
    items = _match_texts(s).select("session_id", F.concat_ws("-", "cited_id", "citing_id").alias("owner_id"), "text")
    evidence = evidence_texts(s).select("session_id", c("evidence_id").cast("string").alias("owner_id"), "text")
    log = template_log(items.select("session_id", "text").unionByName(evidence.select("session_id", "text")))
    return T.persisted_matches(items, evidence, T.session_templates(T.builtin_templates(s.spark), log)).select("owner", "owner_id", "template_id", F.array_join("matched_terms", "|").alias("terms"), "match_score")


MATCH_TEXT = "i.title || ' ' || d.title || ' ' || coalesce(venue, '') || ' ' || author || ' as in ' || author || ' target'"

PLANS = {
    "r4_match_text": (
        _match_texts,
        f"select d.session_id, cited_id, citing_id, {MATCH_TEXT} as text from fx_edge join fx_citing i on citing_id = i.publication_id join fx_cited d on cited_id = d.publication_id",
    ),
    "r6_template_matches": (
        _persisted,
        f"with tx as (select d.session_id, 'item ' || cited_id || '-' || citing_id as key, {MATCH_TEXT} as text from fx_edge join fx_citing i on citing_id = i.publication_id join fx_cited d on cited_id = d.publication_id union all select session_id, 'evidence ' || evidence_id, {EVIDENCE_TEXT} from fx_evidence), {MATCHED} select split_part(key, ' ', 1) as owner, split_part(key, ' ', 2) as owner_id, template_id, terms, match_score from tm",
    ),
    "r7_effective_rules": (
        lambda s: V.effective_rules(templates(s)).select("session_id", "template_id", F.array_join("allowed_types", ",").alias("allowed"), "require_marker"),
        "select session_id, template_id, array_to_string(" + ALLOWED + f", ',') as allowed, {KNOWN} as require_marker from (select distinct session_id from fx_evidence), (values " + ", ".join(f"({x[0]}, {_text(x[1])}, {str(x[4]).lower()}, {_list(x[5])})" for x in TEMPLATES) + ") as v(template_id, type, own, aspects)",
    ),
    "r8_strict_guard": (
        lambda s: V.prepared(findings(s)).withColumn("require_marker", c("evidence_id") % 2 == 0).select("evidence_id", F.coalesce(V.guard(), F.lit("")).alias("reason")),
        f"with {JUDGED} select evidence_id, case when guard = 'citation_text does not anchor to target paper' and evidence_id % 2 = 1 then '' else coalesce(guard, '') end as reason from judged where template_id = 1",
    ),
    "r9_first_claims": _of("first_or_pioneering_claim", "first_or_seminal_claim"),
    "r10_comparisons": _of("detailed_comparison"),
    "r11_baselines": _of("baseline_or_benchmark"),
    "r12_positive_evaluations": _of("positive_evaluation"),
    "r13_limitations": _of("limitation_or_negative"),
    "r14_theoretical_foundations": _of("theoretical_foundation"),
    "r15_method_foundations": _of("method_foundation"),
    "r16_capability_summaries": _of("method_or_capability_summary"),
    "r17_neutral_attitudes": _of("tone"),
    "r18_configured_templates": _of("custom", "focus"),
    "r19_template_verdicts": (
        lambda s: V.together(_evaluated(s), s.spark.createDataFrame([(x[0], x[2]) for x in TEMPLATES], "template_id int, name string")).select("evidence_id", "template_match_level", F.array_join(c("template_ids").cast("array<string>"), ",").alias("ids"), F.array_join(c("strong_ids").cast("array<string>"), ",").alias("strong"), "failures"),
        f"with {JUDGED} select evidence_id, case when bool_or(level = 'strong') then 'strong' when bool_or(level = 'candidate') then 'candidate' else 'none' end as template_match_level, coalesce(string_agg(cast(template_id as varchar), ',' order by template_id) filter (level <> 'none'), '') as ids, coalesce(string_agg(cast(template_id as varchar), ',' order by template_id) filter (level = 'strong'), '') as strong, coalesce(string_agg(name || ': ' || failure, '; ' order by template_id) filter (level = 'none'), '') as failures from judged group by 1",
    ),
    "r20_reapplied_templates": (
        _reapplied,
        f"with {JUDGED}, m as (select evidence_id, session_id, case when bool_or(level = 'strong') then 'strong' when bool_or(level = 'candidate') then 'candidate' else 'none' end as l from judged group by 1, 2) select session_id, count(*) as findings, count(*) filter (l <> 'none') as matched, count(*) filter (l = 'strong') as strong, count(*) filter (l <> case when evidence_id % 4 = 0 then 'strong' else 'none' end) as changed, count(*) filter (l <> 'none' and evidence_id % 2 = 0) as cards from m group by 1",
    ),
    "r21_template_decisions": (
        lambda s: D.decided(_direct(s), _named(s), templates(s)).select("evidence_id", "final_recommendation", "claim_type", "stance", c("template_match_level").alias("level"), F.array_join(c("template_ids").cast("array<string>"), ",").alias("ids")),
        f"with {DECIDED} select evidence_id, final_recommendation, claim_type, stance, level, array_to_string(template_ids, ',') as ids from d",
    ),
    "r26_background_upgrades": (
        lambda s: findings(s).select("evidence_id", D.background_upgrade(c("citation_text"), c("reasoning")).alias("kind"), D.is_representative(F.lit("background"), F.when(c("evidence_id") % 2 == 0, "related_work").otherwise("direct"), c("citation_text"), c("reasoning"), F.contains("citation_text", F.lit("[5]"))).alias("representative"), D.is_grouped_for_review(c("claim_type"), F.when(c("evidence_id") % 3 == 0, "grouped_citation").otherwise(""), c("citation_text"), ("method_use", "detailed_comparison")).alias("grouped")),
        f"with f as (select doc_id, ({_list(QUOTES)})[doc_id % {len(QUOTES)} + 1] as q, ({_list(CLAIMS)})[(doc_id // {len(QUOTES)}) % {len(CLAIMS)} + 1] as claim, case when doc_id % 17 = 0 then 'listed as related work' else '' end as r from documents), k as (select *, lower(q || ' ' || r) as t from f) select doc_id as evidence_id, case when regexp_matches(t, 'limitation|drawback|negative') then 'limitation_or_negative' when regexp_matches(t, 'compared with|compare|baseline|benchmark') then 'detailed_comparison' when regexp_matches(t, 'method|approach|model') then 'representative_work' end as kind, contains(q, '[5]') and doc_id % 2 = 0 and doc_id % 17 = 0 as representative, doc_id % 3 = 0 and claim in ('method_use', 'detailed_comparison') and q <> '' as grouped from k",
    ),
    "r28_normalised_evidence": (_checked, _answers()),
    "l5_rejudged_evidence": (
        lambda s: D.rejudged(_results(s), _direct(s), _named(s), templates(s), s.documents.select(c("doc_id").alias("evidence_id"), (c("doc_id") % 50 * 10 + F.floor(c("doc_id") / 50) % 3).alias("result_id"), F.when(c("doc_id") % 6 == 0, "accepted").otherwise("unreviewed").alias("review_status")))[2],
        f"with {DECIDED}, {LATEST} select evidence_id, case when final_recommendation = 'include' then 'keep' when evidence_id % 6 = 0 then 'demote' else 'delete' end as action from d join l using (item_id, result_id)",
    ),
    "l5_rejudged_counts": (
        lambda s: D.rejudged(_results(s), _direct(s), _named(s), templates(s), s.documents.select(c("doc_id").alias("evidence_id"), F.lit(0).alias("result_id"), F.lit("").alias("review_status")))[1],
        f"with {DECIDED}, {LATEST} select session_id, count(distinct item_id) as results, count(*) as evidence, count(*) filter (final_recommendation = 'include') as include, count(*) filter (final_recommendation = 'review') as review, count(*) filter (final_recommendation = 'exclude') as exclude from d join l using (item_id, result_id) group by 1",
    ),
    "x21_inherited_anchors": (
        lambda s: X.inheritances(s.documents.select(c("doc_id").alias("evidence_id"), _pick(["A Heat-Box is warm.", "It cools [4].", "A Heat-Box is warm.", "Nowhere.", "It is warm.", "A Heat-Box is warm."], c("doc_id")).alias("quote"), F.concat(_pick(["In [5] a tool called Heat-Box was shown. ", "In [5] a tool called Heat-Box was shown. ", "In [5] a tool called Heat-Box was shown.\n\n", "In [5] a tool called Heat-Box was shown. ", "Heat-Box [5] was shown. ", "In [5] Heat-Box was proposed, as in [6]. "], c("doc_id")), _pick(["A Heat-Box is warm.", "It cools [4].", "A Heat-Box is warm.", "Else.", "It is warm.", "A Heat-Box is warm."], c("doc_id")), F.lit("\n"), "text").alias("context"), F.lit("5").alias("marker"))),
        "select doc_id as evidence_id, doc_id % 6 = 0 as inherited, ['same_paragraph_named_method:Heat-Box', 'quote_contains_other_reference_marker', 'target_marker_in_different_paragraph', case when contains(text, 'Nowhere.') then 'no_unique_named_method_link' else 'quote_not_located_in_context' end, 'no_unique_named_method_link', 'other_reference_marker_between_anchor_and_quote'][doc_id % 6 + 1] as reason from documents",
    ),
}
