"""Cards, reports and inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.operators import answers as W
from citeloom.operators import cards as C
from citeloom.operators import claims as M
from citeloom.operators import evidence as E
from citeloom.operators import inference as L

from .evidence_plans import KINDS, PLAIN, SCORED, scored
from .fixtures import Source

c = F.col


def _items(s: Source):
    return s.fx_evidence.select("item_id").distinct().select("item_id", F.concat(F.lit("Citing "), "item_id").alias("citing_title"), F.concat(F.lit("Cited "), "item_id").alias("cited_title"))


def _single(s: Source):
    """Each piece of evidence as an item of its own."""
    k = c("evidence_id")
    return s.fx_evidence.select(k.alias("item_id"), F.concat(F.lit("Citing "), k).alias("citing_title"), F.concat(F.lit("Cited "), k).alias("cited_title"))


def cards(s: Source):
    return C.cards(E.eligible(scored(s)), _items(s))


TYPE = "case when stance in ('negative', 'mixed') and evidence_type not in ('detailed_comparison', 'baseline_or_benchmark') then 'limitation_or_negative' when evidence_type in ('detailed_comparison', 'baseline_or_benchmark', 'method_foundation') then evidence_type else 'positive_evaluation' end"
CARDS = f"""{SCORED}, ca as (select session_id, evidence_id, item_id, {TYPE} as card_type, strength, review_status, citation_text, score, strength in ('strong', 'moderate') and self_citation_status <> 'self_citation' as include_in_report,
      row_number() over (partition by session_id order by review_status = 'important' desc, review_status = 'accepted' desc, round(score, 9) desc, evidence_id) as sort_order from sc where trim(citation_text) <> '' and review_status not in ('rejected', 'false_positive'))"""
SECTION = "case card_type when 'positive_evaluation' then 'evaluative' when 'detailed_comparison' then 'precision' when 'baseline_or_benchmark' then 'precision' when 'method_foundation' then 'method_summary' when 'limitation_or_negative' then 'limitation' else 'review' end"
NUMBER = "case section when 'evaluative' then 1 when 'precision' then 2 when 'method_summary' then 3 when 'capability' then 4 when 'review' then 5 else 6 end"


def _answers(s: Source):
    k = c("conv_id") * 100 + c("turn")
    body = F.concat(F.lit('{"evidence_type": "'), "role", F.lit('", "stance": "neutral", "keep": true, "confidence": 0.5}'))
    text = F.when(k % 3 == 0, body).when(k % 3 == 1, F.concat(F.lit("<think>x {\"a\": 1}</think>\n```json\n"), body, F.lit("\n```"))).when(k % 6 == 2, F.concat(F.lit("Sure: "), body, F.lit(" done"))).otherwise("no answer")
    return s.conversations.select(k.alias("item_id"), text.alias("response"))


def _responses(s: Source):
    """Answers that quote a turn's whole text, in ten shapes: plain, a list, fenced, behind thoughts, other names, a wrong second finding, an escaped apostrophe, none, no JSON, empty."""
    k = c("conv_id") * 100 + c("turn")
    own = lambda quote, stance="neutral", names=("evidence_type", "reasoning", "citation_text"): F.struct(F.lit("background").alias(names[0]), F.lit(stance).alias("stance"), c("role").alias("mention_type"), F.concat(F.lit("turn "), c("turn")).alias(names[1]), quote.alias(names[2]))
    listed = lambda name, *rows: F.to_json(F.struct(F.array(*rows).alias(name)))
    one = listed("findings", own(c("text")))
    shapes = (
        listed("findings", own(c("text")), own(F.upper("role"), "mixed")), F.to_json(F.array(own(c("text")))), F.concat(F.lit("Here:\n```json\n"), one, F.lit("\n```\nThat is all.")),
        F.concat(F.lit('<think>{"findings": []}</think> So {x}: '), one, F.lit(" and nothing else")), listed("evidence", own(c("text"), names=("aspect", "reason", "quote"))), listed("findings", own(c("text")), own(c("text"), "odd")),
        F.replace(listed("findings", own(F.concat(F.lit("it's "), c("text")))), F.lit("'"), F.lit("\\'")), F.lit(" No  evidence found\n"), c("text"), F.lit('{"findings": []}'),
    )
    return s.conversations.select(k.alias("item_id"), F.get(F.array(*shapes), (k % 10).cast("int")).alias("response"))


#: Cards of all eligible evidence with what was said about them around their texts, and what templates made of them.
SAID = f"""
    select evidence_id, citation_text as evidence_quote, card_type, stance, mention_type, strength,
           case evidence_id % 7 when 0 then 'RFID tag vibration sensing method' when 1 then 'Sub mm and through-wall' when 2 then 'in related work' when 3 then 'A Simple Graph model' when 4 then 'as the pioneering one' else '' end as context,
           case evidence_id % 5 when 0 then 'RFID sub–mm' when 1 then 'a first claim' when 2 then '亚毫米' when 3 then 'own words' end as template_reason, case when evidence_id % 11 = 0 then 'Submillimeter, but limited' else '' end as template_failure,
           case when evidence_id % 6 <> 0 then evidence_id % 4 <> 0 end as template_satisfied, case when evidence_id % 13 = 0 then 'invalid' else 'valid' end as anchor_status
    from (select *, {{type}} as card_type from {{rows}}) x"""


def _said(s: Source):
    return s.spark.sql(SAID.format(type=TYPE, rows="{e}"), e=E.eligible(scored(s)))


def _has(text: str, words) -> str:
    return f"regexp_matches({text}, '{'|'.join(words)}')"


def _when(of: dict, i: int) -> str:
    return "case kind " + " ".join(f"when '{k}' then '{v[i]}'" for k, v in of.items()) + " end"


FORM = r"trim(regexp_replace(lower(translate({0}, '–—', '--')), '\s+', ' ', 'g'))"
CLAIMED = f"""
    with {SCORED}, i as ({SAID.format(type=TYPE, rows="sc where trim(citation_text) <> '' and review_status not in ('rejected', 'false_positive')")}),
    n as (select *, {FORM.format('evidence_quote')} as q, {FORM.format("coalesce(template_reason, '') || ' ' || template_failure")} as rs, {FORM.format("coalesce(template_reason, '')")} as r1, coalesce(template_satisfied, false) as ok, evidence_quote || ' ' || context as said,
      stance in ('negative', 'mixed') or card_type = 'limitation_or_negative' as neg, mention_type = 'grouped_citation' as gr from i),
    h as (select *, {FORM.format('said')} || ' ' || rs as al from n),
    k as (select *, case when anchor_status = 'invalid' then 'invalid_anchor' when {_has('rs', M.PRECISION)} then case when neg or {_has('al', M.LIMITS)} then 'limitation' when not ok then case when {_has('al', M.RELATED)} then 'plain_related' else 'mismatch' end
      {' '.join(f"when {_has('al', w)} then '{k}'" for k, w in M.ABILITIES)} else 'plain_related' end when {_has('q', M.FIRST)} then case when ok and {_has('r1', M.FIRST)} then 'first_satisfied' else 'first_scope_unclear' end when neg then 'negative' else 'typed' end as kind from h),
    p as (select evidence_id, x, row_number() over (partition by evidence_id, lower(x) order by pi, xi) as copy, pi, xi from (select evidence_id, pi, unnest(xs) as x, generate_subscripts(xs, 1) as xi from (
      {' union all '.join(f"select evidence_id, {i} as pi, regexp_extract_all(said, '{p.replace(chr(39), chr(39) * 2)}', 0, 'i') as xs from n" for i, p in enumerate(M.PHRASES))}))),
    f as (select evidence_id, string_agg(x, '|' order by pi, xi) filter (place <= 8) as phrases from (select *, row_number() over (partition by evidence_id order by pi, xi) as place from p where copy = 1) group by 1)
    select evidence_id, kind as claim_kind, coalesce({_when(M.KINDS, 0)}, case when kind = 'negative' then '{M.NEGATIVE_LABEL}' end, case card_type {' '.join(f"when '{a}' then '{b}'" for a, b in M.LABELS.items())} else replace(card_type, '_', ' ') end) as label,
      coalesce({_when(M.KINDS, 1)}, case when kind = 'typed' and strength in ('strong', 'moderate') and not gr then '{M.INCLUDE}' else '{M.REVIEW}' end) as recommendation, coalesce({_when(M.KINDS, 2)}, case when kind = 'typed' and strength in ('strong', 'moderate') and not gr then 'high' else 'medium' end) as confidence,
      coalesce(phrases, '') as phrases, array_to_string(list_filter([case when kind = 'invalid_anchor' then 'anchor' end, case when gr and kind not in ('invalid_anchor', 'first_satisfied', 'first_scope_unclear') then 'grouped' end,
        case when not gr and kind in ('through_wall', 'limitation', 'plain_related', 'mismatch') then 'candidate' end, case when kind in ('first_satisfied', 'first_scope_unclear') then 'scope' end, case when kind = 'negative' then 'negative' end], lambda z: z is not null), '|') as risks
    from k left join f using (evidence_id)"""


PLANS = {
    "c1_card_types": (lambda s: s.fx_evidence.select("evidence_id", C.card_type(c("evidence_type"), c("stance")).alias("card_type")), f"select evidence_id, {TYPE} as card_type from fx_evidence"),
    "c2_cards": (lambda s: cards(s).select("evidence_id", "card_type", "include_in_report", "sort_order"), f"with {CARDS} select evidence_id, card_type, include_in_report, sort_order from ca"),
    "c3_card_type_override": (
        lambda s: C.cards(E.eligible(scored(s)), _items(s), s.fx_evidence.where("evidence_id % 3 = 0").select("evidence_id", F.explode(F.array(F.struct(F.lit("custom").alias("template_type"), F.lit(10.0).alias("match_score"), F.lit(1).alias("template_id")), F.struct(F.when(c("evidence_id") % 2 == 0, "method_foundation").otherwise("custom").alias("template_type"), F.lit(20.0).alias("match_score"), F.lit(2).alias("template_id")))).alias("m")).select("evidence_id", "m.*")).select("evidence_id", "card_type"),
        f"with {CARDS} select evidence_id, case when evidence_id % 6 = 0 then 'method_foundation' else card_type end as card_type from ca",
    ),
    "c5_anchor_invalid": (
        lambda s: C.without_invalid(scored(s).withColumn("anchor_status", F.when(c("evidence_id") % 4 == 0, "invalid").otherwise("valid"))).groupBy("review_status", "strength").agg(F.count(F.lit(1)).alias("n")),
        f"with {SCORED} select case when evidence_id % 4 = 0 then 'false_positive' else review_status end as review_status, case when evidence_id % 4 = 0 then 'none' else strength end as strength, count(*) as n from sc group by 1, 2",
    ),
    "c6_claims": (lambda s: M.interpreted(_said(s)).select("evidence_id", "claim_kind", "label", "recommendation", "confidence", F.array_join("key_phrases", "|").alias("phrases"), F.array_join("risks", "|").alias("risks")), CLAIMED),
    "c7_report_sections": (
        lambda s: C.report_sections(cards(s).where("include_in_report")).select("session_id", "evidence_id", "section", "number"),
        f"with {CARDS}, x as (select *, {SECTION} as section from ca where include_in_report) select session_id, evidence_id, section, row_number() over (partition by session_id order by {NUMBER}, sort_order) as number from x",
    ),
    "c9_conclusions": (
        lambda s: C.conclusions(C.report_sections(cards(s))),
        f"with {CARDS}, x as (select *, {SECTION} as section from ca), n as (select session_id, count(*) filter (section = 'evaluative') as evaluative, count(*) filter (section = 'precision') as precision, count(*) filter (section = 'method_summary') as method_summary, count(*) filter (section = 'capability') as capability, count(*) filter (section = 'review') as review, count(*) filter (section = 'limitation') as limitation from x group by 1) select *, case when evaluative + precision >= 5 then 'strong impact' when evaluative + precision > 0 then 'visible impact' when method_summary + capability > 0 then 'use without evaluation' else 'background only' end as conclusion from n",
    ),
    "c11_review_overlay": (
        lambda s: C.with_latest_review(s.fx_evidence.select("evidence_id", "review_status"), s.events.select((c("event_id") % 1500).alias("evidence_id"), c("event_type").alias("review_status"), "ts", c("event_id").alias("id")), "evidence_id", "review_status"),
        "select evidence_id, coalesce(st, review_status) as review_status from fx_evidence left join (select event_id % 1500 as k, arg_max(event_type, {'a': ts, 'b': event_id}) as st from events group by 1) l on l.k = evidence_id",
    ),
    "c13_review_list": (
        lambda s: scored(s).join(s.fx_asset.select(c("asset_id").alias("a"), "source_type"), c("evidence_id") == c("a"), "left").groupBy("session_id", "item_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("source_type")), ",").alias("sources"), F.round(F.max("score"), 4).alias("best")),
        f"with {SCORED} select session_id, item_id, count(*) as n, array_to_string(list_sort(list_distinct(list(source_type))), ',') as sources, round(max(score), 4) as best from sc left join fx_asset on asset_id = evidence_id group by 1, 2",
    ),
    "p5_card_views": (
        lambda s: cards(s).groupBy("session_id", "card_type").agg(F.count(F.lit(1)).alias("cards"), F.count_if("include_in_report").alias("included")),
        f"with {CARDS} select session_id, card_type, count(*) as cards, count(*) filter (include_in_report) as included from ca group by 1, 2",
    ),
    "p9_reportable_cards": (lambda s: C.reportable(cards(s), s.fx_evidence).select("evidence_id", "card_type"), f"with {CARDS} select evidence_id, card_type from ca where include_in_report"),
    "t6_manual_order": (
        lambda s: C.reordered(cards(s), s.fx_evidence.where("evidence_id % 50 = 0").groupBy("session_id").agg(F.reverse(F.array_sort(F.collect_list("evidence_id"))).alias("ids"))).select("evidence_id", "sort_order"),
        f"with {CARDS}, o as (select evidence_id as id, row_number() over (partition by session_id order by evidence_id desc) as p from fx_evidence where evidence_id % 50 = 0) select evidence_id, coalesce(p, sort_order) as sort_order from ca left join o on id = evidence_id",
    ),
    "u9_distinct_quotes": (
        lambda s: C.distinct_quotes(C.typed(E.eligible(scored(s)), _items(s)).select("item_id", "card_type", "evidence_id", c("citation_text").alias("quote"), "review_status", "score")),
        None,
    ),
    "u15_fallback_rows": (
        lambda s: C.fallback_rows(s.fx_evidence.select("item_id").distinct(), cards(s).where("include_in_report"), E.latest_results(s.fx_result)),
        f"with {CARDS} select item_id, result_id, case when result_id is null then 'no_result' else 'no_card' end as reason from (select distinct item_id from fx_evidence) left join (select item_id, arg_max(result_id, {{'a': created_at, 'b': result_id}}) as result_id from fx_result where status = 'success' group by 1) r using (item_id) where item_id not in (select item_id from ca where include_in_report)",
    ),
    "a13_workspace_stats": (
        lambda s: C.workspace_stats(cards(s)),
        f"with {CARDS} select session_id, count(*) as cards, count(*) filter (include_in_report) as included, count(*) filter (strength = 'strong') as strong, count(*) filter (strength <> 'strong') as ordinary, cast(0 as bigint) as important_author, count(*) filter (review_status = 'unreviewed') as needs_review from ca group by 1",
    ),
    "s11_structured_report": (
        lambda s: C.structured_report(scored(s), cards(s)).select("session_id", "n_evidence", "n_strong", "n_cards", F.size(F.from_json(F.get_json_object("report", "$.cards"), "array<struct<evidence_id:long>>")).alias("in_json")),
        f"with {CARDS}, k as (select session_id, count(*) as n from ca where include_in_report group by 1) select e.*, cast(coalesce(n, 0) as int) as n_cards, cast(n as int) as in_json from (select session_id, count(*) as n_evidence, count(*) filter (strength = 'strong') as n_strong from sc group by 1) e left join k using (session_id)",
    ),
    "l1_prompts": (
        lambda s: L.prompts(_items(s), s.fx_evidence.select("item_id", c("evidence_id").alias("ordinal"), c("citation_text").alias("text"))).select("item_id", F.length("prompt").alias("chars")),
        "select item_id, 13 + 8 + length('Citing ' || item_id) + 8 + length('Cited ' || item_id) + 11 + sum(length(citation_text)) + count(*) - 1 as chars from fx_evidence group by item_id",
    ),
    "l2_default_inference": (
        lambda s: L.infer(L.prompts(_single(s), s.fx_evidence.select(c("evidence_id").alias("item_id"), F.lit(1).alias("ordinal"), c("citation_text").alias("text")))).select("item_id", F.get_json_object("response", "$.evidence_type").alias("kind"), F.get_json_object("response", "$.stance").alias("stance")),
        f"""with k as (select evidence_id as item_id, {PLAIN.format('citation_text')} as q from fx_evidence), n as (select *, {KINDS.format('q')} as kind from k)
            select item_id, coalesce(kind, 'background') as kind, case when regexp_matches(q, 'limitation|negative|fail|weakness') then 'negative' when kind in ('positive_evaluation', 'method_foundation', 'first_or_seminal_claim') then 'positive' else 'neutral' end as stance from n""",
    ),
    "l3_salvaged_answers": (
        lambda s: L.salvaged(_answers(s)).groupBy("status", c("answer.evidence_type").alias("kind")).agg(F.count(F.lit(1)).alias("n")),
        "select case when (conv_id * 100 + turn) % 3 < 2 then 'parsed' when (conv_id * 100 + turn) % 6 = 2 then 'salvaged' else 'quarantined' end as status, case when (conv_id * 100 + turn) % 3 < 2 or (conv_id * 100 + turn) % 6 = 2 then role end as kind, count(*) as n from conversations group by 1, 2",
    ),
    "l3_answer_findings": (
        lambda s: W.answers(_responses(s)).select("item_id", "status", "reason", F.size("findings").alias("n"), F.get("findings", F.lit(0))["citation_text"].alias("quote"), F.get("findings", F.lit(0))["reasoning"].alias("why"), F.array_join(F.transform("findings", lambda x: x["stance"]), ",").alias("stances")),
        """with k as (select conv_id * 100 + turn as i, (conv_id * 100 + turn) % 10 as x, turn, text from conversations)
           select i as item_id, case when x in (2, 3) then 'salvaged' when x in (5, 8) then 'quarantined' when x = 7 then 'no_evidence' else 'parsed' end as status, case x when 5 then 'stance' when 8 then 'no_json' end as reason,
           case when x = 0 then 2 when x in (1, 2, 3, 4, 6) then 1 else 0 end as n, case when x = 6 then 'it''s ' || text when x < 5 then text end as quote, case when x < 5 or x = 6 then 'turn ' || turn end as why,
           case when x = 0 then 'neutral,mixed' when x in (1, 2, 3, 4, 6) then 'neutral' else '' end as stances from k""",
    ),
}
