"""Evidence and templates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from citeloom.functions.names import norm_title_alnum
from citeloom.operators import decisions as D
from citeloom.operators import evidence as E
from citeloom.operators import promotion as P
from citeloom.operators import templates as T
from citeloom.rounds import numbered

from .fixtures import Source

c = F.col
STRONG = "evidence_type in ('detailed_comparison', 'baseline_or_benchmark', 'method_foundation', 'limitation_or_negative')"
RAW = f"""(case when citation_text = '' then 0.0 when mention_type = 'grouped_citation' then 0.25 when mention_type = 'reference_only' then 0.0 when mention_type in ('weak_mention', 'background_mention') then 0.35
      else 0.5 + case when {STRONG} then 0.25 else 0.0 end + case when stance in ('positive', 'mixed') then 0.1 else 0.0 end + case when length(citation_text) >= 80 then 0.05 else 0.0 end end)"""
SCORED = f"""k0 as (select *, cast({RAW} as double) as raw from fx_evidence),
    k1 as (select * exclude (raw), raw, case when self_citation_status = 'self_citation' then greatest(0.0, round(raw - 0.2, 4)) else raw end as score from k0),
    sc as (select *, case when self_citation_status <> 'self_citation' and (citation_text = '' or mention_type = 'reference_only') then 'none' when score >= 0.8 - 1e-9 then 'strong' when score >= 0.6 - 1e-9 then 'moderate' else 'weak' end as strength from k1)"""


def scored(s: Source):
    return E.with_scores(s.fx_evidence)


def direct(s: Source):
    """Evidence as a model's direct answers: recommendation, claim, marker, anchors and template ids by id."""
    k = c("evidence_id")
    return s.fx_evidence.select(
        "evidence_id", "item_id", "session_id", "citation_text", k.alias("ordinal"),
        F.when(k % 4 == 0, "include").when(k % 4 == 1, "review").when(k % 4 == 2, "exclude").otherwise("include").alias("recommendation"),
        F.when(k % 5 == 0, "ordinary_reference").when(k % 5 == 1, "limitation_feedback").when(k % 5 == 2, "detailed_comparison").otherwise("method_use").alias("claim_type"),
        (k % 3).cast("string").alias("marker"), (k % 7 != 0).alias("has_target"), F.when(k % 9 == 0, "mismatch").when(k % 9 == 1, "unresolved").otherwise("matched").alias("reference_match_status"),
        F.when(k % 6 == 0, "candidate").when(k % 6 == 1, "strong").otherwise("none").alias("template_match_level"), (k % 10 == 1).alias("negative_template"), F.when(k % 8 == 0, "exclude").otherwise("include").alias("original_recommendation"),
        F.array((k % 2).cast("string"), F.lit("t")).alias("template_ids"),
    ).withColumn("codes", E.reason_codes())


DIRECT = """d0 as (select evidence_id, item_id, session_id, citation_text, evidence_id as ordinal, evidence_id as k, case evidence_id % 4 when 1 then 'review' when 2 then 'exclude' else 'include' end as recommendation,
      case evidence_id % 5 when 0 then 'ordinary_reference' when 1 then 'limitation_feedback' when 2 then 'detailed_comparison' else 'method_use' end as claim_type, cast(evidence_id % 3 as varchar) as marker, evidence_id % 7 <> 0 as has_target,
      case evidence_id % 9 when 0 then 'mismatch' when 1 then 'unresolved' else 'matched' end as status, case evidence_id % 6 when 0 then 'candidate' when 1 then 'strong' else 'none' end as level, cast(evidence_id % 2 as varchar) as tid from fx_evidence),
    d1 as (select *, list_filter([case when k % 9 = 0 then 'reference_mismatch' end, case when k % 7 = 0 then 'target_marker_missing' end, case when k % 6 = 0 then 'template_candidate_requires_review' end, case when k % 5 = 0 then 'ordinary_reference' end,
      case when k % 5 = 1 and k % 10 <> 1 then 'limitation_feedback_not_positive' end, case when k % 8 = 0 then 'llm_recommended_exclude' end], lambda x: x is not null) as cs from d0),
    di as (select *, case when len(cs) = 0 and recommendation <> 'include' then ['template_goal_not_satisfied'] else cs end as codes from d1)"""


def evidence_texts(s: Source):
    mark = F.when(c("mention_type") == "direct_citation", F.concat(F.lit(" ["), "result_no", F.lit("]"))).otherwise("")
    return s.fx_evidence.select("session_id", "evidence_id", F.concat("citation_text", F.lit(" "), "evidence_type", F.lit(" "), "stance", mark).alias("text"))


def template_log(texts):
    """What the sessions of texts (session_id, text) did: all built-in templates on, one off again, then three of their own, with bounds and words from their texts."""
    # how the least text begins is the least beginning; few beginnings are counted by hash, where the least of whole texts would be found by sorting them
    begun = texts.groupBy("session_id", F.substring("text", 1, 6).alias("phrase")).agg(F.count("text").alias("n"), F.sum(F.length("text")).alias("total"))
    of = begun.groupBy("session_id").agg(F.min("phrase").alias("phrase"), F.floor(F.sum("total") / F.sum("n")).cast("int").alias("chars"))
    row = lambda ordinal, action, number, kind=None, words=(), chars=F.lit(0), least=0, marker=False: F.struct(
        F.lit(ordinal).alias("ordinal"), F.lit(action).alias("action"), F.lit(number).alias("template_id"), F.lit(kind).cast("string").alias("template_type"), F.array(*words).cast("array<string>").alias("positive"),
        chars.cast("int").alias("min_chars"), F.lit(least).alias("min_words"), F.lit(marker).alias("require_marker"),
    )
    n = len(T.BUILT_IN)
    own = [row(n + 2, "create", 101, "own", [c("phrase"), F.lit(" The "), F.lit("the"), F.lit("no  such")]), row(n + 3, "create", 102, T.LONG_CONTEXT, chars=c("chars"), least=40), row(n + 4, "create", 103, T.LONG_CONTEXT, chars=F.floor(c("chars") / 2), marker=True)]
    rows = [*(row(i, "enable", i) for i in range(1, n + 1)), row(n + 1, "disable", 9), *own]
    return of.select("session_id", F.explode(F.array(*rows)).alias("r")).select("session_id", "r.*")


def template_matches(s: Source, texts, key: str):
    return T.term_matches(texts, T.session_templates(T.builtin_templates(s.spark), template_log(texts)), key)


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _builtin_terms() -> str:
    rows = []
    for i, b in enumerate(T.BUILT_IN, 1):
        terms: dict[str, str] = {}
        for w in (*b.words, *b.patterns, *b.aspects):
            terms.setdefault(w.lower(), w)
        rows += [f"({i}, {_quoted(b.kind)}, {p}, {_quoted(w)})" for p, w in enumerate(terms.values()) if i != 9 and b.kind != T.LONG_CONTEXT]
    return ", ".join(rows)


#: Matches of texts tx (session_id, key, text): key, template_id, template_type, terms, reason, match_score as tm.
MATCHED = rf"""
    ts as (select session_id, trim(regexp_replace(substring(min(text), 1, 6), '\s+', ' ', 'g')) as phrase, cast(floor(avg(length(text))) as int) as chars from tx group by 1),
    te as (select session_id, v.template_id, v.kind, v.kind as name, v.pos, v.term from ts cross join (values {_builtin_terms()}) as v(template_id, kind, pos, term)
      union all select session_id, 101, 'own', 'custom_own_' || session_id || '_12', pos, term from (select session_id, phrase, unnest([phrase, 'The', 'no such', 'own']) as term, unnest([0, 1, 2, 3]) as pos from ts) where term <> '' and not (pos = 1 and lower(phrase) = 'the')),
    lt as (select session_id, 102 as template_id, chars as lo, 40 as least, false as marker from ts union all select session_id, 103, chars // 2, 0, true from ts),
    hit as (select key, template_id, kind, name, pos, term from tx join te on tx.session_id = te.session_id and contains(lower(text), lower(term))),
    tm as (select key, template_id, kind as template_type, string_agg(term, '|' order by pos) as terms, 'Matched template ''' || name || ''' terms: ' || string_agg(term, ', ' order by pos) as reason, least(30.0, 10.0 * count(*)) as match_score from hit group by key, template_id, kind, name
      union all select key, template_id, 'long_context_citation', array_to_string(b, '|'), 'Matched long_context_citation rules: ' || array_to_string(b, ', '), least(30.0, 10.0 + 5 * len(b)) from (
        select key, template_id, list_filter([case when lo > 0 then 'min_citation_chars>=' || lo end, case when least > 0 then 'min_citation_words>=' || least end, case when marker then 'require_target_marker' end], lambda z: z is not null) as b
        from tx join lt using (session_id) where length(text) >= lo and len(list_filter(string_split_regex(text, '\s+'), lambda z: z <> '')) >= least and (not marker or contains(text, '['))) where len(b) > 0)"""
BUILT = ", ".join(f"({i}, {_quoted(b.kind)}, {_quoted('|'.join(b.aspects))}, {len(b.words)})" for i, b in enumerate(T.BUILT_IN, 1))
SESSION_TEMPLATES = f"""
    with b as (select * from (values {BUILT}) as v(b_id, kind, asp, words)), l as (select * from fx_template_log where action <> 'open'),
    m as (select l.*, b_id, kind, asp, words, min(case when action = 'create' then ordinal end) over (partition by session_id, template_id) as made from l left join b on template_id = b_id),
    g as (select *, cast(action <> 'disable' as int) as o, cast(action <> 'disable' as int) - coalesce(lag(cast(action <> 'disable' as int)) over (partition by session_id, template_id order by ordinal), 0) as gain from m where action = 'create' or b_id is not null or made < ordinal),
    h as (select *, coalesce(sum(gain) over (partition by session_id order by ordinal rows between unbounded preceding and 1 preceding), 0) as others, coalesce(nullif(template_type, ''), 'custom') as own from g)
    select session_id, template_id, case when max(b_id) is null then 'custom_' || arg_min(own, ordinal) || '_' || session_id || '_' || cast(arg_min(others, ordinal) + 1 as bigint) else any_value(kind) end as name, case when max(b_id) is null then arg_min(own, ordinal) else any_value(kind) end as template_type, arg_max(o, ordinal) = 1 as enabled,
      max(b_id) is null as user_defined, case when max(b_id) is null then arg_min(own, ordinal) else any_value(asp) end as aspects, cast(case when max(b_id) is null then 1 else any_value(words) end as int) as words from h group by 1, 2"""
EVIDENCE_TEXT = "citation_text || ' ' || evidence_type || ' ' || stance || case when mention_type = 'direct_citation' then ' [' || result_no || ']' else '' end"


KINDS_OF_FINDINGS = ("background", "background", "detailed_comparison", "positive_evaluation", "application_extension", "method_foundation", "custom", "limitation_or_negative", "representative_work")
#: A finding for each document, in pieces of its text; entries of a reference list follow every fourth.
FINDINGS = f"""
    select doc_id as evidence_id, doc_id, marked || case when doc_id % 4 = 1 then chr(10) || 'References' || chr(10) || '[1] Smith, J. ' || title || ' Proc. 1999.' else '' end as full_text, title, target_marker, cites,
           case doc_id % 7 when 0 then 'It follows' when 1 then 'It follows ' || cites || '.' when 2 then substring(text, 1, 40) when 3 then substring(text, 200, 60) when 4 then '' when 5 then 'As [99] says' else 'Smith, J. ' || title || ' Proc. 1999.' end as citation_text,
           case when doc_id % 10 <> 0 then '[' || target_marker || ']' end as marker,
           case cast(floor(doc_id / 7) as int) % 9 {' '.join(f"when {i} then '{k}'" for i, k in enumerate(KINDS_OF_FINDINGS))} end as evidence_type,
           case cast(floor(doc_id / 5) as int) % 4 when 2 then 'positive' when 3 then 'negative' else 'neutral' end as stance,
           case cast(floor(doc_id / 3) as int) % 6 when 0 then 'grouped_citation' when 1 then 'related_work' when 2 then 'reference_only' when 3 then 'weak_mention' else 'direct_citation' end as mention_type,
           case doc_id % 8 when 0 then 'a drawback' when 1 then 'compared with ours' when 2 then 'its method' when 3 then 'an example' else '' end as reasoning,
           doc_id % 23 <> 0 as keep, case when doc_id % 2 = 0 then 'fulltext_direct' else 'candidate_spans' end as scope, case when doc_id % 6 = 0 then 'self_citation' else 'unknown' end as self_citation_status
    from (select *, case when doc_id % 9 = 4 then 'Nothing of it' else substring(text, 1, 20) end as title, substring(marked, length(text) + 13, length(marked) - length(text) - 13) as cites from fx_text) x"""


def _promoted(s: Source):
    f = s.spark.sql(FINDINGS.replace("fx_text", "{fx_text}").replace("chr(10)", "char(10)"), fx_text=s.fx_text)
    name = norm_title_alnum(c("title"))
    findings = f.withColumn("aliases", F.when(name == "", F.array().cast("array<string>")).otherwise(F.array(name)))
    return P.promoted(findings.drop("full_text", "cites"), f.select("doc_id", c("full_text").alias("text")))


ALNUM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
LIFT = "case " + " ".join(f"when regexp_matches({{0}}, '{'|'.join(words)}') then '{kind}'" for kind, words in D.UPGRADES) + " end"
PROMOTED = rf"""
    with f as ({FINDINGS}), f1 as (select *, regexp_replace(citation_text, '^\s+|\s+$', '', 'g') as q0, {ALNUM.format('title')} as alias from f),
    f2 as (select *, strpos(full_text, q0) as place, cast(target_marker as int) = doc_id % 40 + 1 or cast(target_marker as int) between doc_id % 7 + 1 and doc_id % 7 + 4 as within from f1),
    f3 as (select *, case when q0 <> '' and not contains(q0, '[') and marker is not null and not (alias <> '' and contains({ALNUM.format('q0')}, alias)) and place > 0
        then regexp_replace(regexp_extract(substring(full_text, 1, place - 1), '[^.!?\n]*$') || q0 || regexp_extract(substring(full_text, place + length(q0)), '^[^.!?\n]*[.!?\n]?'), '^\s+|\s+$', '', 'g') else '' end as wide from f2),
    f4 as (select *, case when contains(wide, cites) and within then wide else q0 end as q from f3),
    f5 as (select *, contains(q, '[') as any_mark, marker is not null and contains(q, cites) and within as has_target, alias <> '' and contains({ALNUM.format('q')}, alias) as by_alias from f4),
    f6 as (select *, case when has_target then 'citation_text_contains_target_marker' when marker is not null and any_mark then 'cited_other_reference_marker' when by_alias then 'title_alias_anchor_found' when marker is not null then 'target_anchor_missing' else 'no_target_reference_marker_available' end as anchor_reason,
        {LIFT.format(ALNUM.format("q || ' ' || reasoning"))} as lift, {LIFT.format(ALNUM.format('q'))} as own_lift, evidence_type = 'background' and stance = 'neutral' as bg, mention_type = 'grouped_citation' as gr,
        cast(case when q = '' then 0 when mention_type = 'grouped_citation' then 0.25 when mention_type = 'reference_only' then 0 when mention_type = 'weak_mention' then 0.35
          else 0.5 + case when evidence_type in ('background', 'custom', 'representative_work') then 0 else 0.25 end + case when stance = 'positive' then 0.1 else 0 end + case when length(q) >= 80 then 0.05 else 0 end end as double) as raw from f5),
    f7 as (select *, case when self_citation_status = 'self_citation' then greatest(0.0, round(raw - 0.2, 4)) else raw end as sc,
        case anchor_reason when 'citation_text_contains_target_marker' then 'valid_grouped' when 'title_alias_anchor_found' then 'valid' when 'no_target_reference_marker_available' then 'unknown' else 'invalid' end as anchor_status,
        regexp_matches({ALNUM.format("q || ' ' || reasoning")}, '{'|'.join(D.REPRESENTATIVE)}') as said from f6),
    f8 as (select *, case when not keep then 'keep_false' when q = '' then 'no_citation_text' when mention_type = 'reference_only' then 'reference_only' when anchor_status in ('invalid', 'unknown') then anchor_reason
        when gr and anchor_status = 'valid_grouped' and evidence_type in ('positive_evaluation', 'application_extension') then 'grouped_citation_not_promoted_to_strong_claim'
        when scope = 'fulltext_direct' and doc_id % 7 = 6 then 'reference_entry' when scope = 'fulltext_direct' and bg and own_lift is null then 'background_neutral' when bg and lift is not null then 'up'
        when bg and has_target and mention_type in ('related_work', 'grouped_citation') and said then 'rep' when bg then 'background_neutral' when gr and evidence_type not in ('background', 'custom') then 'grouped_citation_saved_for_review'
        when sc < 0.6 then case when gr then 'grouped_citation_too_ambiguous' else 'low_strength' end else 'saved' end as r from f7)
    select evidence_id, q as citation_text, q <> q0 as expanded, anchor_status, anchor_reason, has_target, marker is not null and any_mark as has_other,
      case r when 'up' then 'saved_background_anchor_upgrade' when 'rep' then 'saved_representative_review' when 'grouped_citation_saved_for_review' then 'saved_review_needed' when 'saved' then 'saved' when 'grouped_citation_not_promoted_to_strong_claim' then 'filtered_grouped_anchor_requires_review'
        when anchor_reason then 'filtered_target_anchor_validation' else 'filtered' end as decision, case when r in ('up', 'rep') then 'saved' else r end as reason,
      case r when 'up' then lift when 'rep' then 'representative_work' else evidence_type end as evidence_type, case when r = 'up' then case lift when 'limitation_or_negative' then 'negative' else 'neutral' end else stance end as stance,
      case when r = 'up' and lift in ('detailed_comparison', 'limitation_or_negative') then 'comparison' else mention_type end as mention_type,
      case when r in ('up', 'rep') then greatest(sc, 0.65) when r = 'grouped_citation_saved_for_review' then greatest(sc, 0.6) when r = 'saved' then sc end as score,
      case when r in ('up', 'rep', 'grouped_citation_saved_for_review') then 'moderate' when r = 'saved' then case when sc >= 0.8 - 1e-9 then 'strong' else 'moderate' end end as strength,
      r in ('up', 'rep', 'grouped_citation_saved_for_review', 'grouped_citation_not_promoted_to_strong_claim') as review from f8"""


def _inferred(s: Source):
    """Types of whole texts; an item's cited title is how its first text begins."""
    first = s.fx_evidence.groupBy(c("item_id").alias("k")).agg(F.substring(F.min_by("citation_text", "evidence_id"), 1, 12).alias("title"))
    return s.fx_evidence.join(first, c("item_id") == c("k")).select("evidence_id", E.inferred(c("citation_text"), c("title")).alias("i")).select("evidence_id", "i.*")


PLAIN = r"trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce({0}, ''))), '[^\x00-\x7F]', '', 'g'), '\s+', ' ', 'g'))"
KINDS = """case when regexp_matches({0}, 'first|seminal|pioneer') then 'first_or_seminal_claim' when contains({0}, 'compar') and regexp_matches({0}, 'compare|comparison') then 'detailed_comparison' when regexp_matches({0}, 'baseline|benchmark') then 'baseline_or_benchmark'
    when regexp_matches({0}, 'method foundation|methodological foundation|builds on|based on') then 'method_foundation' when regexp_matches({0}, 'theoretical foundation|theory|theoretical') then 'theoretical_foundation' when regexp_matches({0}, 'extend|extension|application') then 'application_extension'
    when regexp_matches({0}, 'positive|effective|accurate|robust|high precision|important') then 'positive_evaluation' when regexp_matches({0}, 'limitation|negative|fail|weakness') then 'limitation_or_negative' end"""
INFERRED = f"""
    with f as (select item_id, substring(arg_min(citation_text, evidence_id), 1, 12) as title from fx_evidence group by 1),
    k as (select evidence_id, {PLAIN.format('citation_text')} as q, {PLAIN.format('title')} as t from fx_evidence join f using (item_id)), n as (select *, {KINDS.format('q')} as kind from k)
    select evidence_id, kind as evidence_type, case when regexp_matches(q, 'limitation|negative|fail|weakness') then 'negative' when kind in ('positive_evaluation', 'method_foundation', 'first_or_seminal_claim') then 'positive' else 'neutral' end as stance,
    case when contains(q, t) then 'explicit_target' when kind in ('detailed_comparison', 'baseline_or_benchmark') then 'comparison' when kind in ('method_foundation', 'theoretical_foundation') then 'method_use' else 'other' end as mention_type from n"""

PLANS = {
    "r23_scored_evidence": (lambda s: scored(s).select("evidence_id", "score", "strength"), f"with {SCORED} select evidence_id, score, strength from sc"),
    "r25_promotion": (_promoted, PROMOTED),
    "r25_promotion_counts": (lambda s: P.promotion_counts(_promoted(s)), f"with p as ({PROMOTED}) select decision, reason, count(*) as findings, count(*) filter (review) as review from p group by 1, 2"),
    "r27_inferred": (_inferred, INFERRED),
    "r29_reason_codes": (lambda s: direct(s).select("evidence_id", F.array_join("codes", "|").alias("codes"), E.template_eligible().alias("eligible")), f"with {DIRECT} select evidence_id, array_to_string(codes, '|') as codes, has_target and not list_has_any(codes, ['reference_mismatch', 'target_marker_missing', 'reference_only']) as eligible from di"),
    "r5_template_terms": (
        lambda s: template_matches(s, evidence_texts(s), "evidence_id").select("evidence_id", "template_id", "template_type", F.array_join("matched_terms", "|").alias("terms"), "reason", "match_score"),
        f"with tx as (select session_id, evidence_id as key, {EVIDENCE_TEXT} as text from fx_evidence), {MATCHED} select key as evidence_id, template_id, template_type, terms, reason, match_score from tm",
    ),
    "r3_template_reasons": (
        lambda s: T.template_reasons(template_matches(s, evidence_texts(s), "evidence_id"), "evidence_id").select("evidence_id", F.array_join(F.transform("extra", lambda x: x["reason"]), ";").alias("reasons"), F.aggregate("extra", F.lit(0.0), lambda a, x: a + x["delta"]).alias("delta")),
        f"with tx as (select session_id, evidence_id as key, {EVIDENCE_TEXT} as text from fx_evidence), {MATCHED} select key as evidence_id, string_agg('template_match:' || template_type || ':' || replace(terms, '|', ', '), ';' order by template_id) as reasons, sum(match_score) as delta from tm group by 1",
    ),
    "r22_template_overlay": (
        lambda s: T.session_templates(T.builtin_templates(s.spark), s.fx_template_log.withColumn("positive", F.array("word"))).select("session_id", "template_id", "name", "template_type", "enabled", "user_defined", F.array_join("aspects", "|").alias("aspects"), F.size("positive").alias("words")),
        SESSION_TEMPLATES,
    ),
    "p3_evidence_views": (
        lambda s: scored(s).select("session_id", F.explode(F.array(*(F.when(f(), F.lit(n)) for n, f in E.VIEWS.items()))).alias("view")).where("view is not null").groupBy("session_id", "view").agg(F.count(F.lit(1)).alias("n")),
        f"with {SCORED}, v as (select session_id, 'all' as view from sc union all select session_id, review_status from sc where review_status in ('unreviewed', 'accepted', 'rejected', 'false_positive') union all select session_id, 'positive' from sc where stance = 'positive' union all select session_id, 'high_strength' from sc where strength = 'strong' union all select session_id, 'third_party_only' from sc where third_party_status = 'third_party' union all select session_id, 'exclude_self_citation' from sc where self_citation_status <> 'self_citation') select session_id, view, count(*) as n from v group by 1, 2",
    ),
    "p4_eligible": (lambda s: E.eligible(s.fx_evidence).select("evidence_id"), "select evidence_id from fx_evidence where trim(citation_text) <> '' and review_status not in ('rejected', 'false_positive')"),
    "p10_reportable_direct": (
        lambda s: direct(s).where((c("recommendation") == "include") & (c("template_match_level") == "strong") & (c("reference_match_status") == "matched") & c("has_target")).select("evidence_id"),
        f"with {DIRECT} select evidence_id from di where recommendation = 'include' and level = 'strong' and status = 'matched' and has_target",
    ),
    "t3_card_order": (
        lambda s: numbered(E.eligible(scored(s)), "session_id", E.card_order(), "place").select("session_id", "evidence_id", "place"),
        f"with {SCORED} select session_id, evidence_id, row_number() over (partition by session_id order by review_status = 'important' desc, review_status = 'accepted' desc, round(score, 9) desc, evidence_id) as place from sc where trim(citation_text) <> '' and review_status not in ('rejected', 'false_positive')",
    ),
    "u3_evidence_upsert": (
        lambda s: E.upserted(scored(s).where("evidence_id % 2 = 0"), scored(s).where("evidence_id % 3 = 0").withColumn("score", c("score") + 1)).groupBy("review_status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("score"), F.sum("evidence_id").alias("ids")),
        f"with {SCORED}, o as (select item_id, evidence_type, stance, mention_type, citation_text, min(evidence_id) as id, arg_min(review_status, evidence_id) as st, arg_min(score, evidence_id) as score from sc where evidence_id % 2 = 0 group by 1, 2, 3, 4, 5), n as (select item_id, evidence_type, stance, mention_type, citation_text, min(evidence_id) as id, arg_max(score + 1, evidence_id) as score from sc where evidence_id % 3 = 0 group by 1, 2, 3, 4, 5) select coalesce(o.st, 'unreviewed') as review_status, count(*) as n, round(sum(coalesce(n.score, o.score)), 4) as score, cast(sum(coalesce(o.id, n.id)) as bigint) as ids from o full join n using (item_id, evidence_type, stance, mention_type, citation_text) group by 1",
    ),
    "u6_strongest": (
        lambda s: E.strongest(direct(s)).select("evidence_id", "first_ordinal", "copies"),
        f"with {DIRECT}, r as (select *, trim(regexp_replace(lower(citation_text), '[^a-z0-9]+', ' ', 'g')) as qk from di), n as (select evidence_id, row_number() over (partition by item_id, marker, qk order by case recommendation when 'include' then 2 when 'review' then 1 else 0 end desc, case claim_type when 'detailed_comparison' then 85 when 'method_use' then 50 when 'limitation_feedback' then 30 else 20 end desc, ordinal) as rn, min(ordinal) over (partition by item_id, marker, qk) as first_ordinal, count(*) over (partition by item_id, marker, qk) as copies from r) select evidence_id, first_ordinal, copies from n where rn = 1",
    ),
    "u7_strong_clusters": (
        lambda s: E.strong_clusters(direct(s)).select("evidence_id", "cluster_size"),
        f"with {DIRECT}, n as (select evidence_id, row_number() over w as rn, count(*) over (partition by item_id, marker, claim_type, tid) as cluster_size from di where recommendation = 'include' window w as (partition by item_id, marker, claim_type, tid order by ordinal)) select evidence_id, cluster_size from n where rn = 1 union all select evidence_id, 1 from di where recommendation <> 'include'",
    ),
    "u12_stale_evidence": (lambda s: E.stale_split(s.fx_evidence, s.fx_evidence.where("evidence_id % 3 <> 0").select("evidence_id")).groupBy("action").agg(F.count(F.lit(1)).alias("n")), "select case when evidence_id % 3 <> 0 then 'keep' when review_status <> 'unreviewed' then 'demote' else 'delete' end as action, count(*) as n from fx_evidence group by 1"),
    "a2_quality_summary": (
        lambda s: E.quality_summary(scored(s)),
        f"with {SCORED} select session_id, count(*) as total, count(*) filter (review_status = 'unreviewed') as unreviewed, count(*) filter (review_status = 'accepted') as accepted, count(*) filter (review_status = 'rejected') as rejected, count(*) filter (review_status = 'false_positive') as false_positive, count(*) filter (third_party_status = 'third_party') as third_party, count(*) filter (self_citation_status = 'self_citation') as self_citation, count(*) filter (strength = 'strong') as strong, count(*) filter (strength = 'moderate') as moderate, count(*) filter (strength = 'weak') as weak from sc group by 1",
    ),
    "a8_filter_reasons": (lambda s: direct(s).where("recommendation <> 'include'").select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")), f"with {DIRECT} select code, count(*) as n from (select unnest(codes) as code from di where recommendation <> 'include') group by 1"),
    "a9_failure_texts": (lambda s: direct(s).select(F.explode(F.split(F.array_join("codes", ";"), ";")).alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count(F.lit(1)).alias("n")), f"with {DIRECT} select reason, count(*) as n from (select unnest(codes) as reason from di) group by 1"),
    "a10_direct_counts": (
        lambda s: E.direct_counts(direct(s)),
        f"with {DIRECT} select session_id, count(*) as total, count(*) filter (recommendation = 'include') as include, count(*) filter (recommendation = 'review') as review, count(*) filter (recommendation = 'exclude') as exclude, count(*) filter (has_target) as aligned, count(*) filter (status = 'unresolved') as unresolved, count(*) filter (has_target and not list_has_any(codes, ['reference_mismatch', 'target_marker_missing', 'reference_only'])) as eligible, count(*) filter (level = 'strong') as matched, count(*) filter (recommendation = 'include' and has_target) as verified, count(*) filter (recommendation = 'include' and has_target and claim_type <> 'ordinary_reference') as verified_substantive from di group by 1",
    ),
    "a15_candidate_layers": (
        lambda s: direct(s).join(E.latest_results(s.fx_result), "item_id").groupBy("recommendation", "claim_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("has_target").alias("verified")),
        f"with {DIRECT} select recommendation, claim_type, count(*) as n, count(*) filter (has_target) as verified from di where item_id in (select item_id from fx_result where status = 'success') group by 1, 2",
    ),
    "w1_latest_results": (lambda s: E.latest_results(s.fx_result), "select item_id, arg_max(result_id, {'a': created_at, 'b': result_id}) as result_id, count(*) as n_results from fx_result where status = 'success' group by 1"),
    "w2_result_counts": (
        lambda s: s.fx_result.groupBy("item_id").agg(F.count(F.lit(1)).alias("results"), F.max_by("status", F.struct("created_at", "result_id")).alias("last_status")).join(s.fx_evidence.groupBy(c("item_id").alias("e")).agg(F.count(F.lit(1)).alias("evidence")), c("item_id") == c("e"), "left").select("item_id", "results", "last_status", F.coalesce("evidence", F.lit(0)).alias("evidence")),
        "select r.*, coalesce(evidence, 0) as evidence from (select item_id, count(*) as results, arg_max(status, {'a': created_at, 'b': result_id}) as last_status from fx_result group by 1) r left join (select item_id, count(*) as evidence from fx_evidence group by 1) e using (item_id)",
    ),
    "w3_of_latest": (
        lambda s: E.of_latest(s.fx_evidence.withColumn("result_id", c("result_no")), s.fx_evidence.where("item_id % 2 = 0").groupBy("item_id").agg(F.max("result_no").alias("result_id"))).select("evidence_id", "item_id"),
        "select evidence_id, item_id from (select *, max(result_no) over (partition by item_id) as m from fx_evidence) where item_id % 2 = 1 or result_no = m",
    ),
    "w5_latest_of_twenty": (
        lambda s: s.fx_result.withColumn("rank", F.row_number().over(Window.partitionBy("scope", c("item_id") % 10).orderBy(F.desc("created_at"), F.desc("result_id")))).where("rank <= 20").groupBy("scope", "item_id").agg(F.min_by("result_id", "rank").alias("result_id")),
        "select scope, item_id, arg_min(result_id, rank) as result_id from (select *, row_number() over (partition by scope, item_id % 10 order by created_at desc, result_id desc) as rank from fx_result) where rank <= 20 group by 1, 2",
    ),
    "w6_latest_snapshot": (
        lambda s: s.fx_result.join(s.fx_result.groupBy(c("scope").alias("x")).agg(F.max_by(F.to_date("created_at"), "created_at").alias("day")), (c("scope") == c("x")) & (F.to_date("created_at") == c("day")), "left_semi").select("result_id", "scope"),
        "select result_id, scope from (select *, max(cast(created_at as date)) over (partition by scope) as day from fx_result) where cast(created_at as date) = day",
    ),
    "j18_evidence_listing": (
        lambda s: scored(s).join(s.fx_asset.select(c("asset_id").alias("a"), "publication_id"), c("evidence_id") == c("a")).join(s.fx_citing.select(c("publication_id").alias("p"), "title"), c("publication_id") == c("p")).select("evidence_id", "title", "score"),
        f"with {SCORED} select evidence_id, title, score from sc join fx_asset on evidence_id = asset_id join fx_citing c on c.publication_id = fx_asset.publication_id",
    ),
}
