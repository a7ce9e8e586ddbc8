"""What becomes of a model's direct evidence: checked against the reference list, then against the templates that the model named, run again on demand.

Evidence is one row for each finding of an item: evidence_id, item_id, citation_text, context, claim_type, recommendation, and its target's marker, title, doi,
reference entry, authors, year and whether that entry is resolved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.names import norm_title_alnum

from . import anchors as A
from . import contexts as X
from .evaluation import effective_rules, stance

c = F.col

# The relation that a claim has to the templates; others are unmatched unless the model's own relation speaks of a method or capability.
RELATIONS = {
    "positive_evaluation": "explicit_positive_evaluation",
    "method_summary": "detailed_method_summary",
    "method_use": "detailed_method_summary",
    "method_foundation": "detailed_method_summary",
    "capability_summary": "capability_recognition",
    "capability_recognition": "capability_recognition",
    "through_wall_eavesdropping": "capability_recognition",
    "rfid_loudspeaker_vibration": "capability_recognition",
    "first_or_seminal_claim": "first_or_seminal_claim",
    "baseline_or_benchmark": "baseline_or_benchmark",
    "performance_comparison": "baseline_or_benchmark",
    "theoretical_foundation": "theoretical_foundation",
    "detailed_comparison": "detailed_method_summary",
    "limitation_feedback": "limitation_feedback",
    "limitation_or_negative": "limitation_feedback",
}
# Claims that are positive without a word from model or template.
POSITIVE_CLAIMS = ("positive_evaluation", "first_or_seminal_claim", "detailed_comparison", "baseline_or_benchmark")
# Notes after which a template can't rescue a finding.
BARRED = ("reference_only", "title_or_reference_only", "cited_other_reference_marker", "target_anchor_missing", "reference_entry_target_mismatch")
# Words that lift a background mention to a type of its own, in the order of the types, and those of a representative work.
UPGRADES = (
    ("limitation_or_negative", ("limitation", "camera dependent", "sensitive to lighting", "lighting sensitive", "trade off", "tradeoff", "drawback", "weakness", "constraint", "negative")),
    ("detailed_comparison", ("compared with", "compared to", "comparison", "compare", "outperform", "superiority", "advantage", "benchmark", "baseline")),
    ("representative_work", ("introduces", "introduced", "proposes", "proposed", "presents", "presented", "mechanism", "method", "approach", "framework", "model", "system")),
)
REPRESENTATIVE = ("representative", "related work", "technical line", "method category", "prior work", "technology route", "field positioning", "research direction", "category", "example")


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def background_upgrade(quote: Column, reasoning: Column) -> Column:
    """The type to which words of limits, comparison or mechanism lift a background mention; null without any."""
    text = norm_title_alnum(F.concat_ws(" ", quote, reasoning))
    out = F.lit(None).cast("string")
    for kind, words in reversed(UPGRADES):
        out = F.when(_holds(text, words), kind).otherwise(out)
    return out


def is_representative(kind: Column, mention: Column, quote: Column, reasoning: Column, has_marker: Column) -> Column:
    """Whether a related-work or grouped mention with the target's marker is said to be representative."""
    said = _holds(norm_title_alnum(quote), REPRESENTATIVE) | _holds(norm_title_alnum(reasoning), REPRESENTATIVE)
    return has_marker & mention.isin("related_work", "grouped_citation") & kind.isin("background", "representative_work") & said


def is_grouped_for_review(kind: Column, mention: Column, quote: Column, reviewable: tuple[str, ...]) -> Column:
    return (mention == "grouped_citation") & kind.isin(*reviewable) & (F.trim(F.coalesce(quote, F.lit(""))) != "")


def relation(claim: Column, own: Column) -> Column:
    out = F.when(F.contains(F.lower(own), F.lit("method")), "detailed_method_summary").when(F.contains(F.lower(own), F.lit("capability")), "capability_recognition").otherwise("unmatched")
    for k, v in RELATIONS.items():
        out = F.when(claim == k, v).otherwise(out)
    return out


def _lowest(markers: Column) -> Column:
    return F.array_min(markers).cast("string")


def normalised(evidence: DataFrame, entries: DataFrame) -> DataFrame:
    """Evidence checked against its text's reference list: final_recommendation, final_claim_type, reference_match_status and reason, anchor status, attribution conflict, grouped, grounding_status, template_relation,
    evidence_strength, notes.

    evidence: evidence_id, item_id, citation_text, context, claim_type, recommendation, semantic_relation, marker, title, doi, own_entry, authors (array), year, resolved.
    entries: item_id, marker, entry, one row for each marker of an item."""
    text = lambda x: F.coalesce(x, F.lit(""))
    rows = evidence.withColumns({x: text(x) for x in ("citation_text", "context", "marker", "title", "own_entry", "semantic_relation")})
    rows = rows.withColumns({"claim_type": F.coalesce("claim_type", F.lit("ordinary_reference")), "recommendation": F.coalesce("recommendation", F.lit("review")), "resolved": F.coalesce("resolved", F.lit(False))})
    rows = rows.withColumns({"q_marks": A.markers(c("citation_text")), "c_marks": A.markers(c("context")), "n": c("marker").try_cast("long")})
    direct = (c("marker") != "") & A.has_marker(c("citation_text"), c("marker"))
    own = lambda m: (c("marker") != "") & F.array_contains(m, c("n"))
    found = F.when(own(c("q_marks")), c("marker")).when(F.size("q_marks") > 0, _lowest(c("q_marks"))).when(own(c("c_marks")), c("marker")).when(F.size("c_marks") > 0, _lowest(c("c_marks"))).otherwise(c("marker"))
    rows = rows.withColumns({"direct": F.coalesce(direct, F.lit(False)), "found_marker": found})
    e = entries.select(c("item_id").alias("e_item"), c("marker").alias("e_marker"), "entry")
    rows = rows.join(e, (c("item_id") == c("e_item")) & (c("found_marker") == c("e_marker")), "left").drop("e_item", "e_marker")
    taken = X.inheritances(rows.select("evidence_id", c("citation_text").alias("quote"), "context", "marker")).select(c("evidence_id").alias("t_id"), c("inherited"), c("reason").alias("inheritance_reason"))
    rows = rows.join(taken, c("evidence_id") == c("t_id")).drop("t_id")
    same = c("found_marker") == c("marker")
    entry = F.coalesce("entry", F.when(c("resolved") & same, c("own_entry")), F.lit(""))
    anchored = c("direct") | c("inherited")
    rows = rows.withColumns({"used_entry": entry, "anchored": anchored, "by_marker": c("resolved") & (c("marker") != "") & same & anchored & c("entry").isNotNull()})
    known = X.identities(rows.select("evidence_id", c("used_entry").alias("entry"), "title", "doi", "own_entry", "authors", "year", c("by_marker").alias("resolved")))
    rows = rows.join(known.select(c("evidence_id").alias("k_id"), c("status").alias("k_status"), c("method").alias("alignment_method"), c("score").alias("alignment_score"), c("reason").alias("k_reason")), c("evidence_id") == c("k_id")).drop("k_id")
    # the sentence with the target's marker, of the quote or else of its context
    parts = F.filter(F.concat(F.split("citation_text", r"(?<=[.!?。！？])\s+|[\r\n]+"), F.split("context", r"(?<=[.!?。！？])\s+|[\r\n]+")), lambda s: (F.trim(s) != "") & A.has_marker(s, c("marker")))
    scope = F.when(c("marker") == "", c("citation_text")).otherwise(F.coalesce(F.trim(F.try_element_at(parts, F.lit(1))), c("citation_text")))
    rows = rows.withColumn("scope", scope)
    rows = rows.withColumns({"grouped": c("direct") & F.exists(A.markers(c("scope")), lambda m: m != c("n")), "body": A.body_author(c("scope"), c("marker")), "listed": A.entry_author(c("used_entry"))})
    plain = norm_title_alnum
    conflict = (c("body") != "") & (c("listed") != "") & (plain(c("body")) != plain(c("listed")))
    alias = ((plain(c("title")) != "") & F.contains(plain(c("citation_text")), plain(c("title")))) | (F.contains("title", F.lit(":")) & (F.length(plain(F.split_part("title", F.lit(":"), F.lit(1)))) >= 6) & F.contains(plain(c("citation_text")), plain(F.split_part("title", F.lit(":"), F.lit(1)))))
    bare = A.is_reference_entry(c("citation_text")) | (plain(F.regexp_replace("citation_text", r"\[[^\]]+\]", "")) == plain(c("title")))
    listed, matched = c("used_entry") != "", c("k_status") == "matched"
    other = (c("marker") != "") & (c("found_marker") != "") & ~same & ~c("direct")
    status = F.when(other, "mismatch").when(listed & matched, "matched").when(listed, "mismatch").otherwise("unresolved")
    status_reason = F.when(other, "evidence_marker_not_target_marker").when(listed, c("k_reason")).otherwise("reference_entry_unresolved")
    include = c("recommendation") == "include"
    out = (
        F.when(other, "cited_other_reference_marker")
        .when(listed & ~matched, "reference_entry_target_mismatch")
        .when(~listed & (c("marker") != "") & include, "reference_entry_unresolved")
        .when((c("marker") != "") & (F.size("q_marks") > 0) & ~c("direct"), "cited_other_reference_marker")
        .when((c("marker") != "") & ~c("anchored") & ~alias, "target_anchor_missing")
        .when(A.is_reference_entry(c("citation_text")), "reference_only")
        .when(bare, "title_or_reference_only_not_include")
        .when(include & (status != "matched"), "reference_match_not_matched")
        .when(include & ~c("anchored"), "include_requires_body_target_marker")
        .when(include & (c("claim_type") == "ordinary_reference"), "ordinary_reference_not_include")
    )
    rows = rows.withColumns({"reference_match_status": status, "reference_match_reason": status_reason, "bare": bare, "conflict": conflict, "note": out})
    false_ = c("note").isin("cited_other_reference_marker", "reference_entry_target_mismatch", "target_anchor_missing", "reference_only")
    first = F.when(false_ | (c("note") == "title_or_reference_only_not_include"), "exclude").when(c("note").isNotNull(), "review").otherwise(c("recommendation"))
    claim = F.when(false_, "false_positive").otherwise(c("claim_type"))
    second = F.when(c("conflict") & (first != "exclude"), "review").otherwise(first)
    # a safely aligned summary that the model would drop waits for the templates
    waits = (c("recommendation") == "exclude") & (second == "exclude") & claim.isin("method_summary", "capability_summary") & (c("reference_match_status") == "matched") & c("anchored") & ~c("bare") & ~c("conflict")
    grounding = F.when(c("conflict"), "attribution_conflict").when((c("reference_match_status") == "mismatch") | (claim == "false_positive"), "mismatch").when((c("reference_match_status") == "matched") & c("anchored") & ~c("bare"), "verified").otherwise("unresolved")
    rows = rows.withColumns({"final_recommendation": F.when(waits, "review").otherwise(second), "final_claim_type": claim, "grounding_status": grounding, "template_relation": relation(claim, c("semantic_relation"))})
    substantive = (c("template_relation") != "unmatched") & ~c("final_claim_type").isin("ordinary_reference", "false_positive")
    verified = c("grounding_status") == "verified"
    strength = F.when(c("grounding_status").isin("mismatch", "attribution_conflict"), "weak").when(verified & substantive, "strong").when(verified | substantive, "medium").otherwise("weak")
    notes = F.concat_ws("; ", "note", F.when(c("conflict") & (first != "exclude"), "reference_attribution_conflict"), F.when(waits, "candidate_requires_matching_template"))
    anchor_status = F.when(c("direct"), "direct_marker").when(c("inherited"), "inherited_named_method").otherwise("missing")
    return rows.select(
        "evidence_id", "item_id", "final_recommendation", "final_claim_type", "reference_match_status", "reference_match_reason", "alignment_method", "alignment_score", anchor_status.alias("target_anchor_status"), "inheritance_reason",
        c("conflict").alias("attribution_conflict"), "grouped", "grounding_status", "template_relation", strength.alias("evidence_strength"), notes.alias("notes"),
    )


def decided(evidence: DataFrame, named: DataFrame, templates: DataFrame) -> DataFrame:
    """Evidence with what the model's template decisions come to: recommendation, stance, level, matched and strong template ids.

    evidence: evidence_id, session_id, recommendation, claim_type, stance, grounding_status, reference_match_status, attribution_conflict, target_anchor_status, notes. named: evidence_id, template_id, level (candidate, strong); a finding without a
    row there has no decision, and its recommendation is review at most. templates: session_id, template_id, template_type, name, goal, enabled, ...; those that are not enabled count for nothing."""
    t = effective_rules(templates.where("enabled")).select(c("session_id").alias("t_session"), c("template_id").alias("t_id"), stance().alias("intent"))
    hits = named.join(evidence.select(c("evidence_id").alias("h_id"), c("session_id").alias("h_session")), c("evidence_id") == c("h_id")).join(t, (c("h_session") == c("t_session")) & (c("template_id") == c("t_id")))
    strong = c("level") == "strong"
    per = hits.groupBy(c("h_id").alias("p_id")).agg(
        F.array_sort(F.collect_set("template_id")).alias("template_ids"), F.array_sort(F.collect_set(F.when(strong, c("template_id")))).alias("strong_ids"), F.collect_set(F.when(strong, c("intent"))).alias("intents"),
    )
    said = named.select(c("evidence_id").alias("d_id")).distinct()
    none = F.array().cast("array<int>")
    rows = evidence.join(per, c("evidence_id") == c("p_id"), "left").join(said, c("evidence_id") == c("d_id"), "left")
    rows = rows.withColumns({"template_ids": F.coalesce("template_ids", none), "strong_ids": F.coalesce("strong_ids", none), "intents": F.coalesce("intents", F.array().cast("array<string>")), "said": c("d_id").isNotNull()})
    status = F.coalesce("reference_match_status", F.lit("unresolved"))
    valid = (c("grounding_status") == "verified") & (status == "matched") & ~c("attribution_conflict") & (c("target_anchor_status") != "missing") & (c("claim_type") != "false_positive") & ~_holds(F.coalesce("notes", F.lit("")), BARRED)
    recommendation = (
        F.when(c("said") & ~valid, F.when(status == "unresolved", "review").otherwise("exclude"))
        .when(c("said") & (F.size("strong_ids") > 0), "include")
        .when(c("said") & (F.size("template_ids") > 0), "review")
        .otherwise(c("recommendation"))
    )
    kept = F.when(c("said") & ~valid, none).otherwise(c("strong_ids"))
    level = F.when(F.size(kept) > 0, "strong").when(F.size("template_ids") > 0, "candidate").otherwise("none")
    supplied = F.lower(F.trim(F.coalesce("stance", F.lit(""))))
    intent = lambda x: F.array_contains("intents", x)
    own = (
        F.when(c("claim_type").isin("limitation_feedback", "limitation_or_negative"), "negative")
        .when(supplied.isin("positive", "neutral", "negative", "mixed"), supplied)
        .when(intent("negative"), "negative").when(intent("positive"), "positive").when(intent("neutral"), "neutral")
        .when(c("claim_type").isin(*POSITIVE_CLAIMS), "positive").otherwise("neutral")
    )
    # nothing is included without a strong template; templates refused by the guard above count here as they were named
    final = F.when((recommendation == "include") & (F.size("strong_ids") == 0), "review").otherwise(recommendation)
    return rows.select("evidence_id", "session_id", F.when(final.isNull(), "review").otherwise(final).alias("final_recommendation"), "claim_type", own.alias("stance"), level.alias("template_match_level"), "template_ids", kept.alias("strong_ids"))


def rejudged(results: DataFrame, evidence: DataFrame, named: DataFrame, templates: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decisions run again over each item's latest successful result: the decided evidence, counts by session, and the action for each stored row (keep, demote, delete).

    results: result_id, item_id, session_id, status, created_at. evidence: see decided(), with result_id. stored: evidence_id, result_id, review_status."""
    ranked = results.where("status = 'success'").withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("created_at"), F.desc("result_id"))))
    latest = ranked.where("rank = 1").select(c("result_id").alias("l_result"), c("session_id").alias("l_session"))
    own = evidence.join(latest.select("l_result"), c("result_id") == c("l_result"), "left_semi")
    verdict = decided(own, named, templates)
    n = lambda x: F.count_if(c("final_recommendation") == x).alias(x)
    sums = verdict.groupBy("session_id").agg(F.count(F.lit(1)).alias("evidence"), n("include"), n("review"), n("exclude"))
    counts = latest.groupBy(c("l_session").alias("session_id")).agg(F.count(F.lit(1)).alias("results")).join(sums, "session_id", "left").fillna(0, ["evidence", "include", "review", "exclude"])
    rows = stored.join(latest.select("l_result"), c("result_id") == c("l_result"), "left_semi").join(verdict.where("final_recommendation = 'include'").select(c("evidence_id").alias("v_id")), c("evidence_id") == c("v_id"), "left")
    touched = c("review_status") != "unreviewed"
    return verdict, counts, rows.select("evidence_id", F.when(c("v_id").isNotNull(), "keep").when(touched, "demote").otherwise("delete").alias("action"))
