"""Which findings of a model become evidence, and why the others do not.

A finding is judged with the text that it quotes: its anchor, the sentence around it, whether it stands among the references. The texts join once, and no row carries them further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.names import norm_title_alnum, norm_title_ws, unaccented

from . import anchors as A
from . import contexts as X
from . import decisions as D
from .evidence import downranked, score_finding

c = F.col
#: The least score of evidence, and what background that is lifted counts at least.
LEAST, LIFTED = 0.6, 0.65
DIRECT = "fulltext_direct"
# Types that a grouped citation cannot claim, and those which a grouped citation may have for review.
NOT_GROUPED = ("positive_evaluation", "application_extension", "theoretical_foundation")
REVIEWABLE = ("limitation_or_negative", "detailed_comparison", "positive_evaluation", "representative_work", "method_foundation", "baseline_or_benchmark", "application_extension", "theoretical_foundation", "first_or_seminal_claim")
# Signs of a reference entry.
ENTRY_SIGNS = ("proc.", " pp.", " vol.", " doi", " arxiv", " conf.", " int. conf.")
ENTRY_TITLE = 0.6


def plain(x: Column) -> Column:
    """Plain lower-case ASCII with single spaces."""
    return norm_title_ws(F.regexp_replace(unaccented(F.coalesce(x, F.lit(""))), r"[^\x00-\x7F]", ""))


def sentence_around(text: Column, quote: Column) -> Column:
    """The sentence or line of a text in which a quote first stands, from the last stop before it to the first one after; '' where it does not."""
    at = F.instr(text, quote)
    stops = lambda x: F.translate(x, "!?\n", "...")
    before, after = F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(quote), F.length(text))
    head = F.substring_index(stops(before), ".", -1)
    tail = F.substring_index(stops(after), ".", 1)
    found = X.stripped(F.substring(text, at - F.length(head), F.length(head) + F.length(quote) + F.length(tail) + 1))
    return F.when((quote != "") & (at > 0), found).otherwise("")


def _like_entry() -> Column:
    """Whether a quote reads like a reference entry of its target: signs and a year, with initials or most of the title's words. One without plain characters does."""
    q = c("__plain")
    words = lambda x: F.regexp_extract_all(x, F.lit("[a-z0-9]+"), F.lit(0))
    title = F.array_distinct(F.filter(words(plain(c("title"))), lambda w: F.length(w) >= 4))
    shared = F.size(F.array_intersect(title, words(q))) >= ENTRY_TITLE * F.size(title)
    signs = F.coalesce(*(F.when(F.contains(q, F.lit(s)), F.lit(True)) for s in ENTRY_SIGNS), F.lit(False))
    return (q == "") | (signs & q.rlike(r"\b(19|20)\d{2}\b") & (q.rlike(r"\b[a-z]\.\s*[a-z\-]+") | ((F.size(title) > 0) & shared)))


# What each rule that does not filter or keep a finding as it is makes of it: decision and reason.
OUTCOMES = {
    "grouped_claim": ("filtered_grouped_anchor_requires_review", "grouped_citation_not_promoted_to_strong_claim"),
    "lifted": ("saved_background_anchor_upgrade", "saved"),
    "representative": ("saved_representative_review", "saved"),
    "grouped_review": ("saved_review_needed", "grouped_citation_saved_for_review"),
    "saved": ("saved", "saved"),
}
FOR_REVIEW = ("grouped_claim", "lifted", "representative", "grouped_review")


def _rule() -> Column:
    """The first rule that applies: a name in OUTCOMES, else the reason of a filtered finding. From the anchor's rule on, every quote has the target's marker or an alias of it."""
    grouped = c("mention_type") == "grouped_citation"
    background = (c("evidence_type") == "background") & (c("stance") == "neutral")
    direct = c("scope") == DIRECT
    return (
        F.when(~c("keep"), "keep_false")
        .when(c("__quote") == "", "no_citation_text")
        .when(c("mention_type") == "reference_only", "reference_only")
        .when(~c("v.status").isin("valid", "valid_grouped"), c("v.reason"))
        .when(grouped & (c("v.status") == "valid_grouped") & c("evidence_type").isin(*NOT_GROUPED), "grouped_claim")
        .when(direct & (c("in_references") | _like_entry()), "reference_entry")
        .when(direct & background & c("__own_upgrade").isNull(), "background_neutral")
        .when(background & c("__upgrade").isNotNull(), "lifted")
        .when(background & D.is_representative(c("evidence_type"), c("mention_type"), c("__quote"), c("reasoning"), c("v.has_target")), "representative")
        .when(background, "background_neutral")
        .when(D.is_grouped_for_review(c("evidence_type"), c("mention_type"), c("__quote"), REVIEWABLE), "grouped_review")
        .when(c("s.score") < LEAST, F.when(grouped, "grouped_citation_too_ambiguous").otherwise("low_strength"))
        .otherwise("saved")
    )


def _outcome() -> list[Column]:
    """decision, reason, evidence_type, stance, mention_type, score, strength, review of a finding by its rule."""
    rule, kind = c("rule"), c("__upgrade")
    lifted = rule == "lifted"
    named = lambda i: F.coalesce(*(F.when(rule == k, v[i]) for k, v in OUTCOMES.items()))
    unanchored = ~c("v.status").isin("valid", "valid_grouped") & (rule == c("v.reason"))
    floor = F.when(lifted | (rule == "representative"), LIFTED).when(rule == "grouped_review", LEAST)
    return [
        F.coalesce(named(0), F.when(unanchored, "filtered_target_anchor_validation"), F.lit("filtered")).alias("decision"), F.coalesce(named(1), rule).alias("reason"),
        F.when(lifted, kind).when(rule == "representative", "representative_work").otherwise(c("evidence_type")).alias("evidence_type"),
        F.when(lifted, F.when(kind == "limitation_or_negative", "negative").otherwise("neutral")).otherwise(c("stance")).alias("stance"),
        F.when(lifted & kind.isin("detailed_comparison", "limitation_or_negative"), "comparison").otherwise(c("mention_type")).alias("mention_type"),
        F.when(floor.isNotNull(), F.greatest(c("s.score"), floor)).when(rule == "saved", c("s.score")).alias("score"), F.when(floor.isNotNull(), "moderate").when(rule == "saved", c("s.strength")).alias("strength"), rule.isin(*FOR_REVIEW).alias("review"),
    ]


def promoted(findings: DataFrame, texts: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """What becomes of each finding: evidence_id, citation_text, expanded, anchor_status, anchor_reason, has_target, has_other, decision, reason, evidence_type, stance, mention_type, score, strength, review; with verdicts (evidence_id, more: the
    verdicts of templates) also those columns.

    findings: evidence_id, doc_id, citation_text, evidence_type, stance, mention_type, keep, reasoning, marker, aliases (array), title, self_citation_status, scope. texts: doc_id, text, one row for each.
    A quote that has no marker is widened to its sentence where that cites the target. score and strength are null unless the finding is saved. Nulls: an empty quote, title or reasoning, no aliases, keep is true, types and stances match no rule;
    a finding without a text is judged by its quote alone."""
    own = texts.select(c("doc_id").alias("t_doc"), F.coalesce("text", F.lit("")).alias("text"))
    empty = F.lit("")
    rows = findings.select(
        "evidence_id", "doc_id", "marker", "scope", F.coalesce("keep", F.lit(True)).alias("keep"), *(F.coalesce(x, empty).alias(x) for x in ("evidence_type", "stance", "mention_type", "reasoning", "title")), X.stripped(F.coalesce("citation_text", empty)).alias("__first"),
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce(c("self_citation_status") == "self_citation", F.lit(False)).alias("__self"),
    )
    rows = rows.join(own, c("doc_id") == c("t_doc"), "left").drop("t_doc").withColumn("text", F.coalesce("text", empty))
    number = F.regexp_replace(F.trim(F.coalesce("marker", empty)), r"^\[\s*|\s*\]$", "")
    norm = norm_title_alnum(c("__first"))
    bare = (number != "") & ~c("__first").rlike(r"\[[^\]]*\d+[^\]]*\]") & ~F.exists("aliases", lambda a: F.contains(norm, a))
    rows = rows.withColumn("__wide", F.when(bare, sentence_around(c("text"), c("__first"))))
    rows = rows.withColumn("__quote", F.when(A.has_marker(c("__wide"), number), c("__wide")).otherwise(c("__first")))
    rows = X.with_attribution(rows, "__quote").drop("text", "__wide", "attributed")
    rows = rows.withColumns({
        "v": A.validate_anchor(c("__quote"), c("marker"), c("aliases")), "__plain": plain(c("__quote")), "__upgrade": D.background_upgrade(c("__quote"), c("reasoning")), "__own_upgrade": D.background_upgrade(c("__quote"), empty),
        "s": downranked(score_finding(c("__quote"), c("evidence_type"), c("stance"), c("mention_type")), c("__self")),
    })
    out = rows.withColumn("rule", _rule()).select(
        "evidence_id", c("__quote").alias("citation_text"), (c("__quote") != c("__first")).alias("expanded"), c("v.status").alias("anchor_status"), c("v.reason").alias("anchor_reason"), c("v.has_target").alias("has_target"), c("v.has_other").alias("has_other"), *_outcome()
    )
    if verdicts is None:
        return out
    more = [x for x in verdicts.columns if x != "evidence_id"]
    return out.join(verdicts.select(c("evidence_id").alias("v_id"), *more), c("evidence_id") == c("v_id"), "left").select(*out.columns, *more)


def promotion_counts(decisions: DataFrame) -> DataFrame:
    """decision, reason, findings, review: how many findings end each way."""
    return decisions.groupBy("decision", "reason").agg(F.count(F.lit(1)).alias("findings"), F.count_if("review").alias("review"))
