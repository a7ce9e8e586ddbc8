"""Evidence: scores, promotion, review, deduplication, the latest results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.names import norm_title_alnum, norm_title_ws, unaccented

# Evidence types that count as strong, mentions that count as weak.
STRONG_TYPES = (
    "first_or_seminal_claim", "detailed_comparison", "baseline_or_benchmark", "method_foundation", "theoretical_foundation", "application_extension",
    "positive_evaluation", "limitation_or_negative", "adopted_or_combined", "state_of_the_art_claim", "important_author_citation", "long_context_citation",
)
WEAK_MENTIONS = ("weak_mention", "background_mention", "passing_mention", "reference_only")
# How claim types rank when one quote has several.
CLAIM_PRIORITY = {
    "first_or_seminal_claim": 100, "submm_precision_claim": 90, "detailed_comparison": 85, "through_wall_eavesdropping": 80, "baseline_or_benchmark": 75, "rfid_loudspeaker_vibration": 70, "positive_evaluation": 65, "performance_comparison": 60,
    "custom_template_evidence": 55, "method_use": 50, "capability_recognition": 40, "method_summary": 35, "capability_summary": 35, "limitation_feedback": 30, "ordinary_reference": 20, "false_positive": 0,
}


def strength(score: Column) -> Column:
    return F.when(score >= 0.8, "strong").when(score >= 0.6, "moderate").otherwise("weak")


def score_finding(quote: Column, kind: Column, stance: Column, mention: Column) -> Column:
    """struct(score, strength) of a finding. The additions keep their order, for their sum is held against thresholds."""
    row = lambda s, t: F.struct(F.lit(s).alias("score"), F.lit(t).alias("strength"))
    text = F.coalesce(quote, F.lit(""))
    total = F.lit(0.5) + F.when(kind.isin(*STRONG_TYPES), 0.25).otherwise(0.0) + F.when(stance.isin("positive", "mixed"), 0.1).otherwise(0.0) + F.when(F.length(text) >= 80, 0.05).otherwise(0.0)
    return (
        F.when(text == "", row(0.0, "none"))
        .when(mention == "grouped_citation", row(0.25, "weak"))
        .when(mention == "reference_only", row(0.0, "none"))
        .when(mention.isin(*WEAK_MENTIONS), row(0.35, "weak"))
        .otherwise(F.struct(total.alias("score"), strength(total).alias("strength")))
    )


def downranked(scored: Column, is_self: Column) -> Column:
    """A self-citation's score is lower by 0.2, zero at least."""
    lower = F.greatest(F.lit(0.0), F.round(scored["score"] - 0.2, 4))
    return F.when(is_self, F.struct(lower.alias("score"), strength(lower).alias("strength"))).otherwise(scored)


def with_scores(evidence: DataFrame) -> DataFrame:
    """evidence with score and strength, self-citations downranked."""
    s = score_finding(F.col("citation_text"), F.col("evidence_type"), F.col("stance"), F.col("mention_type"))
    return evidence.withColumn("s", downranked(s, F.coalesce(F.col("self_citation_status") == "self_citation", F.lit(False)))).select(*evidence.columns, F.col("s.score").alias("score"), F.col("s.strength").alias("strength"))


# Words that make a quote evidence of a type, in order of precedence; the words that make it negative; what types are positive, comparisons or uses of a method.
SUPPORTED = (
    ("first_or_seminal_claim", ("first", "seminal", "pioneer", "pioneering")),
    ("detailed_comparison", ("detailed comparison", "compare", "compared", "comparison")),
    ("baseline_or_benchmark", ("baseline", "benchmark")),
    ("method_foundation", ("method foundation", "methodological foundation", "builds on", "based on")),
    ("theoretical_foundation", ("theoretical foundation", "theory", "theoretical")),
    ("application_extension", ("extend", "extension", "application")),
    ("positive_evaluation", ("positive", "effective", "accurate", "robust", "high precision", "important")),
    ("limitation_or_negative", ("limitation", "negative", "fail", "weakness")),
)
POSITIVE_TYPES, COMPARISONS, USES = ("positive_evaluation", "method_foundation", "first_or_seminal_claim"), ("detailed_comparison", "baseline_or_benchmark"), ("method_foundation", "theoretical_foundation")


def inferred(text: Column, cited_title: Column | None = None) -> Column:
    """struct(evidence_type, stance, mention_type) from words of a quote, which may be parts of longer ones; the first type wins, without any it is null. The default scorer of batch inference.

    Texts are compared in plain lower-case ASCII with single spaces. A quote that holds the cited title is an explicit mention; an empty title is in every quote, and without a title mentions follow the type alone."""
    plain = lambda x: norm_title_ws(F.regexp_replace(unaccented(F.coalesce(x, F.lit(""))), r"[^\x00-\x7F]", ""))
    # the normal form is made once: a list of one quote
    quotes = F.array(F.struct(plain(text).alias("q"), (F.lit(None).cast("string") if cited_title is None else plain(cited_title)).alias("title")))
    any_of = lambda q, words: F.coalesce(*(F.when(F.contains(q, F.lit(w)), F.lit(True)) for w in words), F.lit(False))
    typed = F.transform(quotes, lambda x: F.struct(x["q"].alias("q"), x["title"].alias("title"), F.coalesce(*(F.when(any_of(x["q"], words), F.lit(kind)) for kind, words in SUPPORTED)).alias("kind")))
    negative = dict(SUPPORTED)["limitation_or_negative"]

    def judged(x: Column) -> Column:
        stance = F.when(any_of(x["q"], negative), "negative").when(x["kind"].isin(*POSITIVE_TYPES), "positive").otherwise("neutral")
        mention = F.when(F.contains(x["q"], x["title"]), "explicit_target").when(x["kind"].isin(*COMPARISONS), "comparison").when(x["kind"].isin(*USES), "method_use").otherwise("other")
        return F.struct(x["kind"].alias("evidence_type"), stance.alias("stance"), mention.alias("mention_type"))

    return F.get(F.transform(typed, judged), F.lit(0))


VIEWS = {
    "all": lambda: F.lit(True),
    "unreviewed": lambda: F.col("review_status") == "unreviewed",
    "accepted": lambda: F.col("review_status") == "accepted",
    "rejected": lambda: F.col("review_status") == "rejected",
    "false_positive": lambda: F.col("review_status") == "false_positive",
    "positive": lambda: F.col("stance") == "positive",
    "high_strength": lambda: F.col("strength") == "strong",
    "third_party_only": lambda: F.col("third_party_status") == "third_party",
    "exclude_self_citation": lambda: F.col("self_citation_status") != "self_citation",
}


def view(evidence: DataFrame, name: str) -> DataFrame:
    """A named view; any other name is an evidence type."""
    return evidence.where(VIEWS[name]() if name in VIEWS else F.col("evidence_type") == name)


def eligible(evidence: DataFrame) -> DataFrame:
    """Evidence that may become a card: with a quote, not refused."""
    return evidence.where((F.trim(F.coalesce("citation_text", F.lit(""))) != "") & ~F.coalesce(F.col("review_status").isin("rejected", "false_positive"), F.lit(False)))


def card_order() -> list[Column]:
    """Important, accepted, score, then id."""
    return [(F.col("review_status") == "important").desc(), (F.col("review_status") == "accepted").desc(), F.desc("score"), F.asc("evidence_id")]


def quality_summary(evidence: DataFrame) -> DataFrame:
    n = lambda cond, name: F.count_if(cond).alias(name)
    c = F.col
    return evidence.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total"), *(n(c("review_status") == s, s) for s in ("unreviewed", "accepted", "rejected", "false_positive")), n(c("third_party_status") == "third_party", "third_party"),
        n(c("self_citation_status") == "self_citation", "self_citation"), *(n(c("strength") == s, s) for s in ("strong", "moderate", "weak")),
    )


def upserted(evidence: DataFrame, new: DataFrame) -> DataFrame:
    """Evidence by (item, type, stance, mention, quote): new scores replace old ones, what users set stays. Nulls in the key are equal."""
    keys = ("item_id", "evidence_type", "stance", "mention_type", "citation_text")
    old = evidence.groupBy(*keys).agg(F.min_by(F.struct("evidence_id", "review_status", "score"), "evidence_id").alias("o")).select(*(F.col(k).alias(f"o_{k}") for k in keys), "o")
    fresh = new.groupBy(*keys).agg(F.max_by("score", "evidence_id").alias("n_score"), F.min("evidence_id").alias("n_id"))
    same = None
    for k in keys:
        cond = F.col(k).eqNullSafe(F.col(f"o_{k}"))
        same = cond if same is None else same & cond
    joined = fresh.join(old, same, "full")
    return joined.select(*(F.coalesce(k, f"o_{k}").alias(k) for k in keys), F.coalesce("o.evidence_id", "n_id").alias("evidence_id"), F.coalesce("o.review_status", F.lit("unreviewed")).alias("review_status"), F.coalesce("n_score", "o.score").alias("score"))


def strongest(evidence: DataFrame) -> DataFrame:
    """One row for each (item, marker, quote in normal form): the best recommendation, then claim, then the first; with the number it stands for and the place of the first."""
    ranks = F.create_map(*(F.lit(x) for kv in CLAIM_PRIORITY.items() for x in kv))
    rec = F.when(F.col("recommendation") == "include", 2).when(F.col("recommendation") == "review", 1).otherwise(0)
    key = ["item_id", "marker", "quote_key"]
    rows = evidence.withColumn("quote_key", norm_title_alnum(F.col("citation_text")))
    w = Window.partitionBy(*key)
    rows = rows.withColumns({"rank": F.row_number().over(w.orderBy(rec.desc(), F.coalesce(ranks[F.col("claim_type")], F.lit(0)).desc(), F.asc("ordinal"))), "first_ordinal": F.min("ordinal").over(w), "copies": F.count(F.lit(1)).over(w)})
    return rows.where("rank = 1").drop("rank", "quote_key")


def strong_clusters(evidence: DataFrame) -> DataFrame:
    """Included rows one for each (item, marker, claim, template ids), with the cluster's size; the others pass as they are."""
    rows = evidence.where("recommendation = 'include'").withColumn("ids", F.array_join(F.array_sort("template_ids"), ","))
    w = Window.partitionBy("item_id", "marker", "claim_type", "ids")
    kept = rows.withColumns({"cluster_size": F.count(F.lit(1)).over(w), "rank": F.row_number().over(w.orderBy("ordinal"))}).where("rank = 1").drop("rank", "ids")
    return kept.unionByName(evidence.where("recommendation <> 'include' or recommendation is null").withColumn("cluster_size", F.lit(1).cast("long")))


def latest_results(results: DataFrame, scope: str | None = None) -> DataFrame:
    """Each item's latest successful result, of one scope on demand: by time, then by id."""
    rows = results.where("status = 'success'") if scope is None else results.where((F.col("status") == "success") & (F.col("scope") == scope))
    return rows.groupBy("item_id").agg(F.max_by("result_id", F.struct("created_at", "result_id")).alias("result_id"), F.count(F.lit(1)).alias("n_results"))


def of_latest(evidence: DataFrame, latest: DataFrame) -> DataFrame:
    """The evidence of each item's latest result; items without one keep all."""
    l = latest.select(F.col("item_id").alias("l_item"), F.col("result_id").alias("l_result"))  # noqa: E741
    return evidence.join(l, F.col("item_id") == F.col("l_item"), "left").where(F.col("l_result").isNull() | (F.col("result_id") == F.col("l_result"))).drop("l_item", "l_result")


def reason_codes() -> Column:
    """Stable codes of why a piece of direct evidence fell short, in a fixed order, each once."""
    c = F.col
    say = lambda cond, code: F.when(cond, F.lit(code))
    parts = [
        say(c("reference_match_status") == "mismatch", "reference_mismatch"),
        say(~c("has_target"), "target_marker_missing"),
        say(c("template_match_level") == "candidate", "template_candidate_requires_review"),
        say(c("claim_type") == "ordinary_reference", "ordinary_reference"),
        say((c("claim_type") == "limitation_feedback") & ~c("negative_template"), "limitation_feedback_not_positive"),
        say(c("original_recommendation") == "exclude", "llm_recommended_exclude"),
    ]
    codes = F.array_distinct(F.filter(F.array(*parts), lambda x: x.isNotNull()))
    return F.when((F.size(codes) == 0) & (c("recommendation") != "include"), F.array(F.lit("template_goal_not_satisfied"))).otherwise(codes)


def template_eligible() -> Column:
    """A verified candidate without a blocking code."""
    blocking = F.array(F.lit("reference_mismatch"), F.lit("target_marker_missing"), F.lit("reference_only"))
    return F.col("has_target") & ~F.arrays_overlap("codes", blocking)


def direct_counts(evidence: DataFrame) -> DataFrame:
    """Counts of each session's direct evidence."""
    c = F.col
    n = lambda cond, name: F.count_if(F.coalesce(cond, F.lit(False))).alias(name)
    inc = c("recommendation") == "include"
    return evidence.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total"), n(inc, "include"), n(c("recommendation") == "review", "review"), n(c("recommendation") == "exclude", "exclude"), n(c("has_target"), "aligned"), n(c("reference_match_status") == "unresolved", "unresolved"),
        n(template_eligible(), "eligible"), n(c("template_match_level") == "strong", "matched"), n(inc & c("has_target"), "verified"), n(inc & c("has_target") & (c("claim_type") != "ordinary_reference"), "verified_substantive"),
    )


def stale_split(evidence: DataFrame, current: DataFrame) -> DataFrame:
    """Generated evidence that its result no longer holds: deleted, or demoted to weak where a user touched it; the rest kept. current: result_id, evidence_id."""
    cur = current.select(F.col("evidence_id").alias("cur")).distinct()
    rows = evidence.join(cur, F.col("evidence_id") == F.col("cur"), "left")
    touched = F.col("review_status") != "unreviewed"
    return rows.withColumn("action", F.when(F.col("cur").isNotNull(), "keep").when(touched, "demote").otherwise("delete")).drop("cur")


def evidence_order() -> list[Column]:
    """What users marked as important, then by score, then by id."""
    return [(F.col("review_status") == "important").desc(), F.round("score", 9).desc(), F.asc("evidence_id")]
