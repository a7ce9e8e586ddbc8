"""Smaller steps around the queue, evidence and cards: gates, links, backfills, keepers, expansions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import identifiers as I
from citeloom.functions.names import canonical_quote_key, norm_title_alnum
from citeloom.operators.anchors import has_marker, target_keywords


def export_gate(include_all: bool = False) -> Column:
    """Which report rows an export takes: included ones with a valid anchor; all of them on demand."""
    return F.lit(True) if include_all else (F.col("recommendation") == "include") & (F.col("anchor_status") != "invalid") & F.col("has_target")


def download_links(publications: DataFrame) -> DataFrame:
    """publication_id, doi_url, landing_url, publisher, search_url."""
    p = I.publisher(F.col("doi"), F.lit(None).cast("string"))
    plain = I.doi_plain(F.col("doi"))
    search = F.concat(F.lit("https://scholar.google.com/scholar?q="), F.url_encode(F.coalesce("title", F.lit(""))))
    return publications.select("publication_id", F.when(plain != "", F.concat(F.lit("https://doi.org/"), plain)).otherwise("").alias("doi_url"), p["landing_url"].alias("landing_url"), p["publisher"].alias("publisher"), search.alias("search_url"))


def report_rows(rows: DataFrame) -> DataFrame:
    """One report row for each (session, quote in normal form): the best score, then the first, with the number of results it comes from."""
    w = Window.partitionBy("session_id", "key")
    out = rows.withColumn("key", canonical_quote_key(F.col("citation_text"))).where("key <> ''")
    return out.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("score"), F.asc("evidence_id"))), "seen": F.count(F.lit(1)).over(w)}).where("rank = 1").drop("rank", "key")


def card_keepers(cards: DataFrame) -> DataFrame:
    """Of cards with one (item, type, quote key) the one that a user edited stays, else the lowest id."""
    return cards.groupBy("item_id", "card_type", canonical_quote_key(F.col("quote")).alias("key")).agg(F.min_by("card_id", F.struct(~F.col("is_user_edited"), F.col("card_id"))).alias("card_id"), F.count(F.lit(1)).alias("copies"))


def backfilled_venues(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with the venue that an import tells where theirs is empty or unknown. found: citing_title, citing_venue; the first by name counts."""
    v = found.where("citing_venue <> ''").groupBy(norm_title_alnum(F.col("citing_title")).alias("f_title")).agg(F.min("citing_venue").alias("f_venue")).where("f_title <> ''")
    empty = F.lower(F.trim(F.coalesce("venue", F.lit("")))).isin("", "unknown")
    return rows.join(v, norm_title_alnum(F.col("title")) == F.col("f_title"), "left").withColumn("venue", F.when(empty, F.coalesce("f_venue", "venue")).otherwise(F.col("venue"))).drop("f_title", "f_venue")


def finding_reasons(evidence: DataFrame, results: DataFrame) -> DataFrame:
    """evidence_id with the reasoning of the first finding of its result that has its quote, type and stance. results: result_id, findings (JSON)."""
    kind = "array<struct<citation_text:string,evidence_type:string,stance:string,reasoning:string>>"
    r = results.select(F.col("result_id").alias("r_id"), F.from_json("findings", kind).alias("f"))
    rows = evidence.join(r, F.col("result_id") == F.col("r_id"), "left")
    same = lambda x: (x["citation_text"] == F.col("citation_text")) & (x["evidence_type"] == F.col("evidence_type")) & (x["stance"] == F.col("stance"))
    return rows.select("evidence_id", F.coalesce(F.try_element_at(F.filter("f", same), F.lit(1))["reasoning"], F.lit("")).alias("reason"))


def review_section(recommendation: Column, claim: Column, level: Column) -> Column:
    """Where a row goes on the review page."""
    return F.when((recommendation == "include") & (level == "strong"), "formal").when(claim == "limitation_feedback", "limitation").when(recommendation == "exclude", "excluded").otherwise("review")


def inbox_status(score: Column) -> Column:
    """What a drop-folder file's best match is worth."""
    return F.when(score >= 0.95, "matched").when(score >= 0.82, "candidate").otherwise("unmatched")


def paragraph_candidates(texts: DataFrame, targets: DataFrame, key: str = "doc_id", most: int = 20) -> DataFrame:
    """The paragraphs that best fit a target: 2 for each keyword, 8 for the title, 12 for the DOI; the first `most` by score and place. targets: key, title, doi."""
    t = targets.select(F.col(key).alias("t_key"), norm_title_alnum(F.col("title")).alias("tt"), target_keywords(F.col("title")).alias("tw"), F.lower("doi").alias("td"))
    p = texts.select(key, F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\n\s*\n|\n")).alias("pos", "paragraph")).join(t, F.col(key) == F.col("t_key"))
    n = norm_title_alnum(F.col("paragraph"))
    score = 2 * F.size(F.filter("tw", lambda w: F.contains(n, w))) + F.when((F.col("tt") != "") & F.contains(n, F.col("tt")), 8).otherwise(0) + F.when(F.contains(F.lower("paragraph"), F.col("td")), 12).otherwise(0)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), F.asc("pos")))
    return p.withColumn("score", score).where("score > 0").withColumn("rank", rank).where(F.col("rank") <= most).select(key, "pos", "score", "rank")


def marker_sentence(pieces: DataFrame, markers: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first sentence of each text that holds its marker. markers: key, marker."""
    m = markers.select(F.col(key).alias("m_key"), "marker")
    return pieces.join(m, F.col(key) == F.col("m_key")).where(has_marker(F.col("sentence"), F.col("marker"))).groupBy(key).agg(F.min_by("sentence", "pos").alias("sentence"), F.min("pos").alias("pos"))


def run_summary(outcomes: DataFrame, by: str) -> DataFrame:
    """Counts of a run's outcomes: analysed, failed, skipped by reason."""
    reasons = ["unsupported_pdf_status", "invalid_pdf_binding", "pdf_extract_not_ready", "missing_extracted_text"]
    n = lambda cond, name: F.count_if(F.coalesce(cond, F.lit(False))).alias(name)
    return outcomes.groupBy(by).agg(F.count(F.lit(1)).alias("items"), n(F.col("reason").isNull(), "analysed"), *(n(F.col("reason") == r, r) for r in reasons))


def asset_usage(assets: DataFrame, links: DataFrame, queue: DataFrame) -> DataFrame:
    """Each document of the pool with its first link, its number of links and of queue items that use it, and the citing title of the item changed last ('' without one).

    assets: asset_id, source_type, extract_status. links: link_id, asset_id, doi, raw_title. queue: item_id, asset_id, updated_at, citing_title; items without a document use none. Ids break ties; both sides are grouped by document before they are joined."""
    first = links.where("asset_id is not null").groupBy(F.col("asset_id").alias("l_asset")).agg(F.min_by(F.struct("doi", "raw_title"), "link_id").alias("link"), F.count(F.lit(1)).alias("links"))
    used = queue.where("asset_id is not null").groupBy(F.col("asset_id").alias("q_asset")).agg(F.count(F.lit(1)).alias("uses"), F.max_by("citing_title", F.struct("updated_at", "item_id")).alias("latest"))
    out = assets.join(first, F.col("asset_id") == F.col("l_asset"), "left").join(used, F.col("asset_id") == F.col("q_asset"), "left")
    number = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return out.select("asset_id", "source_type", "extract_status", "link.doi", "link.raw_title", number("links"), number("uses"), F.coalesce("latest", F.lit("")).alias("latest_citing_title"))


def pool_summary(usage: DataFrame, extracted: str = "extracted") -> DataFrame:
    """One row on the pool, of asset_usage: documents, extracted ones, links, and uses by queue items; zeros for an empty pool."""
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return usage.agg(F.count(F.lit(1)).alias("assets"), F.count_if(F.col("extract_status") == extracted).alias("extracted"), total("links").alias("links"), total("uses").alias("uses"))


def recent_assets(usage: DataFrame, most: int = 10) -> DataFrame:
    """The newest documents of asset_usage, the newest first: ids grow with time."""
    return usage.orderBy(F.desc("asset_id")).limit(most)
