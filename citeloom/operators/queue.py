"""The queue of citing works: who cites, how ready the text is, how it ranks and why."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.names import norm_title_ws, venue_tier
from citeloom.rounds import numbered

READY = ("manual_pdf", "reused_pdf", "local_library_pdf")
# What each finding adds to a priority.
TIER_SCORES = {"A": 10.0, "B": 6.0, "C": 3.0}


def is_ready(status: Column) -> Column:
    return F.coalesce(status.isin(*READY), F.lit(False))


def readiness(source_type: Column) -> Column:
    """need_pdf without a document, else by the kind of its source."""
    return F.when(source_type.isNull(), "need_pdf").when(source_type == "upload", "manual_pdf").when(source_type == "local_library", "local_library_pdf").otherwise("unavailable")


def attached_readiness(source_type: Column, reused: Column) -> Column:
    return F.when(source_type == "local_library", "local_library_pdf").when(reused, "reused_pdf").otherwise("manual_pdf")


def blocking_reason(status: Column, asset_id: Column, extract_status: Column, text: Column) -> Column:
    """Why an item can't be analysed yet, the first reason that holds; null where it can."""
    return (
        F.when(~is_ready(status), "unsupported_pdf_status")
        .when(asset_id.isNull(), "invalid_pdf_binding")
        .when(F.coalesce(extract_status, F.lit("")) != "extracted", "pdf_extract_not_ready")
        .when(F.trim(F.coalesce(text, F.lit(""))) == "", "missing_extracted_text")
    )


def analysis_readiness(asset_id: Column, extracted: Column) -> Column:
    return F.when(asset_id.isNull(), "need_pdf").when(~F.coalesce(extracted, F.lit(False)), "need_extracted_text").otherwise("ready")


def normal_names(authors: Column) -> Column:
    """A list of names in normal form; a null list is empty."""
    return F.filter(F.transform(F.coalesce(authors, F.array().cast("array<string>")), lambda x: norm_title_ws(x)), lambda x: x.isNotNull())


def citation_status(cited_authors: Column, citing_authors: Column) -> Column:
    """struct(self_citation_status, third_party_status) from two lists of names, compared in normal form."""
    return status_of_names(normal_names(cited_authors), normal_names(citing_authors))


def status_of_names(a: Column, b: Column) -> Column:
    """citation_status of two lists of names in normal form."""
    row = lambda s, t: F.struct(F.lit(s).alias("self_citation_status"), F.lit(t).alias("third_party_status"))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), row("unknown", "ambiguous")).when(F.arrays_overlap(a, b), row("self_citation", "not_third_party")).otherwise(row("not_self_citation", "third_party"))


def priority_reasons(as_of_year: int, extra: Column | None = None) -> Column:
    """The findings that make up an item's priority, array<struct<reason, delta>>; extra: more of them, such as matched templates or notable authors."""
    say = lambda cond, reason, delta: F.when(cond, F.struct(reason.alias("reason"), F.lit(float(delta)).alias("delta")))
    c, lit = F.col, F.lit
    year = F.coalesce(c("year"), lit(0))
    parts = [
        say(c("third_party_status") == "third_party", lit("third_party_citation"), 20),
        say(c("third_party_status") == "ambiguous", lit("ambiguous_third_party_status"), 0),
        say(c("self_citation_status") == "self_citation", lit("self_citation_penalty"), -25),
        say(c("self_citation_status") == "possible_self_citation", lit("possible_self_citation_penalty"), -10),
        say(is_ready(c("pdf_readiness_status")), lit("pdf_ready"), 15),
        *(say(c("venue_tier") == t, lit(f"venue_tier_{t.lower()}"), d) for t, d in TIER_SCORES.items()),
        say((year > 0) & (year >= as_of_year - 1), lit("recent_citing_paper"), 5),
        say((year > 0) & (year < as_of_year - 1) & (year >= as_of_year - 5), lit("moderately_recent_citing_paper"), 2),
        say(c("user_review_status") == "important", lit("user_marked_important"), 100),
        say(c("user_review_status") == "rejected", lit("user_rejected"), -100),
        say(c("queue_status") == "skipped", lit("queue_skipped"), -50),
    ]
    own = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return own if extra is None else F.concat(own, F.coalesce(extra, F.array().cast("array<struct<reason:string,delta:double>>")))


def priority(reasons: Column) -> Column:
    return F.aggregate(reasons, F.lit(0.0), lambda s, r: s + r["delta"])


def build_queue(edges: DataFrame, cited_authors: DataFrame, as_of_year: int, extra: DataFrame | None = None) -> DataFrame:
    """Joined edges as scored queue items.

    cited_authors: cited_id, author. extra: cited_id, citing_id, extra (array of reasons). Authors are grouped and brought to their normal form per publication before the join, so an edge
    never multiplies, nor does that work. An edge's venue is its tier before that join: what is left out of the queue then goes through no exchange.
    """
    names = cited_authors.groupBy(F.col("cited_id").alias("n_cited")).agg(normal_names(F.collect_set("author")).alias("cited_authors"))
    rows = edges.withColumn("venue_tier", venue_tier(F.col("venue"))).join(names, F.col("cited_id") == F.col("n_cited"), "left").drop("n_cited")
    rows = rows.withColumn("status", status_of_names(F.coalesce("cited_authors", F.array().cast("array<string>")), normal_names(F.col("citing_authors")))).select("*", "status.self_citation_status", "status.third_party_status")
    rows = rows.withColumn("user_review_status", F.lit("unreviewed") if "user_review_status" not in rows.columns else F.col("user_review_status"))
    if extra is not None:
        rows = rows.join(extra.select(F.col("cited_id").alias("x_cited"), F.col("citing_id").alias("x_citing"), "extra"), (F.col("cited_id") == F.col("x_cited")) & (F.col("citing_id") == F.col("x_citing")), "left").drop("x_cited", "x_citing")
    return rows.withColumn("reasons", priority_reasons(as_of_year, F.col("extra") if extra is not None else None)).withColumn("priority_score", priority(F.col("reasons"))).drop("status", "cited_authors")


def queue_order() -> list[Column]:
    """Priority, year, venue tier, readiness, then the ids."""
    rank = lambda c, order: reduce(lambda w, kv: w.when(F.col(c) == kv[0], kv[1]), order.items(), F.when(F.lit(False), 0)).otherwise(0)
    return [
        F.desc("priority_score"),
        F.coalesce(F.col("year"), F.lit(0)).desc(),
        rank("venue_tier", {"A": 3, "B": 2, "C": 1}).desc(),
        rank("pdf_readiness_status", {"manual_pdf": 4, "reused_pdf": 3, "local_library_pdf": 2, "need_pdf": 1}).desc(),
        F.asc("cited_id"),
        F.asc("citing_id"),
    ]


#: What the order of a queue and the findings of priority_reasons are made of.
RANKING = ("session_id", "cited_id", "citing_id", "self_citation_status", "third_party_status", "venue_tier", "year", "pdf_readiness_status", "queue_status", "user_review_status", "priority_score")


def ranked(queue: DataFrame, as_of_year: int | None = None) -> DataFrame:
    """queue with its position in each session. With as_of_year, that of a queue built without extra reasons: the columns of RANKING and reasons, which are made again from these: written and dealt out, they would take most of the disk."""
    if as_of_year is None:
        return numbered(queue, "session_id", queue_order(), "position")
    return numbered(queue.select(*RANKING), "session_id", queue_order(), "position").withColumn("reasons", priority_reasons(as_of_year))


def top(queue: DataFrame, n: int) -> DataFrame:
    """The first n rows of each session, with their position. Each task keeps its own first n of a session, so few rows meet in one window."""
    return queue.withColumn("position", F.row_number().over(Window.partitionBy("session_id").orderBy(*queue_order()))).where(F.col("position") <= n)


def is_important(review: Column, flag: Column, annotated: Column, reasons: Column) -> Column:
    """Rejection blocks; a review, the item's own flag, an annotation or a notable author's reason makes important."""
    noted = F.exists(F.coalesce(reasons, F.array().cast("array<struct<reason:string,delta:double>>")), lambda r: F.coalesce(r["reason"].startswith("notable_author:"), F.lit(False)))
    yes = F.coalesce(flag, F.lit(False)) | F.coalesce(annotated, F.lit(False)) | noted
    return F.when(review.isin("rejected", "false_positive"), F.lit(False)).when(review == "important", F.lit(True)).otherwise(yes)


VIEWS = {
    "all": lambda: F.lit(True),
    "ready_only": lambda: is_ready(F.col("pdf_readiness_status")),
    "need_pdf": lambda: F.col("pdf_readiness_status") == "need_pdf",
    "third_party_only": lambda: F.col("third_party_status") == "third_party",
    "exclude_self_citation": lambda: F.col("self_citation_status") != "self_citation",
    "selected": lambda: F.col("queue_status") == "selected",
    "skipped": lambda: F.col("queue_status") == "skipped",
    "analyzed": lambda: F.col("queue_status") == "analyzed",
    "failed": lambda: F.col("queue_status") == "failed",
    "important": lambda: F.col("important"),
}


def view(queue: DataFrame, name: str) -> DataFrame:
    """The rows of a named view; an unknown name shows all."""
    return queue.where(VIEWS.get(name, VIEWS["all"])())


def rebuild(queue: DataFrame, previous: DataFrame) -> DataFrame:
    """A new queue that keeps what users set in the previous one: status, review, note."""
    old = previous.select(F.col("cited_id").alias("o_cited"), F.col("citing_id").alias("o_citing"), *(F.col(c).alias(f"o_{c}") for c in ("queue_status", "user_review_status", "user_note")))
    out = queue.join(old, (F.col("cited_id") == F.col("o_cited")) & (F.col("citing_id") == F.col("o_citing")), "left")
    keep = {c: F.coalesce(F.col(f"o_{c}"), F.col(c) if c in queue.columns else F.lit(d)) for c, d in (("queue_status", "pending"), ("user_review_status", "unreviewed"), ("user_note", ""))}
    return out.withColumns(keep).drop("o_cited", "o_citing", *(f"o_{c}" for c in keep))


def edge_counts(edges: DataFrame) -> DataFrame:
    """session_id, edges, citing, ready: edges, distinct citing publications and ready edges of each session. Edges are dealt out by session and citing publication before they are grouped, into as many parts as the session's shuffles have: nearly each has a group of its
    own, which a task would otherwise hold for all its edges beside their sort, and parts of a set number are not put together again."""
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = edges.select("session_id", "citing_id", is_ready(F.col("pdf_readiness_status")).alias("ready")).repartition(n, "session_id", "citing_id")
    each = each.groupBy("session_id", "citing_id").agg(F.count(F.lit(1)).alias("edges"), F.count_if("ready").alias("ready"))
    return each.groupBy("session_id").agg(F.sum("edges").alias("edges"), F.count("citing_id").alias("citing"), F.sum("ready").alias("ready"))


def summary(queue: DataFrame) -> DataFrame:
    """Counts of each session's queue."""
    n = lambda cond, name: F.count_if(cond).alias(name)
    return queue.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total"),
        n(is_ready(F.col("pdf_readiness_status")), "ready"),
        n(F.col("pdf_readiness_status") == "need_pdf", "need_pdf"),
        n(F.col("queue_status") == "selected", "selected"),
        n(F.col("queue_status") == "analyzed", "analyzed"),
        n(F.col("queue_status") == "failed", "failed"),
        n(F.col("third_party_status") == "third_party", "third_party"),
        n(F.col("self_citation_status") == "self_citation", "self_citation"),
    )


def selected_ready(queue: DataFrame) -> DataFrame:
    return queue.where((F.col("queue_status") == "selected") & is_ready(F.col("pdf_readiness_status")))


def template_match_text(items: DataFrame) -> DataFrame:
    """session_id, cited_id, citing_id and the text in which templates look for their terms: titles, venue, authors, contexts and target title of an item, nulls as nothing."""
    text = lambda x: F.coalesce(x, F.lit(""))
    parts = F.concat(F.array(text("citing_title"), text("cited_title"), text("venue"), F.array_join("authors", ", ")), F.coalesce("contexts", F.array().cast("array<string>")), F.array(text("target_title")))
    return items.select("session_id", "cited_id", "citing_id", F.array_join(parts, " ").alias("text"))
