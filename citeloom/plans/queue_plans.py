"""The queue (R1 to R3, P1, P2, P6 to P8, P13, T1, U2, A1, A3, A6, A14, A18); the flagship query is ranked_queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.operators import graph as G
from citeloom.operators import queue as Q

from .fixtures import Source

c = F.col
YEAR = 1998


def queue(s: Source):
    citing = s.fx_citing.select("publication_id", "title", "venue", "year", F.array("author").alias("citing_authors"), "queue_status")
    return Q.build_queue(G.joined_edges(s.fx_edge, s.fx_cited.select("publication_id", "title", "doi"), citing), s.fx_cited_author, YEAR)


QUEUE = f"""
    select e.session_id, e.cited_id, e.citing_id, e.pdf_readiness_status, b.year, b.queue_status, a.title as cited_title, b.title as citing_title,
           case when n.has is null then 'unknown' when s.cited_id is not null then 'self_citation' else 'not_self_citation' end as self_citation_status,
           case when n.has is null then 'ambiguous' when s.cited_id is not null then 'not_third_party' else 'third_party' end as third_party_status,
           case when lower(b.venue) like '%nature%' then 'A' when lower(b.venue) like '%journal%' or lower(b.venue) like '%proceedings%' then 'B' when b.venue <> '' then 'C' else 'unknown' end as venue_tier
    from fx_edge e join fx_cited a on a.publication_id = e.cited_id join fx_citing b on b.publication_id = e.citing_id
    left join (select distinct cited_id as has from fx_cited_author) n on n.has = e.cited_id
    left join fx_cited_author s on s.cited_id = e.cited_id and lower(s.author) = lower(b.author)"""
SCORE = f"""(case third_party_status when 'third_party' then 20.0 else 0 end + case self_citation_status when 'self_citation' then -25.0 else 0 end
      + case when pdf_readiness_status in ('manual_pdf', 'local_library_pdf') then 15.0 else 0 end + case venue_tier when 'A' then 10.0 when 'B' then 6.0 when 'C' then 3.0 else 0 end
      + case when year >= {YEAR - 1} then 5.0 when year >= {YEAR - 5} then 2.0 else 0 end)"""
Q0 = f"with q0 as ({QUEUE}), q as (select *, {SCORE} as priority_score from q0)"
POSITION = """row_number() over (partition by session_id order by priority_score desc, coalesce(year, 0) desc, case venue_tier when 'A' then 3 when 'B' then 2 when 'C' then 1 else 0 end desc,
      case pdf_readiness_status when 'manual_pdf' then 4 when 'reused_pdf' then 3 when 'local_library_pdf' then 2 when 'need_pdf' then 1 else 0 end desc, cited_id, citing_id)"""


def ranked_queue(s: Source):
    return Q.ranked(queue(s), YEAR).select("session_id", "cited_id", "citing_id", "self_citation_status", "third_party_status", "venue_tier", "priority_score", F.array_join(F.transform("reasons", lambda r: r["reason"]), "|").alias("reasons"), "position")


RANKED = f"""{Q0} select session_id, cited_id, citing_id, self_citation_status, third_party_status, venue_tier, priority_score,
    concat_ws('|', case third_party_status when 'third_party' then 'third_party_citation' when 'ambiguous' then 'ambiguous_third_party_status' end, case self_citation_status when 'self_citation' then 'self_citation_penalty' end,
      case when pdf_readiness_status in ('manual_pdf', 'local_library_pdf') then 'pdf_ready' end, case when venue_tier <> 'unknown' then 'venue_tier_' || lower(venue_tier) end,
      case when year >= {YEAR - 1} then 'recent_citing_paper' when year >= {YEAR - 5} then 'moderately_recent_citing_paper' end) as reasons, {POSITION} as position from q"""


def _with_review(s: Source):
    q = queue(s)
    reviewed = q.withColumn("user_review_status", F.when(c("citing_id") % 17 == 0, "rejected").when(c("citing_id") % 13 == 0, "important").otherwise("unreviewed"))
    return reviewed.withColumn("important", Q.is_important(c("user_review_status"), c("citing_id") % 29 == 0, c("cited_id") % 31 == 0, c("reasons")))


IMPORTANT = "case when citing_id % 17 = 0 then false when citing_id % 13 = 0 then true else citing_id % 29 = 0 or cited_id % 31 = 0 end"


def _views(s: Source):
    q = _with_review(s)
    rows = q.select("session_id", F.explode(F.array(*(F.when(f(), F.lit(name)) for name, f in Q.VIEWS.items()))).alias("view")).where("view is not null")
    return rows.groupBy("session_id", "view").agg(F.count(F.lit(1)).alias("n"))


VIEW_SQL = {
    "all": "true", "ready_only": "pdf_readiness_status <> 'need_pdf'", "need_pdf": "pdf_readiness_status = 'need_pdf'", "third_party_only": "third_party_status = 'third_party'", "exclude_self_citation": "self_citation_status <> 'self_citation'",
    "selected": "queue_status = 'selected'", "skipped": "queue_status = 'skipped'", "analyzed": "queue_status = 'analyzed'", "failed": "queue_status = 'failed'", "important": IMPORTANT,
}


def _rescored(s: Source):
    """Notable citing authors add 30 for each honour: every author whose nation key is a multiple of 4."""
    honours = s.nation.where(c("n_nationkey") % 4 == 0).select(c("n_name").alias("who"), F.array(F.struct(F.concat(F.lit("notable_author:"), "n_name").alias("reason"), F.lit(30.0).alias("delta"))).alias("extra"))
    extra = s.fx_edge.join(s.fx_citing.select(c("publication_id").alias("p"), "author"), c("citing_id") == c("p")).join(honours, c("author") == c("who")).select("cited_id", "citing_id", "extra")
    citing = s.fx_citing.select("publication_id", "title", "venue", "year", F.array("author").alias("citing_authors"), "queue_status")
    q = Q.build_queue(G.joined_edges(s.fx_edge, s.fx_cited.select("publication_id", "title", "doi"), citing), s.fx_cited_author, YEAR, extra)
    return q.select("cited_id", "citing_id", "priority_score", Q.is_important(F.lit("unreviewed"), F.lit(False), F.lit(False), c("reasons")).alias("important"))


def _dealt(s: Source) -> Source:
    """The same tables, citations dealt out by cited publication before they are joined and sorted, in as many parts as shuffles have: a part of a file is larger."""
    dealt = Source(s.spark, s.sf_dir)
    dealt.lineitem = s.lineitem.repartition(int(s.spark.conf.get("spark.sql.shuffle.partitions")), "l_partkey")
    return dealt


PLANS = {
    "ranked_queue": (ranked_queue, RANKED),
    "r1_self_citation": (lambda s: queue(s).groupBy("session_id", "self_citation_status", "third_party_status").agg(F.count(F.lit(1)).alias("n")), f"{Q0} select session_id, self_citation_status, third_party_status, count(*) as n from q group by 1, 2, 3"),
    "r3_notable_author_bonus": (
        _rescored,
        f"{Q0} select q.cited_id, q.citing_id, priority_score + case when n_nationkey is not null then 30.0 else 0 end as priority_score, n_nationkey is not null as important from q join fx_citing b on b.publication_id = q.citing_id left join nation on n_name = author and n_nationkey % 4 = 0",
    ),
    "p1_queue_views": (_views, Q0 + ", v as (" + " union all ".join(f"select session_id, '{n}' as view from q where {w}" for n, w in VIEW_SQL.items()) + ") select session_id, view, count(*) as n from v group by 1, 2"),
    "p2_important_items": (lambda s: _with_review(s).where("important").select("cited_id", "citing_id"), f"select cited_id, citing_id from fx_edge where {IMPORTANT}"),
    "p6_readiness": (
        lambda s: s.fx_edge.join(s.fx_asset.groupBy(c("publication_id").alias("p")).agg(F.min("source_type").alias("source_type")), c("cited_id") == c("p"), "left").select("cited_id", "citing_id", Q.readiness(c("source_type")).alias("status"), Q.attached_readiness(c("source_type"), c("citing_id") % 2 == 0).alias("attached")),
        "select cited_id, citing_id, case when t is null then 'need_pdf' when t = 'upload' then 'manual_pdf' when t = 'local_library' then 'local_library_pdf' else 'unavailable' end as status, case when t = 'local_library' then 'local_library_pdf' when citing_id % 2 = 0 then 'reused_pdf' else 'manual_pdf' end as attached from fx_edge left join (select publication_id, min(source_type) as t from fx_asset group by 1) a on a.publication_id = cited_id",
    ),
    "p7_blocking_reason": (
        lambda s: s.fx_asset.select("asset_id", Q.blocking_reason(F.when(c("asset_id") % 7 == 0, "need_pdf").otherwise("manual_pdf"), F.when(c("asset_id") % 5 != 0, c("asset_id")), c("extract_status"), F.when(c("asset_id") % 9 != 0, c("text"))).alias("reason"), Q.analysis_readiness(F.when(c("asset_id") % 5 != 0, c("asset_id")), c("extract_status") == "extracted").alias("readiness")),
        "select asset_id, case when asset_id % 7 = 0 then 'unsupported_pdf_status' when asset_id % 5 = 0 then 'invalid_pdf_binding' when extract_status <> 'extracted' then 'pdf_extract_not_ready' when asset_id % 9 = 0 or trim(text) = '' then 'missing_extracted_text' end as reason, case when asset_id % 5 = 0 then 'need_pdf' when extract_status <> 'extracted' then 'need_extracted_text' else 'ready' end as readiness from fx_asset",
    ),
    "p8_selected_ready": (lambda s: Q.selected_ready(queue(s)).select("session_id", "cited_id", "citing_id"), f"{Q0} select session_id, cited_id, citing_id from q where queue_status = 'selected' and pdf_readiness_status <> 'need_pdf'"),
    "t1_queue_top": (lambda s: Q.top(queue(s), 20).select("session_id", "position", "cited_id", "citing_id"), f"{Q0} select session_id, position, cited_id, citing_id from (select *, {POSITION} as position from q) where position <= 20"),
    "u2_queue_rebuild": (
        lambda s: Q.rebuild(queue(s), s.fx_edge.where("citing_id % 4 = 0").select("cited_id", "citing_id", F.lit("skipped").alias("queue_status"), F.when(c("citing_id") % 8 == 0, "important").alias("user_review_status"), F.concat(F.lit("note "), "citing_id").alias("user_note"))).select("cited_id", "citing_id", "queue_status", "user_review_status", "user_note"),
        "select e.cited_id, e.citing_id, case when citing_id % 4 = 0 then 'skipped' else queue_status end as queue_status, case when citing_id % 8 = 0 then 'important' else 'unreviewed' end as user_review_status, case when citing_id % 4 = 0 then 'note ' || citing_id else '' end as user_note from fx_edge e join fx_citing on publication_id = citing_id",
    ),
    "a1_queue_summary": (
        lambda s: Q.summary(queue(s)),
        f"{Q0} select session_id, count(*) as total, count(*) filter (pdf_readiness_status <> 'need_pdf') as ready, count(*) filter (pdf_readiness_status = 'need_pdf') as need_pdf, count(*) filter (queue_status = 'selected') as selected, count(*) filter (queue_status = 'analyzed') as analyzed, count(*) filter (queue_status = 'failed') as failed, count(*) filter (third_party_status = 'third_party') as third_party, count(*) filter (self_citation_status = 'self_citation') as self_citation from q group by 1",
    ),
    "a3_workflow_stats": (
        lambda s: s.fx_cited.groupBy("session_id").agg(F.count(F.lit(1)).alias("publications"), F.count_if(c("doi").isNotNull()).alias("with_doi")).join(Q.edge_counts(_dealt(s).fx_edge), "session_id", "left"),
        "select p.*, edges, citing, ready from (select session_id, count(*) as publications, count(doi) as with_doi from fx_cited group by 1) p left join (select session_id, count(*) as edges, count(distinct citing_id) as citing, count(*) filter (pdf_readiness_status <> 'need_pdf') as ready from fx_edge group by 1) e using (session_id)",
    ),
    "a6_external_edges": (
        lambda s: s.fx_edge.groupBy("session_id").agg(F.count_if(c("n_rows") > 1).alias("repeated"), F.count_if(c("citing_id") % 10 == 0).alias("external")),
        "select session_id, count(*) filter (n_rows > 1) as repeated, count(*) filter (citing_id % 10 = 0) as external from fx_edge group by 1",
    ),
    "a14_expansion_summary": (
        lambda s: s.fx_edge.groupBy("session_id", "cited_id").agg(F.count(F.lit(1)).alias("fetched"), F.sum("n_rows").alias("cited_by")).groupBy("session_id").agg(F.sum("fetched").alias("fetched"), F.sum("cited_by").alias("cited_by"), F.count_if(c("fetched") >= c("cited_by")).alias("complete"), F.count_if(c("fetched") < c("cited_by")).alias("incomplete")),
        "select session_id, cast(sum(f) as bigint) as fetched, cast(sum(b) as bigint) as cited_by, count(*) filter (f >= b) as complete, count(*) filter (f < b) as incomplete from (select session_id, cited_id, count(*) as f, sum(n_rows) as b from fx_edge group by 1, 2) group by 1",
    ),
    "a18_document_counts": (
        lambda s: s.fx_edge.groupBy("session_id").agg(F.count_if(Q.is_ready(c("pdf_readiness_status"))).alias("ready"), F.count_if(~Q.is_ready(c("pdf_readiness_status"))).alias("need")),
        "select session_id, count(*) filter (pdf_readiness_status <> 'need_pdf') as ready, count(*) filter (pdf_readiness_status = 'need_pdf') as need from fx_edge group by 1",
    ),
}
