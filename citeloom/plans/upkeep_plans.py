"""Smaller operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citeloom.operators import anchors as A
from citeloom.operators import evidence as E
from citeloom.operators import matching as M
from citeloom.operators import queue as Q
from citeloom.operators import upkeep as K
from citeloom.rounds import numbered

from .evidence_plans import DIRECT, SCORED, direct, scored
from .fixtures import Source
from .matching_plans import HONOUR, _scores, honours

c = F.col
NORM = r"trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
QKEY = f"substring({NORM.format('strip_accents(citation_text)')}, 1, 220)"


def _reasons(s: Source):
    k = c("asset_id")
    return s.fx_asset.select("source_type", Q.blocking_reason(F.when(k % 7 == 0, "need_pdf").otherwise("manual_pdf"), F.when(k % 5 != 0, k), c("extract_status"), F.when(k % 9 != 0, c("text"))).alias("reason"))


def _findings(s: Source):
    e = s.fx_evidence
    one = F.struct("citation_text", "evidence_type", "stance", F.concat(F.lit("because "), "evidence_id").alias("reasoning"))
    other = F.struct(F.lit("x").alias("citation_text"), "evidence_type", "stance", F.lit("no").alias("reasoning"))
    return K.finding_reasons(e.withColumn("result_id", c("evidence_id")), e.where("evidence_id % 4 <> 0").select(c("evidence_id").alias("result_id"), F.to_json(F.array(other, one)).alias("findings")))


def _inbox(s: Source):
    """Drop-folder files with the DOI of a queue item, or a title near one's, or neither."""
    k = c("publication_id")
    return s.fx_cited.select((k * 2).alias("file_id"), F.when(k % 3 == 0, F.upper("doi")).alias("doi"), F.when(k % 3 == 1, F.concat("title", F.lit(" x"))).otherwise(F.reverse("title")).alias("title"))


def _usage(s: Source):
    """Documents with up to two links, used by the queue items of a table of events."""
    one = lambda n: s.fx_asset.where(c("asset_id") % (n + 1) == 0).select((c("asset_id") * 2 + n).alias("link_id"), "asset_id", (c("publication_id") + n).alias("p"))
    links = one(0).unionByName(one(1)).join(s.fx_cited.select(c("publication_id").alias("p"), "doi", c("title").alias("raw_title")), "p")
    return K.asset_usage(s.fx_asset, links, s.events.select(c("event_id").alias("item_id"), c("user_id").alias("asset_id"), c("ts").alias("updated_at"), c("event_type").alias("citing_title")))


USAGE = """l as (select asset_id * 2 as link_id, asset_id, publication_id as p from fx_asset union all select asset_id * 2 + 1, asset_id, publication_id + 1 from fx_asset where asset_id % 2 = 0),
    l1 as (select asset_id, arg_min({'d': doi, 't': title}, link_id) as f, count(*) as links from l join fx_cited on publication_id = p group by 1),
    q as (select user_id as asset_id, count(*) as uses, arg_max(event_type, {'a': ts, 'b': event_id}) as latest from events where user_id is not null group by 1),
    us as (select asset_id, source_type, extract_status, f.d as doi, f.t as raw_title, coalesce(links, 0) as links, coalesce(uses, 0) as uses, coalesce(latest, '') as latest_citing_title from fx_asset left join l1 using (asset_id) left join q using (asset_id))"""

PLANS = {
    "a4_honour_summary": (lambda s: honours(s).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("items")), None),
    "a4_summary_rule": (lambda s: M.honour_decisions(_scores(s)).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("items")), f"select status, count(*) as n, count(distinct item_id) as items from ({HONOUR}) group by 1"),
    "a11_run_summary": (
        lambda s: K.run_summary(_reasons(s), "source_type"),
        "with k as (select source_type, case when asset_id % 7 = 0 then 'unsupported_pdf_status' when asset_id % 5 = 0 then 'invalid_pdf_binding' when extract_status <> 'extracted' then 'pdf_extract_not_ready' when asset_id % 9 = 0 or trim(text) = '' then 'missing_extracted_text' end as r from fx_asset) select source_type, count(*) as items, count(*) filter (r is null) as analysed, count(*) filter (r = 'unsupported_pdf_status') as unsupported_pdf_status, count(*) filter (r = 'invalid_pdf_binding') as invalid_pdf_binding, count(*) filter (r = 'pdf_extract_not_ready') as pdf_extract_not_ready, count(*) filter (r = 'missing_extracted_text') as missing_extracted_text from k group by 1",
    ),
    "c8_review_sections": (lambda s: direct(s).groupBy(K.review_section(c("recommendation"), c("claim_type"), c("template_match_level")).alias("section")).agg(F.count(F.lit(1)).alias("n")), f"with {DIRECT} select case when recommendation = 'include' and level = 'strong' then 'formal' when claim_type = 'limitation_feedback' then 'limitation' when recommendation = 'exclude' then 'excluded' else 'review' end as section, count(*) as n from di group by 1"),
    "c12_card_edits": (
        lambda s: s.fx_evidence.select("evidence_id", "stance").join(s.events.groupBy((c("event_id") % 1500).alias("k")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("title"), F.count(F.lit(1)).alias("edits")), c("evidence_id") == c("k"), "left").select("evidence_id", F.coalesce("title", "stance").alias("title"), F.coalesce("edits", F.lit(0)).alias("edits")),
        "select evidence_id, coalesce(t, stance) as title, coalesce(n, 0) as edits from fx_evidence left join (select event_id % 1500 as k, arg_max(event_type, {'a': ts, 'b': event_id}) as t, count(*) as n from events group by 1) on k = evidence_id",
    ),
    "c14_diagnostics": (
        lambda s: direct(s).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))), "|").alias("codes")),
        f"with {DIRECT} select item_id, n, coalesce(codes, '') as codes from (select item_id, count(*) as n from di group by 1) a left join (select item_id, string_agg(distinct code, '|' order by code) as codes from (select item_id, unnest(codes) as code from di) group by 1) b using (item_id)",
    ),
    "j5_fuzzy_reuse": (
        lambda s: M.title_similarity_join(s.fx_cited.groupBy("title").agg(F.min("publication_id").alias("id")), s.fx_cited.groupBy("title").agg(F.min("publication_id").alias("id")), 0.8).withColumn("auto_attach", c("score") >= 0.98),
        None,
    ),
    "j10_inbox_matches": (
        lambda s: _inbox(s).join(M.inbox_matches(_inbox(s), s.fx_cited.select(c("publication_id").alias("item_id"), "doi", "title")).withColumnRenamed("file_id", "m_id"), c("file_id") == c("m_id"), "left").select("file_id", "item_id", K.inbox_status(F.coalesce("score", F.lit(0.0))).alias("status")),
        None,
    ),
    "j10_inbox_status": (lambda s: _scores(s).groupBy("row_id").agg(F.max("score").alias("best")).select("row_id", K.inbox_status(c("best")).alias("status")), "select cited_id as row_id, case when b >= 0.95 then 'matched' when b >= 0.82 then 'candidate' else 'unmatched' end as status from (select cited_id, max(least(1.0, 0.85 * (1 - (citing_id % 20) / 80.0) + 0.15 + case when citing_id % 3 = 0 then 0.05 else 0 end)) as b from fx_edge group by 1)"),
    "j19_finding_reasons": (_findings, "select evidence_id, case when evidence_id % 4 <> 0 then 'because ' || evidence_id else '' end as reason from fx_evidence"),
    "p11_export_gate": (lambda s: direct(s).withColumn("anchor_status", F.when(c("evidence_id") % 11 == 0, "invalid").otherwise("valid")).where(K.export_gate()).select("evidence_id"), f"with {DIRECT} select evidence_id from di where recommendation = 'include' and has_target and evidence_id % 11 <> 0"),
    "p12_download_links": (
        lambda s: K.download_links(s.fx_cited.select("publication_id", "doi", F.regexp_replace("title", "[^A-Za-z0-9 ]", "").alias("title"))).select("publication_id", "doi_url", "publisher", "search_url"),
        "select publication_id, coalesce(doi, '') as doi_url, case when doi like '%10.1145/%' then 'ACM Digital Library' when doi like '%10.1109/%' then 'IEEE Xplore' when doi like '%10.1007/%' then 'Springer' when doi like '%10.1016/%' then 'Elsevier / ScienceDirect' else 'Publisher' end as publisher, 'https://scholar.google.com/scholar?q=' || replace(regexp_replace(title, '[^A-Za-z0-9 ]', '', 'g'), ' ', '+') as search_url from fx_cited",
    ),
    "t2_evidence_order": (
        lambda s: numbered(scored(s).withColumn("review_status", F.when(c("evidence_id") % 13 == 0, "important").otherwise("")), "session_id", E.evidence_order(), "place").select("session_id", "evidence_id", "place"),
        f"with {SCORED} select session_id, evidence_id, row_number() over (partition by session_id order by evidence_id % 13 = 0 desc, round(score, 9) desc, evidence_id) as place from sc",
    ),
    "t5_top_three": (
        lambda s: scored(s).withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.round("score", 9).desc(), "evidence_id"))).where("rank <= 3").select("item_id", "rank", "evidence_id"),
        f"with {SCORED} select item_id, rank, evidence_id from (select *, row_number() over (partition by item_id order by round(score, 9) desc, evidence_id) as rank from sc) where rank <= 3",
    ),
    "u8_report_rows": (
        lambda s: K.report_rows(scored(s).withColumn("score", F.round("score", 9))).select("evidence_id", "seen"),
        f"with {SCORED} select evidence_id, seen from (select evidence_id, row_number() over (partition by session_id, {QKEY} order by round(score, 9) desc, evidence_id) as n, count(*) over (partition by session_id, {QKEY}) as seen from sc where {QKEY} <> '') where n = 1",
    ),
    "u10_card_keepers": (
        lambda s: K.card_keepers(s.fx_evidence.select((c("item_id") % 5).alias("item_id"), c("stance").alias("card_type"), c("evidence_id").alias("card_id"), c("citation_text").alias("quote"), (c("evidence_id") % 6 == 5).alias("is_user_edited"))),
        f"with k as (select item_id % 5 as item_id, stance as card_type, evidence_id as card_id, {QKEY} as key from fx_evidence) select item_id, card_type, key, coalesce(min(card_id) filter (card_id % 6 = 5), min(card_id)) as card_id, count(*) as copies from k group by 1, 2, 3",
    ),
    "u16_venue_backfill": (
        lambda s: K.backfilled_venues(s.fx_citing.select("publication_id", "title", "venue"), s.fx_citing.where("publication_id % 2 = 0").select(F.upper("title").alias("citing_title"), F.concat(F.lit("Conf "), c("publication_id") % 7).alias("citing_venue"))).select("publication_id", "venue"),
        "select publication_id, case when venue is null and publication_id % 2 = 0 then 'Conf ' || publication_id % 7 else venue end as venue from fx_citing",
    ),
    "x4_paragraph_candidates": (
        lambda s: K.paragraph_candidates(s.documents, s.documents.select("doc_id", F.when(c("lang") == "en", "thing that").otherwise("dans mente").alias("title"), F.lit("10.1/none").alias("doi"))),
        f"""with p as (select doc_id, lang, unnest(parts) as par, generate_subscripts(parts, 1) - 1 as pos from (select doc_id, lang, string_split(text, chr(10)) as parts from documents)),
            k as (select doc_id, pos, {NORM.format('par')} as n, lang from p),
            s as (select doc_id, pos, case when lang = 'en' then 2 * (cast(contains(n, 'thing') as int) + cast(contains(n, 'that') as int)) + case when contains(n, 'thing that') then 8 else 0 end else 2 * (cast(contains(n, 'dans') as int) + cast(contains(n, 'mente') as int)) + case when contains(n, 'dans mente') then 8 else 0 end end as score from k)
            select doc_id, pos, score, rank from (select *, row_number() over (partition by doc_id order by score desc, pos) as rank from s where score > 0) where rank <= 20""",
    ),
    "x20_marker_sentences": (
        lambda s: K.marker_sentence(A.sentences(s.fx_text.select("doc_id", c("marked").alias("text"))), s.fx_text.select("doc_id", c("target_marker").alias("marker"))).select("doc_id", F.regexp_extract("sentence", r"\[[^\]]*\]", 0).alias("cites")),
        "select doc_id, '[' || doc_id % 40 + 1 || ', ' || doc_id % 7 + 1 || '-' || doc_id % 7 + 4 || ']' as cites from fx_text where target_marker = cast(doc_id % 40 + 1 as varchar) or cast(target_marker as int) between doc_id % 7 + 1 and doc_id % 7 + 4",
    ),
    "a7_asset_usage": (_usage, f"with {USAGE} select * from us"),
    "a7_pool_summary": (lambda s: K.pool_summary(_usage(s)), f"with {USAGE} select count(*) as assets, count(*) filter (extract_status = 'extracted') as extracted, cast(sum(links) as bigint) as links, cast(sum(uses) as bigint) as uses from us"),
    "a7_recent_assets": (lambda s: K.recent_assets(_usage(s)), f"with {USAGE} select * from us order by asset_id desc limit 10"),
}
