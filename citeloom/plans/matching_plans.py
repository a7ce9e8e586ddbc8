"""Matching (J4 to J9, J11 to J13, J16, J17, J20, U4, U5, U11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions.identifiers import arxiv_in
from citeloom.operators import matching as M

from .fixtures import Source

c = F.col
NORM = r"trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
KEY = r"nullif(lower(trim(regexp_replace(trim(coalesce({0}, '')), '^(https?://doi\.org/|doi:)', '', 'i'))), '')"


def _items(s: Source):
    k = c("publication_id")
    return s.fx_cited.select(k.alias("item_id"), k, F.when(k % 3 == 0, c("doi")).alias("doi"), F.when(k % 4 == 0, F.concat(F.lit("W"), k)).alias("work_id"), "title")


def _links(s: Source):
    k = c("publication_id")
    return s.fx_cited.where("publication_id % 2 = 0").select((k + 5000).alias("asset_id"), F.when(k % 8 == 0, k).alias("publication_id"), F.upper("doi").alias("doi"), F.concat(F.lit("W"), k).alias("work_id"), F.when(k % 10 == 2, F.upper("title")).alias("title"))


ITEMS = "items as (select publication_id as item_id, publication_id as p, case when publication_id % 3 = 0 then doi end as doi, case when publication_id % 4 = 0 then 'W' || publication_id end as w, title from fx_cited)"
LINKS = "links as (select publication_id + 5000 as asset_id, case when publication_id % 8 = 0 then publication_id end as p, upper(doi) as doi, 'W' || publication_id as w, case when publication_id % 10 = 2 then upper(title) end as title from fx_cited where publication_id % 2 = 0)"
REUSE = f"""
    with {ITEMS}, {LINKS},
    k as (select item_id, asset_id, 0 as o, 1.0 as s, 'doi' as r from items i join links l on {KEY.format('i.doi')} = {KEY.format('l.doi')}
          union all select item_id, asset_id, 1, 1.0, 'work_id' from items i join links l on i.w = l.w
          union all select item_id, asset_id, 2, 1.0, 'publication_id' from items i join links l on i.p = l.p
          union all select item_id, asset_id, 3, 0.95, 'title' from items i join links l on {NORM.format('i.title')} = {NORM.format('l.title')} and {NORM.format('i.title')} <> ''),
    f as (select *, row_number() over (partition by item_id, asset_id order by o) as n from k),
    g as (select *, row_number() over (partition by item_id order by s desc, asset_id) as rank from f where n = 1)
    select item_id, asset_id, s as match_score, r as match_reason, rank, true as auto_attach from g where rank <= 3"""


def _files(s: Source):
    k = c("publication_id")
    return s.fx_cited.where("publication_id % 3 = 1").select((k * 2).alias("file_id"), F.when(k % 2 == 0, c("doi")).alias("doi"), F.upper("title").alias("title"))


def _entries(s: Source):
    k = c("publication_id")
    return s.fx_cited.where("publication_id % 2 = 0").select((k + 9000).alias("entry_id"), F.when(k % 4 == 0, F.upper("doi")).alias("doi"), F.when(k % 5 == 1, arxiv_in(F.concat(F.lit("arXiv:1905."), F.lpad(k.cast("string"), 5, "0")))).alias("arxiv_id"), "title")


def _published(s: Source):
    k = c("publication_id")
    return s.fx_cited.select("publication_id", "doi", arxiv_in(F.concat(F.lit("arXiv:1905."), F.lpad(k.cast("string"), 5, "0"))).alias("arxiv_id"), "title")


LIBRARY = f"""
    with e as (select publication_id + 9000 as entry_id, case when publication_id % 4 = 0 then {KEY.format('doi')} end as d, case when publication_id % 5 = 1 then '1905.' || lpad(cast(publication_id as varchar), 5, '0') end as a, {NORM.format('title')} as t from fx_cited where publication_id % 2 = 0),
    p as (select publication_id, {KEY.format('doi')} as d, '1905.' || lpad(cast(publication_id as varchar), 5, '0') as a, {NORM.format('title')} as t from fx_cited),
    k as (select publication_id, entry_id, 1.0 as s, 'doi' as r, 0 as o from p join e on p.d = e.d union all select publication_id, entry_id, 0.98, 'arxiv', 1 from p join e on p.a = e.a),
    f as (select *, row_number() over (partition by publication_id order by entry_id, o) as n from k),
    b as (select publication_id, min(entry_id) as entry_id, 1.0 as s, 'title' as r from p join e on p.t = e.t where publication_id not in (select publication_id from k) group by 1)
    select publication_id, entry_id, s as match_score, r as match_reason from f where n = 1 union all select * from b"""


def _overlap(s: Source):
    t = s.fx_cited.groupBy("title").agg(F.min("publication_id").alias("id"))
    files = t.select("id", F.concat("title", F.lit(" final")).alias("title"))
    return M.token_overlap_join(files, t)


OVERLAP = f"""
    with t as (select min(publication_id) as id, title from fx_cited group by title),
    a as (select id, list_distinct(string_split({NORM.format("title || ' final'")}, ' ')) as w from t), b as (select id, list_distinct(string_split({NORM.format('title')}, ' ')) as w from t)
    select a.id as left_id, b.id as right_id, len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w)) as overlap from a, b where len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w)) >= 0.75"""

#: Wanted papers, and files named after them in several ways.
WANTED = """select publication_id as id, title, case when publication_id % 3 = 0 then title || ' final' end as query, doi, case when publication_id % 7 < 3 then 'arXiv:2101.' || lpad(cast(publication_id % 100000 as {str}), 5, '0') || 'v2' end as arxiv from fx_cited"""
FILES = """select case publication_id % 6 when 0 then 'lib/' || replace(title, ':', '_') || '.pdf' when 1 then 'lib/sub/' || title || ' final.pdf' when 2 then 'in/' || replace(replace(lower(doi), 'https://doi.org/', ''), '/', '_') || '.PDF' when 3 then 'in/2101.' || lpad(cast(publication_id % 100000 as {str}), 5, '0') || '.pdf'
    when 4 then 'x/' || title || '.txt' else 'lib/' || substring(title, 1, 40) || '.pdf' end as path from fx_cited"""


def _local_files(s: Source):
    run = lambda q: s.spark.sql(q.format(str="string").replace("fx_cited", "{fx_cited}"), fx_cited=s.fx_cited)
    return M.local_files(run(WANTED), run(FILES))


LOCAL_FILES = rf"""
    with w as ({WANTED.format(str='varchar')}), f as (select distinct path, regexp_replace(string_split(path, '/')[-1], '\.[^.]*$', '') as stem from ({FILES.format(str='varchar')}) where lower(path) like '%.pdf'),
    x as (select id, unnest([title, query]) as text from w), t as (select distinct text, list_distinct(string_split({NORM.format('text')}, ' ')) as ws, lower(substring(trim(translate(text, '/\:*?"<>|', '_________')), 1, 180)) as name from x where text is not null),
    g as (select path, stem, list_distinct(string_split({NORM.format('stem')}, ' ')) as ws from f),
    o as (select text, path, case when name = lower(stem) then 1.0 else len(list_intersect(t.ws, g.ws)) / greatest(len(t.ws), len(g.ws)) end as score, case when name = lower(stem) then 0 else 2 end as rank from t join g on name = lower(stem) or len(list_intersect(t.ws, g.ws)) / greatest(len(t.ws), len(g.ws)) >= 0.75),
    p as (select id, path, score, rank from x join o using (text)
      union all select id, path, 1.0, 1 from w join f on {NORM.format("substring(arxiv, 7, 10)")} = {NORM.format('stem')}
      union all select id, path, 0.95, 3 from w join f on doi is not null and contains(lower(path), replace(replace(lower(doi), 'https://doi.org/', ''), '/', '_')))
    select id, path, cast(score as double) as score, ['filename', 'arxiv', 'title', 'doi'][rank + 1] as reason from (select *, row_number() over (partition by id order by score desc, length(path), path, rank) as place from p) where place = 1"""



def _scores(s: Source):
    """Honour rows against queue items of the same cited work: exact citing titles for some, others by a fixed share of agreement."""
    return s.fx_edge.select(c("cited_id").alias("row_id"), c("citing_id").alias("item_id"), F.least(F.lit(1.0), 0.85 * (1 - (c("citing_id") % 20) / 80) + 0.15 + F.when(c("citing_id") % 3 == 0, 0.05).otherwise(0.0)).alias("score"))


HONOUR = """
    with k as (select cited_id as row_id, citing_id as item_id, least(1.0, 0.85 * (1 - (citing_id % 20) / 80.0) + 0.15 + case when citing_id % 3 = 0 then 0.05 else 0 end) as score from fx_edge),
    r as (select *, row_number() over w as rank, lead(score) over w as nxt from k where score >= 0.75 - 1e-9 window w as (partition by row_id order by score desc, item_id))
    select row_id, item_id, score, case when nxt is not null and (score - nxt < 0.05 - 1e-9 or score < 0.95 - 1e-9) then 'ambiguous' when score >= 0.90 - 1e-9 then 'matched' else 'ambiguous' end as status from r where rank = 1"""


def honour_rows(s: Source):
    """Honour rows whose citing titles are those of the queue, shortened, reversed, or others."""
    k, t = c("publication_id"), c("title")
    title = F.when(k % 4 == 0, t).when(k % 4 == 1, F.substring_index(t, " ", 4)).when(k % 4 == 2, F.array_join(F.reverse(F.split(t, " ")), " ")).otherwise(F.concat(F.lit("Other words "), k.cast("string")))
    return s.fx_cited.select(k.alias("row_id"), "session_id", title.alias("citing_title"), F.concat(F.lit("Cited work "), (k % 3).cast("string")).alias("cited_title"), F.concat(F.lit("Author "), (k % 5).cast("string")).alias("author"))


def queue_items(s: Source):
    k = c("publication_id")
    return s.fx_cited.select(k.alias("item_id"), "session_id", c("title").alias("citing_title"), F.concat(F.lit("Cited work "), (k % 2).cast("string")).alias("cited_title"), F.array(F.concat(F.lit("AUTHOR "), (k % 10).cast("string"))).alias("authors"))


def honours(s: Source):
    rows = honour_rows(s)
    return M.honour_decisions(M.best_honours(rows, queue_items(s)), rows)


def _annotations(s: Source):
    k = c("publication_id")
    own = lambda n: s.fx_cited.where(k % 2 == n).select("session_id", k.alias("annotation_id"), F.lit(n).alias("import_no"))
    return M.replaced(own(0), own(1).where("session_id < 'Brand#3'"))


def _candidate_links(s: Source):
    k = c("page_id")
    return s.pages.select((k % 20).alias("item_id"), "url", F.when(k % 3 == 0, "direct_pdf").when(k % 3 == 1, "landing_page").otherwise("metadata_page").alias("url_type"), (k % 2 == 0).alias("can_auto_download"), F.concat(F.lit("L"), (k % 5).cast("string")).alias("label")).distinct()


def _similar(s: Source):
    t = s.fx_cited.groupBy("title").agg(F.min("publication_id").alias("id"))
    return M.title_similarity_join(t.select("id", F.concat(F.lit("The "), "title").alias("title")), t.select("id", "title"), 0.9)


def _records(s: Source):
    k = c("publication_id")
    recs = s.fx_cited.select(k.alias("record_id"), F.when(k % 5 == 0, F.upper("doi")).when(k % 5 == 1, c("doi")).alias("doi"), F.when(k % 2 == 0, F.upper("title")).otherwise(F.concat("title", F.lit("s"))).alias("title"), "year")
    return M.record_publications(recs, s.fx_cited)


def _notable(s: Source):
    items = s.fx_citing.select(c("publication_id").alias("item_id"), F.array(F.lit("Nobody"), "author").alias("citing_authors"))
    notes = s.fx_citing.where("publication_id % 7 = 0").select((c("publication_id") * 2).alias("annotation_id"), c("publication_id").alias("item_id"), (c("publication_id") % 25).alias("author_id"), F.when(c("publication_id") % 2 == 0, "matched").otherwise("unmatched").alias("match_status"), F.lit(True).alias("is_important"))
    authors = s.nation.where("n_nationkey % 5 = 0").select(c("n_nationkey").alias("author_id"), c("n_name").alias("name"))
    return M.notable_authors(items, notes, authors)


def _preprints(s: Source):
    t = s.fx_cited.groupBy("title").agg(F.min("publication_id").alias("id"))
    names = s.fx_cited_author.groupBy(c("cited_id").alias("k")).agg(F.array_sort(F.collect_set("author")).alias("authors"))
    p = t.join(names, c("id") == c("k")).select("id", "title", "authors")
    return M.preprint_matches(M.title_similarity_join(p, p, 0.97), p, p)


def _linked(s: Source):
    k = c("asset_id")
    return M.upsert_links(s.fx_asset.select((k % 100).alias("asset_id"), F.when(k % 3 != 0, c("publication_id") % 7).alias("publication_id"), F.lit("t").alias("normalized_title"), k.alias("ordinal"), F.when(k % 2 == 0, c("source_type")).alias("match_method"), (k % 10 / 10).alias("match_score"), (k % 11 == 0).alias("verified")))


PLANS = {
    "j4_reuse_candidates": (lambda s: M.reuse_candidates(_items(s), _links(s)), REUSE),
    "j6_top_candidates": (lambda s: M.best(M.first_of_keys(_items(s), _links(s), [(M.norm_title_alnum(c("title")), M.norm_title_alnum(c("title")), 0.95, "title")], "item_id", "asset_id", 3), "item_id", "asset_id", 3).select("item_id", "asset_id", "rank"),
        f"with {ITEMS}, {LINKS} select * from (select item_id, asset_id, row_number() over (partition by item_id order by asset_id) as rank from items i join links l on {NORM.format('i.title')} = {NORM.format('l.title')} and {NORM.format('i.title')} <> '') where rank <= 3"),
    "j7_library_matches": (lambda s: M.library_matches(_published(s), _entries(s), 1.0), LIBRARY),
    "j7_fuzzy_library_matches": (lambda s: M.library_matches(_published(s), _entries(s).withColumn("title", F.concat(c("title"), F.lit(" final")))), None),
    "j8_session_library_matches": (
        lambda s: M.library_matches(_published(s).join(s.fx_edge.where("pdf_readiness_status <> 'need_pdf' and citing_id % 50 = 0").select(c("cited_id").alias("has")).distinct(), c("publication_id") == c("has"), "left_anti"), _entries(s), 1.0),
        f"select * from ({LIBRARY}) where publication_id not in (select cited_id from fx_edge where pdf_readiness_status <> 'need_pdf' and citing_id % 50 = 0)",
    ),
    "j9_file_publications": (
        lambda s: M.file_publications(_files(s), s.fx_cited),
        f"""select f.publication_id * 2 as file_id, coalesce(case when f.publication_id % 2 = 0 then (select min(publication_id) from fx_cited g where {KEY.format('g.doi')} = {KEY.format('f.doi')}) end, t.id) as publication_id
            from fx_cited f join (select {NORM.format('title')} as k, min(publication_id) as id from fx_cited group by 1) t on t.k = {NORM.format('f.title')} where f.publication_id % 3 = 1""",
    ),
    "j11_honour_decisions": (honours, None),
    "j11_decision_rule": (lambda s: M.honour_decisions(_scores(s)), HONOUR),
    "u13_replaced_annotations": (
        _annotations,
        "with k as (select session_id, publication_id as annotation_id, publication_id % 2 as import_no from fx_cited), n as (select * from k where import_no = 1 and session_id < 'Brand#3') select session_id, annotation_id, cast(import_no as int) as import_no from n union all select session_id, annotation_id, cast(import_no as int) from k where import_no = 0 and session_id not in (select session_id from n)",
    ),
    "u14_rematched_annotations": (lambda s: M.rematched(honour_rows(s).withColumnRenamed("row_id", "annotation_id"), queue_items(s).where("item_id % 3 <> 0")), None),
    "t4_link_order": (
        lambda s: M.ordered_links(_candidate_links(s)).select("item_id", "url", "url_type", "label", "place"),
        "with k as (select distinct page_id % 20 as item_id, url, case page_id % 3 when 0 then 'direct_pdf' when 1 then 'landing_page' else 'metadata_page' end as url_type, page_id % 2 = 0 as auto, 'L' || page_id % 5 as label from pages) select item_id, url, url_type, label, row_number() over (partition by item_id order by case when auto and url_type = 'direct_pdf' then 0 when url_type = 'landing_page' then 1 else 2 end, label, url) as place from k",
    ),
    "j12_title_similarity": (_similar, None),
    "j13_record_publications": (_records, None),
    "j16_token_overlap": (_overlap, OVERLAP),
    "j16_local_files": (_local_files, LOCAL_FILES),
    "j17_notable_authors": (
        _notable,
        "select publication_id as item_id, coalesce(case when publication_id % 14 = 0 then publication_id % 25 end, n_nationkey) as author_id from fx_citing left join nation on n_name = author and n_nationkey % 5 = 0 where publication_id % 14 = 0 or n_nationkey is not null",
    ),
    "j20_preprint_matches": (_preprints, None),
    "u4_unique_assets": (
        lambda s: M.unique_assets(s.fx_asset.select("asset_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256")), s.fx_asset.where("asset_id % 10 = 3").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))),
        "with k as (select asset_id, sha256(text) as sha256 from fx_asset) select sha256, min(asset_id) as asset_id, count(*) as copies from k where sha256 not in (select sha256 from k where asset_id % 10 = 3) group by 1",
    ),
    "u5_upsert_links": (
        _linked,
        "with k as (select asset_id % 100 as a, case when asset_id % 3 <> 0 then publication_id % 7 end as p, asset_id as o, case when asset_id % 2 = 0 then source_type end as m, (asset_id % 10) / 10.0 as sc, asset_id % 11 = 0 as v from fx_asset) select a as asset_id, p as publication_id, 't' as normalized_title, arg_min(m, o) filter (m is not null) as match_method, max(sc) as match_score, bool_or(v) as verified from k group by 1, 2",
    ),
    "u11_distinct_links": (
        lambda s: s.pages.select((c("page_id") % 20).alias("item_id"), F.regexp_replace("url", r"[?#].*$", "").alias("url"), "page_id", (c("page_id") % 4).alias("priority")).groupBy("item_id", "url").agg(F.min_by("page_id", F.struct("priority", "page_id")).alias("page_id")),
        "with k as (select page_id % 20 as item_id, regexp_replace(url, '[?#].*$', '') as url, page_id from pages) select item_id, url, page_id from (select *, row_number() over (partition by item_id, url order by page_id % 4, page_id) as n from k) where n = 1",
    ),
    "a7_asset_pool": (
        lambda s: s.fx_asset.groupBy("source_type").agg(F.count(F.lit(1)).alias("assets"), F.count_if(c("extract_status") == "extracted").alias("extracted"), F.countDistinct("publication_id").alias("linked"), F.sum("size_bytes").alias("bytes")),
        "select source_type, count(*) as assets, count(*) filter (extract_status = 'extracted') as extracted, count(distinct publication_id) as linked, cast(sum(size_bytes) as bigint) as bytes from fx_asset group by 1",
    ),
}
