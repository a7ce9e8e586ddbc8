"""Sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from citeloom.rounds import shared_folder
from citeloom.sources import readers as R

from .fixtures import Source
from .queue_plans import Q0, queue

c = F.col


def _list(s: Source):
    return s.fx_citing.select(c("title").alias("Title"), F.concat("author", F.lit("; Ann Other")).alias("AUTHORS"), c("year").cast("string").alias("Year"), c("venue").alias("Source"), F.lit("shadowed").alias("Publisher"), c("doi").alias("DOI"), F.concat(F.lit("https://x.org/"), "publication_id").alias("url"), c("publication_id").cast("string").alias("GSRank"))


def _honours(s: Source):
    n = R.HONOUR_HEADERS
    return s.fx_citing.select(F.lit("Fellow").alias(n[0]), c("author").alias(n[1]), F.lit("").alias(n[2]), F.concat(F.lit("[Conf '19] "), "title", F.lit(".")).alias(n[3]), F.lit("Mine").alias(n[4]), F.lit("V").alias(n[5]), F.lit("2019").alias(n[6]))


def _files(s: Source):
    name = F.concat(F.replace("source", F.lit(" "), F.lit("_")), F.lit("_paper_"), "doc_id", F.when(c("doc_id") % 10 == 0, ".txt").otherwise(".pdf"))
    data = F.encode(F.concat(F.when(c("doc_id") % 4 == 0, "").otherwise("%PDF-"), "text"), "UTF-8")
    return s.documents.select(F.concat(F.lit("/lib/"), name).alias("path"), name.alias("filename"), F.length(data).cast("long").alias("length"), data.alias("content"), "doc_id")


def _imports(s: Source):
    k = c("publication_id")
    return s.fx_citing.select((k % 5).alias("batch_id"), k.alias("row_index"), F.when(k % 11 != 0, F.concat(F.lit("Study of "), (k % 3000).cast("string"))).alias("title"), F.when(k % 4 == 0, F.concat(F.lit("doi:10.1/"), k)).alias("doi"))


def _works(s: Source):
    p = s.fx_cited
    return p.select(F.concat(F.lit("https://openalex.org/W"), "publication_id").alias("id"), "doi", F.when(c("publication_id") % 2 == 0, c("title")).otherwise("").alias("title"), c("title").alias("display_name"), c("year").alias("publication_year"),
        F.array(F.struct(F.struct(F.lit("Ann").alias("display_name")).alias("author"))).alias("authorships"),
        F.array(F.struct(F.lit(False).alias("is_oa"), F.lit("no").alias("pdf_url"), F.lit("closed").alias("landing_page_url"), F.struct(F.lit("Tests").alias("display_name")).alias("source")), F.struct(F.lit(True).alias("is_oa"), F.when(c("publication_id") % 3 == 0, "p").alias("pdf_url"), F.lit("open").alias("landing_page_url"), F.struct(F.lit("x").alias("display_name")).alias("source"))).alias("locations"))


def _stored(s: Source):
    """Annotations of all sessions, then a second import of some, one of which brings none: written, replaced and read back."""
    k = c("publication_id")
    own = lambda n: s.fx_cited.where(k % 2 == n).select("session_id", k.alias("annotation_id"), F.lit(n).alias("import_no"))
    again = s.fx_cited.where("session_id < 'Brand#3'")
    spark = again.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/annotations-{uuid.uuid4().hex}"
    R.store_sessions(own(0), path)
    R.store_sessions(own(1).where("session_id < 'Brand#3' and session_id <> 'Brand#11'"), path, again.select("session_id"))
    return R.stored_sessions(spark, path, own(0).schema)


PLANS = {
    "s1_citation_list": (
        lambda s: R.citation_records(_list(s)).select("title", F.array_join("authors", "|").alias("authors"), "year", "venue", "doi", "article_url", "rank"),
        "select title, author || '|Ann Other' as authors, year, coalesce(venue, '') as venue, case when doi is not null then lower(substring(doi, 5)) end as doi, 'https://x.org/' || publication_id as article_url, cast(publication_id as int) as rank from fx_citing",
    ),
    "s2_honours": (lambda s: R.honour_records(_honours(s)).groupBy("author", "citing_venue", "citing_year").agg(F.countDistinct("citing_title").alias("titles")), "select author, 'Conf' as citing_venue, 2019 as citing_year, count(distinct title) as titles from fx_citing group by 1"),
    "s4_file_metadata": (
        lambda s: R.file_metadata(_files(s)).select("filename", "size_bytes", "sha256", "title"),
        "with k as (select source || '_paper_' || doc_id as stem, case when doc_id % 10 = 0 then '.txt' else '.pdf' end as ext, case when doc_id % 4 = 0 then '' else '%PDF-' end || text as body from documents) select stem || ext as filename, octet_length(encode(body)) as size_bytes, sha256(body) as sha256, replace(stem, '_', ' ') as title from k",
    ),
    "s5_works": (
        lambda s: R.works(_works(s)).select("work_id", "title", "year", "doi", "venue", "pdf_url", "landing_url"),
        "select 'W' || publication_id as work_id, title, year, lower(substring(doi, 17)) as doi, 'Tests' as venue, case when publication_id % 3 = 0 then 'p' end as pdf_url, 'open' as landing_url from fx_cited",
    ),
    "s6_profile": (
        lambda s: R.profile_records(s.fx_cited.select(F.concat("title", F.lit(".")).alias("title"), c("year").cast("string").alias("year"), F.when(c("publication_id") % 2 == 0, "J").alias("journal"), F.lit("B").alias("booktitle"), F.array(F.lit("https://x.org"), "doi").alias("ee"), F.array(F.lit("Ann")).alias("author"))).select("title", "year", "venue", "doi"),
        "select title, year, case when publication_id % 2 = 0 then 'J' else 'B' end as venue, lower(substring(doi, 17)) as doi from fx_cited",
    ),
    "s7_author_candidates": (
        lambda s: R.author_candidates(s.supplier.join(s.nation, c("s_nationkey") == c("n_nationkey")).select(c("s_suppkey").alias("pid"), c("s_name").alias("name"), F.array(F.struct(F.lit("affiliation").alias("type"), c("n_name").alias("text")), F.struct(F.lit("affiliation").alias("type"), c("n_name").alias("text")), F.struct(F.lit("award").alias("type"), F.lit("x").alias("text"))).alias("notes")), "SUPP", 20).select("pid", "name", F.array_join("affiliations", ",").alias("affiliations")),
        "select s_suppkey as pid, s_name as name, n_name as affiliations from supplier join nation on s_nationkey = n_nationkey where contains(lower(s_name), 'supp') order by s_suppkey limit 20",
    ),
    "s9_missing_documents": (
        lambda s: R.missing_documents(queue(s).select("session_id", "cited_id", "citing_id", "citing_title", "pdf_readiness_status", F.lit(None).cast("string").alias("doi"))).select("cited_id", "citing_id", "doi_url", "search_url"),
        f"{Q0} select cited_id, citing_id, '' as doi_url, 'https://scholar.google.com/scholar?q=' || replace(citing_title, ' ', '+') as search_url from q where pdf_readiness_status = 'need_pdf'",
    ),
    "a5_import_counts": (
        lambda s: R.import_counts(R.import_statuses(_imports(s), s.fx_citing.where("publication_id % 8 = 0").select(F.concat(F.lit("10.1/"), "publication_id").alias("doi")))),
        """with k as (select publication_id % 5 as batch_id, publication_id as i, case when publication_id % 11 <> 0 then 'Study of ' || publication_id % 3000 end as t, case when publication_id % 4 = 0 then '10.1/' || publication_id end as d from fx_citing),
           r as (select *, row_number() over (partition by batch_id, coalesce(d, trim(regexp_replace(lower(coalesce(t, '')), '[^a-z0-9]+', ' ', 'g'))) order by i) as n from k),
           x as (select batch_id, case when coalesce(t, '') = '' then 'skipped' when n > 1 then 'duplicate' when i % 8 = 0 then 'matched_existing' else 'imported' end as st from r)
           select batch_id, count(*) filter (st = 'imported') as imported, count(*) filter (st = 'matched_existing') as matched_existing, count(*) filter (st = 'duplicate') as duplicate, count(*) filter (st = 'skipped') as skipped, cast(0 as bigint) as error from x group by 1""",
    ),
    "p14_validated_files": (
        lambda s: R.validated(_files(s), 20000).select("doc_id", "reason"),
        "select doc_id, case when octet_length(encode(case when doc_id % 4 = 0 then '' else '%PDF-' end || text)) = 0 then 'empty' when octet_length(encode(case when doc_id % 4 = 0 then '' else '%PDF-' end || text)) > 20000 then 'too_large' when doc_id % 10 = 0 then 'not_pdf_name' when doc_id % 4 = 0 then 'not_pdf_content' end as reason from documents",
    ),
    "u13_stored_annotations": (
        _stored,
        "with k as (select session_id, publication_id as annotation_id, cast(publication_id % 2 as int) as import_no from fx_cited) select * from k where case when session_id < 'Brand#3' then import_no = 1 and session_id <> 'Brand#11' else import_no = 0 end",
    ),
}
