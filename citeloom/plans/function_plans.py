"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import identifiers as I
from citeloom.functions import names as N

from .fixtures import Source

NORM = r"trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
DOI = r"trim(regexp_replace(trim(coalesce({0}, '')), '^(https?://doi\.org/|doi:)', '', 'i'))"
c = F.col


def _dois(s: Source):
    a = s.fx_cited.select("publication_id", "doi")
    return a.unionByName(s.fx_citing.select("publication_id", "doi"))


BOTH = "(select publication_id, doi from fx_cited union all select publication_id, doi from fx_citing)"
PUBLISHER_SQL = f"""
    with k as (select publication_id, {DOI.format('doi')} as own from fx_cited)
    select publication_id,
           case when lower(own) like '10.1145/%' then 'acm_dl' when lower(own) like '10.1109/%' then 'ieee_xplore' when lower(own) like '10.1007/%' then 'springer' when lower(own) like '10.1016/%' then 'elsevier' else 'publisher' end as source,
           case when lower(own) like '10.1145/%' then 'https://dl.acm.org/doi/' || own when own <> '' then 'https://doi.org/' || own else '' end as landing_url,
           case when own <> '' then 'https://doi.org/' || own else '' end as fallback_url
    from k"""

PLANS = {
    "f1_title_whitespace": (
        lambda s: s.documents.select("doc_id", N.norm_title_ws("text").alias("norm")),
        r"select doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) as norm from documents",
    ),
    "f2_title_alnum": (
        lambda s: s.fx_cited.select("publication_id", N.norm_title_alnum(c("title")).alias("norm")),
        f"select publication_id, {NORM.format('title')} as norm from fx_cited",
    ),
    "f5_doi_plain": (lambda s: _dois(s).select("publication_id", I.doi_plain(c("doi")).alias("plain")), f"select publication_id, {DOI.format('doi')} as plain from {BOTH}"),
    "f6_doi_key": (lambda s: _dois(s).select("publication_id", I.doi_key(c("doi")).alias("key")), f"select publication_id, nullif(lower({DOI.format('doi')}), '') as key from {BOTH}"),
    "f7_doi_in_text": (
        lambda s: s.fx_cited.select("publication_id", I.doi_in_text(F.concat(c("title"), F.lit(" ("), c("doi"), F.lit(").,"))).alias("doi")),
        r"""select publication_id, nullif(lower(regexp_replace(regexp_extract(coalesce(title || ' (' || doi || ').,', ''), '10\.\d{4,9}/[-._;()/:A-Z0-9]+', 0, 'i'), '[.,;)]+$', '')), '') as doi from fx_cited""",
    ),
    "f8_doi_in_filename": (
        lambda s: s.fx_cited.select("publication_id", I.doi_in_filename(F.concat(F.lit("paper "), F.replace(I.doi_plain(c("doi")), F.lit("/"), F.lit("_")), F.lit("_v2.pdf"))).alias("doi")),
        rf"""with k as (select publication_id, {DOI.format('doi')} as own from fx_cited)
            select publication_id, case when own <> '' then lower(own || '.v2') end as doi from k""",
    ),
    "f9_arxiv_id": (
        lambda s: s.orders.select(
            "o_orderkey",
            I.arxiv_in(F.concat(F.lit("https://arxiv.org/abs/"), F.lpad((c("o_orderkey") % 100).cast("string"), 2, "0"), F.lpad((c("o_orderkey") % 15).cast("string"), 2, "0"), F.lit("."), F.lpad((c("o_orderkey") % 100000).cast("string"), 5, "0"), F.lit("v2?x=1"))).alias("linked"),
            I.arxiv_in(F.concat(F.lit("see arXiv: 1905."), F.lpad((c("o_orderkey") % 9000).cast("string"), 5, "0"), F.lit(", and more"))).alias("named"),
        ),
        """with k as (select o_orderkey, lpad(cast(o_orderkey % 100 as varchar), 2, '0') as a, lpad(cast(o_orderkey % 15 as varchar), 2, '0') as m, lpad(cast(o_orderkey % 100000 as varchar), 5, '0') as n from orders)
           select o_orderkey, case when m between '01' and '12' then a || m || '.' || n || 'v2' end as linked, '1905.' || lpad(cast(o_orderkey % 9000 as varchar), 5, '0') as named from k""",
    ),
    "f10_publisher": (lambda s: s.fx_cited.select("publication_id", I.publisher(c("doi"), F.lit(None).cast("string")).alias("p")).select("publication_id", "p.source", "p.landing_url", "p.fallback_url"), PUBLISHER_SQL),
    "f11_publisher_short_name": (
        lambda s: s.fx_citing.select("publication_id", I.publisher_short_name(c("doi"), c("venue")).alias("name")),
        "select publication_id, case when lower(concat_ws(' ', doi, venue)) like '%10.1145%' then 'ACM' else '' end as name from fx_citing",
    ),
    "f12_url_type": (
        lambda s: s.pages.select("page_id", I.url_type(F.when(c("page_id") % 3 == 0, F.concat("url", F.lit(".pdf?x=1"))).otherwise(c("url")), F.when(c("page_id") % 5 == 0, F.lit("declared"))).alias("kind")),
        r"""with k as (select page_id, lower(case when page_id % 3 = 0 then url || '.pdf?x=1' else url end) as v from pages)
            select page_id, case when page_id % 5 = 0 then 'declared' when regexp_replace(v, '[?#].*$', '') like '%.pdf' or regexp_replace(v, '[?#].*$', '') like '%/pdf/%' then 'direct_pdf' else 'landing_page' end as kind from k""",
    ),
    "f13_source_name": (
        lambda s: s.fx_cited.select("publication_id", I.source_name(c("doi"), F.lit("Metadata")).alias("site")),
        "select publication_id, case when doi like '%10.1145%' then 'ACM Digital Library' when doi like '%10.1109%' then 'IEEE Xplore' when doi is not null then 'DOI' else 'Metadata' end as site from fx_cited",
    ),
    "f14_restricted_publisher": (
        lambda s: s.fx_cited.select("publication_id", I.restricted_publisher(c("doi")).alias("restricted")),
        "select publication_id, doi is not null as restricted from fx_cited",
    ),
    "f15_author_list": (
        lambda s: s.fx_cited_author.groupBy("cited_id").agg(F.array_join(F.array_sort(F.collect_list("author")), " ; ").alias("a")).select("cited_id", F.array_join(N.author_list(F.replace("a", F.lit("UNITED KINGDOM"), F.lit("Ann and Bob,Cy"))), "|").alias("authors")),
        """select cited_id, string_agg(author, '|' order by author) as authors from (
               select cited_id, case when author = 'UNITED KINGDOM' then 'Ann|Bob|Cy' else author end as author, author as k from fx_cited_author) group by cited_id""",
    ),
    "f16_year_in_text": (
        lambda s: s.orders.select("o_orderkey", N.year_in_text(F.concat(F.lit("no 1234, in "), F.col("o_orderdate").cast("string"))).alias("year")),
        "select o_orderkey, cast(extract(year from o_orderdate) as int) as year from orders",
    ),
    "f18_citing_paper_info": (
        lambda s: s.fx_citing.select("publication_id", N.citing_paper_info(F.concat(F.lit("["), F.coalesce("venue", F.lit("Arxiv")), F.lit(" '"), F.substring(c("year").cast("string"), 3, 2), F.lit(" Oral] "), c("title"), F.lit("."))).alias("i")).select("publication_id", "i.*"),
        "select publication_id, title, coalesce(venue, 'Arxiv') as venue, case when year >= 2000 then year else year + 100 end as year, 'Oral' as type from fx_citing",
    ),
    "f19_provider_name": (
        lambda s: s.documents.select("doc_id", N.provider_name(F.concat(F.element_at(F.array(*(F.lit(x) for x in ("Google Books ", "my SCHOLAR list ", "self-published ", "a web page ", None))), (c("doc_id") % 5 + 1).cast("int")), "source")).alias("provider")),
        "select doc_id, case when doc_id % 5 < 3 or (doc_id % 5 = 3 and regexp_matches(lower(source), 'google|scholar|publish')) then 'google_scholar_import' else 'external_import' end as provider from documents",
    ),
    "f20_venue_tier": (
        lambda s: s.fx_citing.groupBy("venue", N.venue_tier(c("venue")).alias("tier")).agg(F.count(F.lit(1)).alias("n")),
        """select venue, case when lower(venue) like '%science%' or lower(venue) like '%nature%' then 'A' when lower(venue) like '%journal%' or lower(venue) like '%proceedings%' then 'B' when venue <> '' then 'C' else 'unknown' end as tier, count(*) as n
           from fx_citing group by 1, 2""",
    ),
    "f21_work_id": (
        lambda s: s.part.select("p_partkey", I.work_id(F.when(c("p_partkey") % 3 == 0, F.concat(F.lit("https://openalex.org/w"), "p_partkey")).when(c("p_partkey") % 3 == 1, F.concat(F.lit("W"), "p_partkey")).otherwise(F.lit("x12"))).alias("work")),
        "select p_partkey, case when p_partkey % 3 < 2 then 'W' || p_partkey end as work from part",
    ),
    "f22_best_open_location": (
        lambda s: s.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (c("l_returnflag") != "N").alias("is_open"), F.when(c("l_linestatus") == "F", F.concat(F.lit("pdf"), "l_linenumber")).alias("pdf_url"), F.concat(F.lit("page"), "l_linenumber").alias("landing_url")))).alias("p")).select("l_orderkey", I.best_open_location(c("p")).alias("b")).select("l_orderkey", "b.pdf_url", "b.landing_url"),
        """with k as (select l_orderkey, l_linenumber, l_returnflag <> 'N' as o, case when l_linestatus = 'F' then 'pdf' || l_linenumber end as pdf_url, 'page' || l_linenumber as landing_url from lineitem),
           r as (select *, row_number() over (partition by l_orderkey order by not o, pdf_url is null, l_linenumber, not o, pdf_url, landing_url) as rn from k)
           select l_orderkey, case when o then pdf_url end as pdf_url, case when o then landing_url end as landing_url from r where rn = 1""",
    ),
    "f23_author_page_id": (
        lambda s: s.supplier.select("s_suppkey", I.author_page_id(F.when(c("s_suppkey") % 2 == 0, F.concat(F.lit("https://dblp.org/pid/"), "s_nationkey", F.lit("/"), "s_suppkey", F.lit(".html"))).otherwise(F.concat(F.lit("pid:no "), "s_suppkey"))).alias("pid")),
        "select s_suppkey, case when s_suppkey % 2 = 0 then s_nationkey || '/' || s_suppkey end as pid from supplier",
    ),
    "f24_filename_title": (
        lambda s: s.fx_cited.select("publication_id", N.filename_title(F.concat(F.replace("title", F.lit(" "), F.lit("_")), F.lit("-arXiv_1905.01234v2.pdf"))).alias("title")),
        r"""select publication_id, trim(regexp_replace(replace(title, ' ', '_'), '[_\s-]+', ' ', 'g')) as title from fx_cited""",
    ),
    "f25_detected_title": (
        lambda s: s.documents.select("doc_id", N.detected_title(c("text")).alias("title")),
        """select doc_id, coalesce(substring(list_filter(list_transform(string_split(text, chr(10))[1:20], lambda x: trim(x)), lambda x: length(x) >= 12)[1], 1, 300), '') as title from documents""",
    ),
    "f26_json_number": (
        lambda s: s.events.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.size(N.json_list(c("props"))).alias("as_list")),
        "select event_id, try_cast(props::json->>'$.k' as int) as k, cast(0 as int) as as_list from events",
    ),
    "f27_highlight_keywords": (
        lambda s: s.documents.select("doc_id", F.array_join(N.highlight_keywords(F.array(F.lit("The"), F.lit("the"), F.lit(" est "), F.lit("zzz")), c("text")), "|").alias("words")),
        """select doc_id, concat_ws('|', case when contains(lower(text), 'the') then 'The' end, case when contains(lower(text), 'est') then 'est' end) as words from documents""",
    ),
    "f29_quote_key": (
        lambda s: s.documents.select("doc_id", N.canonical_quote_key(c("text")).alias("key")),
        f"select doc_id, substring({NORM.format('strip_accents(text)')}, 1, 220) as key from documents",
    ),
    "f30_label_and_confidence": (
        lambda s: s.events.select("event_id", N.evidence_label(F.when(c("event_id") % 2 == 0, F.lit(" Limitation")).otherwise(c("event_type"))).alias("label"), N.confidence((c("value") / 50).cast("string")).alias("confidence")),
        "select event_id, case when event_id % 2 = 0 then 'limitation_or_negative' else event_type end as label, greatest(0.0, least(1.0, value / 50)) as confidence from events",
    ),
    "f31_valid_arxiv_meta": (
        lambda s: s.part.select("p_partkey", F.map_filter(F.create_map(F.lit("arxiv_id"), F.concat(F.lit("1905."), F.lpad((c("p_partkey") % 4000).cast("string"), F.when(c("p_partkey") % 2 == 0, 4).otherwise(3), F.lit("0"))), F.lit("name"), c("p_name")), lambda k, v: (k != "arxiv_id") | I.arxiv_valid(v).isNotNull()).alias("m")).select("p_partkey", c("m")["arxiv_id"].alias("arxiv_id"), c("m")["name"].alias("name")),
        "select p_partkey, case when p_partkey % 2 = 0 then '1905.' || lpad(cast(p_partkey % 4000 as varchar), 4, '0') end as arxiv_id, p_name as name from part",
    ),
    "f32_precision_phrases": (
        lambda s: s.lineitem.select("l_orderkey", "l_linenumber", F.array_join(N.precision_phrases(F.concat(F.lit("gains of "), c("l_linenumber").cast("string"), F.lit(".5% and 3x, then 3X, and "), c("l_linenumber").cast("string"), F.lit(".5% again"))), "|").alias("phrases")),
        "select l_orderkey, l_linenumber, l_linenumber || '.5%|3x' as phrases from lineitem",
    ),
    "f33_redacted": (
        lambda s: s.conversations.select("conv_id", "turn", N.redacted(F.concat("text", F.lit(" api_key="), c("conv_id").cast("string"), F.lit(" Bearer a.b-c sk-abcdefgh1"))).alias("safe")),
        "select conv_id, turn, text || ' api_key=[redacted] Bearer [redacted] [redacted]' as safe from conversations",
    ),
}
