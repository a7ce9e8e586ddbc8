"""Publications and edges (J1 to J3, J14, J15, U1, W4, G3's batch form)."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.operators import graph as G

from .fixtures import Source

c = F.col
WS = r"trim(regexp_replace(lower(coalesce({0}, '')), '\s+', ' ', 'g'))"
KEY = r"nullif(lower(trim(regexp_replace(trim(coalesce({0}, '')), '^(https?://doi\.org/|doi:)', '', 'i'))), '')"


def _new_records(s: Source):
    """Every cited publication again as an incoming record: ids for some, DOI in other case for some, else title and year; and rows that nothing knows."""
    x = s.fx_cited
    k = c("publication_id") % 6
    return x.select(
        (c("publication_id") + 1).alias("ordinal"),
        F.when(k == 0, F.concat(F.lit("W"), "publication_id")).alias("work_id"),
        F.when(k < 3, F.upper("doi")).alias("doi"),
        F.when(k == 4, F.concat(F.lit("Unheard "), "title")).otherwise(F.concat(F.lit(" "), F.upper("title"))).alias("title"),
        "year",
    )


NEW = """(select publication_id + 1 as ordinal, case when publication_id % 6 = 0 then 'W' || publication_id end as work_id, case when publication_id % 6 < 3 then upper(doi) end as doi,
         case when publication_id % 6 = 4 then 'Unheard ' || title else ' ' || upper(title) end as title, year from fx_cited)"""


def _known(s: Source):
    return s.fx_cited.select("publication_id", F.concat(F.lit("W"), "publication_id").alias("work_id"), "doi", "title", "year")


def _edges(s: Source):
    return s.fx_edge.select("session_id", "cited_id", "citing_id", F.create_map(F.lit("rows"), c("n_rows").cast("string"), F.lit("state"), c("pdf_readiness_status")).alias("meta"))


def _arriving(s: Source):
    """Two rows of an edge each, in order: the second brings one entry again, one of its own and a null."""
    x = s.fx_edge.where(c("citing_id") % 3 == 0).select("session_id", "cited_id", F.when(c("citing_id") % 2 == 0, c("citing_id")).otherwise(-c("citing_id")).alias("citing_id"))
    one = x.withColumns({"meta": F.create_map(F.lit("state"), F.when(c("cited_id") % 2 == 0, F.lit("new")), F.lit("page"), F.lit("1")), "ordinal": F.lit(1)})
    two = x.where(c("cited_id") % 5 < 3).withColumns({"meta": F.create_map(F.lit("page"), F.when(c("cited_id") % 5 < 2, F.lit("2")), F.lit("seen"), F.lit("again")), "ordinal": F.lit(2)})
    return one.unionByName(two)


def _some_known(s: Source):
    """What a store knows of the cited works: half of them, ids missing here and there."""
    k = c("publication_id")
    return s.fx_cited.where(k % 2 == 0).select(k, F.when(k % 4 == 0, F.concat(F.lit("W"), k % 97)).alias("work_id"), F.when(k % 3 == 0, c("doi")).alias("doi"), "title", "year")


def _chained(s: Source):
    """Records that meet each other: titles, DOIs and work ids of the cited works and of their neighbours, so that one record brings the id by which another is found."""
    k, n = c("publication_id"), s.fx_cited.select((c("publication_id") + 1).alias("next_id"), c("doi").alias("next_doi"))
    x = s.fx_cited.join(n, k == c("next_id"), "left")
    return x.select((k + 1).alias("ordinal"), F.when(k % 3 != 0, F.concat(F.lit("W"), k % 97)).alias("work_id"), F.when(k % 4 == 1, c("doi")).when(k % 4 == 2, c("next_doi")).alias("doi"), F.when(k % 5 == 0, F.lit("Shared title")).otherwise(c("title")).alias("title"), "year")


def j1(s: Source):
    return G.resolve_publications(_new_records(s), _known(s)).select("ordinal", "publication_id", "matched_by")


J1 = f"""
    with n as (select *, {KEY.format('doi')} as kd, nullif({WS.format('title')}, '') as kt, coalesce(year, 0) as ky from {NEW}),
    old as (select publication_id, 'W' || publication_id as work_id, {KEY.format('doi')} as kd, nullif({WS.format('title')}, '') as kt, coalesce(year, 0) as ky from fx_cited),
    w as (select work_id, min(publication_id) as id from old group by 1), d as (select kd, min(publication_id) as id from old where kd is not null group by 1), t as (select kt, ky, min(publication_id) as id from old where kt is not null group by 1, 2),
    m as (select n.*, w.id as wi, d.id as di, t.id as ti from n left join w using (work_id) left join d on n.kd = d.kd left join t on n.kt = t.kt and n.ky = t.ky)
    select ordinal, coalesce(wi, di, ti, -min(ordinal) over (partition by coalesce(wi, di, ti), coalesce('d:' || kd, 't:' || kt || '|' || ky))) as publication_id,
           case when wi is not null then 'work_id' when di is not null then 'doi' when ti is not null then 'title_year'
                when ordinal = min(ordinal) over (partition by coalesce(wi, di, ti), coalesce('d:' || kd, 't:' || kt || '|' || ky)) then 'new' else 'title_year' end as matched_by from m"""

# the ordered choice as rounds: those whose earlier rivals are all decided are decided, until none is left
J2 = f"""
    with recursive n as (select publication_id as ordinal, session_id, {WS.format('title')} || '|' || year as kt, {KEY.format('doi')} as kd from fx_cited),
    f as (select * from n where ordinal % 10 <> 0 and not exists (select 1 from n p where p.ordinal % 10 = 0 and p.session_id = n.session_id and (p.kt = n.kt or p.kd = n.kd))),
    rivals as (select a.ordinal as late, b.ordinal as early from f a join f b on a.session_id = b.session_id and b.ordinal < a.ordinal and (a.kt = b.kt or a.kd = b.kd)),
    rounds as (
        select 0 as i, (select list(ordinal) from f) as entered
        union all
        select i + 1, (select list(ordinal) from f where ordinal not in (select late from rivals where list_contains(r.entered, early))) from rounds r where i < 12)
    select ordinal, session_id from f where list_contains((select entered from rounds where i = 12), ordinal)"""

PLANS = {
    "j1_resolve_publications": (j1, J1),
    "j1_chained_records": (lambda s: G.resolve_publications(_chained(s), _some_known(s)).select("ordinal", "publication_id", "matched_by"), None),
    "j1_stored_publications": (lambda s: G.stored_publications(_chained(s), _some_known(s)), None),
    "j2_add_session_publications": (
        lambda s: G.add_session_publications(s.fx_cited.select((c("publication_id")).alias("ordinal"), "session_id", "title", "year", "doi"), s.fx_cited.where("publication_id % 10 = 0").select("session_id", "title", "year", "doi")).select("ordinal", "session_id"),
        J2,
    ),
    "j3_joined_edges": (
        lambda s: G.joined_edges(s.fx_edge, s.fx_cited.where("publication_id % 9 <> 0"), s.fx_citing.withColumn("citing_authors", F.array("author"))).select("session_id", "cited_id", "citing_id", "cited_title", "citing_title", "year"),
        "select e.session_id, cited_id, citing_id, a.title as cited_title, b.title as citing_title, b.year from fx_edge e join fx_cited a on a.publication_id = cited_id join fx_citing b on b.publication_id = citing_id where cited_id % 9 <> 0",
    ),
    "u1_upsert_edges": (
        lambda s: G.upsert_edges(_edges(s), _arriving(s)).select("session_id", "cited_id", "citing_id", c("meta")["rows"].alias("rows"), c("meta")["state"].alias("meta_state"), c("meta")["page"].alias("page"), c("meta")["seen"].alias("seen"), "state"),
        """with n as (select session_id, cited_id, case when citing_id % 2 = 0 then citing_id else -citing_id end as citing_id, case when cited_id % 2 = 0 then 'new' end as st,
                             case when cited_id % 5 < 2 then '2' else '1' end as page, case when cited_id % 5 < 3 then 'again' end as seen from fx_edge where citing_id % 3 = 0)
           select coalesce(e.session_id, n.session_id) as session_id, coalesce(e.cited_id, n.cited_id) as cited_id, coalesce(e.citing_id, n.citing_id) as citing_id, cast(e.n_rows as varchar) as rows,
                  coalesce(n.st, e.pdf_readiness_status) as meta_state, n.page, n.seen, case when e.cited_id is null then 'inserted' when n.cited_id is null then 'kept' else 'merged' end as state
           from fx_edge e full join n on e.session_id = n.session_id and e.cited_id = n.cited_id and e.citing_id = n.citing_id""",
    ),
    "j14_existing_edges": (
        lambda s: G.existing_edges(
            s.fx_edge.join(s.fx_citing.select(c("publication_id").alias("p"), "doi"), c("citing_id") == c("p")).select((c("citing_id") * 100000 + c("cited_id")).alias("record_id"), "session_id", "cited_id", F.when(c("citing_id") % 2 == 0, c("citing_id")).otherwise(-1).alias("citing_id"), "doi"),
            s.fx_edge,
            s.fx_citing,
        ).select("record_id", "citing_id"),
        "select citing_id * 100000 + cited_id as record_id, case when citing_id % 2 = 0 then citing_id else -1 end as citing_id from fx_edge where citing_id % 2 = 0 or citing_id % 3 <> 0",
    ),
    "j15_target_publications": (
        lambda s: G.target_publications(s.fx_cited.withColumn("selected", c("publication_id") % 50 == 7)),
        "select session_id, coalesce(min(publication_id) filter (publication_id % 50 = 7), min(publication_id)) as target_id from fx_cited group by session_id",
    ),
    "w4_local_codes": (
        lambda s: G.local_codes(s.fx_cited.select("session_id", "publication_id"), "S", "session_id", "publication_id"),
        "select session_id, publication_id, printf('S%03d', row_number() over (partition by session_id order by publication_id)) as local_code from fx_cited",
    ),
}
