"""Views of the given tables that stand for the operators' inputs: publications, edges, documents, texts, reviews.

Each view is one SQL text that Spark and DuckDB both run; {str} is the engine's text type. A view may use those before it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels conversations pages".split()

VIEWS: dict[str, str] = {
    "fx_cited": """
        select p_partkey as publication_id, p_brand as session_id,
               p_name || ' for ' || p_type || case when p_partkey % 7 = 0 then ': ' || p_brand else '' end as title,
               cast(2010 + p_size % 12 as int) as year,
               case when p_partkey % 5 = 0 then null else 'https://doi.org/10.' || case p_partkey % 4 when 0 then '1145' when 1 then '1109' when 2 then '1007' else '1016' end
                    || '/' || cast(p_partkey as {str}) end as doi
        from part""",
    "fx_citing": """
        select o_orderkey as publication_id, 'Study ' || cast(o_orderkey as {str}) || ' of ' || lower(c_mktsegment) as title,
               case o_orderpriority when '1-URGENT' then 'Nature Methods' when '2-HIGH' then 'Proceedings of Tests' when '3-MEDIUM' then 'Journal of Tests' when '4-NOT SPECIFIED' then null else 'Workshop' end as venue,
               cast(extract(year from o_orderdate) as int) as year, n_name as author,
               case o_orderstatus when 'F' then 'analyzed' when 'O' then 'selected' else 'pending' end as queue_status,
               case when o_orderkey % 3 = 0 then null else 'DOI:10.1145/S' || cast(o_orderkey as {str}) end as doi
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
    "fx_edge": """
        select p_brand as session_id, l_partkey as cited_id, l_orderkey as citing_id, count(*) as n_rows,
               case max(l_returnflag) when 'R' then 'manual_pdf' when 'A' then 'local_library_pdf' else 'need_pdf' end as pdf_readiness_status
        from lineitem join part on l_partkey = p_partkey group by p_brand, l_partkey, l_orderkey""",
    "fx_cited_author": """
        select distinct l_partkey as cited_id, n_name as author
        from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey""",
    "fx_text": """
        select doc_id, source, lang, text, text || ' It follows [' || cast(doc_id % 40 + 1 as {str}) || ', ' || cast(doc_id % 7 + 1 as {str}) || '-' || cast(doc_id % 7 + 4 as {str}) || '].' as marked,
               cast(doc_id % 45 + 1 as {str}) as target_marker
        from documents""",
    "fx_review": """
        select doc_id, case when toxic = 1 then 'false_positive' when quality = 1 then 'accepted' else 'rejected' end as review_status from labels""",
    # one asset for each document; a source of its own kind for each third
    "fx_asset": """
        select doc_id as asset_id, doc_id * 5 % 1500 + 1 as publication_id, text, length(text) as size_bytes,
               case doc_id % 3 when 0 then 'upload' when 1 then 'local_library' else 'web' end as source_type,
               case when doc_id % 4 = 0 then 'pending' else 'extracted' end as extract_status
        from documents""",
    "fx_evidence": """
        select d.doc_id as evidence_id, d.doc_id % 97 as item_id, 'S' || cast(d.doc_id % 7 as {str}) as session_id,
               case when d.doc_id % 31 = 0 then '' else d.text end as citation_text,
               case d.doc_id % 6 when 0 then 'detailed_comparison' when 1 then 'baseline_or_benchmark' when 2 then 'method_foundation' when 3 then 'limitation_or_negative' when 4 then 'background' else 'custom' end as evidence_type,
               case d.doc_id % 5 when 0 then 'positive' when 1 then 'neutral' when 2 then 'negative' when 3 then 'mixed' else 'neutral' end as stance,
               case d.doc_id % 8 when 0 then 'grouped_citation' when 1 then 'reference_only' when 2 then 'weak_mention' when 3 then 'background_mention' else 'direct_citation' end as mention_type,
               case d.doc_id % 3 when 0 then 'self_citation' when 1 then 'not_self_citation' else 'unknown' end as self_citation_status,
               case d.doc_id % 3 when 0 then 'not_third_party' when 1 then 'third_party' else 'ambiguous' end as third_party_status,
               coalesce(case when l.toxic = 1 then 'false_positive' when l.quality = 1 then 'accepted' when l.quality = 0 then 'rejected' end, 'unreviewed') as review_status,
               d.doc_id % 11 as result_no
        from documents d left join labels l on d.doc_id = l.doc_id""",
    # what users do with templates; every user creates some of their own, and later rows switch the newest of these
    "fx_template_log": """
        select session_id, ordinal, action, case when action = 'create' then 1000 + ordinal when value > 40 then 1000 + newest else cast(floor(value) as int) % 12 + 1 end as template_id,
               case when ordinal % 3 = 0 then null when ordinal % 3 = 1 then '' else event_type end as template_type, event_type as word
        from (select 'U' || cast(user_id as {str}) as session_id, event_id as ordinal, event_type, value,
                     case when event_type = 'signup' and value > 40 then 'create' when event_type = 'error' then 'disable' when event_type = 'view' then 'open' else 'enable' end as action,
                     max(case when event_type = 'signup' and value > 40 then event_id end) over (partition by user_id order by event_id) as newest
              from events) e""",
    "fx_result": """
        select event_id as result_id, user_id as item_id, ts as created_at, case when value > 20 then 'success' else 'failed' end as status, event_type as scope from events""",
}


def names_in(sql: str) -> list[str]:
    """The views that a query needs, in order of definition."""
    used: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                todo.append(VIEWS[name])
    return [n for n in VIEWS if n in used]


def oracle(sql: str) -> str:
    """A DuckDB query with the views that it names as common table expressions."""
    own = ", ".join(f"{n} as ({VIEWS[n].format(str='varchar')})" for n in names_in(sql))
    body = sql.strip()
    if not own:
        return body
    if body[:15].lower() == "with recursive ":
        return f"with recursive {own}, {body[15:]}"
    return f"with {own}, {body[5:]}" if body[:5].lower() == "with " else f"with {own} {body}"


class Source:
    """The tables and views of one folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in VIEWS:
            sql = VIEWS[name].format(str="string")
            used = [t for t in [*TABLES, *VIEWS] if t != name and re.search(rf"\b{t}\b", sql)]
            for t in used:
                sql = re.sub(rf"\b{t}\b", "{" + t + "}", sql)
            return self.spark.sql(sql, **{t: getattr(self, t) for t in used})
        raise AttributeError(name)


Query = Callable[[SparkSession, str], DataFrame]


def query(f: Callable[[Source], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(Source(spark, sf_dir))
