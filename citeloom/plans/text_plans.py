"""Texts and anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.operators import anchors as A

from .fixtures import Source

c = F.col
NORM = r"trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


def _refs(s: Source):
    """Texts with three reference entries of cited publications, one marker twice."""
    p = s.fx_cited.select("publication_id", "title", "year", "doi")
    k = [(c("doc_id") * (3 + i) + i) % 2000 for i in range(3)]
    rows = s.fx_text.select("doc_id", "marked", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), k[i].alias("pid")) for i in range(3)))).alias("e")).select("doc_id", "marked", "e.*")
    rows = rows.join(p, c("pid") == c("publication_id"), "left")
    entry = F.concat(F.lit("["), F.when(c("i") == 2, 2).otherwise(c("i") + 1).cast("string"), F.lit("] Smith, J., \""), F.coalesce("title", F.lit("none")), F.lit("\". Journal of Tests, "), F.coalesce(c("year").cast("string"), F.lit("1999")), F.lit(". "), F.coalesce("doi", F.lit("")))
    return rows.groupBy("doc_id").agg(F.first("marked").alias("marked"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", entry.alias("t")))), lambda x: x["t"]), "\n").alias("r")).select("doc_id", F.concat("marked", F.lit("\nReferences\n"), "r").alias("text"))


def _unheaded(s: Source):
    """Texts whose reference list has no heading; in a third of them its numbers leave a gap that makes it no list."""
    number = F.when((c("i") == 2) & (c("doc_id") % 3 == 0), 9).otherwise(c("i") + 1).cast("string")
    rows = s.fx_text.select("doc_id", "marked", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")).withColumn("entry", F.concat(F.lit("["), number, F.lit("] Smith, J., \"On "), c("doc_id").cast("string"), F.lit(" things\". Journal of Tests, 1999.")))
    lists = rows.groupBy("doc_id").agg(F.max("marked").alias("marked"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "entry"))), lambda x: x["entry"]), "\n").alias("r"))
    return lists.select("doc_id", F.concat("marked", F.lit("\n"), "r").alias("text"))


UNHEADED = """
    e as (select doc_id, marked, i, case when i = 2 and doc_id % 3 = 0 then 9 else i + 1 end as number from (select doc_id, marked, unnest([0, 1, 2]) as i from fx_text)),
    x as (select *, '[' || number || '] Smith, J., "On ' || doc_id || ' things". Journal of Tests, 1999.' as entry, number - lag(number) over (partition by doc_id order by i) as step from e),
    g as (select *, sum(case when step between 1 and 3 then 0 else 1 end) over (partition by doc_id order by i) as run, sum(length(entry) + 1) over (partition by doc_id order by i) - length(entry) + length(marked) as start from x),
    islands as (select doc_id, run, min(start) as start from g group by all having count(*) >= 3),
    last as (select doc_id, max(run) as run, max_by(start, run) as start from islands group by 1)"""

REFS = """
    e as (select doc_id, i, '[' || case when i = 2 then 2 else i + 1 end || '] Smith, J., "' || coalesce(title, 'none') || '". Journal of Tests, ' || coalesce(cast(year as varchar), '1999') || '. ' || coalesce(doi, '') as entry, case when i = 2 then 2 else i + 1 end as marker, title, year
          from (select doc_id, unnest([0, 1, 2]) as i from fx_text) left join fx_cited on publication_id = (doc_id * (3 + i) + i) % 2000)"""
BOUNDS = "target_marker = cast(doc_id % 40 + 1 as varchar) or cast(target_marker as int) between doc_id % 7 + 1 and doc_id % 7 + 4"


def _anchored(s: Source):
    t = s.fx_text.select("doc_id", F.substring_index("marked", " It follows ", -1).alias("quote"), "target_marker", "source")
    marker = F.when(c("doc_id") % 10 != 0, F.concat(F.lit("["), "target_marker", F.lit("]")))
    quote = F.when(c("doc_id") % 5 == 1, F.lit("no marker, small widget here")).otherwise(c("quote"))
    return t.select("doc_id", A.validate_anchor(quote, marker, A.target_aliases(F.lit("Small widget: a study"), F.array().cast("array<string>"), F.lit(""))).alias("v")).select("doc_id", "v.*")


ANCHORED = f"""
    select doc_id, case when doc_id % 10 = 0 then 'unknown' when doc_id % 5 = 1 then 'valid' when {BOUNDS} then 'valid_grouped' else 'invalid' end as status,
           case when doc_id % 10 = 0 then 'no_target_reference_marker_available' when doc_id % 5 = 1 then 'title_alias_anchor_found' when {BOUNDS} then 'citation_text_contains_target_marker' else 'cited_other_reference_marker' end as reason,
           doc_id % 10 <> 0 and doc_id % 5 <> 1 and ({BOUNDS}) as has_target, doc_id % 10 <> 0 and doc_id % 5 <> 1 as has_other from fx_text"""

PLANS = {
    "x1_sentences": (
        lambda s: A.sentences(s.documents).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.sum("stop").alias("stops"), F.sum(F.length("sentence")).alias("chars")),
        """with p as (select doc_id, regexp_extract_all(text, '[^.!?。！？]+[.!?。！？]?') as raw, string_split_regex(text, '[^.!?。！？]+[.!?。！？]?') as gaps from documents),
           u as (select doc_id, unnest(raw) as r, unnest(gaps[:len(raw)]) as g, generate_subscripts(raw, 1) as i from p),
           s as (select *, sum(length(g)) over (partition by doc_id order by i) + sum(length(r)) over (partition by doc_id order by i) - length(r) as start from u)
           select doc_id, count(*) as n, cast(sum(start) as bigint) as starts, cast(sum(start + length(r)) as bigint) as stops, cast(sum(length(trim(r))) as bigint) as chars from s where trim(r) <> '' group by doc_id""",
    ),
    "x2_candidate_spans": (
        lambda s: A.candidate_spans(A.sentences(s.documents), s.documents.select("doc_id", F.when(c("lang") == "en", "the thing that").otherwise("dans chen ciónes mente").alias("title"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("places")),
        f"""with u as (select doc_id, lang, unnest(regexp_extract_all(text, '[^.!?。！？]+[.!?。！？]?')) as r, generate_subscripts(regexp_extract_all(text, '[^.!?。！？]+[.!?。！？]?'), 1) - 1 as pos from documents),
            k as (select *, {NORM.format('trim(r)')} as norm, case when lang = 'en' then 'the thing that' else 'dans chen ci nes mente' end as tt from u where trim(r) <> ''),
            h as (select * from k where contains(norm, tt) or case when lang = 'en' then cast(contains(norm, 'thing') as int) + cast(contains(norm, 'that') as int) else cast(contains(norm, 'dans') as int) + cast(contains(norm, 'chen') as int) + cast(contains(norm, 'mente') as int) end >= 2),
            n as (select *, row_number() over (partition by doc_id order by pos) as rank from h)
            select doc_id, count(*) as n, cast(sum(pos) as bigint) as places from n where rank <= 5 group by doc_id""",
    ),
    "x3_target_keywords": (
        lambda s: s.fx_cited.select("publication_id", F.array_join(A.target_keywords(F.concat(F.lit("Study: "), c("title"))), " ").alias("words")),
        f"select publication_id, array_to_string(list_filter(string_split({NORM.format('title')}, ' '), lambda x: length(x) >= 4), ' ') as words from fx_cited",
    ),
    "x5_body": (
        lambda s: _refs(s).select("doc_id", A.body_and_references(c("text")).alias("p")).select("doc_id", F.length("p.body").alias("body_chars"), F.length("p.refs").alias("ref_chars")),
        f"with {REFS} select t.doc_id, length(marked) + 1 as body_chars, length(r) + 1 as ref_chars from fx_text t join (select doc_id, string_agg(entry, chr(10) order by i) as r from e group by 1) x using (doc_id)",
    ),
    "x5_unheaded_bodies": (
        lambda s: A.body_ends(_unheaded(s)),
        f"with {UNHEADED} select doc_id, cast(coalesce(start, total) as int) as body_end from (select doc_id, max(length(marked)) + sum(length(entry) + 1) as total from x group by 1) left join last using (doc_id)",
    ),
    "x6_unheaded_entries": (lambda s: A.reference_entries(_unheaded(s)), f"with {UNHEADED} select doc_id, cast(number as varchar) as marker, entry from g join last using (doc_id, run)"),
    "x6_reference_entries": (
        lambda s: A.reference_entries(_refs(s)),
        f"with {REFS} select doc_id, cast(marker as varchar) as marker, trim(regexp_replace(entry, '\\s+', ' ', 'g')) as entry from e where i <> 1",
    ),
    "x7_bibliographic": (
        lambda s: A.reference_entries(_refs(s)).withColumn("entry", F.when(c("doc_id") % 4 == 1, "[1] Smith, J. says so.").when(c("doc_id") % 4 == 2, F.concat(F.lit("[1] In "), (c("doc_id") % 90 + 1900).cast("string"), F.lit(" a journal"))).when(c("doc_id") % 4 == 3, F.concat(F.rpad(F.lit("x"), 1900, "x"), "entry")).otherwise(c("entry"))).select("doc_id", "marker", A.is_bibliographic(c("entry")).alias("yes"), A.is_reference_entry(c("entry")).alias("strict")),
        f"with {REFS} select doc_id, cast(marker as varchar) as marker, doc_id % 4 in (0, 2) as yes, doc_id % 4 in (0, 2) as strict from e where i <> 1",
    ),
    "x8_target_references": (
        lambda s: A.resolve_targets(A.reference_entries(_refs(s)), s.fx_text.join(s.fx_cited.select("publication_id", "title", F.lit(None).cast("string").alias("doi"), F.lit("Smith").alias("author")), (c("doc_id") * 3) % 2000 == c("publication_id")).select("doc_id", "title", "doi", "author")),
        f"""with {REFS}, t as (select doc_id, {NORM.format('title')} as tt from fx_text join fx_cited on publication_id = (doc_id * 3) % 2000),
            k as (select e.doc_id, marker, {NORM.format('entry')} as en, tt, list_distinct(list_filter(string_split(tt, ' '), lambda x: length(x) >= 4)) as w from e join t on e.doc_id = t.doc_id where i <> 1),
            m as (select *, len(list_intersect(w, string_split(en, ' '))) / len(w) as o from k),
            f as (select doc_id, marker, case when contains(en, tt) or contains(replace(en, ' ', ''), replace(tt, ' ', '')) then 'title_exact' when o >= 0.75 then 'title_overlap' when o >= 0.55 then 'title_author_overlap' end as method,
                  case when contains(en, tt) then 0.98 when length(replace(tt, ' ', '')) >= 8 and contains(replace(en, ' ', ''), replace(tt, ' ', '')) then 0.96 when o >= 0.75 then 0.98 when o >= 0.55 then 0.75 end as score from m)
            select doc_id, cast(marker as varchar) as marker, method, score from (select *, row_number() over (partition by doc_id order by score desc, marker) as n from f where score is not null) where n = 1""",
    ),
    "x10_marker_membership": (lambda s: s.fx_text.select("doc_id", A.has_marker(c("marked"), c("target_marker")).alias("cited")), f"select doc_id, ({BOUNDS}) as cited from fx_text"),
    "x11_markers": (
        lambda s: s.fx_text.select("doc_id", F.array_join(A.markers(c("marked")), " ").alias("markers")),
        "select doc_id, array_to_string(list_sort(list_distinct([doc_id % 40 + 1, doc_id % 7 + 1, doc_id % 7 + 2, doc_id % 7 + 3, doc_id % 7 + 4])), ' ') as markers from fx_text",
    ),
    "x14_anchor_validation": (_anchored, ANCHORED),
    "x15_grouped": (
        lambda s: s.fx_text.select("doc_id", A.is_grouped(F.concat("text", F.lit(" as in "), F.element_at(F.array(*(F.lit(x) for x in ("[3]", "[3, 4]", "[3-5]", "[a, b]", "(3, 4)", "[3] and [4]", "[3 – 7]"))), (c("doc_id") % 7 + 1).cast("int")))).alias("grouped")),
        "select doc_id, doc_id % 7 in (1, 2, 6) or len(list_filter(regexp_extract_all(text, '\\[([^\\]]+)\\]', 1), lambda x: regexp_matches(x, '\\d+\\s*[,–—-]\\s*\\d+'))) > 0 as grouped from fx_text",
    ),
    "x16_quote_location": (lambda s: A.quote_location(s.benchmark, s.documents), "select item_id, doc_id, instr(d.text, b.text) - 1 as start from documents d join benchmark b on instr(d.text, b.text) > 0"),
    "x22_authors": (
        lambda s: s.fx_text.select("doc_id", A.body_author(F.concat(F.lit("Smith ["), "target_marker", F.lit("] and "), F.when(c("doc_id") % 3 == 0, "Table").when(c("doc_id") % 3 == 1, "Müller-Jones et al.").otherwise("Lee"), F.lit(" ["), "target_marker", F.lit("]")), c("target_marker")).alias("body"), A.entry_author(F.concat(F.lit("[3] J. Lee, A. Kim. Title "), "target_marker")).alias("entry")),
        "select doc_id, case doc_id % 3 when 0 then '' when 1 then 'Jones' else 'Lee' end as body, 'Lee' as entry from fx_text",
    ),
    "x23_reference_only": (
        lambda s: s.fx_text.select("doc_id", A.is_reference_entry(F.when(c("doc_id") % 2 == 0, F.concat(F.lit("[1] A. Kim. Title. Journal of Tests, vol 2, "), (c("doc_id") % 20 + 1995).cast("string"))).otherwise(c("marked"))).alias("entry")),
        "select doc_id, doc_id % 2 = 0 as entry from fx_text",
    ),
    "f3_f4_normal_forms": (lambda s: A.normal_forms(s.documents, "doc_id", "text").select("doc_id", F.length("ascii_form").alias("ascii_chars"), F.length("biblio_form").alias("biblio_chars")), None),
    "f4_biblio_form": (
        lambda s: A.normal_forms(s.documents.withColumn("text", F.concat(F.lit(" [7] "), "text")), "doc_id", "text").select("doc_id", F.length("biblio_form").alias("chars")),
        r"select doc_id, length(trim(regexp_replace(replace(lower(replace(text, chr(173), '')), 'ß', 'ss'), '[^\p{L}\p{N}]+', ' ', 'g'))) as chars from documents",
    ),
}
