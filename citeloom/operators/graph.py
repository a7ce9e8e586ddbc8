"""Publications and the edges between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.identifiers import doi_key
from citeloom.functions.names import norm_title_ws
from citeloom.rounds import numbered, settled, written


#: New publications are numbered after all known ones while a batch is resolved; known ids are smaller than this.
NEW = 1 << 62


def _keyed(df: DataFrame) -> DataFrame:
    title = F.nullif(norm_title_ws(F.col("title")), F.lit(""))
    return df.withColumns({"k_work": F.nullif("work_id", F.lit("")), "k_doi": doi_key(F.col("doi")), "k_title": F.concat(title, F.lit("|"), F.coalesce(F.col("year"), F.lit(0)).cast("string"))})


#: The keys by which a record finds its publication, in this order, and what a match by each is called.
KEYS = {"k_work": "work_id", "k_doi": "doi", "k_title": "title_year"}


def _holders(members: DataFrame, key: str, publication_key: str) -> DataFrame:
    """Who holds a key since when: a publication that lacks it takes it from the first of its records that has it. One row for each key, with the steps at which its smallest holder changes."""
    taken = members.where(f"{key} is not null and {publication_key} is null").groupBy("publication").agg(F.min(F.struct("ordinal", key)).alias("m")).select(F.col(f"m.{key}").alias("held"), F.col("m.ordinal").alias("since"), "publication")
    return _steps(taken)


def _steps(taken: DataFrame) -> DataFrame:
    before = F.min("publication").over(Window.partitionBy("held").orderBy("since").rowsBetween(Window.unboundedPreceding, -1))
    changes = taken.withColumn("before", before).where("before is null or publication < before")
    return changes.groupBy("held").agg(F.collect_list(F.struct("since", "publication")).alias("steps"))


def _resolved(new: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with their keys, known owners and publication; and the members of all publications with what the known ones lack."""
    rows, old = _keyed(new), _keyed(known)
    for key in KEYS:
        owner = old.where(f"{key} is not null").groupBy(F.col(key).alias("o_key")).agg(F.min("publication_id").alias(f"known_{key}"))
        rows = rows.join(owner, F.col(key) == F.col("o_key"), "left").drop("o_key")
    rows = written(rows.select("ordinal", *KEYS, *(f"known_{k}" for k in KEYS)), "records")
    # a publication matters where a record's key leads to it
    wanted = rows.select(F.explode(F.array(*(f"known_{k}" for k in KEYS))).alias("want")).where("want is not null").distinct()
    lacks = written(old.join(wanted, F.col("publication_id") == F.col("want")).select("publication_id", F.col("k_work").alias("p_work"), F.col("k_doi").alias("p_doi")), "known")

    def members(decided: DataFrame) -> DataFrame:
        own = decided.join(rows.withColumnRenamed("ordinal", "r_ordinal"), F.col("ordinal") == F.col("r_ordinal"))
        return own.join(lacks, F.col("publication") == F.col("publication_id"), "left")

    def step(decided: DataFrame) -> DataFrame:
        own = members(decided)
        made = own.where(F.col("publication") == F.col("ordinal") + NEW)
        held = {"k_work": _holders(own, "k_work", "p_work"), "k_doi": _holders(own, "k_doi", "p_doi"), "k_title": _steps(made.where("k_title is not null").select(F.col("k_title").alias("held"), F.col("ordinal").alias("since"), "publication"))}
        out = rows
        for key, table in held.items():
            then = F.array_min(F.transform(F.filter("steps", lambda x: x["since"] < F.col("ordinal")), lambda x: x["publication"]))
            out = out.join(table, F.col(key) == F.col("held"), "left").withColumn(f"by_{key}", F.least(f"known_{key}", then)).drop("held", "steps")
        # the first key that has an owner, and the owner
        found = F.coalesce(*(F.when(F.col(f"by_{k}").isNotNull(), F.struct(F.col(f"by_{k}").alias("publication"), F.lit(how).alias("matched_by"))) for k, how in KEYS.items()), F.struct((F.col("ordinal") + NEW).alias("publication"), F.lit("new").alias("matched_by")))
        return out.select("ordinal", found.alias("found")).select("ordinal", "found.publication", "found.matched_by")

    guess = rows.select("ordinal", F.coalesce(*(f"known_{k}" for k in KEYS), F.col("ordinal") + NEW).alias("publication"), F.lit("").alias("matched_by"))
    return (decided := settled(guess, step, "ordinal", "publication")), members(decided)


def _public(id_: Column) -> Column:
    """New publications get the negated ordinal of their first record as id."""
    return F.when(id_ >= NEW, NEW - id_).otherwise(id_)


def _fills(members: DataFrame, key: str, publication_key: str, into: str) -> DataFrame:
    return members.where(f"{key} is not null and {publication_key} is null").groupBy(F.col("publication").alias("f_publication")).agg(F.min_by(key, "ordinal").alias(into))


def resolve_publications(new: DataFrame, known: DataFrame) -> DataFrame:
    """new with publication_id and matched_by, as if its records came one by one in order of ordinal: a record is of the publication that holds its work_id, else its DOI, else its title and year; else it makes a new one, whose id is
    its negated ordinal. A publication that lacks a work_id or DOI takes that of the first record of its own that has one, and later records find it by that. Of several holders the smallest id counts, known before new.

    new: ordinal (unique, positive), work_id, doi, title, year. known: publication_id (below NEW), work_id, doi, title, year. Keys of the result are compared as doi_key() and norm_title_ws() give them; a null or empty key finds nothing.
    The ordered rule is a fixed point of rounds (see citeloom.rounds), so no batch, session or key is gathered in one task.
    """
    decided, _ = _resolved(new, known)
    own = decided.select(F.col("ordinal").alias("d_ordinal"), _public(F.col("publication")).alias("publication_id"), "matched_by")
    return new.join(own, F.col("ordinal") == F.col("d_ordinal")).drop("d_ordinal")


def stored_publications(new: DataFrame, known: DataFrame) -> DataFrame:
    """The publications after resolve_publications(): publication_id, work_id, doi (normal form), title, year, state (kept, filled, new). Missing ids of known ones are filled by their records."""
    decided, members = _resolved(new, known)
    fills = _fills(members, "k_work", "p_work", "f_work").join(_fills(members, "k_doi", "p_doi", "f_doi"), "f_publication", "full")
    old = _keyed(known).select("publication_id", F.col("k_work").alias("own_work"), F.col("k_doi").alias("own_doi"), "title", "year", F.lit("kept").alias("was"))
    made = decided.where(F.col("publication") == F.col("ordinal") + NEW).select(F.col("ordinal").alias("m_ordinal")).join(new, F.col("ordinal") == F.col("m_ordinal"))
    made = made.select((F.col("ordinal") + NEW).alias("publication_id"), F.lit(None).cast("string").alias("own_work"), F.lit(None).cast("string").alias("own_doi"), "title", "year", F.lit("new").alias("was"))
    every = old.unionByName(made).join(fills, F.col("publication_id") == F.col("f_publication"), "left")
    filled = (F.col("was") == "kept") & ((F.col("own_work").isNull() & F.col("f_work").isNotNull()) | (F.col("own_doi").isNull() & F.col("f_doi").isNotNull()))
    return every.select(_public(F.col("publication_id")).alias("publication_id"), F.coalesce("own_work", "f_work").alias("work_id"), F.coalesce("own_doi", "f_doi").alias("doi"), "title", "year", F.when(filled, "filled").otherwise(F.col("was")).alias("state"))


def add_session_publications(new: DataFrame, present: DataFrame) -> DataFrame:
    """The rows of new (ordinal, session_id, title, year, doi) that enter their session, taken one by one in order of ordinal: a row stays out where a row that is present, or entered before, has its title and year or its DOI.

    A row that stays out keeps no other one out. The ordered choice is a fixed point of rounds (see citeloom.rounds)."""
    k = lambda df: df.withColumns({"k_title": F.concat(norm_title_ws(F.col("title")), F.lit("|"), F.coalesce(F.col("year"), F.lit(0)).cast("string")), "k_doi": doi_key(F.col("doi"))})
    old = k(present)
    rows = k(new).select("ordinal", "session_id", "k_title", "k_doi")
    for key in ("k_title", "k_doi"):
        taken = old.select(F.col("session_id").alias("p_session"), F.col(key).alias("p_key")).where("p_key is not null").distinct()
        rows = rows.join(taken, (F.col("session_id") == F.col("p_session")) & (F.col(key) == F.col("p_key")), "left_anti")
    rows = written(rows, "records")

    def step(decided: DataFrame) -> DataFrame:
        entered = rows.join(decided.where("entered").select(F.col("ordinal").alias("e_ordinal")), F.col("ordinal") == F.col("e_ordinal"))
        out = rows
        for key in ("k_title", "k_doi"):
            first = entered.where(f"{key} is not null").groupBy(F.col("session_id").alias("f_session"), F.col(key).alias("f_key")).agg(F.min("ordinal").alias(f"first_{key}"))
            out = out.join(first, (F.col("session_id") == F.col("f_session")) & (F.col(key) == F.col("f_key")), "left").drop("f_session", "f_key")
        free = [F.coalesce(F.col(f"first_{key}") >= F.col("ordinal"), F.lit(True)) for key in ("k_title", "k_doi")]
        return out.select("ordinal", (free[0] & free[1]).alias("entered"))

    decided = settled(rows.select("ordinal", F.lit(True).alias("entered")), step, "ordinal", "entered")
    return new.join(decided.where("entered").select(F.col("ordinal").alias("e_ordinal")), F.col("ordinal") == F.col("e_ordinal"), "left_semi")


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges with new ones merged by (session_id, cited_id, citing_id), in order of ordinal: each non-null entry of a new meta map wins over what the edge has under its key by then."""
    keys = ["session_id", "cited_id", "citing_id"]
    # the latest value of each edge and entry; an edge without entries stays with a null one
    latest = new.select(*keys, "ordinal", F.explode_outer("meta").alias("k", "v")).groupBy(*keys, F.when(F.col("v").isNotNull(), F.col("k")).alias("k")).agg(F.max_by("v", "ordinal").alias("v"))
    fresh = latest.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))).alias("given"))
    old = edges.select(*keys, F.col("meta").alias("old_meta"), F.lit(True).alias("known"))
    none = F.create_map().cast("map<string,string>")
    given = F.coalesce("given", none)
    kept = F.map_filter(F.coalesce("old_meta", none), lambda k, _: ~F.map_contains_key(given, k))
    joined = old.join(fresh, keys, "full")
    state = F.when(F.col("known").isNull(), "inserted").when(F.col("given").isNull(), "kept").otherwise("merged")
    return joined.select(*keys, F.map_concat(kept, given).alias("meta"), state.alias("state"))


def expanded(edges: DataFrame, page: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One step of citation expansion: edges with a provider's page (session_id, cited_id, citing_id, provider) merged in, and by session what it brought: fetched, added, duplicates (edges known before, and
    repeats within the page). A known edge keeps its provider."""
    keys = ["session_id", "cited_id", "citing_id"]
    fresh = page.groupBy(*keys).agg(F.min("provider").alias("new_provider"), F.count(F.lit(1)).alias("seen"))
    old = edges.groupBy(*keys).agg(F.min("provider").alias("old_provider"))
    both = old.join(fresh, keys, "full")
    merged = both.select(*keys, F.coalesce("old_provider", "new_provider").alias("provider"))
    new = F.col("old_provider").isNull()
    counts = both.where("seen is not null").groupBy("session_id").agg(F.sum("seen").alias("fetched"), F.count_if(new).alias("added"), F.sum(F.col("seen") - F.when(new, 1).otherwise(0)).alias("duplicates"))
    return merged, counts


def joined_edges(edges: DataFrame, cited: DataFrame, citing: DataFrame) -> DataFrame:
    """Edges with both publications; an edge that misses one goes."""
    a = cited.select(F.col("publication_id").alias("cited_id"), F.col("title").alias("cited_title"), F.col("doi").alias("cited_doi"))
    b = citing.select(F.col("publication_id").alias("citing_id"), F.col("title").alias("citing_title"), "venue", "year", "citing_authors", "queue_status")
    return edges.join(a, "cited_id").join(b, "citing_id")


def existing_edges(records: DataFrame, edges: DataFrame, citing: DataFrame) -> DataFrame:
    """The records (record_id, session_id, cited_id, citing_id, doi) whose edge exists: by ids, or by the DOI of any citing publication of the same cited one."""
    ids = edges.select(F.col("session_id").alias("e_session"), F.col("cited_id").alias("e_cited"), F.col("citing_id").alias("e_citing"))
    same = (F.col("session_id") == F.col("e_session")) & (F.col("cited_id") == F.col("e_cited"))
    by_id = records.join(ids, same & (F.col("citing_id") == F.col("e_citing")), "left_semi")
    dois = ids.join(citing.select(F.col("publication_id").alias("e_citing"), doi_key(F.col("doi")).alias("e_doi")), "e_citing").where("e_doi is not null")
    by_doi = records.join(dois, same & (doi_key(F.col("doi")) == F.col("e_doi")), "left_semi")
    return by_id.unionByName(by_doi).distinct()


def target_publications(session_publications: DataFrame) -> DataFrame:
    """session_id and its target: the first selected publication, else the first."""
    return session_publications.groupBy("session_id").agg(F.min_by("publication_id", F.struct(~F.col("selected"), F.col("publication_id"))).alias("target_id"))


def local_codes(rows: DataFrame, prefix: str, group: str, order: str) -> DataFrame:
    """S001, S002, ... in each group, in input order."""
    return numbered(rows, group, [F.col(order)], "place").withColumn("local_code", F.format_string(f"{prefix}%03d", "place")).drop("place")
