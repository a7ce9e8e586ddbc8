"""Positions in a session: rows are made once, and the first of each session come from one window limit."""

from pyspark.sql import functions as F

from citeloom.operators import queue as Q
from citeloom.plans import registry
from citeloom.rounds import numbered


def test_numbered_rows_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(200).selectExpr("id % 3 as s", "id").repartition(4).mapInArrow(run, "s long, id long")
    got = {(r.s, r.id): r.n for r in numbered(rows, "s", [F.desc("id")], "n").collect()}
    assert got == {(i % 3, i): sum(j % 3 == i % 3 for j in range(i, 200)) for i in range(200)}
    assert made.value == 200


def test_top_of_a_session(spark):
    rows = [(s, i % 5, 2000 + i % 3, "A", "manual_pdf", i, i) for s in "ab" for i in range(60)] + [("c", 1, 2000, "B", "need_pdf", 1, 1)]
    queue = spark.createDataFrame([(s, float(p), *r) for s, p, *r in rows], "session_id string, priority_score double, year int, venue_tier string, pdf_readiness_status string, cited_id long, citing_id long").repartition(3)
    key = lambda df: sorted((r.session_id, r.position, r.cited_id) for r in df.collect())
    top = Q.top(queue, 7)
    assert key(top) == key(Q.ranked(queue).where("position <= 7")) and len(key(top)) == 15
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_names_of_publications_are_normal_once(spark):
    edges = spark.createDataFrame([(1, 5, ["ann  LEE"]), (2, 5, ["Bo"]), (3, 5, ["Bo"])], "cited_id long, citing_id long, citing_authors array<string>").selectExpr("*", "'V' as venue", "2000 as year", "'need_pdf' as pdf_readiness_status", "'' as queue_status")
    authors = spark.createDataFrame([(1, "Ann Lee"), (1, "BO"), (2, "Ann Lee")], "cited_id long, author string")
    got = {r.cited_id: (r.self_citation_status, r.third_party_status) for r in Q.build_queue(edges, authors, 2000).collect()}
    assert got == {1: ("self_citation", "not_third_party"), 2: ("not_self_citation", "third_party"), 3: ("unknown", "ambiguous")}


def test_edges_are_dealt_out_before_sessions_are_counted(spark):
    rows = [("a", 1, 10, "manual_pdf"), ("a", 2, 10, "need_pdf"), ("a", 2, None, "reused_pdf"), ("b", 3, 11, None), (None, 4, 12, "manual_pdf")]
    edges = spark.createDataFrame(rows, "session_id string, cited_id long, citing_id long, pdf_readiness_status string")
    got = {tuple(r) for r in Q.edge_counts(edges).collect()}
    assert got == {("a", 3, 1, 2), ("b", 1, 1, 0), (None, 1, 1, 1)}
    stats = registry.QUERIES["a3_workflow_stats"](spark, "/root/testdata/sf0.001")
    plan = stats._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    sorting = plan[plan.index("REPARTITION_BY_NUM") :].split("ENSURE_REQUIREMENTS")[0]
    assert "SortAggregate" in sorting and "HashAggregate" not in sorting
    assert plan.count("REPARTITION_BY_NUM") == 2 and "Sort" not in plan[plan.rindex("REPARTITION_BY_NUM") :].split("BroadcastExchange")[0]
