"""What a ranked queue writes and deals out, and that its reasons are those of the queue."""

import pathlib

from pyspark.sql import functions as F

from citeloom import rounds
from citeloom.operators import queue as Q


def _queue(spark):
    n = F.col("id")
    edges = spark.range(400).select(
        (n % 3).cast("string").alias("session_id"), (n % 7).alias("cited_id"), n.alias("citing_id"), F.when(n % 4 > 0, F.lit("Journal of Tests")).alias("venue"), (F.lit(1985) + n % 15).cast("int").alias("year"),
        F.array(F.concat(F.lit("Name "), (n % 5).cast("string"))).alias("citing_authors"), F.when(n % 2 == 0, "manual_pdf").otherwise("need_pdf").alias("pdf_readiness_status"), F.when(n % 11 == 0, "skipped").otherwise("pending").alias("queue_status"),
        F.repeat(F.lit("long title "), 50).alias("citing_title"),
    )
    authors = spark.range(6).select(n.alias("cited_id"), F.concat(F.lit("name "), n.cast("string")).alias("author"))
    return Q.build_queue(edges, authors, 1998)


def test_reasons_are_made_again_after_numbering(spark):
    queue = _queue(spark)
    rows = lambda df: sorted(map(repr, df.select("session_id", "cited_id", "citing_id", "priority_score", "reasons", "position").collect()))
    assert rows(Q.ranked(queue, 1998)) == rows(Q.ranked(queue)) and len(rows(queue.withColumn("position", F.lit(1)))) == 400


def test_numbering_writes_no_titles_nor_reasons_and_deals_rows_out_once(spark, monkeypatch):
    made, own = [], rounds.written

    def noted(df, name):
        made.append(own(df, name))
        return made[-1]

    monkeypatch.setattr(rounds, "written", noted)
    found = Q.ranked(_queue(spark), 1998)
    assert all(set(t.columns) <= {*Q.RANKING, "__at", "__by", "__range", "__first", "__n", "__before"} for t in made) and made
    assert all(p.suffixes[-2:] == [".zstd", ".parquet"] for t in made for f in t.inputFiles() for p in [pathlib.Path(f)])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
