"""Streams in their batch form (G1, G2, A12, A17); tests hold the streams against these."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.streaming import streams as S

from .fixtures import Source

c = F.col


def sha():
    return F.sha2(F.encode("text", "UTF-8"), 256)


def _named_files(s: Source):
    """A file for each cited work, named by its title; works of one title are copies."""
    return s.fx_cited.select(F.concat(F.lit("/in/"), F.regexp_replace("title", "[^A-Za-z0-9]+", "_"), F.lit(".pdf")).alias("path"), F.sha2(F.encode("title", "UTF-8"), 256).alias("sha256"))


PLANS = {
    "g1_intake": (
        lambda s: S.intake(s.documents.where("doc_id % 2 = 0").select(F.concat(F.lit("f"), "doc_id").alias("path"), sha().alias("sha256")), s.documents.where("doc_id % 2 = 1").select(sha().alias("sha256")).distinct()),
        "with k as (select doc_id, sha256(text) as sha256 from documents) select sha256, min('f' || doc_id) as path, count(*) as copies from k where doc_id % 2 = 0 and sha256 not in (select sha256 from k where doc_id % 2 = 1) group by 1",
    ),
    "g1_matched_intake": (
        lambda s: S.matched_intake(_named_files(s), _named_files(s).where("sha256 < '2'"), s.fx_cited.select(c("publication_id").alias("item_id"), "doi", "title")).select("path", "copies", "item_id", "status", "bound"),
        r"""with f as (select sha256(title) as sha256, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) as t, '/in/' || regexp_replace(title, '[^A-Za-z0-9]+', '_', 'g') || '.pdf' as path from fx_cited),
            n as (select sha256, min(path) as path, count(*) as copies, min(t) as t from f where sha256 >= '2' group by 1),
            i as (select trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) as t, min(publication_id) as item_id from fx_cited group by 1)
            select path, copies, item_id, 'matched' as status, true as bound from n join i using (t)""",
    ),
    "g2_progress": (
        lambda s: S.progress(s.events).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 2).alias("total")),
        "select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M') as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2",
    ),
    "g2_current_state": (lambda s: S.current_state(s.events, "user_id", "event_type"), "select user_id, arg_max(event_type, {'a': ts, 'b': event_id}) as event_type, count(*) as changes from events group by 1"),
    "a12_task_outcomes": (
        lambda s: s.events.groupBy("user_id").agg(F.count_if(c("value") <= 20).alias("bad"), F.count(F.lit(1)).alias("n")).select("user_id", F.when(c("bad") == c("n"), "failed").when(c("bad") * 2 > c("n"), "partial_success").when(c("bad") > 0, "completed_with_warnings").otherwise("completed").alias("outcome")),
        "select user_id, case when b = n then 'failed' when b * 2 > n then 'partial_success' when b > 0 then 'completed_with_warnings' else 'completed' end as outcome from (select user_id, count(*) filter (value <= 20) as b, count(*) as n from events group by 1)",
    ),
    "a17_intake_summary": (
        lambda s: s.documents.groupBy("source").agg(F.count(F.lit(1)).alias("scanned"), F.countDistinct(sha()).alias("new"), (F.count(F.lit(1)) - F.countDistinct(sha())).alias("duplicate")),
        "select source, count(*) as scanned, count(distinct text) as new, count(*) - count(distinct text) as duplicate from documents group by 1",
    ),
}
