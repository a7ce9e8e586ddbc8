"""Connected components of links, by smallest labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """node and label, the smallest node that links (a, b) lead to; only nodes that have links.

    Every round each node takes the least label around it and then that label's own, so paths shorten by half or more. The labels are a written table
    after each round.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("next"), "label")
        of = labels.select(F.col("node").alias("l_node"), F.col("label").alias("l_label"))
        jumped = written(step.join(of, F.col("next") == F.col("l_node"), "left").select("node", F.least("next", F.coalesce("l_label", "next")).alias("label"), F.col("label").alias("old")), "labels")
        changed = not jumped.where("label <> old").isEmpty()
        labels = jumped.select("node", "label")
        if not changed:
            return labels
