"""Document quality by hierarchical empirical Bayes.

A logistic classifier over a text's shape gives each document's own evidence. Grouped sums of it give each host and each path
of a host a posterior: a path is shrunk toward its host, a host toward the whole table, the more so the fewer documents it
has. How strongly is estimated from the tables themselves by the method of moments. A document's score adds its path's shift to its own
log-odds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts, written

#: At most so many labelled rows are learned from; the choice follows a hash of doc_id.
LABELLED_ROWS = 20000
#: Documents below this probability of good quality are rejected.
LEAST = 0.5
#: How far a site may shift a document's log-odds: evidence on the text itself outweighs its site.
SITE_SHARE = 0.5
WORD = re.compile(r"\w+")
FEATURES = ("upper", "exclaim", "pipe", "symbol", "digit", "other", "word_chars", "variety", "short", "repeated_lines", "line_words", "length")
BAD_CHANCE = (0.02, 0.98)


def features(text: str) -> list[float]:
    """Shares and logarithms that describe a text's shape; an empty text has zeros."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    words = WORD.findall(text)
    k, lines = max(1, len(words)), text.split("\n")
    marks = sum(map(text.count, "#$%&*@^~=+<>{}[]\\/_"))
    upper = sum(1 for w in words if len(w) > 1 and w.isupper()) / k
    letters = sum(map(len, words))
    return [
        upper,
        text.count("!") / k,
        text.count("|") / k,
        marks / k,
        sum(map(text.count, "0123456789")) / n,
        (n - letters - text.count(" ") - len(lines) + 1) / n,
        letters / k / 10,
        len(set(words)) / k,
        float(len(words) < 30),
        1 - len(set(lines)) / len(lines),
        np.log1p(k / len(lines)) / 5,
        np.log1p(k) / 10,
    ]


@dataclass
class Model:
    """A standardised logistic regression."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def probability(self, rows: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(rows)), (rows - self.mean) / self.scale]) @ self.weights
        return np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), *BAD_CHANCE)


def learn(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Model:
    """The classifier, from at most `rows` labelled documents; without labels of both kinds it finds every document good. Where labels of one document disagree, the worse holds; of
    several texts of one doc_id the first in order counts."""
    own = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("quality")).where("label_id is not null and quality in (0, 1)")
    chosen = own.groupBy("label_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("label_id"), "label_id").limit(rows)
    sample = texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).groupBy("label_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality")).select("text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("quality"), pa.array([features(x) for x in b.column("text").to_pylist()], pa.list_(pa.float64()))], ["quality", "x"])

    seen = sample.mapInArrow(run, "quality int, x array<double>").collect()
    x, y = np.array([r["x"] for r in seen], float).reshape(-1, len(FEATURES)), np.array([r["quality"] for r in seen], float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.array([4.0] + [0.0] * len(FEATURES)))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z, w = np.column_stack([np.ones(len(y)), (x - mean) / scale]), np.zeros(len(FEATURES) + 1)
    ridge = np.eye(len(w)) * 0.1
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return Model(mean, scale, w)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: str, within: str) -> float:
    """The prior's weight in documents: expected variance inside a group over the variance between groups beyond it."""
    r = groups.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("p") / F.col("n") - F.col(mean), 2)).alias("between"), F.sum(F.col("n") * F.col(within)).alias("within"), F.count(F.lit(1)).alias("k")).first()
    if not r["n"]:
        return 1.0
    inside = r["within"] / r["n"]
    between = max(1e-4, r["between"] / r["n"] - r["k"] * inside / r["n"])
    return float(min(1e4, max(1.0, inside / between)))


def quality_scores(docs: DataFrame, model: Model, host: str = "source", path: str = "lang", least: float = LEAST) -> DataFrame:
    """One row for each row of docs: doc_id, host, path, doc_probability, host_posterior, path_posterior, score, kept.

    A null host or path is a site of its own. Null and empty texts have the evidence of a text without shape. Repeated rows count as often as they occur. An empty table gives an empty
    result; columns other than doc_id, text, host and path are ignored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column("text").to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("host"), b.column("path"), pa.array(shared.value.probability(x))], ["doc_id", "host", "path", "doc_probability"])

    site = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), site(host).alias("host"), site(path).alias("path"))
    own = written(rows.mapInArrow(run, "doc_id long, host string, path string, doc_probability double"), "evidence")
    p = F.col("doc_probability")
    paths = written(own.groupBy("host", "path").agg(F.sum(p).alias("p"), F.sum(p * p).alias("pp"), F.count(F.lit(1)).alias("n")), "paths")
    total = paths.agg(F.sum("p").alias("p"), F.sum("n").alias("n")).first()
    prior = (total["p"] + 1) / (total["n"] + 2) if total["n"] else 0.5
    spread = (F.col("pp") / F.col("n") - F.pow(F.col("p") / F.col("n"), 2)).alias("spread")
    hosts = paths.groupBy("host").agg(F.sum("p").alias("p"), F.sum("pp").alias("pp"), F.sum("n").alias("n")).select("host", "p", "n", spread, F.lit(prior).alias("prior"))
    a = _strength(hosts, "prior", "spread")
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("p") + a * prior) / (F.col("n") + a)).alias("host_posterior"))
    nested = paths.join(hosts, F.col("host") == F.col("h")).select("host", "path", "p", "n", spread, "host_posterior")
    b = _strength(nested, "host_posterior", "spread")
    sites = written(nested.select(F.col("host").alias("h"), F.col("path").alias("q"), "host_posterior", ((F.col("p") + b * F.col("host_posterior")) / (F.col("n") + b)).alias("path_posterior")), "sites")
    joined = own.join(sites, (F.col("host") == F.col("h")) & (F.col("path") == F.col("q")))
    shift = SITE_SHARE * (_logit(F.col("path_posterior")) - F.lit(float(np.log(prior / (1 - prior)))))
    score = 1 / (1 + F.exp(-(_logit(p) + shift)))
    return joined.select("doc_id", "host", "path", "doc_probability", "host_posterior", "path_posterior", score.alias("score"), (score >= least).alias("kept"))
