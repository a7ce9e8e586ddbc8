"""Toxicity by a learned lexicon, misspellings included, with the context of each hit.

The lexicon is learned from labelled documents: words, and stems that several words share, whose documents are mostly toxic.
A trie holds it; a Levenshtein automaton of each distinct word walks the trie and meets the terms within one edit. Each
hit is weighed by its term's log-odds and by its window: quoted or reported terms count for less, terms aimed at a reader for more.
A logistic curve over a document's evidence gives its score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts

#: At most so many labelled rows are learned from; the choice follows a hash of doc_id.
LABELLED_ROWS = 9000
LEXICON_TERMS = 2000
LEAST_LOG_ODDS = 3.0
#: Terms shorter than this are matched without edits, and so are stems.
EDIT_CHARS = 5
STEM_CHARS = (4, 5, 6)
KNOWN_WORDS = 1_000_000
# How a window weighs a hit.
QUOTED, REPORTED, AIMED = 0.3, 0.6, 1.25
OPENERS, CLOSERS = "\"“„«‘'‚‹", "\"”“»’'‘›"
REPORTING = frozenset("said says wrote called quote quoted word words term sagte schrieb nannte wort zitat dit écrit appelé mot dijo escribió llamó palabra".split())
READER = frozenset("you your u du dich dir ihr euch tu toi te vous tú usted ustedes eres".split())
WORD = re.compile(r"\w+")


class LevenshteinAutomaton:
    """States are (position, edits) pairs of a word within `edits` of what has been read."""

    def __init__(self, word: str, edits: int):
        self.word, self.edits = word, edits

    def start(self) -> frozenset:
        return self._closed({(0, 0)})

    def _closed(self, states: set) -> frozenset:
        todo = list(states)
        while todo:
            i, e = todo.pop()
            if i < len(self.word) and e < self.edits and (i + 1, e + 1) not in states:
                states.add((i + 1, e + 1))
                todo.append((i + 1, e + 1))
        return frozenset(states)

    def step(self, states: frozenset, char: str) -> frozenset:
        out = set()
        for i, e in states:
            if i < len(self.word) and self.word[i] == char:
                out.add((i + 1, e))
            if e < self.edits:
                out.add((i, e + 1))
                if i < len(self.word):
                    out.add((i + 1, e + 1))
        return self._closed(out)

    def accepts(self, states: frozenset) -> bool:
        return any(i == len(self.word) for i, _ in states)


@dataclass
class Node:
    children: dict = field(default_factory=dict)
    term: str | None = None


@dataclass
class Lexicon:
    """Whole terms in a trie, stems in a dictionary; weights by term, and by (term, "~") for its misspellings."""

    weights: dict[str, float]

    def __post_init__(self):
        self.root = Node()
        self.stems, self.terms, self.halves = {}, {}, set()
        for t in self.weights:
            if t.endswith("*"):
                self.stems[t[:-1]] = t
            elif not t.endswith("~"):
                self.terms[t] = t
                if len(t) >= EDIT_CHARS:
                    node = self.root
                    for c in t:
                        node = node.children.setdefault(c, Node())
                    node.term = t
                    self.halves |= {t[: len(t) // 2], t[len(t) // 2 :]}
        self.half_sizes = sorted({len(h) for h in self.halves})
        self.stem_sizes = sorted({len(s) for s in self.stems})
        self.most = max((len(t) for t in self.terms), default=0) + 1

    def match(self, word: str) -> str | None:
        """The term that a word stands for, with ~ after it where an edit lies between; None without one."""
        if word in self.terms:
            return word
        for n in self.stem_sizes:
            if word[:n] in self.stems and len(word) > n:
                return self.stems[word[:n]]
        # one edit leaves one half of the term as it is, at the word's start or end
        if not EDIT_CHARS - 1 <= len(word) <= self.most or not any(word[:n] in self.halves or word[-n:] in self.halves for n in self.half_sizes):
            return None
        automaton = LevenshteinAutomaton(word, 1)
        todo, found = [(self.root, automaton.start())], []
        while todo:
            node, states = todo.pop()
            if node.term and automaton.accepts(states):
                found.append(node.term)
            for c, child in node.children.items():
                if after := automaton.step(states, c):
                    todo.append((child, after))
        return max(found, key=lambda t: (self.weights[t], t)) + "~" if found else None

    def weight(self, match: str) -> float:
        return self.weights.get(match, 0.5 * self.weights[match[:-1]] if match.endswith("~") else 0.0)


class Reader:
    """A text's hits; words seen before are not matched again."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.clean, self.hits = lexicon, set(), {}

    def found(self, text: str) -> list[tuple[str, float]]:
        """(match, context factor) of each hit."""
        low = text.lower()
        words = set(WORD.findall(low))
        for w in words - self.clean:
            if w not in self.hits:
                if m := self.lexicon.match(w):
                    self.hits[w] = m
                else:
                    self.clean.add(w)
        if len(self.clean) > KNOWN_WORDS:
            self.clean = set()
        if words.isdisjoint(self.hits):
            return []
        tokens = list(WORD.finditer(low))
        return [(self.hits[t.group()], _context(low, tokens, k)) for k, t in enumerate(tokens) if t.group() in self.hits]

    def evidence(self, text: str) -> tuple[float, float]:
        """The weighted sum of the hits, and that sum for each hundred words."""
        hits = self.found(text)
        total = sum(self.lexicon.weight(m) * c for m, c in hits)
        return total, 100 * total / max(20, text.count(" ") + 1)


def _context(text: str, tokens: list, k: int) -> float:
    near = {t.group() for t in tokens[max(0, k - 6) : k + 7]}
    before, after = text[max(0, tokens[k].start() - 40) : tokens[k].start()], text[tokens[k].end() : tokens[k].end() + 40]
    factor = AIMED if near & READER else 1.0
    if any(c in before for c in OPENERS) and any(c in after for c in CLOSERS):
        factor *= QUOTED
    elif near & REPORTING:
        factor *= REPORTED
    return factor


@dataclass
class Model:
    lexicon: dict[str, float]
    curve: tuple[float, float, float]

    def score(self, evidence: tuple[float, float]) -> float:
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * np.log1p(evidence[0]) + c * np.log1p(evidence[1]), -30, 30))))


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """text and toxic of at most `rows` labelled documents that are not held out, one row for each text. Where labels of one document or text disagree, toxic holds; of several texts of one
    doc_id the first in order counts."""
    own = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where("label_id is not null and toxic in (0, 1)").where(~is_held_out(F.col("label_id")))
    chosen = own.groupBy("label_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("label_id"), "label_id").limit(rows)
    found = texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    return found.groupBy("label_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).groupBy("text").agg(F.max("toxic").alias("toxic"))


def learn(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Model:
    """The lexicon from grouped counts over the sample, then the weights of misspellings and the curve from the sample's evidence."""
    sample = _sample(docs, labels, rows).persist()
    words = sample.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{M}\p{N}_]+"))).alias("word")).where(F.length("word") >= min(STEM_CHARS))
    whole = words.groupBy("word").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n"))
    stems = whole.select("word", "pos", "n", F.explode(F.array(*(F.lit(n) for n in STEM_CHARS))).alias("size")).where(F.length("word") > F.col("size"))
    stems = stems.groupBy(F.concat(F.expr("substring(word, 1, size)"), F.lit("*")).alias("word")).agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
    sizes = sample.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    toxic, clean = int(sizes[0] or 0), int((sizes[1] or 0) - (sizes[0] or 0))
    terms = whole.withColumn("kinds", F.lit(9)).unionByName(stems).where(F.col("kinds") >= 4)
    odds = F.log((F.col("pos") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("pos") + 0.5) / (clean + 1))
    terms = terms.withColumn("odds", odds).where((F.col("pos") >= max(4, 0.03 * toxic)) & (F.col("odds") >= LEAST_LOG_ODDS))
    weights = {r["word"]: float(r["odds"]) for r in terms.orderBy(F.desc("odds"), "word").limit(LEXICON_TERMS).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Lexicon(shared.value))
        for b in batches:
            rows = [(t, m) for t, text in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist(), strict=True) for m in {m for m, _ in reader.found(text)} if m.endswith("~")]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.int32()), pa.array([m for _, m in rows], pa.string())], ["toxic", "match"])

    edited = sample.mapInArrow(hits, "toxic int, match string").groupBy("match").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n")).collect()
    for r in edited:  # at most one for each term
        own = float(np.log((r["pos"] + 0.5) / (toxic + 1)) - np.log((r["n"] - r["pos"] + 0.5) / (clean + 1)))
        weights[r["match"]] = max(0.0, min(0.5 * weights[r["match"][:-1]], own))
    final = docs.sparkSession.sparkContext.broadcast(weights)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Lexicon(final.value))
        for b in batches:
            found = [reader.evidence(x) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.float64())], ["toxic", "total", "rate"])

    seen = np.array([tuple(r) for r in sample.mapInArrow(evidence, "toxic int, total double, rate double").collect()], float).reshape(-1, 3)
    sample.unpersist()
    return Model(weights, _curve(seen))


def _curve(seen: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps; without labels of both kinds, a curve that calls nothing toxic but strong evidence."""
    y = seen[:, 0]
    if y.min(initial=1) == y.max(initial=0) or not len(y):
        return (-4.0, 1.5, 0.5)
    x = np.column_stack([np.ones(len(y)), np.log1p(seen[:, 1]), np.log1p(seen[:, 2])])
    w, ridge = np.zeros(3), np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return tuple(map(float, w))


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    Only the text is scored. Null and empty texts score like a text without hits. A null doc_id is not held out. An empty table gives an
    empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        reader = Reader(Lexicon(own.lexicon))
        for b in batches:
            scores = [own.score(reader.evidence(x)) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
