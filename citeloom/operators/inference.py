"""Prompts, batch inference and answers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.operators.evidence import inferred

ANSWER = "evidence_type string, stance string, keep boolean, confidence double"


def prompts(items: DataFrame, contexts: DataFrame, form: str = "anchor") -> DataFrame:
    """item_id and prompt: titles, then the item's contexts in order. items: item_id, citing_title, cited_title. contexts: item_id, ordinal, text."""
    c = contexts.groupBy(F.col("item_id").alias("c_item")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n").alias("contexts"))
    head = F.concat(F.lit(f"form: {form}\nciting: "), F.coalesce("citing_title", F.lit("")), F.lit("\ncited: "), F.coalesce("cited_title", F.lit("")), F.lit("\ncontexts:\n"))
    return items.join(c, F.col("item_id") == F.col("c_item"), "left").select("item_id", F.concat(head, F.coalesce("contexts", F.lit(""))).alias("prompt"))


def infer(prompts_: DataFrame, scorer: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """item_id, response, error. A scorer maps a batch of prompts to answers and does its own retries; a batch that fails becomes rows with an error. Without one, words of the prompt decide."""
    if scorer is None:
        i = inferred(F.col("prompt"))
        return prompts_.select("item_id", F.to_json(F.struct(F.coalesce(i["evidence_type"], F.lit("background")).alias("evidence_type"), i["stance"].alias("stance"), F.lit(True).alias("keep"), F.lit(0.5).alias("confidence"))).alias("response"), F.lit(None).cast("string").alias("error"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                answers, error = scorer(b["prompt"].tolist()), None
            except Exception as e:  # one batch's failure is data, not the job's end
                answers, error = [None] * len(b), f"{type(e).__name__}: {e}"
            yield pd.DataFrame({"item_id": b["item_id"], "response": answers, "error": error})

    return prompts_.mapInPandas(run, "item_id long, response string, error string")


def stripped(response: Column) -> Column:
    """An answer without thoughts and code fences."""
    plain = F.regexp_replace(F.coalesce(response, F.lit("")), r"(?s)<think>.*?</think>", "")
    return F.trim(F.regexp_replace(plain, r"(?m)^\s*```[a-zA-Z]*\s*$", ""))


def embedded_json(text: str) -> str | None:
    """The first JSON object within a text."""
    for m in re.finditer(r"\{", text or ""):
        try:
            value, _ = json.JSONDecoder().raw_decode(text[m.start() :])
        except ValueError:
            continue
        if isinstance(value, dict):
            return json.dumps(value, ensure_ascii=False)
    return None


def salvaged(responses: DataFrame) -> DataFrame:
    """item_id, answer (struct) and status: parsed, salvaged or quarantined. Plain JSON is read natively; only the rest is searched in Arrow batches."""
    rows = responses.withColumn("s", stripped(F.col("response"))).withColumn("whole", F.from_json("s", ANSWER))
    ok = rows.where("whole.evidence_type is not null").select("item_id", F.col("whole").alias("answer"), F.lit("parsed").alias("status"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"item_id": b["item_id"], "found": b["s"].map(embedded_json)})

    rest = rows.where("whole.evidence_type is null").select("item_id", "s").mapInPandas(run, "item_id long, found string")
    rest = rest.withColumn("answer", F.from_json("found", ANSWER))
    good = F.col("answer.evidence_type").isNotNull()
    return ok.unionByName(rest.select("item_id", F.when(good, F.col("answer")).alias("answer"), F.when(good, "salvaged").otherwise("quarantined").alias("status")))
