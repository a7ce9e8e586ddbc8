"""Findings out of a model's answers, whatever shape they came in."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a finding may be, what its stance may be, other names of its fields, and texts that say there is none.
EVIDENCE_TYPES = (
    "first_or_seminal_claim", "detailed_comparison", "baseline_or_benchmark", "method_foundation", "theoretical_foundation", "application_extension", "positive_evaluation", "representative_work",
    "limitation_or_negative", "background", "adopted_or_combined", "state_of_the_art_claim", "important_author_citation", "long_context_citation", "precision_claim", "capability_recognition",
)
STANCES = ("positive", "neutral", "negative", "mixed")
OTHER_NAMES = {"evidence_type": ("aspect", "type", "category"), "reasoning": ("reason", "evidence_reason"), "citation_text": ("quote", "evidence_quote", "text"), "keywords": ("highlight_keywords",)}
NO_EVIDENCE = ("no evidence found", "no strong evidence found", "no citation evidence found", "no relevant evidence found")

#: Fields of a finding with their types; the first four must be there, but for citation_text.
FIELDS = {
    "evidence_type": "string", "stance": "string", "mention_type": "string", "reasoning": "string", "citation_text": "string", "keywords": "array<string>", "keep": "boolean",
    "matched_template_ids": "array<int>", "template_match_reason": "string", "template_satisfied": "boolean", "template_failure_reason": "string",
}
NEEDED = ("evidence_type", "stance", "mention_type", "reasoning")


def without_thoughts(response: Column) -> Column:
    return F.btrim(F.regexp_replace(F.coalesce(response, F.lit("")), r"(?is)<think>.*?</think>", ""), F.lit(" \t\n\v\f\r"))


def plain_apostrophes(text: Column) -> Column:
    r"""text whose apostrophes carry no backslash of their own: \' is no escape in JSON. A backslash that another one escapes stays."""
    return F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)\\'", "$1'")


def _nested(value: Any) -> Iterator[Any]:
    """A JSON value and all objects and lists within it, in the order in which they begin."""
    yield value
    for inner in value.values() if isinstance(value, dict) else value:
        if isinstance(inner, (dict, list)):
            yield from _nested(inner)


def _embedded(text: str) -> Iterator[Any]:
    """Objects and lists of JSON that stand in a text, nested ones after those that hold them."""
    decoder, at = json.JSONDecoder(), 0
    while begin := re.compile(r"[{\[]").search(text, at):
        try:
            value, at = decoder.raw_decode(text, begin.start())
        except (ValueError, RecursionError):
            at = begin.start() + 1
        else:
            yield from _nested(value)


def payload_within(text: str | None) -> str | None:
    """The payload of an answer with other text around it, as JSON: out of fenced blocks that are JSON, else from anywhere. The last object with a list of findings counts, else the last object, else the last list."""
    text = re.sub(r"(?is)<think>.*$", "", text or "")
    whole = []
    for block in re.findall(r"(?is)```(?:json)?\s*(.*?)```", text):
        try:
            whole.append(json.loads(block))
        except (ValueError, RecursionError):
            continue
    found = whole or list(_embedded(text))
    objects = [v for v in found if isinstance(v, dict)]
    best = ([v for v in objects if isinstance(v.get("findings"), list)] or objects or found)[-1:]
    return json.dumps(best[0], ensure_ascii=False) if best else None


def _json(text: Column) -> Column:
    """text as a variant; null unless all of it is one JSON value. The parser stops after a value, so the text is read as a field that another one must follow."""
    end = "after the value"
    both = F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"v": '), text, F.lit(f', "{end}": 1}}'))), "$", "map<string, variant>")
    return F.when((F.size(both) == 2) & F.map_contains_key(both, end), F.try_element_at(both, F.lit("v")))


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), r"^(\w+)", 1)


def _field(finding: Column, name: str) -> Column:
    """The value of a field, or of the first of its other names that has one; null and the empty text are none."""
    own = [F.try_variant_get(finding, f"$.{n}", "variant") for n in (name, *OTHER_NAMES.get(name, ()))]
    return F.coalesce(*(F.when(~F.is_variant_null(v) & (F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("?")) != ""), v) for v in own))


def _typed(finding: Column) -> Column:
    """struct of a finding's fields with `flaw`, the first field that is missing or not of its kind."""
    kinds = {"string": ("STRING",), "int": ("BIGINT", "STRING"), "boolean": ("BOOLEAN", "STRING")}  # numbers and truth values may come as texts
    raw = {n: _field(finding, n) for n in FIELDS}
    value = {n: F.try_variant_get(raw[n], "$", t) for n, t in FIELDS.items()}

    def fits(v: Column, t: str) -> Column:
        if t.startswith("array"):
            return F.forall(F.try_variant_get(v, "$", "array<variant>"), lambda x: fits(x, t[6:-1]))
        return _kind(v).isin(*kinds[t]) & F.try_variant_get(v, "$", t).isNotNull()

    bad = {n: raw[n].isNotNull() & ~F.coalesce(fits(raw[n], t), F.lit(False)) for n, t in FIELDS.items()}
    for n, allowed in (("evidence_type", EVIDENCE_TYPES), ("stance", STANCES)):
        bad[n] = bad[n] | ~F.coalesce(value[n].isin(*allowed), F.lit(False))
    for n in NEEDED:
        bad[n] = bad[n] | raw[n].isNull()
    flaw = F.coalesce(*(F.when(b, F.lit(n)) for n, b in bad.items()))
    default = {"keywords": F.array().cast("array<string>"), "matched_template_ids": F.array().cast("array<int>"), "keep": F.lit(True), "template_match_reason": F.lit("")}
    return F.struct(*(F.coalesce(value[n], default[n]).alias(n) if n in default else value[n].alias(n) for n in FIELDS), F.when(_kind(finding) != "OBJECT", "finding").otherwise(flaw).alias("flaw"))


def answers(responses: DataFrame) -> DataFrame:
    """item_id, status, reason and findings (array) of responses (item_id, response).

    Thoughts in tags go. A text that says that there is no evidence has no findings (no_evidence). A response that begins with a brace or bracket is JSON, or JSON but for escaped apostrophes (parsed);
    else its payload is looked for in fenced blocks and in the text (salvaged). A list is one of findings; findings may be named evidence, and fields may have other names. A payload without findings has none.
    One finding with a field missing or of the wrong kind makes the whole response quarantined, with the reason: no_json, not_findings, or the field. A quarantined response has no findings; none is dropped.
    A field that is null or an empty text counts as missing. Only text around JSON is searched in Python, in Arrow batches."""
    rows = responses.select("item_id", without_thoughts(F.col("response")).alias("s"))
    # one name for each step: what several later ones need is found once
    rows = rows.withColumn("how", F.when(F.lower(F.regexp_replace("s", r"\s+", " ")).isin(*NO_EVIDENCE), "no_evidence").when(F.substring("s", 1, 1).isin("{", "["), "parsed").otherwise("salvaged"))
    plain = rows.where("how <> 'salvaged'").select("item_id", "how", F.when(F.col("how") == "parsed", F.coalesce(_json(F.col("s")), _json(plain_apostrophes(F.col("s"))))).alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"item_id": b["item_id"], "found": b["s"].map(payload_within)})

    id_type = responses.schema["item_id"].dataType.simpleString()
    found = rows.where("how = 'salvaged'").select("item_id", plain_apostrophes(F.col("s")).alias("s")).mapInPandas(run, f"item_id {id_type}, found string")
    all_ = plain.unionByName(found.select("item_id", F.lit("salvaged").alias("how"), F.try_parse_json("found").alias("v")))
    own, other = (F.try_variant_get("v", f"$.{n}", "variant") for n in ("findings", "evidence"))
    list_ = F.when(_kind(F.col("v")) == "ARRAY", F.col("v")).when(_kind(F.col("v")) == "OBJECT", F.coalesce(own, other, F.parse_json(F.lit("[]"))))
    out = all_.withColumn("list", list_).withColumn("findings", F.transform(F.try_variant_get("list", "$", "array<variant>"), _typed))
    reason = F.when(F.col("how") == "no_evidence", None).when(F.col("v").isNull(), "no_json").when(F.col("findings").isNull(), "not_findings").otherwise(F.get(F.filter(F.transform("findings", lambda x: x["flaw"]), lambda x: x.isNotNull()), F.lit(0)))
    out = out.withColumn("reason", reason)
    clean = F.transform("findings", lambda x: F.struct(*(x[n].alias(n) for n in FIELDS)))
    none = F.array().cast("array<struct<" + ", ".join(f"{n}: {t}" for n, t in FIELDS.items()) + ">>")
    return out.select("item_id", F.when(F.col("reason").isNotNull(), "quarantined").otherwise(F.col("how")).alias("status"), "reason", F.when(F.col("reason").isNull() & F.col("findings").isNotNull(), clean).otherwise(none).alias("findings"))


def findings(answers_: DataFrame) -> DataFrame:
    """A row for each finding of answers, with its place in the answer, from 0."""
    return answers_.select("item_id", F.posexplode("findings").alias("place", "f")).select("item_id", "place", "f.*")
