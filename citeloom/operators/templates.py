"""Evidence templates: the built-in ones, what sessions change, term matches."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.rounds import written

from .evaluation import CONTRACTS

c = F.col
LONG_CONTEXT = "long_context_citation"


class BuiltIn(NamedTuple):
    kind: str
    bonus: int
    words: tuple[str, ...]
    patterns: tuple[str, ...]
    aspects: tuple[str, ...]


# The built-in templates in the order of their ids: type (also the name), bonus, words, patterns, aspects. What their types allow is in evaluation.py.
BUILT_IN = (
    BuiltIn("first_or_pioneering_claim", 30, ("first", "the first", "pioneering", "earliest", "first-of-its-kind", "seminal", "for the first time", "首次", "开创性", "率先", "最早"), ("the first", "for the first time", "pioneering work", "seminal work"), ("first_or_pioneering_claim", "first_or_seminal_claim")),
    BuiltIn("first_or_seminal_claim", 20, ("first", "seminal", "pioneering", "首次", "开创"), ("first work", "seminal work"), ("first_or_seminal_claim",)),
    BuiltIn("detailed_comparison", 20, ("compare", "compared with", "comparison", "对比", "比较"), ("compared with",), ("detailed_comparison",)),
    BuiltIn("baseline_or_benchmark", 20, ("baseline", "benchmark", "基线", "评测"), ("benchmark baseline",), ("baseline_or_benchmark",)),
    BuiltIn("theoretical_foundation", 18, ("theoretical foundation", "理论基础"), ("foundation follows",), ("theoretical_foundation",)),
    BuiltIn("method_foundation", 18, ("method foundation", "method source", "方法来源"), ("method foundation",), ("method_foundation",)),
    BuiltIn("application_extension", 15, ("application", "extension", "应用", "拓展"), ("extends",), ("application_extension",)),
    BuiltIn("important_author_citation", 15, ("Fellow", "院士", "important author"), ("fellow",), ("important_author_citation",)),
    BuiltIn("survey_highlight", 15, ("survey", "review", "综述"), ("survey highlights",), ("survey_highlight",)),
    BuiltIn(LONG_CONTEXT, 12, ("long context", "substantial discussion", "长上下文"), ("substantial discussion",), (LONG_CONTEXT,)),
    BuiltIn("positive_evaluation", 12, ("positive", "improves", "strong", "正向", "评价"), ("positive evaluation",), ("positive_evaluation",)),
    BuiltIn("limitation_or_negative", 12, ("limitation", "negative", "局限", "不足"), ("limitation",), ("limitation_or_negative",)),
)
#: The bonus of a session's own templates.
OWN_BONUS = 15
DETAILS = {
    "template_type": "string", "positive": "array<string>", "negative": "array<string>", "required": "array<string>", "allowed_types": "array<string>", "min_chars": "int", "min_words": "int", "require_marker": "boolean", "allow_grouped": "boolean",
}


def builtin_templates(spark: SparkSession) -> DataFrame:
    """The built-in templates, numbered from 1: template_id, name, template_type, positive, negative, required, aspects, allowed_types, bonus, min_chars, min_words, require_marker, allow_grouped. Types that have a contract need
    the target's marker; the others leave that open (null)."""
    rows = [(i, b.kind, b.kind, list(b.words), [], list(b.patterns), list(b.aspects), list(CONTRACTS.get(b.kind, ())), b.bonus, 0, 0, True if b.kind in CONTRACTS else None, False) for i, b in enumerate(BUILT_IN, 1)]
    return spark.createDataFrame(rows, "template_id long, name string, template_type string, positive array<string>, negative array<string>, required array<string>, aspects array<string>, allowed_types array<string>, bonus int, min_chars int, min_words int, require_marker boolean, allow_grouped boolean")


def session_templates(builtin: DataFrame, log: DataFrame) -> DataFrame:
    """The templates that sessions have, as a log of what they did says: builtin's columns with session_id, enabled, user_defined.

    log: session_id, ordinal (unique in a session), action (enable, disable, create), template_id; for creations the columns of DETAILS, any of which may be missing or null. Enabling or disabling a built-in template gives the session a copy,
    which later actions switch. A created template is on, and named by its type, its session and the number of the session's templates that are on then, plus one; its aspects are the types it allows, else its type. Actions on
    templates that neither exist nor were created before in the session do nothing, nor does creating one id again. A session's log, what one user did, is one window; templates of different sessions never meet."""
    rows = log.select("session_id", "ordinal", "action", c("template_id").cast("long").alias("template_id"), *((c(n).cast(t) if n in log.columns else F.lit(None).cast(t)).alias(n) for n, t in DETAILS.items())).where(c("action").isin("enable", "disable", "create"))
    own = Window.partitionBy("session_id", "template_id").orderBy("ordinal")
    b = builtin.select(c("template_id").alias("b_id"))
    rows = rows.join(b, c("template_id") == c("b_id"), "left").withColumn("made", F.min(F.when((c("action") == "create") & c("b_id").isNull(), c("ordinal"))).over(own))
    rows = rows.where(F.when(c("action") == "create", c("ordinal") == c("made")).otherwise(c("b_id").isNotNull() | (c("made") < c("ordinal"))))
    rows = rows.withColumn("on", c("action") != "disable")
    rows = rows.withColumn("gain", c("on").cast("int") - F.coalesce(F.lag("on").over(own), F.lit(False)).cast("int"))
    before = F.sum("gain").over(Window.partitionBy("session_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("others", F.coalesce(before, F.lit(0)))
    first = lambda x: F.min_by(x, "ordinal").alias(x)
    held = rows.groupBy("session_id", "template_id").agg(F.max_by("on", "ordinal").alias("enabled"), F.max("b_id").isNull().alias("user_defined"), first("others"), *(first(n) for n in DETAILS))
    copies = held.where(~c("user_defined")).select("session_id", "template_id", "enabled", "user_defined").join(builtin, "template_id")
    kind = F.coalesce(F.nullif("template_type", F.lit("")), F.lit("custom"))
    none = F.array().cast("array<string>")
    allowed = F.coalesce("allowed_types", none)
    made = held.where("user_defined").select(
        "template_id", "session_id", "enabled", "user_defined", F.concat_ws("_", F.lit("custom"), kind, "session_id", c("others") + 1).alias("name"), kind.alias("template_type"), F.coalesce("positive", none).alias("positive"), F.coalesce("negative", none).alias("negative"), F.coalesce("required", none).alias("required"),
        F.when(F.size(allowed) > 0, allowed).otherwise(F.array(kind)).alias("aspects"), allowed.alias("allowed_types"), F.lit(OWN_BONUS).alias("bonus"), F.coalesce("min_chars", F.lit(0)).alias("min_chars"), F.coalesce("min_words", F.lit(0)).alias("min_words"), F.coalesce("require_marker", F.lit(False)).alias("require_marker"), F.coalesce("allow_grouped", F.lit(False)).alias("allow_grouped"),
    )
    return copies.unionByName(made)


def _terms() -> Column:
    """A template's words, patterns and aspects with single spaces, each once whatever its case, in its first spelling, with its lower-case form."""
    lists = [F.coalesce(x, F.array().cast("array<string>")) for x in ("positive", "required", "aspects")]
    clean = F.filter(F.transform(F.concat(*lists), lambda t: F.trim(F.regexp_replace(t, r"(?U)\s+", " "))), lambda t: t != "")
    forms = F.transform(clean, lambda t: F.struct(t.alias("term"), F.lower(t).alias("low")))
    return F.aggregate(forms, F.array().cast("array<struct<term:string,low:string>>"), lambda seen, t: F.when(F.exists(seen, lambda s: s["low"] == t["low"]), seen).otherwise(F.concat(seen, F.array(t))))


def _by_session(templates: DataFrame) -> DataFrame:
    """t_session, sought (a map from each distinct term to the templates that have it, and where), longs (the bounds of templates of long context): one row for each session."""
    t = templates.where("enabled").withColumnRenamed("session_id", "t_session")
    long = F.coalesce(c("template_type") == LONG_CONTEXT, F.lit(False))
    terms = t.where(~long).select("t_session", "template_id", "template_type", "name", F.posexplode(_terms()).alias("place", "term"))
    hit = F.struct("template_id", "place", "template_type", "name", c("term.term").alias("term"))
    sought = terms.groupBy("t_session", c("term.low").alias("low")).agg(F.collect_list(hit).alias("hits")).groupBy("t_session").agg(F.map_from_entries(F.collect_list(F.struct("low", "hits"))).alias("sought"))
    bounds = (F.coalesce("min_chars", F.lit(0)).alias("min_chars"), F.coalesce("min_words", F.lit(0)).alias("min_words"), F.coalesce("require_marker", F.lit(False)).alias("require_marker"))
    longs = t.where(long).groupBy("t_session").agg(F.collect_list(F.struct("template_id", "template_type", "name", *bounds)).alias("longs"))
    both = sought.join(longs, "t_session", "full")
    return both.select("t_session", *(F.coalesce(x, none.cast(both.schema[x].dataType)).alias(x) for x, none in (("sought", F.create_map()), ("longs", F.array()))))


def term_matches(texts: DataFrame, templates: DataFrame, key: str) -> DataFrame:
    """key, template_id, template_type, matched_terms, reason, match_score of texts (session_id, key, text) with the templates of their session that are on (columns as session_templates gives them). No row where nothing matches.

    A template matches by its words, patterns and aspects, as parts of the text whatever their case: ten a term, thirty at most. One of long context matches by its bounds instead, all of which must hold (characters, words, a bracket where the
    marker is asked for): ten and five for each bound, thirty at most; without any bound it matches nothing. A null text is empty.

    Each text is read once, for the distinct terms of all templates of its session; what is found names its templates. A session's templates are one row of a written table, whose size Spark knows: while it is small, texts are not shuffled, so
    few sessions do not gather them in few tasks, and no text is multiplied before it matches."""
    rows = texts.select("session_id", key, F.coalesce("text", F.lit("")).alias("text")).join(written(_by_session(templates), "templates"), c("session_id") == c("t_session"))
    one = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  f of x, which is made once
    match = lambda t, long, terms: F.struct(t["template_id"].alias("template_id"), t["template_type"].alias("template_type"), t["name"].alias("name"), F.lit(long).alias("long"), terms.alias("matched_terms"))
    hits = one(F.lower("text"), lambda low: F.flatten(F.transform(F.filter(F.map_keys("sought"), lambda t: F.contains(low, t)), lambda t: c("sought")[t])))
    own = lambda of, number: one(F.filter(of, lambda h: h["template_id"] == number), lambda o: match(o[0], False, F.transform(o, lambda h: h["term"])))
    by_terms = one(F.sort_array(hits), lambda of: F.transform(F.array_distinct(F.transform(of, lambda h: h["template_id"])), lambda number: own(of, number)))
    chars = F.length("text")
    worded = F.exists("longs", lambda t: (t["min_words"] > 0) & (chars >= t["min_chars"]))
    read = F.struct(chars.alias("chars"), F.when(worded, F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != ""))).otherwise(0).alias("words"), F.contains("text", F.lit("[")).alias("bracket"))

    def bounds(seen: Column, t: Column) -> Column:
        holds = ((t["min_chars"] <= 0) | (seen["chars"] >= t["min_chars"])) & ((t["min_words"] <= 0) | (seen["words"] >= t["min_words"])) & (~t["require_marker"] | seen["bracket"])
        named = F.array_compact(F.array(
            F.when(t["min_chars"] > 0, F.concat(F.lit("min_citation_chars>="), t["min_chars"])), F.when(t["min_words"] > 0, F.concat(F.lit("min_citation_words>="), t["min_words"])), F.when(t["require_marker"], "require_target_marker"),
        ))
        return match(t, True, F.when(holds, named).otherwise(F.array().cast("array<string>")))

    by_bounds = one(read, lambda seen: F.filter(F.transform("longs", lambda t: bounds(seen, t)), lambda m: F.size(m["matched_terms"]) > 0))
    found = rows.select(key, F.explode(F.concat(by_terms, by_bounds)).alias("m"))
    n = F.size("m.matched_terms")
    listed = F.array_join("m.matched_terms", ", ")
    reason = F.when(c("m.long"), F.concat(F.lit(f"Matched {LONG_CONTEXT} rules: "), listed)).otherwise(F.concat(F.lit("Matched template '"), "m.name", F.lit("' terms: "), listed))
    score = F.least(F.lit(30.0), F.when(c("m.long"), 10.0 + 5.0 * n).otherwise(10.0 * n))
    return found.select(key, "m.template_id", "m.template_type", "m.matched_terms", reason.alias("reason"), score.alias("match_score"))


def template_reasons(matches: DataFrame, key: str) -> DataFrame:
    """key with its matches as priority reasons, in template order."""
    reason = F.concat(F.lit("template_match:"), "template_type", F.lit(":"), F.array_join("matched_terms", ", "))
    return matches.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("template_id", reason.alias("reason"), F.col("match_score").alias("delta")))), lambda x: F.struct(x["reason"].alias("reason"), x["delta"].alias("delta"))).alias("extra"))


def persisted_matches(items: DataFrame, evidence: DataFrame, templates: DataFrame) -> DataFrame:
    """The matches of queue items and of evidence (session_id, owner_id, text) as one table, owner being item or evidence. owner_id has one type in both."""
    rows = items.select(F.lit("item").alias("owner"), "session_id", "owner_id", "text").unionByName(evidence.select(F.lit("evidence").alias("owner"), "session_id", "owner_id", "text"))
    keyed = rows.select("session_id", F.struct("owner", "owner_id").alias("k"), "text")
    return term_matches(keyed, templates, "k").select("k.owner", "k.owner_id", "template_id", "template_type", "matched_terms", "reason", "match_score")
