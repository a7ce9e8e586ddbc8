"""What a card's quote lets one claim: its kind, label, recommendation, confidence, key phrases and risks. The sentences of a report are left to its writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
INCLUDE, REVIEW, EXCLUDE = "推荐纳入", "候选复核", "不建议纳入"
# Label, recommendation and confidence of the kinds that do not depend on a card's strength.
KINDS = {
    "invalid_anchor": ("误报候选", EXCLUDE, "low"),
    "direct_submm": ("直接亚毫米能力佐证", INCLUDE, "high"),
    "loudspeaker_vibration": ("RFID 振动能力佐证", INCLUDE, "medium"),
    "through_wall": ("穿墙窃听能力佐证", REVIEW, "medium"),
    "limitation": ("局限性反馈", REVIEW, "medium"),
    "plain_related": ("普通相关工作", REVIEW, "low"),
    "mismatch": ("模板未满足", EXCLUDE, "low"),
    "first_satisfied": ("首次/开创性明确佐证", INCLUDE, "high"),
    "first_scope_unclear": ("首次作用域不明确", EXCLUDE, "low"),
}
# Labels of the other cards, by type; and of those that are negative or ordinary.
LABELS = {
    "theoretical_foundation": "理论基础", "method_foundation": "方法采用", "application_extension": "应用拓展", "detailed_comparison": "详细对比", "baseline_or_benchmark": "基线/Benchmark", "positive_evaluation": "正向评价", "representative_work": "代表性相关工作",
    "first_or_seminal_claim": "首次/开创性",
}
NEGATIVE_LABEL, ORDINARY_LABEL = "局限性/负面反馈", "普通相关工作引用"
ORDINARY = ("representative_work", "background_reference", "ordinary_citation", "weak_mention", "citation_only")
# Words of templates about precision, of limits, of the three abilities, of claims to be first.
PRECISION = ("rfid", "亚毫米", "sub-mm", "submillimeter")
LIMITS = ("limitation", "limited", "constraint", "trade-off", "tradeoff", "sensitive to", "shortcoming")
RELATED = ("plain rfid reference", "related work")
ABILITIES = (
    ("direct_submm", ("sub-mm", "sub mm", "submillimeter", "sub-millimeter", "millimeter-level", "mm-level")),
    ("through_wall", ("through-wall", "through wall", "eavesdropping")),
    ("loudspeaker_vibration", ("loudspeaker vibration", "speaker vibration", "vibration sensing", "acoustic sensing", "voice sensing", "audio sensing")),
)
FIRST = ("first", "pioneering", "seminal", "earliest", "首次", "开创性", "率先", "最早")
# Patterns of key phrases, in their order; case does not count.
PHRASES = (
    r"\bsub[-\s]?mm\b",
    r"\bsub[-\s]?millimeter(?:-level)?\b",
    r"\bmillimeter[-\s]?level\b",
    r"\bmm[-\s]?level\b",
    r"\bRFID(?:\s+tag)?\b",
    r"\bvibration\s+sensing\b",
    r"\b(?:loudspeaker|speaker|voice|audio|acoustic|tiny|micro)[-\s]vibration\b",
    r"\bthrough[-\s]wall\b",
    r"\beavesdropping\b",
    r"\b(?:[A-Za-z][\w'’-]{2,}\s+){1,4}(?:model|method|mechanism|process|operation|sensing|comparison|limitation|constraint|trade[-\s]?off|framework|system)\b",
)
MOST_PHRASES = 8
#: What a row may leave out, and what it then is.
OPTIONAL = {"context": "string", "template_reason": "string", "template_failure": "string", "template_satisfied": "boolean", "anchor_status": "string", "key_phrases": "array<string>"}


def _form(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.translate(F.coalesce(x, F.lit("")), "–—", "--")), r"\s+", " "))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.when(F.contains(text, F.lit(w)), F.lit(True)) for w in words), F.lit(False))


def key_phrases(given: Column, text: Column) -> Column:
    """The phrases given, then at most MOST_PHRASES that a text has, each once whatever its case, in its first spelling."""
    once = lambda xs: F.aggregate(xs, F.array().cast("array<string>"), lambda seen, x: F.when((x == "") | F.exists(seen, lambda s: F.lower(s) == F.lower(x)), seen).otherwise(F.concat(seen, F.array(x))))
    found = once(F.concat(*(F.transform(F.regexp_extract_all(text, F.lit("(?iU)" + p), F.lit(0)), lambda x: F.trim(x)) for p in PHRASES)))
    own = F.filter(F.transform(F.coalesce(given, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull())
    return once(F.concat(own, F.slice(found, 1, MOST_PHRASES)))


def interpreted(cards: DataFrame) -> DataFrame:
    """cards with claim_kind, label, recommendation, confidence, key_phrases (array) and risks (array: anchor, grouped, candidate, scope, ordinary, negative).

    cards: evidence_quote, card_type, stance, mention_type, strength; also the columns of OPTIONAL, which may be missing. The first rule wins: an invalid anchor; a template about precision (limits, then whether it is satisfied, then the
    ability that quote, context and reasons name); words of being first, which only count where the template's reason has them too; then the card's own type. Nulls are empty texts, and a template without a verdict is not satisfied."""
    rows = cards.select(*(x for x in cards.columns if x not in OPTIONAL), *((c(n).cast(t) if n in cards.columns else F.lit(None).cast(t)).alias(n) for n, t in OPTIONAL.items()))
    rows = rows.withColumns({
        "__quote": _form(c("evidence_quote")), "__reasons": _form(F.concat_ws(" ", "template_reason", "template_failure")), "__reason": _form(c("template_reason")), "__satisfied": F.coalesce("template_satisfied", F.lit(False)),
        "__said": F.concat_ws(" ", F.coalesce("evidence_quote", F.lit("")), F.coalesce("context", F.lit(""))), "__type": F.coalesce("card_type", F.lit("")), "__grouped": F.coalesce(c("mention_type") == "grouped_citation", F.lit(False)),
    }).withColumn("__all", F.concat_ws(" ", _form(c("__said")), "__reasons"))
    negative = F.coalesce(c("stance").isin("negative", "mixed"), F.lit(False)) | (c("__type") == "limitation_or_negative")
    ability = F.coalesce(*(F.when(_any(c("__all"), words), F.lit(kind)) for kind, words in ABILITIES), F.lit("plain_related"))
    precise = F.when(negative | _any(c("__all"), LIMITS), "limitation").when(~c("__satisfied"), F.when(_any(c("__all"), RELATED), "plain_related").otherwise("mismatch")).otherwise(ability)
    first = F.when(c("__satisfied") & _any(c("__reason"), FIRST), "first_satisfied").otherwise("first_scope_unclear")
    own = F.when(negative, "negative").when(c("__type").isin(*ORDINARY), "ordinary").otherwise("typed")
    kind = F.when(c("anchor_status") == "invalid", "invalid_anchor").when(_any(c("__reasons"), PRECISION), precise).when(_any(c("__quote"), FIRST), first).otherwise(own)
    rows = rows.withColumn("claim_kind", kind)
    k, solid = c("claim_kind"), F.coalesce(c("strength").isin("strong", "moderate"), F.lit(False)) & ~c("__grouped")
    of = lambda i: F.coalesce(*(F.when(k == n, F.lit(v[i])) for n, v in KINDS.items()))
    typed = F.coalesce(*(F.when(c("__type") == n, F.lit(v)) for n, v in LABELS.items()), F.replace("__type", F.lit("_"), F.lit(" ")))
    label = F.coalesce(of(0), F.when(k == "negative", NEGATIVE_LABEL), F.when((k == "ordinary") & (c("__type") != "representative_work"), ORDINARY_LABEL), typed)
    recommendation = F.coalesce(of(1), F.when((k == "typed") & solid, INCLUDE), F.lit(REVIEW))
    confidence = F.coalesce(of(2), F.when((k == "typed") & solid, "high"), F.when((k == "ordinary") & c("strength").isin("weak", "low"), "low"), F.lit("medium"))
    ability_kind = k.isin("direct_submm", "loudspeaker_vibration", "through_wall", "limitation", "plain_related", "mismatch")
    general = k.isin("negative", "ordinary", "typed")
    risks = F.array_compact(F.array(
        F.when(k == "invalid_anchor", "anchor"), F.when((general | ability_kind) & c("__grouped"), "grouped"), F.when(ability_kind & ~c("__grouped") & (of(1) != INCLUDE), "candidate"), F.when(k.isin("first_satisfied", "first_scope_unclear"), "scope"),
        F.when(general & c("__type").isin(*ORDINARY), "ordinary"), F.when(k == "negative", "negative"),
    ))
    kept = [x for x in cards.columns if x != "key_phrases"]
    return rows.select(*kept, "claim_kind", label.alias("label"), recommendation.alias("recommendation"), confidence.alias("confidence"), key_phrases(c("key_phrases"), c("__said")).alias("key_phrases"), risks.alias("risks"))
