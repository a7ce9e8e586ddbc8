"""Evidence templates judged against findings: contracts, guard, one rule for each template type, and what they come to together.

A finding is a row with citation_text, context, claim_type, mention_type, reasoning, keywords (array), reference_match_status, target_marker,
title, inherited (boolean: an anchor taken over from the paragraph), recommendation, model_ids (array<int>: templates that a model named) and
model_satisfied (boolean). A template is a row with template_id, template_type, name, goal, user_defined, enabled, aspects, allowed_types,
positive, negative, required (arrays), require_marker, min_chars, min_words. Everything is a built-in expression; rows meet in one join on the session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col

# The contract of each template type, the evidence types that it takes. All require the target's marker and allow no grouped citation.
CONTRACTS = {
    "first_or_pioneering_claim": ["first_or_pioneering_claim", "first_or_seminal_claim"],
    "first_or_seminal_claim": ["first_or_seminal_claim"],
    "detailed_comparison": ["detailed_comparison", "performance_comparison"],
    "baseline_or_benchmark": ["baseline_or_benchmark", "performance_comparison"],
    "positive_evaluation": ["positive_evaluation", "capability_recognition", "capability_summary", "method_summary", "rfid_loudspeaker_vibration", "through_wall_eavesdropping"],
    "limitation_or_negative": ["limitation_feedback", "limitation_or_negative"],
    "theoretical_foundation": ["theoretical_foundation", "method_foundation", "method_summary", "capability_summary"],
    "method_foundation": ["method_foundation", "method_use", "method_summary"],
    "method_or_capability_summary": ["method_summary", "capability_summary", "method_use", "capability_recognition"],
}
# The further evidence types with which a rule may make a candidate.
COMPARED = ["detailed_comparison", "performance_comparison", "method_summary", "capability_summary", "ordinary_reference"]
MEASURED = ["baseline_or_benchmark", "performance_comparison", "method_summary", "ordinary_reference"]
PRAISED = [*CONTRACTS["positive_evaluation"], "ordinary_reference", "method_use"]
NEUTRAL = ["method_summary", "capability_summary", "method_use", "capability_recognition", "theoretical_foundation", "method_foundation", "ordinary_reference"]
# The claims with which an included grouped citation counts as attributed by the model.
ATTRIBUTED = {
    "first_or_seminal_claim": ["first_or_seminal_claim", "first_or_pioneering_claim"],
    "first_or_pioneering_claim": ["first_or_seminal_claim", "first_or_pioneering_claim"],
    "detailed_comparison": ["detailed_comparison", "performance_comparison"],
    "baseline_or_benchmark": ["baseline_or_benchmark"],
    "theoretical_foundation": ["theoretical_foundation", "method_foundation"],
    "method_foundation": ["method_foundation", "method_use"],
    "positive_evaluation": ["positive_evaluation", "capability_recognition", "through_wall_eavesdropping", "rfid_loudspeaker_vibration"],
    "limitation_or_negative": ["limitation_feedback", "limitation_or_negative"],
    "method_or_capability_summary": ["method_summary", "capability_summary", "method_use", "capability_recognition"],
}
# The words of each cue, whole words in any case; after a bar, words in Chinese.
CUES = {
    "comparison": (r"compar\w*|versus|vs\.?|relative\s+to", ""),
    "detail": (r"table|experiment\w*|performance|accuracy|error|latency|throughput|metric|result\w*|outperform\w*|higher|lower|faster|slower|whereas|however", "%"),
    "baseline": (r"baseline|benchmark", ""),
    "evaluation": (r"table|experiment\w*|evaluat\w*|compar\w*|reproduc\w*|implement\w*|performance|accuracy|error|metric|result\w*", ""),
    "praise": (r"effective\w*|demonstrat\w*|accurate|robust|valuable|significant|important|promising|novel|strong|superior|outperform\w*|improv\w*|efficien\w*|enhanc\w*|mitigat\w*|reduc\w*|accelerat\w*|facilitat\w*|success\w*|high[- ]precision|high[- ]accuracy|state[- ]of[- ]the[- ]art", "有效|准确|鲁棒|重要|显著|优越|领先|高精度|有价值"),
    "spoiled": (r"limitation|limited|less practical|impractical|drawback|weakness|insufficient|not practical|requires pre-installing", "局限|不足|受限|不实用"),
    "limitation": (r"limitation|limited|less practical|impractical|not practical|drawback|weakness|insufficient|fails? to|cannot|can only|requires? pre[- ]install\w*|constraint|shortcoming", "局限|不足|受限|不实用|只能|无法|缺点"),
    "theory": (r"theor\w*|foundation|model|equation|formula|deriv\w*|framework|mechanism|phase|frequency|particle[- ]filter|based\s+on|builds?\s+on|following|integrat\w*", "理论|模型|公式|推导|机制|基础"),
    "theory_use": (r"theoretical\s+foundation|derive[sd]?\s+from|builds?\s+on|following|based\s+on|adopt\w*|integrat\w*|extend\w*", "理论基础|基于|沿用|采用|推导自"),
    "method_use": (r"adopt\w*|use[sd]?|utiliz\w*|follow\w*|builds?\s+on|based\s+on|according\s+to|derive[sd]?\s+from|extend\w*|implement\w*|reuse\w*|leverag\w*", "采用|沿用|基于|依据|源自|扩展|复现|使用"),
    "not_neutral": (r"effective\w*|robust|valuable|significant|important|promising|novel|superior|outperform\w*|improv\w*|high[- ]precision|high[- ]accuracy|success\w*", "有效|鲁棒|重要|显著|优越|领先|高精度|有价值"),
    "negative": (r"limitation|limited|less practical|impractical|not practical|drawback|weakness|insufficient|fails? to|cannot|can only|constraint|shortcoming", "局限|不足|受限|不实用|只能|无法|缺点"),
    "action": (r"achiev\w*|demonstrat\w*|detect\w*|measur\w*|estimat\w*|captur\w*|enable\w*|use[sd]?|using|adopt\w*|extend\w*|compar\w*|outperform\w*|improv\w*|reconstruct\w*|extract\w*|distinguish\w*", ""),
    "statement": (r"propos\w*|present\w*|introduc\w*|develop\w*|design\w*|utiliz\w*|use[sd]?|using|achiev\w*|enable\w*|detect\w*|measur\w*|estimat\w*|implement\w*|extend\w*|improv\w*|captur\w*|reconstruct\w*|extract\w*|distinguish\w*", "(?:提出|介绍|设计|实现|采用|使用|扩展|改进|检测|测量|捕获|重建).{0,40}(?:方法|机制|系统|能力|贡献|模型)"),
    "reference_only": (r"references?|bibliography|title[- ]only|reference[- ]only", ""),
}
# Expressions of a first claim, and the words that part one from its anchor.
FIRST = ["the first", "first ", "first-of-its-kind", "for the first time", "pioneering", "seminal", "earliest", "首次", "开创性", "率先", "最早"]
PARTING = ["unlike", "whereas", "while ", "rather than", "compared with"]
FIRST_REACH = 80
# Phrases of a mere mention.
MENTION = ["related work", "ordinary reference", "background reference", "listed", "列举", "普通引用", "普通相关工作"]
# What makes a template's stance.
STANCES = {"neutral": ["中性", "neutral"], "negative": ["负面", "局限", "negative evaluation"], "positive": ["正向评价", "positive evaluation"]}
# Failures that leave no candidate.
HARD = ["no citation_text", "reference mismatch", "title-only", "citation_text does not anchor", "citation_text shorter", "matched exclusion terms", "plain related work"]


def says(text: Column, cue: str) -> Column:
    words, more = CUES[cue]
    return F.coalesce(text, F.lit("")).rlike(rf"(?i)\b(?:{words})\b" + (f"|{more}" if more else ""))


def plain(text: Column) -> Column:
    """Lower case, other than a-z, 0-9 and Chinese characters as single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9一-鿿]+", " "))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def title_aliases(title: Column) -> Column:
    """The part of a title before a colon, and the title."""
    t = F.coalesce(title, F.lit(""))
    return F.filter(F.array(F.when(F.contains(t, F.lit(":")), F.trim(F.split_part(t, F.lit(":"), F.lit(1)))), t), lambda a: a.isNotNull() & (a != ""))


def is_anchored(quote: Column, marker: Column, title: Column) -> Column:
    q, m = F.coalesce(quote, F.lit("")), F.coalesce(marker, F.lit(""))
    return ((m != "") & F.contains(q, m)) | F.exists(title_aliases(title), lambda a: F.contains(F.lower(q), F.lower(a)))


def is_title_only(quote: Column, title: Column) -> Column:
    """Whether a quote is nothing but the title, or holds it with at most three words more, or speaks of references."""
    q, t = plain(F.regexp_replace(F.coalesce(quote, F.lit("")), r"\[[^\]]+\]", "")), plain(title)
    short = F.size(_words(q)) <= F.size(_words(t)) + 3
    return (q == "") | ((t != "") & ((q == t) | (F.contains(q, t) & short))) | says(quote, "reference_only")


def is_grouped(quote: Column, marker: Column) -> Column:
    """Whether the marker stands in brackets of a quote whose brackets hold other numbers too."""
    inside = F.array_join(F.regexp_extract_all(F.coalesce(quote, F.lit("")), F.lit(r"\[[^\]]+\]"), F.lit(0)), " ")
    numbers = F.array_distinct(F.regexp_extract_all(inside, F.lit(r"\d+"), F.lit(0)))
    own = F.regexp_replace(F.coalesce(marker, F.lit("")), r"\D+", "")
    return (own != "") & F.array_contains(numbers, own) & (F.size(numbers) > 1)


def is_mere_mention() -> Column:
    """Whether the words about a finding call it a listing."""
    text = F.lower(F.concat_ws(" ", "citation_text", "reasoning", "mention_type", "claim_type"))
    return F.exists(_strings(MENTION), lambda p: F.contains(text, p))


def contracts(spark: SparkSession) -> DataFrame:
    """contract_type, contract_allowed."""
    return spark.createDataFrame(list(CONTRACTS.items()), "contract_type string, contract_allowed array<string>")


def effective_rules(templates: DataFrame) -> DataFrame:
    """templates with the rules that hold: a template's own ones over its type's contract; without either, a built-in one takes the types among its aspects."""
    joined = templates.join(F.broadcast(contracts(templates.sparkSession)), c("template_type") == c("contract_type"), "left")  # one row for each entry of CONTRACTS
    own = F.when(F.size("allowed_types") > 0, c("allowed_types"))
    rest = F.when(~c("user_defined"), c("aspects"))
    known = c("contract_type").isNotNull()
    return joined.select(
        *(x for x in templates.columns if x not in ("allowed_types", "require_marker")),
        F.coalesce(own, "contract_allowed", rest, F.array().cast("array<string>")).alias("allowed_types"),
        F.coalesce("require_marker", known).alias("require_marker"),
    )


def stance() -> Column:
    """A template's stance: neutral before negative before positive; empty without one."""
    text = F.lower(F.concat_ws(" ", "template_type", "name", "goal"))
    has = lambda kind: F.exists(_strings(STANCES[kind]), lambda t: F.contains(text, t))
    return F.when(has("neutral"), "neutral").when((c("template_type") == "limitation_or_negative") | has("negative"), "negative").when((c("template_type") == "positive_evaluation") | has("positive"), "positive").otherwise("")


#: The cues that rules look for in a quote, and in quote and context together.
QUOTE_CUES = ("limitation", "not_neutral", "negative", "action", "statement")
BOTH_CUES = ("comparison", "detail", "baseline", "evaluation", "praise", "spoiled", "theory", "theory_use", "method_use", "action", "statement")


def prepared(findings: DataFrame) -> DataFrame:
    """findings with what several rules ask of them, each found once: _text (quote and context), anchor, title only, mere mention, grouped, and cues."""
    quote, context = F.coalesce("citation_text", F.lit("")), F.coalesce("context", F.lit(""))
    rows = findings.withColumns({"_text": F.concat_ws(" ", quote, context), "_anchored": is_anchored(quote, c("target_marker"), c("title")), "_title_only": is_title_only(quote, c("title")), "_mention": is_mere_mention(), "_grouped": is_grouped(quote, c("target_marker"))})
    cues = {f"_quote_{x}": says(quote, x) for x in QUOTE_CUES} | {f"_both_{x}": says(c("_text"), x) for x in BOTH_CUES} | {"_context_limitation": says(context, "limitation")}
    sentences = F.size(F.filter(F.split("_text", r"(?<=[.!?])\s+|[\r\n]+"), lambda x: F.trim(x) != ""))
    return rows.withColumns(cues | first_parts() | {"_long": (sentences >= 2) | (F.length(context) >= 220), "_plain": plain(F.concat_ws(" ", quote, F.when(context != "", context).otherwise(quote)))})


def guard() -> Column:
    """Why no template can hold for a prepared finding; null where one may."""
    return (
        F.when(F.trim(F.coalesce("citation_text", F.lit(""))) == "", "no citation_text body evidence")
        .when(c("reference_match_status") == "mismatch", "reference mismatch")
        .when(c("_title_only"), "title-only or reference-only evidence does not satisfy the template")
        .when(c("require_marker") & ~c("_anchored") & ~c("inherited"), "citation_text does not anchor to target paper")
    )


def _not_allowed(unknown: str = "unknown") -> Column:
    kind = F.when(c("claim_type") != "", c("claim_type")).otherwise(unknown)
    return F.concat(F.lit("evidence type "), kind, F.lit(" is not allowed by the template"))


def _graded(blocked: Column, allowed: Column, need: Column, lacking: str, strong: Column, candidate: Column, reasons: tuple[str, str], terms: tuple[list[str], list[str]], not_allowed: Column | None = None) -> Column:
    """struct(level, reason, failure, terms, score) of a rule: what blocks it, the types and words that it needs, and its two degrees."""
    failure = F.when(blocked.isNotNull(), blocked).when(~allowed, not_allowed if not_allowed is not None else _not_allowed()).when(~need, lacking)
    level = F.when(failure.isNotNull(), "none").when(strong, "strong").when(candidate, "candidate").otherwise("none")
    pick = lambda a, b, none: F.when(level == "strong", a).when(level == "candidate", b).otherwise(none)
    return F.struct(level.alias("level"), pick(*map(F.lit, reasons), F.lit("")).alias("reason"), F.coalesce(failure, F.lit("")).alias("failure"), pick(_strings(terms[0]), _strings(terms[1]), _strings([])).alias("terms"), pick(F.lit(30.0), F.lit(15.0), F.lit(0.0)).alias("score"))


def _claims(types: list[str]) -> Column:
    return c("claim_type").isin(*types)


def _both(cue: str) -> Column:
    return c(f"_both_{cue}")


def _quote(cue: str) -> Column:
    return c(f"_quote_{cue}")


def first_parts() -> dict[str, Column]:
    """Of a finding: expressions of a first claim, the number of its anchors, and whether an expression and an anchor lie within FIRST_REACH characters, nothing parting them; the first place of each counts."""
    quote = F.coalesce("citation_text", F.lit(""))
    low = F.lower(quote)
    flat = F.trim(F.regexp_replace(F.regexp_replace(low, "[–—]", "-"), r"\s+", " "))
    terms = F.filter(_strings(FIRST), lambda t: F.contains(flat, t))
    places = lambda x: F.filter(F.transform(x, lambda t: F.instr(low, F.lower(F.trim(t))) - 1), lambda p: p >= 0)
    marker = F.coalesce("target_marker", F.lit(""))
    own = F.when((marker != "") & F.contains(quote, marker), F.array(F.instr(quote, marker) - 1)).otherwise(F.array().cast("array<int>"))
    anchors = F.concat(own, places(title_aliases(c("title"))))
    parted = lambda a, b: F.substring(low, F.least(a, b) + 1, F.abs(a - b)).rlike("|".join(PARTING))
    near = F.exists(places(terms), lambda a: F.exists(anchors, lambda b: (F.abs(a - b) <= FIRST_REACH) & ~parted(a, b)))
    return {"_first_terms": terms, "_first_anchors": F.size(anchors), "_first_near": near}


def first_claim() -> Column:
    terms = c("_first_terms")
    failure = (
        F.when(c("_guard").isNotNull(), c("_guard"))
        .when(F.size(terms) == 0, "no explicit first/pioneering expression in body text")
        .when(c("_first_anchors") == 0, "first/pioneering expression has no target title or reference marker anchor")
        .when(~c("_first_near"), "explicit first/pioneering expression does not modify the target paper")
    )
    ok = failure.isNull()
    reason = F.when(ok, F.concat(F.lit("explicit first/pioneering expression targets cited paper: "), F.array_join(terms, ", "))).otherwise("")
    return F.struct(F.when(ok, "strong").otherwise("none").alias("level"), reason.alias("reason"), F.coalesce(failure, F.lit("")).alias("failure"), terms.alias("terms"), F.when(ok, 30.0).otherwise(0.0).alias("score"))


def detailed_comparison() -> Column:
    compared = _both("comparison")
    return _graded(c("_guard"), _claims(COMPARED), compared, "no explicit comparison expression in body text", compared & _both("detail") & c("_long"), compared,
        ("target-anchored substantive comparison with concrete details", "target-anchored comparison candidate; detail or metric support requires review"), (["comparison", "concrete comparison detail"], ["comparison candidate"]))


def baseline() -> Column:
    used = _both("baseline")
    return _graded(c("_guard"), _claims(MEASURED), used, "target paper is not explicitly used as a baseline or benchmark", used & _both("evaluation"), used,
        ("target paper is explicitly used as an evaluated baseline or benchmark", "target paper is described as a baseline or benchmark candidate; experimental use requires review"), (["baseline or benchmark", "evaluation context"], ["baseline or benchmark candidate"]))


def _described() -> Column:
    return _quote("statement") | _quote("action")


def positive_evaluation() -> Column:
    praised, spoiled = _both("praise"), _both("spoiled")
    blocked = F.coalesce(c("_guard"), F.when(~_claims(PRAISED), _not_allowed()), F.when(spoiled, "limitation feedback cannot satisfy positive evaluation"))
    return _graded(blocked, F.lit(True), praised | _described(), "no target-specific capability, contribution, effect, or value statement", praised, _described(),
        ("explicit target-anchored positive evaluation in body text", "target-anchored method or capability description is a positive-evaluation candidate"), (["explicit positive evaluation"], ["target-specific capability candidate"]))


def limitation() -> Column:
    own, around = _quote("limitation"), c("_context_limitation")
    return _graded(c("_guard"), _claims(CONTRACTS["limitation_or_negative"]), own | around, "no explicit target-specific limitation or negative evaluation", own, around,
        ("target-anchored body evidence explicitly states a limitation or practical constraint", "the surrounding target context contains a limitation that requires scope review"), (["explicit limitation or negative evaluation"], ["contextual limitation candidate"]))


def theoretical_foundation() -> Column:
    theory = _both("theory")
    return _graded(c("_guard"), _claims(CONTRACTS["theoretical_foundation"]), theory, "no target-specific model, theory, equation, mechanism, or derivation statement", theory & _both("theory_use"), theory,
        ("target paper is explicitly used as a theoretical or methodological foundation", "target-anchored model or mechanism description is a theoretical-foundation candidate"), (["explicit theoretical dependency"], ["model or mechanism candidate"]))


def method_foundation() -> Column:
    told = _described()
    return _graded(c("_guard"), _claims(CONTRACTS["method_foundation"]), told, "no concrete target-specific method description", told & _both("method_use") & (c("claim_type") != "method_summary"), told,
        ("the citing paper explicitly adopts or builds on the target paper's method", "the body describes a concrete target method, but adoption or dependency requires review"), (["explicit method adoption or dependency"], ["concrete method summary"]))


def capability_summary() -> Column:
    allowed = F.array_contains("allowed_types", c("claim_type"))
    blocked = F.coalesce(c("_guard"), F.when(~allowed, F.concat(F.lit("evidence type "), "claim_type", F.lit(" is not allowed by the template"))), F.when(c("_mention") & ~_both("action"), "plain related work without a substantive target-specific claim"))
    out = _graded(blocked, F.lit(True), _both("statement"), "no concrete method, mechanism, capability, or contribution statement", F.lit(True), F.lit(False),
        ("target-anchored body text concretely describes the paper's method, mechanism, or capability", ""), ([], []))
    return out.withField("terms", F.when(out["level"] == "strong", F.array("claim_type")).otherwise(_strings([])))


def neutral_attitude() -> Column:
    """A factual description with the target's anchor and neither praise nor criticism; a mere mention is a candidate."""
    quote = c("citation_text")
    anchored = c("_anchored") | c("inherited")
    good, bad, told = _quote("not_neutral"), _quote("negative"), _described()
    blocked = (
        F.when(c("reference_match_status") == "mismatch", "reference mismatch")
        .when(~anchored, "citation_text does not anchor to target paper")
        .when(c("_title_only"), "title-only or reference-only evidence does not satisfy the template")
        .when(good, "explicit positive evaluation is not neutral evidence")
        .when(bad, "limitation or negative evaluation is not neutral evidence")
        .when(~_claims(NEUTRAL), F.concat(F.lit("evidence type "), F.when(c("claim_type") != "", c("claim_type")).otherwise("unknown"), F.lit(" is not neutral evidence")))
    )
    out = _graded(blocked, F.lit(True), F.lit(True), "", told & _claims([x for x in NEUTRAL if x != "ordinary_reference"]), F.lit(True),
        ("target-anchored factual method or capability description without positive or negative evaluation", "neutral target mention requires review because it lacks a substantive method or capability statement"), (["neutral target-specific description"], ["neutral mention candidate"]))
    return out.withField("failure", F.when(blocked.isNull() & ~told, "neutral mention lacks a substantive target-specific description").otherwise(out["failure"]))


def configured_parts() -> dict[str, Column]:
    """Of a finding and a template of words: the terms that the text holds and the finding's keywords that agree with one."""
    held = lambda terms: F.filter(F.col(terms), lambda t: (plain(t) != "") & F.contains("_plain", plain(t)))
    known = F.filter(F.transform(F.concat("positive", "required"), plain), lambda t: t != "")
    words = F.filter(F.filter(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), F.trim), lambda k: k != ""), lambda k: F.exists(known, lambda t: F.contains(plain(k), t) | F.contains(t, plain(k))))
    return {"_positive": held("positive"), "_needed": held("required"), "_excluded": held("negative"), "_words": words}


def configured() -> Column:
    """A template of words: exclusions, required patterns, concepts, lengths, types; what a model named counts for it."""
    quote = F.coalesce("citation_text", F.lit(""))
    positive, needed, excluded, words = c("_positive"), c("_needed"), c("_excluded"), c("_words")
    named = F.array_contains("model_ids", c("template_id")) & F.coalesce("model_satisfied", F.lit(True))
    typed = ~c("user_defined") & (c("claim_type") != "") & F.array_contains("allowed_types", c("claim_type"))
    specific = F.exists(positive, lambda t: F.contains(plain(t), F.lit(" ")) | (F.length(plain(t)) >= 8))
    blocked = (
        F.when(F.trim(quote) == "", "no citation_text body evidence")
        .when(c("reference_match_status") == "mismatch", "reference mismatch")
        .when(c("_title_only"), "title-only or reference-only evidence does not satisfy the template")
        .when((c("require_marker") | c("user_defined")) & ~c("_anchored"), "citation_text does not anchor to target paper")
        .when((c("min_chars") > 0) & (F.length(quote) < c("min_chars")), F.concat(F.lit("citation_text shorter than min_citation_chars="), c("min_chars").cast("string")))
        .when((c("min_words") > 0) & (F.size(_words(quote)) < c("min_words")), F.concat(F.lit("citation_text shorter than min_citation_words="), c("min_words").cast("string")))
        .when(F.size(excluded) > 0, F.concat(F.lit("matched exclusion terms: "), F.array_join(excluded, ", ")))
        .when(c("user_defined") & (F.size("required") > 0) & (F.size(needed) == 0), "no required evidence pattern matched")
        .when((F.size("allowed_types") > 0) & (c("claim_type") != "") & ~F.array_contains("allowed_types", c("claim_type")), _not_allowed())
        .when(c("_mention") & ~_quote("action"), "plain related work without a substantive target-specific claim")
        .when(~(named | typed | (F.size(needed) > 0) | specific), "no substantive configured concept matched in body evidence")
    )
    support = named | typed | (F.size(needed) > 0) | (F.size(positive) >= 2) | (F.size(words) >= 2)
    return F.struct(blocked.alias("blocked"), support.alias("support"), named.alias("named"), F.array_distinct(F.concat(needed, positive, words)).alias("terms"))


def configured_verdict() -> Column:
    """The verdict from what configured() found (column _own)."""
    blocked, terms = c("_own.blocked"), c("_own.terms")
    unattributed = blocked.isNull() & c("_grouped") & ~c("_own.named")
    failure = F.when(unattributed, "grouped citation attribution awaits model judgment").otherwise(blocked)
    hard = failure.rlike("^(?:" + "|".join(HARD) + ")")
    level = F.when(failure.isNull(), "strong").when(unattributed | (c("_own.support") & ~hard), "candidate").otherwise("none")
    tail = F.when(F.size(terms) > 0, F.concat(F.lit(": "), F.array_join(F.slice(terms, 1, 8), ", "))).otherwise("")
    reason = F.when(level == "strong", F.concat(F.lit("body evidence satisfies the configured template"), tail)).when(level == "candidate", F.concat(F.lit("body evidence is a configured-template candidate; strict review pending: "), failure, tail)).otherwise("")
    score = F.when(level == "strong", F.least(F.lit(30.0), 15.0 + 5.0 * F.size(terms))).when(level == "candidate", F.least(F.lit(20.0), 10.0 + 3.0 * F.size(terms))).otherwise(0.0)
    return F.struct(level.alias("level"), reason.alias("reason"), F.when(level == "none", failure).otherwise("").alias("failure"), terms.alias("terms"), score.alias("score"))


#: The rule of each type; the others have the configured one, or the neutral one by their stance. Only first claims are judged without a claim type.
RULES = {
    "detailed_comparison": detailed_comparison,
    "baseline_or_benchmark": baseline,
    "positive_evaluation": positive_evaluation,
    "limitation_or_negative": limitation,
    "theoretical_foundation": theoretical_foundation,
    "method_foundation": method_foundation,
    "method_or_capability_summary": capability_summary,
}


def _judged(rows: DataFrame) -> DataFrame:
    """rows (prepared findings with their templates) with v, their verdict."""
    claimed, kind = F.coalesce("claim_type", F.lit("")) != "", c("template_type")
    verdict = F.when(kind.isin("first_or_seminal_claim", "first_or_pioneering_claim"), first_claim())
    for name, rule in RULES.items():
        verdict = verdict.when(claimed & (kind == name), rule())
    verdict = verdict.when(claimed & (c("_stance") == "neutral"), neutral_attitude()).otherwise(configured_verdict())
    return rows.withColumns(configured_parts()).withColumn("_own", configured()).withColumn("v", verdict)


def _attributed() -> Column:
    """Whether the model attributes a grouped citation to the target for a template."""
    named = F.array_contains("model_ids", c("template_id")) & F.coalesce("model_satisfied", F.lit(True))
    fits = F.lit(False)
    for kind, types in ATTRIBUTED.items():
        fits = fits | ((c("template_type") == kind) & c("claim_type").isin(*types))
    return named | ((F.lower(F.coalesce("recommendation", F.lit(""))) == "include") & fits)


def evaluations(findings: DataFrame, templates: DataFrame, key: str = "evidence_id") -> DataFrame:
    """key, template_id, template_type, level (strong, candidate, none), reason, failure, terms, score: every finding with every enabled template of its session.

    A strong match of a grouped citation is a candidate unless the model attributes it."""
    rules = effective_rules(templates.where("enabled")).withColumn("_stance", stance()).withColumnRenamed("session_id", "t_session")
    rows = prepared(findings).join(rules, c("session_id") == c("t_session")).withColumn("_guard", guard())
    rows = _judged(rows)
    lowered = (c("v.level") == "strong") & c("_grouped") & ~_attributed()
    return rows.select(
        key, "template_id", "template_type", F.when(lowered, "candidate").otherwise(c("v.level")).alias("level"),
        F.when(lowered, F.concat(c("v.reason"), F.lit("; grouped citation attribution awaits model judgment"))).otherwise(c("v.reason")).alias("reason"),
        "v.failure", "v.terms", F.when(lowered, F.least(F.lit(20.0), c("v.score"))).otherwise(c("v.score")).alias("score"),
    )


def together(rows: DataFrame, names: DataFrame, key: str = "evidence_id") -> DataFrame:
    """One row for each finding: template_ids and strong_ids in template order, template_match_level, reasons, failures (with the template's name). names: template_id, name; one row for each template."""
    ok = c("level") != "none"
    named = rows.join(names.select(c("template_id").alias("n_id"), "name"), c("template_id") == c("n_id"))
    said = named.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("template_id", "level", "reason", "failure", "name"))).alias("all"))
    pick = lambda test, field: F.transform(F.filter("all", test), field)
    held, strong = lambda x: x["level"] != "none", lambda x: x["level"] == "strong"
    level = F.when(F.exists("all", strong), "strong").when(F.exists("all", held), "candidate").otherwise("none")
    return said.select(
        key, pick(held, lambda x: x["template_id"]).alias("template_ids"), pick(strong, lambda x: x["template_id"]).alias("strong_ids"), level.alias("template_match_level"),
        F.array_join(pick(held, lambda x: x["reason"]), "; ").alias("reasons"),
        F.array_join(pick(lambda x: x["level"] == "none", lambda x: F.concat(x["name"], F.lit(": "), x["failure"])), "; ").alias("failures"),
    )


def reapplied(findings: DataFrame, templates: DataFrame, cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What reapplying a session's templates gives: every finding with its verdict and whether its level changed (findings: with old_level), and by session the numbers of
    findings, matched, strong, changed and of cards whose finding is matched. cards: card_id, card_evidence."""
    names = templates.groupBy("template_id").agg(F.min("name").alias("name"))
    verdict = together(evaluations(findings, templates), names)
    own = findings.select(c("evidence_id").alias("f_id"), "session_id", "old_level")
    rows = own.join(verdict, c("f_id") == c("evidence_id"), "left").select(c("f_id").alias("evidence_id"), "session_id", "old_level", F.coalesce("template_match_level", F.lit("none")).alias("template_match_level"), "template_ids", "strong_ids", "reasons", "failures")
    rows = rows.withColumn("changed", ~c("template_match_level").eqNullSafe(c("old_level")))
    n_cards = cards.groupBy(c("card_evidence").alias("k_id")).agg(F.count(F.lit(1)).alias("cards"))
    level = c("template_match_level")
    counts = rows.join(n_cards, c("evidence_id") == c("k_id"), "left").groupBy("session_id").agg(F.count(F.lit(1)).alias("findings"), F.count_if(level != "none").alias("matched"), F.count_if(level == "strong").alias("strong"), F.count_if("changed").alias("changed"), F.coalesce(F.sum(F.when(level != "none", c("cards"))), F.lit(0)).alias("cards"))
    return rows, counts
