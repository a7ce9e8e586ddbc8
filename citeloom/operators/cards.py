"""Cards and reports made from evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.names import canonical_quote_key
from citeloom.rounds import numbered, settled, written

# Evidence types that make a card of their own type.
CARD_TYPES = ("first_or_seminal_claim", "detailed_comparison", "baseline_or_benchmark", "theoretical_foundation", "method_foundation", "application_extension", "important_author_citation", "long_context_citation")
#: Report sections in order, with the card types that go there.
SECTIONS = (
    ("evaluative", ("first_or_seminal_claim", "positive_evaluation", "important_author_citation")),
    ("precision", ("detailed_comparison", "baseline_or_benchmark")),
    ("method_summary", ("method_foundation", "theoretical_foundation")),
    ("capability", ("application_extension", "long_context_citation")),
    ("review", ("neutral_evaluation",)),
    ("limitation", ("limitation_or_negative",)),
)


def card_type(kind: Column, stance: Column) -> Column:
    """Negative and mixed evidence makes a limitation, but for comparisons; neutral custom evidence a neutral card; the rest follows its type."""
    return (
        F.when(stance.isin("negative", "mixed") & ~kind.isin("detailed_comparison", "baseline_or_benchmark"), "limitation_or_negative")
        .when((stance == "neutral") & (kind == "custom_template_evidence"), "neutral_evaluation")
        .when(kind.isin(*CARD_TYPES), kind)
        .otherwise("positive_evaluation")
    )


def section(kind: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, kinds in SECTIONS:
        out = out.when(kind.isin(*kinds), name)
    return out.otherwise("review")


def typed(evidence: DataFrame, items: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """The evidence of items with their titles and the type of its card: the best template match's, unless that is custom. evidence, items, matches: see cards."""
    rows = evidence.join(items, "item_id")
    kind = card_type(F.col("evidence_type"), F.col("stance"))
    if matches is not None:
        best = matches.groupBy(F.col("evidence_id").alias("m_id")).agg(F.max_by("template_type", F.struct("match_score", -F.col("template_id"))).alias("m_type"))
        rows = rows.join(best, F.col("evidence_id") == F.col("m_id"), "left").drop("m_id")
        kind = F.when(F.col("m_type").isNotNull() & (F.col("m_type") != "custom"), F.col("m_type")).otherwise(kind)
    return rows.withColumn("card_type", kind)


def cards(evidence: DataFrame, items: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """A card for each piece of evidence: type (see typed), titles, whether it is included, and its order.

    evidence: scored and eligible. items: item_id, citing_title, cited_title. matches: evidence_id, template_type, match_score, template_id."""
    rows = typed(evidence, items, matches)
    rows = numbered(rows, "session_id", [(F.col("review_status") == "important").desc(), (F.col("review_status") == "accepted").desc(), F.desc("score"), F.asc("evidence_id")], "sort_order")
    title = F.concat(F.initcap(F.replace("card_type", F.lit("_"), F.lit(" "))), F.lit(": "), "citing_title")
    include = F.col("strength").isin("strong", "moderate") & (F.col("self_citation_status") != "self_citation")
    return rows.select("session_id", "evidence_id", "item_id", "card_type", title.alias("card_title"), F.concat(F.lit("cites "), "cited_title").alias("subtitle"), F.col("citation_text").alias("evidence_quote"), "strength", "review_status", include.alias("include_in_report"), "sort_order")


def agree(kept: Column, new: Column) -> Column:
    """Whether two quote keys say the same: one holds the other, or all but two words of the one with fewer characters (five at least) are in the other."""
    # the words are cut out once: a list of one pair
    fewer = F.length(kept) <= F.length(new)
    pairs = F.array(F.struct(F.split(F.when(fewer, kept).otherwise(new), " ").alias("short"), F.split(F.when(fewer, new).otherwise(kept), " ").alias("long")))
    shared = F.transform(pairs, lambda p: F.size(F.filter(p["short"], lambda w: F.array_contains(p["long"], w))) >= F.greatest(F.lit(5), F.size(p["short"]) - 2))
    return (kept != "") & (new != "") & (F.contains(kept, new) | F.contains(new, kept) | F.get(shared, F.lit(0)))


def _bits(hashes: str, high: bool) -> Column:
    """One half of 128 bits, of which each hash sets one."""
    at = lambda h: F.pmod(h, F.lit(128)).cast("int")
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda bits, h: bits.bitwiseOR(F.when((at(h) >= 64) == F.lit(high), F.call_function("shiftleft", F.lit(1).cast("long"), at(h))).otherwise(F.lit(0).cast("long"))))


def agreements(keys: DataFrame) -> DataFrame:
    """grp, kept, new of the distinct keys (grp, key) of a group that agree.

    Nothing is lost. If a key of three words or more lies in another or has all but two words there, at most two of its distinct words are not there: so one of its three rarest is (of fewer, one), and of the bits that its words set at most
    two are missing from the other's. Keys meet by rare words, as numbers; those that the bits tell apart go no further than the join. A shorter key has its first three characters in the other. Texts join last."""
    c = F.col
    words = F.array_distinct(F.split("key", " "))
    w = keys.where("key <> ''").select("grp", "key", F.monotonically_increasing_id().alias("id"), F.size(F.split("key", " ")).alias("size"), F.length("key").alias("chars"), F.transform(words, lambda t: F.xxhash64("grp", t)).alias("hs"))
    w = written(w.withColumns({"low": _bits("hs", False), "high": _bits("hs", True)}), "words")
    held = w.select("id", "chars", "low", "high", "size", F.explode("hs").alias("h"))
    counts = held.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    rare = held.where("size >= 3").join(counts, "h").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("n", "h"))).where("rank <= 3")
    rare = rare.select("h", *(c(x).alias(f"k_{x}") for x in ("id", "chars", "low", "high")))
    missing = lambda half: F.bit_count(c(f"k_{half}").bitwiseAND(F.bitwise_not(half)))
    by_word = rare.join(held.drop("size"), (rare["h"] == held["h"]) & (c("k_chars") <= c("chars")) & (missing("low") + missing("high") <= 2)).select("k_id", "id")
    begin = F.substring("key", 1, 3)
    short = w.where("size <= 2").select(c("id").alias("k_id"), c("key").alias("k_key"), c("grp").alias("k_grp"), F.length(begin).alias("n"), F.xxhash64("grp", begin).alias("k_h"))
    lengths = short.groupBy("k_grp").agg(F.collect_set("n").alias("ns"))  # numbers from 1 to 3
    places = F.flatten(F.transform("ns", lambda n: F.transform(F.sequence(F.lit(1), "chars"), lambda i: F.xxhash64("grp", F.substring(c("key"), i, n)))))
    pieces = w.join(lengths, c("grp") == c("k_grp")).select("id", "key", F.explode(F.array_distinct(places)).alias("h"))
    by_begin = pieces.join(short, (c("h") == c("k_h")) & F.contains("key", c("k_key"))).select("k_id", "id")
    pairs = by_word.unionByName(by_begin).distinct()
    text = lambda id_, key: w.select(c("id").alias(id_), "grp", c("key").alias(key))
    pairs = pairs.join(text("k_id", "key"), "k_id").join(text("id", "holder").drop("grp"), "id")
    way = lambda kept, new: F.struct(c(kept).alias("kept"), c(new).alias("new"))
    both = pairs.select("grp", F.explode(F.array(way("key", "holder"), way("holder", "key"))).alias("p")).select("grp", "p.*").distinct()
    return both.where(agree(c("kept"), c("new")))


#: Rows of one kept quote are looked through in so many parts before their best ones meet.
PARTS = 32


def distinct_quotes(rows: DataFrame) -> DataFrame:
    """Evidence without equivalent quotes within an item and card type (item_id, card_type, evidence_id), and the number that each stands for (copies). rows: item_id, card_type, evidence_id (unique), quote, review_status, score.

    In the order of ids, a quote joins the first kept one that it agrees with, and takes its place if it is preferred: important, accepted, higher score, longer, larger id. Agreement isn't transitive, and what a kept place
    agrees with changes with its quote, so the rule is ordered. It is found as a fixed point of rounds (see citeloom.rounds): given each quote's place, the quotes that a place had over time are its members that were preferred to all
    before; given these, a quote's place is the first whose quote at its time agrees with it. Which keys agree is found once. No item, type or place is gathered in one task."""
    quote, status = F.coalesce("quote", F.lit("")), F.coalesce("review_status", F.lit(""))
    preference = F.struct((status == "important").alias("p1"), (status == "accepted").alias("p2"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("p3"), F.length(quote).alias("p4"), F.col("evidence_id").alias("p5"))
    group = F.concat_ws("|", F.coalesce(F.col("item_id").cast("string"), F.lit("-")), F.coalesce("card_type", F.lit("-")))
    keyed = written(rows.select("item_id", "card_type", "evidence_id", group.alias("grp"), canonical_quote_key(quote).alias("key"), preference.alias("preference")), "quotes")
    edges = written(agreements(keyed.select("grp", "key").distinct()), "agreements")
    own = keyed.select(F.col("evidence_id").alias("id"), "grp", "key", "preference")

    def leading(members: DataFrame, *part: Column | str) -> DataFrame:
        before = F.max("preference").over(Window.partitionBy("place", *part).orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
        return members.withColumn("before", before).where("before is null or preference > before").drop("before")

    def step(placed: DataFrame) -> DataFrame:
        members = placed.select(F.col("id").alias("m_id"), "place").join(own, F.col("m_id") == F.col("id"))
        # what is not preferred to all before it in its part is not so in the whole
        led = leading(leading(members, F.pmod(F.xxhash64("id"), F.lit(PARTS))))
        led = led.select("grp", F.col("key").alias("kept"), "place", F.col("id").alias("since"), F.lead("id").over(Window.partitionBy("place").orderBy("id")).alias("until"))
        offered = led.join(edges, ["grp", "kept"]).select(F.col("grp").alias("o_grp"), F.col("new").alias("o_key"), "place", "since", "until")
        now = (F.col("grp") == F.col("o_grp")) & (F.col("key") == F.col("o_key")) & (F.col("since") < F.col("id")) & (F.col("until").isNull() | (F.col("id") <= F.col("until")))
        first = own.join(offered, now).groupBy(F.col("id").alias("f_id")).agg(F.min("place").alias("place"))
        return own.select("id").join(first, F.col("id") == F.col("f_id"), "left").select("id", F.coalesce("place", "id").alias("place"))

    placed = settled(own.select("id", F.col("id").alias("place")), step, "id", "place")
    members = placed.select(F.col("id").alias("m_id"), "place").join(own, F.col("m_id") == F.col("id"))
    best = members.groupBy("place").agg(F.max("preference").alias("m"), F.count(F.lit(1)).alias("copies")).select(F.col("m.p5").alias("b_id"), "copies")
    return keyed.join(best, F.col("evidence_id") == F.col("b_id")).select("item_id", "card_type", "evidence_id", "copies")


def generated(evidence: DataFrame, items: DataFrame, anchors: DataFrame, matches: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A session's cards made anew: one for each distinct quote whose anchor is not invalid, in rank order; and the evidence that becomes false positive.

    evidence: scored and eligible. anchors: evidence_id, status. matches: see cards(). existing: card_id, session_id, item_id, card_type, quote, is_user_edited, card_title. Of the existing cards that have a new one's
    item, type and quote key, the one that a user edited stays as it is (only its place is new), else the lowest id takes the new values; without any, card_id is null."""
    a = anchors.select(F.col("evidence_id").alias("a_id"), F.col("status").alias("anchor_status"))
    made = cards(evidence, items, matches)
    first = distinct_quotes(made.join(evidence.select(F.col("evidence_id").alias("s_id"), "score"), F.col("evidence_id") == F.col("s_id")).select("item_id", "card_type", "evidence_id", F.col("evidence_quote").alias("quote"), "review_status", "score"))
    chosen = made.join(first.select(F.col("evidence_id").alias("f_id"), "copies"), F.col("evidence_id") == F.col("f_id")).drop("f_id").join(a, F.col("evidence_id") == F.col("a_id"), "left").drop("a_id")
    bad = chosen.where("anchor_status = 'invalid'").select("evidence_id", F.lit("false_positive").alias("review_status"))
    good = chosen.where("anchor_status is null or anchor_status <> 'invalid'").withColumn("key", canonical_quote_key(F.col("evidence_quote")))
    own = existing.select(F.col("session_id").alias("x_session"), F.col("item_id").alias("x_item"), F.col("card_type").alias("x_type"), canonical_quote_key(F.col("quote")).alias("x_key"), "card_id", "is_user_edited", F.col("card_title").alias("x_title"))
    own = own.groupBy("x_session", "x_item", "x_type", "x_key").agg(F.min_by(F.struct("card_id", "is_user_edited", "x_title"), F.struct(~F.col("is_user_edited"), F.col("card_id"))).alias("x"))
    same = (F.col("session_id") == F.col("x_session")) & (F.col("item_id") == F.col("x_item")) & (F.col("card_type") == F.col("x_type")) & (F.col("key") == F.col("x_key"))
    rows = good.join(own, same, "left").withColumn("card_title", F.when(F.col("x.is_user_edited"), F.col("x.x_title")).otherwise(F.col("card_title")))
    rows = rows.withColumns({"card_id": F.col("x.card_id"), "user_edited": F.coalesce("x.is_user_edited", F.lit(False))})
    rows = numbered(rows.withColumnRenamed("sort_order", "rank_order"), "session_id", [F.col("rank_order")], "sort_order")
    return rows.select("session_id", "card_id", "evidence_id", "item_id", "card_type", "card_title", "evidence_quote", "copies", "user_edited", "sort_order"), bad


# What a card's section is called, and the sentences of a judgment.
SECTION_NAMES = {
    "theoretical_foundation": "理论基础影响",
    "method_foundation": "方法采用",
    "representative_work": "代表性相关工作",
    "limitation_or_negative": "局限性反馈",
    "detailed_comparison": "详细对比",
    "baseline_or_benchmark": "基线与比较对象",
    "positive_evaluation": "正向评价",
    "neutral_evaluation": "中性评价",
    "ordinary_citation": "普通引用待复核",
    "background_reference": "背景引用待复核",
    "weak_mention": "弱证据待复核",
    "citation_only": "仅引用记录",
}
NO_SECTION, TO_REVIEW = "报告素材", "（成组引用待复核）"
REASONS = {
    "theoretical_foundation": "因此判断为理论基础：该段不是单纯列出参考文献，而是在正文技术论述中把目标论文作为建模、推导或概念说明的依据。",
    "method_foundation": "因此判断为方法采用：该段将目标论文关联到后续方法设计、技术流程或实现依据。",
    "representative_work": "因此判断为代表性相关工作：该段体现目标论文被纳入相关工作或技术路线梳理，但不是直接高度评价。",
    "limitation_or_negative": "因此判断为局限性反馈：该段表达的是限制、负面比较或技术约束，不能改写成正向亮点。",
}
ORDINARY_REASON = "因此判断为普通/背景引用：该段能证明正文引用存在，但不足以支持高度评价、方法采用或详细对比。"
POSITIVE_REASON, OTHER_REASON = "因此判断为正向证据：该段包含可追溯到原文的正向评价或使用依据。", "该判断基于正文原文、引用锚点、证据类型和人工复核状态综合给出。"
GROUPED_RISK, ORDINARY_RISK, LIMITATION_RISK = "这是成组引用，需要人工确认归因范围。", "这不是直接正向评价，不应包装成高度评价。", "这是局限性反馈/负面比较，不应改写成正向亮点。"
ORDINARY_TYPES = ("ordinary_citation", "background_reference", "citation_only", "weak_mention")


def judgments(cards_: DataFrame) -> DataFrame:
    """cards_ (card_type, mention_type, stance, strength) with judgment_label, reason_sentence, risk_note and confidence."""
    kind, grouped = F.col("card_type"), F.coalesce(F.col("mention_type") == "grouped_citation", F.lit(False))
    name = F.lit(NO_SECTION)
    for k, v in SECTION_NAMES.items():
        name = F.when(kind == k, v).otherwise(name)
    why = F.when(F.col("stance") == "positive", POSITIVE_REASON).otherwise(OTHER_REASON)
    why = F.when(kind.isin(*ORDINARY_TYPES), ORDINARY_REASON).otherwise(why)
    for k, v in REASONS.items():
        why = F.when(kind == k, v).otherwise(why)
    risk = F.concat_ws(" ", F.when(grouped, GROUPED_RISK), F.when(kind.isin("representative_work", *ORDINARY_TYPES), ORDINARY_RISK), F.when(kind == "limitation_or_negative", LIMITATION_RISK))
    return cards_.select(
        "*", F.when(grouped, F.concat(name, F.lit(TO_REVIEW))).otherwise(name).alias("judgment_label"), why.alias("reason_sentence"), risk.alias("risk_note"),
        F.when(F.col("strength").isin("weak", "moderate"), "medium").otherwise("high").alias("confidence"),
    )


def session_summaries(publications: DataFrame, edges: DataFrame, queue: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row for each session: publications and their list (JSON, by id), edges, queue items, analysed and selected ones, evidence and important evidence."""
    n = lambda cond, name: F.count_if(F.coalesce(cond, F.lit(False))).alias(name)
    p = publications.groupBy("session_id").agg(F.count(F.lit(1)).alias("publications"), F.to_json(F.array_sort(F.collect_list(F.struct("publication_id", "title", "year", "doi")))).alias("publication_list"))
    out = p
    for df, name in (
        (edges.groupBy("session_id").agg(F.count(F.lit(1)).alias("edges")), "e"),
        (queue.groupBy("session_id").agg(F.count(F.lit(1)).alias("queue_items"), n(F.col("queue_status") == "analyzed", "analysed"), n(F.col("queue_status") == "selected", "selected")), "q"),
        (evidence.groupBy("session_id").agg(F.count(F.lit(1)).alias("evidence"), n(F.col("review_status") == "important", "important")), "v"),
    ):
        out = out.join(df.withColumnRenamed("session_id", f"{name}_session"), F.col("session_id") == F.col(f"{name}_session"), "left").drop(f"{name}_session")
    return out.fillna(0, ["edges", "queue_items", "analysed", "selected", "evidence", "important"])


def reportable(cards_: DataFrame, evidence: DataFrame) -> DataFrame:
    """Included cards whose evidence exists, is not refused and has a quote."""
    e = evidence.select(F.col("evidence_id").alias("e_id"), F.col("review_status").alias("e_status"), F.col("citation_text").alias("e_quote"))
    ok = F.col("include_in_report") & ~F.coalesce(F.col("e_status").isin("rejected", "false_positive"), F.lit(False)) & (F.trim(F.coalesce("e_quote", F.lit(""))) != "")
    return cards_.join(e, F.col("evidence_id") == F.col("e_id")).where(ok).drop("e_id", "e_status", "e_quote")


def report_sections(cards_: DataFrame) -> DataFrame:
    """Cards with section and their number in the report."""
    order = F.array_position(F.array(*(F.lit(n) for n, _ in SECTIONS)), F.col("section"))
    return numbered(cards_.withColumn("section", section(F.col("card_type"))), "session_id", [order, F.col("sort_order")], "number")


def conclusions(sections: DataFrame) -> DataFrame:
    """Counts by section and one line for each session."""
    counts = sections.groupBy("session_id").pivot("section", [n for n, _ in SECTIONS]).count().fillna(0)
    strong = F.col("evaluative") + F.col("precision")
    line = F.when(strong >= 5, "strong impact").when(strong > 0, "visible impact").when(F.col("method_summary") + F.col("capability") > 0, "use without evaluation").otherwise("background only")
    return counts.withColumn("conclusion", line)


def workspace_stats(cards_: DataFrame) -> DataFrame:
    n = lambda cond, name: F.count_if(cond).alias(name)
    c = F.col
    return cards_.groupBy("session_id").agg(F.count(F.lit(1)).alias("cards"), n(c("include_in_report"), "included"), n(c("strength") == "strong", "strong"), n(c("strength") != "strong", "ordinary"), n(c("card_type") == "important_author_citation", "important_author"), n(c("review_status") == "unreviewed", "needs_review"))


def without_invalid(evidence: DataFrame) -> DataFrame:
    """Evidence whose anchor is invalid becomes a false positive of score 0. anchor_status: of each row."""
    bad = F.col("anchor_status") == "invalid"
    return evidence.withColumns({"review_status": F.when(bad, "false_positive").otherwise(F.col("review_status")), "score": F.when(bad, 0.0).otherwise(F.col("score")), "strength": F.when(bad, "none").otherwise(F.col("strength"))})


def with_latest_review(rows: DataFrame, log: DataFrame, key: str, value: str) -> DataFrame:
    """rows with the newest entry of an append-only log (key, value, ts, id) in place of their value."""
    new = log.groupBy(F.col(key).alias("l_key")).agg(F.max_by(value, F.struct("ts", "id")).alias("l_value"))
    return rows.join(new, F.col(key) == F.col("l_key"), "left").withColumn(value, F.coalesce("l_value", value)).drop("l_key", "l_value")


def reordered(cards_: DataFrame, lists: DataFrame) -> DataFrame:
    """Cards in the order of a session's list of evidence ids; cards outside the list keep theirs. lists: session_id, ids (array)."""
    pos = lists.select(F.col("session_id").alias("p_session"), F.posexplode("ids").alias("p", "p_id")).groupBy("p_session", "p_id").agg(F.min("p").alias("p"))
    return cards_.join(pos, (F.col("session_id") == F.col("p_session")) & (F.col("evidence_id") == F.col("p_id")), "left").withColumn("sort_order", F.coalesce(F.col("p") + 1, F.col("sort_order"))).drop("p_session", "p", "p_id")


def fallback_rows(analysed: DataFrame, cards_: DataFrame, latest: DataFrame) -> DataFrame:
    """Analysed items without a card, with their latest result, as synthetic cards."""
    rows = analysed.join(cards_.select(F.col("item_id").alias("has")).distinct(), F.col("item_id") == F.col("has"), "left_anti")
    l = latest.select(F.col("item_id").alias("l_item"), "result_id")  # noqa: E741
    return rows.join(l, F.col("item_id") == F.col("l_item"), "left").select("item_id", "result_id", F.when(F.col("result_id").isNull(), "no_result").otherwise("no_card").alias("reason"))


def structured_report(evidence: DataFrame, cards_: DataFrame) -> DataFrame:
    """session_id and report, a JSON text of counts and included cards in order. A session's included cards are its report, which is read as one document."""
    e = evidence.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_evidence"), F.count_if(F.col("strength") == "strong").alias("n_strong"))
    k = cards_.where("include_in_report").groupBy(F.col("session_id").alias("k_session")).agg(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "evidence_id", "card_type"))), lambda x: F.struct(x["evidence_id"].alias("evidence_id"), x["card_type"].alias("card_type"))).alias("cards"))
    rows = e.join(k, F.col("session_id") == F.col("k_session"), "left")
    return rows.select("session_id", "n_evidence", "n_strong", F.coalesce(F.size("cards"), F.lit(0)).alias("n_cards"), F.to_json(F.struct("session_id", "n_evidence", "n_strong", "cards")).alias("report"))


