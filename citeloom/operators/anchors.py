"""Citations inside full texts: sentences, markers, reference entries, anchors."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.names import norm_title_alnum, unaccented

# Fixed value: a sentence.
SENTENCE = r"[^.!?。！？]+[.!?。！？]?"
#: A marker range wider than this is read by its bounds only.
WIDEST_RANGE = 1000
#: So many texts of an Arrow batch are Python's objects at a time; a batch has thousands.
AT_ONCE = 64


def in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of AT_ONCE rows, without copies, so what Python holds does not grow with the rows of a task."""
    for b in batches:
        for at in range(0, b.num_rows, AT_ONCE):
            yield b.slice(at, AT_ONCE)


def sentences(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, sentence, start and stop, characters of the untrimmed match. Blank pieces go; their length still counts. A text is read once, in Arrow batches; no row carries more of it than its sentence."""
    pattern = re.compile(SENTENCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches):
            keys, rows = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = [(i, x, m.start(), m.end()) for i, m in enumerate(pattern.finditer(t)) if (x := m.group().strip(" "))]
                keys += [k] * len(own)
                rows += own
            columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((keys, *columns), (b.schema[0].type, pa.int32(), pa.string(), pa.int32(), pa.int32()), strict=True)], [key, "pos", "sentence", "start", "stop"])

    kind = texts.select(key).schema[0].dataType.simpleString()
    return texts.select(key, F.coalesce(text, F.lit("")).alias("t")).mapInArrow(run, f"{key} {kind}, pos int, sentence string, start int, stop int")


def target_keywords(title: Column) -> Column:
    """Words of four letters or more, without paper, study and analysis; repeated words repeat."""
    return F.filter(F.split(norm_title_alnum(title), " "), lambda w: (F.length(w) >= 4) & ~w.isin("paper", "study", "analysis"))


def candidate_spans(pieces: DataFrame, targets: DataFrame, key: str = "doc_id", most: int = 5) -> DataFrame:
    """The first sentences that hold a target's title or two of its keywords, as parts of words. targets: key, title."""
    t = targets.select(F.col(key).alias("t_key"), norm_title_alnum(F.col("title")).alias("t_title"), target_keywords(F.col("title")).alias("t_words"))
    rows = pieces.join(t, F.col(key) == F.col("t_key")).withColumn("norm", norm_title_alnum(F.col("sentence")))
    hits = F.size(F.filter("t_words", lambda w: F.contains(F.col("norm"), w)))
    rows = rows.where(((F.col("t_title") != "") & F.contains("norm", F.col("t_title"))) | (hits >= 2))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select(key, "rank", "pos", "sentence")


def marker_bounds(text: Column) -> Column:
    """array<struct<lo, hi>> of the citation markers in a text: [5], lists, ranges within or between brackets, in either order."""
    plain = F.translate(F.coalesce(text, F.lit("")), "–—", "--")
    pair = lambda a, b: F.struct(F.least(a.try_cast("long"), b.try_cast("long")).alias("lo"), F.greatest(a.try_cast("long"), b.try_cast("long")).alias("hi"))
    across = F.transform(F.regexp_extract_all(plain, F.lit(r"\[\d{1,15}\]\s*-\s*\[\d{1,15}\]"), F.lit(0)), lambda m: pair(F.regexp_extract(m, r"\[(\d+)\]", 1), F.regexp_extract(m, r"-\s*\[(\d+)\]", 1)))
    inside = F.flatten(F.transform(F.regexp_extract_all(plain, F.lit(r"\[([^\]]+)\]"), F.lit(1)), lambda x: F.split(x, ",")))
    inside = F.transform(inside, lambda x: F.trim(x))
    span = r"^(\d{1,15})\s*-\s*(\d{1,15})$"
    one = F.transform(F.filter(inside, lambda x: x.rlike(r"^\d{1,15}$")), lambda x: pair(x, x))
    some = F.transform(F.filter(inside, lambda x: x.rlike(span)), lambda x: pair(F.regexp_extract(x, span, 1), F.regexp_extract(x, span, 2)))
    return F.concat(across, one, some)


def has_marker(text: Column, marker: Column) -> Column:
    """Whether a marker is among a text's; ranges are tested by their bounds."""
    n = marker.try_cast("long")
    return F.coalesce(F.exists(marker_bounds(text), lambda b: (b["lo"] <= n) & (n <= b["hi"])), F.lit(False))


def markers(text: Column) -> Column:
    """The distinct markers of a text in order; of a range wider than WIDEST_RANGE only the ends."""
    wide = lambda b: b["hi"] - b["lo"] > WIDEST_RANGE
    return F.array_sort(F.array_distinct(F.flatten(F.transform(marker_bounds(text), lambda b: F.when(wide(b), F.array(b["lo"], b["hi"])).otherwise(F.sequence(b["lo"], b["hi"]))))))


def target_aliases(title: Column, authors: Column, first_author: Column) -> Column:
    """Texts that stand for a target: its title, the part before a colon, its first five long words, "name et al", the entry's first author; four characters or more."""
    norm = norm_title_alnum(title)
    long_words = F.slice(F.filter(F.split(norm, " "), lambda w: F.length(w) >= 5), 1, 5)
    names = F.transform(F.coalesce(authors, F.array().cast("array<string>")), lambda a: F.concat(F.element_at(F.split(norm_title_alnum(a), " "), -1), F.lit(" et al")))
    short = F.when(F.contains(title, F.lit(":")), norm_title_alnum(F.split_part(title, F.lit(":"), F.lit(1))))
    parts = F.concat(F.array(norm, short, F.array_join(long_words, " "), norm_title_alnum(first_author)), names)
    return F.array_distinct(F.filter(parts, lambda a: a.isNotNull() & (F.length(a) >= 4)))


def validate_anchor(quote: Column, marker: Column, aliases: Column) -> Column:
    """struct(status, reason, has_target, has_other): whether a quote cites the target, by marker, else by alias."""
    m = F.nullif(F.regexp_replace(F.trim(F.coalesce(marker, F.lit(""))), r"^\[\s*|\s*\]$", ""), F.lit(""))
    bounds = marker_bounds(quote)
    n = m.try_cast("long")
    target = m.isNotNull() & has_marker(quote, m)
    other = m.isNotNull() & F.coalesce(F.exists(bounds, lambda b: (b["lo"] != b["hi"]) | (b["lo"] != n) | n.isNull()), F.lit(False))
    any_ = F.size(bounds) > 0
    norm = norm_title_alnum(quote)
    alias = F.exists(aliases, lambda a: F.contains(norm, a))
    row = lambda status, reason: F.struct(status.alias("status"), F.lit(reason).alias("reason"), target.alias("has_target"), other.alias("has_other"))
    lit = F.lit
    with_marker = F.when(target, row(F.when(other, "valid_grouped").otherwise("valid"), "citation_text_contains_target_marker")).when(any_, row(lit("invalid"), "cited_other_reference_marker")).when(alias, row(lit("valid"), "title_alias_anchor_found")).otherwise(row(lit("invalid"), "target_anchor_missing"))
    without = F.when(alias, row(lit("valid"), "title_alias_anchor_found")).otherwise(row(lit("unknown"), "no_target_reference_marker_available"))
    return F.when(m.isNotNull(), with_marker).otherwise(without)


def is_grouped(text: Column) -> Column:
    """Whether a text cites several works at one place."""
    return F.exists(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[([^\]]+)\]"), F.lit(1)), lambda x: x.rlike(r"\d+\s*[,–—-]\s*\d+"))


# Fixed value: the heading of a reference list, its letters spaced or not.
HEADING = r"(?im)^[ \t]*(?:references|bibliography|r[ \t]*e[ \t]*f[ \t]*e[ \t]*r[ \t]*e[ \t]*n[ \t]*c[ \t]*e[ \t]*s)[ \t]*$"


def body_and_references(text: Column) -> Column:
    """struct(body, refs): a text before and after its references heading; without one all is body."""
    parts = F.split(F.coalesce(text, F.lit("")), HEADING, 2)
    return F.struct(parts[0].alias("body"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("refs"))


# Where a numbered entry begins, and its number, digits spaced or not.
ENTRY_BEGIN = r"(?md)(?=^[ \t]*\[[ \t]*\d(?:[ \t]*\d)*[ \t]*\]|\f[ \t]*\[[ \t]*\d(?:[ \t]*\d)*[ \t]*\])"
ENTRY_NUMBER = r"^\f?[ \t]*\[[ \t]*(\d(?:[ \t]*\d)*)[ \t]*\]"
#: Entries that follow each other by no more than STEP make a run, which tells a reference list from RUN entries on.
STEP, RUN = 3, 3


# Cues of a bibliographic entry.
BIBLIOGRAPHIC_CUES = [
    r"\b(?:19|20)\d{2}\b",
    r"(?i)\b(?:doi|vol\.?|no\.?|pp?\.?|proc\.?|proceedings|journal|transactions?|conference|symposium|workshop|ieee|acm)\b",
    r"[“\"].{8,}[”\"]",
    r"^\s*\[\s*\d+\s*\]\s+[A-Z][.\w-]*(?:\s+[A-Z][.\w-]*)*,",
]


def is_bibliographic(entry: Column) -> Column:
    """Two of four cues in 1800 characters at most: a year, a venue word, a quoted title, an author's name after the marker."""
    t = F.trim(F.regexp_replace(F.substring(F.coalesce(entry, F.lit("")), 1, 2500), r"\s+", " "))
    n = sum((t.rlike(x).cast("int") for x in BIBLIOGRAPHIC_CUES), F.lit(0))
    return (t != "") & (F.length(t) <= 1800) & (n >= 2)


def numbered_entries(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, start, marker, entry: each text cut where a line begins with a number in brackets; start counts characters before."""
    pieces = texts.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), ENTRY_BEGIN)).alias("pos", "entry"))
    marker = F.regexp_replace(F.regexp_extract("entry", ENTRY_NUMBER, 1), r"\s", "")
    # of what is no entry only the length travels
    pieces = pieces.select(key, "pos", marker.alias("marker"), F.length("entry").alias("chars"), "entry").withColumn("entry", F.when(F.col("marker") != "", F.col("entry")))
    before = F.sum("chars").over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return pieces.select(key, "pos", F.coalesce(before, F.lit(0)).alias("start"), "marker", "entry").where("marker <> ''")


def _unheaded_lists(texts: DataFrame, key: str, text: str) -> DataFrame:
    """The entries of the reference lists of texts without a heading: of those that read like bibliography, the last run of RUN or more. A run is an island among the gaps between numbers."""
    entries = numbered_entries(texts.where(~F.coalesce(text, F.lit("")).rlike(HEADING)), key, text).where(is_bibliographic(F.col("entry")))
    order = Window.partitionBy(key).orderBy("pos")
    step = F.col("marker").try_cast("decimal(38,0)") - F.lag(F.col("marker").try_cast("decimal(38,0)")).over(order)
    entries = entries.withColumn("gap", F.when(step.between(1, STEP), 0).otherwise(1)).withColumn("run", F.sum("gap").over(order))
    entries = entries.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(key, "run"))).where(F.col("size") >= RUN)
    return entries.withColumn("last", F.max("run").over(Window.partitionBy(key))).where("run = last").select(key, "pos", "start", "marker", "entry")


def headed_chars(text: Column) -> Column:
    """How many characters of a text come before the heading of its references; without one, all."""
    return F.length(F.split(F.coalesce(text, F.lit("")), HEADING, 2)[0])


def listed_starts(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, listed: where the reference list of a text without a heading begins. Texts without such a list have no row."""
    return _unheaded_lists(texts, key, text).groupBy(key).agg(F.min("start").alias("listed"))


def body_ends(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, body_end: how many characters of a text come before its references: before their heading; without one, before the last run of numbered entries that read like bibliography; without these, all."""
    headed = texts.select(key, headed_chars(F.col(text)).alias("body"))
    return headed.join(listed_starts(texts, key, text).withColumnRenamed(key, "__key"), F.col(key) == F.col("__key"), "left").select(key, F.least("body", "listed").cast("int").alias("body_end"))


def reference_entries(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, marker, entry of the numbered entries below the references heading, or of the list of a text without one (see body_ends); of a repeated marker the last entry counts."""
    refs = texts.select(key, body_and_references(F.col(text))["refs"].alias("refs"))
    rows = numbered_entries(refs, key, "refs").unionByName(_unheaded_lists(texts, key, text))
    return rows.groupBy(key, "marker").agg(F.max_by("entry", "pos").alias("entry")).select(key, "marker", F.trim(F.regexp_replace("entry", r"\s+", " ")).alias("entry"))


def resolve_targets(entries: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, marker, method, score of the entry that is a document's target: DOI 1.0, title 0.98, title without spaces 0.96, shared title words; below 0.65 none.

    targets: key, title, doi, author (last name). The first entry, by marker, wins ties."""
    t = targets.select(F.col(key).alias("t_key"), norm_title_alnum(F.col("title")).alias("tt"), norm_title_alnum(F.col("doi")).alias("td"), norm_title_alnum(F.col("author")).alias("ta"))
    rows = entries.join(t, F.col(key) == F.col("t_key")).withColumn("e", norm_title_alnum(F.col("entry")))
    flat = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    words = F.array_distinct(F.filter(F.split("tt", " "), lambda w: F.length(w) >= 4))
    overlap = F.when(F.size(words) > 0, F.size(F.array_intersect(words, F.split("e", " "))) / F.size(words)).otherwise(0.0)
    author = (F.col("ta") != "") & F.array_contains(F.split("e", " "), F.col("ta"))
    row = lambda m, s: F.struct(F.lit(m).alias("method"), s.alias("score"))
    found = (
        F.when((F.col("td") != "") & F.contains("e", F.col("td")), row("doi_exact", F.lit(1.0)))
        .when((F.col("tt") != "") & F.contains("e", F.col("tt")), row("title_exact", F.lit(0.98)))
        .when((F.length(flat("tt")) >= 8) & F.contains(flat("e"), flat("tt")), row("title_exact", F.lit(0.96)))
        .when(overlap >= 0.75, row("title_overlap", F.lit(0.98)))
        .when((overlap >= 0.55) & author, row("title_author_overlap", F.lit(0.75)))
    )
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("m.score"), F.col("marker").cast("int")))
    return rows.withColumn("m", found).where("m.score >= 0.65").withColumn("rank", rank).where("rank = 1").select(key, "marker", "m.method", "m.score")


def body_author(text: Column, marker: Column) -> Column:
    """The capitalised name before the last [marker]; empty for words such as Table and for capitals only."""
    pattern = F.concat(F.lit(r"\b([A-Z][A-Za-z'’-]+)(?:\s+et\s+al\.?)?\s*\["), marker, F.lit(r"\]"))
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), pattern, F.lit(1))
    name = F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))
    common = F.lower(name).isin("figure", "method", "paper", "reference", "section", "system", "table", "work")
    return F.when(common | (name == F.upper(name)), F.lit("")).otherwise(name)


def entry_author(entry: Column) -> Column:
    """The last name of an entry's first author."""
    plain = F.trim(F.regexp_replace(F.coalesce(entry, F.lit("")), r"^\s*\[\d+\]\s*", ""))
    head = F.split(plain, r"(?i),|\bet\s+al\.?")[0]
    names = F.filter(F.regexp_extract_all(head, F.lit(r"\b([A-Z][A-Za-z'’-]+|[A-Z]\.)"), F.lit(1)), lambda x: F.length(F.rtrim(x, F.lit("."))) > 1)
    return F.coalesce(F.try_element_at(names, F.lit(-1)), F.lit(""))


def is_reference_entry(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    n = norm_title_alnum(t)
    return t.rlike(r"^\s*\[\d+\]") & n.rlike(r"\b(19|20)\d{2}\b") & n.rlike(r"\b(proc|conference|journal|vol|pp|doi|arxiv|isbn)\b")


#: Quotes are sought by probes of so many characters.
PROBE_CHARS = 24
#: So many probes are looked for in a text at once; they are dealt to groups of this size.
PROBES_AT_ONCE = 50_000


def quote_location(quotes: DataFrame, texts: DataFrame, probe: int = PROBE_CHARS) -> DataFrame:
    """item_id, doc_id, start (from 0) of the first place of exact quotes (item_id, text) in texts (doc_id, text). Blank quotes are not sought; any other length is.

    A quote is nominated by its first `probe` characters, all of them if it has fewer. Groups of probes, of bounded size, go to every text as one automaton; only hits
    are shuffled, and only they meet the whole quote."""
    q = quotes.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("item_id", F.col("text").alias("quote"), F.substring("text", 1, probe).alias("probe"))
    probes = q.select("probe").distinct()
    groups = max(1, -(-probes.count() // PROBES_AT_ONCE))
    own = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hits = None
    for g in range(groups):  # one pass over the texts for each group: the number of groups is that of the quotes over a constant
        part = probes.where(F.pmod(F.xxhash64("probe"), F.lit(groups)) == g)
        shared = texts.sparkSession.sparkContext.broadcast([r[0] for r in part.toLocalIterator()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            seek = ahocorasick.Automaton()
            for p in shared.value:
                seek.add_word(p, p)
            seek.make_automaton()
            for b in batches:
                rows = [(k, p) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for p in {p for _, p in seek.iter(t)}] if len(seek) else []
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], b.schema[0].type), pa.array([p for _, p in rows], pa.string())], ["d", "found"])

        found = own.mapInArrow(run, f"d {own.schema[0].dataType.simpleString()}, found string")
        hits = found if hits is None else hits.unionByName(found)
    met = q.join(hits, F.col("probe") == F.col("found")).select("item_id", "d", "quote")
    return met.join(own, F.col("d") == F.col("doc_id")).select("item_id", "doc_id", (F.instr("text", F.col("quote")) - 1).alias("start")).where("start >= 0")


def ascii_key(x: Column) -> Column:
    """ascii_form() by built-in expressions: accents by a table, words joined over line ends, spaced letters closed up, lower case, alphanumeric."""
    t = F.regexp_replace(F.replace(unaccented(F.coalesce(x, F.lit(""))), F.lit("-\n"), F.lit("")), r"\n", " ")
    # of three letters or more that stand alone, the blank before the last one, then those before others
    gap = r"(?<=(?<![A-Za-z])[A-Za-z][ \t]{1,9}[A-Za-z])[ \t]+(?=[A-Za-z](?![A-Za-z]))|(?<=(?<![A-Za-z])[A-Za-z])[ \t]+(?=[A-Za-z][ \t]+[A-Za-z](?![A-Za-z]))"
    return norm_title_alnum(F.regexp_replace(t, gap, ""))


def ascii_form(value: str) -> str:
    """Letters without accents, words joined over line ends and spaced letters closed up, lower case, alphanumeric."""
    text = unicodedata.normalize("NFKD", value or "").encode("ascii", "ignore").decode().replace("-\n", "").replace("\n", " ")
    closed = re.compile(r"(?<![A-Za-z])(?:[A-Za-z][ \t]+){2,}[A-Za-z](?![A-Za-z])").sub(lambda m: "".join(m.group().split()), text)
    return " ".join(re.findall("[a-z0-9]+", closed.lower()))


def biblio_form(value: str) -> str:
    """Compatible characters, no entry number, soft hyphens or dashes, alphanumeric, lower case."""
    text = re.sub(r"^\s*\[\d+\]\s*", "", unicodedata.normalize("NFKC", value or "")).replace("­", "")
    text = re.sub("[‐-―]", "-", text).casefold()
    return " ".join(re.findall(r"[^\W_]+", text))


def normal_forms(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, ascii_form, biblio_form: normal forms that no built-in expression has, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches):
            values = b.column(1).to_pylist()
            forms = [pa.array([form(x) for x in values], pa.string()) for form in (ascii_form, biblio_form)]
            yield pa.RecordBatch.from_arrays([b.column(0), *forms], [key, "ascii_form", "biblio_form"])

    return texts.select(F.col(key).cast("long").alias(key), F.coalesce(text, F.lit("")).alias("t")).mapInArrow(run, f"{key} long, ascii_form string, biblio_form string")
