"""Column functions over titles, people, venues and dates in text."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_title_ws(x: Column) -> Column:
    """Lower case, runs of white space as one space; punctuation stays. Also the normal form of names."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"(?U)\s+", " "))


def norm_title_alnum(x: Column) -> Column:
    """Lower case, everything but ASCII letters and digits as one space. Titles in other scripts become empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " "))


@lru_cache(maxsize=1)
def _plain_letters() -> tuple[str, str]:
    """Characters whose compatible form without combining marks is one ASCII character, and these."""
    pairs = []
    for ch in map(chr, (*range(0x80, 0xD800), *range(0xF900, 0x10000))):
        form = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if len(form) == 1 and form.isascii():
            pairs.append((ch, form))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def unaccented(x: Column) -> Column:
    """Letters without accents and other marks, full-width and styled letters as plain ones. A built-in expression: characters that stand for several letters, such as ligatures, stay."""
    return F.regexp_replace(F.translate(x, *_plain_letters()), r"\p{M}", "")


# Typographic marks and their plain forms.
MARKS, PLAIN_MARKS = "’‘´`“”–— ", "''''\"\"-- "


def plain_characters(x: Column) -> Column:
    """Letters without accents, typographic quotes and dashes as plain ones, lower case: character by character, so that places stay what they are."""
    letters, plain = _plain_letters()
    return F.lower(F.when(F.octet_length(x) == F.length(x), F.replace(x, F.lit("`"), F.lit("'"))).otherwise(F.translate(x, MARKS + letters, PLAIN_MARKS + plain)))


#: The characters of a quote's key, and those read for it at first. The latter don't change it.
KEY_CHARS, KEY_READ = 220, 400


def canonical_quote_key(x: Column) -> Column:
    """The key under which quotes count as one: without accents, alphanumeric, 220 characters at most. The normal form goes character by character, so a text's beginning gives the key where that has enough of them."""
    whole = lambda t: norm_title_alnum(unaccented(F.coalesce(t, F.lit(""))))
    # the beginning's form is made once: a list of one
    key = F.transform(F.array(whole(F.substring(x, 1, KEY_READ))), lambda begin: F.when((F.length(begin) < KEY_CHARS) & (F.length(x) > KEY_READ), whole(x)).otherwise(begin))
    return F.substring(F.get(key, F.lit(0)), 1, KEY_CHARS)


def author_list(x: Column) -> Column:
    """Names parted by semicolon, comma or the word and; null and empty texts have none."""
    parts = F.split(F.coalesce(x, F.lit("")), r";|,|\band\b")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def year_in_text(x: Column) -> Column:
    """The first year of 1900 to 2099 in a text, else null."""
    return F.regexp_extract(F.coalesce(x, F.lit("")), r"(?:19|20)\d{2}", 0).try_cast("int")


def venue_tier(x: Column) -> Column:
    """A, B, C or unknown, by plain substrings: a signature counts as nature."""
    v = F.lower(F.coalesce(x, F.lit("")))
    return (
        F.when(v.contains("science") | v.contains("nature"), "A")
        .when(v.contains("journal") | v.contains("proceedings"), "B")
        .when(v != "", "C")
        .otherwise("unknown")
    )


def provider_name(x: Column) -> Column:
    """The kind of import that a source names."""
    return F.when(F.lower(F.coalesce(x, F.lit(""))).rlike("google|scholar|publish"), "google_scholar_import").otherwise("external_import")


def citing_paper_info(x: Column) -> Column:
    """"[Venue 'YY Type] Title." as struct(title, venue, year, type)."""
    text = F.trim(F.coalesce(x, F.lit("")))
    inner = F.regexp_extract(text, r"^\[([^\]]*)\]", 1)
    title = F.rtrim(F.trim(F.regexp_replace(text, r"^\[[^\]]*\]", "")), F.lit("."))
    part = lambda i: F.trim(F.regexp_extract(inner, r"^(.*?)'(\d{2})\s*(.*)$", i))
    dated = inner.rlike(r"'\d{2}")
    return F.struct(
        title.alias("title"),
        F.when(dated, part(1)).otherwise(F.trim(inner)).alias("venue"),
        F.when(dated, F.concat(F.lit("20"), part(2)).try_cast("int")).alias("year"),
        F.when(dated, part(3)).otherwise("").alias("type"),
    )


def filename_title(x: Column) -> Column:
    """A file name without extension, DOI and arXiv id, separators as spaces; null where nothing is left."""
    stem = F.regexp_replace(x, r"\.[A-Za-z0-9]{1,5}$", "")
    plain = F.regexp_replace(F.regexp_replace(stem, r"10\.\d{4,9}[._-]+[A-Za-z0-9._-]+", " "), r"(?i)(?:arxiv[_\s-]*)?(?<![\d.])\d{4}\.\d{4,5}(?:v\d+)?", " ")
    return F.nullif(F.trim(F.regexp_replace(plain, r"[_\s-]+", " ")), F.lit(""))


def detected_title(text: Column) -> Column:
    """The first of 20 lines with 12 characters or more, cut at 300; empty without one."""
    lines = F.transform(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 20), lambda x: F.trim(x))
    return F.coalesce(F.substring(F.try_element_at(F.filter(lines, lambda x: F.length(x) >= 12), F.lit(1)), 1, 300), F.lit(""))


def json_list(x: Column) -> Column:
    """A JSON list of strings; anything else counts as an empty list."""
    return F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))


def highlight_keywords(words: Column, quote: Column) -> Column:
    """The words that a quote holds, white space normalised, each spelling once whatever its case."""
    low = F.lower(F.regexp_replace(F.coalesce(quote, F.lit("")), r"\s+", " "))
    clean = F.filter(F.transform(words, lambda w: F.trim(F.regexp_replace(w, r"\s+", " "))), lambda w: (w != "") & F.contains(low, F.lower(w)))
    fresh = lambda seen, w: F.when(F.exists(seen, lambda s: F.lower(s) == F.lower(w)), seen).otherwise(F.concat(seen, F.array(w)))
    return F.aggregate(clean, F.array().cast("array<string>"), fresh)


def redacted(x: Column) -> Column:
    """Secrets masked: key assignments, bearer tokens and sk- keys."""
    out = F.regexp_replace(x, r"(?i)\b(api[_-]?key|token|secret|password)\s*[:=]\s*\S+", "$1=[redacted]")
    out = F.regexp_replace(out, r"(?i)bearer\s+[A-Za-z0-9._-]+", "Bearer [redacted]")
    return F.regexp_replace(out, r"\bsk-[A-Za-z0-9_-]{8,}", "[redacted]")


def precision_phrases(x: Column, most: int = 8) -> Column:
    """Phrases that carry figures: numbers with a unit of comparison, distinct whatever their case."""
    found = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"\d+(?:\.\d+)?\s?(?:%|percent|times|x|ms|points)"), F.lit(0))
    fresh = lambda seen, w: F.when(F.exists(seen, lambda s: F.lower(s) == F.lower(w)), seen).otherwise(F.concat(seen, F.array(w)))
    return F.slice(F.aggregate(found, F.array().cast("array<string>"), fresh), 1, most)


# Labels of the older vocabulary and the evidence types they stand for.
EVIDENCE_LABELS = {
    "first": "first_or_seminal_claim",
    "comparison": "detailed_comparison",
    "baseline": "baseline_or_benchmark",
    "method": "method_foundation",
    "theory": "theoretical_foundation",
    "application": "application_extension",
    "positive": "positive_evaluation",
    "limitation": "limitation_or_negative",
}


def evidence_label(x: Column) -> Column:
    """An older label's evidence type; other texts stand for themselves, lower case with underscores."""
    key = F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), r"[\s-]+", "_")
    table = F.create_map(*(F.lit(v) for pair in EVIDENCE_LABELS.items() for v in pair))
    return F.coalesce(table[key], F.nullif(key, F.lit("")), F.lit("background"))


def confidence(x: Column) -> Column:
    """A number from 0 to 1; texts that are none count as 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x.try_cast("double"), F.lit(0.0))))
