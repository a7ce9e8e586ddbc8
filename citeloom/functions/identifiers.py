"""Column functions over DOIs, arXiv ids, work ids and publisher addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doi_plain(x: Column) -> Column:
    """A DOI without resolver prefix, case kept; null counts as empty."""
    return F.trim(F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), r"(?i)^(https?://doi\.org/|doi:)", ""))


def doi_key(x: Column) -> Column:
    """The form in which DOIs are compared: lower case, null where empty."""
    return F.nullif(F.lower(doi_plain(x)), F.lit(""))


def doi_in_text(x: Column) -> Column:
    """The first DOI in a text, lower case, without closing punctuation; null without one."""
    found = F.regexp_extract(F.coalesce(x, F.lit("")), r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+", 0)
    return F.nullif(F.lower(F.regexp_replace(found, r"[.,;)]+$", "")), F.lit(""))


def doi_in_filename(x: Column) -> Column:
    """10.1145_3494975 as 10.1145/3494975: of an underscored suffix the second part joins the first only where that has no dot."""
    stem = F.regexp_replace(x, r"\.[A-Za-z][A-Za-z0-9]{1,4}$", "")
    pattern = r"(10\.\d{4,9})[._-]+([A-Za-z0-9][A-Za-z0-9._-]*)"
    head, tail = F.regexp_extract(stem, pattern, 1), F.regexp_replace(F.regexp_extract(stem, pattern, 2), "^[._-]+|[._-]+$", "")
    parts = F.split(tail, "_")
    suffix = F.when((F.size(parts) > 1) & ~parts[0].contains("."), F.concat(parts[0], F.lit("."), F.try_element_at(parts, F.lit(2)))).otherwise(parts[0])
    return F.when((head != "") & (tail != ""), F.lower(F.concat(head, F.lit("/"), suffix)))


NEW_ARXIV = r"^\d{2}(?:0[1-9]|1[0-2])\.\d{4,5}(?:v\d+)?$"
OLD_ARXIV = r"^[a-z][a-z0-9-]*(?:\.[a-z]{2})?/\d{7}(?:v\d+)?$"


def arxiv_valid(x: Column) -> Column:
    """An arXiv id whose whole text is valid, prefixes and .pdf taken off; else null."""
    v = F.trim(F.coalesce(x, F.lit("")))
    for prefix in (r"(?i)^arxiv\s*:\s*", r"(?i)^10\.48550/arxiv\.", r"(?i)\.pdf$", r"^[/.,;()\[\]{}]+|[/.,;()\[\]{}]+$"):
        v = F.regexp_replace(v, prefix, "")
    return F.when(v.rlike("(?i)" + NEW_ARXIV) | v.rlike("(?i)" + OLD_ARXIV), v)


def arxiv_in(x: Column, bare: bool = False) -> Column:
    """The arXiv id that an address, DOI or prefix names; bare ids count on demand, where no other DOI stands."""
    v = F.trim(F.coalesce(x, F.lit("")))
    path = F.regexp_extract(v, r"(?i)^https?://(?:www\.|export\.)?arxiv\.org/(?:abs/|pdf/)?([^?#]*)", 1)
    named = F.coalesce(F.nullif(F.regexp_extract(v, r"(?i)10\.48550/arxiv\.([^\s?#]+)", 1), F.lit("")), F.nullif(F.regexp_extract(v, r"(?i)\barxiv\s*:\s*([^\s,;?#]+)", 1), F.lit("")))
    out = F.when(path != "", arxiv_valid(path)).when(named.isNotNull(), arxiv_valid(named))
    if bare:
        loose = F.nullif(F.regexp_extract(v, r"(?:^|[^\d.])(\d{4}\.\d{4,5}(?:v\d+)?)(?:[^\d.]|\.[A-Za-z]|$)", 1), F.lit(""))
        out = out.when(~v.rlike(r"(?i)\b10\.\d{4,9}/"), arxiv_valid(loose))
    return out


#: Source, publisher, DOI prefix, host, in the order in which they are tried after arXiv.
PUBLISHERS = (
    ("acm_dl", "ACM Digital Library", "10.1145/", "dl.acm.org"),
    ("ieee_xplore", "IEEE Xplore", "10.1109/", "ieeexplore.ieee.org"),
    ("springer", "Springer", "10.1007/", "link.springer.com"),
    ("elsevier", "Elsevier / ScienceDirect", "10.1016/", "sciencedirect.com"),
    ("usenix", "USENIX", None, "usenix.org"),
    ("openreview", "OpenReview", None, "openreview.net"),
)


def publisher(doi: Column, url: Column) -> Column:
    """struct(source, publisher, landing_url, fallback_url) of a work, by DOI prefix or host."""
    link = F.trim(F.coalesce(url, F.lit("")))
    low = F.lower(link)
    own = doi_plain(doi)
    own = F.when(own != "", own).otherwise(F.regexp_extract(link, r"(?i)^https?://doi\.org/(.*)$", 1))
    key = F.lower(own)
    fallback = F.when(own != "", F.concat(F.lit("https://doi.org/"), own)).otherwise("")
    row = lambda source, name, landing: F.struct(F.lit(source).alias("source"), F.lit(name).alias("publisher"), landing.alias("landing_url"), fallback.alias("fallback_url"))
    either = F.when(link != "", link).otherwise(fallback)
    out = F.when(key.startswith("10.48550/arxiv.") | arxiv_in(link).isNotNull(), row("arxiv", "arXiv", either))
    for source, name, prefix, host in PUBLISHERS:
        hit, landing = low.contains(host), F.when(low.contains(host), link).otherwise(fallback)
        if prefix:
            hit = hit | key.startswith(prefix)
        if source in ("acm_dl", "ieee_xplore"):
            hit = hit | low.contains(prefix)
        if source == "acm_dl":
            landing = F.when(low.contains(host), link).otherwise(F.concat(F.lit("https://dl.acm.org/doi/"), own))
        out = out.when(hit, row(source, name, landing))
    return out.otherwise(row("publisher", "Publisher", either))


def publisher_short_name(*texts: Column) -> Column:
    """ACM, IEEE, Springer, Elsevier or empty, from DOI, venue and provider texts together."""
    v = F.lower(F.concat_ws(" ", *texts))
    return (
        F.when(v.contains("10.1145") | v.contains("acm"), "ACM")
        .when(v.contains("10.1109") | v.contains("ieee"), "IEEE")
        .when(v.contains("springer"), "Springer")
        .when(v.contains("elsevier"), "Elsevier")
        .otherwise("")
    )


def source_name(url: Column, fallback: Column) -> Column:
    """The name of the site that an address leads to."""
    v = F.lower(F.coalesce(url, F.lit("")))
    return (
        F.when(v.contains("dl.acm.org") | v.contains("10.1145"), "ACM Digital Library")
        .when(v.contains("ieeexplore.ieee.org") | v.contains("10.1109"), "IEEE Xplore")
        .when(v.contains("arxiv.org"), "arXiv")
        .when(v.contains("semanticscholar.org"), "Semantic Scholar")
        .when(v.contains("openalex.org"), "OpenAlex OA")
        .when(v.contains("doi.org"), "DOI")
        .otherwise(F.coalesce(F.nullif(fallback, F.lit("")), F.lit("Unknown")))
    )


def url_type(url: Column, declared: Column) -> Column:
    """declared where given, else direct_pdf, metadata_page or landing_page by the address."""
    v = F.lower(F.coalesce(url, F.lit("")))
    path = F.regexp_replace(v, r"[?#].*$", "")
    return (
        F.when(F.coalesce(declared, F.lit("")) != "", declared)
        .when(path.endswith(".pdf") | path.contains("/pdf/"), "direct_pdf")
        .when(v.contains("openalex.org") | v.contains("semanticscholar.org") | v.contains("scholar.google."), "metadata_page")
        .otherwise("landing_page")
    )


def restricted_publisher(*texts: Column) -> Column:
    """Whether a link leads to a publisher that mostly asks for a login."""
    return F.lower(F.concat_ws(" ", *texts)).rlike(r"dl\.acm\.org|ieeexplore|sciencedirect|link\.springer|10\.1145/|10\.1109/|10\.1016/|10\.1007/")


def work_id(x: Column) -> Column:
    """W and digits, from an address or alone; null otherwise."""
    return F.nullif(F.upper(F.regexp_extract(F.trim(F.coalesce(x, F.lit(""))), r"(?i)(?:^|/)(W\d+)$", 1)), F.lit(""))


def author_page_id(x: Column) -> Column:
    """The person id of an author page (two path parts), from an address or a prefixed text; null where it is malformed."""
    v = F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), r"(?i)^https?://[^/]+/pid/|^pid:|^pid/", "")
    v = F.regexp_replace(v, r"(?i)\.(html|xml)$", "")
    return F.when(v.rlike(r"^[a-z0-9]+/[A-Za-z0-9-]+$"), v)


def best_open_location(places: Column) -> Column:
    """Of locations (is_open, pdf_url, landing_url) the first open one with a PDF, else the first open one."""
    open_ = F.filter(places, lambda p: p["is_open"])
    return F.coalesce(F.try_element_at(F.filter(open_, lambda p: F.coalesce(p["pdf_url"], F.lit("")) != ""), F.lit(1)), F.try_element_at(open_, F.lit(1)))
