"""Column functions over titles, identifiers, names and markup. All stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Small words that carry no content in a title.
STOP_WORDS = ["a", "an", "the", "of", "in", "for", "and", "or", "is", "to", "by", "on", "at", "its", "with", "from", "that", "this", "not", "are", "was", "as", "it", "be", "into", "via", "but"]
#: Words that mark a sentence as a finding.
FINDING_WORDS = [
    "showed", "demonstrated", "found", "identified", "reveal", "required", "increased", "decreased", "reduced", "enhanced", "suppressed", "activated", "inhibited", "suggest", "indicate", "conclude",
    "significantly", "potently", "robustly", "unexpectedly",
]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """NULL for empty and blank strings."""
    return F.when(_c(c).rlike(r"\S"), _c(c))


def doi_slug(doi: Column | str, pmid: Column | str) -> Column:
    """File-safe id of a paper: the DOI with '/' as '_' and '.' as '-', else pmid_<number>; NULL without either."""
    return F.coalesce(F.translate(blank_to_null(doi), "/.", "_-"), F.concat(F.lit("pmid_"), blank_to_null(pmid)))


def bare_title(c: Column | str) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]", "")


def title_key(c: Column | str, width: int = 80) -> Column:
    """Lower case, other signs as single blanks, cut at ``width``."""
    t = F.regexp_replace(F.lower(_c(c)), r"[^\p{L}\p{N}_\s]", " ")
    return F.substring(F.trim(F.regexp_replace(t, r"\s+", " ")), 1, width)


def slugify(c: Column | str) -> Column:
    """URL part: lower case, blanks as '-', no other signs, no leading or trailing '-'."""
    t = F.regexp_replace(F.lower(_c(c)), r"[^a-z0-9\s-]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+", "-"), "-+", "-")
    return F.regexp_replace(t, "^-|-$", "")


def file_key(c: Column | str) -> Column:
    """Name under which an index path and a file name meet: '_-_' and '_' become '-', doubled '-' one."""
    t = F.regexp_replace(F.regexp_replace(F.lower(_c(c)), "_-_", "-"), "_", "-")
    return F.regexp_replace(t, "-{2,}", "-")


def pmid_digits(c: Column | str) -> Column:
    """Digits of a PubMed number in any notation, without leading zeros; NULL for placeholders."""
    d = F.regexp_extract(F.trim(_c(c)), r"([0-9]+)(?:\.0*)?[^0-9]*$", 1)
    return F.nullif(F.regexp_replace(d, "^0+", ""), F.lit(""))


def doi_key(c: Column | str) -> Column:
    """Canonical DOI: without resolver and closing marks, lower case; NULL for placeholders."""
    d = F.regexp_extract(F.lower(F.regexp_replace(_c(c), "(?i)%2f", "/")), r"(10\.[0-9]{4,}/[^\s]+)", 1)
    return F.nullif(F.regexp_replace(d, r"[.,;)]+$", ""), F.lit(""))


def is_preprint_doi(c: Column | str, prefixes: list[str]) -> Column:
    """Does the DOI belong to a preprint server's registrant?"""
    return F.coalesce(F.regexp_extract(doi_key(c), r"^10\.([0-9]+)/", 1).isin(prefixes), F.lit(False))


def author_line(authors: Column | str, most: int = 3) -> Column:
    """The first authors, 'et al.' for the rest; NULL for none."""
    a = F.filter(_c(authors), lambda x: x.rlike(r"\S"))
    shown = F.array_join(F.slice(a, 1, most), ", ")
    return F.when(F.size(a) > most, F.concat(shown, F.lit(" et al."))).when(F.size(a) > 0, shown)


def first_author_last(authors: Column | str) -> Column:
    """Surname of the first author: before a comma; first word if the last is initials; else the last word."""
    n = F.trim(F.get(F.filter(_c(authors), lambda x: x.rlike(r"\S")), F.lit(0)))
    w = F.split(n, r"\s+")
    last = F.element_at(w, -1)
    return F.when(n.contains(","), F.trim(F.substring_index(n, ",", 1))).when(last.rlike(r"^[A-Z]{1,4}$") & (F.size(w) > 1), F.element_at(w, 1)).otherwise(last)


def display_name(c: Column | str) -> Column:
    """'LAST, FIRST' as 'First Last', capital letters at word starts (after hyphens too)."""
    p = F.split(_c(c), ",", 2)
    n = F.when(F.size(p) == 2, F.concat_ws(" ", F.trim(p[1]), F.trim(p[0]))).otherwise(F.trim(_c(c)))
    words = F.split(F.lower(F.regexp_replace(n, r"\s+", " ")), " ")
    cap = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1000))
    return F.array_join(F.transform(words, lambda w: F.array_join(F.transform(F.split(w, "-"), cap), "-")), " ")


def content_words(c: Column | str) -> Column:
    """Distinct words of two and more letters, bounded on both sides, that are not small words."""
    words = F.split(F.lower(_c(c)), r"[^\p{L}\p{N}_]+")
    return F.filter(F.array_distinct(words), lambda w: w.rlike("^[a-z]{2,}$") & ~w.isin(STOP_WORDS))


def word_overlap(a: Column, b: Column) -> Column:
    """Shared words over the larger of two word sets; 0 when either is empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.greatest(F.size(a), F.size(b)), F.lit(0)), F.lit(0.0))


def strip_tags(c: Column | str) -> Column:
    """Text without tags; the three basic entities and non-breaking blanks resolved; white space collapsed."""
    t = F.regexp_replace(_c(c), r"<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


#: Tags that pass the sanitiser.
SAFE_TAGS = ["h4", "p", "ul", "li"]


def sanitize(c: Column | str) -> Column:
    """Comments and all tags but bare h4, p, ul and li are dropped, the text stays."""
    t = F.regexp_replace(_c(c), r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?i)<(/?)(h4|p|ul|li)(?:\s[^>]*)?/?>", "\u0001$1$2\u0002")
    t = F.regexp_replace(t, r"<[/!?a-zA-Z][^>]*>", "")
    for tag in SAFE_TAGS:
        t = F.regexp_replace(t, f"(?i)\u0001(/?){tag}\u0002", f"<$1{tag}>")
    return F.coalesce(t, F.lit(""))


def cut_with_dots(c: Column | str, most: int = 130) -> Column:
    """At most ``most`` characters, a cut shown by three dots."""
    return F.when(F.length(_c(c)) > most, F.concat(F.substring(_c(c), 1, most - 3), F.lit("..."))).otherwise(_c(c))


def word_count(c: Column | str) -> Column:
    return F.size(F.filter(F.split(F.coalesce(_c(c), F.lit("")), r"\s+"), lambda w: w != ""))


def findings(c: Column | str, top: int = 4, least: int = 40) -> Column:
    """The ``top`` sentences above ``least`` characters with most finding words, in their order in the text."""
    s = F.filter(F.transform(F.split(_c(c), r"(?<=[.!?])\s+"), F.trim), lambda x: F.length(x) > least)
    hits = lambda x: F.size(F.filter(F.split(F.lower(x), r"\s+"), lambda w: w.isin(FINDING_WORDS)))
    scored = F.transform(s, lambda x, i: F.struct((-hits(x)).alias("k"), i.alias("i"), x.alias("s")))
    best = F.slice(F.array_sort(scored), 1, top)
    return F.transform(F.array_sort(F.transform(best, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))), lambda x: x["s"])


def keyword_hit(text: Column, keyword: str) -> Column:
    """Case-blind match; a leading '~' asks for whole words."""
    if keyword.startswith("~"):
        return F.coalesce(F.lower(text).rlike(r"\b\Q" + keyword[1:].lower() + r"\E\b"), F.lit(False))
    return F.coalesce(F.lower(text).contains(keyword.lower()), F.lit(False))


def fiscal_year(d: Column | str) -> Column:
    """The fiscal year starts in October."""
    return (F.year(_c(d)) + (F.month(_c(d)) >= 10).cast("int")).cast("int")


def iso_week(d: Column | str) -> Column:
    """ISO week label, with the year the week belongs to."""
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), _c(d)).cast("int"), F.weekofyear(_c(d)))
