"""Column functions that describe papers: file names, citations, journals, checks of titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, first_author_last

#: Patterns of lines that a converter takes for a title by mistake.
JUNK_TITLES = [
    r"^research\s+article", r"^original\s+article", r"^review\s+article", r"^techniques\s+and\s+resources", r"^basic\s+science", r"^brief\s+communication", r"^short\s+communication", r"^letter\s+to\s+the\s+editor",
    r"^editorial", r"^commentary", r"^perspective", r"^open\s+access", r"^clinical\s*[-–]\s*", r"^glyph", r"^\*?for\s+correspondence", r"^https?://", r"^doi:",
]
#: Subject terms too general to tell papers apart.
GENERIC_TERMS = [
    "Animals", "Mice", "Rats", "Humans", "Male", "Female", "Adult", "Middle Aged", "Aged", "Young Adult", "Adolescent", "Child", "Infant", "Mice, Inbred C57BL", "Mice, Knockout", "Mice, Transgenic", "Disease Models, Animal",
    "Rats, Sprague-Dawley", "Rats, Wistar", "Cells, Cultured", "Random Allocation", "Time Factors", "Body Weight", "Body Mass Index", "Dose-Response Relationship, Drug",
]
#: Beginnings of journal names, in the order they are tried, and their short forms.
SHORT_JOURNALS = [
    ("cell metabolism", "Cell Metab"), ("the journal of clinical investigation", "JCI"), ("journal of clinical investigation", "JCI"), ("nature communications", "Nat Commun"), ("nature metabolism", "Nat Metab"), ("cell reports", "Cell Rep"),
    ("endocrinology", "Endocrinology"), ("scientific reports", "Sci Rep"), ("diabetes", "Diabetes"), ("obesity", "Obesity"), ("molecular metabolism", "Mol Metab"), ("nutrients", "Nutrients"), ("physiology & behavior", "Physiol Behav"),
    ("annual review of nutrition", "Annu Rev Nutr"), ("proceedings of the national academy of sciences", "PNAS"), ("the journal of neuroscience", "J Neurosci"), ("journal of neuroscience", "J Neurosci"), ("neuropharmacology", "Neuropharmacol"),
    ("american journal of physiology", "Am J Physiol"), ("metabolism", "Metabolism"), ("plos one", "PLoS ONE"), ("elife", "eLife"), ("nature", "Nature"), ("cell", "Cell"), ("nature medicine", "Nat Med"), ("science", "Science"),
    ("appetite", "Appetite"), ("chemical senses", "Chem Senses"),
]


def suspicious_title(c: Column | str) -> Column:
    """Empty, under 15 characters, or beginning like a running head."""
    t = F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    return (F.length(t) < 15) | t.rlike("(?i)" + "|".join(JUNK_TITLES)) | t.contains("GLYPH")


def subject_terms(mesh: Column | str, own: Column | str, most: int = 12) -> Column:
    """Subject headings without the general ones, then own terms not among them but for case, at most ``most``."""
    m = F.array_except(F.coalesce(F.col(mesh) if isinstance(mesh, str) else mesh, F.array().cast("array<string>")), F.array(*(F.lit(x) for x in GENERIC_TERMS)))
    o = F.coalesce(F.col(own) if isinstance(own, str) else own, F.array().cast("array<string>"))
    return F.slice(F.concat(m, F.filter(o, lambda x: ~F.array_contains(F.transform(m, F.lower), F.lower(x)))), 1, most)


def sniff_doi(text: Column | str, within: int = 5000) -> Column:
    """First DOI in the first characters of a text, without closing marks."""
    c = F.col(text) if isinstance(text, str) else text
    return F.nullif(F.regexp_replace(F.regexp_extract(F.substring(c, 1, within), r"(10\.\d{4,}/[^\s]+)", 1), r"[.,;)]+$", ""), F.lit(""))


def initial_dot(fore: Column) -> Column:
    """A fore name that is one or two characters long, or ends in a single letter, gets a dot."""
    return F.when(fore.rlike(r"(?:^.?| )\p{L}$"), F.concat(fore, F.lit("."))).otherwise(fore)


def short_author(name: Column) -> Column:
    """'Jane Ann Doe' as 'J. A. Doe', 'Chen-Yu Yeh' as 'C.-Y. Yeh'; single words stay."""
    w = F.split(F.trim(name), r"\s+")
    one = lambda p: F.array_join(F.transform(F.filter(F.split(p, "-"), lambda s: s != ""), lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.lit("."))), "-")
    given = F.transform(F.filter(F.transform(F.slice(w, 1, F.size(w) - 1), lambda p: F.regexp_replace(p, r"\.+$", "")), lambda p: p != ""), one)
    return F.when(F.size(w) < 2, name).otherwise(F.concat_ws(" ", F.array_join(given, " "), F.element_at(w, -1)))


def safe_file_name(name: Column) -> Column:
    """Stem of a file name without signs, blanks and underscores as one underscore."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(stem, r"[^\p{L}\p{N}_\s.-]", ""), r"[\s_]+", "_"), "^_+|_+$", "")


def index_path(path: Column) -> Column:
    """Path as the index keeps it: '___' as '/', lower case, other signs than letters and digits as '-', the extension kept; NULL where nothing is left."""
    clean = lambda s: F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    parts = F.split(F.lower(F.replace(path, F.lit("___"), F.lit("/"))), "/")
    last = F.element_at(parts, -1)
    ext = F.regexp_extract(last, r"(\.[a-z0-9]+)$", 1)
    name = F.concat(clean(F.substring(last, F.lit(1), F.length(last) - F.length(ext))), ext)
    whole = F.array_join(F.filter(F.concat(F.transform(F.slice(parts, 1, F.size(parts) - 1), clean), F.array(name)), lambda s: s != ""), "/")
    return F.when(F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"\.[^.]+$", "").rlike(r"[\p{L}\p{N}]"), whole)


def best_year(file: Column, year: Column) -> Column:
    """Year in a file's name, else a stated one between 1950 and 2030."""
    found = F.nullif(F.regexp_extract(file, r"((?:19|20)\d{2})", 1), F.lit("")).cast("int")
    return F.coalesce(found, F.when(year.between(1950, 2030), year))


def first_page(pages: Column) -> Column:
    return F.regexp_extract(F.coalesce(pages.cast("string"), F.lit("")), r"^(\d+)", 1)


def money(amount: Column) -> Column:
    """"$1,234,567"; NULL where absent or zero."""
    return F.when(F.coalesce(amount, F.lit(0)) != 0, F.concat(F.lit("$"), F.format_number(F.round(amount.cast("decimal(20,2)"), 0), 0)))


#: Small words left out of file names.
NAME_STOP_WORDS = ["a", "an", "the", "of", "in", "for", "and", "or", "is", "to", "by", "on", "at", "with", "from", "that", "this", "are"]


def file_name(authors: Column | str, day: Column | str, title: Column | str, words: int = 6, width: int = 50) -> Column:
    """'Surname-Year-First_telling_words': the title's part is cut at ``width``; absent parts are left out."""
    d = F.col(day) if isinstance(day, str) else day
    t = F.coalesce(F.col(title) if isinstance(title, str) else title, F.lit(""))
    told = F.slice(F.filter(F.regexp_extract_all(t, F.lit("([a-zA-Z0-9]+)"), 1), lambda w: ~F.lower(w).isin(NAME_STOP_WORDS)), 1, words)
    slug = F.nullif(F.substring(F.array_join(told, "_"), 1, width), F.lit(""))
    last = F.nullif(F.regexp_replace(first_author_last(authors), r"[^\p{L}]", ""), F.lit(""))
    return F.concat_ws("-", last, F.year(d).cast("string"), slug)


def citation(authors: Column | str, day: Column | str, journal: Column | str) -> Column:
    """'Doe et al., 2020, Journal'; absent parts are left out."""
    a = F.col(authors) if isinstance(authors, str) else authors
    last = blank_to_null(first_author_last(authors))
    who = F.when(F.size(a) > 2, F.concat(last, F.lit(" et al."))).otherwise(last)
    return F.concat_ws(", ", who, F.year(day).cast("string"), blank_to_null(journal))


def heading_title(text: Column | str) -> Column:
    """First heading of one or two '#'; NULL without one."""
    c = F.col(text) if isinstance(text, str) else text
    return F.nullif(F.trim(F.regexp_extract(c, r"(?m)^##?[ \t]+([^\r\n]+)", 1)), F.lit(""))


def fenced_json(c: Column | str, brackets: str = "[]") -> Column:
    """The outermost JSON array (or object, with '{}') in an answer that has text or code fences around it."""
    a, b = brackets
    return F.nullif(F.regexp_extract(F.col(c) if isinstance(c, str) else c, rf"(?s)(\{a}.*\{b})", 1), F.lit(""))


def single_slashes(c: Column | str) -> Column:
    """Doubled slashes of an address as one, but for the scheme's."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"(?<!:)/{2,}", "/")
