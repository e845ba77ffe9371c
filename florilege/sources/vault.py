"""Notes with front matter: reading, writing, and index pages made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order of the known front matter fields when written.
FIELD_ORDER = ["pmid", "pmcid", "title", "authors", "year", "journal", "volume", "issue", "pages", "doi", "type", "lab", "full_text", "enrichment_status", "status", "tags"]
HEADER = r"(?s)\A---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"


def read_vault(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): the notes under ``path`` whose name does not start with '_'."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="[!_]*.md")
    return raw.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def header(text: Column | str) -> Column:
    """Front matter of a note; '' without one."""
    return F.regexp_extract(F.col(text) if isinstance(text, str) else text, HEADER, 1)


def body(text: Column | str) -> Column:
    """The note below its front matter."""
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, HEADER, "")


def field(head: Column, name: str) -> Column:
    """Scalar of a front matter field without quotes; NULL if absent, empty, null or ~."""
    v = F.trim(F.regexp_extract(head, rf"(?m)^{name}:[ \t]*(.*?)[ \t\r]*$", 1))
    v = F.regexp_replace(v, r"""^(["'])(.*)\1$""", "$2")
    return F.when(~v.isin("", "null", "~", "[]"), v)


def list_field(head: Column, name: str) -> Column:
    """Items of a front matter list, written inline in brackets or as '- item' lines; [] if absent."""
    inline = F.regexp_extract(head, rf"(?m)^{name}:[ \t]*\[(.*)\][ \t\r]*$", 1)
    block = F.regexp_extract(head, rf"(?m)^{name}:[ \t\r]*\n((?:[ \t]*- .*(?:\n|\z))+)", 1)
    items = F.when(inline != "", F.split(inline, r",\s*")).otherwise(F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*- (.*)$"), 1))
    clean = F.transform(items, lambda x: F.regexp_replace(F.trim(x), r"""^(["'])(.*)\1$""", "$2"))
    return F.filter(clean, lambda x: x != "")


def parse_notes(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the known fields, body, body_sha (SHA-256 of the body), words and has_full_text of each note."""
    h = header(text)
    b = body(text)
    scalars = {n: field(h, n) for n in ("pmid", "title", "journal", "doi", "type", "status", "enrichment_status")}
    return df.withColumns(
        scalars
        | {
            "year": field(h, "year").try_cast("int"),
            "authors": list_field(h, "authors"),
            "tags": list_field(h, "tags"),
            "body": b,
            "body_sha": F.sha2(b, 256),
            "words": F.size(F.filter(F.split(b, r"\s+"), lambda w: w != "")),
            "has_full_text": F.regexp_count(b, F.lit(r"(?m)^## ")) > 1,
        }
    )


def note_text(df: DataFrame) -> Column:
    """Front matter in the fixed field order followed by the body; NULL fields are left out, lists are written inline."""
    lines = []
    for name in FIELD_ORDER:
        if name in df.columns:
            kind = df.schema[name].dataType.simpleString()
            v = F.concat(F.lit("["), F.array_join(name, ", "), F.lit("]")) if kind.startswith("array") else F.col(name).cast("string") if kind != "string" else F.when(F.col(name).rlike(r"[:#\[\]\"]"), F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit("'")), F.lit('"'))).otherwise(F.col(name))
            lines.append(F.concat(F.lit(f"{name}: "), v))
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"), F.coalesce("body", F.lit("")))


def changed(new: DataFrame, known: DataFrame, key: str, sha: str) -> DataFrame:
    """(key, change): new, changed or unchanged against the kept body hashes."""
    k = known.select(key, F.col(sha).alias("_known"))
    state = F.when(F.col("_known").isNull(), "new").when(F.col("_known") != F.col(sha), "changed").otherwise("unchanged")
    return new.join(k, key, "left").select(key, state.alias("change"))


def index_row(file: Column, year: Column, authors: Column, journal: Column, title: Column) -> Column:
    """Line of the markdown index table; a dash for what is absent."""
    dash = lambda c: F.coalesce(c, F.lit("-"))
    return F.concat_ws(" | ", F.lit(""), dash(file), dash(year.cast("string")), dash(authors), dash(journal), dash(title), F.lit(""))
