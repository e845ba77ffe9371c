"""Names, paths, texts and other forms made from single rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import papers as P
from ..functions import text as X
from ..operators import fulltext as T
from ..session import table


def index_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path of a document as the index keeps it, and its address taken apart again."""
    df = table(spark, d, "documents").select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("none")), F.concat(F.coalesce("journal", F.lit("No Journal")), F.lit("___"), F.coalesce("paper_id", F.lit("note")), F.lit(".md"))).alias("path"))
    p = df.select("doc_id", P.index_path(F.col("path")).alias("path"))
    address = F.concat(F.lit("lib://"), F.col("path"))
    return p.select("doc_id", "path", F.regexp_extract(address, "^lib://([^/]+)/(.+)$", 1).alias("collection"), F.regexp_extract(address, "^lib://([^/]+)/(.+)$", 2).alias("rest"))


def author_forms(spark: SparkSession, d: str) -> DataFrame:
    """Authors with given names as initials."""
    a = F.filter("authors", lambda x: x.rlike(r"\S") & ~x.contains(","))
    return table(spark, d, "digest_papers").where(F.size("authors") > 0).select("id", F.array_join(F.transform(a, P.short_author), "; ").alias("short"))


def clean_file_names(spark: SparkSession, d: str) -> DataFrame:
    """Titles as file names, and the year such a name or the record gives."""
    df = table(spark, d, "endnote_records").where("title is not null")
    name = F.concat("title", F.lit(".pdf"))
    return df.select("rec_no", P.safe_file_name(name).alias("name"), P.best_year(name, F.regexp_extract("pub_year", r"(\d{4})", 1).try_cast("int")).alias("year"), P.first_page(F.regexp_replace("accession_num", r"^\D+", "")).alias("page"))


def grant_lines(spark: SparkSession, d: str) -> DataFrame:
    """Amount and month of an award as a reader sees them."""
    return table(spark, d, "digest_grants").select("id", P.money(F.col("amount")).alias("amount"), F.coalesce(F.date_format("award_date", "MMM yyyy"), F.lit("")).alias("awarded"))


def _seed() -> Column:
    return F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("abstract", F.lit(""))))


def seed_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts to be embedded: title and abstract of more than 50 characters, cut at 2,000, with the model's prefix."""
    df = table(spark, d, "digest_papers").select("id", "title", _seed().alias("t")).where(F.length("t") > 50)
    doc = F.concat(F.lit("title: "), F.coalesce(F.nullif("title", F.lit("")), F.lit("none")), F.lit(" | text: "), F.substring("t", 1, 2000))
    return df.select("id", F.sha2(doc, 256).alias("sha"), F.length(doc).alias("n_chars"))


def stub_headers(spark: SparkSession, d: str) -> DataFrame:
    """Header of a note for a record that has none yet: year from the name, reviews told by it, the DOI."""
    df = table(spark, d, "endnote_records").where("title is not null")
    kind = F.when(F.lower("title").contains("review"), "review").otherwise("primary")
    lines = [F.lit("---"), F.lit('pmid: ""'), F.lit('title: ""'), F.lit("authors: []"), F.concat(F.lit("year: "), F.regexp_extract("title", r"((?:19|20)\d{2})", 1)), F.lit('journal: ""'),
             F.concat(F.lit('doi: "'), F.coalesce("electronic_resource_num", F.lit("")), F.lit('"')), F.concat(F.lit("type: "), kind), F.lit("full_text: true"), F.lit("subtopics: []"), F.lit("key_findings: []"), F.lit("related_papers: []"), F.lit("---")]
    return df.select("rec_no", F.concat_ws("\n", *lines).alias("header"))


def summary_html(spark: SparkSession, d: str) -> DataFrame:
    """JSON summaries as markup; signs that mean something in it are escaped."""
    j = F.from_json("full_summary", "findings array<string>, methods string")
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    df = table(spark, d, "papers").where("full_summary is not null").select("id", j.alias("j"))
    items = F.array_join(F.transform("j.findings", lambda x: F.concat(F.lit("<li>"), esc(x), F.lit("</li>"))), "\n")
    found = F.when(F.size("j.findings") > 0, F.concat(F.lit("<h4>Key Findings</h4><ul>\n"), items, F.lit("\n</ul>")))
    return df.select("id", F.concat_ws("\n", found, F.concat(F.lit("<h4>Methods</h4><p>"), esc(F.nullif("j.methods", F.lit(""))), F.lit("</p>"))).alias("html"))


def paper_entries(spark: SparkSession, d: str) -> DataFrame:
    """Two lines on every saved paper, dashes and question marks for what is absent."""
    df = table(spark, d, "papers")
    who = F.coalesce(X.blank_to_null(X.first_author_last("authors")), F.lit("Unknown"))
    meta = F.concat(F.lit("  PMID "), F.coalesce(X.pmid_digits("pmid"), F.lit("—")), F.lit(" | "), who, F.lit(" "), F.coalesce(F.year("pub_date").cast("string"), F.lit("?")), F.lit(" | "), F.coalesce(X.blank_to_null("journal"), F.lit("?")))
    return df.select("id", F.concat(F.lit("**"), F.coalesce("paper_id", F.lit("")), F.lit("**\n"), meta).alias("entry"))


def cited_numbers(spark: SparkSession, d: str) -> DataFrame:
    """PubMed numbers and (Author Year) citations that stand in documents."""
    df = table(spark, d, "documents").where("text is not null")
    n = lambda r: F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(r), 1)))
    return df.select("doc_id", n(r"(?i)PMID:?\s*(\d{7,8})").alias("numbers"), n(r"\(([A-Z][a-z]+(?: et al\.)?,? (?:19|20)\d{2})\)").alias("citations")).where("numbers > 0 or citations > 0")


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines 3 to 10 of every document with their numbers."""
    lines = F.slice(F.split("text", "\n"), 3, 8)
    df = table(spark, d, "documents").where("text is not null").select("doc_id", lines.alias("ls")).where(F.size("ls") > 0)
    return df.select("doc_id", F.size("ls").alias("n"), F.sha2(T.numbered(F.array_join("ls", "\n"), 3), 256).alias("sha"))


def header_fields(spark: SparkSession, d: str) -> DataFrame:
    """Scalars in the front matter of notes, list items left out."""
    head = F.regexp_extract("text", r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    df = table(spark, d, "documents").where(F.col("text").startswith("---\n")).select("doc_id", F.explode(F.split(head, r"\r?\n")).alias("line"))
    df = df.where(F.col("line").rlike(r"^[A-Za-z_]+:\s*\S"))
    value = F.regexp_replace(F.trim(F.regexp_extract("line", r"^[A-Za-z_]+:\s*(.*)$", 1)), r"""^["']|["']$""", "")
    return df.select("doc_id", F.regexp_extract("line", r"^([A-Za-z_]+):", 1).alias("field"), value.alias("value"))


def id_filters(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers quoted and encoded for a request's filter."""
    quoted = F.when(F.col("paper_id").rlike(r'[,"()]'), F.concat(F.lit('"'), F.replace("paper_id", F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(F.col("paper_id"))
    return table(spark, d, "papers").where("paper_id is not null").select("id", F.replace(F.url_encode(quoted), F.lit("+"), F.lit("%20")).alias("encoded"))


def token_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents in chunks of 800 words, 680 apart, cut at the last break of their end."""
    return T.chunk_words(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "seq", "pos", "n_tokens", F.length("text").alias("n_chars"))


QUERIES = {f.__name__: f for f in (
    index_paths, author_forms, clean_file_names, grant_lines, seed_texts, stub_headers, summary_html, paper_entries, cited_numbers, document_lines, header_fields, id_filters, token_chunks)}

DASH = r"regexp_replace(regexp_replace({0}, '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g')"
FIRST = r"""case when contains(a[1], ',') then trim(split_part(trim(a[1]), ',', 1)) when regexp_matches(list_extract(regexp_split_to_array(trim(a[1]), '\s+'), -1), '^[A-Z]{1,4}$') and len(regexp_split_to_array(trim(a[1]), '\s+')) > 1
  then list_extract(regexp_split_to_array(trim(a[1]), '\s+'), 1) else list_extract(regexp_split_to_array(trim(a[1]), '\s+'), -1) end"""
ESC = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
ORACLE = {
    "index_paths": rf"""with p as (select doc_id, string_split(lower(replace(coalesce(source, 'none') || '/' || coalesce(journal, 'No Journal') || '___' || coalesce(paper_id, 'note') || '.md', '___', '/')), '/') as ps from documents),
        c as (select doc_id, array_to_string(list_filter(list_concat(list_transform(ps[:-2], lambda x: {DASH.format('x')}), [{DASH.format("regexp_replace(ps[-1], '[.]md$', '')")} || '.md']), lambda x: x <> ''), '/') as path from p)
        select doc_id, path, split_part(path, '/', 1) as collection, substr(path, position('/' in path) + 1) as rest from c""",
    "author_forms": r"""select id, array_to_string(list_transform(list_filter(authors, lambda x: regexp_matches(x, '\S') and not contains(x, ',')), lambda n: case when len(regexp_split_to_array(trim(n), '\s+')) < 2 then n else
        concat_ws(' ', array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(trim(n), '\s+')[:-2], lambda p: regexp_replace(p, '\.+$', '')), lambda p: p <> ''),
          lambda p: array_to_string(list_transform(list_filter(string_split(p, '-'), lambda s: s <> ''), lambda s: upper(s[1:1]) || '.'), '-')), ' '), regexp_split_to_array(trim(n), '\s+')[-1]) end), '; ') as short from digest_papers where len(authors) > 0""",
    "clean_file_names": r"""select rec_no, regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '^.*/', ''), '[^\p{L}\p{N}_\s.-]', '', 'g'), '[\s_]+', '_', 'g'), '^_+|_+$', '', 'g') as name,
        coalesce(try_cast(nullif(regexp_extract(title, '((?:19|20)\d{2})', 1), '') as int), case when try_cast(regexp_extract(pub_year, '(\d{4})', 1) as int) between 1950 and 2030 then try_cast(regexp_extract(pub_year, '(\d{4})', 1) as int) end) as year,
        coalesce(regexp_extract(regexp_replace(accession_num, '^\D+', ''), '^(\d+)', 1), '') as page from endnote_records where title is not null""",
    "grant_lines": "select id, case when coalesce(amount, 0) <> 0 then '$' || format('{:,}', round(amount)::bigint) end as amount, coalesce(strftime(award_date, '%b %Y'), '') as awarded from digest_grants",
    "seed_texts": r"""select id, sha256(t) as sha, length(t)::int as n_chars from (select id, 'title: ' || coalesce(nullif(title, ''), 'none') || ' | text: ' || substr(s, 1, 2000) as t from (select id, title, trim(coalesce(title, '') || chr(10) || chr(10) || coalesce(abstract, '')) as s from digest_papers) where length(s) > 50)""",
    "stub_headers": r"""select rec_no, concat_ws(chr(10), '---', 'pmid: ""', 'title: ""', 'authors: []', 'year: ' || regexp_extract(title, '((?:19|20)\d{2})', 1), 'journal: ""', 'doi: "' || coalesce(electronic_resource_num, '') || '"',
        'type: ' || case when contains(lower(title), 'review') then 'review' else 'primary' end, 'full_text: true', 'subtopics: []', 'key_findings: []', 'related_papers: []', '---') as header from endnote_records where title is not null""",
    "summary_html": f"""with j as (select id, from_json(json_extract(full_summary, '$.findings'), '["VARCHAR"]') as f, nullif(json_extract_string(full_summary, '$.methods'), '') as m from papers where full_summary is not null)
        select id, concat_ws(chr(10), case when len(f) > 0 then '<h4>Key Findings</h4><ul>' || chr(10) || array_to_string(list_transform(f, lambda x: '<li>' || {ESC.format('x')} || '</li>'), chr(10)) || chr(10) || '</ul>' end, '<h4>Methods</h4><p>' || {ESC.format('m')} || '</p>') as html from j""",
    "paper_entries": rf"""select id, '**' || coalesce(paper_id, '') || '**' || chr(10) || '  PMID ' || coalesce(nullif(regexp_replace(regexp_extract(trim(pmid), '([0-9]+)(?:\.0*)?[^0-9]*$', 1), '^0+', '', 'g'), ''), '—') || ' | ' || case when regexp_matches({FIRST}, '\S') then {FIRST} else 'Unknown' end
        || ' ' || coalesce(year(pub_date)::varchar, '?') || ' | ' || case when regexp_matches(journal, '\S') then journal else '?' end as entry from (select *, list_filter(authors, lambda x: regexp_matches(x, '\S')) as a from papers)""",
    "cited_numbers": r"""select * from (select doc_id, len(list_distinct(regexp_extract_all(text, '(?i)PMID:?\s*(\d{7,8})', 1)))::int as numbers, len(list_distinct(regexp_extract_all(text, '\(([A-Z][a-z]+(?: et al\.)?,? (?:19|20)\d{2})\)', 1)))::int as citations from documents where text is not null)
        where numbers > 0 or citations > 0""",
    "document_lines": r"""select doc_id, len(ls)::int as n, sha256(array_to_string(list_transform(ls, lambda s, i: (i + 2) || ': ' || s), chr(10))) as sha from (select doc_id, string_split(text, chr(10))[3:10] as ls from documents where text is not null) where len(ls) > 0""",
    "header_fields": r"""with h as (select doc_id, unnest(regexp_split_to_array(regexp_extract(text, '(?s)\A---\r?\n(.*?)\r?\n---', 1), '\r?\n')) as line from documents where starts_with(text, '---' || chr(10)))
        select doc_id, regexp_extract(line, '^([A-Za-z_]+):', 1) as field, regexp_replace(trim(regexp_extract(line, '^[A-Za-z_]+:\s*(.*)$', 1)), '^["'']|["'']$', '', 'g') as value from h where regexp_matches(line, '^[A-Za-z_]+:\s*\S')""",
    "id_filters": r"""select id, url_encode(case when regexp_matches(paper_id, '[,"()]') then '"' || replace(paper_id, '"', '\"') || '"' else paper_id end) as encoded from papers where paper_id is not null""",
}
