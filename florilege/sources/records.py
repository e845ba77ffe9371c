"""Readers for reference records: RIS, EndNote XML, PubMed XML, article XML, HTML meta tags, id lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.papers import initial_dot

#: Months as they are written in records.
MONTHS = {m: f"{i + 1:02d}" for i, m in enumerate(["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"])}


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id): the lines of a text file that are digits only."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where(F.col("id").rlike(r"^\d+$"))


def _tag(block: Column, tags: list[str]) -> Column:
    """Value of the first of ``tags`` that a record has."""
    return F.coalesce(*(F.nullif(F.trim(F.regexp_extract(block, rf"(?m)^{t}\s{{1,2}}- ?(.*)$", 1)), F.lit("")) for t in tags))


def _tags(block: Column, tags: str) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(block, F.lit(rf"(?m)^(?:{tags})\s{{1,2}}- ?(.*)$"), 1), F.trim), lambda x: x != "")


def read_ris(spark: SparkSession, path: str) -> DataFrame:
    """One row per RIS record: type, title, authors, journal, year, abstract, doi, pmid, pmcid, volume, issue, pages.

    Files are split at the end mark by the reader, so a file of any size is
    read in parts. 'et al.' is no author. Of the journal tags the first in the
    order JO, JF, T2 wins; a PubMed number must be digits. Abstracts run on over
    lines without a tag. Records without a title and authors give no row.
    """
    b = F.regexp_replace(F.col("value"), r"\r", "")
    pages = F.concat_ws("-", _tag(b, ["SP"]), _tag(b, ["EP"]))
    number = F.coalesce(*(F.nullif(F.regexp_extract(b, rf"(?m)^{t}\s{{1,2}}- ?\s*(\d+)\s*$", 1), F.lit("")) for t in ("PM", "PMID", "AN")))
    abstract = F.regexp_extract(b, r"(?ms)^(?:AB|N2)\s{1,2}- ?(.*?)(?=^[A-Z][A-Z0-9]{1,3}\s{1,2}- |\z)", 1)
    out = spark.read.option("lineSep", "ER  -").text(path).select(
        _tag(b, ["TY"]).alias("type"),
        _tag(b, ["TI", "T1"]).alias("title"),
        F.filter(_tags(b, "AU|A1"), lambda x: ~F.lower(x).rlike(r"^et al\.?$")).alias("authors"),
        _tag(b, ["JO", "JF", "T2"]).alias("journal"),
        F.nullif(F.regexp_extract(_tag(b, ["PY", "Y1", "DA"]), r"(\d{4})", 1), F.lit("")).cast("int").alias("year"),
        F.nullif(F.trim(F.regexp_replace(abstract, r"\s+", " ")), F.lit("")).alias("abstract"),
        _tag(b, ["DO"]).alias("doi"),
        number.alias("pmid"),
        _tag(b, ["C2"]).alias("pmcid"),
        _tag(b, ["VL"]).alias("volume"),
        _tag(b, ["IS"]).alias("issue"),
        F.nullif(pages, F.lit("")).alias("pages"),
    )
    return out.where("title is not null or size(authors) > 0")


def ris_lines(df: DataFrame) -> Column:
    """RIS text of a row with title, authors, journal, pub_date, doi, pmid, abstract; absent fields have no line."""
    line = lambda tag, c: F.concat(F.lit(f"{tag}  - "), c)
    authors = F.when(F.size("authors") > 0, F.array_join(F.transform("authors", lambda a: F.concat(F.lit("AU  - "), a)), "\n"))
    return F.concat_ws(
        "\n", F.lit("TY  - JOUR"), line("TI", F.col("title")), authors, line("JO", F.col("journal")), line("PY", F.year("pub_date").cast("string")),
        line("DA", F.date_format("pub_date", "yyyy/MM/dd")), line("AB", F.col("abstract")), line("DO", F.col("doi")), line("AN", F.col("pmid")), F.lit("ER  - "),
    )


def parse_endnote_xml(df: DataFrame, xml: str) -> DataFrame:
    """Columns of one EndNote ``<record>`` per row, from XML text in ``xml``: text may be wrapped in style elements.

    A PubMed number is the accession number if it is digits, else the number in
    a PubMed address.
    """
    text = lambda path: F.nullif(F.trim(F.array_join(F.xpath(F.col(xml), F.lit(f"{path}//text()")), "")), F.lit(""))
    accession = text("record/accession-num")
    url = text("record/urls")
    return df.select(
        *[c for c in df.columns if c != xml],
        F.nullif(F.xpath_string(xml, F.lit("record/ref-type/@name")), F.lit("")).alias("ref_type"),
        text("record/titles/title").alias("title"),
        text("record/titles/secondary-title").alias("secondary_title"),
        F.transform(F.xpath(F.col(xml), F.lit("record/contributors/authors/author//text()")), F.trim).alias("authors"),
        F.nullif(F.regexp_extract(text("record/dates/year"), r"(\d{4})", 1), F.lit("")).cast("int").alias("pub_year"),
        F.coalesce(F.when(accession.rlike(r"^\d+$"), accession), F.nullif(F.regexp_extract(url, r"pubmed[^0-9]*(\d{5,9})", 1), F.lit(""))).alias("pmid"),
        text("record/electronic-resource-num").alias("doi"),
    )


def read_xml_records(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """(xml): one row per element ``tag`` of the XML files, split by the reader."""
    raw = spark.read.option("lineSep", f"</{tag}>").text(path)
    body = F.regexp_extract("value", rf"(?s)(<{tag}[\s>].*)$", 1)
    return raw.select(F.concat(body, F.lit(f"</{tag}>")).alias("xml")).where(F.col("xml") != f"</{tag}>")


def author_name(xml: Column) -> Column:
    """Name in one ``<Author>`` element: fore name and last name, else the collective name, else NULL.

    A fore name that ends in a single letter gets a dot.
    """
    part = lambda tag: F.nullif(F.trim(F.regexp_extract(xml, rf"(?s)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))
    fore = initial_dot(part("ForeName"))
    return F.coalesce(F.when(part("LastName").isNotNull(), F.concat_ws(" ", fore, part("LastName"))), part("CollectiveName"))


def parse_pubmed_xml(df: DataFrame, xml: str) -> DataFrame:
    """pmid, title, authors, journal, pub_date, doi, abstract, mesh of one PubmedArticle per row.

    Labelled abstract sections become 'LABEL: text', joined by blanks. The date
    is the journal issue's; a missing month or day is 01, a year in a free-text
    date is found. Articles without a number or a title give no row.
    """
    x = F.col(xml)
    s = lambda p: F.nullif(F.trim(F.xpath_string(x, F.lit(p))), F.lit(""))
    people = F.regexp_extract_all(x, F.lit(r"(?s)(<Author[\s>].*?</Author>)"), 1)
    month = F.lower(F.substring(s("//JournalIssue/PubDate/Month"), 1, 3))
    number = F.when(month.rlike(r"^\d+$"), F.lpad(month, 2, "0"))
    for k, v in MONTHS.items():
        number = number.when(month == k, v)
    year = F.coalesce(s("//JournalIssue/PubDate/Year"), F.nullif(F.regexp_extract(s("//JournalIssue/PubDate/MedlineDate"), r"(\d{4})", 1), F.lit("")))
    date = F.try_to_date(F.concat_ws("-", year, F.coalesce(number, F.lit("01")), F.coalesce(F.lpad(s("//JournalIssue/PubDate/Day"), 2, "0"), F.lit("01"))))
    parts = F.regexp_extract_all(x, F.lit(r"(?s)(<AbstractText[^>]*>.*?</AbstractText>)"), 1)
    label = lambda p: F.nullif(F.regexp_extract(p, r'Label="([^"]+)"', 1), F.lit(""))
    text = lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, "<[^>]*>", ""), r"\s+", " "))
    out = df.select(
        s("//MedlineCitation/PMID").alias("pmid"), s("//ArticleTitle").alias("title"), F.array_compact(F.transform(people, author_name)).alias("authors"), s("//Journal/Title").alias("journal"), date.alias("pub_date"),
        s("//ArticleIdList/ArticleId[@IdType='doi']").alias("doi"), F.nullif(F.array_join(F.transform(parts, lambda p: F.concat_ws(": ", label(p), text(p))), " "), F.lit("")).alias("abstract"),
        F.xpath(x, F.lit("//MeshHeadingList/MeshHeading/DescriptorName/text()")).alias("mesh"),
    )
    return out.where("pmid is not null and title is not null")


def article_text(xml: Column | str, least: int = 500) -> Column:
    """Plain text of an article's body: titles as '## ', paragraphs apart, no tables and figures; NULL if no longer than ``least``."""
    c = F.col(xml) if isinstance(xml, str) else xml
    body = F.regexp_extract(c, r"(?s)<body[^>]*>(.*?)</body>", 1)
    for tag in ("table-wrap", "fig", "supplementary-material"):
        body = F.regexp_replace(body, rf"(?s)<{tag}[\s>].*?</{tag}>", "")
    body = F.regexp_replace(body, r"(?s)<title[^>]*>(.*?)</title>", "\n\n## $1\n\n")
    body = F.regexp_replace(F.regexp_replace(body, r"</p>", "\n\n"), r"<[^>]+>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        body = F.replace(body, F.lit(a), F.lit(b))
    body = F.regexp_replace(F.regexp_replace(body, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return F.when(F.length(body) > least, body)


def meta_values(html: Column | str, name: str) -> Column:
    """Contents of all ``<meta name=... content=...>`` of a page, in order."""
    c = F.col(html) if isinstance(html, str) else html
    return F.regexp_extract_all(c, F.lit(rf'(?i)<meta\s+name=["\']{name}["\']\s+content=["\']([^"\']*)["\']'), 1)


def preprint_doi(c: Column | str, prefixes: str = "1101|64898") -> Column:
    """DOI of a preprint in a DOI, a resolver's or a server's address, without version."""
    x = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_extract(x, rf"(10\.(?:{prefixes})/[0-9.]*[0-9])", 1), F.lit(""))


def write_id_files(records: DataFrame, path: str) -> None:
    """Two folders of text files: the distinct PubMed numbers, one a line in numeric order, and a TSV of the records without one."""
    numbers = records.where(F.col("pmid").rlike(r"^\d+$")).select("pmid").distinct().orderBy(F.col("pmid").cast("bigint"))
    numbers.write.mode("overwrite").text(f"{path}/pmids")
    records.where("pmid is null or pmid = ''").select("title", "journal", "year").write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{path}/no_pmid")


GRANT = T.StructType(
    [
        T.StructField("core_project_num", T.StringType()),
        T.StructField("project_title", T.StringType()),
        T.StructField("contact_pi_name", T.StringType()),
        T.StructField("organization", T.StructType([T.StructField("org_name", T.StringType()), T.StructField("org_city", T.StringType()), T.StructField("org_state", T.StringType())])),
        T.StructField("activity_code", T.StringType()),
        T.StructField("award_amount", T.DecimalType(18, 2)),
        T.StructField("fiscal_year", T.IntegerType()),
        T.StructField("abstract_text", T.StringType()),
        T.StructField("full_study_section", T.StructType([T.StructField("name", T.StringType())])),
    ]
)


def parse_grants(df: DataFrame, raw: str) -> DataFrame:
    """Flat grant columns from the nested JSON in ``raw``; broken JSON gives NULLs."""
    g = df.select(F.from_json(raw, GRANT).alias("g"))
    n = lambda p: F.nullif(F.col(p), F.lit(""))
    return g.select(
        n("g.core_project_num").alias("grant_id"), n("g.project_title").alias("title"), n("g.contact_pi_name").alias("pi"), n("g.organization.org_name").alias("organization"), n("g.organization.org_city").alias("org_city"),
        n("g.organization.org_state").alias("org_state"), n("g.activity_code").alias("mechanism"), F.col("g.award_amount").alias("amount"), F.col("g.fiscal_year").alias("fiscal_year"), n("g.abstract_text").alias("abstract"), n("g.full_study_section.name").alias("study_section"),
    )
