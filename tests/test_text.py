from datetime import date

import pytest
from pyspark.sql import functions as F

from florilege.functions import text as X


def one(spark, col, **kw):
    df = spark.createDataFrame([tuple(kw.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'date' if isinstance(v, date) else 'string'}" for k, v in kw.items()))
    return df.select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "pmid,want",
    [("60012345", "60012345"), (" PMID: 60012345 ", "60012345"), ("0060012345", "60012345"), ("60012345.0", "60012345"), ("https://pubmed.example/60012345/", "60012345"), ("0", None), ("00000000", None), ("n/a", None), ("", None), (None, None)],
)
def test_pmid(spark, pmid, want):
    assert one(spark, X.pmid_digits("p"), p=pmid) == want


@pytest.mark.parametrize(
    "doi,want",
    [("10.1016/j.cmet.2026.03.016", "10.1016/j.cmet.2026.03.016"), ("https://doi.example/10.1234%2FAbC.", "10.1234/abc"), ("doi:10.1234/x(1);", "10.1234/x(1"), ("10.", None), ("unknown", None), (None, None)],
)
def test_doi(spark, doi, want):
    assert one(spark, X.doi_key("d"), d=doi) == want


def test_slugs(spark):
    assert one(spark, X.doi_slug("d", "p"), d="10.1/a.b", p="7") == "10-1_a-b"
    assert one(spark, X.doi_slug("d", "p"), d=" ", p="7") == "pmid_7"
    assert one(spark, X.doi_slug("d", "p"), d=None, p=None) is None
    assert one(spark, X.slugify("t"), t="  A  (new) Way -- of things! ") == "a-new-way-of-things"
    assert one(spark, X.file_key("t"), t="A_-_b__C") == "a-b-c"


def test_names(spark):
    assert one(spark, X.display_name("n"), n="SMITH-JONES, MARY ann") == "Mary Ann Smith-Jones"
    assert one(spark, X.author_line("a"), a=["A", "B", "C", "D"]) == "A, B, C et al."
    assert one(spark, X.author_line("a"), a=[]) is None
    assert one(spark, X.first_author_last("a"), a=["Doe JA"]) == "Doe"
    assert one(spark, X.first_author_last("a"), a=["Doe, Jane"]) == "Doe"
    assert one(spark, X.first_author_last("a"), a=["Jane Doe"]) == "Doe"


@pytest.mark.parametrize(
    "html,want",
    [
        ("<H4 class='x'>T</H4><p>a<br/>b</p>", "<h4>T</h4><p>ab</p>"),
        ("<script>alert(1)</script>", "alert(1)"),
        ("x<!-- <p>hidden</p> -->y", "xy"),
        ("5 < 6 and 7 > 3", "5 < 6 and 7 > 3"),
        ("<img src=x onerror=y><ul><LI>a</LI></ul>", "<ul><li>a</li></ul>"),
        (None, ""),
    ],
)
def test_sanitize(spark, html, want):
    got = one(spark, X.sanitize("h"), h=html)
    assert got == want
    assert one(spark, X.sanitize("h"), h=got) == got


def test_strip_and_count(spark):
    assert one(spark, X.strip_tags("h"), h="<p>a&nbsp;&amp; b</p>\n<p></p>") == "a & b"
    assert one(spark, X.word_count("h"), h="  a b\n c ") == 3
    assert one(spark, X.word_count("h"), h=None) == 0
    assert one(spark, X.cut_with_dots("h", 5), h="abcdefg") == "ab..."


def test_findings_keep_text_order(spark):
    a = "We measured things in a long plain sentence without any of it at all."
    b = "The results showed that this reduced and significantly enhanced the measured outcome."
    c = "It was found that nothing else changed in the remaining animals here."
    assert one(spark, X.findings("t", 2), t=" ".join([a, b, c, "Short show."])) == [b, c]
    assert one(spark, X.findings("t"), t="") == []


def test_keywords(spark):
    assert one(spark, X.keyword_hit(F.col("t"), "~fast"), t="breakfast") is False
    assert one(spark, X.keyword_hit(F.col("t"), "~Fast"), t="a FAST car") is True
    assert one(spark, X.keyword_hit(F.col("t"), "fast"), t="breakfast") is True
    assert one(spark, X.keyword_hit(F.col("t"), "fast"), t=None) is False


def test_calendar(spark):
    assert one(spark, X.iso_week("d"), d=date(2024, 12, 30)) == "2025-W01"
    assert one(spark, X.fiscal_year("d"), d=date(2024, 10, 1)) == 2025
    assert one(spark, X.fiscal_year("d"), d=date(2024, 9, 30)) == 2024


def test_forms(spark):
    from florilege.functions import papers as P

    assert one(spark, P.short_author(F.col("n")), n="Jane Ann Doe") == "J. A. Doe" and one(spark, P.short_author(F.col("n")), n="Chen-Yu Yeh") == "C.-Y. Yeh" and one(spark, P.short_author(F.col("n")), n="Plato") == "Plato"
    assert one(spark, P.index_path(F.col("n")), n="Notes___My File!! (v2).MD") == "notes/my-file-v2.md" and one(spark, P.index_path(F.col("n")), n="a/b/!!.md") is None
    assert one(spark, P.safe_file_name(F.col("n")), n="dir/A  b_c: (d).v2.pdf") == "A_b_c_d.v2"
    assert [one(spark, P.initial_dot(F.col("n")), n=x) for x in ("Jane A", "J", "Jane", "JA")] == ["Jane A.", "J.", "Jane", "JA."]
    assert one(spark, P.money(F.col("n").cast("double")), n="1234567.5") == "$1,234,568" and one(spark, P.money(F.col("n").cast("double")), n="0") is None
    assert one(spark, P.suspicious_title("n"), n="Research  Article on mice") and not one(spark, P.suspicious_title("n"), n="Research on mice and their fat")


def test_sanitize_nested(spark):
    out = one(spark, X.sanitize("h"), h="<scr<script>ipt>alert(1)</script>")
    assert "<script" not in out.lower()
