from pyspark.sql import functions as F

from florilege.sources import records as R
from florilege.sources import vault as V

RIS = """TY  - JOUR
TI  - A title
AU  - Doe, Jane
AU  - et al.
T2  - Third
JO  - First
PY  - 2021/03/01
AB  - One line
goes on here.
DO  - 10.1/x
AN  - 12345
SP  - 1
EP  - 9
ER  -
TY  - JOUR
T1  - Other
AU  - Roe R
AN  - shelf 9
ER  -
"""


def test_ris(spark, tmp_path):
    (tmp_path / "a.ris").write_text(RIS)
    a, b = sorted(R.read_ris(spark, str(tmp_path / "a.ris")).collect(), key=lambda r: r["title"])
    assert (a["title"], a["authors"], a["journal"], a["year"], a["pmid"], a["pages"], a["abstract"]) == ("A title", ["Doe, Jane"], "First", 2021, "12345", "1-9", "One line goes on here.")
    assert b["title"] == "Other" and b["pmid"] is None and b["journal"] is None


def test_ris_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("T", ["A B"], "J", None, "10.1/z", "77", None)], "title string, authors array<string>, journal string, pub_date date, doi string, pmid string, abstract string")
    (tmp_path / "b.ris").write_text(df.select(R.ris_lines(df).alias("x")).first()["x"] + "\n")
    got = R.read_ris(spark, str(tmp_path / "b.ris")).collect()
    assert len(got) == 1 and (got[0]["title"], got[0]["doi"], got[0]["pmid"], got[0]["abstract"]) == ("T", "10.1/z", "77", None)


PUBMED = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>11</PMID><Article><Journal><JournalIssue><PubDate><Year>2020</Year><Month>Mar</Month></PubDate></JournalIssue><Title>J</Title></Journal>
<ArticleTitle>On things</ArticleTitle><Abstract><AbstractText Label="AIMS">To <i>see</i>.</AbstractText><AbstractText>Then more.</AbstractText></Abstract><AuthorList><Author><LastName>Plato</LastName></Author><Author><CollectiveName>A group</CollectiveName></Author><Author ValidYN="Y"><LastName>Doe</LastName><ForeName>Jane A</ForeName><Initials>JA</Initials></Author></AuthorList></Article></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>12</PMID></MedlineCitation></PubmedArticle></PubmedArticleSet>"""


def test_pubmed(spark, tmp_path):
    (tmp_path / "p.xml").write_text(PUBMED)
    got = R.parse_pubmed_xml(R.read_xml_records(spark, str(tmp_path / "p.xml"), "PubmedArticle"), "xml").collect()
    assert len(got) == 1
    r = got[0]
    assert (r["pmid"], r["title"], r["authors"], str(r["pub_date"]), r["abstract"]) == ("11", "On things", ["Plato", "A group", "Jane A. Doe"], "2020-03-01", "AIMS: To see. Then more.")


def test_endnote(spark):
    xml = "<record><ref-type name='Journal Article'>17</ref-type><contributors><authors><author><style>Doe, J.</style></author></authors></contributors><titles><title><style>A </style><style>B</style></title></titles><dates><year><style>2019</style></year></dates><accession-num>x1</accession-num><urls><u>https://pubmed.example/1234567/</u></urls></record>"
    r = R.parse_endnote_xml(spark.createDataFrame([(xml,)], "xml string"), "xml").first()
    assert (r["ref_type"], r["title"], r["authors"], r["pub_year"], r["pmid"], r["doi"]) == ("Journal Article", "A B", ["Doe, J."], 2019, "1234567", None)


def test_html_and_articles(spark):
    df = spark.createDataFrame([('<meta name="citation_author" content="A"><META NAME="citation_author" CONTENT="B">', "<body><sec><title>T</title><p>" + "word " * 120 + "</p><fig><p>no</p></fig></sec></body>", "https://www.biorxiv.example/content/10.1101/2024.01.02.123456v2")], "h string, x string, u string")
    r = df.select(R.meta_values("h", "citation_author").alias("m"), R.article_text("x").alias("t"), R.article_text("x", 5000).alias("n"), R.preprint_doi("u").alias("d")).first()
    assert r["m"] == ["A", "B"] and r["t"].startswith("## T") and "no" not in r["t"] and r["n"] is None and r["d"] == "10.1101/2024.01.02.123456"


def test_grants(spark):
    raw = '{"core_project_num":"R01X","project_title":"","organization":{"org_name":"U"},"award_amount":12.5,"fiscal_year":2024}'
    a, b = R.parse_grants(spark.createDataFrame([(raw,), ("{broken",)], "raw string"), "raw").collect()
    assert (a["grant_id"], a["title"], a["organization"], float(a["amount"]), a["fiscal_year"]) == ("R01X", None, "U", 12.5, 2024) and b["grant_id"] is None


NOTE = '---\npmid: "12"\ntitle: "A: b"\nauthors: [X Y, "Z"]\nyear: 2020\njournal: null\ntags:\n  - one\n  - two\n---\nBody text.\n\n## M\n\n## R\n'


def test_notes(spark, tmp_path):
    (tmp_path / "a.md").write_text(NOTE)
    (tmp_path / "_index.md").write_text("x")
    r = V.parse_notes(V.read_vault(spark, str(tmp_path))).collect()
    assert len(r) == 1
    r = r[0]
    assert (r["file"], r["pmid"], r["title"], r["year"], r["journal"], r["authors"], r["tags"], r["has_full_text"]) == ("a.md", "12", "A: b", 2020, None, ["X Y", "Z"], ["one", "two"], True)
    again = spark.createDataFrame([(r["pmid"], r["title"], r["authors"], r["year"], r["body"])], "pmid string, title string, authors array<string>, year int, body string")
    text = again.select(V.note_text(again).alias("text"))
    s = V.parse_notes(text).first()
    assert (s["pmid"], s["title"], s["authors"], s["year"], s["body_sha"]) == (r["pmid"], r["title"], r["authors"], r["year"], r["body_sha"])


def test_changed(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, sha string")
    old = spark.createDataFrame([(1, "a"), (2, "x"), (9, "z")], "id int, sha string")
    assert sorted((r["id"], r["change"]) for r in V.changed(new, old, "id", "sha").collect()) == [(1, "unchanged"), (2, "changed"), (3, "new")]


def test_id_file(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("12\n x\n 34 \n")
    assert sorted(r["id"] for r in R.read_ids(spark, str(tmp_path / "ids.txt")).collect()) == ["12", "34"]
