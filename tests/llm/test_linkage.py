import cProfile
import datetime as dt
import pstats
import random
import unicodedata

import numpy as np
import pandas as pd
import pytest

from florilege.llm import leakage as E
from florilege.llm import linkage as L
from florilege.llm import matching as M
from florilege.llm import names as N
from florilege.llm import variants as V

SCHEMA = "id long, batch string, paper_id string, pmid string, doi string, title string, authors array<string>, journal string, pub_date date"
T1 = "Loss of ABCD12 restrains lipid turnover in obese mice: a role for zugafen"


def row(i, batch, title, pmid=None, doi=None, authors=("Doering J", "Roebuck R"), journal="Annals of Things", day=dt.date(2020, 1, 5), paper_id=None):
    return (i, batch, paper_id, pmid, doi, title, list(authors) if authors is not None else None, journal, day)


ROWS = [
    row(1, "2020-02-01", T1, "60000001", "10.9999/a.1"),
    row(2, "2020-03-01", T1.upper() + " .", None, "https://doi.example/10.9999%2FA.1"),
    row(3, "2020-03-01", "Loss of ABCD12 restrians lipid turnover in obese mice: a role for zugafen", None, "10.9001/2019.01.02.33v2", journal="bioRxiv", day=dt.date(2019, 1, 2)),
    row(4, "2020-04-01", "<i>Loss</i> of ABCD12 restrains lipid turnover in obese…", None, None),
    row(5, "2020-04-01", "Erratum: " + T1, "60000002", "10.9999/a.2", day=dt.date(2020, 6, 1)),
    row(6, "2020-05-01", T1 + " (2022 update)", "60000003", None, day=dt.date(2020, 7, 1)),
    row(7, "2020-05-01", "Loss of ABCD12 restrains lipid turnover in shift workers: a role for zugafen", None, "10.9999/a.9", day=dt.date(2020, 9, 1)),
    row(8, "2020-05-01", "Editorial", None, None, paper_id="pmid_null"),
    row(9, "2020-05-01", "Editorial", None, None, paper_id="pmid_null", journal="Other Journal"),
    row(10, None, None, None, None, authors=None, journal=None, day=None),
    row(11, "2020-06-01", T1, None, None, paper_id="pmid_60000001"),
    row(12, "2020-06-01", "", "-", "unknown", authors=[]),
    row(13, "2020-06-01", "Wholly different words about quartz minerals in deep caves", "60000044"),
]
NOISE = [row(100 + i, "2020-01-01", f"Study number {i} on gene QX{i} with compound bla{i}trin in mice and lipid matters", str(61000000 + i), day=dt.date(2018, 1, 1 + i % 28)) for i in range(60)]


def link(spark, path, *batches, **kw):
    for b in batches:
        L.link_batch(L.read_records(b), L.History(spark, str(path)), **kw)  # every batch opens the history anew
    return L.History(spark, str(path))


def pairs_of(h):
    return {(r["id_lo"], r["id_hi"]) for r in L.first_pairs(h).collect()}


@pytest.mark.parametrize("small", [40, 2])
def test_linking_in_one_and_two_batches(spark, tmp_path, small):
    df = spark.createDataFrame(ROWS + NOISE, SCHEMA)
    want = {(1, 2), (1, 3), (1, 4), (1, 11)}
    assert pairs_of(link(spark, tmp_path / "a", df, small=small)) == want
    h = link(spark, tmp_path / "b", df.where("coalesce(batch, '') < '2020-04-15'"), df.where("batch >= '2020-04-15'"), small=small)
    assert pairs_of(h) == want and len(h.parts()) == 2
    h.compact()
    assert pairs_of(L.History(spark, h.path)) == want and len(h.parts()) == 1


def test_history_is_exclusive_and_failed_batches_leave_nothing(spark, tmp_path):
    df = spark.createDataFrame(ROWS[:4], SCHEMA)
    h = link(spark, tmp_path, df)
    a, b = L.History(spark, h.path), L.History(spark, h.path)
    a.write("records", L.read_records(df))  # never committed
    assert h.read("records").count() == 4
    b.commit = lambda: b._put("_commits/000000000", "{}")
    with pytest.raises(Exception):
        b.commit()


def test_linking_nothing(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    assert pairs_of(link(spark, tmp_path, df)) == set()


def test_hot_paper(spark, tmp_path):
    df = spark.createDataFrame([row(i, "b", T1, "60000001" if i % 2 else None, "10.9999/a.1") for i in range(3000)], SCHEMA)
    c = link(spark, tmp_path, df).clusters()
    assert {r["component"] for r in c.collect()} == {0} and c.count() == 3000


def task(monkeypatch, df, make):
    """The function that ``make(df)`` runs in tasks."""
    kept = []
    with monkeypatch.context() as m:
        m.setattr(type(df), "mapInPandas", lambda self, f, schema: kept.append(f))
        make(df)
    return kept[0]


def test_work_of_a_record(spark, monkeypatch):
    """In Python calls: reading such a record and making its keys took 705, now 224, as much was done again for every word and name."""
    rows = [row(i, "b", f"Study of gene QX{i} with compound bla{i}trin in mice of {i % 40} farms near the old river", str(61000000 + i), f"10.9999/x.{i}", authors=[f"Vabamedé{k % 50} M" for k in range(i, i + 4)]) for i in range(1000)]
    df = spark.createDataFrame(rows, SCHEMA)
    new = pd.DataFrame(rows, columns=df.columns).assign(day=18266)
    read, keyed = task(monkeypatch, df, L.read_records), task(monkeypatch, L.read_records(df), lambda r: L.blocking_keys(r, {"study": 1000, "mice": 1000}))
    keys = []
    with cProfile.Profile() as work:
        for records in read(iter([new])):
            keys += keyed(iter([records]))
    assert sum(map(len, keys)) > 8 * len(rows)
    assert pstats.Stats(work).total_calls < 400 * len(rows)


def test_first_batch_probes_nothing(spark, tmp_path, monkeypatch):
    asked, read = [], L.History.read
    monkeypatch.setattr(L.History, "read", lambda self, kind, *a: asked.append(kind) or read(self, kind, *a))
    df = spark.createDataFrame(ROWS[:4], SCHEMA)
    h = link(spark, tmp_path, df)
    assert "keys" not in asked
    link(spark, tmp_path, df.selectExpr("id + 50 as id", *df.columns[1:]))
    assert "keys" in asked and len({r["component"] for r in h.clusters().collect()}) == 1


def test_pairs_do_not_depend_on_batches_of_rows(spark, monkeypatch):
    rng = np.random.default_rng(7)
    own = [(int(k), bool(k % 5 == 0), int(i), bool(i % 3)) for k, i in zip(rng.integers(0, 40, 150), rng.permutation(150))]
    own = sorted(own + [(-9, False, 500, False), (50, False, 501, False), (60, True, 502, False)])
    run = task(monkeypatch, spark.createDataFrame(own, "key long, strong boolean, id long, old boolean"), lambda df: L.candidate_pairs(df, 5))
    want = set()
    for key in {x[0] for x in own}:
        g = [x for x in own if x[0] == key]
        if g[0][1]:
            want |= {(g[0][2], x[2], L.STRONG) for x in g[1:] if not (x[3] and g[0][3])}
        elif len(g) > 5:
            want.add((key, len(g), L.LARGE))
        else:
            want |= {(x[2], y[2], L.WEAK) for n, x in enumerate(g) for y in g[n + 1 :] if not (x[3] and y[3])}
    assert {k for *_, k in want} == {L.STRONG, L.WEAK, L.LARGE}
    rows = pd.DataFrame(own, columns=["key", "strong", "id", "old"])
    for n in (1, 2, 7, 200):
        got = pd.concat(run(rows[k : k + n] for k in range(0, len(rows), n)))
        assert {tuple(map(int, r)) for r in got.itertuples(index=False)} == want


@pytest.mark.parametrize("s", ["Vabamedé DREVALOTRÍ", "İzmir", "Åbo ﬁnd", "ΑΒΓ ΟΔΟΣ", "straße ǆ", "gutâ€“liver", "e\u0301", "plain"])
def test_folding_letter_by_letter(s):
    t = unicodedata.normalize("NFKD", N._ODD.sub(N._repair, s))
    assert N.fold(s) == "".join(N.GREEK.get(c, c) for c in "".join(c for c in t if not unicodedata.combining(c)).lower())


@pytest.mark.parametrize(
    "a,b,want",
    [(T1, T1.lower(), 3), (T1, T1.replace("lipid", "lipd"), 2), (T1, T1.split(":")[0], 1), (T1, T1[:40] + " …", 1), (T1, T1.replace("obese mice", "shift workers"), 0), (T1, T1.replace("mice", "rats"), 0), ("a", "", 0), ("Tumour ageing", "tumor aging", 3)],
)
def test_titles(a, b, want):
    (x, _, cx, hx), (y, _, cy, hy) = N.title_words(a), N.title_words(b)
    assert N.same_titles(x, y, cx, cy, hx, hy) == want == N.same_titles(y, x, cy, cx, hy, hx)


def test_editions():
    e = lambda t: N.title_words(t)[1]
    assert e("A b c: part II") == e("A b c: part 2") != e("A b c: part I")
    assert e("Retraction notice: A b") == "retraction" and e("Correction to: A b") == "correction" and e("Comment on: A") == "comment"
    assert e("gutâ€“liver axis") == "" and N.title_words("gutâ€“liver axis")[0] == ["gut", "liver", "axis"]


def test_near_against_full_table():
    def dist(a, b):
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        d[:, 0], d[0, :] = range(len(a) + 1), range(len(b) + 1)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[-1, -1]

    rng = random.Random(1)
    for _ in range(1500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(2))
        for most in (1, 2):
            assert N.near(a, b, most) == (dist(a, b) <= most), (a, b, most)


def test_assignment_against_permutations():
    from itertools import permutations

    rng = np.random.default_rng(4)
    for _ in range(60):
        n, m = (int(x) for x in rng.integers(1, 5, 2))
        g = np.round(rng.random((n, m)) * (rng.random((n, m)) > 0.3), 3)
        small, big = min(n, m), max(n, m)
        t = g if n <= m else g.T
        best = max(sum(t[i, p[i]] for i in range(small)) for p in permutations(range(big), small))
        got = M.assignment(g)
        assert abs(sum(g[a, b] for a, b in got) - best) < 1e-9 and len({a for a, _ in got}) == len(got) == len({b for _, b in got})


PUB = "node long, title string, authors array<string>, journal string, year string, pmid string, doi string"


def test_sparse_assignment_at_any_size():
    rng = np.random.default_rng(4)
    for _ in range(200):
        g = rng.integers(0, 6, size=rng.integers(1, 7, size=2)) * 0.1
        got = M.sparse_assignment([(10 + a, 20 + b, float(g[a, b])) for a, b in zip(*np.nonzero(g))])
        assert len({a for a, _ in got}) == len({b for _, b in got}) == len(got)
        assert sum(g[a - 10, b - 20] for a, b in got) == pytest.approx(sum(g[a, b] for a, b in M.assignment(g)))
    n = 1500  # a chain in which best pair first loses every other row
    chain = [(i, i, 1.0) for i in range(n)] + [(i, i + 1, 1.1) for i in range(n - 1)] + [(n - 1, 0, 0.5)]
    assert sum({(a, b): s for a, b, s in chain}[p] for p in M.sparse_assignment(chain)) == pytest.approx(max(float(n), 1.1 * (n - 1) + 0.5))


def test_large_knot_is_assigned_exactly(spark, monkeypatch):
    """A knot of 1,201 groups a side: best pair first would leave one row of either side alone."""
    n = 1200
    pairs = [(2 * i, 2 * i + 1, 6.0) for i in range(n + 1)] + [(2 * i, 2 * i + 3, 6.001) for i in range(n)]
    monkeypatch.setattr(M, "neighbour_links", lambda rows, window: spark.createDataFrame(pairs, "a long, b long, score double"))
    a, b = (spark.createDataFrame([(i, f"Title {i}", [], "J", "2020", None, None) for i in range(n + 1)], PUB) for _ in range(2))
    assert {(r["left_id"], r["right_id"]) for r in M.match_tables(a, b).collect()} == {(i, i) for i in range(n + 1)}


def test_match_tables(spark):
    left = [
        (1, T1, ["Doering J", "Roebuck R"], "Annals of Things", "2020", "60000001", None),
        (2, T1 + ".", ["Doering J"], "Ann Things", "2020", "PMID: 60000001", None),
        (3, T1 + " (2022 update)", ["Doering J"], "Annals of Things", "2020", None, None),
        (4, "Editorial", ["Poe P"], "Annals of Things", "2020", None, None),
        (5, None, None, None, None, None, None),
    ]
    right = [
        (1, T1.upper(), ["Roebuck, R.", "Doering, J."], "Ann. Things", "'20", None, None),
        (2, "Loss of ABCD12 restrians lipid turnover in obese …", ["Doering, Jane"], None, "2021", None, None),
        (3, T1 + " (2022 Update)", ["Doering, Jane; Roebuck R"], None, "in press", None, None),
        (4, "Editorial", ["Other O"], "Annals of Things", "2020", None, None),
        (5, "Nothing alike in this library at all today", [], "J", None, None, None),
        (6, "", None, None, None, None, None),
    ]
    pad = [(100 + i, f"Pad paper {i} about QZ{i} and drug{i}statin in cells", [f"Au{i} B"], "J", "2011", None, None) for i in range(50)]
    a, b = spark.createDataFrame(left + pad, PUB), spark.createDataFrame(right + pad, PUB)
    got = {(r["left_id"], r["right_id"]) for r in M.match_tables(a, b).collect()}
    assert {p for p in got if p[0] < 100} == {(1, 1), (2, 1), (1, 2), (2, 2), (3, 3)}
    assert {p for p in got if p[0] >= 100} == {(100 + i, 100 + i) for i in range(50)}
    assert M.match_tables(a.limit(0), b).count() == 0


def test_windows_do_not_depend_on_blocks(spark):
    data = [(i, f"Shared start of title number {i // 2} kappa{i // 2}stat", ["Doering J"], "J", "2020", None, None) for i in range(120)]
    rows = M.read_publications(spark.createDataFrame(data, PUB))
    a, b = ({(r["a"], r["b"]) for r in M.neighbour_links(rows, block=k).collect()} for k in (4096, 16))
    assert a == b and {(2 * i, 2 * i + 1) for i in range(60)} <= a


PEOPLE = ["Doe JA", "Jane Doe", "JANE A. DOE", "Doe, Jane", "Dr. Jane Doe, PhD", "Janie Doe"]


def test_name_variants(spark):
    names = [
        "Dabolemar RH", "Rebecca Dabolemar", "Becky Dabolemar", "R. Dabolemar", "DABOLEMAR, REBECCA H", "Dabolemmar RH", "Dabolemar Rebecca", "Rebecca Dabolemar, Jr.", "Rebecca  Dabolemar", "Dr. Rebecca Dabolemar",
        "Dabolemar DP", "Deborah Dabolemar", "Tanabuki MD", "Michael Tanabuki", "Mufipefi-Metadrezo VR", "Valentina Mufipefi", "et al.", "on behalf of the study group", "", " ", None,
    ]
    orgs = ["University of Ravomehel", "Univ. of Ravomehel", "RAVOMEHEL, UNIVERSITY OF", "Universtiy of Ravomeel", "Ravomehel State University", "Ravomehel Cancer Ctr.", "Cancer Centre of Ravomehel", "Dept. of Medicine, University of Ravomehel", "Ravomehel Institute of Technology", "Ravomehel Inst. of Tech."]
    df = spark.createDataFrame([("person", n) for n in names * 2] + [("org", n) for n in orgs], "kind string, name string")
    got = {(r["kind"], r["name_lo"], r["name_hi"]) for r in V.name_variants(df).collect()}

    def all_pairs(kind, group):
        return {(kind, *sorted((a, b), key=lambda s: s.encode())) for a in group for b in group if a != b}

    want = all_pairs("person", names[:10]) | all_pairs("person", names[10:12]) | all_pairs("person", names[12:14]) | all_pairs("person", names[14:16])
    want |= all_pairs("org", [orgs[i] for i in (0, 1, 2, 3, 7)]) | all_pairs("org", orgs[5:7]) | all_pairs("org", orgs[8:10])
    assert got == want
    assert V.name_variants(df.limit(0)).count() == 0


def test_all_strings_of_a_large_key_meet(spark):
    names = ["Dabolemar RH", "R. Dabolemar", "Rebecca Dabolemar", "Becky Dabolemar", "Rebecca Dabolemar-Tanabuki", "Roberta Dabolemar", "Dabolemar Rob", "Dabolemmar RH", "Rebecca H Dabolemmar", "DABOLEMAR, REBECCA Q"]
    df = spark.createDataFrame([("person", n) for n in names], "kind string, name string")
    one, cut = ({tuple(r) for r in V.name_variants(df, small=k).collect()} for k in (400, 2))
    assert one and one == cut


def test_misspelt_surnames():
    form = V.person_forms
    assert V.linked("person", form("Rebecca Dabolemar"), form("Rebecca Dabolemmar")) and V.linked("person", form("R Dabolemar"), form("Dabolemmar RH"))
    two = lambda a, b, n, m: V.linked("person", form(a), form(b), n, m)
    assert two("Rebecca Dabolemar", "Rebecca Dablemmar", 100, 10) and two("Rebecca Dabolemar", "Rebecca Dablemmar", 1, 10)
    assert not two("Rebecca Dabolemar", "Rebecca Dablemmar", 99, 10) and not two("R Dabolemar", "Dablemmar RH", 400, 1)


def test_parts_of_surnames_two_errors_apart(spark):
    """Parts are looked at even where the whole surnames are two letters apart."""
    assert V.same_surname(("de", "santos"), ("santos",)) == 1 and V.same_surname(("smith", "jones"), ("smyth", "jonas")) == 2
    assert V.same_surname(("dabolemar",), ("dablemmar",)) == -2 and V.same_surname(("dabolemar",), ("dabrummer",)) == 0
    df = spark.createDataFrame([("person", n) for n in ("de Santos, Rebecca", "Santos R", "Smith-Jones R", "Smyth-Jonas, Rebecca", "Santer R")], "kind string, name string")
    assert {tuple(r)[1:] for r in V.name_variants(df).collect()} == {("Santos R", "de Santos, Rebecca"), ("Smith-Jones R", "Smyth-Jonas, Rebecca")}


def test_links_do_not_depend_on_the_table(spark):
    """However often two spellings occur, they are linked as in a table of the two."""
    two = ["Rebecca Dabolemar", "Rebecca Dabolemmar"]
    more = [f"{g} {s}" for s in ("Dabolemar", "Dabolemmar") for g in ("Oskar", "Ulrike", "Yvonne", "Ignaz", "Kuno", "Tilda", "Wanda")]
    pairs = lambda names: {tuple(r)[1:] for r in V.name_variants(spark.createDataFrame([("person", n) for n in names], "kind string, name string")).collect()}
    assert tuple(two) in pairs(two) and tuple(two) in pairs(two + more)


ITEM = "Answer the question using only the passage below. Farmers supplying Zahelvamide hid spare ampoules of rinordecine for volunteers older than 637 minutes, which puzzled friends of XIZL9 when the grant lapsed. Does it hold?"
PASSAGE = ITEM.split("below. ")[1].rsplit(" Does", 1)[0]


def leaks(spark, *texts):
    items = spark.createDataFrame([(1, ITEM)] + [(i, f"Answer the question using only the passage below. Cooks near Kemi{i} burned every sample of drug{i}stat for volunteers older than {i} hours, ruling out G{i}A when the grant lapsed. Which?") for i in range(2, 30)] + [(99, None)], "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in E.find_leaks(docs, items).collect()}


def test_altered_passages(spark):
    w = PASSAGE.split()
    got = leaks(
        spark,
        "Before. " + PASSAGE + " After.",
        "x " + PASSAGE.upper().replace(",", ""),
        PASSAGE.replace("ampoules", "amp-\nou­les").replace("older than", "<em>older</em> [12] **than**"),
        PASSAGE.replace("a", "а").replace("o", "о"),
        PASSAGE.replace("spare", "green").replace("older", "taller"),
        " ".join(w[:7]),
        "Answer the question using only the passage below. Something else is told here in quite other words.",
        "> " + "\n> ".join(" ".join(w[i : i + 4]) for i in range(0, len(w), 4)),
        PASSAGE.replace("Zahelvamide", "Other").replace("rinordecine", "other").replace("637", "12").replace("XIZL9", "ABC1"),
        "", None, ("pad " * 40_000) + PASSAGE,
    )
    assert got == {(i, 1) for i in (0, 1, 2, 3, 4, 7, 8, 11)}  # 8: only single words differ


def passages(spark, items):
    words, usual, word = E.item_words(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", shared=30)
    return E.Passages({r["item_id"]: list(r["ws"]) for r in words.collect()}, usual, word)


def test_ordinary_words_leak_too(spark):
    heads, tails = ("the board of", "two nurses from", "some cooks near"), ("while page nine steps in heavy snow as minutes confirm", "until the counter read zero over that long weekend again")
    texts = [f"{h} town{i}{k} burned every sample of drug{i}{k} {t}" for i, h in enumerate(heads * 4) for k, t in enumerate(tails)]
    p = passages(spark, [*enumerate(texts), (100, texts[0]), (101, texts[0])])
    found = lambda text: {x[0] for x in E.leaked(E.runs_in(text, p), 12)}
    assert found("x burned every sample of drug00 while page nine steps in heavy snow as y") == {0, 100, 101}  # one telling word
    assert found("x burned every sample of drug00 while page seven steps in heavy snow as y") == {0, 100, 101}  # and a wrong one
    assert found("x burned every sample of other while page nine steps in heavy snow as y") == set()  # of many items, or of none
    assert found("the board of town00 burned every sample of drug00") == set()  # nine words


def test_twelve_ordinary_words_of_two_items(spark):
    text = "we asked for a little more time and the board of it was glad to wait"
    p = passages(spark, [(i, f"alpha{i} beta{i} {text} gamma{i} delta{i}") for i in range(4)] + [(i, f"other{i} words{i} here{i}") for i in range(4, 100)])
    assert set(text.split()) <= p.usual
    found = lambda text: {x[0] for x in E.leaked(E.runs_in(text, p), 12)}
    assert found("x " + text + " y") == {0, 1, 2, 3}
    assert found("x " + text.replace("time", "rope") + " y") == {0, 1, 2, 3}


def test_sets_of_items_do_not_change_the_result(spark):
    tails = [" ".join(f"quiet{j} rope{j}{m}" for m in range(5)) for j in range(6)]
    texts = [f"Use only the passage below to answer this. The board of town{i} burned every sample of drug{i} {tails[i // 2]} until {'one two three'.split()[i % 3]}" for i in range(12)]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before it all {t} after it all") for i, t in enumerate(texts)] + [(50, tails[0] + " until one more"), (51, texts[0].replace("drug0", "else").replace("town0", "there"))], "doc_id long, text string")
    one, cut = ({tuple(r) for r in E.find_leaks(docs, items, max_grams=n, spans=True).collect()} for n in (2_000_000, 20))
    assert one == cut and {(i, i) for i in range(12)} <= {x[:2] for x in one}


def test_cut_leaks(spark):
    docs = spark.createDataFrame([(1, "Kept before.\n" + PASSAGE.replace("ampoules", "<b>ampoules</b>") + "\nKept after."), (2, "nothing"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, "Another one that holds other words in all its places and is long enough")], "item_id long, text string")
    cut = E.cut_leaks(docs, E.find_leaks(docs, items, spans=True)).collect()
    assert [(r["doc_id"], r["spans"]) for r in cut] == [(1, 1)]
    assert cut[0]["text"].split() == "Kept before. Kept after.".split() and cut[0]["cut_chars"] >= len(PASSAGE)


def test_leaks_without_items(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert E.find_leaks(docs, items).count() == 0
    assert E.without_leaks(docs, E.find_leaks(docs, items)).count() == 1
