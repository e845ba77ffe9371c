import numpy as np
import pytest
from pyspark.sql import functions as F

from florilege.operators import communities as C
from florilege.operators import components as U
from florilege.operators import dedup as D
from florilege.operators import fulltext as T
from florilege.operators import matching as M
from florilege.operators import neighbours as N
from florilege.operators import scoring as S
from florilege.operators import state as K


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


def test_components_random(spark):
    rng = np.random.default_rng(3)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(5, 5), (7, 8), (8, 7)]
    root = list(range(300))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in e:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = sorted((x, find(x)) for x in {v for p in e for v in p if p[0] != p[1]})
    df = spark.createDataFrame([*e, (None, 3)], "src long, dst long")
    assert rows(U.connected_components(df), "node", "component") == want


def test_components_path_and_empty(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
    assert {r["component"] for r in U.connected_components(path).collect()} == {0}
    assert U.connected_components(path.limit(0)).count() == 0


@pytest.mark.parametrize("failed,total,percent,want", [(0, 10, 50.0, False), (5, 10, 50.0, False), (6, 10, 50.0, True), (1, 10, 10.0, False), (2, 10, 10.0, True), (8, 10, 90.0, False), (10, 10, 90.0, True), (1, 1, 99.0, True), (1, 1, 100.0, False)])
def test_failure_gate(spark, failed, total, percent, want):
    df = spark.createDataFrame([("r", i < failed) for i in range(total)], "run string, bad boolean")
    assert S.failure_gate(df, ["run"], F.col("bad"), percent).first()["abort"] is want


def test_failure_gate_without_rows(spark):
    df = spark.createDataFrame([], "run string, bad boolean")
    assert S.failure_gate(df, ["run"], F.col("bad")).count() == 0


def test_sections_ignore_missing_scores(spark):
    df = spark.createDataFrame([(1, 3.0, None), (2, 2.9, 8.0), (3, 2.5, 7.5), (4, 2.4, 9.0), (5, None, 9.0), (6, float("nan"), 9.0), (7, 2.6, float("nan")), (8, 2.6, 8.0)], "id long, r double, s double")
    assert rows(S.sections(df, "r", "s", "id", slots=2), "id", "section") == [(1, "main"), (2, "wildcard"), (8, "wildcard")]


def test_canonical_rows(spark):
    df = spark.createDataFrame([(1, "a", 0, 9), (2, "a", 1, 1), (3, "b", 1, 1), (4, None, 1, 1), (5, "c", 1, 1), (6, "c", 1, 1), (7, "c", 1, 0)], "id long, g string, x int, y int")
    got = D.canonical_rows(df, F.col("g"), [F.col("x"), F.col("y")])
    assert rows(got, "group", "kept", "n", "runner_up", "decided_by") == [("a", 2, 2, 1, 1), ("c", 5, 3, 6, 0)]


def test_duplicate_groups_note_earlier_kinds(spark):
    df = spark.createDataFrame([(1, "7", None, "x" * 30), (2, "7", None, "x" * 30), (3, None, "10.1234/a", "y"), (4, None, "10.1234/A.", "z"), (5, "8", None, "w" * 30), (6, None, None, "w" * 30), (7, "7", "10.1234/b", "v" * 30), (8, None, "10.1234/b", "v" * 30)], "id long, pmid string, doi string, title string")
    got = {(r["kind"], r["n"], r["first"], r["seen"]) for r in D.duplicate_groups(D.paper_keys(df)).collect()}
    assert got == {("pmid", 3, 1, False), ("doi", 2, 3, False), ("doi", 2, 7, True), ("title", 2, 5, False), ("title", 2, 7, True)}


def test_unseen_ignores_null_keys(spark):
    new = spark.createDataFrame([(1, "a", None), (2, None, "d"), (3, None, None), (4, "b", "e")], "id long, pmid string, doi string")
    old = spark.createDataFrame([("a", None), (None, "e")], "pmid string, doi string")
    assert rows(D.unseen(new, old, ["pmid", "doi"]), "id") == [(2,), (3,)]


def test_merge_keeps_what_is_not_supplied(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, t string")
    new = spark.createDataFrame([("b", None, 5), ("c", "z", 6), (None, "q", 7)], "k string, t string, extra int")
    assert rows(K.merge_rows(base, new, "k")) == [("a", 1, "x"), ("b", 2, "y"), ("c", None, "z")]
    assert rows(K.delete_rows(base, spark.createDataFrame([("a",), ("a",)], "k string"), "k")) == [("b", 2, "y")]


def test_staged_table(spark, tmp_path):
    t = K.StagedTable(spark, f"file://{tmp_path}/t")
    assert t.read() is None
    t.publish(spark.range(200).toDF("id"))
    t.stage(spark.range(7).toDF("id"))  # never committed
    assert t.read().count() == 200
    with pytest.raises(ValueError):
        t.publish(spark.range(20).toDF("id"))
    assert t.read().count() == 200
    for n in (150, 160, 170):
        t.publish(spark.range(n).toDF("id"))
    assert t.read().count() == 170 and len(t.versions()) == 2
    a, b = (K.StagedTable(spark, f"file://{tmp_path}/t") for _ in "ab")
    a.publish(spark.range(180).toDF("id"))
    with pytest.raises(Exception):  # b has not read a's version: one of two writers fails
        b.commit(b.stage(spark.range(190).toDF("id")))
    assert b.read().count() == 180
    for n in (181, 182, 183):
        a.publish(spark.range(n).toDF("id"))
    b.seen = 1  # a number that was cleared
    with pytest.raises(Exception):
        b.commit(b.stage(spark.range(190).toDF("id")))
    assert a.read().count() == 183


def test_search_by_hand(spark):
    docs = spark.createDataFrame([(1, "Insulin in mice", "A"), (2, "insulins of mice and mice", "B"), (3, "nothing", None), (4, None, None)], "id long, text string, journal string")
    q = spark.createDataFrame([(1, "insulin mice"), (2, ""), (3, "zzz")], "query int, text string")
    got = rows(T.search(docs, q, "id", {"text": 1.0, "journal": 2.0}), "query", "id", "rank")
    assert got == [(1, 1, 2), (1, 2, 1)] or got == [(1, 1, 1), (1, 2, 2)]


def test_chunks_cover_the_text(spark):
    text = "".join(f"Sentence number {i} of the text. " + ("\n\n" if i % 9 == 0 else "") for i in range(800)) + "x" * 9000
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "short")], "id long, text string")
    got = sorted((r for r in T.chunk_text(df, "id", "text").collect()), key=lambda r: (r["id"], r["seq"]))
    mine = [r for r in got if r["id"] == 1]
    assert mine[0]["pos"] == 0 and mine[-1]["pos"] + mine[-1]["n_chars"] == len(text)
    assert all(r["n_chars"] <= 3200 and text[r["pos"] : r["pos"] + r["n_chars"]] == r["text"] for r in mine)
    assert all(a["pos"] < b["pos"] <= a["pos"] + a["n_chars"] for a, b in zip(mine, mine[1:]))
    assert [r["text"] for r in got if r["id"] == 4] == ["short"] and not [r for r in got if r["id"] in (2, 3)]


def test_snippet_takes_first_of_equals(spark):
    df = spark.createDataFrame([("a\nfoo\nb\nfoo bar\nc\nfoo bar\nd",), (None,)], "t string")
    got = T.snippets(df, "t", ["foo", "bar"]).collect()
    assert (got[0]["line"], got[0]["snippet"]) == (4, "b\nfoo bar\nc\nfoo bar") and got[1]["line"] == 1
    assert df.limit(1).select(T.numbered("t").alias("x")).first()["x"].startswith("1: a\n2: foo")


def test_rank_fusion(spark):
    df = spark.createDataFrame([(1, 7, 1, 2.0), (1, 7, 3, 1.0), (1, 8, 2, 1.0), (1, 9, 5, 1.0)], "query int, id long, rank int, weight double")
    got = {r["id"]: r["score"] for r in T.fuse_ranks(df, "id").collect()}
    assert got[7] == pytest.approx(2 / 61 + 1 / 63 + 0.05, abs=1e-6) and got[8] == pytest.approx(1 / 62 + 0.02, abs=1e-6) and got[9] == pytest.approx(1 / 65, abs=1e-6)


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 8))
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, [0.0] * 8), (901, None), (902, [float("nan")] * 8)]
    df = spark.createDataFrame(data, "id long, v array<double>")
    got = rows(N.nearest(df, df.where("id % 20 = 0"), "id", "v", 5, rows=32), "query", "id", "sim", "rank")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = []
    for q in range(0, 150, 20):
        s = np.round(u @ u[q], 6)
        s[q] = -2
        want += [(q, int(i), float(s[i]), k + 1) for k, i in enumerate(np.lexsort((np.arange(150), -s))[:5])]
    assert got == sorted(want)


def test_communities_of_two_cliques(spark):
    e = [(a, b, 1.0) for part in (range(0, 6), range(10, 16)) for a in part for b in part if a < b] + [(5, 10, 1.0), (20, 0, 0.1)]
    df = spark.createDataFrame(e, "a long, b long, weight double")
    parts = C.communities(df, rounds=12)
    by = dict(rows(parts))
    assert len({by[i] for i in range(6)}) == 1 and len({by[i] for i in range(10, 16)}) == 1 and by[0] != by[10]
    assert C.modularity(df, parts).first()["modularity"] > 0.4
    lone = spark.createDataFrame([(i, 0) for i in range(6)] + [(i, 10) for i in range(10, 16)] + [(20, 20)], "node long, community long")
    assert dict(rows(C.merge_tiny(df, lone)))[20] == 0
    assert C.bridges(df, lone).first()["node"] in (0, 5, 10)


def test_betweenness_of_known_graphs(spark):
    def of(e, sources=None):
        df = spark.createDataFrame([(a, b, 1.0) for a, b in e], "a long, b long, weight double")
        nodes = sorted({x for p in e for x in p}) if sources is None else sources
        return dict(rows(C.betweenness(df, spark.createDataFrame([(n,) for n in nodes], "node long"))))

    path = of([(0, 1), (1, 2), (2, 3), (3, 4)])
    assert path == {0: 0.0, 1: 0.75, 2: 1.0, 3: 0.75, 4: 0.0}
    star = of([(0, i) for i in range(1, 6)])
    assert star[0] == 1.0 and set(star.values()) == {0.0, 1.0}
    square = of([(0, 1), (1, 2), (2, 3), (3, 0)])
    assert set(square.values()) == {1.0}
    assert of([(0, 1)], sources=[]) == {}


def test_suggestions_against_all_pairs(spark):
    import random

    from florilege.operators import matching as M

    rng = random.Random(2)
    base = ["".join(rng.choice("abcdef") for _ in range(rng.randint(6, 14))) for _ in range(60)]

    def typed(s):
        s = list(s)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(s))
            s[i : i + 1] = rng.choice([[], [rng.choice("abcdef")], [s[i], "a"]])
            s = s or ["a"]
        return "".join(s)

    asked = sorted({typed(b) for b in base})
    a, k = spark.createDataFrame([(x,) for x in asked] + [(None,)], "n string"), spark.createDataFrame([(x,) for x in base], "n string")
    got = {(r["asked"], r["n"], r["distance"]) for r in M.suggestions(a, k, "n", 3, 1000).collect()}
    a.createOrReplaceTempView("a")
    k.createOrReplaceTempView("k")
    want = {tuple(r) for r in spark.sql("select distinct a.n, k.n, levenshtein(a.n, k.n) from a, k where levenshtein(a.n, k.n) <= 3 and length(a.n) >= 4").collect()}
    assert got == want


def test_cascade_and_fill(spark):
    from florilege.operators import matching as M

    a = spark.createDataFrame([(1, "p", None), (2, None, "x"), (3, None, None), (4, "q", "x")], "i long, p string, t string")
    b = spark.createDataFrame([(9, "p", "x"), (8, None, "x")], "j long, p string, t string")
    got = rows(M.cascade(a, b, "i", "j", [("number", F.col("p"), F.col("p")), ("title", F.col("t"), F.col("t"))]))
    assert got == [(1, 9, "number"), (2, 8, "title"), (4, 8, "title")]
    df = spark.createDataFrame([(1, " ", "k"), (2, None, "z"), (3, "c", None)], "k long, a string, b string")
    new = spark.createDataFrame([(1, "n", "m"), (3, "x", "y")], "k long, a string, b string")
    assert rows(M.fill_fields(df, new, "k", ["a", "b"]).na.fill("-")) == [(1, "n", "k", "a"), (2, "-", "z", ""), (3, "c", "y", "b")]
    twins = M.numbered_twins(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "i long, n string"), "n", "i")
    assert rows(twins, "unique_name") == [("a",), ("a-2",), ("b",)]


def test_similar_sets_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    sets = lambda n: [(i, rng.sample("abcdefghij", rng.randint(0, 6))) for i in range(n)]
    a, b = sets(60) + [(99, None)], sets(60)
    got = {(r["a"], r["b"]) for r in M.similar_sets(spark.createDataFrame(a, "a long, w array<string>"), spark.createDataFrame(b, "b long, w array<string>"), "a", "b", "w", 0.6).collect()}
    assert got == {(i, j) for i, x in a for j, y in b if x and y and len(set(x) & set(y)) / max(len(x), len(y)) >= 0.6 - 1e-9}


def test_confirmed(spark):
    title, long = "On rare fat", "Loss of alpha restrains beta turnover in gamma mice of delta"
    rows_ = [(1, title, ["Jane Doe"], "x  ON RARE\nfat. by Jane Doe"), (2, title, ["Ann Roe"], "on rare fat here"), (3, long + ".", None, "pad " * 90 + long.upper()), (4, long, [], "loss of alpha. it restrains much of the beta turnover here, in gamma rats of delta"), (5, long, [], "quite other words"), (6, None, None, "x"), (7, long, [], None)]
    df = spark.createDataFrame(rows_, "id long, t string, a array<string>, b string").select("id", M.confirmed(F.col("t"), F.col("a"), F.col("b")).alias("c"))
    assert {r["id"] for r in df.where("c").collect()} == {1, 3, 4}


def test_postings_upkeep(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, "c"), (3, None)], "id long, text string")
    old = T.postings(df, "id", ["text"])
    changed = spark.createDataFrame([(2, "d d"), (4, "e")], "id long, text string")
    now = T.update_postings(old, changed, spark.createDataFrame([(1,)], "id long"), "id", ["text"])
    assert rows(now, "id", "term", "tf") == [(2, "d", 2), (4, "e", 1)]


def test_word_chunks(spark):
    text = " ".join(f"w{i}" + (".\n" if i % 50 == 49 else "") for i in range(2000)) + "  "
    got = sorted((r for r in T.chunk_words(spark.createDataFrame([(1, text), (2, "short one"), (3, ""), (4, None)], "id long, text string"), "id", "text").collect()), key=lambda r: (r["id"], r["seq"]))
    mine = [r for r in got if r["id"] == 1]
    assert {r["id"] for r in got} == {1, 2} and [r["text"].split()[0] for r in mine] == [f"w{680 * k}" for k in range(len(mine))]
    assert all(r["text"].endswith(".\n") for r in mine[:-1]) and mine[-1]["text"].split()[-1] == "w1999." and max(r["n_tokens"] for r in mine) == 800
    covered = set().union(*(r["text"].split() for r in mine))
    assert len(covered) >= 1900


def test_inserts_guards_and_events(spark, tmp_path):
    base = spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>")
    new = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (None, [1.0, 1.0])], base.schema)
    assert [r["id"] for r in K.insert_new(base, new, "id").collect()] == [2]
    assert K.check_dimension(base, "v", 2) is False and K.check_dimension(base, "v", 3, acknowledged=True) is True and K.check_dimension(base.limit(0), "v", 3) is False
    with pytest.raises(ValueError):
        K.check_dimension(base, "v", 3)
    path = tmp_path / "report"
    path.mkdir()
    (path / "old.json").write_text("{this is not valid json")
    K.append_events(spark.createDataFrame([("fetch", "ok"), ("score", "abort")], "stage string, result string"), f"file://{path}")
    got = K.read_events(spark, f"file://{path}", "stage string, result string")
    assert rows(got, "stage", "result") == [("fetch", "ok"), ("score", "abort")]
    a, b = (spark.createDataFrame([(x,) for x in names], "slug string") for names in ("abc", "bd"))
    assert rows(K.stale_outputs(a, b, "slug"), "slug") == [("a",), ("c",)]


def test_glob_patterns():
    import re

    ok = lambda g, p: bool(re.match(T.glob_pattern(g), p))
    assert ok("a/*.md", "a/b.md") and not ok("a/*.md", "a/b/c.md") and ok("a/**", "a/b/c.md") and ok("{a,b}/?.md", "b/x.md") and not ok("a.md", "axmd")


def test_find_documents(spark):
    docs = spark.createDataFrame([(1, "aa00bb", "v/one.md"), (2, "aa00bb", "v/sub/two.md"), (3, None, "w/sub/two.md"), (4, "c0ffee", "top.md")], "id long, docid string, path string")
    asks = ["#AA00BB", "lib://v/sub/two.md", "sub/two.md", "two.md", "wo.md", "top.md", "", "c0ffee"]
    got = T.find_documents(spark.createDataFrame(list(enumerate(asks)), "ask int, name string"), docs, "ask", "name", "id")
    assert rows(got, "ask", "id", "how") == [(0, 1, "docid"), (1, 2, "path"), (2, 2, "suffix"), (3, 2, "suffix"), (4, None, "not found"), (5, 4, "path"), (6, None, "not found"), (7, 4, "docid")]


def test_shared_words_do_not_depend_on_blocks(spark):
    """Pairs of a frequent key are counted in blocks of any size; equal texts and pairs without a shared word are left out."""
    from florilege.operators import matching as M

    def side(step):
        data = [("hot" if i % 5 else f"k{i}", i, f"t{i * step}", sorted({f"w{i % 3}", f"w{i * step % 7}", f"v{i % 2}"}), None) for i in range(60)]
        return spark.createDataFrame(data, "key string, id long, text string, words array<string>, pos int")

    a, b = side(1), side(2)
    want = {(x["id"], y["id"], len(set(x["words"]) & set(y["words"]))) for x in a.collect() for y in b.collect() if x["key"] == y["key"] and x["text"] != y["text"] and set(x["words"]) & set(y["words"])}
    for block in (1024, 7):
        got = [(r["a"], r["b"], r["shared"]) for r in M.shared_words(a, b, block=block).collect()]
        assert len(got) == len(want) and set(got) == want


def test_similar_sets_of_frequent_words(spark):
    """Brute force on sets whose rare words are shared by many; every pair once."""
    import random

    from florilege.operators import matching as M

    r = random.Random(3)
    make = lambda: [(i, r.sample([f"w{j}" for j in range(12)], r.randint(0, 6))) for i in range(80)]
    x, y = make(), make()
    a, b = spark.createDataFrame(x, "i long, ws array<string>"), spark.createDataFrame(y, "j long, ws array<string>")
    got = [(g["i"], g["j"], round(g["overlap"], 6)) for g in M.similar_sets(a, b, "i", "j", "ws", 0.6).collect()]
    want = {(i, j, round(len(set(u) & set(v)) / max(len(u), len(v)), 6)) for i, u in x for j, v in y if u and v and len(set(u) & set(v)) >= 0.6 * max(len(u), len(v)) - 1e-9}
    assert len(got) == len(want) and set(got) == want


def test_betweenness_in_arrays_equals_joins(spark):
    """Both forms give the same on a random graph in several pieces; the array form needs no table of sources times nodes."""
    import random

    r = random.Random(1)
    e = {tuple(sorted(r.sample(range(40), 2))) for _ in range(60)} | {(100, 101), (101, 102)}
    df = spark.createDataFrame([(f"n{a}", f"n{b}", 1.0) for a, b in e], "a string, b string, weight double")
    src = spark.createDataFrame([(f"n{i}",) for i in (*range(0, 40, 3), 100, 999)], "node string")
    one, other = (dict(rows(C.betweenness(df, src, held=h))) for h in (20_000_000, 0))
    assert one == other and len(one) > 30 and max(one.values()) == 1.0


def test_runs_of_words_meet(spark):
    """Titles meet only documents that hold their words in a row, not all that hold the telling one."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"abc1 w{i} x y z".split()) for i in range(200)] + [(500, "q w7 abc1 x".split()), (501, []), (502, ["w7"])], "doc_id long, words array<string>")
    asked = spark.createDataFrame([(1, "abc1 w7 x".split()), (2, "w7 abc1".split()), (3, ["w7"]), (4, "abc1 x".split())], "id long, run array<string>")
    for bits in (25, 3):
        assert {tuple(r) for r in T.meet_runs(docs, asked, "doc_id", "id", bits=bits).collect()} == {(7, 1), (500, 2), (7, 3), (500, 3), (502, 3), (500, 4)}
    run = lambda i: T.run_around(F.array(*(F.lit(c) for c in "abcde")), F.lit(i), 3)
    assert [list(r) for r in spark.range(1).select(run(0), run(2), run(4)).collect()[0]] == [list("abc"), list("bcd"), list("cde")]
