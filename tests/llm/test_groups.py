import pytest
from pyspark.sql import functions as F

from florilege.llm import mixing as M
from florilege.llm import splitting as S
from florilege.llm import survivor as B
from florilege.llm import tokens as K
from florilege.llm import topn as T


def test_top_n(spark):
    nan = float("nan")
    data = [("a", 1.0, 5, "x"), ("a", 1.0, 2, "y"), ("a", 1.0, 2, "y"), ("a", 3.0, 9, None), ("a", nan, 1, "z"), ("a", None, 1, "z"), (None, 9.0, 1, "z"), ("b", 0.0, None, "z"), ("b", -1.0, 7, "z")]
    df = spark.createDataFrame(data, "g string, s double, i long, score string").repartition(3)
    got = sorted((r["g"], r["s"], r["i"]) for r in T.top_n_per_group(df, ["g"], "s", "i", 3).collect())
    assert got == [("a", 1.0, 2), ("a", 1.0, 2), ("a", 3.0, 9), ("b", -1.0, 7)]
    assert T.top_n_per_group(df.limit(0), ["g"], "s", "i", 3).count() == 0


def test_top_n_hot_group_equals_window(spark):
    df = spark.range(5000).select((F.col("id") % 7).cast("string").alias("h"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), ((F.col("id") * 7919) % 101).cast("double").alias("s"), "id")
    got = {(r["g"], r["id"]) for r in T.top_n_per_group(df.repartition(5), ["g"], "s", "id", 5).collect()}
    df.createOrReplaceTempView("t")
    want = {(r["g"], r["id"]) for r in spark.sql("select g, id from (select *, row_number() over (partition by g order by s desc, id) r from t) where r <= 5").collect()}
    assert got == want


FIELDS = {"status": ("vs", "qs"), "text": ("vt", "qt")}


def survive(spark, data):
    df = spark.createDataFrame(data, "k string, id long, source string, vs string, qs double, vt string, qt double")
    return {r["k"]: (r["id"], r["complete"], r["strictly"]) for r in B.surviving_rows(df, "k", "id", FIELDS, "source").collect()}


def test_survivor(spark):
    data = [
        ("a", 1, "s1", "ready", 8.0, "t", 8.0), ("a", 2, "s2", "saved", 0.0, "t", 8.0),
        ("b", 3, "s1", "ready", 8.0, None, 0.0), ("b", 4, "s2", "saved", 0.0, "u", 8.0),
        ("c", 5, None, "ready", 8.0, "t", 8.0), ("c", 6, "s3", "ready", 8.0, "t", 8.0),
        ("d", 7, "s1", "ready", 8.0, "t", 8.0), (None, 8, "s1", "ready", 8.0, "t", 8.0), (None, 9, "s1", "ready", 8.0, "t", 8.0),
        ("e", 10, "s1", None, 0.0, None, 0.0), ("e", 11, "s1", None, 0.0, None, 0.0),
    ]
    got = survive(spark, data)
    assert got["a"] == (1, True, True) and got["b"][1:] == (False, False) and got["c"] == (5, True, False)
    assert "d" not in got and None not in got


def test_copied_votes_are_discounted(spark):
    rows = []
    for k in range(30):  # x and its copier y share false values; three independent sources mostly agree
        for s, v in (("a", "t"), ("b", "t"), ("c", "t" if k % 3 else "w"), ("x", f"f{k}" if k % 2 else "t"), ("y", f"f{k}" if k % 2 else "t")):
            rows.append((str(k), "f", v, s, 0.0))
    c = spark.createDataFrame(rows, "key string, field string, value string, source string, quality double")
    won = {r["key"]: r["value"] for r in B.fuse_claims(c).where("wins").collect()}
    assert set(won.values()) == {"t"}
    assert B.fuse_claims(c.limit(0)).count() == 0


def test_differing_values_speak_against_copying(spark):
    """y shares x's false values and nothing else (a copier); z shares as many but differs elsewhere."""
    rows = []
    for k in range(12):
        for s in ("a", "b", "c"):
            rows.append((str(k), "f", "t", s, 0.0))
        rows += [(str(k), "f", f"w{k}", s, 0.0) for s in ("x", "y")]
    base = spark.createDataFrame(rows, "key string, field string, value string, source string, quality double")
    conf = lambda df: {(r["key"], r["value"]): r["confidence"] for r in B.fuse_claims(df).collect()}
    assert max(v for (k, w), v in conf(base).items() if w.startswith("w")) < 0.2
    # quality is a prior that votes cannot outweigh, and decides nothing between equals
    better = spark.createDataFrame([("k", "f", "new", "x", 2.0), *(("k", "f", "old", s, 1.0) for s in "abcdefgh"), ("j", "f", "u", "a", 1.0), ("j", "f", "u", "b", 1.0), ("j", "f", "v", "c", 1.0)], base.schema)
    assert {(r["key"], r["value"]) for r in B.fuse_claims(better).where("wins").collect()} == {("k", "new"), ("j", "u")}


def test_fusion_decides_the_survivors(spark, monkeypatch):
    """p3 rests on the posteriors: with claims fused to nothing, other rows come out."""
    data = [("a", 1, "s1", "ready", 1.0, "t", 1.0), ("a", 2, "s2", "saved", 0.0, None, 0.0)]
    assert survive(spark, data)["a"] == (1, True, True)
    real = B.fuse_claims
    monkeypatch.setattr(B, "fuse_claims", lambda c: real(c).withColumn("wins", F.lit(False)))
    assert survive(spark, data)["a"][2] is False


def test_fused_record(spark):
    data = [("a", 1, "s1", "ready", 1.0, "t", 1.0), ("a", 2, "s2", "saved", 0.0, "u", 1.0), ("a", 3, "s3", None, 0.0, "u", 1.0), ("b", 4, "s1", None, 0.0, None, 0.0), ("b", 5, "s1", None, 0.0, None, 0.0)]
    df = spark.createDataFrame(data, "k string, id long, source string, vs string, qs double, vt string, qt double")
    got = {r["k"]: r for r in B.surviving_rows(df, "k", "id", FIELDS, "source").collect()}
    assert (got["a"]["best_status"], got["a"]["best_text"]) == ("ready", "u") and got["b"]["best_status"] is None and not got["b"]["strictly"]


def test_budget_tree():
    leaf = lambda d, l, s, t, w, m: {"domain": d, "language": l, "source": s, "tokens": t, "weight": w, "max_repeats": m}
    total, out = M.budgets([leaf("d1", "en", "a", 100, 0.5, 1), leaf("d1", "en", "b", 1000, 0.2, 1), leaf("d2", "en", "c", 1000, 0.3, 1)], 400.0)
    assert [round(x["budget"]) for x in out] == [100, 180, 120]  # a's shortage goes to its sibling b
    total, out = M.budgets([leaf("d", "en", "a", 100, 0.5, 2), leaf("d", "en", "b", 1000, 0.5, 1)], None)
    assert total == 400 and [x["budget"] for x in out] == [200, 200]
    assert M.budgets([], None)[0] == 0


def test_mix(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "small").when(F.col("id") % 3 == 1, "big").otherwise(None).alias("source"), F.when(F.col("id") % 5 == 0, " EN ").otherwise("en").alias("lang"), (F.when(F.col("id") % 3 == 0, 1).otherwise(9) + F.col("id") % 4).alias("n_tokens"))
    targets = spark.createDataFrame([("small", 0.4, 3), ("big", 0.6, 1), ("gone", 0.0, 5)], "source string, target_share double, max_repeats int")
    chosen, report = M.mix(docs, targets)
    r = {x["source"]: x for x in report.collect()}
    assert abs(r["small"]["actual_share"] - 0.4) < 0.01 and abs(r["big"]["actual_share"] - 0.6) < 0.01 and r["gone"]["used_tokens"] == 0
    assert chosen.where("repeats > 3 or source is null").count() == 0
    assert chosen.where("source = 'big' and repeats > 1").count() == 0
    again = M.mix(docs, targets)[0]
    assert chosen.exceptAll(again).count() == 0 == again.exceptAll(chosen).count()
    assert M.mix(docs.limit(0), targets)[0].count() == 0


def test_shortages_stay_in_the_domain(spark):
    """short holds 1,000 tokens, twice; what it lacks of 8,000 goes to its sibling, the other domain keeps its share."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 100, "short").when(F.col("id") < 1500, "sibling").otherwise("other").alias("source"), F.lit("en").alias("lang"), F.lit(10).alias("n_tokens"))
    targets = spark.createDataFrame([("short", 0.4, 2), ("sibling", 0.2, 1), ("other", 0.4, 1)], "source string, target_share double, max_repeats int")
    used = lambda **kw: {r["source"]: r["used_tokens"] for r in M.mix(docs, targets, 20_000.0, **kw)[1].collect()}
    assert used(domains={"short": "one", "sibling": "one"}) == {"short": 2000, "sibling": 10_000, "other": 8000}
    flat = used()
    assert flat["short"] == 2000 and abs(flat["sibling"] - 6000) <= 10 and abs(flat["other"] - 12_000) <= 10


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world", 5), (2, "", 6), (3, None, 7), (4, "a" * 250_000, 8)], "id long, text string, n long")
    got = {r["id"]: r["n_tokens"] for r in M.with_token_counts(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1000


def test_range_maximum_ties_go_right():
    import numpy as np

    rng = np.random.default_rng(0)
    s = rng.integers(-1, 4, 200).astype("i1")
    t = S.StrongestCut(s)
    for _ in range(300):
        a, b = sorted(rng.integers(0, 200, 2))
        w = s[a : b + 1]
        assert t.query(int(a), int(b)) == a + max(i for i in range(len(w)) if w[i] == w.max())


TEXTS = [
    "# A\n\n" + "One sentence here. " * 300 + "\n\n# B\n\nMore. " + "word " * 900,
    "x" * 9000,
    "日本語のテキスト。" * 400,
    "naïve café 🙂 " * 500,
    "line\r\nline two\r\n\r\n" * 400,
    "short text",
    "",
    None,
]


def test_pieces(spark):
    limit, overlap = 128, 16
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("piece", F.lit("clash"))
    got = S.split_oversized(df, limit=limit, overlap=overlap).collect()
    enc, _ = K.load()
    assert {r["doc_id"] for r in got} == {0, 1, 2, 3, 4}
    for d in range(5):
        mine = sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["piece"])
        whole = TEXTS[d]
        assert [r["piece"] for r in mine] == list(range(mine[0]["n_pieces"]))
        assert mine[0]["start_char"] == 0 and mine[-1]["end_char"] == len(whole)
        for r in mine:
            assert r["n_tokens"] <= limit and r["text"] == whole[r["start_char"] : r["end_char"]] and r["text"]
        for a, b in zip(mine, mine[1:]):
            assert a["start_char"] < b["start_char"] <= a["end_char"]
            assert len(enc.encode_ordinary(whole[b["start_char"] : a["end_char"]])) <= overlap + 2
    first = min((r for r in got if r["doc_id"] == 0), key=lambda r: r["piece"])
    assert first["text"].rstrip().endswith(".")
    with pytest.raises(ValueError):
        S.split_oversized(df, limit=100, overlap=90)
