import numpy as np
import pandas as pd
import pytest

from florilege.llm import vectors as V

RNG = np.random.default_rng(5)


def clustered(n_groups=12, size=9, noise=150, dims=64):
    parts, rng = [], np.random.default_rng(2)
    for _ in range(n_groups):
        c = rng.normal(size=dims)
        parts.append(c / np.linalg.norm(c) + rng.normal(size=(size, dims)) * 0.035)
    parts.append(rng.normal(size=(noise, dims)))
    return np.concatenate(parts)


def frame(spark, x, ids=None):
    codes, ok = V.encode(x)
    ids = np.arange(1, len(x) + 1) if ids is None else ids
    return spark.createDataFrame(pd.DataFrame({"vec_rowid": np.asarray(ids)[ok], "code": [c.tobytes() for c in codes[ok]]}), "vec_rowid long, code binary")


def cosines(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    return s


def test_live_vectors(spark):
    dims = 64
    a = RNG.normal(size=(4, dims)).astype("<f4")
    a[1] = 0
    a[2, 3] = np.nan
    chunks = spark.createDataFrame([(1, a.tobytes(), "x"), (2, a.tobytes()[:700], "x"), (3, None, "x")], "chunk_id long, vectors binary, id string")
    rows = spark.createDataFrame([(10, "p", 1, 0), (11, "q", 1, 1), (12, "r", 1, 2), (13, "s", 1, 3), (14, "t", 2, 2), (15, "u", 3, 0), (16, "v", 9, 0), (17, "w", 2, 0), (18, "y", None, 0), (19, "z", 1, 77)], "vec_rowid long, id string, chunk_id long, chunk_offset int")
    got = {r["vec_rowid"]: np.frombuffer(r["code"], "<i2") for r in V.live_vectors(chunks, rows).collect()}
    assert sorted(got) == [10, 13, 17]
    u = got[13] / np.linalg.norm(got[13].astype(float))
    assert abs(u @ (a[3] / np.linalg.norm(a[3])) - 1) < 1e-7
    assert V.live_vectors(chunks.limit(0), rows).count() == 0


@pytest.mark.parametrize("candidates,block", [(5120, 8192), (60, 16), (200, 40)])
def test_forest_recall(spark, candidates, block):
    x = clustered()
    got = {(r["id"], r["nbr"]): r["cos"] for r in V.forest_neighbours(frame(spark, x), candidates=candidates, block=block, trees=6).collect()}
    s = cosines(x)
    want = {(i + 1, int(j) + 1) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), -s[i]))[:5] if s[i, j] >= 0.8}
    assert len(want & set(got)) >= 0.9 * len(want)
    assert all(abs(c / 1e6 - s[a - 1, b - 1]) < 3e-5 and s[a - 1, b - 1] >= 0.7999 for (a, b), c in got.items())


def nearest(x, k=5, least=0.8):
    s = cosines(x)
    return {(i + 1, int(j) + 1) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), -s[i]))[:k] if s[i, j] >= least}


def test_forest_of_long_prefixes(spark):
    """So few candidates, as with prefixes in a hundred times the vectors, still lead to the whole lists."""
    x = clustered(60, 14, 2000)
    got = {(r["id"], r["nbr"]) for r in V.forest_neighbours(frame(spark, x), trees=5, candidates=10).collect()}
    want = nearest(x)
    assert len(want & got) >= 0.98 * len(want) and len(want & got) >= 0.98 * len(got)


@pytest.mark.parametrize("small,block", [(4096, 8192), (20, 30), (20, 7)])
def test_neighbours_in_components(spark, small, block):
    """A chain of pairs is enough for the exact lists of a component of any size, in blocks or whole."""
    rng = np.random.default_rng(4)
    heads = rng.normal(size=(6, 64)) * 3
    x = np.concatenate([h + rng.normal(size=(n, 64)) for h, n in zip(heads, (90, 41, 30, 12, 3, 2))] + [np.repeat(heads[:1], 4, axis=0)])
    df, group = frame(spark, x).withColumnRenamed("vec_rowid", "id"), np.r_[np.repeat(range(6), (90, 41, 30, 12, 3, 2)), np.zeros(4, int)]
    near = [(a + 1, np.array([(b + 1, 0)], V.PAIR).tobytes()) for g in range(6) for a, b in zip(np.flatnonzero(group == g)[:-1].tolist(), np.flatnonzero(group == g)[1:].tolist())]
    got = {(r["id"], r["nbr"]) for r in V.neighbours_in_components(df, spark.createDataFrame(near, "id long, near binary"), small=small, block=block).collect()}
    assert got == nearest(V.encode(x)[0].astype("f8")) and len(got) >= 800


def test_forest_blocks_do_not_change_the_result(spark):
    """A crowd under one string is cut into parts, and sparse queries beside it still meet all of it."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=64) + rng.normal(size=(90, 64)) * 1e-4, rng.normal(size=(60, 64)), clustered(4, 6, 0)])
    one, cut = ({tuple(r) for r in V.forest_neighbours(frame(spark, x), candidates=50, block=b).collect()} for b in (8192, 10))
    assert one == cut and len(one) >= 90 * 5


def test_census_levels():
    counts = np.zeros((2, 1 << 10), "i8")
    counts[0, 5], counts[0, 6], counts[1, 900] = 40, 3, 7
    c = V.Census(counts, 10)
    assert c.parts[0, 5] == 4 and c.length[0, 5] == 10 and c.start[0, 6] == 6 and c.length[1, 900] == 0
    strings = np.array([[5, 6, 6], [900, 900, 100]])
    assert c.levels(strings, 45).tolist() == [10, 8, 0]  # the third stands alone in the second tree
    assert c.levels(strings, 1000).tolist() == [0, 0, 0]


def test_forest_copies_and_ties(spark):
    one = RNG.normal(size=64)
    x = np.concatenate([np.repeat(one[None], 40, axis=0), RNG.normal(size=(3, 64)), (one * 3)[None]])
    got = {}
    for r in V.forest_neighbours(frame(spark, x)).collect():
        got.setdefault(r["id"], []).append(r["nbr"])
    assert sorted(got[1]) == [2, 3, 4, 5, 6] and sorted(got[40]) == [1, 2, 3, 4, 5] and sorted(got[44]) == [1, 2, 3, 4, 5]
    assert not {41, 42, 43} & set(got)
    assert V.forest_neighbours(frame(spark, x).limit(0)).count() == 0


def components(s, least, smallest):
    n, root = len(s), list(range(len(s)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in zip(*np.nonzero(s >= least)):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    of = [find(a) for a in range(n)]
    return {(of[a] + 1, a + 1) for a in range(n) if of.count(of[a]) >= smallest}


def test_clusters_against_brute_force(spark):
    x = clustered()
    got = {(r["cluster_key"], r["vec_rowid"]) for r in V.similarity_clusters(frame(spark, x)).collect()}
    assert got == components(cosines(x), 0.8, 3)
    assert V.similarity_clusters(frame(spark, x).limit(0)).count() == 0


def test_clusters_far_from_centres(spark):
    rng = np.random.default_rng(8)
    heads = rng.normal(size=(150, 64))
    heads /= np.linalg.norm(heads, axis=1, keepdims=True)
    parts = [heads, rng.normal(size=(3000, 64))]
    for _ in range(3):  # chains with cosines a little above 0.80
        side = rng.normal(size=heads.shape)
        side -= (side * heads).sum(axis=1, keepdims=True) * heads
        heads = 0.82 * heads + np.sqrt(1 - 0.82**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
        parts.append(heads)
    x = np.concatenate(parts)
    df, want = frame(spark, x), components(cosines(x), 0.8, 3)
    assert len(want) >= 600
    assert {(r["cluster_key"], r["vec_rowid"]) for r in V.similarity_clusters(df).collect()} == want
    centres = V.kmeans_centres(df, 20)
    links = V.similarity_links(df, centres, cells=1).unionByName(V.links_between_cells(df, centres, block=400, part=150))
    got = {(r["component"], r["node"]) for r in V.connected_components(links).collect()}
    assert got == components(cosines(x), 0.8, 2)


def test_links_between_balls(spark):
    """Groups that cells cut through are compared as balls; links of single vectors into a ball, and between balls, are all found."""
    rng = np.random.default_rng(12)
    heads = rng.normal(size=(40, 64))
    heads /= np.linalg.norm(heads, axis=1, keepdims=True)
    near = np.repeat(heads, 25, axis=0) + rng.normal(size=(1000, 64)) * 0.033
    edge = 0.82 * heads + 0.57 * np.roll(heads, 1, axis=0)
    x = np.concatenate([near, edge, rng.normal(size=(300, 64))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    ball = V._balls(u.astype("f4"), 0.8)
    assert (ball[:1000] >= 0).mean() > 0.9 and (ball[-300:] < 0).all()
    assert all((u[ball == b] @ u[ball == b].mean(axis=0)).min() > 0.9 * np.linalg.norm(u[ball == b].mean(axis=0)) for b in set(ball[ball >= 0].tolist()))
    df = frame(spark, x)
    centres = V.unit(rng.normal(size=(30, 64)))  # fit nothing
    got = {}
    for block, part in ((16384, 4096), (400, 100)):
        links = V.similarity_links(df, centres, cells=1).unionByName(V.links_between_cells(df, centres, block=block, part=part))
        got[part] = {(r["component"], r["node"]) for r in V.connected_components(links).collect()}
    assert got[4096] == got[100] == components(cosines(x), 0.8, 2)


def test_links_in_blocks_equal_links_at_once(spark):
    x = np.concatenate([clustered(3, 60, 40), clustered(1, 4, 1)])
    df = frame(spark, x)
    centres = V.kmeans_centres(df, 5)
    from florilege.operators.components import connected_components

    parts = [{(r["node"], r["component"]) for r in connected_components(V.similarity_links(df, centres, cells=5, slack=9, block=b)).collect()} for b in (4096, 16)]
    assert parts[0] == parts[1]
    assert {n for n, _ in parts[0]} == {b for _, b in components(cosines(x), 0.8, 2)}


def test_typical_members(spark):
    x = clustered(2, 9, 0)
    df = frame(spark, x)
    got = V.typical_members(df, V.similarity_clusters(df)).collect()
    assert len(got) == 6 and {r["size"] for r in got} == {9} and all(r["cosine"] > 0.8 for r in got)


def test_hashed_features(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "Alpha, beta gamma delta!"), (3, "quite other words here"), (4, ""), (5, None)], "k long, t string")
    got = {r["vec_rowid"]: np.frombuffer(r["code"], "<i2").astype(float) for r in V.hashed_features(df, "k", "t").collect()}
    assert sorted(got) == [1, 2, 3]
    assert np.allclose(got[1], got[2]) and abs(got[1] @ got[3]) < 0.8 * np.linalg.norm(got[1]) * np.linalg.norm(got[3])
