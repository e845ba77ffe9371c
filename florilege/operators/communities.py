"""Communities of a weighted graph by distributed local moving, and what is told about them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stash, unstash


def _moved(edges: DataFrame, degree: DataFrame, total: float, resolution: float, rounds: int, seed: int) -> DataFrame:
    """(node, c): nodes after rounds of local moving. ``degree``: node, k."""
    both = stash(edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    state = stash(degree.select("node", "k", F.col("node").alias("c")))
    for r in range(rounds):
        size = state.groupBy("c").agg(F.sum("k").alias("size"))
        pull = both.join(state.select(F.col("node").alias("b"), F.col("c").alias("to")), "b").groupBy(F.col("a").alias("node"), "to").agg(F.sum("weight").alias("w"))
        pull = pull.unionByName(state.select("node", F.col("c").alias("to"), F.lit(0.0).alias("w"))).groupBy("node", "to").agg(F.sum("w").alias("w"))
        cand = pull.join(state, "node").join(size.select(F.col("c").alias("to"), "size"), "to")
        here = F.col("to") == F.col("c")
        rest = F.col("size") - F.when(here, F.col("k")).otherwise(0.0)
        cand = cand.withColumn("gain", F.round(F.col("w") - resolution * F.col("k") * rest / total, 9))
        best = cand.groupBy("node").agg(
            F.max_by("to", F.struct(F.col("gain"), here.alias("s"), F.xxhash64("to").alias("h"))).alias("to"), F.max("gain").alias("gain"), F.max(F.when(here, F.col("gain"))).alias("stay")
        )
        turn = F.pmod(F.xxhash64("node", F.lit(seed), F.lit(r)), F.lit(2)) == 0
        nxt = stash(state.join(best, "node").select("node", "k", F.when(turn & (F.col("gain") > F.col("stay")), F.col("to")).otherwise(F.col("c")).alias("c"), (F.col("gain") > F.col("stay")).alias("open")))
        unstash(state)
        state = nxt.drop("open")
        if not nxt.where("open").limit(1).count():
            break
    return state.select("node", "c")


def communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 8, levels: int = 3, seed: int = 42) -> DataFrame:
    """(node, community) maximising modularity with a resolution, by local moving and merging.

    ``edges``: a, b, weight (undirected, one row a pair). Each round every node
    weighs its neighbours' communities with two aggregations and moves to the
    one with the largest gain; a random half of the nodes, by a hash of node and
    round, may move, so that neighbours don't swap forever. Ties and gains of
    zero keep the node. Communities then become the nodes of a smaller graph and
    move in their turn, up to ``levels`` times. All work is joins on node and
    community; nothing is gathered. A community is named by its smallest node.
    Nodes without an edge don't appear.
    """
    edges = edges.select("a", "b", F.col("weight").cast("double").alias("weight"))
    degree = stash(edges.select(F.explode(F.array("a", "b")).alias("node"), "weight").groupBy("node").agg(F.sum("weight").alias("k")))
    total = degree.agg(F.sum("k")).first()[0] or 1.0
    parts = None
    for level in range(levels):
        step = stash(_moved(edges, degree, total, resolution, rounds, seed + level))
        parts = step if parts is None else stash(parts.join(step.select(F.col("node").alias("c"), F.col("c").alias("to")), "c").select("node", F.col("to").alias("c")))
        if not step.where("node <> c").limit(1).count():
            break
        of = step.select("node", "c")
        e = edges.join(of.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(of.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b")
        edges = stash(e.where("ca <> cb").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("weight").alias("weight")))
        degree = stash(degree.join(of, "node").groupBy(F.col("c").alias("node")).agg(F.sum("k").alias("k")))
    name = parts.groupBy("c").agg(F.min("node").alias("community"))
    return parts.join(name, "c").select("node", "community")


def modularity(edges: DataFrame, parts: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: communities, modularity."""
    m = edges.agg(F.sum("weight").alias("m"))
    a = edges.join(parts.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(parts.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    inside = a.where("ca = cb").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("inside"))
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"), "weight").join(parts, "node").groupBy("community").agg(F.sum("weight").alias("k"))
    sq = ends.agg(F.sum(F.col("k") * F.col("k")).alias("sq"), F.count("*").alias("communities"))
    return m.crossJoin(inside).crossJoin(sq).select("communities", F.round(F.col("inside") / F.col("m") - resolution * F.col("sq") / (4 * F.col("m") * F.col("m")), 6).alias("modularity"))


def merge_tiny(edges: DataFrame, parts: DataFrame, least: int = 3) -> DataFrame:
    """Communities below ``least`` nodes join the larger community they share most weight with (ties: the smaller name); lone ones stay."""
    size = parts.groupBy("community").agg(F.count("*").alias("n"))
    a = edges.join(parts.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(parts.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b").where("ca <> cb")
    cross = a.select(F.col("ca").alias("x"), F.col("cb").alias("y"), "weight").unionByName(a.select(F.col("cb").alias("x"), F.col("ca").alias("y"), "weight"))
    big = size.where(F.col("n") >= least).select(F.col("community").alias("y"))
    tiny = size.where(F.col("n") < least).select(F.col("community").alias("x"))
    w = cross.join(tiny, "x", "left_semi").join(big, "y", "left_semi").groupBy("x", "y").agg(F.round(F.sum("weight"), 9).alias("w"))
    to = w.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("w"), "y"))).where("r = 1").select(F.col("x").alias("community"), F.col("y").alias("to"))
    return parts.join(to, "community", "left").select("node", F.coalesce("to", "community").alias("community"))


def related(edges: DataFrame, parts: DataFrame, top: int = 4) -> DataFrame:
    """(community, other, weight, rank): the communities a community shares most weight with."""
    a = edges.join(parts.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(parts.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b").where("ca <> cb")
    w = a.groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(F.round(F.sum("weight"), 6).alias("weight"))
    both = w.select(F.col("x").alias("community"), F.col("y").alias("other"), "weight").unionByName(w.select(F.col("y").alias("community"), F.col("x").alias("other"), "weight"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("weight"), F.desc("other")))).where(F.col("rank") <= top)


def central_members(edges: DataFrame, parts: DataFrame, top: int = 10) -> DataFrame:
    """(community, node, degree, rank): nodes with the largest weight to their own community."""
    a = edges.join(parts.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(parts.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b").where("ca = cb")
    d = a.select(F.explode(F.array("a", "b")).alias("node"), F.col("ca").alias("community"), "weight").groupBy("community", "node").agg(F.round(F.sum("weight"), 6).alias("degree"))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "node"))).where(F.col("rank") <= top)


def other_communities(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(node, others): the communities of a node's neighbours other than its own, sorted; nodes without any are left out."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("o")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("o")))
    j = ends.join(parts, "node").join(parts.select(F.col("node").alias("o"), F.col("community").alias("oc")), "o").where("community <> oc")
    return j.groupBy("node").agg(F.array_sort(F.collect_set("oc")).alias("others"))  # at most the communities


def bridges(edges: DataFrame, parts: DataFrame, top: int = 30) -> DataFrame:
    """(node, community, others, across): nodes that join most communities, by weight across them."""
    a = edges.join(parts.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(parts.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b").where("ca <> cb")
    out = a.select(F.col("a").alias("node"), F.col("ca").alias("community"), F.col("cb").alias("o"), "weight").unionByName(a.select(F.col("b").alias("node"), F.col("cb").alias("community"), F.col("ca").alias("o"), "weight"))
    g = out.groupBy("node", "community").agg(F.count_distinct("o").alias("others"), F.round(F.sum("weight"), 6).alias("across"))
    return g.orderBy(F.desc("others"), F.desc("across"), "node").limit(top)


def betweenness(edges: DataFrame, sources: DataFrame, held: int = 20_000_000) -> DataFrame:
    """(node, betweenness): share of shortest paths (by hops) from the ``sources`` that run through a node, largest scaled to 1.

    ``sources``: node. With all nodes as sources this is the exact measure; a
    sample gives an estimate. Breadth-first search runs from every source and
    dependencies are summed back hop by hop; paths of any length are followed.
    A graph of up to ``held`` edges, counted in both directions, is broadcast as
    two arrays of numbers and sources are spread over tasks; the work is sources
    times edges, and only sums by node are shuffled. A larger graph is searched
    by joins, with the same result, in tables of sources times nodes reached.
    """
    both = stash(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    n = both.count()
    total = (_paths_in_arrays if n <= held else _paths_by_joins)(both, sources) if n else None
    if total is None:
        return sources.select("node").limit(0).withColumn("betweenness", F.lit(0.0))
    g = stash(total.groupBy(F.col("v").alias("node")).agg(F.sum("dep").alias("x")))
    top = g.agg(F.max("x").alias("top"))
    return g.crossJoin(F.broadcast(top)).select("node", F.round(F.coalesce(F.col("x") / F.nullif(F.col("top"), F.lit(0.0)), F.lit(0.0)), 6).alias("betweenness"))  # top is one row


def _search(start: np.ndarray, near: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes reached from s, their dependencies) in a graph given by each node's first place among the neighbours."""
    n = len(start) - 1
    far, paths, dep = np.full(n, -1, "i4"), np.zeros(n), np.zeros(n)
    far[s], paths[s], front, hops, d = 0, 1.0, np.array([s]), [], 0
    while len(front):
        d += 1
        count = start[front + 1] - start[front]
        ends = np.cumsum(count)
        v = near[np.arange(ends[-1]) + np.repeat(start[front] - ends + count, count)]
        new = far[v] < 0
        v, u = v[new], np.repeat(front, count)[new]
        got = np.bincount(v, paths[u], minlength=n)
        front = np.flatnonzero(got)
        far[front], paths[front] = d, got[front]
        hops.append((u, v))
    for u, v in reversed(hops):
        dep += np.bincount(u, paths[u] / paths[v] * (1 + dep[v]), minlength=n)
    reached = np.flatnonzero(far > 0)
    return reached, dep[reached]


def _paths_in_arrays(both: DataFrame, sources: DataFrame) -> DataFrame:
    """(v, dep): dependencies summed by task, for a graph whose edges are held as numbers."""
    spark = both.sparkSession
    nodes = stash(both.select(F.col("a").alias("v")).distinct().withColumn("n", F.monotonically_increasing_id()))
    ends = both.join(nodes.select(F.col("v").alias("a"), F.col("n").alias("x")), "a").join(nodes.select(F.col("v").alias("b"), F.col("n").alias("y")), "b")

    def pack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            yield pd.DataFrame({"x": [p["x"].to_numpy("<i8").tobytes()], "y": [p["y"].to_numpy("<i8").tobytes()]})

    lots = ends.select("x", "y").mapInPandas(pack, "x binary, y binary").collect()
    x, y = (np.frombuffer(b"".join(r[c] for r in lots), "<i8") for c in ("x", "y"))
    names = np.unique(x)
    order = np.argsort(x, kind="stable")
    graph = spark.sparkContext.broadcast((np.searchsorted(x[order], np.r_[names, np.iinfo("i8").max]), np.searchsorted(names, y[order]).astype("i4"), names))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, near, names = graph.value
        dep, seen = np.zeros(len(names)), np.zeros(len(names), bool)
        for p in it:
            for s in np.searchsorted(names, p["n"].to_numpy("i8")):
                at, x = _search(start, near, int(s))
                dep[at] += x
                seen[at] = True
        yield pd.DataFrame({"n": names[seen], "dep": dep[seen]})

    tasks = 4 * spark.sparkContext.defaultParallelism  # a stated number: few bytes, much to search
    asked = nodes.join(sources.select(F.col("node").alias("v")).distinct(), "v", "left_semi").select("n").repartition(tasks, "n")
    return asked.mapInPandas(run, "n long, dep double").groupBy("n").agg(F.sum("dep").alias("dep")).join(nodes, "n").select("v", "dep")


def _paths_by_joins(both: DataFrame, sources: DataFrame) -> DataFrame | None:
    """(v, dep): dependencies by source and node; a table of (source, node, paths) grows by one join a hop and is written between hops."""
    front = stash(sources.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(1.0).alias("paths")).distinct())
    levels = [front]
    seen = front.select("s", "v")
    while True:
        step = front.join(both, F.col("v") == F.col("a")).groupBy("s", F.col("b").alias("v")).agg(F.sum("paths").alias("paths"))
        front = stash(step.join(seen, ["s", "v"], "left_anti"))
        if not front.limit(1).count():
            break
        levels.append(front)
        seen = seen.unionByName(front.select("s", "v"))
    total, below = None, None
    for front in reversed(levels[1:]):
        own = front if below is None else front.join(below, ["s", "v"], "left")
        own = stash(own.select("s", "v", "paths", (F.lit(0.0) if below is None else F.coalesce("dep", F.lit(0.0))).alias("dep")))
        total = own.select("v", "dep") if total is None else total.unionByName(own.select("v", "dep"))
        up = levels[levels.index(front) - 1].select("s", F.col("v").alias("u"), F.col("paths").alias("up"))
        share = own.join(both, F.col("v") == F.col("a")).select("s", F.col("b").alias("u"), "paths", "dep").join(up, ["s", "u"])
        below = share.groupBy("s", F.col("u").alias("v")).agg(F.sum(F.col("up") / F.col("paths") * (1 + F.col("dep"))).alias("dep"))
    return total
