"""Matching two tables that share no key: sorted neighbourhoods, weighted similarities, one-to-one assignment."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import stash
from . import names as N
from .linkage import PREPRINT_SERVERS, _pmid, doi_slug

ROW = "node long, words string, edition string, cut boolean, head int, people string, journal string, year int, known string"
_COLS = [c.split()[0] for c in ROW.split(", ")]


def read_publications(df: DataFrame) -> DataFrame:
    """Comparable form of ``df``: node, title, authors, journal, year (any notation), pmid, doi; all but node may be NULL.

    ``known`` lists identifiers that two rows of one table may share.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            rows = []
            for node, title, authors, journal, year, pmid, doi in zip(p["node"], p["title"], p["authors"], p["journal"], p["year"], p["pmid"], p["doi"]):
                w, edition, cut, head = N.title_words(title)
                people = " ".join(",".join(x) for x in N.person_tokens(authors))
                j = [] if not journal else [x[:3] for x in re.findall(r"[a-z]+", N.fold(journal)) if x not in ("the", "of", "and", "in", "on", "for")]
                if "".join(re.findall(r"[a-z]+", (journal or "").lower())) in PREPRINT_SERVERS:
                    j, year = [], None
                m = re.search(r"\d{4}", year or "")
                short = re.search(r"'(\d{2})\b", year or "")
                y = int(m.group()) if m else 2000 + int(short.group(1)) if short else -1
                known = [x for x in ("p" + _pmid(pmid, None), "d" + doi_slug(doi)) if len(x) > 1]
                rows.append((node, " ".join(w), edition, cut, head, people, " ".join(j), y, " ".join(known)))
            yield pd.DataFrame(rows, columns=_COLS)

    return df.where("node is not null").select("node", "title", "authors", "journal", F.col("year").cast("string").alias("year"), "pmid", "doi").mapInPandas(run, ROW)


def sort_keys(words: str, people: str, year: int, journal: str) -> list[str]:
    """Composite sort keys: the title from its start, from its end, its most telling words first (with a digit, then the longest), and the first author.

    Behind the title stand author, year and journal, so that of many rows under
    one title those that agree in more stand together.
    """
    w = words.split()
    if not w:
        return []
    whole = "".join(x for x in w if x not in N.SMALL)
    telling = sorted({x for x in w if len(x) > 2}, key=lambda x: (not (x[0].isalpha() and any(c.isdigit() for c in x)), -len(x), x))
    who = min(people.replace(",", " ").split(), default="")
    rest = f"|{who}|{year}|{journal}"
    out = ["0" + whole[:60] + rest, "1" + whole[::-1][:60] + rest, "2" + " ".join(telling[:4])[:60] + rest, "3" + " ".join(telling[1:5])[:60] + rest]
    if people:
        out.append("4" + f"{people.split(' ')[0].split(',')[0][:8]}|{year}|{' '.join(telling[:2])[:40]}")
    return out


def same_journal(a: str, b: str) -> int:
    """1: one and the same but for abbreviation, 0: another, -1: not given."""
    x, y = a.split(), b.split()
    if not x or not y:
        return -1
    return int(len(x) == len(y) and all(p.startswith(q) or q.startswith(p) or N.near(p, q, 1) for p, q in zip(x, y)))


#: Weights of the fields' levels, in log-odds.
WEIGHTS = {
    "title": {3: 6.0, 2: 5.0, 1: 3.0},
    "people": {2: 2.5, 1: 1.0, 0: -4.0, -1: 0.0},
    "journal": {1: 1.5, 0: -1.5, -1: 0.0},
    "year": {0: 1.5, 1: 0.0, 2: -4.0, -1: 0.0},
    "edition": {1: 0.5, -1: -1.0},
}


def weigh(x: tuple, y: tuple) -> float | None:
    """Log-odds that two rows are one publication; None where the title or the edition forbids it."""
    _, wx, ex, cx, hx, px, jx, yx, kx = x
    _, wy, ey, cy, hy, py, jy, yy, ky = y
    a, b = wx.split(), wy.split()
    if kx and ky and kx == ky:
        return 12.0
    if min(len(a), len(b)) < 4:  # headings
        if a != b or not a or not px or px != py or jx != jy or yx != yy:
            return None
    title = N.same_titles(a, b, cx, cy, hx, hy)
    if not title:
        return None
    edition = 1 if ex == ey else -1 if title == 1 and not (ex and ey) else 0
    if not edition:
        return None
    p, q = ({w for g in s.split(" ") for w in g.split(",") if w} for s in (px, py))
    people = -1
    if p and q:
        hit = sum(any(N.near(v, w, 1) for w in q) for v in p)
        people = 2 if 2 * hit >= min(len(p), len(q)) else 1 if hit else 0
    year = -1 if yx < 0 or yy < 0 else min(2, abs(yx - yy))
    return WEIGHTS["title"][title] + WEIGHTS["people"][people] + WEIGHTS["journal"][same_journal(jx, jy)] + WEIGHTS["year"][year] + WEIGHTS["edition"][edition]


def _alike(titles: list[str], window: int) -> np.ndarray:
    """[i, d]: do titles i and i + d + 1 share half of the long words of the shorter? All pairs of the windows at once."""
    number: dict[str, int] = {}
    bags = [[number.setdefault(w, len(number)) for w in {x for x in t.split() if len(x) > 3}] for t in titles]
    n, width = len(bags), max(map(len, bags), default=0)
    size = np.array([len(b) for b in bags], "i4")
    m = np.full((n, max(width, 1)), -1, "i4")
    for i, b in enumerate(bags):
        m[i, : len(b)] = b
    out = np.zeros((n, window - 1), bool)
    for d in range(min(window - 1, n - 1)):
        for a in range(0, n - d - 1, 1024):
            x, y = m[a : min(a + 1024, n - d - 1)], m[a + d + 1 : a + d + 1 + 1024][: n - d - 1 - a]
            shared = ((x[:, :, None] == y[:, None, :]) & (x[:, :, None] >= 0)).sum(axis=(1, 2))
            out[a : a + len(x), d] = 2 * shared >= np.minimum(size[a : a + len(x)], size[a + d + 1 : a + d + 1 + len(x)])
    return out


def _known(ids: list[str], window: int) -> np.ndarray:
    """[i, d]: do rows i and i + d + 1 have the same identifiers?"""
    v = np.unique(np.array(ids, dtype=object).astype(str), return_inverse=True)[1] if ids else np.zeros(0, int)
    some = np.array([bool(x) for x in ids], bool)
    out = np.zeros((len(ids), window - 1), bool)
    for d in range(min(window - 1, len(ids) - 1)):
        out[: len(ids) - d - 1, d] = (v[: -d - 1] == v[d + 1 :]) & some[d + 1 :]
    return out


def neighbour_links(rows: DataFrame, window: int = 10, block: int = 4096, least: float = 4.0) -> DataFrame:
    """(a, b, score): pairs of nodes that stand within ``window`` of each other under a sort key and score at least ``least``.

    All keys are sorted as one range-partitioned table. A row's position in the
    whole order comes from its place in its partition and the partitions' sizes
    (one number a partition on the driver); rows then meet in blocks that
    overlap by the window, so no window is lost at an edge and no task gets more
    than a block, however many rows share a key.
    """
    spark = rows.sparkSession

    def expand(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            keys = [sort_keys(*x) for x in zip(p["words"], p["people"], p["year"], p["journal"])]
            out = p.loc[p.index.repeat([len(k) for k in keys])].copy()
            out.insert(0, "sort", [k for own in keys for k in own])
            yield out

    def place(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n = TaskContext.get().partitionId(), 0
        for p in it:
            p.insert(0, "part", part)
            p.insert(1, "place", np.arange(n, n + len(p)))
            n += len(p)
            yield p

    keyed = rows.mapInPandas(expand, "sort string, " + ROW)
    ranged = keyed.repartitionByRange("sort", "node").sortWithinPartitions("sort", "node")
    placed = stash(ranged.mapInPandas(place, "part int, place long, sort string, " + ROW))
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())
    start, total = [], 0
    for part, n in sizes:
        start.append((part, total))
        total += n
    if not total:
        return spark.createDataFrame([], "a long, b long, score double")
    offsets = F.broadcast(spark.createDataFrame(start, "part int, start long"))  # one row a partition
    at = F.col("start") + F.col("place")
    own = (at / block).cast("long")
    blocks = placed.join(offsets, "part").withColumn("at", at).withColumn("own", own)
    last = F.pmod("at", F.lit(block)) >= block - window + 1
    blocks = blocks.withColumn("block", F.explode(F.when(last, F.array("own", F.col("own") + 1)).otherwise(F.array("own"))))

    def meet(key, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("at", kind="stable")
        mine = (p["own"] == key[0]).tolist()
        recs = list(p[_COLS].itertuples(index=False, name=None))
        near = _alike([r[1] for r in recs], window) | _known([r[8] for r in recs], window)
        out = {}
        for i, d in zip(*np.nonzero(near)):
            x, y = recs[i], recs[i + d + 1]
            pair = (min(x[0], y[0]), max(x[0], y[0]))
            if not mine[i + d + 1] or x[0] == y[0] or pair in out:
                continue
            s = weigh(x, y)
            if s is not None and s >= least:
                out[pair] = s
        return pd.DataFrame([(a, b, s) for (a, b), s in out.items()], columns=["a", "b", "score"])

    met = blocks.drop("part", "place", "start", "sort").groupBy("block").applyInPandas(meet, "a long, b long, score double")
    return met.groupBy("a", "b").agg(F.max("score").alias("score"))


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one pairs with the largest total gain; pairs without gain are left out. Shortest augmenting paths."""
    n, m = gain.shape
    if n > m:
        return [(b, a) for a, b in assignment(gain.T)]
    cost = gain.max() - gain
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used)
            d = cost[match[j0] - 1, free - 1] - u[match[j0]] - v[free]
            better = d < low[free]
            low[free[better]] = d[better]
            way[free[better]] = j0
            j1 = free[np.argmin(low[free])]
            step = low[j1]
            u[match[used]] += step
            v[used] -= step
            low[~used] -= step
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j] and gain[match[j] - 1, j - 1] > 0]


def sparse_assignment(edges: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """One-to-one pairs with the largest total gain, from (left, right, gain) of the only pairs that may be; in whole millionths of millionths.

    Shortest augmenting paths over the given pairs alone: memory grows with the
    pairs, not with left times right. A left one may stay alone, at gain 0.
    """
    at: dict[int, int] = {}
    own: list[list[tuple[int, int]]] = []
    for a, b, g in edges:
        if g > 0:
            if a not in at:
                at[a] = len(own)
                own.append([])
            own[at[a]].append((b, -round(g * 1e12)))
    lefts, v, u = list(at), {}, [0] * len(at)
    right_of: list[int | None] = [None] * len(at)
    left_of: dict[int, int] = {}
    for i in range(len(lefts)):
        dist, back, done, heap = {}, {}, {}, []
        tree, alone, root, base, j = [i], None, i, 0, None
        while True:
            # ``root`` was reached at ``base``: it may stay alone (cost 0) or take one of its pairs
            if alone is None or base - u[root] < alone[0]:
                alone = (base - u[root], root)
            for b, c in own[root]:
                d = base + c - u[root] - v.get(b, 0)
                if b not in done and d < dist.get(b, d + 1):
                    dist[b], back[b] = d, root
                    heapq.heappush(heap, (d, b))
            while heap and (heap[0][1] in done or heap[0][0] > dist[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= alone[0]:
                least, j = alone[0], None
                break
            base, b = heapq.heappop(heap)
            done[b] = base
            if b not in left_of:
                least, j = base, b
                break
            root = left_of[b]
            tree.append(root)
        for b, d in done.items():
            v[b] = v.get(b, 0) + d - least
        for x in tree:
            u[x] += least - (done[right_of[x]] if x != i else 0)
        x = back[j] if j is not None else alone[1]
        while True:
            before = right_of[x]
            right_of[x] = j
            if j is not None:
                left_of[j] = x
            if x == i:
                break
            j, x = before, back[before]
    return [(lefts[x], b) for x, b in enumerate(right_of) if b is not None]


def distinct_rows(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row for all of one table that are alike in everything compared, (a, b): the others and that row)."""
    rest = [c for c in _COLS if c != "node"]
    keyed = both.withColumn("h1", F.xxhash64(*rest)).withColumn("h2", F.xxhash64(F.lit(1), *rest)).withColumn("side", F.pmod("node", F.lit(2)))
    first = stash(keyed.groupBy("side", "h1", "h2").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    many = first.where("n > 1").drop("n")
    copies = keyed.join(many, ["side", "h1", "h2"]).where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    copies = stash(copies)
    return both.join(copies, both["node"] == copies["a"], "left_anti"), copies


def match_tables(left: DataFrame, right: DataFrame, window: int = 10) -> DataFrame:
    """(left_id, right_id, confidence): rows of two tables that describe one publication.

    ``left`` and ``right``: node (unique BIGINT), title, authors, journal, year,
    pmid, doi. Rows of a table that are alike in everything compared meet the
    others as one. Copies within a table are grouped by the same comparison
    (and by identifiers their own table gives); a group of one side is then
    assigned to at most one of the other so that the total confidence is
    largest, and all copies of matched groups are paired. Two groups that are
    each other's only candidate need no assignment; other knots of groups that
    hang together are spread over tasks and assigned exactly, whatever their
    size; memory grows with a knot's pairs. Rows without a title match nothing.
    Empty tables give no rows.
    """
    both = read_publications(left.withColumn("node", F.col("node") * 2)).unionByName(read_publications(right.withColumn("node", F.col("node") * 2 + 1)))
    both = stash(both)
    rows, copies = distinct_rows(both)
    links = stash(neighbour_links(rows, window))
    known = both.select("node", F.explode(F.split("known", " ")).alias("k")).where("k <> ''")
    first = known.groupBy("k").agg(F.min("node").alias("b"))
    ids = known.join(first, "k").where("node <> b").select(F.col("node").alias("a"), "b")
    side = F.pmod("a", F.lit(2)) == F.pmod("b", F.lit(2))
    comp = stash(connected_components(links.where(side & (F.col("score") >= 5)).select("a", "b").unionByName(ids.where(side)).unionByName(copies), "a", "b"))
    cross = links.where(~side).select(F.when(F.pmod("a", F.lit(2)) == 0, F.col("a")).otherwise(F.col("b")).alias("l"), F.when(F.pmod("a", F.lit(2)) == 0, F.col("b")).otherwise(F.col("a")).alias("r"), "score")
    for c in ("l", "r"):
        cross = cross.join(comp.select(F.col("node").alias(c), F.col("component").alias("g" + c)), c, "left").withColumn("g" + c, F.coalesce("g" + c, c))
    pairs = stash(cross.groupBy("gl", "gr").agg(F.max("score").alias("score"), F.count("*").alias("n")))
    knots = stash(connected_components(pairs, "gl", "gr"))
    knotted = stash(pairs.join(knots.select(F.col("node").alias("gl"), "component"), "gl"))
    single = knotted.groupBy("component").agg(F.count("*").alias("k")).where("k = 1").select("component")
    sure = knotted.join(single, "component", "left_semi").select("gl", "gr", (1 / (1 + F.exp(-F.col("score")))).alias("confidence"))

    def assign(p: pd.DataFrame) -> list[tuple[int, int, float]]:
        p = p.sort_values(["score", "n", "gl", "gr"], ascending=[False, False, True, True])
        got = sparse_assignment([(a, b, 1 / (1 + math.exp(-s)) + 1e-3 * s + 1e-6 * min(n, 100)) for a, b, s, n in zip(p["gl"].tolist(), p["gr"].tolist(), p["score"], p["n"])])
        score = {(a, b): s for a, b, s in zip(p["gl"], p["gr"], p["score"])}
        return [(a, b, 1 / (1 + math.exp(-score[a, b]))) for a, b in got]

    def solve(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Knots arrive sorted; the last of a batch waits for its rest."""
        held = None
        for p in it:
            p = p if held is None else pd.concat([held, p], ignore_index=True)
            whole = p["component"] != p["component"].iloc[-1] if len(p) else np.zeros(0, bool)
            held = p[~whole]
            yield pd.DataFrame([x for _, g in p[whole].groupby("component") for x in assign(g)], columns=["gl", "gr", "confidence"])
        if held is not None and len(held):
            yield pd.DataFrame(assign(held), columns=["gl", "gr", "confidence"])

    tasks = 4 * both.sparkSession.sparkContext.defaultParallelism  # a stated number, so that small rows are not put into one task
    tied = knotted.join(single, "component", "left_anti").repartition(tasks, "component").sortWithinPartitions("component")
    chosen = sure.unionByName(tied.mapInPandas(solve, "gl long, gr long, confidence double"))
    members = comp.select("node", "component").unionByName(pairs.select(F.col("gl").alias("node"), F.col("gl").alias("component"))).unionByName(pairs.select(F.col("gr").alias("node"), F.col("gr").alias("component"))).distinct()
    out = chosen.join(members.select(F.col("component").alias("gl"), F.col("node").alias("l")), "gl").join(members.select(F.col("component").alias("gr"), F.col("node").alias("r")), "gr")
    return out.select((F.col("l") / 2).cast("long").alias("left_id"), ((F.col("r") - 1) / 2).cast("long").alias("right_id"), "confidence")
