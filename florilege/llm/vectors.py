"""Live embeddings: decoding, all-nearest-neighbours and similarity clusters.

Vectors travel as int16 codes (component / largest component * 32767), half the
bytes of float32. The cosine of two codes differs from that of the originals by
about 4e-6, far below the spread of real similarities.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import stash

SCALE = 32767.0


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes int16, usable): zero vectors and those with NaN or infinity are not usable."""
    x = x.astype(np.float64)
    top = np.abs(x).max(axis=1) if x.size else np.zeros(len(x))
    ok = np.isfinite(x).all(axis=1) & (top > 0)
    safe = np.where(ok, top, 1.0)[:, None]
    return np.rint(np.where(ok[:, None], x, 0.0) / safe * SCALE).astype("<i2"), ok


def unit(codes: np.ndarray, kind: str = "f4") -> np.ndarray:
    x = codes.astype(np.float64)
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(kind)


def _matrix(blobs, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<i2").reshape(-1, dims)


def live_vectors(chunks: DataFrame, rowids: DataFrame, dims: int = 64) -> DataFrame:
    """(vec_rowid, code): the listed, usable slots of the chunk blobs.

    Slots nobody lists, NULL or short blobs, offsets outside a blob, zero
    vectors and vectors with NaN give no row. Blobs are recoded to int16 before
    the join on chunk_id, so half their bytes are shuffled; the list of a chunk
    is bounded by its slots.
    """
    width = 4 * dims

    def recode(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for blob in pdf["vectors"]:
                blob = blob or b""
                with np.errstate(all="ignore"):
                    codes, ok = encode(np.frombuffer(blob[: len(blob) // width * width], "<f4").reshape(-1, dims))
                codes = np.where(ok[:, None], codes, 0).astype("<i2")
                out.append(codes.tobytes())
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "codes": out})

    def pick(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            ids, codes = [], []
            for blob, slots, rows in zip(pdf["codes"], pdf["slots"], pdf["rows"]):
                m = np.frombuffer(blob, "<i2").reshape(-1, dims)
                for s, r in zip(slots, rows):
                    if 0 <= s < len(m) and m[s].any():
                        ids.append(r)
                        codes.append(m[s].tobytes())
            yield pd.DataFrame({"vec_rowid": np.array(ids, "i8"), "code": codes})

    lists = (
        rowids.where("vec_rowid is not null and chunk_id is not null and chunk_offset is not null")
        .groupBy("chunk_id")
        .agg(F.collect_list("chunk_offset").alias("slots"), F.collect_list("vec_rowid").alias("rows"))
    )
    packed = chunks.select("chunk_id", "vectors").mapInPandas(recode, "chunk_id long, codes binary")
    return packed.join(lists, "chunk_id").mapInPandas(pick, "vec_rowid long, code binary")


# ---------------------------------------------------------------- neighbours


class Forest:
    """Hash strings of the trees, as integers whose leading bits are their prefixes.

    The first symbol of a string is the signed axis nearest to a random
    rotation of the vector, each further one (3 bits) the nearest of four
    random directions and its sign.
    """

    def __init__(self, dims: int, trees: int, more: int, seed: int):
        rng = np.random.default_rng(seed)
        self.dims, self.trees, self.more = dims, trees, more
        self.bits = (2 * dims - 1).bit_length() + 3 * more
        turn = lambda w: np.linalg.qr(rng.normal(size=(dims, dims)))[0][:, :w]
        self.turn = [np.concatenate([turn(dims), *(turn(4) for _ in range(more))], axis=1).astype("f4") for _ in range(trees)]

    def strings(self, x: np.ndarray, tree: int) -> np.ndarray:
        p, rows = x @ self.turn[tree], np.arange(len(x))

        def symbol(q: np.ndarray) -> np.ndarray:
            a = np.abs(q).argmax(axis=1)
            return 2 * a + (q[rows, a] > 0)

        s = symbol(p[:, : self.dims])
        for i in range(self.more):
            s = s * 8 + symbol(p[:, self.dims + 4 * i : self.dims + 4 * i + 4])
        return s


class Census:
    """How many strings of each tree begin with each prefix, and what follows for blocks and queries.

    ``counts``: (trees, 2 ** bits), the number of vectors under each whole
    string; bounded by the alphabet. A block is the longest run of a tree's
    sorted strings that is one prefix and holds at most ``block`` vectors; a
    string that more vectors share is a block in several parts.
    """

    def __init__(self, counts: np.ndarray, block: int):
        self.trees, self.bits = len(counts), counts.shape[1].bit_length() - 1
        self.under = [counts.reshape(self.trees, 2**b, -1).sum(axis=2) for b in range(self.bits + 1)]
        cells = np.arange(counts.shape[1])
        self.length = np.full(counts.shape, self.bits, "i1")
        for b in range(self.bits, -1, -1):
            self.length[np.repeat(self.under[b] <= block, 2 ** (self.bits - b), axis=1)] = b
        drop = self.bits - self.length.astype("i4")
        self.start = ((cells >> drop) << drop).astype("i4")
        self.parts = np.where(self.length == self.bits, -(-counts // block), 1).clip(1).astype("i4")
        #: First strings of the blocks that hold anything, sorted.
        self.blocks = [np.unique(self.start[t][counts[t] > 0]) for t in range(self.trees)]

    def levels(self, strings: np.ndarray, least: int) -> np.ndarray:
        """Prefix length of each query: all trees ascend together until their subtrees hold ``least`` vectors in all."""
        out = np.zeros(strings.shape[1], "i1")
        for b in range(1, self.bits + 1):
            held = sum(self.under[b][t][strings[t] >> (self.bits - b)] for t in range(self.trees))
            out[(held >= least) & (out == b - 1)] = b
        return out


def _best(qids, xq, mids, xm, at, k: int, least: float, tile: int = 1024):
    """For each query its k best members and some more as (query id, member id, cosine in millionths).

    ``at``: where the query itself stands among the members, or -1.
    """
    n, out = len(mids), []
    keep = min(n, k + 8)
    seniority = np.argsort(np.argsort(mids))
    for a in range(0, len(qids), tile):
        s = xq[a : a + tile] @ xm.T
        own = np.flatnonzero(at[a : a + tile] >= 0)
        s[own, at[a : a + tile][own]] = -2
        rows = np.flatnonzero(s.max(axis=1) >= least - 1e-4)
        if not len(rows):
            continue
        s = s[rows]
        top = np.argpartition(s, n - keep, axis=1)[:, n - keep :] if keep < n else np.broadcast_to(np.arange(n), s.shape)
        if keep < n:  # where more than the kept ones may tie, the smaller ids are kept
            v = np.sort(np.take_along_axis(s, top, 1), axis=1)
            crowd = np.flatnonzero((v[:, -k] - v[:, 0] < 2e-6) & (v[:, -k] >= least - 1e-4))
            for u in range(0, len(crowd), 64):
                w = crowd[u : u + 64]
                ranked = np.rint(s[w].astype("f8") * 1e6) * n - seniority
                top[w] = np.argpartition(ranked, n - keep, axis=1)[:, n - keep :]
        r, c = np.repeat(rows + a, top.shape[1]), top.ravel()
        good = np.take_along_axis(s, top, 1).ravel() >= least - 1e-4
        r, c = r[good], c[good]
        u, v = xq[r].astype("f8"), xm[c].astype("f8")
        cos = np.einsum("ij,ij->i", u, v) / np.sqrt(np.einsum("ij,ij->i", u, u) * np.einsum("ij,ij->i", v, v))
        cos = np.rint(cos * 1e6).astype("i4")
        good = cos >= round(least * 1e6)
        out.append((qids[r[good]], mids[c[good]], cos[good]))
    return out


def _ranked(row: np.ndarray, nbr: np.ndarray, cos: np.ndarray, k: int):
    """The k best of each row, higher cosine first, then smaller id; repeats count once."""
    o = np.lexsort((nbr, -cos, row))
    row, nbr, cos = row[o], nbr[o], cos[o]
    if len(row):
        first = np.r_[True, (row[1:] != row[:-1]) | (nbr[1:] != nbr[:-1]) | (cos[1:] != cos[:-1])]
        row, nbr, cos = row[first], nbr[first], cos[first]
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        rank = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
        good = rank < k
        row, nbr, cos = row[good], nbr[good], cos[good]
    return row, nbr, cos


PAIR = np.dtype([("id", "<i8"), ("cos", "<i4")])

#: How far cosines of 8-bit codes may lie from the true ones; about twenty standard deviations where components are of like size.
ROUGH = 0.02


def forest_neighbours(
    vectors: DataFrame, k: int = 5, least: float = 0.8, dims: int = 64, trees: int = 8, more: int = 3, candidates: int = 8192, block: int = 8192, seed: int = 11
) -> DataFrame:
    """(id, nbr, cos): the k most similar other vectors with cosine >= least, best first, ties to the smaller id.

    Method: a forest of hash strings. Each tree is the array of all vectors
    sorted by their strings, cut into blocks of at most ``block`` vectors. A
    query descends to its longest prefix and then ascends, in all trees
    together, until the subtrees it stands in hold ``candidates`` vectors in
    all; these are compared with it exactly. How long the prefix is follows
    from one count of all vectors by string (bounded by the alphabet, whatever
    the number of vectors): short where vectors are sparse, long where they are
    dense. No subtree is cut: one that spans several blocks sends its queries
    to each of them, and a single string that more than a block of vectors
    share is split into parts that meet pairwise, so no task holds more than
    about two blocks.
    Rows of one block leave each map task packed in one blob, so the shuffle
    carries little besides codes and ids. The codes it carries have 8 bits, so
    what the forest finds is rough by ``ROUGH`` and taken from that much below ``least``.

    The more vectors there are, the longer the prefixes, and the fewer true
    neighbours share one. So the forest only has to say which vectors hang
    together: the lists are made by ``neighbours_in_components``, exactly.

    Copies: of vectors with one code, the k + 1 smallest ids enter the forest;
    each further copy has the k smallest as its neighbours, by definition.

    cos is in millionths. No vectors, no rows. NULL codes are ignored.
    """
    vectors = stash(vectors.where("code is not null and vec_rowid is not null").select(F.col("vec_rowid").alias("id"), "code"))
    hashed = vectors.select("*", F.xxhash64("code").alias("h1"), F.xxhash64(F.lit(7), "code").alias("h2"))
    heavy = stash(hashed.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).drop("n"))
    salted = hashed.join(heavy, ["h1", "h2"], "left_semi").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    w1, w2 = Window.partitionBy("h1", "h2", "salt").orderBy("id"), Window.partitionBy("h1", "h2").orderBy("id")
    lead = salted.withColumn("r", F.row_number().over(w1)).where(F.col("r") <= k + 1).withColumn("r", F.row_number().over(w2)).where(F.col("r") <= k + 1)
    firsts = lead.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("firsts"))
    spread = firsts.withColumn("salt", F.explode(F.expr("sequence(0L, 63L)")))
    copies = (
        salted.join(spread, ["h1", "h2", "salt"])
        .where(F.col("id") > F.element_at("firsts", k + 1))
        .select("id", F.explode(F.slice("firsts", 1, k)).alias("nbr"), F.lit(1_000_000).alias("cos"))
    )
    members = hashed.join(heavy, ["h1", "h2"], "left_anti").select("id", "code").unionByName(lead.select("id", "code"))

    wood = Forest(dims, trees, more, seed)
    head = wood.bits - 7  # counts travel in slices of seven leading bits

    def tally(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = np.zeros((trees, 2**wood.bits), "i8")
        for pdf in it:
            if len(pdf):
                x = unit(_matrix(pdf["code"], dims))
                for t in range(trees):
                    np.add.at(c[t], wood.strings(x, t), 1)
        c = c.reshape(trees, -1, 2**head)
        t, p = np.nonzero(c.any(axis=2))
        yield pd.DataFrame({"tree": t.astype("i4"), "slice": p.astype("i4"), "n": [zlib.compress(c[i, j].tobytes(), 1) for i, j in zip(t, p)]})

    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        n = sum(np.frombuffer(zlib.decompress(b), "i8") for b in pdf["n"])
        return pd.DataFrame({"tree": [key[0]], "slice": [key[1]], "n": [zlib.compress(n.tobytes(), 1)]})

    kind = "tree int, slice int, n binary"
    counts = np.zeros((trees, 2**wood.bits >> head, 2**head), "i8")
    for r in members.mapInPandas(tally, kind).groupBy("tree", "slice").applyInPandas(add, kind).collect():
        counts[r["tree"], r["slice"]] = np.frombuffer(zlib.decompress(r["n"]), "i8")
    held = vectors.sparkSession.sparkContext.broadcast(Census(counts.reshape(trees, -1), block))

    def plant(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = held.value
        for pdf in it:
            if not len(pdf):
                continue
            codes = _matrix(pdf["code"], dims)
            ids, x = pdf["id"].to_numpy("i8"), unit(codes)
            strings = np.stack([wood.strings(x, t) for t in range(trees)])
            rough = np.rint(codes / 258).astype("i1")
            levels, rows = c.levels(strings, candidates), []

            def send(own, t, start, i, j, asks, held):
                """Rows ``own`` to a group: members of its part i (``held``), queries of its part j (``asks``)."""
                flag = (levels[own].astype("i4") if asks else np.full(len(own), 64)) + (128 if held else 0)
                rows.append((t, int(start), int(i), int(j), ids[own].tobytes(), rough[own].tobytes(), strings[t][own].astype("<i4").tobytes(), flag.astype("u1").tobytes()))

            for t in range(trees):
                s = strings[t]
                start, parts = c.start[t][s], c.parts[t][s]
                part = (_draw(ids, 97) * parts).astype("i4")
                o = np.lexsort((part, start))
                cut = np.flatnonzero(np.r_[True, (np.diff(start[o]) != 0) | (np.diff(part[o]) != 0)])
                for a, b in zip(cut, np.r_[cut[1:], len(o)]):
                    own = o[a:b]
                    i, n = part[own[0]], parts[own[0]]
                    send(own, t, start[own[0]], i, i, True, True)
                    for j in range(n):
                        if j != i:
                            send(own, t, start[own[0]], i, j, False, True)
                            send(own, t, start[own[0]], j, i, True, False)
                wide = np.flatnonzero((c.length[t][s] > levels) & ((levels > 0) | (t == 0)))
                drop = c.bits - levels[wide].astype("i4")
                node = np.stack([(s[wide] >> drop) << drop, drop], 1)
                for first, d in np.unique(node, axis=0) if len(wide) else []:
                    own = wide[(node == (first, d)).all(axis=1)]
                    lo, hi = np.searchsorted(c.blocks[t], [first, first + (1 << d)])
                    for other in c.blocks[t][lo:hi]:
                        away = own[start[own] != other]
                        for i in range(c.parts[t][other]) if len(away) else []:
                            send(away, t, other, i, 0, True, False)
            yield pd.DataFrame(rows, columns=["tree", "start", "i", "j", "ids", "codes", "strings", "flags"])

    def harvest(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, flag = np.frombuffer(b"".join(pdf["ids"]), "<i8"), np.frombuffer(b"".join(pdf["flags"]), "u1")
        s, x = np.frombuffer(b"".join(pdf["strings"]), "<i4"), unit(np.frombuffer(b"".join(pdf["codes"]), "i1").reshape(-1, dims))
        mine = np.flatnonzero(flag >= 128)
        mine = mine[np.argsort(s[mine], kind="stable")]
        place = np.full(len(ids), -1)
        place[mine] = np.arange(len(mine))
        level = (flag & 127).astype("i4")
        asks = np.flatnonzero((level < 64) & ((level > 0) | (key[0] == 0)))
        drop = wood.bits - level[asks]
        node = np.stack([(s[asks] >> drop) << drop, drop], 1)
        xm, mids, found = x[mine], ids[mine], []
        for first, d in np.unique(node, axis=0) if len(asks) else []:
            own = asks[(node == (first, d)).all(axis=1)]
            lo, hi = np.searchsorted(s[mine], [first, first + (1 << int(d))])
            at = np.where((place[own] >= lo) & (place[own] < hi), place[own] - lo, -1)
            if hi > lo:
                found += _best(ids[own], x[own], mids[lo:hi], xm[lo:hi], at, k, least - ROUGH)
        if not found:
            return pd.DataFrame({"id": np.zeros(0, "i8"), "near": []})
        return _packed(*_ranked(*(np.concatenate(v) for v in zip(*found)), k))

    def merge(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield _packed(*_merged(pdf, k))

    planted = members.mapInPandas(plant, "tree int, start int, i int, j int, ids binary, codes binary, strings binary, flags binary")
    near = planted.groupBy("tree", "start", "i", "j").applyInPandas(harvest, "id long, near binary")
    found = stash(near.groupBy("id").agg(F.collect_list("near").alias("near")).mapInPandas(merge, "id long, near binary"))
    return neighbours_in_components(members, found, k, least, dims).unionByName(copies)


def _kth(near: list[bytes], k: int, least: float) -> np.ndarray:
    """The cosine a member must reach to be among the k best, as far as rough lists tell."""
    return np.array([max(np.frombuffer(b, PAIR)["cos"][k - 1] / 1e6 - ROUGH, least) if len(b) == k * PAIR.itemsize else least for b in near], "f4")


def _closer(x: np.ndarray, y: np.ndarray, fx: np.ndarray, fy: np.ndarray, k: int, one: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of x, row of y, cosine in millionths) of all pairs that reach what either row asks for; raises ``fx`` and ``fy`` where k members are seen to be nearer."""
    slack, tile = np.float32(4e-6), 512
    for a in range(0, len(x), tile):
        s = x[a : a + tile] @ y.T
        if one:
            s[np.arange(len(s)), a + np.arange(len(s))] = -2
        ask = fx[a : a + tile]
        hits = []
        for t, f in ((s, ask), (s.T, fy)):
            hit = t >= (f - slack)[:, None]
            many = np.flatnonzero(np.count_nonzero(hit, axis=1) > 4 * k)
            if len(many):
                f[many] = np.maximum(f[many], np.partition(t[many], t.shape[1] - k, axis=1)[:, t.shape[1] - k])
                hit[many] = t[many] >= (f[many] - slack)[:, None]
            hits.append(hit)
        r, c = np.nonzero(hits[0] | hits[1].T)
        for i in range(0, len(r), 100_000):
            u, v = x[r[i : i + 100_000] + a].astype("f8"), y[c[i : i + 100_000]].astype("f8")
            cos = np.einsum("ij,ij->i", u, v) / np.sqrt(np.einsum("ij,ij->i", u, u) * np.einsum("ij,ij->i", v, v))
            yield r[i : i + 100_000] + a, c[i : i + 100_000], np.rint(cos * 1e6).astype("i4")


def neighbours_in_components(members: DataFrame, found: DataFrame, k: int = 5, least: float = 0.8, dims: int = 64, small: int = 4096, block: int = 8192) -> DataFrame:
    """(id, nbr, cos): the k best of every vector within the component that the pairs ``found`` so far put it in.

    ``found``: (id, near), up to k neighbours a vector. Whoever is a true
    neighbour of a vector is, but for pairs and chains that hang on one missed link,
    in its component. So what counts is that a component hangs together, for
    which a part of its pairs is enough, however many vectors there are.
    Components of up to ``small`` vectors are compared whole, several
    at once; larger ones in pairs of blocks, read from the written table by the
    tasks that pair them, at a cost that grows with the square of the component.
    No component is cut.
    """
    spark = members.sparkSession

    def links(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            p = np.frombuffer(b"".join(pdf["near"]), PAIR)
            yield pd.DataFrame({"src": np.repeat(pdf["id"].to_numpy("i8"), [len(b) // PAIR.itemsize for b in pdf["near"]]), "dst": p["id"]})

    comp = stash(connected_components(found.mapInPandas(links, "src long, dst long")))
    parts, first = [], 0
    for r in comp.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > small).orderBy("component").collect():  # at most one in ``small`` vectors
        n = -(-r["n"] // block)
        parts.append((r["component"], first, n))
        first += n
    large = F.broadcast(spark.createDataFrame(parts, "component long, first long, parts long"))
    rows = members.join(comp.withColumnRenamed("node", "id"), "id")

    def whole(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None

        def best(pdf):
            ids, x = pdf["id"].to_numpy("i8"), unit(_matrix(pdf["code"], dims))
            got = _best(ids, x, ids, x, np.arange(len(ids)), k, least)
            row, nbr, cos = _ranked(*(np.concatenate(v) for v in zip(*got)), k) if got else (np.zeros(0, "i8"),) * 3
            return pd.DataFrame({"id": row, "nbr": nbr, "cos": cos})

        for pdf in it:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            c = pdf["component"].to_numpy("i8")
            ends, start = np.flatnonzero(c[1:] != c[:-1]) + 1, 0
            while (i := np.searchsorted(ends, start + 512)) < len(ends):
                yield best(pdf.iloc[start : ends[i]])
                start = ends[i]
            rest = pdf.iloc[start:]
        if rest is not None and len(rest):
            yield best(rest)

    spread = rows.join(large, "component", "left_anti").repartition("component").sortWithinPartitions("component")
    out = spread.select("component", "id", "code").mapInPandas(whole, "id long, nbr long, cos int")
    if not parts:
        return out

    def pack(key, pdf):
        near = [b if b is not None else b"" for b in pdf["near"]]
        return pd.DataFrame({"b": [key[0]], "last": [pdf["last"].iloc[0]], "ids": [pdf["id"].to_numpy("<i8").tobytes()], "codes": [b"".join(pdf["code"])], "ask": [_kth(near, k, least).astype("<f4").tobytes()]})

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            at = (_draw(pdf["id"].to_numpy("i8"), 96) * pdf["parts"].to_numpy("i8")).astype("i8")
            yield pd.DataFrame({"b": pdf["first"] + at, "last": pdf["first"] + pdf["parts"] - 1, "id": pdf["id"], "code": pdf["code"], "near": pdf["near"]})

    crowd = rows.join(large, "component").join(found, "id", "left").select("id", "code", "near", "first", "parts")
    packed = crowd.mapInPandas(cut, "b long, last long, id long, code binary, near binary").groupBy("b").applyInPandas(pack, "b long, last long, ids binary, codes binary, ask binary")
    blocks = stash(packed.repartition(spark.sparkContext.defaultParallelism * 2, "b"))

    def meet(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, ids, ask, best = {}, {}, {}, {}  # vectors of the blocks read last; of all blocks, what is asked for and found

        def get(b, i, codes, a):
            if b not in kept:
                if len(kept) >= 8:
                    kept.pop(next(iter(kept)))
                kept[b] = unit(_matrix([codes], dims))
            if b not in ids:
                ids[b], ask[b], best[b] = np.frombuffer(i, "<i8"), np.frombuffer(a, "<f4").copy(), (np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "i4"))
            return kept[b]

        def learn(b, row, nbr, cos):
            row, nbr, cos = best[b] = _ranked(*(np.concatenate(v) for v in zip(best[b], (row, nbr, cos))), k)
            start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, "i8")
            full = start[np.diff(np.r_[start, len(row)]) == k]
            ask[b][row[full]] = np.maximum(ask[b][row[full]], (cos[full + k - 1] / 1e6).astype("f4"))

        for pdf in it:
            for r in pdf.itertuples(index=False):
                x, y = get(r.b, r.ids, r.codes, r.ask), get(r.b2, r.ids2, r.codes2, r.ask2)
                for p, q, cos in _closer(x, y, ask[r.b], ask[r.b2], k, r.b == r.b2):
                    good = cos >= round(least * 1e6)
                    p, q, cos = p[good], q[good], cos[good]
                    learn(r.b, p, ids[r.b2][q], cos)
                    if r.b != r.b2:
                        learn(r.b2, q, ids[r.b][p], cos)
        for b, (row, nbr, cos) in best.items():
            yield _packed(ids[b][row], nbr, cos)

    def merged(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame(dict(zip(("id", "nbr", "cos"), _merged(pdf, k))))

    pairs = blocks.crossJoin(blocks.toDF("b2", "last2", "ids2", "codes2", "ask2")).where("b <= b2 and b2 <= last")  # blocks, not rows
    met = pairs.mapInPandas(meet, "id long, near binary").groupBy("id").agg(F.collect_list("near").alias("near"))
    return out.unionByName(met.mapInPandas(merged, "id long, nbr long, cos int"))


def _merged(pdf: pd.DataFrame, k: int):
    """The k best of the lists of neighbours that each id has."""
    lists = [b"".join(x) for x in pdf["near"]]
    p = np.frombuffer(b"".join(lists), PAIR)
    return _ranked(np.repeat(pdf["id"].to_numpy("i8"), [len(b) // PAIR.itemsize for b in lists]), p["id"], p["cos"], k)


def _packed(row: np.ndarray, nbr: np.ndarray, cos: np.ndarray) -> pd.DataFrame:
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, "i8")
    p = np.empty(len(row), PAIR)
    p["id"], p["cos"] = nbr, cos
    ends = np.r_[start[1:], len(row)]
    return pd.DataFrame({"id": row[start], "near": [p[a:b].tobytes() for a, b in zip(start, ends)]})


# ------------------------------------------------------------------ clusters


def _as_rows(it: Iterator[pd.DataFrame], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for pdf in it:
        if len(pdf):
            codes = _matrix(pdf["code"], dims)
            yield pdf["vec_rowid"].to_numpy("i8"), codes, unit(codes)


def _draw(ids: np.ndarray, salt: int) -> np.ndarray:
    """A uniform number in (0, 1) for each id, the same in every run."""
    z = ids.astype("u8") + np.uint64(0x9E3779B97F4A7C15 * (salt + 1) % 2**64)
    for a, b in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(a))) * np.uint64(b)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype("f8") / 2**53 + 2**-54


def _reduce(cand: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Weighted k-means++ over the oversampled candidates (at most 2k a round)."""
    rng = np.random.default_rng(seed)
    k = min(k, len(cand))
    chosen = [int(rng.choice(len(cand), p=weight / weight.sum()))]
    far = 1 - cand @ cand[chosen[0]]
    while len(chosen) < k:
        w = np.maximum(far, 0) * weight
        if w.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(cand), p=w / w.sum())))
        far = np.minimum(far, 1 - cand @ cand[chosen[-1]])
    return cand[chosen]


def kmeans_centres(vectors: DataFrame, k: int, dims: int = 64, rounds: int = 3, steps: int = 2, seed: int = 5) -> np.ndarray:
    """Spherical k-means: oversampled parallel seeding, then Lloyd steps over the whole table.

    Seeding round r keeps 2k rows drawn with chance in proportion to their
    squared distance from the centres so far (exponential keys, so one pass a
    round and no total is needed). The driver sees 2k * rounds candidates and k
    centres, a bound that does not depend on the data.
    """
    sc = vectors.sparkSession.sparkContext
    first = vectors.orderBy(F.xxhash64("vec_rowid", F.lit(seed)), "vec_rowid").limit(1).collect()
    if not first:
        return np.zeros((0, dims), "f4")
    centres = unit(_matrix([first[0]["code"]], dims))

    def sample(held, salt):
        def run(it):
            c, keys, codes = held.value, np.zeros(0), np.zeros((0, dims), "<i2")
            for ids, own, x in _as_rows(it, dims):
                d = np.full(len(x), 2.0)
                for a in range(0, len(c), 1024):
                    d = np.minimum(d, 2 - 2 * (x @ c[a : a + 1024].T).max(axis=1))
                live = d > 1e-6
                keys = np.r_[keys, -np.log(_draw(ids[live], salt)) / d[live]]
                codes = np.concatenate([codes, own[live]])
                o = np.argsort(keys, kind="stable")[: 2 * k]
                keys, codes = keys[o], codes[o]
            yield pd.DataFrame({"key": keys, "code": [r.tobytes() for r in codes]})

        return run

    for r in range(rounds):
        held = sc.broadcast(centres)
        got = vectors.mapInPandas(sample(held, seed + r), "key double, code binary").orderBy("key", "code").limit(2 * k).collect()
        held.unpersist()
        if not got:
            break
        centres = np.concatenate([centres, unit(_matrix([g["code"] for g in got], dims))])

    names = [f"s{i}" for i in range(dims)]
    schema = "c int, n long, " + ", ".join(f"{s} double" for s in names)

    def totals(held):
        def run(it):
            c = held.value
            s, n = np.zeros((len(c), dims)), np.zeros(len(c), "i8")
            for _, _, x in _as_rows(it, dims):
                a = (x @ c.T).argmax(axis=1)
                o = np.argsort(a, kind="stable")
                cut = np.flatnonzero(np.r_[True, a[o][1:] != a[o][:-1]])
                s[a[o][cut]] += np.add.reduceat(x[o].astype("f8"), cut, axis=0)
                n += np.bincount(a, minlength=len(c))
            live = np.flatnonzero(n)
            yield pd.concat([pd.DataFrame({"c": live, "n": n[live]}), pd.DataFrame(s[live], columns=names)], axis=1)

        return run

    for step in range(steps + 1):
        held = sc.broadcast(centres)
        rows = vectors.mapInPandas(totals(held), schema).groupBy("c").agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in names)).orderBy("c").collect()
        held.unpersist()
        if step == 0:
            centres = _reduce(centres[[r["c"] for r in rows]], np.array([r["n"] for r in rows], "f8"), k, seed)
        else:
            m = np.array([[r[s] for s in names] for r in rows])
            centres = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)).astype("f4")
    return centres


def _groups(link: np.ndarray) -> np.ndarray:
    """Component number of each row of a symmetric link matrix."""
    n = len(link)
    label = np.full(n, -1)
    for a in range(n):
        if label[a] >= 0:
            continue
        edge = np.zeros(n, bool)
        edge[a] = True
        while edge.any():
            label[edge] = a
            edge = link[edge].any(axis=0) & (label < 0)
    return label


def similarity_links(vectors: DataFrame, centres: np.ndarray, least: float = 0.8, dims: int = 64, cells: int = 4, slack: float = 0.08, block: int = 4096) -> DataFrame:
    """(src, dst): star links whose components are those of all pairs with cosine >= least found in a common cell.

    A vector belongs to its nearest centre's cell and to at most ``cells - 1``
    more whose similarity is within ``slack`` of it. Members within half the
    linking angle of the centre are linked to each other by the triangle
    inequality, so a dense hot cell needs no comparisons among them: they only
    get a link to their smallest id. Everything else of a cell meets in blocks
    of at most ``block`` members; cells above that are spread over block pairs.
    """
    spark = vectors.sparkSession
    if not len(centres):
        return spark.createDataFrame([], "src long, dst long")
    held = spark.sparkContext.broadcast(centres)
    cone = math.cos(math.acos(least) / 2) + 1e-4
    m = min(cells, len(centres))

    def cells_of(x):
        s = x @ held.value.T
        top = np.argpartition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m :]
        v = np.take_along_axis(s, top, 1)
        r, c = np.nonzero(v >= v.max(axis=1, keepdims=True) - slack)
        return r, top[r, c], v[r, c] >= cone

    def census(it):
        n, lead = np.zeros((len(held.value), 2), "i8"), np.full((len(held.value), 2), np.iinfo("i8").max)
        for ids, _, x in _as_rows(it, dims):
            r, c, core = cells_of(x)
            np.add.at(n, (c, core.astype(int)), 1)
            np.minimum.at(lead, (c, core.astype(int)), ids[r])
        c, core = np.nonzero(n)
        yield pd.DataFrame({"cell": c, "core": core == 1, "n": n[c, core], "lead": lead[c, core]})

    rows = vectors.mapInPandas(census, "cell int, core boolean, n long, lead long").groupBy("cell", "core").agg(F.sum("n").alias("n"), F.min("lead").alias("lead")).collect()
    size = np.zeros((len(centres), 2), "i8")
    lead = np.zeros(len(centres), "i8")
    for r in rows:
        size[r["cell"], int(r["core"])] = r["n"]
        if r["core"]:
            lead[r["cell"]] = r["lead"]
    whole = size.sum(axis=1) <= block
    parts = np.where(whole[:, None], [[1, 0]], -(-size // block))  # of the rest, of the core
    plan = spark.sparkContext.broadcast((parts, whole, lead, size))

    def core_links(it):
        _, _, lead, _ = plan.value
        for ids, _, x in _as_rows(it, dims):
            r, c, core = cells_of(x)
            yield pd.DataFrame({"src": ids[r[core]], "dst": lead[c[core]]})

    def scatter(it):
        parts, whole, _, size = plan.value
        for ids, codes, x in _as_rows(it, dims):
            r, c, core = cells_of(x)
            busy = (size[c, 0] > 0) & (size[c].sum(axis=1) > 1)
            r, c, core = r[busy], c[busy], core[busy]
            b = np.where(whole[c], 0, (_draw(ids[r], 99) * np.where(core, parts[c, 1], parts[c, 0])).astype("i8"))
            out = []
            for i in np.unique(np.stack([c, b, core & ~whole[c]], 1), axis=0) if len(r) else []:
                own = r[(c == i[0]) & (b == i[1]) & ((core & ~whole[c]) == i[2])]
                rest, blob = int(parts[i[0], 0]), (ids[own].tobytes(), codes[own].tobytes())
                if i[2]:
                    out += [(int(i[0]), -1 - int(i[1]), j, *blob, True) for j in range(rest)]
                else:
                    out += [(int(i[0]), min(int(i[1]), j), max(int(i[1]), j), *blob, False) for j in range(rest)]
                    out += [(int(i[0]), -1 - j, int(i[1]), *blob, False) for j in range(int(parts[i[0], 1]) if not whole[i[0]] else 0)]
            yield pd.DataFrame(out, columns=["cell", "a", "b", "ids", "codes", "core"])

    def meet(key, pdf):
        ids = np.frombuffer(b"".join(pdf["ids"]), "<i8")
        x = unit(_matrix(pdf["codes"], dims))
        o = np.argsort(ids, kind="stable")
        ids, x = ids[o], x[o]
        link = np.empty((len(ids), len(ids)), bool)
        for a in range(0, len(ids), 1024):
            link[a : a + 1024] = x[a : a + 1024] @ x.T >= least - 5e-7
        some = np.flatnonzero(link.sum(axis=1) > 1)
        if not len(some):
            return pd.DataFrame({"src": np.zeros(0, "i8"), "dst": np.zeros(0, "i8")})
        g = _groups(link[np.ix_(some, some)])
        ids = ids[some]
        return pd.DataFrame({"src": ids, "dst": ids[g]})[ids != ids[g]]

    met = vectors.mapInPandas(scatter, "cell int, a int, b int, ids binary, codes binary, core boolean").groupBy("cell", "a", "b").applyInPandas(meet, "src long, dst long")
    return met.unionByName(vectors.mapInPandas(core_links, "src long, dst long")).where("src <> dst")


def _stars(link: np.ndarray, a: np.ndarray, b: np.ndarray | None) -> pd.DataFrame:
    """(src, dst): star links with the components of a link matrix between two lots of ids, or of one with itself."""
    if b is not None:
        r, c = link.any(axis=1), link.any(axis=0)
        a, n = np.concatenate([a[r], b[c]]), int(r.sum())
        both = np.zeros((len(a), len(a)), bool)
        both[:n, n:] = link[np.ix_(r, c)]
        both[n:, :n] = both[:n, n:].T
    else:
        some = np.flatnonzero(link.sum(axis=1) > 1)
        a, both = a[some], link[np.ix_(some, some)]
    g = _groups(both)
    return pd.DataFrame({"src": a, "dst": a[g]})[a != a[g]]


def _balls(x: np.ndarray, least: float, fewest: int = 4, wide: float = 0.94) -> np.ndarray:
    """For each row the number of its ball, -1 for none: rows that hang together by links and lie within ``wide`` of their mean."""
    out = np.full(len(x), -1, "<i4")
    link = np.empty((len(x), len(x)), bool)
    for i in range(0, len(x), 1024):
        np.greater_equal(x[i : i + 1024] @ x.T, np.float32(least), out=link[i : i + 1024])
    some = np.flatnonzero(np.count_nonzero(link, axis=1) >= fewest)
    g = _groups(link[np.ix_(some, some)])
    for n, a in enumerate(np.unique(g)):
        own = some[g == a]
        mean = x[own].mean(axis=0)
        own = own[x[own] @ mean >= wide * np.linalg.norm(mean)]
        if len(own) >= fewest:
            out[own] = n
    return out


def links_between_cells(vectors: DataFrame, centres: np.ndarray, least: float = 0.8, dims: int = 64, block: int = 16384, part: int = 4096) -> DataFrame:
    """(src, dst): star links whose components are those of all pairs with cosine >= least that do not have one nearest centre.

    Every vector lies in one block of about ``block`` vectors of neighbouring
    cells, and every block meets every block once, part by part. Within a part,
    vectors that are alike form balls. A vector can have a link into a ball only
    if its angle to the ball's centre is at most the ball's radius and the
    linking angle, so all vectors are held against the centres of the other
    part's balls, and against members only where that inequality allows a link.
    Vectors in no ball are compared with each other: exact for any data, at a
    cost that grows with the square of the vectors outside balls. Blocks are
    read from the written table by the tasks that pair them, so no copies are shuffled.
    """
    spark = vectors.sparkSession
    if not len(centres):
        return spark.createDataFrame([], "src long, dst long")
    held = spark.sparkContext.broadcast(centres)
    angle = math.acos(least) + 1e-3
    cone = math.cos(math.acos(least) / 2) + 1e-4

    def lots(x):
        s = x @ held.value.T
        c = s.argmax(axis=1)
        return c + len(centres) * (s[np.arange(len(x)), c] < cone)

    def census(it):
        n = np.zeros(2 * len(centres), "i8")
        for _, _, x in _as_rows(it, dims):
            n += np.bincount(lots(x), minlength=len(n))
        yield pd.DataFrame({"lot": np.flatnonzero(n), "n": n[n > 0]})

    size = np.zeros(2 * len(centres), "i8")
    for r in vectors.mapInPandas(census, "lot int, n long").groupBy("lot").agg(F.sum("n").alias("n")).collect():
        size[r["lot"]] = r["n"]
    plan = spark.sparkContext.broadcast((size, np.cumsum(size) - size))

    def deal(it):
        size, start = plan.value
        for ids, codes, x in _as_rows(it, dims):
            g = lots(x)
            b = (start[g] + (_draw(ids, 98) * size[g]).astype("i8")) // block
            for i in np.unique(b):
                own = b == i
                yield pd.DataFrame({"b": [i], "ids": [ids[own].tobytes()], "codes": [codes[own].tobytes()], "lots": [g[own].astype("<i4").tobytes()]})

    def whole(key, pdf):
        ids, g = np.frombuffer(b"".join(pdf["ids"]), "<i8"), np.frombuffer(b"".join(pdf["lots"]), "<i4")
        codes = _matrix(pdf["codes"], dims)
        o = np.lexsort((ids, g))
        ball = np.full(len(o), -1, "<i4")
        for i in range(0, len(o), part):
            own = o[i : i + part]
            n = _balls(unit(codes[own]), least)
            at = np.argsort(n, kind="stable")
            o[i : i + part], ball[i : i + part] = own[at], n[at]
        return pd.DataFrame({"b": [key[0]], "ids": [ids[o].tobytes()], "codes": [codes[o].tobytes()], "lots": [g[o].tobytes()], "balls": [ball.tobytes()]})

    kind = "b long, ids binary, codes binary, lots binary"
    blocks = vectors.mapInPandas(deal, kind).groupBy("b").applyInPandas(whole, kind + ", balls binary")
    blocks = stash(blocks.repartition(spark.sparkContext.defaultParallelism * 2, "b"))

    def read(ids, codes, lots, balls):
        """The parts of a block as its tasks need them: ids, vectors, cells, where each ball starts (what comes before is in none), the centres, and what a vector's product with each must reach to have a link there."""
        ids, x, g, ball = np.frombuffer(ids, "<i8"), unit(_matrix([codes], dims)), np.frombuffer(lots, "<i4"), np.frombuffer(balls, "<i4")
        out = []
        for i in range(0, len(ids), part):
            y, n = x[i : i + part], ball[i : i + part]
            start = np.flatnonzero((n >= 0) & np.r_[True, n[1:] != n[:-1]])
            own, far = np.zeros((0, dims), "f4"), np.zeros(0, "f4")
            if len(start):
                own = np.add.reduceat(y.astype("f8"), start, axis=0)
                own = (own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)).astype("f4")
                cos = np.einsum("ij,ij->i", y[start[0] :], np.repeat(own, np.diff(np.r_[start, len(y)]), axis=0))
                reach = np.arccos(np.clip(np.minimum.reduceat(cos, start - start[0]), -1, 1)) + angle
                far = np.where(reach < math.pi, np.cos(np.minimum(reach, math.pi)), -2).astype("f4")
            out.append((ids[i : i + part], y, set((g[i : i + part] % len(centres)).tolist()), np.r_[start, len(y)], own.T, far))
        return out

    reached = np.float32(least - 5e-7)

    def linked(x, y, tile=1024):
        """Row and column of the products that reach ``least``."""
        rows, cols = [], []
        for i in range(0, len(x), tile):
            s = x[i : i + tile] @ y.T
            near = np.flatnonzero(s.max(axis=1, initial=-2) >= reached)
            r, c = np.nonzero(s[near] >= reached)
            rows.append(near[r] + i)
            cols.append(c)
        return np.concatenate(rows or [np.zeros(0, "i8")]), np.concatenate(cols or [np.zeros(0, "i8")])

    def into(x, y, start, centre, far, most):
        """Row of x and row of y of the links into balls of y; None where the inequality excludes too little."""
        r, q = np.nonzero(x @ centre >= far)
        n = np.diff(start)[q]
        if n.sum() > most:
            return None
        r = np.repeat(r, n)
        c = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[q], n)
        good = np.einsum("ij,ij->i", x[r], y[c]) >= reached
        return r[good], c[good]

    def compare(first, second, one):
        (a, x, cells, sx, cx, fx), (b, y, other, sy, cy, fy) = first, second
        if len(cells | other) == 1:
            return  # one cell
        if one:
            link = np.empty((len(a), len(a)), bool)
            for i in range(0, len(a), 1024):
                np.greater_equal(x[i : i + 1024] @ x.T, reached, out=link[i : i + 1024])
            yield _stars(link, a, None)
            return
        most = len(a) * len(b) // 128
        there = into(x, y, sy, cy, fy, most)
        back = into(y[: sy[0]], x, sx, cx, fx, most)
        if there is None or back is None:
            r, c = linked(x, y)
        else:
            r, c = (np.concatenate(v) for v in zip(there, back[::-1], linked(x[: sx[0]], y[: sy[0]])))
        if len(r):
            r, c = np.unique(r, return_inverse=True), np.unique(c, return_inverse=True)
            link = np.zeros((len(r[0]), len(c[0])), bool)
            link[r[1], c[1]] = True
            yield _stars(link, a[r[0]], b[c[0]])

    def meet(it):
        kept = {}  # blocks read last; each takes part in many pairs

        def parts_of(b, *blobs):
            if b not in kept:
                if len(kept) >= 8:
                    kept.pop(next(iter(kept)))
                kept[b] = read(*blobs)
            return kept[b]

        for pdf in it:
            for r in pdf.itertuples(index=False):
                one, other = parts_of(r.b, r.ids, r.codes, r.lots, r.balls), parts_of(r.b2, r.ids2, r.codes2, r.lots2, r.balls2)
                for i, first in enumerate(one):
                    for j, second in enumerate(other):
                        if r.b != r.b2 or i <= j:
                            yield from compare(first, second, r.b == r.b2 and i == j)

    pairs = blocks.crossJoin(blocks.toDF("b2", "ids2", "codes2", "lots2", "balls2")).where("b <= b2")  # blocks, not rows
    return pairs.mapInPandas(meet, "src long, dst long").where("src <> dst").distinct()


def similarity_clusters(vectors: DataFrame, least: float = 0.8, smallest: int = 3, dims: int = 64, max_cells: int = 4096, seed: int = 5) -> DataFrame:
    """(cluster_key, vec_rowid): components of at least ``smallest`` vectors under links of cosine >= least.

    Pairs with one nearest centre are linked in its cell, all others between
    cells, so no pair is left out.
    The number of cells is the square root of the number of vectors, up to
    ``max_cells``, so that centres stay a bounded broadcast. No vectors, no rows.
    """
    vectors = stash(vectors)
    n = vectors.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "cluster_key long, vec_rowid long")
    centres = kmeans_centres(vectors, min(max_cells, max(1, math.isqrt(n))), dims, seed=seed)
    links = similarity_links(vectors, centres, least, dims, cells=1).unionByName(links_between_cells(vectors, centres, least, dims))
    comp = connected_components(links)
    size = comp.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= smallest)
    return comp.join(size, "component").select(F.col("component").alias("cluster_key"), F.col("node").alias("vec_rowid"))


def typical_members(vectors: DataFrame, members: DataFrame, top: int = 3, dims: int = 64) -> DataFrame:
    """(cluster_key, size, rank, vec_rowid, cosine): the members nearest to each cluster's centroid.

    Centroids are sums made by partial aggregation; only the best ``top`` rows
    of a cluster are kept while sorting (ties: the smaller vec_rowid).
    """
    names = [f"s{i}" for i in range(dims)]

    def spread(it):
        for pdf in it:
            x = unit(_matrix(pdf["code"], dims), "f8") if len(pdf) else np.zeros((0, dims))
            yield pd.concat([pdf[["cluster_key", "vec_rowid"]].reset_index(drop=True), pd.DataFrame(x, columns=names)], axis=1)

    rows = stash(vectors.join(members, "vec_rowid").select("cluster_key", "vec_rowid", "code"))
    wide = rows.mapInPandas(spread, "cluster_key long, vec_rowid long, " + ", ".join(f"{s} double" for s in names))
    centre = wide.groupBy("cluster_key").agg(F.count("*").alias("size"), *(F.sum(s).alias("c" + s) for s in names))
    dot = sum((F.col(s) * F.col("c" + s) for s in names), F.lit(0.0))
    norm = F.sqrt(sum((F.col("c" + s) * F.col("c" + s) for s in names), F.lit(0.0)))
    near = wide.join(centre, "cluster_key").select("cluster_key", "size", "vec_rowid", F.round(dot / norm, 6).alias("cosine"))
    w = Window.partitionBy("cluster_key").orderBy(F.desc("cosine"), "vec_rowid")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("cluster_key", "size", "rank", "vec_rowid", "cosine")


def hashed_features(df: DataFrame, key: str, text: str, dims: int = 64) -> DataFrame:
    """(vec_rowid, code): records without an embedding as hashed, idf-weighted word features.

    For records that come as text. Every word goes to one signed bucket, weighted
    by log(1 + n / document frequency); document frequencies are counted over all
    records, and the word counts are joined to them, so nothing grows on the
    driver. Records without a word give no row.
    """
    words = df.select(F.col(key).cast("long").alias("vec_rowid"), F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}]+")).alias("w")).where("w <> '' and vec_rowid is not null")
    tf = words.groupBy("vec_rowid", "w").agg(F.count("*").alias("tf"))
    n = df.select(F.countDistinct(key).alias("n"))
    idf = tf.groupBy("w").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))  # n is one row
    h = F.xxhash64("w")
    cell = tf.join(idf, "w").select(
        "vec_rowid",
        F.pmod(h, F.lit(dims)).cast("int").alias("b"),
        (F.when(F.shiftright(h, 40) % 2 == 0, 1.0).otherwise(-1.0) * F.log1p(F.col("n") / F.col("df")) * (1 + F.log("tf"))).alias("x"),
    )
    sums = cell.groupBy("vec_rowid").agg(*(F.sum(F.when(F.col("b") == i, F.col("x")).otherwise(0.0)).alias(f"s{i}") for i in range(dims)))

    def pack(it):
        for pdf in it:
            codes, ok = encode(pdf[[f"s{i}" for i in range(dims)]].to_numpy("f8"))
            yield pd.DataFrame({"vec_rowid": pdf["vec_rowid"][ok].to_numpy(), "code": [c.tobytes() for c in codes[ok]]})

    return sums.mapInPandas(pack, "vec_rowid long, code binary")
