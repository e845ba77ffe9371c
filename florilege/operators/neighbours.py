"""Nearest vectors of a stated query set, profiles, and the graph built from neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def mean_vectors(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, pos, mean, n): element-wise means, in long form; partial sums on the map side. NULL vectors don't count."""
    long = df.where(F.col(vector).isNotNull()).select(group, F.posexplode(vector).alias("pos", "x"))
    return long.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count("*").alias("n"))


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centroid): mean vectors scaled to length 1."""
    m = mean_vectors(df, group, vector).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("v"))  # one entry a dimension
    return m.select(group, V.unit(F.transform("v", lambda x: x["mean"])).alias("centroid"))


def nearest(df: DataFrame, queries: DataFrame, ident: str, vector: str, k: int, least: float | None = None, rows: int = 4096) -> DataFrame:
    """(query, ident, sim, rank): the k most similar other vectors of each query, by exact cosine, ties to the smaller ident.

    Both sides are packed into blocks of at most ``rows`` vectors; every query
    block meets every block once, as a matrix product in its own task, and only
    the k best of a query leave it. Memory of a task is two blocks, whatever the
    tables' sizes. Zero, NULL and NaN vectors are left out.
    """

    def pack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            for a in range(0, len(p), rows):
                own = p.iloc[a : a + rows]
                x = np.stack(own[vector].to_list()).astype("f8") if len(own) else np.zeros((0, 1))
                n = np.linalg.norm(x, axis=1)
                ok = np.isfinite(n) & (n > 0)
                if ok.any():
                    yield pd.DataFrame({"ids": [own[ident].to_numpy("i8")[ok].tobytes()], "xs": [(x[ok] / n[ok, None]).tobytes()], "dims": [x.shape[1]]})

    def blocks(d: DataFrame, tag: str) -> DataFrame:
        live = d.where(F.col(vector).isNotNull() & F.col(ident).isNotNull()).select(ident, vector)
        return live.mapInPandas(pack, "ids binary, xs binary, dims int").toDF(f"ids_{tag}", f"xs_{tag}", f"dims_{tag}")

    def best(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            for r in p.itertuples():
                qi, di = np.frombuffer(r.ids_q, "<i8"), np.frombuffer(r.ids_d, "<i8")
                s = np.round(np.frombuffer(r.xs_q).reshape(len(qi), -1) @ np.frombuffer(r.xs_d).reshape(len(di), -1).T, 6)
                s[qi[:, None] == di[None, :]] = -2
                if least is not None:
                    s[s < least] = -2
                o = np.lexsort((np.broadcast_to(di, s.shape), -s), axis=1)[:, :k]
                v = np.take_along_axis(s, o, 1)
                a, b = np.nonzero(v > -2)
                yield pd.DataFrame({"query": qi[a], ident: di[o[a, b]], "sim": v[a, b]})

    pairs = blocks(queries, "q").repartition(df.sparkSession.sparkContext.defaultParallelism).crossJoin(blocks(df, "d"))  # blocks, not rows: a stated query set against all
    near = pairs.mapInPandas(best, f"query long, {ident} long, sim double")
    w = Window.partitionBy("query").orderBy(F.desc("sim"), ident)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def undirected(edges: DataFrame, src: str, dst: str, weight: str) -> DataFrame:
    """(a, b, weight), a < b: one edge a pair with the larger weight of both directions; loops and weights <= 0 go."""
    e = edges.where(F.col(src) != F.col(dst)).groupBy(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).agg(F.max(weight).alias("weight"))
    return e.where("weight > 0")


def soft_members(df: DataFrame, ident: str, vector: str, group: str, top_percent: float = 60.0) -> DataFrame:
    """(ident, group, sim, is_primary): a row belongs to its own group and to every group whose centroid is as near to it as to the group's top members.

    A group's bar is the (100 - top_percent) percentile of its members'
    similarity to the centroid. The centroids (one row a group) are joined to
    all rows, which is the size of the answer before the bar is applied.
    """
    c = centroids(df, group, vector)
    own = df.select(ident, vector, F.col(group).alias("own")).where(F.col(vector).isNotNull())
    sims = own.crossJoin(c).select(ident, "own", group, F.round(V.cosine(F.col(vector), F.col("centroid")), 6).alias("sim"))
    bar = sims.where(F.col("own") == F.col(group)).groupBy(group).agg(F.expr(f"percentile(sim, {(100 - top_percent) / 100})").alias("bar"))
    return sims.join(bar, group).where((F.col("sim") >= F.col("bar")) | (F.col("own") == F.col(group))).select(ident, group, "sim", (F.col("own") == F.col(group)).alias("is_primary"))
