"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stash, unstash


def _lowest(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m): m is the smaller of u and its least neighbour."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node id reached.

    ``edges`` has two columns of one orderable type. NULL ends and loops are
    ignored; repeated and reversed edges count once; nodes without an edge to
    another node do not appear. An empty input gives an empty result. Every
    round is two partial-aggregated groupings joined back on the node, so a hub
    is split by the skew join and no neighbour list is ever built.
    """
    e = edges.select(F.least(src, dst).alias("v"), F.greatest(src, dst).alias("u"))
    e = stash(e.where("u is not null and v is not null and u <> v").distinct())
    last = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = _lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = _lowest(large)
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        nxt = stash(small.where("u <> v").distinct())
        mark = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        unstash(e)
        e = nxt
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
