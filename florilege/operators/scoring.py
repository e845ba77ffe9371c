"""Scoring and selection of candidate papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import keyword_hit

#: Weights of the three profile parts.
PROFILE = (0.5, 0.3, 0.2)


def with_keyword_score(df: DataFrame, text: Column, high: list[str], medium: list[str], tags: int = 5) -> DataFrame:
    """Adds keyword_score, keyword_tier and matched (the first ``tags`` keywords that occur).

    Score: (3 * high + medium) / 10, at most 1. One pass of boolean expressions,
    whatever the number of keywords; a NULL text matches nothing.
    """
    hits = [(k, keyword_hit(text, k)) for k in [*high, *medium]]
    n = [sum((h.cast("int") for _, h in part), F.lit(0)) for part in (hits[: len(high)], hits[len(high) :])]
    found = F.array_compact(F.array(*(F.when(h, F.lit(k.lstrip("~"))) for k, h in hits)))
    score = F.least((3 * n[0] + n[1]) / F.lit(10.0), F.lit(1.0))
    return df.withColumns(
        {
            "keyword_score": F.round(score, 2),
            "keyword_tier": F.when(score >= 0.6, "high").when(score >= 0.3, "medium").otherwise("low"),
            "matched": F.slice(F.array_distinct(found), 1, tags),
        }
    )


def profile_score(core: Column, methods: Column, adjacent: Column) -> Column:
    """Weighted similarity to the three profile parts."""
    return PROFILE[0] * core + PROFILE[1] * methods + PROFILE[2] * adjacent


def combined_score(relevance: Column, surprise: Column) -> Column:
    return 0.7 * relevance + 0.3 * surprise


def known(c: Column) -> Column:
    """NULL for NaN, so that scores that are no numbers drop out of comparisons."""
    return F.when(~F.isnan(c), c)


def score_tier(c: Column) -> Column:
    return F.when(c >= 6.0, "high").when(c >= 4.5, "medium").otherwise("low")


def sections(df: DataFrame, relevance: str, surprise: str, ident: str, least: float = 3.0, pool: float = 2.5, odd: float = 7.5, slots: int = 10) -> DataFrame:
    """Rows of the digest with their section: main (relevance >= least) or wildcard.

    Wildcards are the ``slots`` most surprising rows of pool <= relevance < least
    with surprise >= odd, ties to the smaller ident; a top-k plan, no full sort.
    Rows without scores are in neither section.
    """
    r, s = known(F.col(relevance)), known(F.col(surprise))
    main = df.where(r >= least).withColumn("section", F.lit("main"))
    wild = df.where((r >= pool) & (r < least) & (s >= odd)).orderBy(F.desc(surprise), ident).limit(slots)
    return main.unionByName(wild.withColumn("section", F.lit("wildcard")))


def failure_gate(df: DataFrame, by: list[str], failed: Column, percent: float = 50.0) -> DataFrame:
    """Per run: total, failed, and whether more than ``percent`` failed (so nothing must be published)."""
    g = df.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(failed).alias("failed"))
    return g.withColumn("abort", F.col("failed") * 100.0 / F.col("total") > percent)
