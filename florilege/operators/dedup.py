"""Duplicate registries, groups, canonical rows and seen-key filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import doi_key, pmid_digits, title_key


def paper_keys(df: DataFrame, ident: str = "id", least_title: int = 20) -> DataFrame:
    """(ident, kind, value): the comparable identifiers of each row, in long form.

    Kinds pmid, doi and title (only titles above ``least_title`` characters).
    Rows without any give no row.
    """
    t = title_key("title")
    kinds = F.array(
        F.struct(F.lit("pmid").alias("kind"), pmid_digits("pmid").alias("value")),
        F.struct(F.lit("doi").alias("kind"), doi_key("doi").alias("value")),
        F.struct(F.lit("title").alias("kind"), F.when(F.length(t) > least_title, t).alias("value")),
    )
    return df.select(ident, F.inline(kinds)).where("value is not null")


def registry(keys: DataFrame, ident: str = "id") -> DataFrame:
    """(kind, value, n, first): how many rows hold a value, and the smallest of them."""
    return keys.groupBy("kind", "value").agg(F.count_distinct(ident).alias("n"), F.min(ident).alias("first"))


def registry_stats(keys: DataFrame, ident: str = "id") -> DataFrame:
    """Per kind: distinct values, values held once, values held more often."""
    return registry(keys, ident).groupBy("kind").agg(F.count("*").alias("values"), F.count_if(F.col("n") == 1).alias("unique_values"), F.count_if(F.col("n") > 1).alias("shared_values"))


def duplicate_groups(keys: DataFrame, ident: str = "id") -> DataFrame:
    """(kind, value, n, first, last, seen) of values held by two and more rows.

    Identifiers are tried in the order pmid, doi, title. ``seen``: some member is
    in a group of an earlier kind that is not seen itself. Titles make a group
    only where rows with and without a PubMed number share one. Membership is
    joined by row, groups are only counted, so one of any size is one small row.
    """
    keys = keys.distinct()
    g = keys.groupBy("kind", "value").agg(F.count("*").alias("n"), F.min(ident).alias("first"), F.max(ident).alias("last")).where("n > 1")
    members = keys.join(g, ["kind", "value"])
    of = lambda kind: members.where(F.col("kind") == kind)
    touched = lambda rows, ids: rows.join(ids.select(ident).distinct().withColumn("_hit", F.lit(1)), ident, "left").groupBy("kind", "value", "n", "first", "last").agg((F.count("_hit") > 0).alias("seen"))
    numbered = of("pmid")
    doi = touched(of("doi"), numbered)
    told = numbered.select(ident).unionByName(of("doi").join(doi.where("not seen").select("kind", "value"), ["kind", "value"], "left_semi").select(ident))
    has = keys.where("kind = 'pmid'").select(ident, F.lit(1).alias("_has"))
    mixed = of("title").join(has, ident, "left").groupBy("kind", "value").agg(F.count("_has").alias("with"), F.count("*").alias("all")).where("with > 0 and with < all").select("kind", "value")
    title = touched(of("title").join(mixed, ["kind", "value"], "left_semi"), told)
    return numbered.select("kind", "value", "n", "first", "last", F.lit(False).alias("seen")).distinct().unionByName(doi).unionByName(title)


def canonical_rows(df: DataFrame, group: Column, preference: list[Column], ident: str = "id") -> DataFrame:
    """One row of each group of two and more: group, kept, n, runner_up, decided_by.

    ``preference``: descending sort keys; the row with the largest tuple is
    kept, ties to the smaller ident. decided_by is the number of the first key
    (from 1) in which it beats the runner-up, 0 for a tie. Two aggregations with
    partial maxima instead of a sort of each group.
    """
    keys = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(preference)), (-F.col(ident)).alias("neg"))
    rows = df.select(group.alias("group"), F.col(ident).alias("ident"), keys.alias("k")).where("group is not null")
    best = rows.groupBy("group").agg(F.max("k").alias("best"), F.count("*").alias("n")).where("n > 1")
    rest = rows.join(best, "group").where(F.col("k") < F.col("best"))
    second = rest.groupBy("group").agg(F.max("k").alias("second"), F.first("best").alias("best"), F.first("n").alias("n"))
    decided = F.lit(0)
    for i in reversed(range(len(preference))):
        decided = F.when(~F.col(f"best.k{i}").eqNullSafe(F.col(f"second.k{i}")), i + 1).otherwise(decided)
    return second.select("group", (-F.col("best.neg")).alias("kept"), "n", (-F.col("second.neg")).alias("runner_up"), decided.alias("decided_by"))


def first_wins(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of every key in arrival order; rows with a NULL in the key are left out."""
    w = Window.partitionBy(*key).orderBy(order)
    live = F.lit(True)
    for k in key:
        live = live & F.col(k).isNotNull()
    return df.where(live).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def unseen(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share none of ``keys`` with ``seen``: one anti-join a key; NULL keys never match."""
    for k in keys:
        df = df.join(seen.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti")
    return df


def content_addressed(df: DataFrame, text: str, ident: str) -> DataFrame:
    """(hash, first, n): one row per distinct body. NULL bodies have none."""
    return df.where(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("hash")).agg(F.min(ident).alias("first"), F.count("*").alias("n"))


def latest_version(df: DataFrame, key: str, version: str, ident: str, label: str) -> DataFrame:
    """The row with the highest version of each key (ties: larger ident) and all labels seen, sorted."""
    g = df.where(F.col(key).isNotNull()).groupBy(key)
    return g.agg(
        F.max(F.struct(F.col(version), F.col(ident))).alias("top"), F.array_join(F.array_sort(F.collect_set(label)), "; ").alias("labels"), F.count("*").alias("n")
    ).select(key, F.col(f"top.{version}").alias(version), F.col(f"top.{ident}").alias(ident), "labels", "n")
