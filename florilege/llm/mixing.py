"""Mixing sources to target weights by hierarchical budgets and seeded epochs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stash
from . import tokens as K


def with_token_counts(df: DataFrame, text: str = "text", name: str = "n_tokens", folder: str = K.TOKENIZERS, vocabulary: str = K.VOCABULARY) -> DataFrame:
    """Adds the number of tokens of ``text`` and drops the text (and an older column of that name); NULL and empty texts have 0."""
    rest = [c for c in df.columns if c not in (text, name)]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = pdf[rest].copy()
            out[name] = [K.count(t, folder, vocabulary) for t in pdf[text]]
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in rest)
    return df.mapInPandas(run, f"{schema}, `{name}` long")


def _fill(need: float, kids: dict[str, dict]) -> None:
    """Splits a node's budget over its children by weight; what a full child cannot take goes to its siblings."""
    open_, left = set(kids), need
    for k in kids:
        kids[k]["budget"] = 0.0
    while open_ and left > 1e-9:
        total = sum(kids[k]["weight"] for k in open_)
        if total <= 0:
            break
        over, share = set(), left
        for k in sorted(open_):
            room = kids[k]["room"] - kids[k]["budget"]
            if share * kids[k]["weight"] / total >= room:
                over.add(k)
        if not over:
            for k in open_:
                kids[k]["budget"] += share * kids[k]["weight"] / total
            left = 0.0
            break
        for k in over:
            left -= kids[k]["room"] - kids[k]["budget"]
            kids[k]["budget"] = kids[k]["room"]
        open_ -= over
    for k in kids:
        node = kids[k]
        if node.get("kids"):
            _fill(node["budget"], node["kids"])


def budgets(leaves: list[dict], total: float | None) -> tuple[float, list[dict]]:
    """(total, leaves with their budget).

    A leaf has domain, language, source, tokens, weight (its share of the
    total), max_repeats. Weights are summed up the tree domain - language -
    source, each node's budget is split over its children by weight, and a
    child's shortage (its room is tokens * max_repeats) goes to its siblings
    first; only what a whole branch cannot take reaches the branch's siblings.
    Without ``total`` the largest one is taken at which no leaf runs short, so
    that all shares are met. The tree is as large as the number of leaves.
    """
    for x in leaves:
        x["room"] = float(x["tokens"]) * x["max_repeats"]
    able = [x for x in leaves if x["weight"] > 0]
    if total is None:
        total = min((x["room"] / x["weight"] for x in able), default=0.0)
    root: dict[str, dict] = {}
    for x in able:
        node = root
        for level in (x["domain"], x["language"]):
            node = node.setdefault(level, {"kids": {}, "weight": 0.0, "room": 0.0})
            node["weight"] += x["weight"]
            node["room"] += x["room"]
            node = node["kids"]
        node[x["source"]] = x
    _fill(total, root)
    return total, leaves


def mix(
    docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17, buckets: int = 1024, domains: dict[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(selection, report).

    ``docs``: doc_id, source, lang, n_tokens. ``targets``: source, target_share,
    max_repeats. selection: doc_id, source, lang, n_tokens, repeats. report:
    source, domain, target_share, max_repeats, n_docs, source_tokens,
    used_tokens, actual_share, target_tokens. ``domains``: source -> domain, the
    upper level of the tree; a source without one is a domain of its own.

    A source's target is spread over its languages in proportion to their
    tokens. Every leaf takes whole epochs as often as its budget holds its
    tokens, and of the next, in an order seeded by epoch and doc_id, the prefix
    whose tokens come nearest to the rest (so a leaf misses its budget by at
    most half a document).
    The prefix is found by summing hash buckets first: only the bucket in which
    a leaf's budget ends is ordered row by row, so a source with a third of all
    rows is never sorted by one task. Documents of sources without a target,
    NULL sources included, are left out; no document is used more often than
    max_repeats. Sources of a target without documents report 0. Language
    tags are compared without case and blanks; NULL and blank are one language.
    """
    spark = docs.sparkSession
    lang = F.coalesce(F.nullif(F.lower(F.trim("lang")), F.lit("")), F.lit("und"))
    docs = stash(
        docs.where("doc_id is not null")
        .withColumn("leaf_lang", lang)
        .join(targets.select("source").distinct(), "source", "left_semi")
        .select("doc_id", "source", "lang", "leaf_lang", "n_tokens")
    )
    want = {r["source"]: r for r in targets.collect()}  # one row a source, as given
    sums = docs.groupBy("source", "leaf_lang").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).collect()
    per = {}
    for r in sums:
        per[r["source"]] = per.get(r["source"], 0) + r["tokens"]
    leaves = []
    for r in sums:
        t = want[r["source"]]
        share = t["target_share"] * r["tokens"] / per[r["source"]] if per[r["source"]] else 0.0
        leaves.append({"domain": (domains or {}).get(r["source"], r["source"]), "language": r["leaf_lang"], "source": r["source"], "tokens": r["tokens"], "weight": share, "max_repeats": t["max_repeats"]})
    total, leaves = budgets(leaves, total)
    plan = []
    for x in leaves:
        b = x.get("budget", 0.0)
        whole = min(int(b // x["tokens"]) if x["tokens"] else 0, x["max_repeats"])
        part = b - whole * x["tokens"] if whole < x["max_repeats"] else 0.0
        plan.append((x["source"], x["language"], whole, float(part)))
    plan = spark.createDataFrame(plan, "source string, leaf_lang string, whole int, part double")  # one row a leaf
    h = F.xxhash64(F.lit(seed), F.col("whole"), F.col("doc_id"))
    placed = docs.join(plan, ["source", "leaf_lang"]).withColumn("h", h).withColumn("b", F.pmod(h, F.lit(buckets)))
    by_bucket = placed.groupBy("source", "leaf_lang", "b").agg(F.sum("n_tokens").alias("t"), F.first("part").alias("part"))
    w = Window.partitionBy("source", "leaf_lang").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # at most ``buckets`` rows a leaf
    by_bucket = by_bucket.withColumn("before", F.coalesce(F.sum("t").over(w), F.lit(0)))
    edges = by_bucket.where("before < part").groupBy("source", "leaf_lang").agg(F.max(F.struct("b", "before")).alias("e"))  # the last bucket a leaf reaches
    placed = placed.join(edges.select("source", "leaf_lang", F.col("e.b").alias("edge"), F.col("e.before").alias("before")), ["source", "leaf_lang"], "left")
    sure = placed.where("b < edge").withColumn("extra", F.lit(1))
    w2 = Window.partitionBy("source", "leaf_lang", "b").orderBy("h", "doc_id")
    edge = placed.where("b = edge").withColumn("extra", (F.col("before") + F.sum("n_tokens").over(w2) - F.col("n_tokens") / 2 <= F.col("part")).cast("int"))
    rest = placed.where("edge is null or b > edge").withColumn("extra", F.lit(0))
    cols = ["doc_id", "source", "lang", "n_tokens", (F.col("whole") + F.col("extra")).alias("repeats")]
    chosen = stash(sure.select(*cols).unionByName(edge.select(*cols)).unionByName(rest.select(*cols)).where("repeats > 0"))
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"), F.count("*").alias("n_docs"))
    named = F.create_map(*(F.lit(x) for kv in (domains or {"": ""}).items() for x in kv))
    domain = F.coalesce(F.try_element_at(named, F.col("source")), F.col("source")).alias("domain")
    all_used = chosen.agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("all_tokens"))
    have = docs.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    report = (
        targets.select("source", "target_share", "max_repeats")
        .join(used, "source", "left")
        .join(have, "source", "left")
        .crossJoin(F.broadcast(all_used))  # one row
        .select(
            "source", domain, "target_share", "max_repeats", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"),
            F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.round(F.coalesce("used_tokens", F.lit(0)) / F.col("all_tokens"), 6).alias("actual_share"),
            F.round(F.col("target_share") * F.lit(float(total)), 1).alias("target_tokens"),
        )
    )
    return chosen, report
