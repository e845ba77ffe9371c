"""Look-ups by several strategies, field merges with a log, suggestions for names with typing errors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stash


def cascade(left: DataFrame, right: DataFrame, ident: str, other: str, strategies: list[tuple[str, Column, Column]]) -> DataFrame:
    """(ident, other, strategy): for each left row the first strategy whose keys meet, and its smallest match.

    A strategy is a name, a key of the left and a key of the right; NULL keys
    never match. All strategies are one equi-join on (number, key), so the
    tables are shuffled once however many there are.
    """
    side = lambda df, i, at: df.select(i, F.inline(F.array(*(F.struct(F.lit(n).alias("n"), s[at].alias("k")) for n, s in enumerate(strategies))))).where("k is not null")
    j = side(left, ident, 1).join(side(right, other, 2), ["n", "k"]).groupBy(ident).agg(F.min(F.struct("n", other)).alias("m"))
    names = F.array(*(F.lit(s[0]) for s in strategies))
    return j.select(ident, F.col(f"m.{other}").alias(other), F.get(names, F.col("m.n")).alias("strategy"))


def fill_fields(df: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Empty fields of ``df`` from ``new`` (a key once); adds changed, the names of the fields that were filled."""
    n = new.select(key, *(F.col(f).alias(f"_n_{f}") for f in fields))
    j = df.join(n, key, "left")
    empty = {f: F.coalesce(F.col(f).cast("string"), F.lit("")).rlike(r"^\s*$") & F.coalesce(F.col(f"_n_{f}").cast("string"), F.lit("")).rlike(r"\S") for f in fields}
    changed = F.array_join(F.array_compact(F.array(*(F.when(e, F.lit(f)) for f, e in empty.items()))), ",")
    j = j.withColumn("changed", changed)
    return j.select(*(F.when(empty[c], F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns), "changed")


def first_prefix(df: DataFrame, column: str, prefixes: DataFrame) -> DataFrame:
    """Adds short: the name of the first (by ord) prefix of the column, else its first three words.

    ``prefixes``: ord, prefix, short, a small fixed table.
    """
    p = F.broadcast(prefixes)  # fixed values of the caller
    hit = df.select(column).distinct().join(p, F.lower(F.col(column)).startswith(F.lower("prefix"))).groupBy(column).agg(F.min_by("short", "ord").alias("_s"))
    words = F.array_join(F.slice(F.split(F.col(column), " "), 1, 3), " ")
    return df.join(hit, column, "left").withColumn("short", F.coalesce("_s", words)).drop("_s")


def suggestions(asked: DataFrame, known: DataFrame, column: str, most: int = 3, top: int = 5) -> DataFrame:
    """(asked, column, distance, rank): known names within ``most`` edits of an asked one.

    By the pigeonhole rule a name within d edits shares one of its d + 1 equal
    parts with the other, shifted by at most d: asked names are cut into parts
    and met with the substrings of known ones, so all pairs are found without
    comparing everything. Names of up to d letters are not asked for.
    """
    parts = most + 1
    step = F.floor(F.length("asked") / parts).cast("int")
    a = asked.select(F.col(column).alias("asked")).where("asked is not null").distinct().withColumn("step", step)
    own = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: F.struct(i.alias("i"), F.substring("asked", i * F.col("step") + 1, F.when(i == most, F.length("asked") - i * F.col("step")).otherwise(F.col("step"))).alias("part")))
    a = a.where("step > 0").select("asked", "step", F.inline(own))
    k = known.select(column).where(F.col(column).isNotNull()).distinct()
    sizes = a.select("step", "i", F.length("part").alias("w")).distinct()
    at = F.sequence(F.greatest(F.lit(0), F.col("i") * F.col("step") - most), F.col("i") * F.col("step") + most)
    grams = k.crossJoin(F.broadcast(sizes)).select(column, "i", F.explode(F.transform(at, lambda s: F.substring(F.col(column), s + 1, F.col("w")))).alias("part"))  # a row a name length and part
    d = F.levenshtein(F.col("asked"), F.col(column), most)
    near = a.select("asked", "i", "part").join(grams.distinct(), ["i", "part"]).select("asked", column).distinct().withColumn("distance", d).where("distance >= 0")
    w = Window.partitionBy("asked").orderBy("distance", column)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


#: Small words that do not count when a short title is told from a long one.
SHORT_STOP_WORDS = ["a", "an", "the", "of", "in", "for", "and", "or", "is", "to", "by", "on", "at", "its", "with", "from", "that", "this", "not"]


def _once(parts: dict[str, Column], use) -> Column:
    """``use`` of a row of values that are computed once, however often its nested functions look at them."""
    return F.get(F.transform(F.array(F.struct(*(c.alias(n) for n, c in parts.items()))), use), F.lit(0))


def _in_body(s: Column) -> Column:
    """Does the text b hold the title t, or a window of it four fifths of the title's words ws of three and more letters?

    Windows begin every 50 characters and are three titles long, 300 at least.
    Titles of fewer than three such words must stand there whole.
    """
    starts = F.when(F.length(s["b"]) > 50, F.sequence(F.lit(0), F.length(s["b"]) - 51, F.lit(50))).otherwise(F.array().cast("array<int>"))
    near = F.exists(starts, lambda i: F.size(F.filter(s["ws"], lambda w: F.substring(s["b"], i + 1, s["width"]).contains(w))) >= s["need"])
    return (s["t"] != "") & (s["b"].contains(s["t"]) | ((F.size(s["ws"]) >= 3) & near))


def confirmed(title: Column, authors: Column, text: Column) -> Column:
    """Is the text that of the paper? Its title must stand in it; one of fewer than six content words needs one of the first five authors too."""
    one = lambda c: F.regexp_replace(F.lower(c), r"\s+", " ")
    t, b = F.regexp_replace(F.trim(one(title)), r"\.+$", ""), one(text)
    content = F.filter(F.regexp_extract_all(t, F.lit(r"\b([a-z]{2,})\b"), 1), lambda w: ~w.isin(SHORT_STOP_WORDS))
    last = F.transform(F.filter(F.slice(authors, 1, 5), lambda a: a.isNotNull()), lambda a: F.regexp_replace(F.lower(F.element_at(F.split(F.trim(a), r"\s+"), -1)), r"\.+$", ""))
    words = F.regexp_extract_all(t, F.lit("([a-z]{3,})"), 1)
    parts = {"t": t, "b": b, "ws": words, "width": F.greatest(F.length(t) * 3, F.lit(300)), "need": F.floor(F.size(words) * 0.8).cast("int"), "n": F.size(content), "last": last}
    named = lambda s: F.coalesce(F.exists(s["last"], lambda x: (F.length(x) >= 3) & s["b"].contains(x)), F.lit(False))
    return F.coalesce(_once(parts, lambda s: _in_body(s) & ((s["n"] >= 6) | named(s))), F.lit(False))


def _shared(left: list, right: list) -> np.ndarray:
    """[i, j]: how many words the sets left[i] and right[j] have in common. Frequent words are counted by one matrix product."""
    n, m = len(left), len(right)
    own: dict[str, list[int]] = {}
    for i, ws in enumerate(left):
        for w in ws:
            own.setdefault(w, []).append(i)
    met: dict[str, list[int]] = {}
    for j, ws in enumerate(right):
        for w in ws:
            if w in own:
                met.setdefault(w, []).append(j)
    out, often = np.zeros((n, m), "i2"), []
    for w, js in met.items():
        if 32 * len(own[w]) * len(js) > n * m:
            often.append(w)
        else:
            out[np.ix_(own[w], js)] += 1
    if often:
        x, y = np.zeros((n, len(often)), "f4"), np.zeros((m, len(often)), "f4")
        for k, w in enumerate(often):
            x[own[w], k] = 1
            y[met[w], k] = 1
        out += (x @ y.T).astype("i2")
    return out


def shared_words(left: DataFrame, right: DataFrame, least: float = 0.0, block: int = 1024) -> DataFrame:
    """(a, b, shared, most): pairs of rows under one key with the number of words they share and the size of the larger set.

    ``left`` and ``right``: key, id (BIGINT or string), text, words (a set in an
    order that is one for all rows), pos. A pair comes out where the texts
    differ (NULL differs from all), a word at least and ``least`` of the larger
    set is shared, and none of them stands before the first ``pos`` of both
    words: so of several keys that a pair has in common only the first gives it.
    Rows of a key are cut into blocks by their id and every block of one side
    meets every block of the other in a group of its own, so a frequent key is
    spread over tasks; a group's words are counted in numpy at once.
    """
    kinds = [df.schema["id"].dataType.simpleString() for df in (left, right)]
    size = lambda df, c: df.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias(c))
    parts = size(left, "l").join(size(right, "r"), "key")

    def side(df: DataFrame, n: int, own: str, other: str) -> DataFrame:
        mine, theirs = F.pmod(F.xxhash64("id"), F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        df = df.join(parts, "key").withColumn("mine", mine).withColumn("theirs", theirs)
        i, j = ("mine", "theirs") if n == 0 else ("theirs", "mine")
        null = lambda k: F.lit(None).cast(kinds[k])
        return df.select(F.xxhash64("key", i, j).alias("g"), "key", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(n).alias("side"), (F.col("id") if n == 0 else null(0)).alias("a"), (F.col("id") if n else null(1)).alias("b"), "text", "words", "pos")

    def meet(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, held = None, None

        def found():
            (xs, ys), out = held, pd.DataFrame(columns=["a", "b", "shared", "most"])
            if xs and ys:
                n = _shared([x[2] for x in xs], [y[2] for y in ys])
                most = np.maximum.outer([len(x[2]) for x in xs], [len(y[2]) for y in ys])
                good = (n > 0) & (n >= least * most - 1e-9)
                if good.any() and xs[0][3] is not None:
                    good &= _shared([x[2][: x[3]] for x in xs], [y[2][: y[3]] for y in ys]) == 0
                if good.any():
                    good &= _shared([[x[1]] if x[1] is not None else [] for x in xs], [[y[1]] if y[1] is not None else [] for y in ys]) == 0
                r, c = np.nonzero(good)
                ids = [np.array([x[0] for x in v], object if k == "string" else "i8") for v, k in zip((xs, ys), kinds)]
                out = pd.DataFrame({"a": ids[0][r], "b": ids[1][c], "shared": n[r, c].astype("i4"), "most": most[r, c].astype("i4")})
            return out

        for p in it:
            rows = zip(*(p[c].tolist() for c in ("key", "i", "j", "side", "a", "b", "text", "words", "pos")))
            done = []
            for key, i, j, n, a, b, text, words, pos in rows:
                if (key, i, j) != group:
                    if held is not None and held[0] and held[1]:
                        one = found()
                        if len(one) > 100_000:
                            yield one
                        elif len(one):
                            done.append(one)
                    group, held = (key, i, j), ([], [])
                held[n].append((b if n else a, text, list(words), None if pd.isna(pos) else int(pos)))
            if done:
                yield pd.concat(done)
        if held is not None:
            yield found()

    both = side(left, 0, "l", "r").unionByName(side(right, 1, "r", "l"))
    tasks = 4 * left.sparkSession.sparkContext.defaultParallelism  # a stated number: few bytes, much to compare
    return both.repartition(tasks, "g").sortWithinPartitions("g", "key", "i", "j").mapInPandas(meet, f"a {kinds[0]}, b {kinds[1]}, shared int, most int")


def similar_sets(left: DataFrame, right: DataFrame, ident: str, other: str, words: str, least: float) -> DataFrame:
    """(ident, other, overlap): rows whose word sets share at least ``least`` of the larger set.

    Prefix filter: in an order of words from rare to common, two such sets have
    a word in common among the first n - ceil(least * n) + 1 of each, so only
    rows that share one of these meet, and a pair counts under the first that
    they share. Empty and NULL sets are like nothing.
    """
    side = lambda df, i, n: df.select(F.lit(n).alias("side"), F.col(i).cast("string").alias("id"), F.array_distinct(words).alias("ws")).where(F.size("ws") > 0)
    both = side(left, ident, 0).unionByName(side(right, other, 1)).distinct()
    df = both.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    told = both.select("side", "id", F.explode("ws").alias("w")).join(df, "w").groupBy("side", "id").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("ws"))
    told = stash(told.select("side", "id", F.transform("ws", lambda x: x["w"]).alias("words")))
    need = F.size("words") - F.ceil(F.size("words") * least - 1e-9) + 1
    first = lambda n: told.where(F.col("side") == n).select("id", F.lit(None).cast("string").alias("text"), "words", F.posexplode(F.slice("words", 1, need.cast("int"))).alias("pos", "key"))
    hit = shared_words(first(0), first(1), least)
    kind = lambda df, i: df.schema[i].dataType
    return hit.select(F.col("a").cast(kind(left, ident)).alias(ident), F.col("b").cast(kind(right, other)).alias(other), (F.col("shared") / F.col("most")).alias("overlap"))


def place_in_group(df: DataFrame, group: str, ident: str, width: int = 100_000) -> DataFrame:
    """Adds place: from 0, the place of a row in its group in the order of a whole-number ident.

    Ranges of ``width`` idents are counted first; rows are only numbered within
    their range, so a group that holds a tenth of all rows is spread over tasks.
    """
    df = df.withColumn("_range", F.floor(F.col(ident) / width))
    sizes = df.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    starts = sizes.select(group, "_range", before.alias("_start"))
    own = F.row_number().over(Window.partitionBy(group, "_range").orderBy(ident)) - 1
    return df.withColumn("_own", own).join(starts, [group, "_range"]).withColumn("place", F.col("_start") + F.col("_own")).drop("_range", "_own", "_start")


def numbered_twins(df: DataFrame, name: str, order: str) -> DataFrame:
    """Adds unique_name: the first row of a name keeps it, later ones get '-2', '-3' and so on."""
    r = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return df.withColumn("_r", r).withColumn("unique_name", F.when(F.col("_r") > 1, F.concat_ws("-", name, F.col("_r").cast("string"))).otherwise(F.col(name))).drop("_r")
