"""Full-text search on a postings table, rank fusion, chunks and snippets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stash

#: Terms of all queries together up to which they are looked for by one pattern.
MOST_ASKED = 1000


def tokens(c: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.col(c) if isinstance(c, str) else c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def postings(docs: DataFrame, ident: str, columns: list[str]) -> DataFrame:
    """(ident, column, term, tf): one row per distinct term of a column of a document. Empty columns have none."""
    cols = F.array(*(F.struct(F.lit(c).alias("column"), tokens(F.coalesce(F.col(c), F.lit(""))).alias("ts")) for c in columns))
    long = docs.where(F.col(ident).isNotNull()).select(ident, F.inline(cols))
    return long.select(ident, "column", F.explode("ts").alias("term")).groupBy(ident, "column", "term").agg(F.count("*").alias("tf"))


def update_postings(old: DataFrame, changed: DataFrame, gone: DataFrame, ident: str, columns: list[str]) -> DataFrame:
    """Postings after an insert or update of ``changed`` documents and the removal of ``gone`` ones; only changed documents are tokenised."""
    ids = changed.select(ident).unionByName(gone.select(ident)).distinct()
    fresh = postings(changed.join(gone.select(ident).distinct(), ident, "left_anti"), ident, columns)
    return old.join(ids, ident, "left_anti").unionByName(fresh)


def search(
    docs: DataFrame, queries: DataFrame, ident: str, weights: dict[str, float], limit: int = 20, k1: float = 1.2, b: float = 0.75
) -> DataFrame:
    """(query, ident, bm25, score, rank): conjunctive prefix search ranked by BM25 over weighted columns.

    ``queries``: query, text. Every term must begin a word of some column. Term
    frequencies count per column and are weighted; length is the whole
    document's. Words that no query means are dropped while documents are read,
    by one pattern of all terms, or, for more than MOST_ASKED terms, by a join
    with the part of the vocabulary that they begin; only document lengths are
    computed for all.
    score = bm25 / (1 + bm25); the weight of a term that most documents hold is
    not below 1e-6. Ties go to the smaller ident. Queries without a term find nothing.
    """
    wanted = queries.select("query", F.explode(F.array_distinct(tokens("text"))).alias("prefix"))
    need = wanted.groupBy("query").agg(F.count("*").alias("need"))
    total = F.regexp_count(F.lower(F.concat_ws(" ", *weights)), F.lit(r"[\p{L}\p{N}]+"))
    size = docs.where(F.col(ident).isNotNull()).select(ident, total.alias("len"))
    stats = size.agg(F.count("*").alias("n"), F.avg("len").alias("avglen"))
    asked = [r["prefix"] for r in wanted.select("prefix").distinct().limit(MOST_ASKED + 1).collect()]
    few = len(asked) <= MOST_ASKED
    longest = max(map(len, asked), default=1) if few else wanted.agg(F.max(F.length("prefix"))).first()[0]
    begins = r"(?<![\p{L}\p{N}])((?:" + "|".join(asked) + r")[\p{L}\p{N}]*)" if asked else "(^$)"
    keep = (lambda c: F.regexp_extract_all(F.lower(c), F.lit(begins), 1)) if few else tokens
    cols = F.array(*(F.struct(F.lit(x).alias("w"), keep(F.coalesce(F.col(c), F.lit(""))).alias("ts")) for c, x in weights.items()))
    words = docs.where(F.col(ident).isNotNull()).select(ident, F.inline(cols)).select(ident, "w", F.explode("ts").alias("term"))
    heads = F.transform(F.sequence(F.lit(1), F.least(F.length("term"), F.lit(longest))), lambda i: F.substring(F.col("term"), F.lit(1), i))
    if few:
        hits = words.withColumn("prefix", F.explode(heads)).join(wanted, "prefix")
    else:
        hits = words.join(words.select("term").distinct().withColumn("prefix", F.explode(heads)).join(wanted, "prefix"), "term")
    per = hits.groupBy("query", "prefix", ident).agg(F.sum("w").alias("tf"))
    df = per.groupBy("query", "prefix").agg(F.count("*").alias("df"))
    scored = per.join(df, ["query", "prefix"]).join(size, ident).crossJoin(F.broadcast(stats))  # stats is one row
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avglen")))
    out = scored.groupBy("query", ident).agg(F.sum(part).alias("bm25"), F.count("*").alias("got")).join(need, "query").where("got = need")
    out = out.select("query", ident, F.round("bm25", 6).alias("bm25"), F.round(F.col("bm25") / (1 + F.col("bm25")), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bm25"), ident))
    return out.withColumn("rank", rank).where(F.col("rank") <= limit)


def run_around(words: Column, at: Column, most: int = 8) -> Column:
    """Up to ``most`` words in a row of an array, with the one at place ``at`` (from 0) in the middle where possible."""
    n = F.size(words)
    start = F.greatest(F.least(at - most // 2, n - most), F.lit(0))
    return F.slice(words, start + 1, F.least(n, F.lit(most)))


def _longer(z: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Hashes of runs of words, one word longer."""
    z = (z ^ x) * np.uint64(0x9E3779B97F4A7C15)
    return z ^ (z >> np.uint64(29))


def meet_runs(docs: DataFrame, asked: DataFrame, ident: str, other: str, most: int = 8, bits: int = 25) -> DataFrame:
    """(ident, other): documents and what is asked for whose run of words stands in them, by hash: a caller compares the texts.

    ``docs``: ident BIGINT, words ARRAY<STRING>; ``asked``: other, run, one to
    ``most`` words. Runs of documents are hashed in one scan, and those that a
    bit map of all asked ones excludes are dropped there; the map has
    2 ** ``bits`` bits (4 MB) however many are asked for.
    """
    hashes = lambda c: F.transform(c, lambda w: F.xxhash64(w))

    def keys(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            size = p["run"].map(len).to_numpy("i8")
            h, z = np.zeros((len(p), most), "i8"), np.zeros(len(p), "u8")
            h[np.arange(most) < size[:, None]] = np.concatenate(p["run"].tolist()) if len(p) else []
            for k in range(most):
                z = np.where(k < size, _longer(z, np.ascontiguousarray(h[:, k]).view("u8")), z)
            yield pd.DataFrame({other: p[other], "key": _longer(z, size.view("u8")).view("i8")})

    kind = asked.schema[other].dataType.simpleString()
    want = stash(asked.select(other, hashes("run").alias("run")).mapInPandas(keys, f"{other} {kind}, key long"))

    def pack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            yield pd.DataFrame({"at": [p["at"].to_numpy("<i4").tobytes()]})

    size = 2**bits
    marks = np.zeros(size // 8, "u1")
    for r in want.select(F.pmod("key", F.lit(size)).cast("int").alias("at")).distinct().mapInPandas(pack, "at binary").toLocalIterator():
        at = np.frombuffer(r["at"], "<i4")
        np.bitwise_or.at(marks, at >> 3, (1 << (at & 7)).astype("u1"))
    held = docs.sparkSession.sparkContext.broadcast(marks)

    def runs(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = held.value
        for p in it:
            n = p["words"].map(len).to_numpy("i8")
            h = np.concatenate(p["words"].tolist()).astype("i8").view("u8") if n.sum() else np.zeros(0, "u8")
            doc, left = np.repeat(np.arange(len(n)), n), np.repeat(np.cumsum(n), n) - np.arange(len(h))
            out, at, z = [], np.arange(len(h)), np.zeros(len(h), "u8")
            for k in range(1, most + 1):
                long = left[at] >= k
                at = at[long]
                z = _longer(z[long], h[at + k - 1])
                key = _longer(z, np.uint64(k)).view("i8")
                place = key & (size - 1)
                good = marks[place >> 3] >> (place & 7).astype("u1") & 1 > 0
                out.append(np.stack([doc[at[good]], key[good]], 1))
            found = np.unique(np.concatenate(out), axis=0)
            yield pd.DataFrame({ident: p[ident].to_numpy()[found[:, 0]], "key": found[:, 1]})

    found = docs.select(ident, hashes("words").alias("words")).mapInPandas(runs, f"{ident} long, key long")
    return found.join(want, "key").select(ident, other)


def fuse_ranks(lists: DataFrame, ident: str, k: int = 60, limit: int = 40) -> DataFrame:
    """(query, ident, score, rank): reciprocal rank fusion.

    ``lists``: query, ident, rank (from 1), weight. Sum of weight / (k + rank),
    plus 0.05 for a first place and 0.02 for a best place of two or three.
    """
    best = F.min("rank")
    bonus = F.when(best == 1, 0.05).when(best <= 3, 0.02).otherwise(0.0)
    g = lists.groupBy("query", ident).agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))) + bonus, 6).alias("score"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), ident))).where(F.col("rank") <= limit)


def blend(fused: DataFrame, rerank: Column) -> DataFrame:
    """Adds blended: the fused place and a reranker's score, the place weighing less further down."""
    w = F.when(F.col("rank") <= 3, 0.75).when(F.col("rank") <= 10, 0.60).otherwise(0.40)
    return fused.withColumn("blended", F.round(w / F.col("rank") + (1 - w) * rerank, 6))


_BREAKS = (("\n\n",), (". ", ".\n", "? ", "?\n", "! ", "!\n"), ("\n",), (" ",))


def _chunks(text: str, most: int, overlap: int, look: float) -> list[tuple[int, int]]:
    out, a, n = [], 0, len(text)
    while a < n:
        b = min(n, a + most)
        if b < n:
            from_ = a + int(most * look)
            for s in _BREAKS:
                at = max((text.rfind(m, from_, b) + len(m) for m in s if text.rfind(m, from_, b) >= 0), default=-1)
                if at >= 0:
                    b = at
                    break
        out.append((a, b))
        if b >= n:
            break
        a = max(b - overlap, a + 1) if b - overlap > a else b
    return out


def chunk_text(docs: DataFrame, ident: str, text: str, most: int = 3200, overlap: int = 480, look: float = 0.7) -> DataFrame:
    """(ident, seq, pos, n_chars, text): pieces of at most ``most`` characters.

    A piece ends at a paragraph, sentence, line or word, in this order, if there
    is one in its last part (from ``look``); the next starts ``overlap``
    characters before. Empty and NULL texts have no piece. No shuffle.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            rows = [(i, s, a, b - a, t[a:b]) for i, t in zip(p[ident], p[text]) if t for s, (a, b) in enumerate(_chunks(t, most, overlap, look))]
            yield pd.DataFrame(rows, columns=[ident, "seq", "pos", "n_chars", "text"])

    kind = docs.schema[ident].dataType.simpleString()
    return docs.where(F.col(ident).isNotNull()).select(ident, text).mapInPandas(run, f"{ident} {kind}, seq int, pos long, n_chars int, text string")


def chunk_words(docs: DataFrame, ident: str, text: str, most: int = 800, overlap: int = 120, look: float = 0.7) -> DataFrame:
    """(ident, seq, pos, n_tokens, text): pieces of at most ``most`` words, ``most - overlap`` apart.

    A token is a word with the blanks before it, so tokens joined are the text. A
    piece that is not the last is cut behind the last paragraph, else sentence,
    else line end in its last part (from ``look``). pos is the token's place
    times the mean length of a token. Empty and NULL texts have no piece.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            rows = []
            for i, t in zip(p[ident], p[text]):
                tokens_ = re.findall(r"\s*\S+|\s+$", t or "")
                for seq, a in enumerate(range(0, max(1, len(tokens_) - overlap), most - overlap) if tokens_ else ()):
                    piece = "".join(tokens_[a : a + most])
                    if a + most < len(tokens_):
                        start = int(len(piece) * look)
                        for marks in (("\n\n",), (". ", ".\n", "? ", "?\n", "! ", "!\n"), ("\n",)):
                            at = max((piece.rfind(m, start) + len(m) for m in marks if piece.rfind(m, start) >= 0), default=-1)
                            if at >= 0:
                                piece = piece[:at]
                                break
                    rows.append((i, seq, int(a * len(t) / len(tokens_)), len(tokens_[a : a + most]), piece))
            yield pd.DataFrame(rows, columns=[ident, "seq", "pos", "n_tokens", "text"])

    kind = docs.schema[ident].dataType.simpleString()
    return docs.where(F.col(ident).isNotNull()).select(ident, text).mapInPandas(run, f"{ident} {kind}, seq int, pos long, n_tokens int, text string")


def snippets(docs: DataFrame, text: str, terms: list[str], most: int = 500) -> DataFrame:
    """Adds line (from 1) and snippet: from one line above the line with most query terms (the first of equals) to two below, cut at ``most``."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    hits = lambda s: sum((F.lower(s).contains(t.lower()).cast("int") for t in terms), F.lit(0))
    scored = F.transform(lines, lambda s, i: F.struct(hits(s).alias("n"), (-i).alias("i")))
    best = -F.array_max(scored)["i"]
    start = F.greatest(best, F.lit(1))
    body = F.array_join(F.slice(lines, start, best - start + 4), "\n")
    return docs.withColumn("line", best + 1).withColumn("snippet", F.substring(body, 1, most))


def find_documents(asked: DataFrame, docs: DataFrame, ask: str, name: str, ident: str) -> DataFrame:
    """(ask, ident, how): the document a name means, by short id ('#' and six hex digits, or those alone), whole path, or end of a path.

    ``docs``: ident, docid, path. The first way that finds something wins, of
    several documents the smallest ident; names nobody has are 'not found'. All
    ways are one equi-join: a path is listed under each of its ends.
    """
    plain = F.regexp_replace(F.regexp_replace(F.trim(name), "^[a-z]+://", ""), '^"|"$', "")
    short = F.lower(F.regexp_extract(plain, "^#?([0-9a-fA-F]{6})$", 1))
    want = asked.select(ask, F.inline(F.array(F.struct(F.lit(0).alias("n"), F.nullif(short, F.lit("")).alias("k")), F.struct(F.lit(1).alias("n"), plain.alias("k")), F.struct(F.lit(2).alias("n"), plain.alias("k"))))).where("k is not null")
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.struct(F.lit(2).alias("n"), F.array_join(F.slice(parts, i, F.size(parts)), "/").alias("k")))
    ends = F.when(F.size(parts) > 1, ends).otherwise(F.array().cast("array<struct<n:int,k:string>>"))
    have = docs.select(F.col(ident).alias("_found"), F.inline(F.concat(F.array(F.struct(F.lit(0).alias("n"), F.col("docid").alias("k")), F.struct(F.lit(1).alias("n"), F.col("path").alias("k"))), ends))).where("k is not null")
    best = want.join(have, ["n", "k"]).groupBy(ask).agg(F.min(F.struct("n", "_found")).alias("m"))
    how = F.coalesce(F.get(F.array(F.lit("docid"), F.lit("path"), F.lit("suffix")), F.col("m.n")), F.lit("not found"))
    return asked.select(ask).join(best, ask, "left").select(ask, F.col("m._found").alias(ident), how.alias("how"))


def glob_pattern(glob: str) -> str:
    """Regular expression of a path pattern: '**' any path, '*' and '?' within a part, '{a,b}' either."""
    out, depth, i = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i):
            out, i = out + ".*", i + 1
        elif c in "*?":
            out += "[^/]*" if c == "*" else "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def get_many(asked: DataFrame, docs: DataFrame, ident: str, path: str, text: str, most_bytes: int = 10240) -> DataFrame:
    """(ask, ident, bytes, result): documents by patterns or comma lists of paths; too large ones are skipped, missing names reported.

    ``asked``: ask, names; a request of a few lines, as a user types it.
    Patterns become one filter of the table each, names are joined.
    """
    spark = docs.sparkSession
    size = F.octet_length(text).cast("long")
    row = lambda df: df.select("ask", ident, size.alias("bytes"), F.when(size > most_bytes, "too large").otherwise("ok").alias("result"))
    out, names = None, []
    for r in asked.collect():
        if re.search(r"[*?{]", r["names"]):
            one = row(docs.where(F.col(path).rlike(glob_pattern(r["names"]))).withColumn("ask", F.lit(r["ask"])))
            out = one if out is None else out.unionByName(one)
        else:
            names += [(r["ask"], n.strip()) for n in r["names"].split(",") if n.strip()]
    if names:
        want = F.broadcast(spark.createDataFrame(names, "ask int, _name string"))  # as many as a user typed
        hit = docs.join(want, F.col(path) == F.col("_name"))
        lost = want.join(hit.select("ask", "_name").distinct(), ["ask", "_name"], "left_anti")
        missing = lost.select("ask", F.lit(None).cast(docs.schema[ident].dataType).alias(ident), F.lit(None).cast("long").alias("bytes"), F.concat(F.lit("not found: "), "_name").alias("result"))
        one = row(hit).unionByName(missing)
        out = one if out is None else out.unionByName(one)
    return out


def numbered(text: Column | str, first: int = 1) -> Column:
    """Text with 'n: ' before each line."""
    c = F.col(text) if isinstance(text, str) else text
    return F.array_join(F.transform(F.split(c, "\n"), lambda s, i: F.concat((i + first).cast("string"), F.lit(": "), s)), "\n")
