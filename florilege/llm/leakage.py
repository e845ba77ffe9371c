"""Finding held-out test passages in training text."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stash

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans(
    "абвеіјкмнорԛѕтуԝхһсԁӏАВЕІЈКМНОРЅТУХСԌԚԜαβεικνορτυχγΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɡɑⅼ",
    "abbeijkmhopqstywxhcdlABEIJKMHOPSTYXCGQWabeikvoptuxyABEZHIKMNOPTYXigal",
)
#: Marks that point to notes, set high or low.
MARKS = set("⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻₀₁₂₃₄₅₆₇₈₉†‡§¶")
_INLINE = re.compile(r"</?(?:em|i|b|strong|sub|sup|u|span|a|mark|small|s|code|font)\b[^<>]{0,200}>", re.I)
_BLOCK = re.compile(r"<[^<>]{1,200}>")
_SPLIT = re.compile(r"(?<=\w)[-‐‑¬][ \t]*[\r\n]+[>\s|*]*(?=\w)")
_HYPHENS = frozenset("‐‑¬")
_MARK = re.compile(r"\[\^?\d+(?:\s?[,;–-]\s?\d+)*\]|\(\d{1,3}(?:\s?[,;–-]\s?\d{1,3})*\)|\^\d+\^?")
_HIGH = re.compile(r"[^\x00-\x7f]")
_ASCII, _ANY = re.compile(r"[a-z0-9]+"), re.compile(r"[^\W_]+")


@lru_cache(maxsize=100_000)
def _latin(c: str) -> str:
    """What a character outside ASCII is read as: look-alikes and accented letters as the plain letter."""
    if c in MARKS:
        return " "
    if ord(c) in LOOKALIKES:
        return chr(LOOKALIKES[ord(c)])
    if unicodedata.category(c) in ("Cf", "Mn"):
        return ""
    d = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
    return d if d.isascii() else c


def plain_words(text: str, word: re.Pattern = _ASCII) -> list[str]:
    """Lower-case words without markup, reference marks, line-end hyphens, quotes and look-alike letters."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _BLOCK.sub(" ", _INLINE.sub("", text))
    high = () if text.isascii() else set(_HIGH.findall(text))
    if "-\n" in text or "-\r" in text or "- \n" in text or not _HYPHENS.isdisjoint(high):
        text = _SPLIT.sub("", text)
    for c in high:
        if (x := _latin(c)) != c:
            text = text.replace(c, x)
    if "[" in text or "(" in text or "^" in text:
        text = _MARK.sub(" ", text)
    if "**" in text or "__" in text or "`" in text:
        text = text.replace("**", "").replace("__", "").replace("`", "")
    return word.findall(text.lower())


class Passages:
    """Words of test items, without what many items share, and their n-grams, ready for look-up.

    ``usual``: words too many items hold to tell one from another. They are
    counted over all items (see ``item_words``), so that what is found does not
    depend on how items are split over several look-up sets.
    """

    def __init__(self, words: dict[int, list[str]], usual: frozenset[str], word: re.Pattern = _ASCII, n: int = 3):
        self.words, self.usual, self.word, self.n = words, usual, word, n
        self.ids = {w: k for k, w in enumerate(sorted({w for ws in words.values() for w in ws}))}
        self.base = len(self.ids) + 1
        found: dict[int, list[tuple[int, int]]] = {}
        for i, w in words.items():
            v = [self.ids[x] for x in w]
            for k in range(len(v) - n + 1):
                found.setdefault(sum(x * self.base**j for j, x in enumerate(v[k : k + n])), []).append((i, k))
        self.grams = np.array(sorted(found), "i8")
        self.places = [found[g] for g in self.grams.tolist()]


def item_words(items: DataFrame, item: str, text: str, common: float = 0.05, shared: int = 6, rare: float = 0.02) -> tuple[DataFrame, frozenset[str], re.Pattern]:
    """((item, ws), usual words, word pattern): items without word runs that many of them share, and what tells none apart.

    Runs of ``shared`` words in at least three and ``common`` of the distinct
    items are taken out (the common instruction); words then in more than two
    and ``rare`` of them are usual. Both are counted by Spark over all items; as
    each takes a share of all items, at most the mean length of an item divided
    by that share of either reaches the driver. Texts are cut into words of
    ASCII letters unless an item holds others.
    """

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            yield pd.DataFrame({item: p[item], "ws": [plain_words(t or "", _ANY) for t in p[text]]})

    kind = f"{item} long, ws array<string>"
    plain = stash(items.where(F.col(item).isNotNull()).select(F.col(item).cast("long").alias(item), text).mapInPandas(read, kind))
    word = _ANY if plain.where(F.exists("ws", lambda w: w.rlike(r"[^\x00-\x7f]"))).limit(1).count() else _ASCII
    texts = plain.select("ws").distinct()  # an item that is repeated counts once
    runs = F.transform(F.sequence(F.lit(1), F.size("ws") - (shared - 1)), lambda k: F.array_join(F.slice(F.col("ws"), k, shared), " "))
    grams = texts.where(F.size("ws") >= shared).select(F.explode(F.array_distinct(runs)).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    often = frozenset(r["g"] for r in grams.where(F.col("n") >= max(3, common * texts.count())).select("g").collect())

    def clear(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            out = []
            for w in p["ws"]:
                drop = {k + j for k in range(len(w) - shared + 1) if " ".join(w[k : k + shared]) in often for j in range(shared)}
                out.append([x for k, x in enumerate(w) if k not in drop])
            yield pd.DataFrame({item: p[item], "ws": out})

    left = stash(plain.mapInPandas(clear, kind))
    texts = left.select("ws").distinct()
    held = texts.select(F.explode(F.array_distinct("ws")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    usual = frozenset(r["w"] for r in held.where(F.col("n") > max(2, rare * texts.count())).select("w").collect())
    return left, usual, word


def _run(doc: list[str], item: list[str], d: int, i: int, n: int) -> tuple[int, int, list[tuple[int, int]]]:
    """(first item word, end, places (document, item) that agree) of the longest run through an n-gram found at (d, i).

    Single wrong, missing or additional words are passed over if the word behind
    them agrees, and the next one too where words are missing or additional.
    """

    def walk(d: int, i: int, step: int) -> tuple[int, list[tuple[int, int]]]:
        last, hits = i - step, []
        while 0 <= i < len(item) and 0 <= d < len(doc):
            if doc[d] == item[i]:
                last = i
                hits.append((d, i))
                d, i = d + step, i + step
                continue
            for dd, ii in ((1, 1), (1, 0), (0, 1), (2, 1), (1, 2)):
                a, b = d + dd * step, i + ii * step
                if not (0 <= a < len(doc) and 0 <= b < len(item)) or doc[a] != item[b]:
                    continue
                a2, b2 = a + step, b + step
                if not 0 <= b2 < len(item) or (0 <= a2 < len(doc) and doc[a2] == item[b2]) or (dd, ii) == (1, 1):
                    d, i = a, b
                    break
            else:
                break
        return last, hits

    left, x = walk(d - 1, i - 1, -1)
    right, y = walk(d + n, i + n, 1)
    return left, right + 1, [*reversed(x), *((d + k, i + k) for k in range(n)), *y]


#: item, words covered, telling words right and wrong, places (document, item) that agree
Run = tuple[int, int, int, int, list[tuple[int, int]]]


def runs_in(text: str | None, p: Passages) -> list[Run]:
    """All runs of item words in a document that go through an n-gram of theirs."""
    if not text:
        return []
    doc = plain_words(text, p.word)
    if len(doc) < p.n:
        return []
    v = np.array(list(map(p.ids.get, doc, repeat(-1))), "i8")
    m = len(v) - p.n + 1
    key, ok = np.zeros(m, "i8"), np.ones(m, bool)
    for j in range(p.n):
        key += v[j : j + m] * p.base**j
        ok &= v[j : j + m] >= 0
    at = np.flatnonzero(ok)
    if not len(at) or not len(p.grams):
        return []
    pos = np.searchsorted(p.grams, key[at])
    pos[pos == len(p.grams)] = 0
    hit = p.grams[pos] == key[at]
    at, pos = at[hit], pos[hit]
    runs: list[Run] = []
    done: dict[tuple[int, int], int] = {}
    for d, g in zip(at.tolist(), pos.tolist()):
        for item, i in p.places[g]:
            if done.get((item, d - i), -1) >= d:
                continue
            words = p.words[item]
            a, b, agree = _run(doc, words, d, i, p.n)
            for x, y in agree:
                done[item, x - y] = x
            own = sum(words[k] not in p.usual for _, k in agree)
            runs.append((item, b - a, own, sum(w not in p.usual for w in words[a:b]) - own, agree))
    return runs


def leaked(runs: list[Run], least: int) -> list[tuple[int, int, int, int, int]]:
    """(item, words of it covered, words that agree, first and last document word) of each item with a run of at least ``least`` words that counts."""
    best: dict[int, tuple[int, int, int, int]] = {}
    holders: dict[int, list[int]] = {}
    for item, covered, own, wrong, agree in runs:
        if covered < least or (covered, len(agree)) <= best.get(item, (0, 0))[:2]:
            continue
        if (own < 2 or own < 2 * wrong) and not _verbatim(agree, least):
            if not holders:  # runs by the document words they agree with
                for r, run in enumerate(runs):
                    for x, _ in run[4]:
                        holders.setdefault(x, []).append(r)
            if _contested(item, agree, own < 2 * wrong, runs, holders):
                continue  # another text of the same pattern
        best[item] = (covered, len(agree), agree[0][0], agree[-1][0])
    return [(item, *x) for item, x in best.items()]


def _verbatim(agree: list[tuple[int, int]], least: int) -> bool:
    """Do ``least`` words in a row agree without any wrong one?"""
    n = 1
    for (d, i), (d2, i2) in zip(agree, agree[1:]):
        if n >= least:
            break
        n = n + 1 if (d2, i2) == (d + 1, i + 1) else 1
    return n >= least


def _contested(item: int, agree: list[tuple[int, int]], off: bool, runs: list, holders: dict[int, list[int]]) -> bool:
    """Does another item agree with as many words of the same stretch of the document?

    One that agrees with just the same words says nothing against the item,
    unless (``off``) the wrong ones are those that tell items apart.
    """
    own = {x for x, _ in agree}
    for r in {r for x in own for r in holders[x]}:
        if runs[r][0] != item:
            theirs = {x for x, _ in runs[r][4] if agree[0][0] <= x <= agree[-1][0]}
            if len(theirs) >= len(own) and (off or theirs != own):
                return True
    return False


def _offset(text: str, nth: int, word: re.Pattern) -> int:
    """Where the normalised word number ``nth`` begins: the longest beginning of the text with so many words before it."""
    a, b = 0, len(text)
    while a < b:
        m = (a + b + 1) // 2
        if len(plain_words(text[:m], word)) <= nth:
            a = m
        else:
            b = m - 1
    while a > 0 and not text[a - 1].isspace():
        a -= 1
    return a


def _span(text: str, first: int, last: int, word: re.Pattern) -> tuple[int, int]:
    """Characters from the word number ``first`` to behind the word number ``last``, at blanks."""
    return _offset(text, first, word), max(_offset(text, first, word), _offset(text, last + 1, word)) if last + 1 < len(plain_words(text, word)) else len(text)


def find_leaks(docs: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text", item: str = "item_id", least: int = 12, max_grams: int = 2_000_000, spans: bool = False) -> DataFrame:
    """(ident, item, covered, agreeing): documents that hold a passage of a test item; with ``spans`` also start and end, the characters between which it stands.

    Method: the items' normalised word n-grams are broadcast as a sorted set,
    every document is scanned through it in one pass without a shuffle, and each
    hit is verified by walking along document and item in both directions over
    isolated wrong, missing and additional words. Word runs that many items
    share (the common instruction) are taken out of the items first.
    A run counts if ``least`` words agree without a wrong one, or if words few
    items have agree at least twice and twice as often as they disagree, or if no
    other item agrees with as much of the same stretch.

    The broadcast is bounded: with more than ``max_grams`` n-grams the items are
    dealt over several sets, each scanned on its own, and a document's runs are
    judged together afterwards. Statistics are those of all items, so the result
    does not depend on ``max_grams``. Whole texts are read; NULL and empty ones
    hold nothing; repeated items are each reported. No items, no rows.
    """
    spark = docs.sparkSession
    words, usual, word = item_words(items, item, text)
    total = words.agg(F.sum(F.size("ws"))).first()[0] or 0
    lots = max(1, -(-total // max_grams))
    words = words.withColumn("lot", F.pmod(F.xxhash64(item), F.lit(lots)))
    kind = docs.schema[ident].dataType.simpleString()
    docs = docs.where(F.col(ident).isNotNull()).select(ident, text)
    found = f"{ident} {kind}, {item} long, covered int, agreeing int" + ", start int, end int" * spans
    columns = [c.split()[0] for c in found.split(", ")]
    out = None
    for lot in range(lots):
        own = {r[item]: list(r["ws"]) for r in words.where(F.col("lot") == lot).select(item, "ws").orderBy(item).toLocalIterator()}
        held = spark.sparkContext.broadcast(Passages(own, usual, word))

        def scan(it: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for pdf in it:
                rows = [(i, *x[:3], *(_span(t, *x[3:], word) if spans else ())) for i, t in zip(pdf[ident], pdf[text]) for x in leaked(runs_in(t, held.value), least)]
                yield pd.DataFrame(rows, columns=columns)

        def gather(it: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for pdf in it:
                rows = []
                for i, t in zip(pdf[ident], pdf[text]):
                    for r in runs_in(t, held.value):
                        at = _span(t, r[4][0][0], r[4][-1][0], word) if spans and r[1] >= least else (-1, -1)
                        rows.append((i, *r[:4], np.array(r[4], "<i4").tobytes(), *at))
                yield pd.DataFrame(rows, columns=[ident, item, "covered", "own", "wrong", "agree", "start", "end"])

        one = docs.mapInPandas(scan, found) if lots == 1 else docs.mapInPandas(gather, f"{ident} {kind}, {item} long, covered int, own int, wrong int, agree binary, start int, end int")
        out = one if out is None else out.unionByName(one)
    if lots == 1:
        return out

    def judge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        agree = [[tuple(x) for x in np.frombuffer(b, "<i4").reshape(-1, 2).tolist()] for b in pdf["agree"]]
        runs = sorted(zip(pdf[item].tolist(), pdf["covered"].tolist(), pdf["own"].tolist(), pdf["wrong"].tolist(), agree), key=lambda r: (r[4][0], r[0]))
        at = {(i, g[0][0], g[-1][0]): x for i, g, *x in zip(pdf[item].tolist(), agree, pdf["start"].tolist(), pdf["end"].tolist())}
        return pd.DataFrame([(key[0], *x[:3], *(at[x[0], x[3], x[4]] if spans else ())) for x in leaked(runs, least)], columns=columns)

    return out.groupBy(ident).applyInPandas(judge, found)  # the runs of one document


def without_leaks(docs: DataFrame, leaks: DataFrame, ident: str = "doc_id") -> DataFrame:
    """The documents in which no test passage was found."""
    return docs.join(leaks.select(ident).distinct(), ident, "left_anti")


def cut_leaks(docs: DataFrame, leaks: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, text, spans, cut_chars): the affected documents without their leaked spans.

    ``leaks``: what ``find_leaks`` gave for these documents, with spans. Overlapping spans
    are cut once. Only affected documents are read again, whole. Documents
    without a leak give no row.
    """
    kind = docs.schema[ident].dataType.simpleString()
    spans = leaks.groupBy(ident).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("at"))  # at most one an item

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            rows = []
            for i, t, at in zip(p[ident], p[text], p["at"]):
                kept, last, n = [], 0, 0
                for a, b in ((x["start"], x["end"]) for x in at):
                    n += a >= last
                    kept.append(t[last:a])
                    last = max(last, b)
                out = "".join(kept) + t[last:]
                rows.append((i, out, n, len(t) - len(out)))
            yield pd.DataFrame(rows, columns=[ident, "text", "spans", "cut_chars"])

    return docs.select(ident, text).join(spans, ident).mapInPandas(cut, f"{ident} {kind}, text string, spans int, cut_chars int")
