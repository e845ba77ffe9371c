"""Record linkage: incremental against persisted keys, and between two keyless tables."""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import stash
from . import names as N

#: Journal names that stand for a preprint server.
PREPRINT_SERVERS = {"biorxiv", "medrxiv", "arxiv", "chemrxiv", "psyarxiv", "researchsquare", "preprintsorg", "ssrn"}
RECORD = "id long, ord string, pmid string, doi string, words string, edition string, cut boolean, head int, people string, journal string, day int"
_SLUG = re.compile(r"10-\d{4,}_\S{3,}")
_VERSION = re.compile(r"(?<=\d)v\d{1,2}$")
_POINT = re.compile(r"\.0*\s*$")
_DIGITS = re.compile(r"\d+")
_LETTERS = re.compile(r"[a-z]+")


def doi_slug(x: str | None) -> str:
    """A DOI, or an identifier made of one, without resolver, escapes, case, closing marks and preprint version; '' for placeholders."""
    if not x:
        return ""
    s = x.strip().lower().replace("%2f", "/").replace("/", "_").replace(".", "-")
    m = _SLUG.search(s)
    return _VERSION.sub("", m.group().rstrip("-,;_")) if m else ""


def _pmid(pmid: str | None, paper_id: str | None) -> str:
    for x in (pmid, paper_id if paper_id and paper_id.lower().startswith("pmid") else None):
        m = _DIGITS.findall(_POINT.sub("", x)) if x else []
        n = m[-1].lstrip("0") if m else ""
        if len(n) > 3:
            return n
    return ""


@lru_cache(1 << 12)
def _journal(name: str) -> str | None:
    """Beginnings of a journal's words; None for a preprint server."""
    if "".join(_LETTERS.findall(name.lower())) in PREPRINT_SERVERS:
        return None
    return "".join(x[:4] for x in _LETTERS.findall(N.fold(name)) if x not in ("the", "of", "and", "in", "for"))


def read_records(df: DataFrame) -> DataFrame:
    """The comparable form of literature records.

    ``df``: id, batch, paper_id, pmid, doi, title, authors, journal, pub_date;
    all but id may be NULL. ``ord`` sorts rows by (batch, id), NULL first.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            rows = []
            for i, batch, pid, pmid, doi, title, authors, journal, day in zip(*(p[c].tolist() for c in ("id", "batch", "paper_id", "pmid", "doi", "title", "authors", "journal", "day"))):
                w, edition, cut, head = N.title_words(title)
                slug = doi_slug(doi) or doi_slug(pid)
                people = " ".join(",".join(x) for x in N.person_tokens(authors))
                j = _journal(journal) if journal else ""
                if j is None:
                    j, day = "", None  # says nothing about where and when the article appears
                rows.append((i, f"{(batch or '').strip()}|{i:020d}", _pmid(pmid, pid), slug, " ".join(w), edition, cut, head, people, j, -1 if day is None or day != day else int(day)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])

    src = df.where("id is not null").select("id", "batch", "paper_id", "pmid", "doi", "title", "authors", "journal", F.unix_date("pub_date").alias("day"))
    return src.mapInPandas(run, RECORD)


def common_words(records: DataFrame, part: int = 1000, least: int = 20) -> dict[str, int]:
    """Words in at least one title of ``part``, with their counts; there are at most ``part`` times the mean number of words a title.

    They only rank a title's words (see ``blocking_keys``), none is left out for
    being common.
    """
    n = records.count()
    df = records.select(F.explode(F.array_distinct(F.split("words", " "))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return {r["w"]: r["n"] for r in df.where(F.col("n") >= max(least, n // part)).collect()}


def _hash(*x: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(x)) - 2**63


KEYS = "key long, strong boolean, id long"


def blocking_keys(records: DataFrame, common: dict[str, int]) -> DataFrame:
    """(key, strong, id): the keys under which a record is kept and looked up.

    Strong: PubMed number, DOI, and the whole title with the date and a word of
    the first author (and the journal for headings of a few words). Weak: pairs
    of a title's six rarest words (of which one is not common), pairs of
    neighbours among all its rare words, each of the six with the first author's
    words, and one with a digit with the title's beginning; so typing errors in
    some words leave other keys, and so does a cut. A title of common words only
    has its rarest three together, twice.
    Records alike in everything within a batch of rows are sent once, the others
    as a strong pair with it, so a hot paper is thinned before the shuffle; that
    takes a number, a DOI, a title of five words, or authors, journal and date.
    """
    held = records.sparkSession.sparkContext.broadcast(common)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        usual = held.value
        for p in it:
            keys, strong, ids, seen = [], [], [], {}
            rank = {x: None for x in N.SMALL}  # of the words of these rows: how common, with a digit, length; None for words that make no key
            for i, pmid, doi, words, people, journal, day in zip(*(p[c].tolist() for c in ("id", "pmid", "doi", "words", "people", "journal", "day"))):
                alike, w = (pmid, doi, words, people, journal, day), words.split()
                if alike in seen and (pmid or doi or len(w) >= 5 or (w and people and journal and day >= 0)):
                    keys += [_hash("copy", str(seen[alike]))] * 2
                    strong += [True, True]
                    ids += [i, seen[alike]]
                    continue
                seen.setdefault(alike, i)
                sure, weak = [], []
                if pmid:
                    sure.append(_hash("pmid", pmid))
                if doi:
                    sure.append(_hash("doi", doi))
                first = people.split(" ", 1)[0].split(",") if people else []
                if w and day >= 0 and (len(w) >= 5 or journal):
                    where = journal if len(w) < 5 else ""
                    sure += [_hash("all", "".join(w), x, where, str(day)) for x in first]
                # a heading of a few words says nothing about the piece under it
                ranks = []
                for x in set(w) if len(w) >= 5 else ():
                    if x not in rank:
                        rank[x] = (usual.get(x, 0), x.isalpha(), -len(x), x) if len(x) >= 3 else None
                    if rank[x]:
                        ranks.append(rank[x])
                told = [r[3] for r in sorted(ranks)]
                rare = [x for x in told if x not in usual]
                six = rare[:6] if len(rare) > 1 else told[:6]
                pairs = {(x, y) if x < y else (y, x) for x in rare[:6] for y in six if x != y}
                if not rare:  # three common words together
                    weak += [_hash("three", *sorted(t)) for t in (told[:3], told[1:4]) if len(t) == 3]
                line = [x for x in w if x not in usual and len(x) >= 3 and x not in N.SMALL] if len(rare) > 6 else ()
                pairs |= {(x, y) if x < y else (y, x) for x, y in zip(line, line[1:]) if x != y}
                weak += [_hash("two", x, y) for x, y in pairs]
                for x in rare[:6]:
                    weak += [_hash("one", x, y[:5]) for y in first]
                    if not x.isalpha():
                        weak.append(_hash("head", x, "".join(w)[:8]))
                keys += sure + weak
                strong += [True] * len(sure) + [False] * len(weak)
                ids += [i] * (len(sure) + len(weak))
            yield pd.DataFrame({"key": np.array(keys, "i8"), "strong": np.array(strong, bool), "id": np.array(ids, "i8")})

    return records.select("id", "pmid", "doi", "words", "edition", "people", "journal", "day").mapInPandas(run, KEYS)


STRONG, WEAK, LARGE = 2, 1, 0


def candidate_pairs(keys: DataFrame, small: int) -> DataFrame:
    """(a, b, kind): pairs a < b of which at least one is new, under a STRONG or a WEAK key; LARGE: a is a weak key of b > ``small`` rows.

    ``keys``: key, strong, id, old. A strong key links its members to its
    smallest id. Keys are streamed in sorted order; nothing is held but the
    rows of the current weak key, up to ``small``.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, n = None, [], 0

        def close() -> list[tuple[int, int, int]]:
            if n > small:
                return [(key, n, LARGE)]
            return [(min(x, y), max(x, y), WEAK) for k, (x, was) in enumerate(held) for y, old in held[k + 1 :] if x != y and not (was and old)]

        for p in it:
            rows, at = [], p["key"].to_numpy()
            if len(at):  # most keys are held by one row; only the first and the last may go on in another batch of rows
                new = np.concatenate(([True], at[1:] != at[:-1], [True]))
                alone = new[:-1] & new[1:]
                alone[[0, -1]] = False
                p = p[~alone]
            for k, s, i, old in zip(p["key"].tolist(), p["strong"].tolist(), p["id"].tolist(), p["old"].tolist()):
                if k != key:
                    rows += close()
                    key, held, n, head = k, [], 0, (i, old)
                if s:
                    if i != head[0] and not (old and head[1]):
                        rows.append((min(head[0], i), max(head[0], i), STRONG))
                    continue
                n += 1
                if n <= small:
                    held.append((i, old))
            yield pd.DataFrame(rows, columns=["a", "b", "kind"]).drop_duplicates()
        yield pd.DataFrame(close(), columns=["a", "b", "kind"])

    return keys.repartition("key").sortWithinPartitions("key", "id").mapInPandas(run, "a long, b long, kind int")


FIELDS = ("title", "edition", "people", "journal", "day", "doi")


def compare(x: dict, y: dict) -> tuple[int, ...]:
    """Levels of agreement of two records, field by field; -1: not comparable."""
    wx, wy = x["words"].split(), y["words"].split()
    title = N.same_titles(wx, wy, x["cut"], y["cut"], x["head"], y["head"])
    edition = 1 if x["edition"] == y["edition"] else -1 if title == 1 and not (x["edition"] and y["edition"]) else 0
    px, py = ({w for g in r["people"].split(" ") for w in g.split(",") if w} for r in (x, y))
    if px and py:
        hit = sum(a in py or any(N.near(a, b, 1) for b in py) for a in px)
        people = 2 if 2 * hit >= min(len(px), len(py)) else 1 if hit else 0
    else:
        people = -1
    journal = -1 if not x["journal"] or not y["journal"] else int(x["journal"] == y["journal"])
    gap = abs(x["day"] - y["day"]) if x["day"] >= 0 and y["day"] >= 0 else None
    day = -1 if gap is None else 2 if gap == 0 else 1 if gap <= 800 else 0
    doi = -1 if not x["doi"] or not y["doi"] else int(x["doi"] == y["doi"])
    return title, edition, people, journal, day, doi


_COMPARED = ["pmid", "doi", "words", "edition", "cut", "head", "people", "journal", "day"]
VECTOR = "a long, b long, label int, " + ", ".join(f"{f} int" for f in FIELDS)


def _vector(i: int, j: int, x: dict, y: dict) -> tuple:
    label = int(x["pmid"] == y["pmid"]) if x["pmid"] and y["pmid"] else -1
    return (i, j, label, *compare(x, y)) if i < j else (j, i, label, *compare(y, x))


def compared(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(a, b, label, *FIELDS): levels of agreement; label is 1 or 0 where both have a PubMed number, else -1."""
    left = records.select(F.col("id").alias("a"), *(F.col(c).alias("x_" + c) for c in _COMPARED))
    right = records.select(F.col("id").alias("b"), *(F.col(c).alias("y_" + c) for c in _COMPARED))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            x, y = ([dict(zip(_COMPARED, r)) for r in zip(*(p[s + c].tolist() for c in _COMPARED))] for s in ("x_", "y_"))
            rows = [_vector(*r) for r in zip(p["a"].tolist(), p["b"].tolist(), x, y)]
            yield pd.DataFrame(rows, columns=["a", "b", "label", *FIELDS])

    return pairs.join(left, "a").join(right, "b").mapInPandas(run, VECTOR)


def compared_in_blocks(keys: DataFrame, sizes: DataFrame, records: DataFrame, block: int = 400) -> DataFrame:
    """What ``compared`` gives for all pairs under large weak keys, without emitting the pairs.

    ``keys``: key, id, old; ``sizes``: key, n. The rows of a key are dealt into
    blocks, and every block meets every block in a group of its own, where pairs
    that do not share a third of the words of the shorter title, or are both old,
    are skipped; only pairs whose titles agree come out. So a key of any size is
    compared whole, spread over tasks.
    """
    parts = keys.join(sizes, "key").withColumn("parts", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    parts = parts.withColumn("o", F.explode(F.expr("sequence(0, parts - 1)"))).select("key", "id", "old", "own", F.least("own", "o").alias("lo"), F.greatest("own", "o").alias("hi"))
    rows = parts.join(records.select("id", *_COMPARED), "id").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "id")

    def meet(g: pd.DataFrame) -> list[tuple]:
        recs = g.to_dict("records")
        bags = [{w for w in r["words"].split() if len(w) > 3} for r in recs]
        number = {w: k for k, w in enumerate(sorted(set().union(*bags)))}
        m = np.zeros((len(recs), max(1, len(number))), "f4")
        for k, b in enumerate(bags):
            m[k, [number[w] for w in b]] = 1
        size = m.sum(axis=1)
        near = np.triu(3 * (m @ m.T) >= np.minimum(size[:, None], size[None, :]), 1)
        old, own = g["old"].to_numpy(bool), g["own"].to_numpy()
        near &= ~(old[:, None] & old[None, :])
        if recs[0]["lo"] != recs[0]["hi"]:
            near &= own[:, None] != own[None, :]
        out = [_vector(recs[x]["id"], recs[y]["id"], recs[x], recs[y]) for x, y in zip(*np.nonzero(near))]
        return [v for v in out if v[3]]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for p in it:
            p = p if held is None else pd.concat([held, p], ignore_index=True)
            if not len(p):
                continue
            last = p[["key", "lo", "hi"]].iloc[-1]
            open_ = (p["key"] == last["key"]) & (p["lo"] == last["lo"]) & (p["hi"] == last["hi"])
            held = p[open_]
            yield pd.DataFrame([v for _, g in p[~open_].groupby(["key", "lo", "hi"]) for v in meet(g)], columns=["a", "b", "label", *FIELDS])
        if held is not None and len(held):
            yield pd.DataFrame(meet(held), columns=["a", "b", "label", *FIELDS])

    return rows.mapInPandas(run, VECTOR)


#: Chances of a level for two rows of one paper and of two papers, before any labelled pair is seen.
PRIOR = {
    "title": {3: (0.70, 0.03), 2: (0.20, 0.01), 1: (0.08, 0.02), 0: (0.02, 0.94)},
    "edition": {1: (0.99, 0.50), 0: (0.01, 0.50)},
    "people": {2: (0.97, 0.70), 1: (0.02, 0.15), 0: (0.01, 0.15)},
    "journal": {1: (0.97, 0.60), 0: (0.03, 0.40)},
    "day": {2: (0.97, 0.10), 1: (0.02, 0.60), 0: (0.01, 0.30)},
    "doi": {1: (0.97, 0.01), 0: (0.03, 0.99)},
}


def learned_weights(vectors: DataFrame, prior: float = 20.0) -> dict[tuple[str, int], float]:
    """log(m / u) of every level, from all pairs of which both records have a PubMed number.

    The counts are aggregated over the whole table; what reaches the driver is
    one row a level. PRIOR counts as ``prior`` pairs of either kind, so a small
    first batch has sensible weights. Absent values weigh 0.
    """
    long = vectors.where("label >= 0").select("label", F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in FIELDS))).alias("x"))
    rows = long.groupBy("label", "x.f", "x.v").agg(F.count("*").alias("n")).collect()
    n = {(r["label"], r["f"], r["v"]): r["n"] for r in rows}
    total = {(k, f): sum(n.get((k, f, v), 0) for v in PRIOR[f]) + prior for k in (0, 1) for f in FIELDS}
    out = {}
    for f, levels in PRIOR.items():
        for v, (m, u) in levels.items():
            out[f, v] = math.log((n.get((1, f, v), 0) + prior * m) / total[1, f]) - math.log((n.get((0, f, v), 0) + prior * u) / total[0, f])
    return out


def accepted(vectors: DataFrame, weights: dict[tuple[str, int], float], least: float = 2.0) -> DataFrame:
    """(a, b, score): pairs above the threshold; different numbers, other editions and other titles are never one paper."""
    score = F.lit(0.0)
    for f in FIELDS:
        if f != "doi":  # a preprint has a DOI of its own
            e = F.lit(0.0)
            for (g, v), w in sorted(weights.items()):
                if g == f:
                    e = F.when(F.col(f) == v, w).otherwise(e)
            score = score + e
    veto = (F.col("label") == 0) | (F.col("title") == 0) | (F.col("edition") == 0) | (F.col("people") == 0)
    doubt = (F.col("edition") == -1) & (F.col("day") != 2)  # a cut title that may have lost its part or year mark
    return vectors.withColumn("score", score).where(~veto & ~doubt & (F.col("score") >= least)).select("a", "b", "score")


class History:
    """What is kept between batches, in a folder of the shared storage: records, blocking keys, cluster links, settings.

    Every table is a list of parts, one a batch, divided into ``BUCKETS`` by a
    hash of its key (key, id or node), so that a batch reads only the buckets it
    touches. A part counts once its batch is committed by a file of the next
    number that must not exist yet: a failed batch leaves nothing, and of two
    writers one fails. Cluster links are the pointers of a union-find forest,
    (node, parent): a batch adds pointers for the nodes it touches, the latest
    one holds. ``compact`` merges all parts into one.
    """

    BUCKETS = 32
    KINDS = {"records": RECORD, "keys": KEYS, "clusters": "node long, parent long"}
    ON = {"records": "id", "keys": "key", "clusters": "node"}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.begin()

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path
        return at(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def parts(self) -> list[str]:
        """Committed parts, oldest first; those before a compacted one no longer count."""
        fs, at = self._fs()
        log = at(f"{self.path}/_commits")
        names = sorted(x.getPath().getName() for x in fs.listStatus(log)) if fs.exists(log) else []
        done = [json.loads(self._get(f"_commits/{n}")) for n in names]
        start = max((k for k, d in enumerate(done) if d["whole"]), default=0)
        return [d["part"] for d in done[start:]]

    def settings(self) -> dict | None:
        """Common words and weights, those of the first batch."""
        fs, at = self._fs()
        if not fs.exists(at(f"{self.path}/settings")):
            return None
        got = json.loads(self._get("settings"))
        return {"common": got["common"], "weights": {(f, v): w for f, v, w in got["weights"]}}

    @classmethod
    def bucket(cls, column: str):
        return F.pmod(F.xxhash64(column), F.lit(cls.BUCKETS)).cast("int")

    def read(self, kind: str, touched: DataFrame | None = None, column: str | None = None) -> DataFrame:
        """A table, in full or only the buckets that values of ``touched.column`` fall into (at most BUCKETS numbers reach the driver)."""
        parts = [(n, f"{self.path}/{p}/{kind}") for n, p in enumerate(self.parts())]
        out = self.spark.createDataFrame([], self.KINDS[kind] + ", part int")
        only = None if touched is None or not parts else [r[0] for r in touched.select(self.bucket(column)).distinct().collect()]
        for n, path in parts:
            one = self.spark.read.schema(self.KINDS[kind] + ", bucket int").parquet(path)
            one = one if only is None else one.where(F.col("bucket").isin(only))
            out = out.unionByName(one.drop("bucket").withColumn("part", F.lit(n)))
        return out

    def write(self, kind: str, rows: DataFrame) -> None:
        part = rows.withColumn("bucket", self.bucket(self.ON[kind]))
        part.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{self._new}/{kind}")

    def begin(self) -> None:
        """A new part, whatever an earlier attempt left behind."""
        self._new = uuid.uuid4().hex

    def written(self, kind: str) -> DataFrame:
        """What this batch has written of a table, before it is committed."""
        return self.spark.read.schema(self.KINDS[kind] + ", bucket int").parquet(f"{self.path}/{self._new}/{kind}").drop("bucket")

    def _get(self, name: str) -> str:
        fs, at = self._fs()
        stream = fs.open(at(f"{self.path}/{name}"))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> None:
        fs, at = self._fs()
        out = fs.create(at(f"{self.path}/{name}"), False)  # fails if it is there
        out.write(bytearray(text.encode()))
        out.close()

    def keep_settings(self, common: dict[str, int], weights: dict[tuple[str, int], float]) -> None:
        self._put("settings", json.dumps({"common": common, "weights": [[f, v, w] for (f, v), w in weights.items()]}))

    def commit(self, whole: bool = False) -> None:
        fs, at = self._fs()
        log = at(f"{self.path}/_commits")
        n = len(fs.listStatus(log)) if fs.exists(log) else 0
        self._put(f"_commits/{n:09d}", json.dumps({"part": self._new, "whole": whole}))
        self.begin()

    def latest(self, touched: DataFrame | None = None, column: str | None = None) -> DataFrame:
        """(node, parent): the pointer of every node that has one."""
        return self.read("clusters", touched, column).groupBy("node").agg(F.max_by("parent", "part").alias("parent"))

    def roots(self, nodes: DataFrame) -> DataFrame:
        """(node, root) for the given nodes (column node), by following pointers; nodes without one are their own root."""
        out = stash(nodes.select("node", F.col("node").alias("root")).distinct())
        while self.parts():
            up = self.latest(out, "root").select(F.col("node").alias("root"), "parent")
            nxt = stash(out.join(up, "root", "left").select("node", F.coalesce("parent", "root").alias("root"), (F.coalesce("parent", "root") != F.col("root")).alias("moved")))
            out = nxt.drop("moved")
            if nxt.where("moved").limit(1).count() == 0:
                break
        return out

    def clusters(self) -> DataFrame:
        """(node, component) of every row that is in a cluster; component is its smallest id."""
        return self.roots(self.read("clusters").select("node")).withColumnRenamed("root", "component")

    def compact(self) -> None:
        """One part instead of many, pointers shortened to their roots."""
        for kind in ("records", "keys"):
            self.write(kind, self.read(kind).drop("part"))
        self.write("clusters", self.clusters().withColumnRenamed("component", "parent"))
        self.commit(whole=True)


def link_batch(new: DataFrame, history: History, small: int = 40) -> History:
    """Links a batch of records against everything accepted before and adds it, without comparing the history with itself.

    Of the history only the buckets of keys the batch holds too are probed, only
    records of pairs with a new record are read, and only the pointers of
    clusters that new links touch are written. Common words and weights are
    those of the first batch, so later batches are keyed and scored alike.
    Under a weak key of at most ``small`` rows pairs are formed and compared;
    larger ones are compared in blocks, all of them too. Weights are learned
    from the former. An empty batch adds nothing.
    """
    history.begin()
    history.write("records", new)
    new, settings = history.written("records"), history.settings()
    common = settings["common"] if settings else common_words(new)
    history.write("keys", blocking_keys(new, common))
    keys = history.written("keys")
    every = keys.withColumn("old", F.lit(False))
    if settings:  # else nothing is kept that could be probed
        probe = history.read("keys", keys, "key").join(keys.select("key").distinct(), "key", "left_semi").select("key", "strong", "id")
        every = every.unionByName(probe.withColumn("old", F.lit(True)))
    pairs = stash(candidate_pairs(every, small))
    weak = pairs.where(F.col("kind") == WEAK).select("a", "b").distinct()
    large = pairs.where(F.col("kind") == LARGE).select(F.col("a").alias("key"), F.col("b").alias("n"))
    crowded = large.limit(1).count() > 0
    asked = weak.select(F.explode(F.array("a", "b")).alias("id"))
    if crowded:
        crowd = stash(every.join(large, "key", "left_semi").select("key", "id", "old").distinct())
        asked = asked.unionByName(crowd.select("id"))
    records = new
    if settings:
        asked = stash(asked.distinct())
        records = stash(new.unionByName(history.read("records", asked, "id").drop("part").join(asked, "id", "left_semi")))
    vectors = stash(compared(weak, records))
    if crowded:
        more = stash(compared_in_blocks(crowd, large, records))
    weights = settings["weights"] if settings else learned_weights(vectors)
    vectors = vectors.unionByName(more) if crowded else vectors
    links = stash(pairs.where(F.col("kind") == STRONG).select("a", "b").unionByName(accepted(vectors, weights).select("a", "b")))
    root = history.roots(links.select(F.explode(F.array("a", "b")).alias("node")))
    for c in ("a", "b"):
        links = links.join(root.select(F.col("node").alias(c), F.col("root").alias("r" + c)), c)
    comp = connected_components(links.select(F.col("ra").alias("a"), F.col("rb").alias("b")), "a", "b")
    to = stash(root.join(comp.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("component", "root").alias("parent")))
    history.write("clusters", to.unionByName(comp.select("node", F.col("component").alias("parent"))).distinct())
    if not settings:
        history.keep_settings(common, weights)
    history.commit()
    return history


def first_pairs(history: History) -> DataFrame:
    """(id_lo, id_hi): every later row of a cluster with the cluster's first row by (batch, id)."""
    rows = history.clusters().join(history.read("records").select(F.col("id").alias("node"), "ord"), "node")
    first = rows.groupBy("component").agg(F.min_by("node", "ord").alias("first"))
    pairs = rows.join(first, "component").where("node <> first")
    return pairs.select(F.least("node", "first").alias("id_lo"), F.greatest("node", "first").alias("id_hi"))
