"""Filters, orders, coverage checks and audits of the digest and the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import fulltext as T
from ..operators import matching as M
from ..operators import neighbours as N
from ..operators import state as K
from ..session import table
from .dedup import DOI, PMID
from .graph import NEAR

#: Journals that are preprint servers.
PREPRINT_JOURNALS = ["biorxiv", "medrxiv", "arxiv", "preprints", "biorxiv : the preprint server for biology", "medrxiv : the preprint server for health sciences", "research square"]


def _status() -> Column:
    return F.coalesce(F.regexp_replace(F.lower(F.trim("status")), r"[\s-]+", "_"), F.lit("saved"))


def preprint_filter(spark: SparkSession, d: str) -> DataFrame:
    """Digest rows kept: preprints labelled low are dropped; journals that are servers are marked."""
    df = table(spark, d, "digest_papers").where(~(F.coalesce("is_preprint", F.lit(False)) & F.coalesce(F.col("relevance") == "low", F.lit(False))))
    return df.select("id", F.coalesce(F.lower(F.trim("journal")).isin(PREPRINT_JOURNALS), F.lit(False)).alias("server"))


def grant_selection(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("sonnet_relevance")
    return table(spark, d, "digest_grants").where(F.coalesce(F.when(~F.isnan(s), s), F.lit(0.0)) >= 5.0).select("id", F.round(s, 4).alias("relevance"))


def summary_queue(spark: SparkSession, d: str) -> DataFrame:
    """Rows that wait for a summary: pending or deferred, without a summary date, tried less than four times."""
    df = table(spark, d, "papers").where(_status().isin("summary_pending", "summary_deferred") & F.col("summarized_date").isNull() & (F.coalesce("retry_count", F.lit(0)) < 4))
    return df.select("id", _status().alias("status"))


def visible_states(spark: SparkSession, d: str) -> DataFrame:
    """Saved papers a reader sees, by state and what can be done with them."""
    s = _status()
    act = F.when(s == "summary_ready", "read").when(s.isin("summary_pending", "summary_deferred"), "wait").when(s == "summary_failed", "retry").otherwise("request")
    return table(spark, d, "papers").where(s != "removed").groupBy(s.alias("status"), act.alias("action")).agg(F.count("*").alias("n"))


def recent_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows added in the seven days before the latest one, by source."""
    df = table(spark, d, "digest_papers")
    last = df.agg(F.max("added_date").alias("last"))  # one row
    return df.crossJoin(F.broadcast(last)).where(F.col("added_date") >= F.col("last") - F.expr("interval 7 days")).groupBy("source").agg(F.count("*").alias("n"))


def days_stale(spark: SparkSession, d: str) -> DataFrame:
    """Whole days between the last document of each source and the last of all."""
    df = table(spark, d, "documents").where("added_at is not null")
    last = df.agg(F.max(F.unix_millis(F.col("added_at").cast("timestamp"))).alias("now"))  # one row
    per = df.groupBy("source").agg(F.max(F.unix_millis(F.col("added_at").cast("timestamp"))).alias("at"))
    return per.crossJoin(F.broadcast(last)).select("source", F.floor((F.col("now") - F.col("at")) / 86_400_000).alias("days"))


def batch_order(spark: SparkSession, d: str) -> DataFrame:
    """Runs in a reader's order: newest first, rows without a run last."""
    b = table(spark, d, "digest_papers").groupBy(F.coalesce(X.blank_to_null("batch"), F.lit("legacy")).alias("batch")).agg(F.count("*").alias("n"))
    at = F.row_number().over(Window.orderBy((F.col("batch") == "legacy").cast("int"), F.desc("batch")))  # one row a run
    return b.select("batch", "n", at.alias("place"))


def index_order(spark: SparkSession, d: str) -> DataFrame:
    """The first 500 lines of the index: oldest year first, papers without one last, then by file name."""
    df = table(spark, d, "papers").select("id", F.coalesce(F.year("pub_date"), F.lit(9999)).alias("year"), F.lower(F.coalesce("paper_id", F.lit(""))).alias("file"))
    return df.orderBy("year", "file", "id").limit(500)


def topic_order(spark: SparkSession, d: str) -> DataFrame:
    """The 100 topics with most saved papers, and the file each is written to."""
    t = table(spark, d, "papers").select("id", F.explode("tags").alias("topic")).where("topic <> ''").groupBy("topic").agg(F.count_distinct("id").alias("n"))
    return t.select("topic", X.slugify("topic").alias("file"), "n").orderBy(F.desc("n"), "file", "topic").limit(100)


def numeric_pmids(spark: SparkSession, d: str) -> DataFrame:
    """The 500 smallest PubMed numbers of the library in numeric order."""
    return table(spark, d, "papers").select(X.pmid_digits("pmid").try_cast("bigint").alias("pmid")).where("pmid is not null").distinct().orderBy("pmid").limit(500)


def backlog(spark: SparkSession, d: str) -> DataFrame:
    """Papers without a summary by source, and nights to clear them at twenty a night."""
    df = table(spark, d, "papers").where("summarized_date is null").groupBy(F.coalesce(F.split("source", ":")[0], F.lit("")).alias("kind")).agg(F.count("*").alias("n"))
    return df.withColumn("nights", F.ceil(F.col("n") / 20))


def landing(spark: SparkSession, d: str) -> DataFrame:
    """Papers saved in each month: share with a full text, below half of it is a warning."""
    full = F.length(F.coalesce(X.strip_tags("full_text_summary"), F.lit(""))) >= 20
    m = table(spark, d, "papers").where("saved_date is not null").groupBy(F.date_format("saved_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.count_if(full).alias("full"))
    return m.withColumn("state", F.when(F.col("full") * 2 < F.col("n"), "WARNING").otherwise("OK"))


def sidecar_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a paper whose text has no stored vector, by source."""
    docs = table(spark, d, "documents").where("paper_id is not null and hash is not null")
    rows = table(spark, d, "vectors_vec_rowids").select(F.regexp_extract("id", "^(.*)_[0-9]+$", 1).alias("hash")).distinct()
    total = docs.groupBy("source").agg(F.count("*").alias("n"))
    bare = docs.join(rows, "hash", "left_anti").groupBy("source").agg(F.count("*").alias("uncovered"))
    return total.join(bare, "source", "left").select("source", "n", F.coalesce("uncovered", F.lit(0)).alias("uncovered"))


def chunk_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Documents behind the stored vectors of chunk 1: log, documents and vectors joined on hash and sequence."""
    rows = table(spark, d, "vectors_vec_rowids").where("chunk_id = 1").select("vec_rowid", F.regexp_extract("id", "^(.*)_([0-9]+)$", 1).alias("hash"), F.regexp_extract("id", "^(.*)_([0-9]+)$", 2).cast("int").alias("seq"))
    log = table(spark, d, "content_vectors").select("hash", "seq", "pos", "model")
    docs = table(spark, d, "documents").select("hash", "doc_id")
    return rows.join(log, ["hash", "seq"]).join(docs, "hash").select("vec_rowid", "doc_id", "seq", "pos", "model")


def new_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """An insert of all logged vectors into the stored ones: keys that are there are skipped, repeated ones go in once."""
    log = table(spark, d, "content_vectors").select(F.concat_ws("_", "hash", F.col("seq").cast("string")).alias("id"), "model")
    there = table(spark, d, "vectors_vec_rowids").select("id", F.lit(True).alias("there"))
    j = log.groupBy("id").agg(F.min("model").alias("model")).join(there, "id", "left")
    return j.groupBy("model", F.when(F.col("there"), "skipped").otherwise("inserted").alias("result")).agg(F.count("*").alias("n"))


def first_collection(spark: SparkSession, d: str) -> DataFrame:
    """Collection of each document: the first, longest prefix of its path."""
    roots = [("a", "vault"), ("b", "vault/Annals"), ("c", "abstract"), ("d", "grant"), ("e", "")]
    c = F.broadcast(spark.createDataFrame(roots, "name string, prefix string"))  # fixed, five rows
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "journal").alias("path"))
    best = docs.join(c, F.col("path").startswith(F.col("prefix"))).groupBy("doc_id").agg(F.max_by("name", F.struct(F.length("prefix"), "prefix")).alias("collection"))
    return best.groupBy("collection").agg(F.count("*").alias("n"))


def bare_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources and journals below them for which no context is written."""
    c = F.broadcast(spark.createDataFrame([("vault",), ("abstract",), ("preprint_text/Annals",)], "prefix string"))  # fixed, three rows
    p = table(spark, d, "documents").select(F.concat_ws("/", "source", "journal").alias("path")).where("path <> ''").groupBy("path").agg(F.count("*").alias("n"))
    return p.join(c, F.col("path").startswith(F.col("prefix")), "left_anti")


def topic_audit(spark: SparkSession, d: str) -> DataFrame:
    """Topics too large or too small to be one, or nearly within another: members, best containing topic, findings."""
    t = table(spark, d, "papers").select("id", F.explode(F.array_distinct("tags")).alias("topic")).where("topic <> ''")
    n = t.groupBy("topic").agg(F.count("*").alias("n"))
    both = t.join(t.withColumnRenamed("topic", "other"), "id").where("topic <> other").groupBy("topic", "other").agg(F.count("*").alias("shared"))
    best = both.groupBy("topic").agg(F.max(F.struct("shared", "other")).alias("b"))
    j = n.join(best, "topic", "left").select("topic", "n", F.coalesce("b.shared", F.lit(0)).alias("shared"))
    kind = F.when(F.col("n") > 40, "overflow").when(F.col("shared") >= 0.9 * F.col("n"), "redundant").when(F.col("n") < 10, "small").otherwise("fine")
    return j.withColumn("finding", kind)


def implicit_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Per run: papers shown, saved by the reader, and those shown but not saved."""
    df = table(spark, d, "digest_papers").where(X.blank_to_null("batch").isNotNull() & X.doi_key("doi").isNotNull()).select("batch", X.doi_key("doi").alias("doi")).distinct()
    lib = table(spark, d, "papers").select(X.doi_key("doi").alias("doi"), F.lit(1).alias("saved")).where("doi is not null").distinct()
    return df.join(lib, "doi", "left").groupBy("batch").agg(F.count("*").alias("shown"), F.count("saved").alias("saved"), F.count_if(F.col("saved").isNull()).alias("passed_over"))


def feedback_targets(spark: SparkSession, d: str) -> DataFrame:
    """The library row each digest row's feedback goes to: by number, DOI, then paper_id; unknown ones are left out."""
    key = [("pmid", X.pmid_digits("pmid")), ("doi", X.doi_key("doi")), ("paper_id", F.when(F.col("paper_id") != "pmid_null", F.col("paper_id")))]
    a, b = table(spark, d, "digest_papers"), table(spark, d, "papers").withColumnRenamed("id", "paper")
    return M.cascade(a, b, "id", "paper", [(n, k, k) for n, k in key])


def upsert_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What an upsert of the latest digest rows did: rows added, changed, unchanged."""
    base = table(spark, d, "papers").select("paper_id", F.coalesce("journal", F.lit("")).alias("old"))
    new = table(spark, d, "digest_papers").where("paper_id <> 'pmid_null'").groupBy("paper_id").agg(F.max_by(F.coalesce("journal", F.lit("")), "id").alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new") == "", "skipped").when(F.col("old") != F.col("new"), "updated").otherwise("unchanged")
    return new.join(base, "paper_id", "left").groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


def published_versions(spark: SparkSession, d: str) -> DataFrame:
    """Journal rows for preprints: the first twelve title words and a word of the first author agree, the smallest id is taken."""
    start = F.array_join(F.slice(F.split(F.trim(F.regexp_replace(F.lower("title"), r"[^a-z0-9\s]", "")), r"\s+"), 1, 12), " ")
    server = F.coalesce(F.lower(F.trim("journal")).isin(PREPRINT_JOURNALS), F.lit(False))
    df = table(spark, d, "digest_papers").where(F.length("title") > 20).select("id", start.alias("start"), F.lower(X.first_author_last("authors")).alias("who"), server.alias("server"))
    pre, pub = df.where("server").withColumnRenamed("id", "preprint"), df.where("not server")
    return pre.join(pub, ["start", "who"]).groupBy("preprint").agg(F.min("id").alias("published"), F.count("*").alias("candidates"))


def full_text_dois(spark: SparkSession, d: str) -> DataFrame:
    """DOI to whether its last saved row has a full text that is no mere abstract."""
    has = (F.length(F.coalesce(X.strip_tags("full_text_summary"), F.lit(""))) >= 20) & (_status() != "summary_failed")
    df = table(spark, d, "papers").select(X.doi_key("doi").alias("doi"), "id", has.alias("has")).where("doi is not null")
    return df.groupBy("doi").agg(F.max_by("has", "id").alias("has_full_text"), F.count("*").alias("n"))


def expired_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs more than 56 days older than the last one."""
    b = table(spark, d, "digest_papers").where(F.col("batch").rlike(r"^\d{4}-\d{2}-\d{2}$")).groupBy(F.col("batch").cast("date").alias("day")).agg(F.count("*").alias("n"))
    last = b.agg(F.max("day").alias("last"))  # one row
    return b.crossJoin(F.broadcast(last)).where(F.date_diff("last", "day") > 56).select(F.date_format("day", "yyyy-MM-dd").alias("batch"), "n")


def match_confirmation(spark: SparkSession, d: str) -> DataFrame:
    """Is a document the paper its identifier says? By its title in the text, then the authors; doubt rejects."""
    docs = table(spark, d, "documents").where("text is not null and paper_id is not null").select("doc_id", "paper_id", "text")
    cand = table(spark, d, "digest_papers").where("paper_id <> 'pmid_null'").groupBy("paper_id").agg(F.min_by(F.struct("title", "authors"), "id").alias("c")).select("paper_id", "c.title", "c.authors")
    both = docs.join(cand, "paper_id").repartition(4 * spark.sparkContext.defaultParallelism, "doc_id")  # small rows, long work
    return both.select("doc_id", M.confirmed(F.col("title"), F.col("authors"), F.col("text")).alias("confirmed"))


def postings_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """A postings table built from the older documents and brought up to date by the rest, some changed, some gone: sizes by column."""
    docs = table(spark, d, "documents").select("doc_id", "text", "journal", "hash", "added_at")
    late = F.coalesce(F.col("added_at") >= "2023-01-01", F.lit(True))
    old = T.postings(docs.where(~late).withColumn("text", F.when(F.col("doc_id") % 7 == 0, "stale words").otherwise(F.col("text"))), "doc_id", ["text", "journal"])
    touched = docs.where(late | (F.col("doc_id") % 7 == 0))
    now = T.update_postings(old, touched, docs.where("doc_id % 11 = 0").select("doc_id"), "doc_id", ["text", "journal"])
    return now.groupBy("column").agg(F.count("*").alias("n"), F.sum("tf").alias("words"), F.count_distinct("doc_id").alias("docs"))


def gap_report(spark: SparkSession, d: str) -> DataFrame:
    """The ten bodies that lack most of their vectors, and the band their number puts the index in."""
    g = table(spark, d, "content_vectors").groupBy("hash").agg((F.max("seq") + 1 - F.count("*")).cast("long").alias("gap")).where("gap > 0")
    n = g.agg(F.count("*").alias("bodies"))  # one row
    band = F.when(F.col("bodies") > 10, "CRITICAL").when(F.col("bodies") > 0, "WARNING").otherwise("OK")
    return g.orderBy(F.desc("gap"), "hash").limit(10).crossJoin(F.broadcast(n)).select("hash", "gap", "bodies", band.alias("band"))


def digest_recency(spark: SparkSession, d: str) -> DataFrame:
    """Days from each source's last run to the last row added anywhere; more than eight are critical."""
    df = table(spark, d, "digest_papers").where(F.col("batch").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    last = table(spark, d, "digest_papers").agg(F.max(F.to_date("added_date")).alias("last"))  # one row
    g = df.groupBy("source").agg(F.max(F.col("batch").cast("date")).alias("day")).crossJoin(F.broadcast(last)).withColumn("days", F.date_diff("last", "day"))
    return g.select("source", "days", F.when(F.col("days") > 8, "CRITICAL").otherwise("OK").alias("state"))


def grant_classes(spark: SparkSession, d: str) -> DataFrame:
    """Awards by class of mechanism, everything else as 'other'."""
    m = F.coalesce("mechanism", F.lit(""))
    kind = F.when(m.isin("R01", "R21"), m).when(m.startswith("P"), "P*").when(m.startswith("K"), "K*").when(m.startswith("U"), "U*").otherwise("other")
    return table(spark, d, "digest_grants").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.coalesce("amount", F.lit(0))).cast("double").alias("amount"))


def suffix_paths(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose source ends in '_text' or '_feed', the underscore taken as it is."""
    return table(spark, d, "documents").where(F.expr(r"source like '%!_text' escape '!' or source like '%!_feed' escape '!'")).groupBy("source").agg(F.count("*").alias("n"))


def selected_order(spark: SparkSession, d: str) -> DataFrame:
    """The 200 best rows by combined score, unscored ones as 0, with the identifier each is known by."""
    s = F.col("sonnet_combined")
    c = F.round(F.coalesce(F.when(~F.isnan(s), s), F.lit(0.0)), 4)
    known = F.coalesce(X.blank_to_null("paper_id"), X.blank_to_null("pmid"), X.blank_to_null("doi"), F.lit(""))
    return table(spark, d, "digest_papers").select("id", c.alias("combined"), known.alias("known")).orderBy(F.desc("combined"), "id").limit(200)


def index_files(spark: SparkSession, d: str) -> DataFrame:
    """Digest rows and saved papers that meet under the name an index path and a file share."""
    a = table(spark, d, "digest_papers").where("paper_id <> 'pmid_null'").select("id", X.file_key("paper_id").alias("k"))
    b = table(spark, d, "papers").select(F.col("id").alias("paper"), X.file_key("paper_id").alias("k"))
    return a.join(b, "k").groupBy("paper").agg(F.count("*").alias("rows"), F.min("id").alias("first"))


def label_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Smallest, median, mean and largest group of vectors."""
    n = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("groups"), F.min("n").alias("least"), F.expr("percentile(n, 0.5)").alias("median"), F.round(F.avg("n"), 4).alias("mean"), F.max("n").alias("most"))


def point_updates(spark: SparkSession, d: str) -> DataFrame:
    """The library after states were set for given keys: rows rejected by the latest run are removed, all others stay."""
    new = table(spark, d, "digest_papers").where("relevance = 'low' and paper_id <> 'pmid_null'").select("paper_id").distinct().withColumn("status", F.lit("removed"))
    base = table(spark, d, "papers").select("paper_id", "status")
    keyed = K.merge_rows(base, new.join(base.select("paper_id"), "paper_id", "left_semi"), "paper_id")
    return keyed.groupBy("status").agg(F.count("*").alias("n"))


def related_labels(spark: SparkSession, d: str) -> DataFrame:
    """Groups among the ten nearest of each query vector (ids divisible by 20); a query whose hits lie in one or two is widened."""
    e = table(spark, d, "embeddings")
    n = N.nearest(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 10).select("query", "vec_id")
    g = n.join(e.select("vec_id", "label"), "vec_id").groupBy("query").agg(F.count_distinct("label").alias("groups"), F.count("*").alias("hits"))
    return g.withColumn("widen", F.col("groups") <= 2)


def query_variants(spark: SparkSession, d: str) -> DataFrame:
    """Titles of the export as variants of library titles with the same start: equal ones and those without a shared word are dropped."""
    start = F.substring(X.bare_title("title"), 1, 12)
    text = F.trim(F.lower("title"))
    side = lambda t, i: table(spark, d, t).where(F.length("title") > 20).select(start.alias("key"), F.col(i).alias("id"), text.alias("text"), F.array_distinct(T.tokens(text)).alias("words"), F.lit(None).cast("int").alias("pos"))
    return M.shared_words(side("papers", "id"), side("endnote_records", "rec_no")).select(F.col("a").alias("id"), F.col("b").alias("rec_no"), "shared")


QUERIES = {f.__name__: f for f in (
    preprint_filter, grant_selection, summary_queue, visible_states, recent_rows, days_stale, batch_order, index_order, topic_order, numeric_pmids, backlog, landing, sidecar_coverage, chunk_bodies, new_embeddings,
    first_collection, bare_sources, topic_audit, implicit_negatives, feedback_targets, upsert_outcomes, published_versions, full_text_dois, expired_runs, match_confirmation, postings_upkeep, gap_report, digest_recency,
    grant_classes, suffix_paths, selected_order, index_files, label_sizes, point_updates, related_labels, query_variants)}

STATUS = r"coalesce(regexp_replace(lower(trim(status)), '[\s-]+', '_', 'g'), 'saved')"
SERVERS = "('biorxiv', 'medrxiv', 'arxiv', 'preprints', 'biorxiv : the preprint server for biology', 'medrxiv : the preprint server for health sciences', 'research square')"
PLAIN = r"length(coalesce(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(full_text_summary, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')), ''))"
FIRST = r"""lower(case when contains(a[1], ',') then trim(split_part(trim(a[1]), ',', 1)) when regexp_matches(list_extract(regexp_split_to_array(trim(a[1]), '\s+'), -1), '^[A-Z]{1,4}$') and len(regexp_split_to_array(trim(a[1]), '\s+')) > 1
  then list_extract(regexp_split_to_array(trim(a[1]), '\s+'), 1) else list_extract(regexp_split_to_array(trim(a[1]), '\s+'), -1) end)"""
TOK = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
FILE = "regexp_replace(regexp_replace(regexp_replace(lower({0}), '_-_', '-', 'g'), '_', '-', 'g'), '-{{2,}}', '-', 'g')"
ORACLE = {
    "preprint_filter": f"select id, coalesce(lower(trim(journal)) in {SERVERS}, false) as server from digest_papers where not (coalesce(is_preprint, false) and coalesce(relevance = 'low', false))",
    "grant_selection": "select id, round(sonnet_relevance, 4) as relevance from digest_grants where coalesce(case when isnan(sonnet_relevance) then null else sonnet_relevance end, 0) >= 5.0",
    "summary_queue": f"select id, {STATUS} as status from papers where {STATUS} in ('summary_pending', 'summary_deferred') and summarized_date is null and coalesce(retry_count, 0) < 4",
    "visible_states": f"""select s as status, case when s = 'summary_ready' then 'read' when s in ('summary_pending', 'summary_deferred') then 'wait' when s = 'summary_failed' then 'retry' else 'request' end as action, count(*) as n
        from (select {STATUS} as s from papers) where s <> 'removed' group by 1, 2""",
    "recent_rows": "select source, count(*) as n from digest_papers where added_date >= (select max(added_date) from digest_papers) - interval 7 days group by source",
    "days_stale": "select source, ((select epoch_ms(max(added_at)) from documents) - epoch_ms(max(added_at))) // 86400000 as days from documents where added_at is not null group by source",
    "batch_order": r"select batch, n, (row_number() over (order by (batch = 'legacy')::int, batch desc))::int as place from (select case when regexp_matches(batch, '\S') then batch else 'legacy' end as batch, count(*) as n from digest_papers group by 1)",
    "index_order": "select id, coalesce(year(pub_date), 9999)::int as year, lower(coalesce(paper_id, '')) as file from papers order by 2, 3, 1 limit 500",
    "topic_order": r"""select topic, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(topic), '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') as file, n
        from (select topic, count(distinct id) as n from (select id, unnest(tags) as topic from papers) where topic <> '' group by topic) order by n desc, file, topic limit 100""",
    "numeric_pmids": f"select distinct try_cast({PMID} as bigint) as pmid from papers where try_cast({PMID} as bigint) is not null order by 1 limit 500",
    "backlog": "select coalesce(split_part(source, ':', 1), '') as kind, count(*) as n, ceil(count(*) / 20)::bigint as nights from papers where summarized_date is null group by 1",
    "landing": f"""select month, n, "full", case when "full" * 2 < n then 'WARNING' else 'OK' end as state from (select strftime(saved_date, '%Y-%m') as month, count(*) as n, count(*) filter ({PLAIN} >= 20) as "full" from papers where saved_date is not null group by 1)""",
    "sidecar_coverage": "select source, count(*) as n, count(*) filter (hash not in (select regexp_extract(id, '^(.*)_[0-9]+$', 1) from vectors_vec_rowids)) as uncovered from documents where paper_id is not null and hash is not null group by source",
    "chunk_bodies": "select r.vec_rowid, d.doc_id, c.seq, c.pos, c.model from vectors_vec_rowids r join content_vectors c on r.id = c.hash || '_' || c.seq join documents d on d.hash = c.hash where r.chunk_id = 1",
    "new_embeddings": """select model, case when id in (select id from vectors_vec_rowids) then 'skipped' else 'inserted' end as result, count(*) as n from (select hash || '_' || seq as id, min(model) as model from content_vectors group by 1) group by 1, 2""",
    "first_collection": """select case when starts_with(path, 'vault/Annals') then 'b' when starts_with(path, 'abstract') then 'c' when starts_with(path, 'vault') then 'a' when starts_with(path, 'grant') then 'd' else 'e' end as collection, count(*) as n
        from (select concat_ws('/', source, journal) as path from documents) group by 1""",
    "bare_sources": "select path, count(*) as n from (select concat_ws('/', source, journal) as path from documents) where path <> '' and not (starts_with(path, 'vault') or starts_with(path, 'abstract') or starts_with(path, 'preprint_text/Annals')) group by path",
    "topic_audit": """with t as (select distinct id, unnest(tags) as topic from papers), u as (select * from t where topic <> ''), n as (select topic, count(*) as n from u group by topic),
        s as (select topic, max(k) as shared from (select a.topic, b.topic as other, count(*) as k from u a join u b on a.id = b.id and a.topic <> b.topic group by all) group by topic)
        select topic, n, coalesce(shared, 0) as shared, case when n > 40 then 'overflow' when coalesce(shared, 0) >= 0.9 * n then 'redundant' when n < 10 then 'small' else 'fine' end as finding from n left join s using (topic)""",
    "implicit_negatives": rf"""with s as (select distinct batch, {DOI} as doi from digest_papers where regexp_matches(batch, '\S') and {DOI} is not null), l as (select distinct {DOI} as doi from papers where {DOI} is not null)
        select batch, count(*) as shown, count(*) filter (doi in (select doi from l)) as saved, count(*) filter (doi not in (select doi from l)) as passed_over from s group by batch""",
    "feedback_targets": f"""with l as (select id, {PMID} as k0, {DOI} as k1, case when paper_id <> 'pmid_null' then paper_id end as k2 from digest_papers), r as (select id as paper, {PMID} as k0, {DOI} as k1, case when paper_id <> 'pmid_null' then paper_id end as k2 from papers),
        m as (select l.id, 0 as n, paper from l join r using (k0) union all select l.id, 1, paper from l join r using (k1) union all select l.id, 2, paper from l join r using (k2))
        select id, (min(row(n, paper)))[2] as paper, (['pmid', 'doi', 'paper_id'])[min(n) + 1] as strategy from m group by id""",
    "upsert_outcomes": """with n as (select paper_id, arg_max(coalesce(journal, ''), id) as new from digest_papers where paper_id <> 'pmid_null' group by paper_id)
        select case when p.paper_id is null then 'added' when new = '' then 'skipped' when coalesce(p.journal, '') <> new then 'updated' else 'unchanged' end as outcome, count(*) as n from n left join papers p on p.paper_id = n.paper_id group by 1""",
    "published_versions": rf"""with k as (select id, array_to_string(regexp_split_to_array(trim(regexp_replace(lower(title), '[^a-z0-9\s]', '', 'g')), '\s+')[1:12], ' ') as start, {FIRST} as who, coalesce(lower(trim(journal)) in {SERVERS}, false) as server
          from (select *, list_filter(authors, lambda x: regexp_matches(x, '\S')) as a from digest_papers) where length(title) > 20)
        select p.id as preprint, min(q.id) as published, count(*) as candidates from k p join k q on p.start = q.start and p.who = q.who where p.server and not q.server group by p.id""",
    "full_text_dois": f"select doi, arg_max(has, id) as has_full_text, count(*) as n from (select {DOI} as doi, id, {PLAIN} >= 20 and {STATUS} <> 'summary_failed' as has from papers) where doi is not null group by doi",
    "expired_runs": r"select batch, count(*) as n from digest_papers where regexp_matches(batch, '^\d{4}-\d{2}-\d{2}$') and date_diff('day', batch::date, (select max(batch::date) from digest_papers where regexp_matches(batch, '^\d{4}-\d{2}-\d{2}$'))) > 56 group by batch",
    "match_confirmation": r"""with c as (select paper_id, arg_min({'t': title, 'a': authors}, id) as c from digest_papers where paper_id <> 'pmid_null' group by paper_id),
        j as (select doc_id, regexp_replace(lower(text), '\s+', ' ', 'g') as b, rtrim(trim(regexp_replace(lower(c.t), '\s+', ' ', 'g')), '.') as t, c.a as a from documents join c using (paper_id) where text is not null),
        w as (select *, regexp_extract_all(t, '[a-z]{3,}') as ws, greatest(length(t) * 3, 300) as win, list_filter(regexp_extract_all(t, '\b([a-z]{2,})\b', 1), lambda w: not list_contains(['a', 'an', 'the', 'of', 'in', 'for', 'and', 'or', 'is', 'to', 'by', 'on', 'at', 'its', 'with', 'from', 'that', 'this', 'not'], w)) as cw from j),
        h as (select *, t <> '' and (contains(b, t) or (len(ws) >= 3 and coalesce(list_bool_or(list_transform(range(0, length(b) - 50, 50), lambda i: len(list_filter(ws, lambda w: contains(substr(b, i + 1, win), w))) >= floor(len(ws) * 0.8))), false))) as hit from w)
        select doc_id, coalesce(hit and (len(cw) >= 6 or coalesce(list_bool_or(list_transform(list_filter(a[1:5], lambda x: x is not null), lambda x: length(rtrim(lower(regexp_split_to_array(trim(x), '\s+')[-1]), '.')) >= 3 and contains(b, rtrim(lower(regexp_split_to_array(trim(x), '\s+')[-1]), '.')))), false)), false) as confirmed from h""",
    "gap_report": """with g as (select hash, (max(seq) + 1 - count(*))::bigint as gap from content_vectors group by hash having count(*) < max(seq) + 1)
        select hash, gap, (select count(*) from g) as bodies, case when (select count(*) from g) > 10 then 'CRITICAL' else 'WARNING' end as band from g order by gap desc, hash limit 10""",
    "digest_recency": r"""select source, days::int as days, case when days > 8 then 'CRITICAL' else 'OK' end as state from (select source, date_diff('day', max(batch::date), (select max(added_date::date) from digest_papers)) as days
        from digest_papers where regexp_matches(batch, '^\d{4}-\d{2}-\d{2}$') group by source)""",
    "grant_classes": """select case when mechanism in ('R01', 'R21') then mechanism when mechanism like 'P%' then 'P*' when mechanism like 'K%' then 'K*' when mechanism like 'U%' then 'U*' else 'other' end as kind, count(*) as n, sum(coalesce(amount, 0))::double as amount from digest_grants group by 1""",
    "suffix_paths": "select source, count(*) as n from documents where source like '%!_text' escape '!' or source like '%!_feed' escape '!' group by source",
    "selected_order": r"""select id, round(coalesce(case when isnan(sonnet_combined) then null else sonnet_combined end, 0.0), 4) as combined, coalesce(case when regexp_matches(paper_id, '\S') then paper_id end, case when regexp_matches(pmid, '\S') then pmid end, case when regexp_matches(doi, '\S') then doi end, '') as known
        from digest_papers order by combined desc, id limit 200""",
    "index_files": f"""select p.id as paper, count(*) as rows, min(q.id) as first from papers p join digest_papers q on {FILE.format('p.paper_id')} = {FILE.format('q.paper_id')} where q.paper_id <> 'pmid_null' group by p.id""",
    "label_sizes": "select count(*) as groups, min(n) as least, quantile_cont(n, 0.5) as median, round(avg(n), 4) as mean, max(n) as most from (select label, count(*) as n from embeddings group by label)",
    "point_updates": "select case when paper_id in (select paper_id from digest_papers where relevance = 'low' and paper_id <> 'pmid_null') then 'removed' else status end as status, count(*) as n from papers group by 1",
    "related_labels": f"with {NEAR}, g as (select query, count(distinct label) as groups, count(*) as hits from r join embeddings using (vec_id) where rank <= 10 group by query) select *, groups <= 2 as widen from g",
    "query_variants": f"""with q as (select id, trim(lower(title)) as q, substr(regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), 1, 12) as k from papers where length(title) > 20),
        v as (select rec_no, trim(lower(title)) as v, substr(regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), 1, 12) as k from endnote_records where length(title) > 20)
        select id, rec_no, len(list_intersect({TOK.format('q')}, {TOK.format('v')}))::int as shared from q join v using (k) where q <> v and len(list_intersect({TOK.format('q')}, {TOK.format('v')})) > 0""",
    "postings_upkeep": f"""with w as (select doc_id, 'text' as "column", unnest({TOK.format("coalesce(text, '')")}) as term from documents where doc_id % 11 <> 0 union all select doc_id, 'journal', unnest({TOK.format("coalesce(journal, '')")}) from documents where doc_id % 11 <> 0)
        select "column", count(distinct doc_id || ' ' || term) as n, count(*) as words, count(distinct doc_id) as docs from w group by 1""",
}
