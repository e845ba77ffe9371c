"""Duplicate, identity and storage-consistency queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dedup as D
from ..session import table

PMID = r"nullif(regexp_replace(regexp_extract(trim(pmid), '([0-9]+)(?:\.0*)?[^0-9]*$', 1), '^0+', '', 'g'), '')"
DOI = r"nullif(regexp_replace(regexp_extract(lower(regexp_replace(doi, '%2f', '/', 'gi')), '(10\.[0-9]{4,}/[^\s]+)', 1), '[.,;)]+$', '', 'g'), '')"
TITLE = r"substr(trim(regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')), 1, 80)"
KEYS = f"""(select id, 'pmid' as kind, {PMID} as value from digest_papers union all select id, 'doi', {DOI} from digest_papers
  union all select id, 'title', case when length({TITLE}) > 20 then {TITLE} end from digest_papers)"""


def identifiers(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "digest_papers")
    return df.select(
        "id", X.doi_slug("doi", "pmid").alias("slug"), X.pmid_digits("pmid").alias("pmid"), X.doi_key("doi").alias("doi"), X.is_preprint_doi("doi", ["99001"]).alias("preprint"),
        X.bare_title("title").alias("bare"), X.title_key("title").alias("key"), X.slugify("title").alias("url"), X.file_key("paper_id").alias("file"),
    )


def author_fields(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "digest_papers").where(F.size("authors") > 0)
    return df.select("id", X.author_line("authors").alias("line"), X.first_author_last("authors").alias("first_last"), F.size("authors").cast("long").alias("n"))


def dup_registry_stats(spark: SparkSession, d: str) -> DataFrame:
    return D.registry_stats(D.paper_keys(table(spark, d, "digest_papers")))


def dup_groups(spark: SparkSession, d: str) -> DataFrame:
    return D.duplicate_groups(D.paper_keys(table(spark, d, "digest_papers")))


def canonical_pick(spark: SparkSession, d: str) -> DataFrame:
    """Of digest rows with one DOI: a summary, a PubMed number, an abstract, more authors, the longer title are preferred."""
    df = table(spark, d, "digest_papers")
    b = lambda c: X.blank_to_null(c).isNotNull().cast("int")
    pref = [b("full_text_summary"), b("pmid"), b("abstract"), F.coalesce(F.size("authors"), F.lit(0)), F.coalesce(F.length("title"), F.lit(0))]
    return D.canonical_rows(df, X.doi_key("doi"), pref)


def seen_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Digest rows whose paper is not in the library, by PubMed number or DOI."""
    cols = lambda n: table(spark, d, n).select("id", X.pmid_digits("pmid").alias("pmid"), X.doi_key("doi").alias("doi"))
    return D.unseen(cols("digest_papers"), cols("papers"), ["pmid", "doi"]).select("id")


def first_arrivals(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "digest_papers").select("id", "batch", X.bare_title("title").alias("bare")).where(F.length("bare") > 20)
    return D.first_wins(df, ["bare"], "id").select("id", "batch")


def library_badges(spark: SparkSession, d: str) -> DataFrame:
    """Which digest rows are saved, under any of three keys."""
    keys = lambda n: table(spark, d, n).select(F.col("id"), F.explode(F.array_compact(F.array(F.concat(F.lit("i"), "paper_id"), F.concat(F.lit("p"), X.pmid_digits("pmid")), F.concat(F.lit("d"), X.doi_key("doi"))))).alias("k"))
    hit = keys("digest_papers").where("k <> 'ipmid_null'").join(keys("papers").select("k").distinct(), "k", "left_semi")
    return hit.select("id").distinct()


def content_dedup(spark: SparkSession, d: str) -> DataFrame:
    return D.content_addressed(table(spark, d, "documents"), "text", "doc_id")


def hash_needs_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Bodies without a first vector in the log."""
    cv = table(spark, d, "content_vectors").where("seq = 0").select("hash")
    return table(spark, d, "documents").where("hash is not null").join(cv, "hash", "left_anti").groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


def seq_gaps(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "content_vectors").groupBy("hash").agg((F.max("seq") + 1).cast("long").alias("expected"), F.count("*").alias("n"))
    return g.where("n < expected").withColumn("gap", F.col("expected") - F.col("n"))


def _logged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cv = table(spark, d, "content_vectors").select(F.concat_ws("_", "hash", F.col("seq").cast("string")).alias("id"))
    return cv, table(spark, d, "vectors_vec_rowids").select("id")


def parity(spark: SparkSession, d: str) -> DataFrame:
    """Log entries against stored vectors: counts, difference in percent, band."""
    cv, rows = _logged(spark, d)
    n = cv.agg(F.count("*").alias("logged")).crossJoin(rows.agg(F.count("*").alias("stored")))  # one row each
    pct = F.round(F.abs(F.col("logged") - F.col("stored")) * 100.0 / F.greatest("logged", F.lit(1)), 4)
    return n.withColumn("percent", pct).withColumn("band", F.when(F.col("percent") > 5, "CRITICAL").when(F.col("percent") > 1, "WARNING").otherwise("OK"))


def orphan_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Stored vectors without a log entry, log entries without a vector, logged bodies without a document."""
    cv, rows = _logged(spark, d)
    docs = table(spark, d, "documents").select("hash")
    bodies = table(spark, d, "content_vectors").select("hash").distinct().join(docs, "hash", "left_anti")
    one = lambda df, k, c: df.select(F.lit(k).alias("kind"), F.col(c).alias("id"))
    return one(rows.join(cv, "id", "left_anti"), "no log entry", "id").unionByName(one(cv.join(rows, "id", "left_anti"), "no vector", "id")).unionByName(one(bodies, "no document", "hash"))


def model_counts(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "content_vectors").groupBy("model")
    return g.agg(F.count("*").alias("n"), F.count_distinct("hash").alias("hashes"), F.max("seq").cast("long").alias("max_seq"))


def table_counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t in ("digest_papers", "papers", "documents", "content_vectors"):
        n = table(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "documents").groupBy("source")
    return g.agg(
        F.count("*").alias("n"), F.count_distinct("hash").alias("bodies"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") == 0).alias("empty"),
        F.date_format(F.max("added_at"), "yyyy-MM-dd").alias("latest"), F.round(F.expr("percentile(n_chars, 0.5)"), 2).alias("median"),
    )


def embedding_churn(spark: SparkSession, d: str) -> DataFrame:
    """Per month: vectors logged, bodies first logged in it, and the share that is re-embedding."""
    at = F.substring("embedded_at", 1, 7)
    cv = table(spark, d, "content_vectors").where(F.col("embedded_at").isNotNull()).withColumn("month", at)
    first = cv.groupBy("hash").agg(F.min("month").alias("born"))
    j = cv.join(first, "hash").groupBy("month").agg(F.count("*").alias("n"), F.count_if(F.col("month") == F.col("born")).alias("fresh"))
    return j.withColumn("again", F.round((F.col("n") - F.col("fresh")) * 100.0 / F.col("n"), 4))


def missing_fields(spark: SparkSession, d: str) -> DataFrame:
    """Library audit per source kind: rows without a number, DOI, abstract, authors, full text."""
    miss = lambda c: F.count_if(X.blank_to_null(c).isNull())
    df = table(spark, d, "papers").withColumn("kind", F.coalesce(F.split("source", ":")[0], F.lit("")))
    return df.groupBy("kind").agg(
        F.count("*").alias("n"), F.count_if(X.pmid_digits("pmid").isNull()).alias("no_pmid"), miss("doi").alias("no_doi"), miss("abstract").alias("no_abstract"),
        F.count_if(F.coalesce(F.size("authors"), F.lit(0)) <= 0).alias("no_authors"), F.count_if(F.length(F.coalesce(X.strip_tags("full_text_summary"), F.lit(""))) < 20).alias("no_full_text"),
    )


def false_full_text(spark: SparkSession, d: str) -> DataFrame:
    """Notes said to hold an article but with fewer than 50 lines."""
    df = table(spark, d, "documents").where(F.col("source").isin("preprint_text", "vault"))
    n = F.size(F.split(F.regexp_replace("text", "\r\n|\r", "\n"), "\n")).cast("long")
    return df.select("doc_id", n.alias("lines")).where("lines < 50")


def growth(spark: SparkSession, d: str) -> DataFrame:
    """Papers saved per month and in total so far."""
    m = table(spark, d, "papers").where(F.col("saved_date").isNotNull()).groupBy(F.date_format("saved_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return m.withColumn("total", F.sum("n").over(Window.orderBy("month")))  # one row a month


def run_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Runs that came more than 8 days after the one before."""
    b = table(spark, d, "digest_papers").where(F.col("batch").rlike(r"^\d{4}-\d{2}-\d{2}$")).select(F.col("batch").cast("date").alias("day")).distinct()
    gap = F.date_diff("day", F.lag("day").over(Window.orderBy("day"))).cast("long")  # one row a run
    return b.select(F.date_format("day", "yyyy-MM-dd").alias("batch"), gap.alias("gap")).where("gap > 8")


def decade_histogram(spark: SparkSession, d: str) -> DataFrame:
    y = F.regexp_extract("pub_year", r"(\d{4})", 1).try_cast("int")
    df = table(spark, d, "endnote_records").select(y.alias("y")).where("y between 1900 and 2030")
    return df.groupBy((F.floor(F.col("y") / 10) * 10).cast("long").alias("decade")).agg(F.count("*").alias("n"))


def ref_set_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Bare titles of the library and the reference manager's export: in both, in one."""
    p = table(spark, d, "papers").select(X.bare_title("title").alias("t")).where("t <> ''").distinct().withColumn("a", F.lit(1))
    e = table(spark, d, "endnote_records").select(X.bare_title("title").alias("t")).where("t <> ''").distinct().withColumn("b", F.lit(1))
    j = p.join(e, "t", "full_outer")
    return j.groupBy(F.when(F.col("a").isNull(), "export").when(F.col("b").isNull(), "library").otherwise("both").alias("where_")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    identifiers, author_fields, dup_registry_stats, dup_groups, canonical_pick, seen_antijoin, first_arrivals, library_badges, content_dedup, hash_needs_embedding, seq_gaps, parity, orphan_vectors, model_counts,
    table_counts, collection_stats, embedding_churn, missing_fields, false_full_text, growth, run_gaps, decade_histogram, ref_set_overlap)}

ORACLE = {
    "identifiers": rf"""select id, coalesce(translate(case when regexp_matches(doi, '\S') then doi end, '/.', '_-'), 'pmid_' || case when regexp_matches(pmid, '\S') then pmid end) as slug, {PMID} as pmid, {DOI} as doi,
        coalesce(regexp_extract({DOI}, '^10\.([0-9]+)/', 1) = '99001', false) as preprint, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') as bare, {TITLE} as key,
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') as url,
        regexp_replace(regexp_replace(regexp_replace(lower(paper_id), '_-_', '-', 'g'), '_', '-', 'g'), '-{{2,}}', '-', 'g') as file from digest_papers""",
    "author_fields": r"""with a as (select id, list_filter(authors, lambda x: regexp_matches(x, '\S')) as a, len(authors) as n from digest_papers where len(authors) > 0)
        select id, case when len(a) > 3 then array_to_string(a[1:3], ', ') || ' et al.' when len(a) > 0 then array_to_string(a, ', ') end as line,
        case when contains(a[1], ',') then trim(split_part(trim(a[1]), ',', 1)) when regexp_matches(list_extract(regexp_split_to_array(trim(a[1]), '\s+'), -1), '^[A-Z]{1,4}$') and len(regexp_split_to_array(trim(a[1]), '\s+')) > 1
          then list_extract(regexp_split_to_array(trim(a[1]), '\s+'), 1) else list_extract(regexp_split_to_array(trim(a[1]), '\s+'), -1) end as first_last, n from a""",
    "dup_registry_stats": f"""select kind, count(*) as "values", count(*) filter (n = 1) as unique_values, count(*) filter (n > 1) as shared_values from
        (select kind, value, count(distinct id) as n from {KEYS} where value is not null group by all) group by kind""",
    "dup_groups": f"""with k as (select distinct kind, value, id from {KEYS} where value is not null), g as (select kind, value, count(*) as n, min(id) as first, max(id) as last from k group by kind, value having count(*) > 1),
        m as (select k.* from k join g using (kind, value)), p as (select distinct id from m where kind = 'pmid'),
        d as (select value, bool_or(id in (select id from p)) as seen from m where kind = 'doi' group by value),
        told as (select id from p union select id from m join d using (value) where kind = 'doi' and not seen),
        t as (select value, bool_or(id in (select id from told)) as seen from m where kind = 'title' group by value
          having count(*) filter (id in (select id from k where kind = 'pmid')) between 1 and count(*) - 1)
        select g.*, false as seen from g where kind = 'pmid' union all select g.*, seen from g join d using (value) where kind = 'doi' union all select g.*, seen from g join t using (value) where kind = 'title'""",
    "canonical_pick": rf"""with r as (select {DOI} as g, id, (case when regexp_matches(full_text_summary, '\S') then 1 else 0 end) as a, (case when regexp_matches(pmid, '\S') then 1 else 0 end) as b, (case when regexp_matches(abstract, '\S') then 1 else 0 end) as c,
          coalesce(len(authors), 0) as e, coalesce(length(title), 0) as f from digest_papers), o as (select *, row_number() over (partition by g order by a desc, b desc, c desc, e desc, f desc, id) as rn, count(*) over (partition by g) as n from r where g is not null)
        select x.g as "group", x.id as kept, x.n, y.id as runner_up, (case when x.a <> y.a then 1 when x.b <> y.b then 2 when x.c <> y.c then 3 when x.e <> y.e then 4 when x.f <> y.f then 5 else 0 end)::int as decided_by
        from o x join o y on x.g = y.g and x.rn = 1 and y.rn = 2""",
    "seen_antijoin": f"""with k as (select {PMID} as p, {DOI} as d from papers) select id from (select id, {PMID} as p, {DOI} as d from digest_papers) q
        where not exists (select 1 from k where k.p = q.p) and not exists (select 1 from k where k.d = q.d)""",
    "first_arrivals": "select id, batch from (select id, batch, row_number() over (partition by b order by id) as r from (select *, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') as b from digest_papers) where length(b) > 20) where r = 1",
    "library_badges": f"""with p as (select paper_id, {PMID} as p, {DOI} as d from papers) select id from (select id, paper_id, {PMID} as p, {DOI} as d from digest_papers) q where
        (q.paper_id <> 'pmid_null' and q.paper_id in (select paper_id from p)) or q.p in (select p from p where p is not null) or q.d in (select d from p where d is not null)""",
    "content_dedup": "select sha256(text) as hash, min(doc_id) as first, count(*) as n from documents where text is not null group by 1",
    "hash_needs_embedding": "select hash, min(doc_id) as doc_id, count(*) as n from documents where hash is not null and hash not in (select hash from content_vectors where seq = 0) group by hash",
    "seq_gaps": "select hash, (max(seq) + 1)::bigint as expected, count(*) as n, (max(seq) + 1 - count(*))::bigint as gap from content_vectors group by hash having count(*) < max(seq) + 1",
    "parity": """select *, case when percent > 5 then 'CRITICAL' when percent > 1 then 'WARNING' else 'OK' end as band from (select logged, stored, round(abs(logged - stored) * 100.0 / greatest(logged, 1), 4)::double as percent
        from (select count(*) as logged from content_vectors), (select count(*) as stored from vectors_vec_rowids))""",
    "orphan_vectors": """with c as (select hash || '_' || seq as id from content_vectors), r as (select id from vectors_vec_rowids)
        select 'no log entry' as kind, id from r where id not in (select id from c) union all select 'no vector', id from c where id not in (select id from r)
        union all select 'no document', hash from (select distinct hash from content_vectors) where hash not in (select hash from documents where hash is not null)""",
    "model_counts": "select model, count(*) as n, count(distinct hash) as hashes, max(seq)::bigint as max_seq from content_vectors group by model",
    "table_counts": " union all ".join(f"select '{t}' as name, count(*) as n from {t}" for t in ("digest_papers", "papers", "documents", "content_vectors")),
    "collection_stats": """select source, count(*) as n, count(distinct hash) as bodies, sum(n_chars)::bigint as chars, count(*) filter (n_chars = 0) as empty, strftime(max(added_at), '%Y-%m-%d') as latest,
        round(quantile_cont(n_chars, 0.5), 2) as median from documents group by source""",
    "embedding_churn": """with c as (select hash, substr(embedded_at, 1, 7) as month from content_vectors where embedded_at is not null), f as (select hash, min(month) as born from c group by hash)
        select month, count(*) as n, count(*) filter (month = born) as fresh, round((count(*) - count(*) filter (month = born)) * 100.0 / count(*), 4) as again from c join f using (hash) group by month""",
    "missing_fields": rf"""select coalesce(split_part(source, ':', 1), '') as kind, count(*) as n, count(*) filter ({PMID} is null) as no_pmid, count(*) filter (not coalesce(regexp_matches(doi, '\S'), false)) as no_doi,
        count(*) filter (not coalesce(regexp_matches(abstract, '\S'), false)) as no_abstract, count(*) filter (coalesce(len(authors), 0) = 0) as no_authors,
        count(*) filter (length(coalesce(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(full_text_summary, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')), '')) < 20) as no_full_text
        from papers group by 1""",
    "false_full_text": r"select * from (select doc_id, len(string_split(regexp_replace(text, '\r\n|\r', chr(10), 'g'), chr(10)))::bigint as lines from documents where source in ('preprint_text', 'vault')) where lines < 50",
    "growth": "select month, n, (sum(n) over (order by month))::bigint as total from (select strftime(saved_date, '%Y-%m') as month, count(*) as n from papers where saved_date is not null group by 1)",
    "run_gaps": r"""select * from (select batch, (batch::date - lag(batch::date) over (order by batch))::bigint as gap from (select distinct batch from digest_papers where regexp_matches(batch, '^\d{4}-\d{2}-\d{2}$'))) where gap > 8""",
    "decade_histogram": r"select (y // 10 * 10)::bigint as decade, count(*) as n from (select try_cast(regexp_extract(pub_year, '(\d{4})', 1) as int) as y from endnote_records) where y between 1900 and 2030 group by 1",
    "ref_set_overlap": """with p as (select distinct regexp_replace(lower(title), '[^a-z0-9]', '', 'g') as t from papers), e as (select distinct regexp_replace(lower(title), '[^a-z0-9]', '', 'g') as t from endnote_records)
        select case when p.t is null then 'export' when e.t is null then 'library' else 'both' end as where_, count(*) as n from (select * from p where t <> '') p full outer join (select * from e where t <> '') e on p.t = e.t group by 1""",
}
