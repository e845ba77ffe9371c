"""Library queries: look-ups, merges, names, citations, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import papers as P
from ..functions import text as X
from ..operators import dedup as D
from ..operators import matching as M
from ..operators import neighbours as N
from ..session import stash, table
from .dedup import DOI, KEYS, PMID, TITLE
from .graph import NEAR


def suspicious_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "digest_papers").where(P.suspicious_title("title")).select("id", F.coalesce(F.length("title"), F.lit(0)).cast("long").alias("n_chars"))


def sniffed_dois(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", P.sniff_doi("text").alias("doi")).where("doi is not null")


def file_names(spark: SparkSession, d: str) -> DataFrame:
    """File names of the library, later twins numbered."""
    df = table(spark, d, "papers").withColumn("name", P.file_name("authors", "pub_date", "title"))
    return M.numbered_twins(df, "name", "id").select("id", "name", "unique_name")


def citations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("id", P.citation("authors", "pub_date", "journal").alias("citation"))


def heading_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", P.heading_title("text").alias("title")).where("title is not null")


def short_journals(spark: SparkSession, d: str) -> DataFrame:
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(P.SHORT_JOURNALS)], "ord int, prefix string, short string")
    df = table(spark, d, "digest_papers").where(F.col("journal").isNotNull()).groupBy("journal").agg(F.count("*").alias("n"))
    return M.first_prefix(df, "journal", p).select("journal", "short", "n")


def journal_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Journals of the export that the library does not have, and up to five of its own within three edits."""
    e = table(spark, d, "endnote_records").select(F.col("secondary_title").alias("journal")).distinct()
    p = table(spark, d, "papers").select("journal").where("journal is not null").distinct()
    return M.suggestions(e.join(p, "journal", "left_anti"), p, "journal").select("asked", "journal", F.col("distance").cast("long").alias("distance"), "rank")


def cascade_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Digest rows looked up in the library by number, DOI, title and first words of the title with the journal."""
    key = lambda: (X.pmid_digits("pmid"), X.doi_key("doi"), F.nullif(X.bare_title("title"), F.lit("")), F.concat_ws("|", F.substring(X.bare_title("title"), 1, 30), F.lower("journal")))
    names = ("pmid", "doi", "title", "title start and journal")
    a, b = table(spark, d, "digest_papers"), table(spark, d, "papers").withColumnRenamed("id", "paper")
    return M.cascade(a, b, "id", "paper", [(n, k, k) for n, k in zip(names, key())])


def field_merge(spark: SparkSession, d: str) -> DataFrame:
    """Library rows with empty fields filled from the latest digest row of the same DOI, and what was filled."""
    new = table(spark, d, "digest_papers").select(X.doi_key("doi").alias("key"), "id", "pmid", "abstract", "journal").where("key is not null")
    new = new.groupBy("key").agg(F.max_by(F.struct("pmid", "abstract", "journal"), "id").alias("r")).select("key", "r.*")
    df = table(spark, d, "papers").select("id", X.doi_key("doi").alias("key"), "pmid", "abstract", "journal")
    return M.fill_fields(df, new, "key", ["pmid", "abstract", "journal"]).select("id", "pmid", "journal", F.length("abstract").cast("long").alias("n"), "changed")


def check_new(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the latest run that meet the registry of earlier ones: by which kind, and the first row there."""
    df = table(spark, d, "digest_papers").where(F.col("batch").rlike(r"\S"))
    last = df.agg(F.max("batch").alias("last"))
    df = df.crossJoin(F.broadcast(last))  # one row
    new, old = D.paper_keys(df.where("batch = last")), D.registry(D.paper_keys(df.where("batch < last")))
    rank = F.when(F.col("kind") == "pmid", 0).when(F.col("kind") == "doi", 1).otherwise(2)
    return new.join(old, ["kind", "value"]).groupBy("id").agg(F.min(F.struct(rank.alias("r"), "kind", "first")).alias("m")).select("id", F.col("m.kind").alias("kind"), F.col("m.first").alias("first"))


def neighbor_stats(spark: SparkSession, d: str) -> DataFrame:
    """How many neighbours above 0.2 query vectors have: least, median, mean, most."""
    e = table(spark, d, "embeddings")
    n = N.nearest(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 30, least=0.2).groupBy("query").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("queries"), F.min("n").alias("least"), F.expr("percentile(n, 0.5)").alias("median"), F.round(F.avg("n"), 4).alias("mean"), F.max("n").alias("most"))


def two_hop(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of the five nearest that are not among the ten nearest themselves.

    Query vectors (ids divisible by 20) are compared with all vectors, and so
    are, as the next stated query set, the vectors they lead to.
    """
    e = table(spark, d, "embeddings")
    near = stash(N.nearest(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 10))
    first = near.where("rank <= 5").select("query", F.col("vec_id").alias("via"))
    onward = N.nearest(e, e.join(first.select(F.col("via").alias("vec_id")).distinct(), "vec_id", "left_semi"), "vec_id", "embedding", 10)
    hop = first.join(onward.select(F.col("query").alias("via"), "vec_id", "sim"), "via").where("query <> vec_id")
    return hop.join(near.select("query", "vec_id"), ["query", "vec_id"], "left_anti").groupBy("query", "vec_id").agg(F.max("sim").alias("sim"), F.count("*").alias("paths"))


def summary_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings in the JSON summaries, in long form."""
    j = F.from_json(P.fenced_json("full_summary", "{}"), "findings array<string>")
    return table(spark, d, "papers").select("id", F.posexplode(j["findings"]).alias("pos", "finding"))


def key_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Titles that stand with more than one PubMed number."""
    df = table(spark, d, "digest_papers").select(X.title_key("title").alias("key"), X.pmid_digits("pmid").alias("pmid")).where("key <> '' and pmid is not null")
    return df.groupBy("key").agg(F.count_distinct("pmid").alias("numbers"), F.count("*").alias("n")).where("numbers > 1")


QUERIES = {f.__name__: f for f in (
    suspicious_titles, sniffed_dois, file_names, citations, heading_titles, short_journals, journal_suggestions, cascade_lookup, field_merge, check_new, neighbor_stats, two_hop, summary_findings, key_conflicts)}

LAST = r"""case when contains(a[1], ',') then trim(split_part(trim(a[1]), ',', 1)) when regexp_matches(list_extract(regexp_split_to_array(trim(a[1]), '\s+'), -1), '^[A-Z]{1,4}$') and len(regexp_split_to_array(trim(a[1]), '\s+')) > 1
  then list_extract(regexp_split_to_array(trim(a[1]), '\s+'), 1) else list_extract(regexp_split_to_array(trim(a[1]), '\s+'), -1) end"""
A = r"select *, list_filter(authors, lambda x: regexp_matches(x, '\S')) as a from papers"
BARE = "regexp_replace(lower(title), '[^a-z0-9]', '', 'g')"
ORACLE = {
    "suspicious_titles": r"""select id, coalesce(length(title), 0)::bigint as n_chars from digest_papers where length(trim(coalesce(title, ''))) < 15 or contains(title, 'GLYPH') or regexp_matches(trim(title),
        '(?i)^(research\s+article|original\s+article|review\s+article|techniques\s+and\s+resources|basic\s+science|brief\s+communication|short\s+communication|letter\s+to\s+the\s+editor|editorial|commentary|perspective|open\s+access|clinical\s*[-–]\s*|glyph|\*?for\s+correspondence|https?://|doi:)')""",
    "sniffed_dois": r"select * from (select doc_id, nullif(regexp_replace(regexp_extract(substr(text, 1, 5000), '(10\.\d{4,}/[^\s]+)', 1), '[.,;)]+$', ''), '') as doi from documents) where doi is not null",
    "file_names": rf"""with n as (select id, concat_ws('-', nullif(regexp_replace({LAST}, '[^\p{{L}}]', '', 'g'), ''), year(pub_date)::varchar,
        nullif(substr(array_to_string(list_filter(regexp_extract_all(coalesce(title, ''), '[a-zA-Z0-9]+'), lambda w: not list_contains(['a', 'an', 'the', 'of', 'in', 'for', 'and', 'or', 'is', 'to', 'by', 'on', 'at', 'with', 'from', 'that', 'this', 'are'], lower(w)))[1:6], '_'), 1, 50), '')) as name from ({A}))
        select id, name, case when row_number() over (partition by name order by id) > 1 then name || '-' || row_number() over (partition by name order by id) else name end as unique_name from n""",
    "citations": rf"""select id, concat_ws(', ', case when len(authors) > 2 then l || ' et al.' else l end, year(pub_date)::varchar, case when regexp_matches(journal, '\S') then journal end) as citation from (select *, {LAST} as l from ({A}))""",
    "heading_titles": r"select * from (select doc_id, nullif(trim(regexp_extract(text, '(?m)^##?[ \t]+([^\r\n]+)', 1)), '') as title from documents) where title is not null",
    "short_journals": """with p(ord, prefix, short) as (values (0, 'cell metabolism', 'Cell Metab'), (1, 'the journal of clinical investigation', 'JCI'), (2, 'journal of clinical investigation', 'JCI'), (3, 'nature communications', 'Nat Commun'), (4, 'nature metabolism', 'Nat Metab'),
        (5, 'cell reports', 'Cell Rep'), (6, 'endocrinology', 'Endocrinology'), (7, 'scientific reports', 'Sci Rep'), (8, 'diabetes', 'Diabetes'), (9, 'obesity', 'Obesity'), (10, 'molecular metabolism', 'Mol Metab'), (11, 'nutrients', 'Nutrients'), (12, 'physiology & behavior', 'Physiol Behav'),
        (13, 'annual review of nutrition', 'Annu Rev Nutr'), (14, 'proceedings of the national academy of sciences', 'PNAS'), (15, 'the journal of neuroscience', 'J Neurosci'), (16, 'journal of neuroscience', 'J Neurosci'), (17, 'neuropharmacology', 'Neuropharmacol'),
        (18, 'american journal of physiology', 'Am J Physiol'), (19, 'metabolism', 'Metabolism'), (20, 'plos one', 'PLoS ONE'), (21, 'elife', 'eLife'), (22, 'nature', 'Nature'), (23, 'cell', 'Cell'), (24, 'nature medicine', 'Nat Med'), (25, 'science', 'Science'), (26, 'appetite', 'Appetite'), (27, 'chemical senses', 'Chem Senses')),
        j as (select journal, count(*) as n from digest_papers where journal is not null group by journal)
        select journal, coalesce(arg_min(short, ord), array_to_string(string_split(journal, ' ')[1:3], ' ')) as short, any_value(n) as n from j left join p on starts_with(lower(journal), prefix) group by journal""",
    "journal_suggestions": """with p as (select distinct journal from papers where journal is not null), e as (select distinct secondary_title as asked from endnote_records where secondary_title is not null and secondary_title not in (select journal from p))
        select * from (select asked, journal, levenshtein(asked, journal) as distance, (row_number() over (partition by asked order by levenshtein(asked, journal), journal))::int as rank from e, p where levenshtein(asked, journal) <= 3 and length(asked) >= 4) where rank <= 5""",
    "cascade_lookup": f"""with l as (select id, {PMID} as k0, {DOI} as k1, nullif({BARE}, '') as k2, concat_ws('|', substr({BARE}, 1, 30), lower(journal)) as k3 from digest_papers),
        r as (select id as paper, {PMID} as k0, {DOI} as k1, nullif({BARE}, '') as k2, concat_ws('|', substr({BARE}, 1, 30), lower(journal)) as k3 from papers),
        m as (select l.id, 0 as n, paper from l join r using (k0) union all select l.id, 1, paper from l join r using (k1) union all select l.id, 2, paper from l join r using (k2) union all select l.id, 3, paper from l join r using (k3))
        select id, (min(row(n, paper)))[2] as paper, (['pmid', 'doi', 'title', 'title start and journal'])[min(n) + 1] as strategy from m group by id""",
    "field_merge": rf"""with n as (select {DOI} as key, arg_max(row(pmid, abstract, journal), id) as r from digest_papers where {DOI} is not null group by 1),
        j as (select p.*, r[1] as np, r[2] as na, r[3] as nj from (select *, {DOI} as key from papers) p left join n using (key)),
        f as (select *, regexp_matches(coalesce(pmid, ''), '^\s*$') and regexp_matches(coalesce(np, ''), '\S') as fp, regexp_matches(coalesce(abstract, ''), '^\s*$') and regexp_matches(coalesce(na, ''), '\S') as fa, regexp_matches(coalesce(journal, ''), '^\s*$') and regexp_matches(coalesce(nj, ''), '\S') as fj from j)
        select id, case when fp then np else pmid end as pmid, case when fj then nj else journal end as journal, length(case when fa then na else abstract end) as n,
        concat_ws(',', case when fp then 'pmid' end, case when fa then 'abstract' end, case when fj then 'journal' end) as changed from f""",
    "check_new": rf"""with k as (select k.*, batch, (select max(batch) from digest_papers where regexp_matches(batch, '\S')) as last from {KEYS} k join digest_papers d using (id) where value is not null and regexp_matches(batch, '\S')),
        old as (select kind, value, min(id) as first from k where batch < last group by all), m as (select k.id, kind, first, case kind when 'pmid' then 0 when 'doi' then 1 else 2 end as r from k join old using (kind, value) where batch = last)
        select id, (min(row(r, kind, first)))[2] as kind, (min(row(r, kind, first)))[3] as first from m group by id""",
    "neighbor_stats": f"with {NEAR}, c as (select query, count(*) as n from r where sim >= 0.2 and rank <= 30 group by query) select count(*) as queries, min(n) as least, quantile_cont(n, 0.5) as median, round(avg(n), 4) as mean, max(n) as most from c",
    "two_hop": f"""with {NEAR}, n as (select query, vec_id, sim, rank from r where rank <= 10), v as (select distinct vec_id as via from n where rank <= 5),
        s2 as (select a.vec_id as via, b.vec_id, round(list_dot_product(a.v, b.v) / (a.n * b.n), 6) as sim from u a join v on a.vec_id = via, u b where a.vec_id <> b.vec_id),
        n2 as (select * from (select *, row_number() over (partition by via order by sim desc, vec_id) as rank from s2) where rank <= 10),
        h as (select a.query, b.vec_id, b.sim from n a join n2 b on a.vec_id = b.via where a.rank <= 5 and a.query <> b.vec_id)
        select query, vec_id, max(sim) as sim, count(*) as paths from h where (query, vec_id) not in (select (query, vec_id) from n) group by all""",
    "summary_findings": r"""select id, (unnest(generate_series(0, len(f) - 1)))::int as pos, unnest(f) as finding from (select id, from_json(json_extract(regexp_extract(full_summary, '(?s)(\{.*\})', 1), '$.findings'), '["VARCHAR"]') as f from papers where full_summary is not null)
        where len(f) > 0""",
    "key_conflicts": f"select key, count(distinct pmid) as numbers, count(*) as n from (select {TITLE} as key, {PMID} as pmid from digest_papers) where key <> '' and pmid is not null group by key having count(distinct pmid) > 1",
}
