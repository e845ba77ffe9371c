"""Digest queries: scoring, selection, ordering, batches, grants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dedup as D
from ..operators import matching as M
from ..operators import scoring as S
from ..operators import state as K
from ..session import table

HIGH, MEDIUM = ["insulin", "obesity", "~fasting", "ketone"], ["mice", "lipid", "circadian", "glucose"]


def _text():
    return F.concat_ws(" ", "title", "abstract")


def _sum(part: list[str]) -> str:
    return " + ".join(f"(case when regexp_matches(t, '\\b{k[1:]}\\b') then 1 else 0 end)" if k[0] == "~" else f"(case when contains(t, '{k}') then 1 else 0 end)" for k in part)


KEYWORD_SQL = f"""
  select *, least((3 * h + m) / 10.0, 1.0)::double as raw from (
    select *, ({_sum(HIGH)}) as h, ({_sum(MEDIUM)}) as m from (select *, lower(concat_ws(' ', title, abstract)) as t from digest_papers))
"""
TIER = "case when {0} >= 0.6 then 'high' when {0} >= 0.3 then 'medium' else 'low' end"


def keyword_score(spark: SparkSession, d: str) -> DataFrame:
    df = S.with_keyword_score(table(spark, d, "digest_papers"), _text(), HIGH, MEDIUM)
    return df.select("id", "keyword_score", "keyword_tier", F.array_join("matched", ",").alias("matched"))


def _matched() -> str:
    parts = [f"case when regexp_matches(t, '\\b{k[1:]}\\b') then '{k[1:]}' end" if k[0] == "~" else f"case when contains(t, '{k}') then '{k}' end" for k in [*HIGH, *MEDIUM]]
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x is not null)[1:5], ',')"


def keyword_floor(spark: SparkSession, d: str) -> DataFrame:
    """Hits of a search are raised to at least medium and 0.3; one row a paper_id, the first to arrive wins."""
    df = S.with_keyword_score(table(spark, d, "digest_papers").where(F.col("source").startswith("Search") | (F.col("is_preprint"))), _text(), HIGH, MEDIUM)
    df = df.select("id", "paper_id", F.greatest("keyword_score", F.lit(0.3)).alias("score"), F.when(F.col("keyword_tier") == "high", "high").otherwise("medium").alias("tier"))
    return D.first_wins(df, ["paper_id"], "id")


def digest_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: keyword and profile score, the 500 nearest to the profile, main and wildcard sections, tiers."""
    df = S.with_keyword_score(table(spark, d, "digest_papers"), _text(), HIGH, MEDIUM)
    df = df.where(F.length("title") > 10).withColumn("profile", F.round(S.profile_score(*(F.coalesce(F.col(f"embedding_{p}"), F.lit(0.0)) for p in ("core", "methods", "adjacent"))), 7))
    top = df.orderBy(F.desc("profile"), "id").limit(500)
    out = S.sections(top, "sonnet_relevance", "sonnet_surprise", "id")
    c = F.round(S.combined_score(F.col("sonnet_relevance"), F.coalesce(S.known(F.col("sonnet_surprise")), F.lit(0.0))), 4)
    return out.select("id", "section", "profile", "keyword_score", c.alias("combined"), S.score_tier(c).alias("tier"))


def profile_score_top(spark: SparkSession, d: str) -> DataFrame:
    p = F.round(S.profile_score(F.col("embedding_core"), F.col("embedding_methods"), F.col("embedding_adjacent")), 7)
    return table(spark, d, "digest_papers").select("id", p.alias("profile")).where(F.col("profile").isNotNull() & ~F.isnan("profile")).orderBy(F.desc("profile"), "id").limit(500)


def select_main_wildcard(spark: SparkSession, d: str) -> DataFrame:
    return S.sections(table(spark, d, "digest_papers"), "sonnet_relevance", "sonnet_surprise", "id").select("id", "section")


def apply_scores_left(spark: SparkSession, d: str) -> DataFrame:
    """Saved papers with the best score their digest rows got; papers without one are marked."""
    p = table(spark, d, "papers").select("id", X.pmid_digits("pmid").alias("pmid"))
    s = table(spark, d, "digest_papers").select(X.pmid_digits("pmid").alias("pmid"), S.known(F.col("sonnet_combined")).alias("s")).where("pmid is not null").groupBy("pmid").agg(F.max("s").alias("score"))
    j = p.join(s, "pmid", "left")
    return j.select("id", F.round("score", 4).alias("score"), F.when(F.col("score").isNull(), "embedding-only").otherwise("full").alias("method"))


def abort_gate(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "digest_papers").where(X.blank_to_null("batch").isNotNull())
    return S.failure_gate(df, ["batch"], F.col("scoring_method") != "full", 10.0)


def batch_slices(spark: SparkSession, d: str) -> DataFrame:
    """Scoring requests of 15 rows each within a run: number of requests and sizes of the last."""
    df = M.place_in_group(table(spark, d, "digest_papers").where(X.blank_to_null("batch").isNotNull()).select("batch", "id"), "batch", "id").withColumn("slice", F.floor(F.col("place") / 15))
    return df.groupBy("batch", "slice").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


def frontend_order(spark: SparkSession, d: str) -> DataFrame:
    """The 200 rows a reader sees first: best combined score, then latest added."""
    df = table(spark, d, "digest_papers").withColumn("c", F.round(S.known(F.col("sonnet_combined")), 4))
    top = df.orderBy(F.desc_nulls_last("c"), F.desc_nulls_last("added_date"), "id").limit(200)
    return top.select("id", F.col("c").alias("combined"), F.date_format("added_date", "yyyy-MM-dd").alias("added"))


def keyword_order(spark: SparkSession, d: str) -> DataFrame:
    """Keyword section of the latest run: high, medium, low, then newest first."""
    df = table(spark, d, "digest_papers").where(X.blank_to_null("batch").isNotNull())
    last = df.agg(F.max("batch").alias("batch"))
    rank = F.when(F.col("relevance") == "high", 0).when(F.col("relevance") == "medium", 1).otherwise(2)
    rows = df.join(F.broadcast(last), "batch").select("id", rank.alias("rank"), F.date_format("pub_date", "yyyy-MM-dd").alias("day"))
    sizes = rows.groupBy("rank", "day").agg(F.count("*").alias("n"))
    w = Window.orderBy("rank", F.desc_nulls_last("day")).rowsBetween(Window.unboundedPreceding, -1)  # one row a label and day
    starts = sizes.select(F.col("rank").alias("r"), F.col("day").alias("dd"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("start"))
    own = rows.withColumn("own", F.row_number().over(Window.partitionBy("rank", "day").orderBy("id")))
    return own.join(starts, (F.col("rank") == F.col("r")) & F.col("day").eqNullSafe(F.col("dd"))).select("id", "rank", "day", (F.col("start") + F.col("own")).cast("int").alias("place"))


def batches(spark: SparkSession, d: str) -> DataFrame:
    """Runs: rows, wildcards, relevance labels; rows without a run are 'legacy'."""
    df = table(spark, d, "digest_papers").groupBy(F.coalesce(X.blank_to_null("batch"), F.lit("legacy")).alias("batch"))
    return df.agg(
        F.count("*").alias("n"), F.count_if("is_wildcard").alias("wildcards"), F.count_if(F.col("relevance") == "high").alias("high"), F.count_if(F.col("relevance") == "medium").alias("medium"), F.count_if(F.col("relevance") == "low").alias("low")
    )


def week_batches(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "digest_papers").where(F.col("pub_date").isNotNull())
    return df.groupBy(X.iso_week("pub_date").alias("week")).agg(F.count("*").alias("n"))


def tag_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "digest_papers").select(F.explode("tags").alias("tag")).where("tag is not null and tag <> ''")
    return t.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(200)


def tag_filter(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "digest_papers").where(F.array_contains("tags", "trial") & (F.col("batch").isNull() | ~F.col("batch").isin("2021-06-14")))
    return df.select("id", F.array_size("tags").cast("long").alias("n_tags"))


def journal_year_pivot(spark: SparkSession, d: str) -> DataFrame:
    years = [2018, 2020, 2022, 2024]
    df = table(spark, d, "digest_papers").where(F.col("journal").isNotNull())
    return df.withColumn("year", F.year("pub_date")).groupBy("journal").pivot("year", years).count().na.fill(0).toDF("journal", *(f"y{y}" for y in years))


def latest_update(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "digest_papers").groupBy("source")
    return df.agg(F.date_format(F.max("added_date"), "yyyy-MM-dd HH:mm:ss").alias("latest"), F.count("*").alias("n"))


def batch_prompt(spark: SparkSession, d: str) -> DataFrame:
    """One request text per 15 rows of a run: numbered entries, abstracts cut at 800 characters."""
    df = table(spark, d, "digest_papers").where(X.blank_to_null("batch").isNotNull()).select("batch", "id", "title", "abstract")
    df = M.place_in_group(df, "batch", "id").withColumnRenamed("place", "r")
    entry = F.concat(F.lit("["), (F.col("r") % 15 + 1).cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"), F.substring(F.coalesce("abstract", F.lit("")), 1, 800))
    g = df.withColumn("slice", F.floor(F.col("r") / 15)).groupBy("batch", "slice").agg(F.array_sort(F.collect_list(F.struct("id", entry.alias("e")))).alias("es"))
    text = F.array_join(F.transform("es", lambda x: x["e"]), "\n\n---\n\n")
    return g.select("batch", "slice", F.sha2(text, 256).alias("sha"), F.length(text).cast("long").alias("n_chars"))


def versioned_dedup(spark: SparkSession, d: str) -> DataFrame:
    return D.latest_version(table(spark, d, "digest_grants"), "grant_id", "fiscal_year", "id", "source")


def grant_fiscal_years(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "digest_grants").where(F.col("award_date").isNotNull())
    return df.groupBy(X.fiscal_year("award_date").alias("fy")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("amount").cast("double")), 2).alias("amount"), F.count_distinct("grant_id").alias("grants"))


def grant_browser(spark: SparkSession, d: str) -> DataFrame:
    """Career and cooperative awards, newest and largest first."""
    m = F.col("mechanism")
    kind = F.when(m.isin("R01", "R21"), m).when(m.startswith("P"), "P").when(m.startswith("K"), "K").when(m.startswith("U"), "U").otherwise("other")
    df = table(spark, d, "digest_grants").select("id", kind.alias("kind"), F.coalesce(F.date_format("award_date", "yyyy-MM-dd"), F.lit("")).alias("awarded"), F.coalesce(F.col("amount").cast("double"), F.lit(0.0)).alias("amount"))
    return df.where("kind <> 'other'").orderBy(F.desc("awarded"), F.desc("amount"), "id").limit(300)


def grant_topics(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "digest_grants").select(F.explode(F.split("source", r",\s*")).alias("topic")).where("topic <> ''")
    return t.groupBy("topic").agg(F.count("*").alias("n"))


def grant_pi_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "digest_grants").where(X.blank_to_null("pi").isNotNull()).select("id", X.display_name("pi").alias("name"))


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """The library after an upsert of the latest digest row of each paper."""
    base = table(spark, d, "papers").select("paper_id", "title", "journal", F.col("relevance"))
    new = table(spark, d, "digest_papers").where(F.col("paper_id") != "pmid_null").groupBy("paper_id").agg(F.max_by(F.struct("journal", "relevance"), "id").alias("r"))
    return K.merge_rows(base, new.select("paper_id", F.col("r.journal").alias("journal"), F.col("r.relevance").alias("relevance")), "paper_id")


def newest_rows(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "content_vectors").withColumn("at", F.try_to_timestamp("embedded_at"))
    return K.newest(df.withColumn("k", F.concat_ws("_", "hash", "seq")), "at", "k", 1000).select("hash", F.col("seq").cast("long").alias("seq"))


QUERIES = {f.__name__: f for f in (
    digest_ranked, keyword_score, keyword_floor, profile_score_top, select_main_wildcard, apply_scores_left, abort_gate, batch_slices, frontend_order, keyword_order, batches, week_batches, tag_vocabulary,
    tag_filter, journal_year_pivot, latest_update, batch_prompt, versioned_dedup, grant_fiscal_years, grant_browser, grant_topics, grant_pi_names, upsert_merge, newest_rows)}

PROFILE = "0.5 * {0}embedding_core{1} + 0.3 * {0}embedding_methods{1} + 0.2 * {0}embedding_adjacent{1}"
ORACLE = {
    "keyword_score": f"select id, round(raw, 2) as keyword_score, {TIER.format('raw')} as keyword_tier, {_matched()} as matched from ({KEYWORD_SQL})",
    "keyword_floor": f"""select id, paper_id, greatest(round(raw, 2), 0.3)::double as score, case when raw >= 0.6 then 'high' else 'medium' end as tier from (
        select *, row_number() over (partition by paper_id order by id) as rn from ({KEYWORD_SQL}) where (source like 'Search%' or is_preprint) and paper_id is not null) where rn = 1""",
    "digest_ranked": f"""with top as (select *, round({PROFILE.format('coalesce(', ', 0.0)')}, 7) as profile from ({KEYWORD_SQL}) where length(title) > 10 order by profile desc, id limit 500),
        s as (select * from top where sonnet_relevance is not null and not isnan(sonnet_relevance)),
        both_ as (select *, 'main' as section from s where sonnet_relevance >= 3.0 union all
          (select *, 'wildcard' from s where sonnet_relevance >= 2.5 and sonnet_relevance < 3.0 and sonnet_surprise >= 7.5 and not isnan(sonnet_surprise) order by sonnet_surprise desc, id limit 10)),
        c as (select *, round(0.7 * sonnet_relevance + 0.3 * coalesce(case when isnan(sonnet_surprise) then null else sonnet_surprise end, 0.0), 4) as combined from both_)
        select id, section, profile, round(raw, 2) as keyword_score, combined, case when combined >= 6.0 then 'high' when combined >= 4.5 then 'medium' else 'low' end as tier from c""",
    "profile_score_top": f"select * from (select id, round({PROFILE.format('', '')}, 7) as profile from digest_papers) where profile is not null and not isnan(profile) order by profile desc, id limit 500",
    "select_main_wildcard": """select id, 'main' as section from digest_papers where sonnet_relevance >= 3.0 and not isnan(sonnet_relevance) union all
        (select id, 'wildcard' from digest_papers where sonnet_relevance >= 2.5 and sonnet_relevance < 3.0 and sonnet_surprise >= 7.5 and not isnan(sonnet_surprise) order by sonnet_surprise desc, id limit 10)""",
    "apply_scores_left": r"""with k as (select *, nullif(regexp_replace(regexp_extract(trim(pmid), '([0-9]+)(?:\.0*)?[^0-9]*$', 1), '^0+', '', 'g'), '') as p from digest_papers),
        s as (select p, max(case when isnan(sonnet_combined) then null else sonnet_combined end) as score from k where p is not null group by p)
        select id, round(score, 4) as score, case when score is null then 'embedding-only' else 'full' end as method from
        (select id, nullif(regexp_replace(regexp_extract(trim(pmid), '([0-9]+)(?:\.0*)?[^0-9]*$', 1), '^0+', '', 'g'), '') as p from papers) left join s using (p)""",
    "abort_gate": r"""select batch, count(*) as total, count(*) filter (scoring_method <> 'full') as failed, count(*) filter (scoring_method <> 'full') * 100.0 / count(*) > 10.0 as abort
        from digest_papers where regexp_matches(batch, '\S') group by batch""",
    "batch_slices": r"""select batch, slice, count(*) as n, min(id) as first, max(id) as last from (select batch, id, ((row_number() over (partition by batch order by id) - 1) // 15)::bigint as slice
        from digest_papers where regexp_matches(batch, '\S')) group by batch, slice""",
    "frontend_order": """select id, c as combined, strftime(added_date, '%Y-%m-%d') as added from (select *, round(case when isnan(sonnet_combined) then null else sonnet_combined end, 4) as c from digest_papers)
        order by c desc nulls last, added_date desc nulls last, id limit 200""",
    "keyword_order": r"""with r as (select id, (case relevance when 'high' then 0 when 'medium' then 1 else 2 end)::int as rank, strftime(pub_date, '%Y-%m-%d') as day from digest_papers
        where batch = (select max(batch) from digest_papers where regexp_matches(batch, '\S'))) select *, row_number() over (order by rank, day desc nulls last, id)::int as place from r""",
    "batches": r"""select case when regexp_matches(batch, '\S') then batch else 'legacy' end as batch, count(*) as n, count(*) filter (is_wildcard) as wildcards, count(*) filter (relevance = 'high') as high,
        count(*) filter (relevance = 'medium') as medium, count(*) filter (relevance = 'low') as low from digest_papers group by 1""",
    "week_batches": "select printf('%04d-W%02d', isoyear(pub_date), week(pub_date)) as week, count(*) as n from digest_papers where pub_date is not null group by 1",
    "tag_vocabulary": "select tag, count(*) as n from (select unnest(tags) as tag from digest_papers) where tag is not null and tag <> '' group by tag order by n desc, tag limit 200",
    "tag_filter": "select id, len(tags) as n_tags from digest_papers where list_contains(tags, 'trial') and (batch is null or batch <> '2021-06-14')",
    "journal_year_pivot": "select journal, " + ", ".join(f"count(*) filter (year(pub_date) = {y}) as y{y}" for y in (2018, 2020, 2022, 2024)) + " from digest_papers where journal is not null group by journal",
    "latest_update": "select source, strftime(max(added_date), '%Y-%m-%d %H:%M:%S') as latest, count(*) as n from digest_papers group by source",
    "batch_prompt": r"""with r as (select *, row_number() over (partition by batch order by id) - 1 as r from digest_papers where regexp_matches(batch, '\S')),
        t as (select batch, (r // 15)::bigint as slice, string_agg('[' || (r % 15 + 1) || '] ' || coalesce(title, '') || chr(10) || substr(coalesce(abstract, ''), 1, 800), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by id) as t from r group by 1, 2)
        select batch, slice, sha256(t) as sha, length(t) as n_chars from t""",
    "versioned_dedup": """select grant_id, (max(row(fiscal_year, id)))[1] as fiscal_year, (max(row(fiscal_year, id)))[2] as id, coalesce(string_agg(distinct source, '; ' order by source), '') as labels, count(*) as n
        from digest_grants where grant_id is not null group by grant_id""",
    "grant_fiscal_years": """select (year(award_date) + case when month(award_date) >= 10 then 1 else 0 end)::int as fy, count(*) as n, round(sum(amount::double), 2) as amount, count(distinct grant_id) as grants
        from digest_grants where award_date is not null group by 1""",
    "grant_browser": """select * from (select id, case when mechanism in ('R01', 'R21') then mechanism when mechanism like 'P%' then 'P' when mechanism like 'K%' then 'K' when mechanism like 'U%' then 'U' else 'other' end as kind,
        coalesce(strftime(award_date, '%Y-%m-%d'), '') as awarded, coalesce(amount::double, 0.0) as amount from digest_grants) where kind <> 'other' order by awarded desc, amount desc, id limit 300""",
    "grant_topics": r"select topic, count(*) as n from (select unnest(regexp_split_to_array(source, ',\s*')) as topic from digest_grants) where topic <> '' group by topic",
    "grant_pi_names": r"""select id, array_to_string(list_transform(string_split(lower(regexp_replace(n, '\s+', ' ', 'g')), ' '), lambda w: array_to_string(list_transform(string_split(w, '-'), lambda x: upper(x[1:1]) || x[2:]), '-')), ' ') as name
        from (select id, case when contains(pi, ',') then concat_ws(' ', trim(substr(pi, position(',' in pi) + 1)), trim(split_part(pi, ',', 1))) else trim(pi) end as n from digest_grants where regexp_matches(pi, '\S'))""",
    "newest_rows": "select hash, seq::bigint as seq from (select *, try_cast(embedded_at as timestamp) as t from content_vectors) order by t desc nulls last, hash || '_' || seq limit 1000",
    "upsert_merge": """with n as (select paper_id, arg_max(row(journal, relevance), id) as r from digest_papers where paper_id <> 'pmid_null' group by paper_id)
        select coalesce(p.paper_id, n.paper_id) as paper_id, p.title, coalesce(n.r[1], p.journal) as journal, coalesce(n.r[2], p.relevance) as relevance from papers p full outer join n on p.paper_id = n.paper_id""",
}
