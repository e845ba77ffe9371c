"""Streaming forms and event windows (the windows are an extension)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table
from ..streaming import incremental as I


def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """First row of every DOI, kept over micro-batches."""
    s = I.stream_table(spark, d, "digest_papers").select("doi", "id")
    return I.first_seen(s, "doi", "id", f"seen-{uuid.uuid4().hex}")


def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Latest fiscal year and title length of every grant, merged per micro-batch."""
    s = I.stream_table(spark, d, "digest_grants").select("grant_id", F.struct("fiscal_year", "id").alias("v"), F.length("title").alias("n"))
    out = I.merged_stream(s.withColumn("o", F.col("v.fiscal_year").cast("long") * 10_000_000_000 + F.col("v.id")).drop("v"), "grant_id", ["n"], "o", f"grants-{uuid.uuid4().hex}")
    return out.select("grant_id", "n", (F.floor(F.col("o") / 10_000_000_000)).cast("int").alias("fiscal_year"))


def stream_event_days(spark: SparkSession, d: str) -> DataFrame:
    s = I.stream_table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    out = I.windowed_counts(s, "ts", "event_type", "value", f"days-{uuid.uuid4().hex}")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def event_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Sliding windows of six hours every three hours."""
    e = table(spark, d, "events").groupBy(F.window("ts", "6 hours", "3 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user, apart by more than four hours."""
    e = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "4 hours").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def event_weeks(spark: SparkSession, d: str) -> DataFrame:
    """Per ISO week and type: events, users, mean of the JSON field k."""
    k = F.get_json_object("props", "$.k").cast("double")
    g = table(spark, d, "events").groupBy(F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), F.col("ts")).cast("int"), F.weekofyear("ts")).alias("week"), "event_type")
    return g.agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.avg(k), 6).alias("mean_k"))


def runner_up_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Best and second value of each user, and the gap between them."""
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    e = table(spark, d, "events").where("value is not null").select("user_id", "event_id", "value", F.row_number().over(w).alias("r"), F.lead("value").over(w).alias("next"))
    return e.where("r = 1").select("user_id", "event_id", "value", F.round(F.col("value") - F.col("next"), 6).alias("gap"))


QUERIES = {f.__name__: f for f in (stream_first_seen, stream_upsert, stream_event_days, event_sliding, event_sessions, event_weeks, runner_up_gaps)}
ORACLE = {
    "stream_first_seen": "select doi, min(id) as id from digest_papers where doi is not null group by doi",
    "stream_upsert": "select grant_id, length(arg_max(title, fiscal_year * 10000000000 + id))::int as n, max(fiscal_year) as fiscal_year from digest_grants where grant_id is not null and title is not null group by grant_id",
    "stream_event_days": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "event_sliding": """select strftime(time_bucket(interval 3 hours, ts) - to_hours(3 * k), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n from events, (values (0), (1)) t(k) group by 1, 2""",
    "event_sessions": """with a as (select *, case when ts > lag(ts) over (partition by user_id order by ts) + interval 4 hours or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as f from events),
        b as (select *, sum(f) over (partition by user_id order by ts rows unbounded preceding) as s from a) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from b group by user_id, s""",
    "event_weeks": """select printf('%04d-W%02d', isoyear(ts), week(ts)) as week, event_type, count(*) as n, count(distinct user_id) as users, round(avg(json_extract_string(props, '$.k')::double), 6) as mean_k from events group by 1, 2""",
    "runner_up_gaps": """select user_id, event_id, value, round(value - n, 6) as gap from (select *, row_number() over (partition by user_id order by value desc, event_id) as r, lead(value) over (partition by user_id order by value desc, event_id) as n
        from events where value is not null) where r = 1""",
}
