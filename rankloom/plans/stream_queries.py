"""Queries on the event log: batch figures, and the same from a stream that is drained."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.session import table
from rankloom.streaming import events as E


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")


def _twice(e: DataFrame) -> DataFrame:
    """Every third event delivered again."""
    return e.unionByName(e.where(F.col("event_id") % 3 == 0))


def event_latest(spark: SparkSession, folder: str) -> DataFrame:
    """STM-4: the last event of each user and type."""
    return E.latest(_events(spark, folder), ["user_id", "event_type"]).select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


def replay_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """STM-3: events without repeated deliveries, counted by type."""
    return E.deduplicated(_twice(_events(spark, folder)), ["event_id"]).groupBy("event_type").agg(F.count("*").alias("n"))


def running_progress(spark: SparkSession, folder: str) -> DataFrame:
    """STM-5, MTH-8: figures by type, with the running mean."""
    return E.progress(_events(spark, folder), "event_type")


def hourly_windows(spark: SparkSession, folder: str) -> DataFrame:
    """STM-5: events by type in windows of six hours."""
    return E.windowed(_events(spark, folder), "6 hours", "event_type").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


def session_ttl(spark: SparkSession, folder: str) -> DataFrame:
    """STM-6: sessions that end after 60 minutes without an event."""
    s = E.sessions(_events(spark, folder))
    return s.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"), "n")


def capacity_eviction(spark: SparkSession, folder: str) -> DataFrame:
    """STM-7: users read as sessions; those beyond 25, longest untouched first, that don't run."""
    live = _events(spark, folder).groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("touched")).withColumn("running", F.col("id") % 10 == 0)
    return E.evicted(live)


def log_tail(spark: SparkSession, folder: str) -> DataFrame:
    """STM-1: the newest 1 200 events of the log."""
    return E.retained(_events(spark, folder)).select("event_id", "event_type")


def quota_windows(spark: SparkSession, folder: str) -> DataFrame:
    """STM-8: uses of each user within a quota of three in 24 hours from first use; errors give one back."""
    e = _events(spark, folder).select("event_id", F.col("user_id").cast("string").alias("key"), "ts", (F.col("event_type") == "error").alias("refund"))
    return E.quota(e, 3).select("event_id", "used", "allowed")


def stream_progress(spark: SparkSession, folder: str) -> DataFrame:
    """STM-1, STM-5: the log read as a stream from its start, figures by type when it is drained."""
    return E.drained(E.progress(E.source(spark, f"{folder}/events.parquet"), "event_type"), "complete")


def stream_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """STM-3: the log as a stream without repeated events, counted."""
    return E.drained(E.deduplicated(E.source(spark, f"{folder}/events.parquet"), ["event_id"]).select("event_id", "event_type")).groupBy("event_type").agg(F.count("*").alias("n"))


def stream_quota(spark: SparkSession, folder: str) -> DataFrame:
    """STM-8: the quota kept as the state of a stream."""
    e = E.source(spark, f"{folder}/events.parquet").select("event_id", F.col("user_id").cast("string").alias("key"), "ts", (F.col("event_type") == "error").alias("refund"))
    return E.drained(E.quota_stream(e, 3)).select("event_id", "used", "allowed")


QUERIES = {f.__name__: f for f in (event_latest, replay_dedupe, running_progress, hourly_windows, session_ttl, capacity_eviction, log_tail, quota_windows, stream_progress, stream_dedupe, stream_quota)}

_PROGRESS = "select event_type, count(*) as n, round(sum(value), 6) as total, round(avg(value), 6) as mean from events group by 1"
_DEDUPED = "select event_type, count(distinct event_id) as n from events group by 1"
_QUOTA = """with recursive e as (select event_id, user_id as key, epoch_ms(ts) as ms, event_type = 'error' as refund, row_number() over (partition by user_id order by ts, event_id) as rn from events),
    r as (select event_id, key, rn, ms as started, if(refund, 0, 1) as used, true as allowed from e where rn = 1 union all
    select event_id, key, rn, if(over, ms, started), case when refund then greatest(0, c - 1) when c >= 3 then c else c + 1 end, refund or c < 3 from (select e.*, r.started, e.ms - r.started >= 86400000 as over, if(e.ms - r.started >= 86400000, 0, r.used) as c from r join e on e.key = r.key and e.rn = r.rn + 1))
    select event_id, used::int as used, allowed from r"""
SQL = {
    "quota_windows": _QUOTA,
    "stream_quota": _QUOTA,
    "event_latest": "select user_id, event_type, event_id, round(value, 6) as value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1",
    "replay_dedupe": _DEDUPED,
    "running_progress": _PROGRESS,
    "hourly_windows": "select strftime(time_bucket(interval '6 hours', ts, timestamp '1970-01-01'), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2",
    "session_ttl": """with g as (select *, sum(new::int) over (partition by user_id order by ts, event_id) as s from (select *, coalesce(ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval '60 minutes', true) as new from events))
        select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, strftime(max(ts) + interval '60 minutes', '%Y-%m-%d %H:%M:%S') as "end", count(*) as n from g group by user_id, s""",
    "capacity_eviction": "select id, touched, running from (select user_id as id, max(event_id) as touched, user_id % 10 = 0 as running from events group by 1) qualify row_number() over (order by running desc, touched desc, id) > 25 and not running",
    "log_tail": "select event_id, event_type from events order by event_id desc limit 1200",
    "stream_progress": _PROGRESS,
    "stream_dedupe": _DEDUPED,
}
