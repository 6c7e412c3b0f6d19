"""Queries: the streaming twins, run over all that is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestar.operators.graph import shared_folder
from lodestar.operators.windows import seconds
from lodestar.streaming import operators as R

from .registry import query
from .views import oracle
from .windows import breaker_sql


def _events(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    out = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")  # a file or a folder of files
    return out.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(df, mode: str = "append"):
    return R.run(df, f"{shared_folder(df.sparkSession)}/lodestar-stream-{uuid.uuid4().hex}", mode)


@query("stream_counts", oracle("select event_type, to_timestamp(floor(epoch(ts) / 86400) * 86400)::timestamp as start, count(*) as n from events group by all"))
def _(spark, d):
    return _run(R.counts(_events(spark, d), "1 day", "7 days", "event_type"), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_error_ratio", oracle("select to_timestamp(floor(epoch(ts) / 86400) * 86400)::timestamp as start, count(*) as n, round(avg((event_type = 'error')::int), 6) as error_ratio from events group by 1"))
def _(spark, d):
    out = _run(R.error_ratio(_events(spark, d).withColumn("ok", F.col("event_type") != "error"), "1 day", "7 days"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("error_ratio", 6).alias("error_ratio"))


@query("stream_over_limit", oracle("select user_id, to_timestamp(floor(epoch(ts) / 86400) * 86400)::timestamp as start, count(*) as n, count(*) - 2 as rejected from events group by all having count(*) > 2"))
def _(spark, d):
    return _run(R.over_limit(_events(spark, d), "1 day", 2, "user_id", "7 days"), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_first_seen", oracle("select distinct user_id, event_type from events"))
def _(spark, d):
    return _run(R.first_of(_events(spark, d).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "365 days")).select("user_id", "event_type")


@query("stream_breaker", breaker_sql("t, ok"))
def _(spark, d):
    e = _events(spark, d).select(F.col("user_id").alias("service"), seconds().cast("double").alias("t"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))
    return _run(R.circuit_breaker(e, "service", 2, 1, 43200.0))


@query("stream_sessions", oracle("""with e as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 2 hour or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as new from events),
g as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from e), f as (select user_id, min(ts) as start, max(ts) + interval 2 hour as fires_at, count(*) as events from g group by user_id, s)
select user_id, start, fires_at, events from f"""))
def _(spark, d):
    out = _run(R.sessions(_events(spark, d), "2 hours", "user_id", "7 days"), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("fires_at").cast("timestamp_ntz").alias("fires_at"), "events")


@query("stream_new_commits", oracle("select distinct 'u' || user_id || '-' || (event_id % 50) as commit_hash from events"))
def _(spark, d):
    commit = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), (F.col("event_id") % 50).cast("string"))
    return _run(R.new_commits(_events(spark, d).select(commit.alias("commit_hash"), "ts"), "365 days")).select("commit_hash")


@query("stream_health", oracle("select user_id as service, to_timestamp(floor(epoch(ts) / 3600) * 3600)::timestamp as start, count(*) as checks, round(avg((event_type <> 'error')::int), 6) as healthy, round(max(value * 100), 6) as latency from events group by 1, 2"))
def _(spark, d):
    rows = _events(spark, d).select(F.col("user_id").alias("service"), "ts", (F.col("event_type") != "error").alias("ok"), (F.col("value") * 100).alias("latency"))
    out = _run(R.health_samples(rows, "1 hour", "7 days"), "complete")
    return out.select("service", F.col("start").cast("timestamp_ntz").alias("start"), "checks", F.round("healthy", 6).alias("healthy"), F.round("latency", 6).alias("latency"))
