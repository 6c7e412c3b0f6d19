"""Time windows: sessions, limits, rates, quantiles and alerts over events (key, ts, seq)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans
from .graph import cut


def seconds(column: str = "ts") -> Column:
    return F.unix_seconds(F.col(column).cast("timestamp"))


def sessions(events: DataFrame, gap: str, key: str, ts: str = "ts") -> DataFrame:
    """Bursts: an event restarts the timer, and a burst ends when it stays quiet for the gap."""
    w = F.session_window(F.col(ts), gap)
    return events.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("fires_at"), "events")


def bucket(width: int, ts: str = "ts") -> Column:
    """The start of a fixed window, in seconds."""
    return F.floor(seconds(ts) / width) * width


def rate_limited(events: DataFrame, key: str, limit: int, width: int, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """events with their window, place in it, and whether they are within the limit."""
    out = events.withColumn("window", bucket(width))
    place = F.row_number().over(Window.partitionBy(key, "window").orderBy(*order))
    return out.withColumn("place", place).withColumn("allowed", F.col("place") <= limit)


def error_ratio(events: DataFrame, width: int, failed: Column, by: Sequence[str] = ()) -> DataFrame:
    return events.withColumn("window", bucket(width)).groupBy(*by, "window").agg(F.count(F.lit(1)).alias("n"), F.avg(failed.cast("double")).alias("error_ratio"))


def histogram_quantile(rows: DataFrame, value: str, bounds: Sequence[float], q: float, by: Sequence[str]) -> DataFrame:
    """The q-quantile by linear interpolation in cumulative buckets; beyond the last bound, that bound."""
    wide = rows.groupBy(*by).agg(F.array(*[F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).cast("double") for b in bounds]).alias("c"), F.count(value).cast("double").alias("n"))
    les = F.array(*[F.lit(float(b)) for b in bounds])
    rank = F.col("n") * q
    at = F.size(F.filter("c", lambda x: x < rank))
    lo_c = F.when(at == 0, 0.0).otherwise(F.get("c", at - 1))
    lo_b = F.when(at == 0, 0.0).otherwise(F.get(les, at - 1))
    inside = lo_b + (F.get(les, at) - lo_b) * (rank - lo_c) / (F.get("c", at) - lo_c)
    return wide.where("n > 0").select(*by, F.when(at >= len(bounds), F.lit(float(bounds[-1]))).otherwise(inside).alias("quantile"))


def latency_spikes(rows: DataFrame, value: str, bounds: Sequence[float], short: int, long: int, times: float, by: Sequence[str] = ()) -> DataFrame:
    """Short windows whose p95 is more than `times` that of the long window they lie in."""
    a = histogram_quantile(rows.withColumn("window", bucket(short)), value, bounds, 0.95, [*by, "window"]).withColumn("outer", F.floor(F.col("window") / long) * long)
    b = histogram_quantile(rows.withColumn("outer", bucket(long)), value, bounds, 0.95, [*by, "outer"]).withColumnRenamed("quantile", "baseline")
    return a.join(b, [*by, "outer"]).where(F.col("quantile") > times * F.col("baseline")).select(*by, "window", "quantile", "baseline")


def islands(rows: DataFrame, condition: Column, key: str, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Runs of rows on which the condition holds: key, start, end, rows. A key's rows are spread over tasks, see scans."""
    marked = scans.running_sum(rows.withColumn("_ok", condition), F.when(F.col("_ok"), 0).otherwise(1), key, order, "_run")
    return marked.where("_ok").groupBy(key, "_run").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("rows")).drop("_run")


def firing(rows: DataFrame, condition: Column, key: str, hold: int, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Runs that last `hold` seconds or more, and when they begin to fire."""
    runs = islands(rows, condition, key, order).where(seconds("end") - seconds("start") >= hold)
    return runs.withColumn("fires_at", seconds("start") + hold)


def run_lengths(rows: DataFrame, failed: Column, key: str, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """rows with the number of failures in a row up to each (0 on success)."""
    return scans.run_length(rows, failed, key, order, "consecutive")


def count_over(rows: DataFrame, condition: Column, key: str, width: int) -> DataFrame:
    """rows with how many rows of the last `width` seconds, this one included, meet the condition."""
    timed = rows.withColumn("_s", seconds())
    each = timed.groupBy(F.col(key).alias("_k"), F.col("_s").alias("_at")).agg(F.sum(condition.cast("int")).alias("_n"))
    total = cut(scans.running_sum(each, F.coalesce("_n", F.lit(0)), "_k", ["_at"], "_sum").select("_k", "_at", "_sum"))
    # What the sum was right before the window: the last one known there, found among both kinds of rows in one order.
    asked = total.select("_k", (F.col("_at") - width).alias("_at"), F.lit(None).cast("long").alias("_sum"), F.col("_at").alias("_for"))
    both = total.withColumn("_for", F.lit(None).cast("long")).unionByName(asked).withColumn("_old", F.col("_for").isNull().cast("int"))
    old = scans.last_known(both, "_sum", "_k", ["_at", "_old"], "_was").where("_for is not null").select(F.col("_k").alias("_k2"), "_for", "_was")
    found = total.join(old, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_at") == F.col("_for"))).select("_k", "_at", (F.col("_sum") - F.coalesce("_was", F.lit(0))).alias("count"))
    return timed.join(found, F.col(key).eqNullSafe(F.col("_k")) & F.col("_s").eqNullSafe(F.col("_at"))).drop("_s", "_k", "_at")


def increase(rows: DataFrame, value: str, key: str, width: int, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Per window, how much a counter rose, a fall counting as a restart from zero."""
    before = F.col("_before")
    delta = F.when(before.isNull(), 0.0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    return scans.previous(rows, value, key, order, "_before").withColumn("_d", delta).withColumn("window", bucket(width)).groupBy(key, "window").agg(F.sum("_d").alias("increase"))


def severity(status: str = "status", failures: str = "consecutive") -> Column:
    bad = F.col(status) == "unhealthy"
    return F.when(bad & (F.col(failures) >= 5), "critical").when(bad | (F.col(failures) >= 3), "warning").otherwise("info")


def sliding(events: DataFrame, width: str, step: str, by: Sequence[str] = ()) -> DataFrame:
    w = F.window("ts", width, step)
    return events.groupBy(*by, w.alias("w")).agg(F.count(F.lit(1)).alias("events"), F.approx_count_distinct("key").alias("keys")).select(*by, F.col("w.start").alias("start"), "events", "keys")


def duplicates(messages: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """The first message of each key, by a partial aggregate, so a key with many messages is no hot task; messages without a
    key are never duplicates."""
    out = messages.withColumn("_k", key)
    first = F.min_by(F.struct(*messages.columns), F.struct(*order)).alias("_first")
    kept = out.where("_k is not null").groupBy("_k").agg(first).select("_first.*")
    return kept.unionByName(out.where("_k is null").drop("_k"))


def as_of_join(events: DataFrame, versions: DataFrame, key: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """events with the value of the last version at or before them: one sort of both, no pairs."""
    both = events.withColumn("_v", F.lit(None).cast(versions.schema[value].dataType)).withColumn("_e", F.lit(1))
    old = versions.select(key, ts, *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns if c not in (key, ts)], F.col(value).alias("_v"), F.lit(0).alias("_e"))
    filled = scans.last_known(both.unionByName(old), "_v", key, [ts, "_e"], "as_of_value")
    return filled.where("_e = 1").drop("_v", "_e")


#: Failures in a row and milliseconds from which a service is alerted, and failures beyond that for recovery.
ALERT_FAILURES, ALERT_LATENCY, RECOVERY_FAILURES = 3, 5000.0, 2


def alert_required(failures: str = "consecutive", latency: str = "latency", most: int = ALERT_FAILURES, slow: float = ALERT_LATENCY) -> Column:
    return (F.col(failures) >= most) | F.coalesce(F.col(latency) >= slow, F.lit(False))


def recovery_required(failures: str = "consecutive", most: int = ALERT_FAILURES, beyond: int = RECOVERY_FAILURES) -> Column:
    return F.col(failures) >= most + beyond


def rates(rows: DataFrame, value: str, key: str, width: int) -> DataFrame:
    """key, window, rate: how much a counter rose a second in each window, a fall counting as a restart."""
    return increase(rows, value, key, width).select(key, "window", (F.col("increase") / width).alias("rate"))


def over_threshold(series: DataFrame, value: str, most: float, width: int, hold: int, by: Sequence[str] = ()) -> DataFrame:
    """Runs of windows (one row each of by and window) in which the value is over a threshold, that last `hold` seconds or more: start, end."""
    bad = series.where(F.col(value) > most)
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("window")
    runs = bad.withColumn("_g", F.col("window") - F.row_number().over(w) * width)
    spans = runs.groupBy(*by, "_g").agg(F.min("window").alias("start"), (F.max("window") + width).alias("end"))
    return spans.where(F.col("end") - F.col("start") >= hold).drop("_g")


def series(rows: DataFrame, value: str, label: str, bounds: Sequence[float], width: int, quantiles: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """label, window, rate and a column for each quantile (q50, q95): what a dashboard shows of labelled events."""
    timed = rows.withColumn("window", bucket(width))
    out = timed.groupBy(label, "window").agg((F.count(F.lit(1)) / width).alias("rate"))
    for q in quantiles:
        part = histogram_quantile(timed, value, bounds, q, [label, "window"]).withColumnRenamed("quantile", f"q{round(q * 100)}")
        out = out.join(part, [label, "window"], "left")
    return out


def head_changes(polls: DataFrame, key: str = "project", head: str = "head", order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """The polls at which a project's head differs from the poll before, with that one; the first poll is none."""
    return scans.previous(polls, head, key, order, "before").where(F.col("before").isNotNull() & (F.col("before") != F.col(head)))
