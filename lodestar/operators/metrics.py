"""Query metrics, feedback statistics and tuning rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import latest, with_totals

#: A confident answer that was not useful, and an unsure one that was.
HIGH, LOW = 70.0, 50.0


def window(metrics: DataFrame, as_of, hours: int, project: str | None = None, feedback: bool | None = None) -> DataFrame:
    """Metrics of the last hours, of one project, with or without feedback."""
    out = metrics.where((F.col("ts") >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))) & (F.col("ts") <= F.lit(as_of).cast("timestamp_ntz")))
    if project is not None:
        out = out.where(F.col("project") == project)
    if feedback is not None:
        out = out.where(F.col("feedback").isNotNull() if feedback else F.col("feedback").isNull())
    return out


def _is(value: str):
    return F.col("feedback") == value


def feedback_stats(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    return metrics.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count("feedback").alias("rated"),
        count(_is("useful"))("useful"),
        count(_is("not_useful"))("not_useful"),
        count(_is("partial"))("partial"),
        F.avg("confidence").alias("avg_confidence"),
        F.avg(F.when(_is("useful"), F.col("confidence"))).alias("avg_useful"),
        F.avg(F.when(_is("not_useful"), F.col("confidence"))).alias("avg_not_useful"),
        F.avg("ms").alias("avg_ms"),
    )


def confidence_stats(metrics: DataFrame) -> DataFrame:
    return metrics.where("feedback is not null").groupBy("feedback").agg(F.avg("confidence").alias("mean"), F.median("confidence").alias("median"), F.count(F.lit(1)).alias("n"))


def error_rates(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """False positives (confident, not useful) and false negatives (unsure, useful) over all rated ones."""
    rated = metrics.where("feedback is not null")
    fp, fn = _is("not_useful") & (F.col("confidence") >= HIGH), _is("useful") & (F.col("confidence") < LOW)
    rate = lambda c: F.sum(F.when(c, 1).otherwise(0)) / F.count(F.lit(1))
    return rated.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), rate(fp).alias("false_positive_rate"), rate(fn).alias("false_negative_rate"))


def correlation(metrics: DataFrame, x: str = "confidence", by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation with feedback as 1, 0.5, 0; 0 where it is not defined."""
    y = F.when(_is("useful"), 1.0).when(_is("partial"), 0.5).when(_is("not_useful"), 0.0)
    r = F.corr(x, y)
    return metrics.where("feedback is not null").groupBy(*by).agg(F.coalesce(F.when(F.isnan(r), 0.0).otherwise(r), F.lit(0.0)).alias("correlation"))


FACTORS = ("confidence", "structural", "citations")


def factors(metrics: DataFrame) -> DataFrame:
    """The three factors of a score: confidence over 100, whether the graph matched, citations (full at three)."""
    return metrics.select(
        "query_id", "project", "feedback", (F.col("confidence") / 100).alias("confidence"), F.when(F.col("results") > 0, 1.0).otherwise(0.0).alias("structural"), F.least(F.col("evidence_count") / 3, F.lit(1.0)).alias("citations")
    )


def factor_contrast(rows: DataFrame, names: Sequence[str] = FACTORS) -> DataFrame:
    """For each factor its mean when useful and when not, and their clipped difference over the larger."""
    long = rows.where("feedback in ('useful', 'not_useful')").select("feedback", F.explode(F.array(*[F.struct(F.lit(n).alias("factor"), F.col(n).alias("value")) for n in names])).alias("f")).select("feedback", "f.*")
    means = long.groupBy("factor").agg(F.coalesce(F.avg(F.when(_is("useful"), F.col("value"))), F.lit(0.0)).alias("useful_mean"), F.coalesce(F.avg(F.when(_is("not_useful"), F.col("value"))), F.lit(0.0)).alias("other_mean"))
    raw = (F.col("useful_mean") - F.col("other_mean")) / F.greatest("useful_mean", "other_mean", F.lit(0.01))
    return means.withColumn("correlation", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))).withColumn("adjustment", F.col("correlation") * 0.1)


def weights(rows: DataFrame, current: dict[str, float], least: int = 10) -> DataFrame:
    """New weights: the current ones plus their adjustments, within 0.05 and 0.9, scaled to sum up to 1; unchanged with too few samples.

    auto_apply if the mean strength of the contrasts times the samples (full at 100) is over 0.8.
    """
    counts = rows.agg(F.count(F.when(_is("useful"), 1)).alias("useful"), F.count(F.when(_is("not_useful"), 1)).alias("not_useful"))
    now = F.element_at(F.create_map(*[F.lit(x) for kv in current.items() for x in kv]), F.col("factor"))
    raw = factor_contrast(rows, tuple(current)).withColumn("current", now).withColumn("bounded", F.greatest(F.lit(0.05), F.least(F.lit(0.9), F.col("current") + F.col("adjustment"))))
    sums = raw.agg(F.sum("bounded").alias("_sum"), F.avg(F.abs("correlation")).alias("_strength"))
    out = with_totals(with_totals(raw, sums), counts)
    enough = (F.col("useful") >= least) & (F.col("not_useful") >= least)
    sure = F.when(enough, F.col("_strength") * F.least((F.col("useful") + F.col("not_useful")) / 100, F.lit(1.0))).otherwise(0.0)
    return out.select("factor", F.when(enough, F.col("bounded") / F.col("_sum")).otherwise(F.col("current")).alias("weight"), sure.alias("confidence"), (sure > 0.8).alias("auto_apply"))


def penalty_deltas(rates: DataFrame, strength: float = 0.1) -> DataFrame:
    """Changes of penalties for error rates; where both rates are high, the rule for false negatives has the last word."""
    fp, fn = F.col("false_positive_rate"), F.col("false_negative_rate")
    up = lambda f, x: F.least(F.lit(5.0), f * x * strength)
    down = lambda f, x: F.greatest(F.lit(-5.0), -f * x * strength)
    return rates.withColumns(
        {
            "staleness_delta": F.when(fn > 0.2, down(fn, 10)).when(fp > 0.2, up(fp, 10)).otherwise(0.0),
            "orphan_delta": F.when(fn > 0.15, down(fn, 8)).when(fp > 0.15, up(fp, 8)).otherwise(0.0),
            "connectivity_delta": F.when(fn > 0.2, up(fn, 5)).otherwise(0.0),
        }
    )


def recommendations(rates: DataFrame) -> DataFrame:
    fp, fn = F.col("false_positive_rate"), F.col("false_negative_rate")
    texts = F.array_compact(
        F.array(
            F.when(fp > 0.2, "Raise penalties: confident answers were often not useful"),
            F.when(fn > 0.2, "Lower penalties: unsure answers were often useful"),
            F.when((fp <= 0.2) & (fn <= 0.2), "Confidence fits the feedback"),
        )
    )
    return rates.withColumn("advice", F.array_join(texts, "; "))


def histogram(rows: DataFrame, value: str, bounds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Cumulative buckets (le, count): one pass with a conditional sum a bound, then unpivoted; le +Inf is the count."""
    sums = [F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"_b{i}") for i, b in enumerate(bounds)]
    wide = rows.groupBy(*by).agg(*sums, F.count(value).alias("_n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("sum"))
    pairs = [F.struct(F.lit(str(b)).alias("le"), F.col(f"_b{i}").alias("count")) for i, b in enumerate(bounds)]
    return wide.select(*by, "sum", F.explode(F.array(*pairs, F.struct(F.lit("+Inf").alias("le"), F.col("_n").alias("count")))).alias("x")).select(*by, "x.le", "x.count", "sum")


def gauges(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last value of each series."""
    return samples.groupBy(*keys).agg(F.max_by("value", F.struct("ts", "seq")).alias("value"))


def running_total(rows: DataFrame, delta: str, key: str, order: Sequence[str]) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("total", F.sum(F.coalesce(F.col(delta), F.lit(0.0))).over(w))


def current_config(configs: DataFrame, projects: DataFrame, names: Sequence[str]) -> DataFrame:
    """The last configuration of each project, with zeros for a project that has none."""
    out = projects.join(latest(configs, ["project"], ["ts"]), "project", "left")
    return out.select("project", *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in names])


def attempts(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Per key: attempts, success rate, and the share of successes whose attempt before had failed."""
    from pyspark.sql import Window

    before = F.lag("ok").over(Window.partitionBy(key).orderBy(*order))
    rows = rows.withColumn("_fell", F.col("ok") & (before == F.lit(False)))
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("attempts"), F.avg(F.col("ok").cast("double")).alias("success_rate"), F.avg(F.coalesce("_fell", F.lit(False)).cast("double")).alias("fallback_rate")
    )


def fit_budget(ranked: DataFrame, cost: str, budget: int, order: Sequence, group: str | None = None) -> DataFrame:
    """Ranked rows whose running cost stays within the budget, per group. Each row costs 1 at least, so without a group
    only the first `budget` rows are looked at, which are found by a distributed sort; there a smaller cost is an error."""
    from pyspark.sql import Window

    if group is None:
        ranked = ranked.withColumn(cost, F.when(F.col(cost) < 1, F.raise_error(F.lit(f"{cost} is less than 1"))).otherwise(F.col(cost)))
        ranked = ranked.orderBy(*order).limit(budget)
    w = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("running", F.sum(cost).over(w)).where(F.col("running") <= budget)


def overall(services: DataFrame) -> DataFrame:
    """Two rules over one row a service (healthy): any unhealthy makes it unhealthy; any healthy makes it degraded at worst."""
    every, some = F.bool_and("healthy"), F.bool_or("healthy")
    return services.agg(
        F.when(every, "healthy").when(F.bool_or(~F.col("healthy")), "unhealthy").otherwise("degraded").alias("strict"), F.when(every, "healthy").when(some, "degraded").otherwise("unhealthy").alias("lenient")
    )


def exposition(services: DataFrame) -> DataFrame:
    """(metric, service, value) of one row a service: status 1, 0.5 or 0, latency where known, failures, breaker state."""
    status = F.when(F.col("status") == "healthy", 1.0).when(F.col("status") == "degraded", 0.5).otherwise(0.0)
    breaker = F.when(F.col("breaker") == "open", 2.0).when(F.col("breaker") == "half_open", 1.0).otherwise(0.0)
    rows = [("health_status", status), ("latency_ms", F.when(F.col("latency") >= 0, F.col("latency"))), ("failures", F.col("failures").cast("double")), ("breaker_state", breaker)]
    out = services.select("service", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in rows])).alias("x")).select("x.metric", "service", "x.value")
    return out.where("value is not null")


def breaker_summary(services: DataFrame) -> DataFrame:
    """One row: how many services there are, and how many breakers are closed, open and half open."""
    count = lambda state: F.count(F.when(F.col("breaker") == state, 1)).alias(state)
    return services.agg(F.count(F.lit(1)).alias("total"), count("closed"), count("open"), count("half_open"))


def tracked(metrics: DataFrame, fresh: DataFrame, feedback: DataFrame, reports: DataFrame) -> DataFrame:
    """metrics after new ones of the same query_id have replaced old ones, with the last feedback (query_id, ts, rating)
    and the report of the query where there is one."""
    new = latest(fresh, ["query_id"], ["ts"])
    rows = metrics.join(new.select("query_id"), "query_id", "left_anti").unionByName(new.select(*metrics.columns))
    said = feedback.groupBy("query_id").agg(F.max_by("rating", F.struct("ts", "rating")).alias("_rating"))
    out = rows.join(said, "query_id", "left").withColumn("feedback", F.coalesce("_rating", "feedback")).drop("_rating")
    return out.join(reports.select("query_id", "report_id"), "query_id", "left")


#: The exported metrics, with the bounds of the histograms.
CATALOGUE = (
    ("query_total", "counter", ()),
    ("query_duration_seconds", "histogram", (0.5, 1, 2, 5, 10, 30, 60)),
    ("query_confidence", "histogram", (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)),
    ("errors_total", "counter", ()),
    ("service_health", "gauge", ()),
    ("breaker_state", "gauge", ()),
)


def exported(rows: DataFrame) -> DataFrame:
    """(metric, label, le, value) of query rows (kind, seconds, confidence, ok): counters by kind, cumulative buckets by kind."""
    out = rows.groupBy(F.col("kind").alias("label")).agg(F.count(F.lit(1)).cast("double").alias("query_total"), F.count(F.when(~F.col("ok"), 1)).cast("double").alias("errors_total"))
    out = out.select("label", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(None).cast("string").alias("le"), F.col(m).alias("value")) for m, kind, _ in CATALOGUE if kind == "counter"])).alias("x")).select("x.metric", "label", "x.le", "x.value")
    for metric, column in (("query_duration_seconds", "seconds"), ("query_confidence", "confidence")):
        bounds = next(b for m, _, b in CATALOGUE if m == metric)
        buckets = [F.count(F.when(F.col(column) <= float(b), 1)).cast("double").alias(f"b{i}") for i, b in enumerate(bounds)]
        wide = rows.groupBy(F.col("kind").alias("label")).agg(*buckets, F.count(F.lit(1)).cast("double").alias("all"))
        each = [F.struct(F.lit(str(float(b))).alias("le"), F.col(f"b{i}").alias("value")) for i, b in enumerate(bounds)]
        long = wide.select("label", F.explode(F.array(*each, F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("value")))).alias("x"))
        out = out.unionByName(long.select(F.lit(metric).alias("metric"), "label", "x.le", "x.value"))
    return out
