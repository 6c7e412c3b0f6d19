"""Queries: metrics, feedback, tuning."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import metrics as M

from .registry import query
from .views import AS_OF, health, metrics, oracle, table

_RATED = "feedback is not null"
_FP = "sum(case when feedback = 'not_useful' and confidence >= 70 then 1 else 0 end) / count(*)"
_FN = "sum(case when feedback = 'useful' and confidence < 50 then 1 else 0 end) / count(*)"
_RATES = f"r as (select project, count(*) as n, {_FP} as fp, {_FN} as fn from metrics where {_RATED} group by project)"
BOUNDS = (10.0, 25.0, 50.0, 75.0, 100.0, 250.0)


def _round(df, *columns, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("feedback_stats", oracle("""select project, count(*) as total, count(feedback) as rated, count(*) filter (feedback = 'useful') as useful, count(*) filter (feedback = 'not_useful') as not_useful, count(*) filter (feedback = 'partial') as partial,
round(avg(confidence), 6) as avg_confidence, round(avg(confidence) filter (feedback = 'useful'), 6) as avg_useful, round(avg(confidence) filter (feedback = 'not_useful'), 6) as avg_not_useful, round(avg(ms), 6) as avg_ms from metrics group by project""", "metrics"))
def _(spark, d):
    return _round(M.feedback_stats(metrics(spark, d), ["project"]), "avg_confidence", "avg_useful", "avg_not_useful", "avg_ms")


@query("metrics_window", oracle("select query_id, project from metrics where ts >= timestamp '2024-02-01' - interval 240 hour and ts <= timestamp '2024-02-01' and project = 'p1' and feedback is not null", "metrics"))
def _(spark, d):
    return M.window(metrics(spark, d), AS_OF, 240, "p1", True).select("query_id", "project")


@query("metrics_summary", oracle("select count(*) as total, count(feedback) as rated, round(avg(confidence), 6) as avg_confidence, round(avg(ms), 6) as avg_ms from metrics where ts >= timestamp '2024-01-25' and ts <= timestamp '2024-02-01'", "metrics"))
def _(spark, d):
    return _round(M.feedback_stats(M.window(metrics(spark, d), AS_OF, 168)), "avg_confidence", "avg_ms").select("total", "rated", "avg_confidence", "avg_ms")


@query("feedback_pending", oracle("select query_id from metrics where feedback is null order by ts, query_id limit 50", "metrics"))
def _(spark, d):
    return metrics(spark, d).where("feedback is null").orderBy("ts", "query_id").limit(50).select("query_id")


@query("confidence_stats", oracle("select feedback, round(avg(confidence), 6) as mean, round(median(confidence), 6) as median, count(*) as n from metrics where feedback is not null group by feedback", "metrics"))
def _(spark, d):
    return _round(M.confidence_stats(metrics(spark, d)), "mean", "median")


@query("fp_fn_rates", oracle(f"with {_RATES} select project, n, round(fp, 6) as false_positive_rate, round(fn, 6) as false_negative_rate from r", "metrics"))
def _(spark, d):
    return _round(M.error_rates(metrics(spark, d), ["project"]), "false_positive_rate", "false_negative_rate")


@query("confidence_correlation", oracle("select project, round(coalesce(corr(confidence, case feedback when 'useful' then 1 when 'partial' then 0.5 else 0 end), 0), 6) as correlation from metrics where feedback is not null group by project", "metrics"))
def _(spark, d):
    return _round(M.correlation(metrics(spark, d), by=["project"]), "correlation")


_FACTORS = """f as (select feedback, confidence / 100 as confidence, case when results > 0 then 1.0 else 0.0 end::double as structural, least(evidence_count / 3, 1.0)::double as citations from metrics where feedback in ('useful', 'not_useful')),
l as (select feedback, 'confidence' as factor, confidence as v from f union all select feedback, 'structural', structural from f union all select feedback, 'citations', citations from f),
m as (select factor, coalesce(avg(v) filter (feedback = 'useful'), 0) as u, coalesce(avg(v) filter (feedback = 'not_useful'), 0) as o from l group by factor),
c as (select factor, u, o, greatest(-1.0::double, least(1.0::double, (u - o) / greatest(u, o, 0.01))) as k from m)"""


@query("factor_correlation", oracle(f"with {_FACTORS} select factor, round(u, 6) as useful_mean, round(o, 6) as other_mean, round(k, 6) as correlation, round(k * 0.1, 6) as adjustment from c", "metrics"))
def _(spark, d):
    return _round(M.factor_contrast(M.factors(metrics(spark, d))), "useful_mean", "other_mean", "correlation", "adjustment")


@query("weight_recommendation", oracle(f"""with {_FACTORS}, w as (select factor, k, greatest(0.05, least(0.9, case factor when 'confidence' then 0.7 when 'structural' then 0.1 else 0.2 end + k * 0.1)) as b from c),
s as (select sum(b) as sb, avg(abs(k)) as st from w), n as (select count(*) filter (feedback = 'useful') as u, count(*) filter (feedback = 'not_useful') as o from f)
select factor, round(b / sb, 6) as weight, round(st * least((u + o) / 100, 1), 6) as confidence, st * least((u + o) / 100, 1) > 0.8 as auto_apply from w, s, n""", "metrics"))
def _(spark, d):
    return _round(M.weights(M.factors(metrics(spark, d)), {"confidence": 0.7, "structural": 0.1, "citations": 0.2}), "weight", "confidence")


@query("penalty_adjust", oracle(f"""with {_RATES} select project, round(case when fn > 0.2 then greatest(-5, -fn * 10 * 0.1) when fp > 0.2 then least(5, fp * 10 * 0.1) else 0 end, 6) as staleness_delta,
round(case when fn > 0.15 then greatest(-5, -fn * 8 * 0.1) when fp > 0.15 then least(5, fp * 8 * 0.1) else 0 end, 6) as orphan_delta, round(case when fn > 0.2 then least(5, fn * 5 * 0.1) else 0 end, 6) as connectivity_delta from r""", "metrics"))
def _(spark, d):
    out = M.penalty_deltas(M.error_rates(metrics(spark, d), ["project"]))
    return _round(out, "staleness_delta", "orphan_delta", "connectivity_delta").select("project", "staleness_delta", "orphan_delta", "connectivity_delta")


@query("tuning_advice", oracle(f"""with {_RATES} select project, concat_ws('; ', case when fp > 0.2 then 'Raise penalties: confident answers were often not useful' end, case when fn > 0.2 then 'Lower penalties: unsure answers were often useful' end,
case when fp <= 0.2 and fn <= 0.2 then 'Confidence fits the feedback' end) as advice from r""", "metrics"))
def _(spark, d):
    return M.recommendations(M.error_rates(metrics(spark, d), ["project"])).select("project", "advice")


@query("histogram_buckets", oracle("with " + "h as (" + " union all ".join(f"select project, '{b}' as le, count(*) filter (confidence <= {b}) as count from metrics group by project" for b in BOUNDS) + " union all select project, '+Inf', count(*) from metrics group by project) select * from h", "metrics"))
def _(spark, d):
    return M.histogram(metrics(spark, d), "confidence", BOUNDS, ["project"]).select("project", "le", "count")


@query("gauge_last", oracle("select user_id as service, event_type as kind, arg_max(value, (ts, event_id)) as value from events group by all"))
def _(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("service"), F.col("event_type").alias("kind"), "value", "ts", F.col("event_id").alias("seq"))
    return M.gauges(rows, ["service", "kind"])


@query("tuning_running_total", oracle("select query_id, round(sum(case feedback when 'useful' then 1.0::double when 'not_useful' then -1.0::double else 0.0::double end) over (partition by project order by ts, query_id rows unbounded preceding), 6) as total from metrics", "metrics"))
def _(spark, d):
    rows = metrics(spark, d).withColumn("delta", F.when(F.col("feedback") == "useful", 1.0).when(F.col("feedback") == "not_useful", -1.0))
    return M.running_total(rows, "delta", "project", ["ts", "query_id"]).select("query_id", F.round("total", 6).alias("total"))


@query("current_tuning", oracle("with p as (select distinct 'p' || (user_id % 4) as project from events), c as (select project, arg_max(confidence, (ts, query_id)) as staleness from metrics where feedback = 'useful' and project <> 'p2' group by project) select project, coalesce(staleness, 0) as staleness from p left join c using (project)", "metrics"))
def _(spark, d):
    projects = table(spark, d, "events").select(F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("project")).distinct()
    configs = metrics(spark, d).where("feedback = 'useful' and project <> 'p2'").select("project", "ts", "query_id", F.col("confidence").alias("staleness"))
    from lodestar.operators.common import latest

    return M.current_config(latest(configs, ["project"], ["ts", "query_id"]), projects, ["staleness"])


@query("fallback_stats", oracle("""with a as (select *, lag(ok) over (partition by service order by ts, seq) as before from health)
select service, count(*) as attempts, round(avg(ok::int), 6) as success_rate, round(avg((ok and before is not null and not before)::int), 6) as fallback_rate from a group by service""", "health"))
def _(spark, d):
    return _round(M.attempts(health(spark, d), "service", ["ts", "seq"]), "success_rate", "fallback_rate")


@query("token_budget", oracle("""with t as (select doc_id, source, greatest(1, floor(length(text) * 0.25))::bigint as tokens from documents where text is not null),
r as (select *, sum(tokens) over (partition by source order by tokens, doc_id rows unbounded preceding) as running from t) select doc_id, source, tokens, running::bigint as running from r where running <= 2000"""))
def _(spark, d):
    from lodestar.functions.text import token_estimate

    rows = table(spark, d, "documents").select("doc_id", "source", token_estimate(F.col("text")).alias("tokens"))
    return M.fit_budget(rows, "tokens", 2000, ["tokens", "doc_id"], "source")


_SERVICES = "s as (select service, arg_max(ok, (ts, seq)) as healthy, arg_max(latency, (ts, seq)) as latency, count(*) filter (not ok) as failures from health group by service)"


def _services(spark, d):
    last = F.struct("ts", "seq")
    return health(spark, d).groupBy("service").agg(F.max_by("ok", last).alias("healthy"), F.max_by("latency", last).alias("latency"), F.count(F.when(~F.col("ok"), 1)).alias("failures"))


@query("overall_health", oracle(f"with {_SERVICES} select case when bool_and(healthy) then 'healthy' when bool_or(not healthy) then 'unhealthy' else 'degraded' end as strict, case when bool_and(healthy) then 'healthy' when bool_or(healthy) then 'degraded' else 'unhealthy' end as lenient from s", "health"))
def _(spark, d):
    return M.overall(_services(spark, d))


@query("health_exposition", oracle(f"""with {_SERVICES} select 'health_status' as metric, service, case when healthy then 1.0 else 0.0 end as value from s union all select 'latency_ms', service, latency from s where latency >= 0
union all select 'failures', service, failures from s union all select 'breaker_state', service, case when failures > 3 then 2.0 else 0.0 end from s""", "health"))
def _(spark, d):
    s = _services(spark, d).withColumn("status", F.when(F.col("healthy"), "healthy").otherwise("unhealthy")).withColumn("breaker", F.when(F.col("failures") > 3, "open").otherwise("closed"))
    return M.exposition(s)


@query("metric_rollup", oracle("select project, feedback, count(*) as n, grouping(project, feedback) as level from metrics group by rollup(project, feedback)", "metrics"))
def _(spark, d):
    return metrics(spark, d).rollup("project", "feedback").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


@query("metric_grouping_sets", oracle("select project, feedback, count(*) as n from metrics group by grouping sets ((project), (feedback))", "metrics"))
def _(spark, d):
    metrics(spark, d).createOrReplaceTempView("_metrics_sets")
    return spark.sql("select project, feedback, count(*) as n from _metrics_sets group by grouping sets ((project), (feedback))")


@query("approx_users", None)
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"))
