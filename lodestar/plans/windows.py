"""Queries: time windows, alerts and sequential state."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import stateful as Z
from lodestar.operators import windows as N

from .registry import query
from .views import health, oracle, table

BOUNDS = (1000.0, 2500.0, 5000.0, 7500.0, 10000.0, 25000.0, 50000.0)
_S = "floor(epoch(ts))::bigint"


def _round(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _timed(spark, d):
    return health(spark, d).select("service", N.seconds().cast("double").alias("t"), "seq", "ok")


@query("debounce_sessions", oracle("""with e as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 2 hour or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as new from events),
g as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from e) select user_id, min(ts) as start, max(ts) + interval 2 hour as fires_at, count(*) as events from g group by user_id, s"""))
def _(spark, d):
    return N.sessions(table(spark, d, "events"), "2 hours", "user_id")


@query("rate_limit", oracle(f"""with p as (select user_id, event_id, {_S} // 21600 * 21600 as "window", row_number() over (partition by user_id, {_S} // 21600 order by ts, event_id) as place from events)
select user_id, event_id, "window", place, place <= 2 as allowed from p"""))
def _(spark, d):
    e = table(spark, d, "events").withColumnRenamed("event_id", "seq")
    return N.rate_limited(e, "user_id", 2, 21600).select("user_id", F.col("seq").alias("event_id"), "window", "place", "allowed")


@query("error_rate_window", oracle(f"""select {_S} // 21600 * 21600 as "window", count(*) as n, round(avg((not ok)::int), 6) as error_ratio from health group by 1 having avg((not ok)::int) > 0.1""", "health"))
def _(spark, d):
    return _round(N.error_ratio(health(spark, d), 21600, ~F.col("ok")), "error_ratio").where("error_ratio > 0.1")


def _quantile_sql(by: str, q: float, source: str = "health") -> str:
    cs = ", ".join(f"count(*) filter (latency <= {b}) as c{i}" for i, b in enumerate(BOUNDS))
    cases = []
    for i, b in enumerate(BOUNDS):
        lo_c, lo_b = (f"c{i - 1}", BOUNDS[i - 1]) if i else ("0", 0.0)
        cases.append(f"when c{i} >= n * {q} then {lo_b}::double + ({b} - {lo_b})::double * (n * {q}::double - {lo_c}) / (c{i} - {lo_c})")
    return f"select {by}, case {' '.join(cases)} else {BOUNDS[-1]} end as quantile from (select {by}, count(*) as n, {cs} from {source} group by {by})"


@query("histogram_quantile", oracle(f"with q as ({_quantile_sql('service', 0.95)}) select service, round(quantile, 6) as quantile from q", "health"))
def _(spark, d):
    return _round(N.histogram_quantile(health(spark, d), "latency", BOUNDS, 0.95, ["service"]), "quantile")


@query("latency_spike", oracle(f"""with h2 as (select *, {_S} // 21600 * 21600 as win, {_S} // 86400 * 86400 as outer_ from health),
a as ({_quantile_sql('win, outer_', 0.95, 'h2')}), b as ({_quantile_sql('outer_', 0.95, 'h2')})
select win as "window", round(a.quantile, 6) as quantile, round(b.quantile, 6) as baseline from a join b using (outer_) where a.quantile > 1.05 * b.quantile""", "health"))
def _(spark, d):
    return _round(N.latency_spikes(health(spark, d), "latency", BOUNDS, 21600, 86400, 1.05), "quantile", "baseline")


_ISLANDS = """r as (select *, sum(case when {c} then 0 else 1 end) over (partition by service order by ts, seq rows unbounded preceding) as run from health),
i as (select service, run, min(ts) as start, max(ts) as end_, count(*) as rows from r where {c} group by service, run)"""


@query("alert_for_duration", oracle("with " + _ISLANDS.format(c="latency > 3000") + " select service, start, end_ as \"end\", rows, (floor(epoch(start)) + 21600)::bigint as fires_at from i where floor(epoch(end_)) - floor(epoch(start)) >= 21600", "health"))
def _(spark, d):
    return N.firing(health(spark, d), F.col("latency") > 3000, "service", 21600)


@query("consecutive_failures", oracle("""with r as (select *, sum(case when ok then 1 else 0 end) over (partition by service order by ts, seq rows unbounded preceding) as run from health)
select service, seq, sum(case when ok then 0 else 1 end) over (partition by service, run order by ts, seq rows unbounded preceding)::bigint as consecutive from r""", "health"))
def _(spark, d):
    return N.run_lengths(health(spark, d), ~F.col("ok"), "service").select("service", "seq", "consecutive")


@query("alert_severity", oracle("""with r as (select *, sum(case when ok then 1 else 0 end) over (partition by service order by ts, seq rows unbounded preceding) as run from health),
c as (select *, sum(case when ok then 0 else 1 end) over (partition by service, run order by ts, seq rows unbounded preceding) as k from r)
select case when not ok and k >= 5 then 'critical' when not ok or k >= 3 then 'warning' else 'info' end as severity, count(*) as n from c group by 1""", "health"))
def _(spark, d):
    rows = N.run_lengths(health(spark, d), ~F.col("ok"), "service").withColumn("status", F.when(F.col("ok"), "healthy").otherwise("unhealthy"))
    return rows.groupBy(N.severity().alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("count_over_time", oracle(f"select service, seq, sum((not ok)::int) over (partition by service order by {_S} range between 86400 preceding and current row)::bigint as count from health", "health"))
def _(spark, d):
    return N.count_over(health(spark, d), ~F.col("ok"), "service", 86400).select("service", "seq", "count")


@query("counter_increase", oracle(f"""with r as (select service, {_S} // 86400 * 86400 as "window", latency, lag(latency) over (partition by service order by ts, seq) as before from health)
select service, "window", round(sum(case when before is null then 0 when latency < before then latency else latency - before end), 6) as increase from r group by all""", "health"))
def _(spark, d):
    return _round(N.increase(health(spark, d), "latency", "service", 86400), "increase")


@query("alert_and_on", oracle("with o as (select avg((not ok)::int) > 0.05 as on_ from health) select service, count(*) as n from health, o where not ok and on_ group by service having count(*) > 1", "health"))
def _(spark, d):
    from lodestar.operators.common import with_totals

    h = health(spark, d)
    on = h.agg((F.avg((~F.col("ok")).cast("double")) > 0.05).alias("_on"))
    return with_totals(h.where(~F.col("ok")).groupBy("service").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), on).where("_on").select("service", "n")


@query("instant_thresholds", oracle("select service, arg_max(latency, (ts, seq)) as latency from health group by service having arg_max(latency, (ts, seq)) > 5000", "health"))
def _(spark, d):
    return health(spark, d).groupBy("service").agg(F.max_by("latency", F.struct("ts", "seq")).alias("latency")).where("latency > 5000")


@query("sliding_counts", oracle("""with w as (select to_timestamp(floor(epoch(ts) / 21600) * 21600 - k * 21600)::timestamp as start, ts, event_type from events, unnest(range(0, 4)) as u(k))
select event_type, start, count(*) as events from w where ts >= start and ts < start + interval 24 hour group by all"""))
def _(spark, d):
    e = table(spark, d, "events").withColumn("key", F.col("user_id"))
    return N.sliding(e, "24 hours", "6 hours", ["event_type"]).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "events")


@query("dedupe_messages", oracle("""with m as (select conv_id, turn, case when role <> 'system' then conv_id || ':' || left(text, 3) end as k from conversations)
select conv_id, turn from (select *, row_number() over (partition by k order by conv_id, turn) as n from m where k is not null) where n = 1 union all select conv_id, turn from m where k is null"""))
def _(spark, d):
    c = table(spark, d, "conversations")
    key = F.when(F.col("role") != "system", F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.substring("text", 1, 3)))
    return N.duplicates(c, key, ["conv_id", "turn"]).select("conv_id", "turn")


@query("config_as_of", oracle("""select e.event_id, (select v.value from events v where v.user_id = e.user_id and v.event_type = 'signup' and v.ts <= e.ts order by v.ts desc limit 1) as as_of_value from events e where e.event_type = 'purchase'"""))
def _(spark, d):
    e = table(spark, d, "events")
    versions = e.where("event_type = 'signup'").select("user_id", "ts", "value")
    return N.as_of_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), versions, "user_id").select("event_id", "as_of_value")


_TIMED = f"t as (select service, {_S}::double as t, seq, ok, row_number() over (partition by service order by {_S}, seq) as n from health)"


def breaker_sql(more: str = "") -> str:
    """The breaker as a recursion over each service's events; more: further columns of the events."""
    more = "".join(f"t.{c}, " for c in more.split(", ") if c)
    return oracle(f"""with recursive {_TIMED},
b(service, n, state, failures, successes, opened, rejected) as (
  select distinct service, 0::bigint, 'closed', 0, 0, 0.0::double, false from t
  union all
  select x.service, x.n,
    case when x.rej then 'open' when x.ok and x.mid = 'half_open' and x.succ + 1 >= 1 then 'closed' when x.ok then x.mid
      when x.mid = 'half_open' or x.failures + 1 >= 2 then 'open' else x.mid end,
    case when x.rej then x.failures when x.ok then 0 else x.failures + 1 end,
    case when x.rej then x.successes when x.ok and x.mid = 'half_open' and x.succ + 1 < 1 then x.succ + 1 when x.ok then case when x.mid = 'half_open' then 0 else x.succ end else 0 end,
    case when x.rej then x.opened when x.ok then x.opened when x.mid = 'half_open' or x.failures + 1 >= 2 then x.t else x.opened end, x.rej
  from (select t.service, t.n, t.t, t.ok, b.failures, b.successes, b.opened, b.state = 'open' and t.t - b.opened < 43200 as rej,
      case when b.state = 'open' then 'half_open' else b.state end as mid, case when b.state = 'open' then 0 else b.successes end as succ from b join t on t.service = b.service and t.n = b.n + 1) x)
select t.service, t.seq, {more}b.state, b.rejected from b join t on t.service = b.service and t.n = b.n""", "health")


@query("circuit_breaker", breaker_sql())
def _(spark, d):
    return Z.circuit_breaker(_timed(spark, d), failure=2, success=1, reset=43200.0).select("service", "seq", "state", "rejected")


@query("alert_cooldown", oracle(f"""with recursive a as (select service, {_S}::double as t, seq, row_number() over (partition by service order by {_S}, seq) as n from health where not ok),
c(service, n, last, sent) as (select service, n, t, true from a where n = 1 union all
  select a.service, a.n, case when a.t - c.last >= 43200 then a.t else c.last end, a.t - c.last >= 43200 from c join a on a.service = c.service and a.n = c.n + 1)
select a.service, a.seq, c.sent from c join a on a.service = c.service and a.n = c.n""", "health"))
def _(spark, d):
    return Z.cooldown(_timed(spark, d).where(~F.col("ok")), "service", 43200.0).select("service", "seq", "sent")


@query("recovery_limit", oracle(f"""with recursive a as (select service, {_S}::double as t, seq, row_number() over (partition by service order by {_S}, seq) as n from health where not ok),
r(service, n, done, allowed) as (select distinct service, 0::bigint, []::double[], false from a union all
  select x.service, x.n, case when x.go then list_append(x.held, x.t) else x.held end, x.go from (
    select y.*, (len(held) = 0 or t - held[-1] >= 7200) and len(held) < 5 as go from (select a.service, a.n, a.t, list_filter(r.done, lambda z: a.t - z < 3600) as held from r join a on a.service = r.service and a.n = r.n + 1) y) x)
select a.service, a.seq, r.allowed from r join a on a.service = r.service and a.n = r.n""", "health"))
def _(spark, d):
    return Z.recovery_limit(_timed(spark, d).where(~F.col("ok")), "service", 7200.0, 5).select("service", "seq", "allowed")


@query("provider_fallback", oracle(f"""with recursive a as (select service, {_S}::double as t, seq, ok as first, seq % 3 > 0 as second, row_number() over (partition by service order by {_S}, seq) as n from health),
r(service, n, f1, u1, f2, u2, provider) as (select distinct service, 0::bigint, 0, -1e18::double, 0, -1e18::double, '' from a union all
  select service, n, case when got1 then 0 when try1 and f1 + 1 >= 2 then 0 when try1 then f1 + 1 else f1 end, case when try1 and not got1 and f1 + 1 >= 2 then t + 43200 else u1 end,
    case when got2 then 0 when try2 and f2 + 1 >= 2 then 0 when try2 then f2 + 1 else f2 end, case when try2 and not got2 and f2 + 1 >= 2 then t + 43200 else u2 end, case when got1 then 'first' when got2 then 'second' else 'third' end
  from (select x.*, try2 and second as got2 from (select w.*, not got1 and t >= u2 as try2 from (select v.*, try1 and first as got1 from (select a.*, r.f1, r.u1, r.f2, r.u2, a.t >= r.u1 as try1 from r join a on a.service = r.service and a.n = r.n + 1) v) w) x) z)
select a.service, a.t, a.seq, r.provider from r join a on a.service = r.service and a.n = r.n""", "health"))
def _(spark, d):
    rows = _timed(spark, d).withColumn("first", F.col("ok")).withColumn("second", F.col("seq") % 3 > 0).withColumn("third", F.lit(True))
    return Z.fallback(rows.select("service", "t", "seq", "first", "second", "third"), "service", ["first", "second", "third"], 2, 43200.0)


@query("conversation_rounds", oracle("""with r as (select conv_id, turn, role, least(3, sum((role = 'user')::int) over (partition by conv_id order by turn rows unbounded preceding))::int as round from conversations)
select conv_id, turn, role, round, case when round >= 3 then 'execute' when round > 0 then 'clarify' else 'new' end as state from r"""))
def _(spark, d):
    return Z.rounds(table(spark, d, "conversations"))
