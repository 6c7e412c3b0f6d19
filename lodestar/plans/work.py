"""Queries: linking of commits, rows to append, histories, tools, and further pieces of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import registry as functions
from lodestar.functions import render
from lodestar.functions import text as X
from lodestar.operators import graph as G
from lodestar.operators import linking as L
from lodestar.operators import metrics as M
from lodestar.operators import packet as P
from lodestar.operators import rules as R
from lodestar.operators import stateful as Z
from lodestar.operators import store as K
from lodestar.operators import tracking as W
from lodestar.operators import windows as N
from lodestar.sources import code, files
from lodestar.tools import Toolbox

from .registry import query
from .search import TEXT, _hits
from .sources import FILES, _files, expected
from .views import AS_OF, changes, edges, evidence_nodes, health, metrics, nodes, oracle, spread, table, work_items

# Every second order is an item; every order has a commit whose message names its item or none.
_ITEMS = """li as (select uid, project, 'order' || uid || ' totals' as title, 'repair cust' || (uid // 8) || ' ledger' as description, work_type, priority from work_items where uid % 2 = 0)"""
_SAID = """lc as (select 'c' || uid as commit_hash, case uid % 4 when 0 then 'feat: order' || uid || ' totals with ledger' when 1 then 'fix(cust): cust' || (uid // 8) || ' ledger' when 2 then 'chore: order' || uid else 'Merge branch ' || uid end as message, created_at as ts from work_items)"""
_WORD = "list_filter(list_distinct(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+')), lambda z: length(z) > 3 and z not in ('with', 'from', 'that', 'this', 'will', 'should'))"
_CANDIDATES = f"""iw as (select uid, unnest({_WORD.format("title || ' ' || description")}) as word from li), cw as (select commit_hash, unnest({_WORD.format("message")}) as word from lc),
ok as (select word from iw group by word having count(*) <= 100), cand as (select commit_hash, uid, count(*) as shared from cw join iw using (word) where word in (select word from ok) group by all)"""


def _items(spark, d):
    k = F.col("uid").cast("string")
    w = work_items(spark, d).where("uid % 2 = 0")
    return w.select("uid", "project", F.concat(F.lit("order"), k, F.lit(" totals")).alias("title"), F.concat(F.lit("repair cust"), F.expr("uid div 8").cast("string"), F.lit(" ledger")).alias("description"), "work_type", "priority", "status", "created_at")


def _commits(spark, d):
    u, k = F.col("uid"), F.col("uid").cast("string")
    message = (
        F.when(u % 4 == 0, F.concat(F.lit("feat: order"), k, F.lit(" totals with ledger"))).when(u % 4 == 1, F.concat(F.lit("fix(cust): cust"), F.expr("uid div 8").cast("string"), F.lit(" ledger")))
        .when(u % 4 == 2, F.concat(F.lit("chore: order"), k)).otherwise(F.concat(F.lit("Merge branch "), k))
    )
    return work_items(spark, d).select(F.concat(F.lit("c"), k).alias("commit_hash"), "project", message.alias("message"), F.col("created_at").alias("ts"))


def _n(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


@query("link_candidates", oracle(f"with {_ITEMS}, {_SAID}, {_CANDIDATES} select commit_hash, uid, shared from cand", "work_items"))
def _(spark, d):
    return L.candidates(_commits(spark, d), _items(spark, d))


@query("orphan_link_candidates", oracle(f"with {_ITEMS}, {_SAID}, {_CANDIDATES} select uid % 7 as part, count(*) as pairs, count(distinct commit_hash) as commits from cand where commit_hash not in (select 'c' || uid from work_items where uid % 8 = 0) group by 1", "work_items"))
def _(spark, d):
    bare = _commits(spark, d).join(_linked(spark, d).select("commit_hash").distinct(), "commit_hash", "left_anti")
    return L.candidates(bare, _items(spark, d)).groupBy((F.col("uid") % 7).alias("part")).agg(_n("pairs"), F.countDistinct("commit_hash").alias("commits"))


def _linked(spark, d):
    return work_items(spark, d).where("uid % 8 = 0").select(F.concat(F.lit("c"), F.col("uid").cast("string")).alias("commit_hash"))


@query("commit_link")
def _(spark, d):
    """The best item of each commit, over all commits and items."""
    return L.best_matches(_commits(spark, d), _items(spark, d))


@query("auto_link")
def _(spark, d):
    return L.auto_link(_commits(spark, d), _linked(spark, d), _items(spark, d), dry_run=True)


_MATCH = "m as (select commit_hash, uid, case when uid % 4 = 0 then 0.9::double else 0.4::double end as score from (select 'c' || uid as commit_hash, uid from work_items where uid % 2 = 0))"


@query("commit_outcomes", oracle(f"""with {_SAID}, {_MATCH}, k as (select commit_hash, case when message like 'feat%' then 'feat' when message like 'fix%' then 'fix' when message like 'chore%' then 'chore' end as type from lc),
o as (select k.commit_hash, case when coalesce(score >= 0.7, false) then 'linked_to_existing' when type in ('feat', 'fix') then 'created_work_item' else 'skipped' end as action, uid, type from k left join m on m.commit_hash = k.commit_hash)
select commit_hash, action, case when action = 'linked_to_existing' then uid end as uid, case when action = 'skipped' then case when type is null then 'non_conventional_commit' else 'non_trackable_type' end end as reason from o""", "work_items"))
def _(spark, d):
    matches = _items(spark, d).select(F.concat(F.lit("c"), F.col("uid").cast("string")).alias("commit_hash"), "uid", F.when(F.col("uid") % 4 == 0, 0.9).otherwise(0.4).alias("score"))
    return L.outcomes(_commits(spark, d), matches)


@query("create_items", oracle("""select p_partkey, case when p_partkey % 5 = 0 then null else 'p::workitem::' || substr(sha256(p_name || ' ' || p_partkey || '::' || p_type), 1, 16) end as uid, case when p_partkey % 5 = 0 then 'missing title' else '' end || case when p_partkey % 10 = 0 then ',unknown work_type' else '' end as problems,
case when p_partkey % 3 = 0 then 'high' else 'medium' end as priority from part"""))
def _(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        "p_partkey", F.when(k % 5 != 0, F.concat_ws(" ", "p_name", k.cast("string"))).alias("title"), F.col("p_type").alias("description"),
        F.when(k % 10 == 0, "idea").otherwise("bug").alias("work_type"), F.when(k % 3 == 0, "high").alias("priority"),
    )
    return W.create_items(rows, "p", AS_OF).select("p_partkey", "uid", F.array_join("problems", ",").alias("problems"), "priority")


@query("record_changes", oracle("select doc_id, 'p::codechanqge::d' || doc_id || '-' || substr(sha256(source), 1, 8) as uid, length(substr(text, 1, 1000)) as kept from documents where source is not null and source <> ''"))
def _(spark, d):
    rows = table(spark, d, "documents").where("source is not null and source <> ''").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("commit_hash"), F.col("source").alias("file_path"), F.lit("modified").alias("change_type"), F.col("text").alias("diff"))
    return W.record_changes(rows, "p").select("doc_id", "uid", F.length("diff").cast("long").alias("kept"))


@query("link_changes", oracle("select work_uid, change_uid, 0.5::double as confidence from (select distinct l_orderkey as work_uid, 'part/' || l_partkey as change_uid from lineitem) where work_uid in (select o_orderkey from orders where o_orderkey % 3 <> 0) and change_uid in (select 'part/' || p_partkey from part where p_partkey % 2 = 0)"))
def _(spark, d):
    pairs = changes(spark, d).select("work_uid", F.col("file_path").alias("change_uid"))
    recorded = table(spark, d, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("uid"))
    return W.link(pairs, work_items(spark, d).where("uid % 3 <> 0"), recorded).select("work_uid", "change_uid", "confidence")


@query("queue_settled", oracle("""with s as (select o_orderkey as uid, o_orderdate as "at", 0 as done from orders where o_orderkey % 4 <> 3 union all select o_orderkey, o_orderdate + case when o_orderkey % 2 = 0 then interval 0 hour else interval 1 hour end, 1 from orders where o_orderkey % 3 = 0)
select uid, case when max(done) = 1 then 'completed' else 'pending' end as status, max("at") as "at" from s group by uid"""))
def _(spark, d):
    w = work_items(spark, d)
    waiting = W.enqueue(w.where("uid % 4 <> 3"), F.lit("sync"), F.col("created_at")).select("uid", "status", "at")
    later = F.when(F.col("uid") % 2 == 0, F.col("created_at")).otherwise(F.col("created_at") + F.make_dt_interval(hours=F.lit(1)))
    done = w.where("uid % 3 = 0").select("uid", F.lit("completed").alias("status"), later.alias("at"))
    return W.settled(waiting.unionByName(done))


@query("item_file_paths", oracle("select work_uid, place, file_path from (select *, row_number() over (partition by work_uid order by file_path) as place from (select distinct work_uid, file_path from changes where linked)) where place <= 3", "changes"))
def _(spark, d):
    return W.file_paths(changes(spark, d).where("linked"), 3)


_EVIDENCE = "ev as (select c.conv_id, c.turn, u.i as rank, 'n' || ((c.conv_id * 7 + c.turn * 3 + u.i) % 50) as node from conversations c, unnest(range(0, 14)) as u(i) where role = 'user')"


def _evidence(spark, d):
    c = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.explode(F.sequence(F.lit(0), F.lit(13))).alias("rank"))
    return c.withColumn("node", F.concat(F.lit("n"), ((F.col("conv_id") * 7 + F.col("turn") * 3 + F.col("rank")) % 50).cast("string")))


@query("query_evidence", oracle(f"with {_EVIDENCE} select conv_id, turn, node, rank + 1 as place from ev where rank < 10"))
def _(spark, d):
    asked = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn")
    return W.add_queries(asked, _evidence(spark, d))


@query("conversation_history", oracle(f"""with {_EVIDENCE}, l as (select conv_id, turn, count(distinct node) as n from ev where rank < 10 and turn > 0 group by all)
select c.conv_id, c.turn, c.text, coalesce(l.n, 0) as evidence from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations where role = 'user') c left join l on l.conv_id = c.conv_id and l.turn = c.turn where r <= 5"""))
def _(spark, d):
    turns = table(spark, d, "conversations")
    links = W.add_queries(turns.where("role = 'user'").select("conv_id", "turn"), _evidence(spark, d)).where("turn > 0")
    return W.history(turns, links)


@query("conversation_create", oracle("select substr(sha256('p' || (conv_id % 3) || '::' || conv_id), 1, 16) as conv_id, 'p' || (conv_id % 3) as project from (select distinct conv_id from conversations)"))
def _(spark, d):
    rows = table(spark, d, "conversations").select(F.concat(F.lit("p"), (F.col("conv_id") % 3).cast("string")).alias("project"), F.col("conv_id").cast("string").alias("token"))
    return W.create_conversations(rows, AS_OF).select("conv_id", "project")


@query("conversation_next", oracle(f"""with q as (select conv_id, count(*) as n, arg_min(text, turn) as first, arg_max(text, turn) as last from conversations where role = 'user' group by conv_id),
a as (select *, len(list_filter([{', '.join(f"'{w}'" for w in (*X.PRONOUNS, *X.VAGUE, *X.BROAD))}], lambda w: regexp_matches(lower(trim(last)), '\\b' || w || '\\b'))) as unclear from q)
select conv_id, least(n, 3) as round, case when n >= 3 or (unclear = 0 and length(trim(last)) > 0) then 'execute' else 'questions' end as next, case when n > 1 then concat_ws('. ', first, 'Focus: ' || last) else last end as query from a"""))
def _(spark, d):
    return W.continued(table(spark, d, "conversations"))


@query("metrics_tracked", oracle("""with fresh as (select query_id, ms + 1 as ms from metrics where query_id % 4 = 0), said as (select event_id as query_id, case when event_id % 2 = 0 then 'useful' else 'partial' end as rating from events where event_id % 3 = 0)
select m.query_id, round(coalesce(f.ms, m.ms), 6) as ms, coalesce(s.rating, m.feedback) as feedback, case when m.query_id % 5 = 0 then 'r' || m.query_id end as report_id from metrics m left join fresh f on f.query_id = m.query_id left join said s on s.query_id = m.query_id""", "metrics"))
def _(spark, d):
    m = metrics(spark, d)
    fresh = m.where("query_id % 4 = 0").withColumn("ms", F.col("ms") + 1)
    said = m.where("query_id % 3 = 0").select("query_id", "ts", F.when(F.col("query_id") % 2 == 0, "useful").otherwise("partial").alias("rating"))
    reports = m.where("query_id % 5 = 0").select("query_id", F.concat(F.lit("r"), F.col("query_id").cast("string")).alias("report_id"))
    return M.tracked(m, fresh, said, reports).select("query_id", F.round("ms", 6).alias("ms"), "feedback", "report_id")


@query("faulted_nodes", oracle("select label, uid like 'customer:%' and coalesce(try_cast(substr(uid, 10) as bigint) % 3 = 0, false) as faulty, count(*) as n from nodes group by all", "nodes"))
def _(spark, d):
    n = nodes(spark, d).withColumn("name", F.col("uid"))
    faults = n.where("uid like 'customer:%' and cast(substring(uid, 10) as bigint) % 3 = 0").select("project", F.concat(F.lit("STALE_DOC: "), "uid", F.lit(", is old")).alias("message"))
    return G.faulted(n, faults).groupBy("label", "faulty").agg(_n())


@query("nodes_and_reports", oracle("select kind, count(*) as n, count(label) as labels, count(score) as scores from (select 'node' as kind, label, null as score from nodes union all select 'report', null, value from events) group by kind", "nodes"))
def _(spark, d):
    reports = table(spark, d, "events").select(F.concat(F.lit("report:"), F.col("event_id").cast("string")).alias("uid"), F.col("value").alias("score"))
    return G.shown(nodes(spark, d), reports).groupBy("kind").agg(_n(), F.count("label").alias("labels"), F.count("score").alias("scores"))


@query("nodes_by_path_or_name", oracle("select uid, path, name from (select 'doc:' || doc_id as uid, source as path, 'doc:' || doc_id as name from documents) where contains(path, 'we') or name = 'doc:7'"))
def _(spark, d):
    rows = evidence_nodes(spark, d).select("uid", "path", "name")
    return G.named(rows, "we").unionByName(G.named(rows.where("not contains(path, 'we')"), "doc:7"))


@query("strong_paths", oracle("""with s as (select src, dst, type, case when type = 'DEPENDS_ON' then 0.8::double else 0.5::double end as w from edges where type in ('HAS_FEATURE', 'HAS_ASSET', 'DEPENDS_ON')),
b as (select src as uid, dst as to_, w, type from s union all select dst, src, w, type from s), one as (select to_ as uid, w from b where uid = 'region:1')
select uid, 0 as depth, 1.0::double as strength, uid as path, '' as edges from (select 'region:1' as uid) union all select uid, 1, w, 'region:1>' || uid, 'HAS_FEATURE' from one where w >= 0.25
union all select b.to_, 2, round(one.w * b.w, 6), 'region:1>' || one.uid || '>' || b.to_, 'HAS_FEATURE>' || b.type from one join b on b.uid = one.uid where one.w * b.w >= 0.25 and b.to_ <> 'region:1'""", "edges"))
def _(spark, d):
    e = G.strengths(edges(spark, d).where("type in ('HAS_FEATURE', 'HAS_ASSET', 'DEPENDS_ON')"))
    out = G.path_strengths(e, ["region:1"], 2, least=0.25)
    return out.select("uid", "depth", F.round("strength", 6).alias("strength"), F.array_join("path", ">").alias("path"), F.array_join("edges", ">").alias("edges"))


@query("issues_by_severity", oracle(f"select path, line, message, case confidence when 'HIGH' then 0 when 'MEDIUM' then 1 else 2 end as rank from {expected('code_issues')}"))
def _(spark, d):
    return code.by_severity(code.issues(_files(spark, d))).select("path", "line", "message", "rank")


@query("issues_by_file", oracle(f"select path, count(*)::int as n, min(line) as first, string_agg(message, ',' order by line, type, message) as messages from {expected('code_issues')} group by path"))
def _(spark, d):
    out = code.by_file(code.issues(_files(spark, d)))
    return out.select("path", F.size("issues").alias("n"), F.get("issues", F.lit(0))["line"].alias("first"), F.array_join(F.transform("issues", lambda x: x["message"]), ",").alias("messages"))


@query("cache_clear", oracle("select count(*) as n from (select event_type || ':' || user_id as key from events where event_id % 9 <> 0 union all select null from events where event_id % 9 = 0) where key is null or not starts_with(key, 'error:')"))
def _(spark, d):
    key = F.when(F.col("event_id") % 9 != 0, F.concat_ws(":", "event_type", F.col("user_id").cast("string")))
    return K.without_prefix(table(spark, d, "events").select(key.alias("key")), "error:").agg(_n())


@query("history_ring", oracle("select service, seq from (select *, row_number() over (partition by service order by ts desc, seq desc) as r from health) where r <= 4", "health"))
def _(spark, d):
    return K.ring(health(spark, d), ["service"], ["ts", "seq"], 4).select("service", "seq")


@query("reports_per_project", oracle("select project, query_id from (select *, row_number() over (partition by project order by ts desc, query_id desc) as r from metrics) where r <= 20", "metrics"))
def _(spark, d):
    return K.ring(metrics(spark, d), ["project"], ["ts", "query_id"], 20).select("project", "query_id")


@query("health_history", oracle("""with k as (select *, row_number() over (partition by service order by ts desc, seq desc) as r, floor(epoch(timestamp '2024-01-15') - floor(epoch(ts))) as age from health where ts <= timestamp '2024-01-15' and floor(epoch(timestamp '2024-01-15')) - floor(epoch(ts)) between 0 and 86400)
select 'history' as kind, service, seq from k where r <= 3 union all select 'latest', service, seq from (select * from k where r = 1) where age <= 7200""", "health"))
def _(spark, d):
    newest, kept = K.health_history(health(spark, d), "2024-01-15", 3, 7200, 86400)
    pick = lambda df, kind: df.select(F.lit(kind).alias("kind"), "service", "seq")
    return pick(kept, "history").unionByName(pick(newest, "latest"))


@query("alerts_required", oracle("""with r as (select *, sum(case when ok then 1 else 0 end) over (partition by service order by ts, seq rows unbounded preceding) as run from health), c as (select *, sum(case when ok then 0 else 1 end) over (partition by service, run order by ts, seq rows unbounded preceding) as k from r)
select k >= 2 or latency >= 15000 as alert, k >= 3 as recovery, count(*) as n from c group by all""", "health"))
def _(spark, d):
    rows = N.run_lengths(health(spark, d), ~F.col("ok"), "service")
    return rows.groupBy(N.alert_required(most=2, slow=15000.0).alias("alert"), N.recovery_required(most=2, beyond=1).alias("recovery")).agg(_n())


@query("breaker_summary", oracle("""with s as (select service, count(*) filter (not ok) as f from health group by service) select count(*) as total, count(*) filter (f <= 3) as closed, count(*) filter (f > 5) as open, count(*) filter (f > 3 and f <= 5) as half_open from s""", "health"))
def _(spark, d):
    s = health(spark, d).groupBy("service").agg(F.count(F.when(~F.col("ok"), 1)).alias("f"))
    return M.breaker_summary(s.withColumn("breaker", F.when(F.col("f") > 5, "open").when(F.col("f") > 3, "half_open").otherwise("closed")))


@query("rate_thresholds", oracle("""with h as (select event_type as kind, floor(epoch(ts))::bigint // 86400 * 86400 as w, value, lag(value) over (partition by event_type order by ts, event_id) as before from events),
r as (select kind, w, sum(case when before is null then 0 when value < before then value else value - before end) / 86400 as rate from h group by all),
o as (select *, w - row_number() over (partition by kind order by w) * 86400 as g from r where rate > 0.003)
select kind, min(w) as start, max(w) + 86400 as "end" from o group by kind, g having max(w) + 86400 - min(w) >= 172800"""))
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("kind"), "ts", F.col("event_id").alias("seq"), "value")
    return N.over_threshold(N.rates(e, "value", "kind", 86400), "rate", 0.003, 86400, 172800, ["kind"])


@query("dashboard_series", oracle("""with t as (select event_type as kind, floor(epoch(ts))::bigint // 86400 * 86400 as win, value as v from events), g as (select kind, win, count(*) as n, count(*) filter (v <= 50) as a, count(*) filter (v <= 100) as b, count(*) filter (v <= 200) as c from t group by all)
select kind, win as "window", round(n / 86400, 9) as rate, round(case when a >= n * 0.5 then 50 * (n * 0.5::double) / a when b >= n * 0.5 then 50 + 50 * (n * 0.5::double - a) / (b - a) when c >= n * 0.5 then 100 + 100 * (n * 0.5::double - b) / (c - b) else 200 end, 6) as q50,
round(case when a >= n * 0.95 then 50 * (n * 0.95::double) / a when b >= n * 0.95 then 50 + 50 * (n * 0.95::double - a) / (b - a) when c >= n * 0.95 then 100 + 100 * (n * 0.95::double - b) / (c - b) else 200 end, 6) as q95 from g"""))
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("kind"), "ts", "value")
    return N.series(e, "value", "kind", (50.0, 100.0, 200.0), 86400).select("kind", "window", F.round("rate", 9).alias("rate"), F.round("q50", 6).alias("q50"), F.round("q95", 6).alias("q95"))


def _exported_sql() -> str:
    rows = ["select 'query_total' as metric, kind as label, null as le, count(*)::double as value from x group by kind", "select 'errors_total', kind, null, count(*) filter (not ok)::double from x group by kind"]
    for metric, column in (("query_duration_seconds", "seconds"), ("query_confidence", "confidence")):
        bounds = next(b for m, _, b in M.CATALOGUE if m == metric)
        rows += [f"select '{metric}', kind, '{float(b)}', count(*) filter ({column} <= {float(b)}::double)::double from x group by kind" for b in bounds]
        rows.append(f"select '{metric}', kind, '+Inf', count(*)::double from x group by kind")
    return "with x as (select project as kind, ms / 100 as seconds, confidence / 100 as confidence, coalesce(feedback, '') <> 'not_useful' as ok from metrics) " + " union all ".join(rows)


@query("exported_metrics", oracle(_exported_sql(), "metrics"))
def _(spark, d):
    rows = metrics(spark, d).select(F.col("project").alias("kind"), (F.col("ms") / 100).alias("seconds"), (F.col("confidence") / 100).alias("confidence"), (F.coalesce("feedback", F.lit("")) != "not_useful").alias("ok"))
    return M.exported(rows)


@query("head_changes", oracle("select user_id as project, event_id as seq, event_type as head, before from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) where before <> event_type"))
def _(spark, d):
    polls = table(spark, d, "events").select(F.col("user_id").alias("project"), F.col("event_type").alias("head"), "ts", F.col("event_id").alias("seq"))
    return N.head_changes(polls).select("project", "seq", "head", "before")


@query("first_provider", oracle("select doc_id, case when doc_id % 3 = 0 then 'a' when doc_id % 2 = 0 then 'b' end as provider, case when doc_id % 3 = 0 then doc_id when doc_id % 2 = 0 then -doc_id end as value from documents"))
def _(spark, d):
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", F.when(k % 3 == 0, k).alias("a"), F.when(k % 2 == 0, -k).alias("b"))
    return Z.first_success(rows, ["a", "b"]).select("doc_id", "provider", "value")


@query("neighbour_pairs", oracle("with h as (select src as uid, string_agg(dst, ',' order by dst) as n from edges where type = 'HAS_ASSET' group by src) select uid as src, unnest(string_split(n, ',')) as dst from h", "edges"))
def _(spark, d):
    near = edges(spark, d).where("type = 'HAS_ASSET'").groupBy("src").agg(F.collect_set("dst").alias("n"))
    return near.select("src", F.explode("n").alias("dst"))


@query("second_issue_mapping", oracle("""select uid, title, array_to_string(list_filter([case work_type when 'bug' then 'bug' when 'feature' then 'enhancement' when 'chore' then 'chore' end, case priority when 'high' then 'high-priority' when 'medium' then 'medium-priority' when 'low' then 'low-priority' end, case when uid % 2 = 0 then 'auto-generated' end], lambda x: x is not null), ',') as labels,
case when status = 'closed' then 'closed' else 'open' end as state from work_items""", "work_items"))
def _(spark, d):
    source = F.when(F.col("uid") % 2 == 0, "code_analyzer")
    issue = render.plain_issue(F.col("title"), F.lit(None).cast("string"), F.col("work_type"), F.col("priority"), source, F.col("status"))
    return work_items(spark, d).select("uid", issue.alias("x")).select("uid", "x.title", F.array_join("x.labels", ",").alias("labels"), "x.state")


@query("prompt_context", oracle("""with p as (select source, string_agg(r || '. ' || path || ' (' || printf('%.2f', score) || ')', chr(10) order by r) as context from (select source, 'doc/' || doc_id as path, (n_chars % 100) / 100.0::double as score, row_number() over (partition by source order by (n_chars % 100) desc, doc_id) as r from documents) where r <= 5 group by source) select source, context from p"""))
def _(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "documents").select("source", "doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), (F.col("n_chars") % 100 / 100).alias("score"))
    best = rows.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "doc_id"))).where("r <= 5")
    hits = best.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "path", "score"))), lambda x: F.struct(x["path"].alias("path"), x["score"].alias("score"))).alias("hits"))
    return hits.select("source", render.context(F.col("hits")).alias("context"))


@query("packet_markdown", None)
def _(spark, d):
    return P.rendered(P.assemble(_hits(spark, d), TEXT, "en", AS_OF))


@query("packet_audit", None)
def _(spark, d):
    return P.audit_entry(P.assemble(_hits(spark, d), TEXT, "en", AS_OF), AS_OF)


@query("audit_log", oracle("select strftime(ts, '%Y%m') as yyyymm, count(*) as n, sum(event_id)::bigint as ids from events group by 1"))
def _(spark, d):
    """Two appends to the log, read back."""
    import uuid

    folder = f"{G.shared_folder(spark)}/lodestar-audit-{uuid.uuid4().hex}"
    e = table(spark, d, "events").select("event_id", "ts", "event_type")
    for part in (e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")):
        K.append_log(part, folder)
    return spark.read.schema("event_id long, ts string, event_type string, yyyymm string").json(folder).groupBy("yyyymm").agg(_n(), F.sum("event_id").alias("ids"))


@query("packed_lines", oracle(r"select doc_id, length(regexp_replace(text, '\s', '', 'g')) as chars, true as fits from documents where length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) > 0"))
def _(spark, d):
    """All texts packed by the UDTF: no character but white space is lost, and only a line that is longer alone makes a longer chunk."""
    functions.register(spark)
    table(spark, d, "documents").select("doc_id", "text").createOrReplaceTempView("_packed_documents")
    return spark.sql(r"""select doc_id, sum(length(regexp_replace(content, r'\s', ''))) as chars, every(length(content) <= 300 or instr(content, '\n') = 0) as fits
        from _packed_documents, lateral chunk_text(text, 300) group by doc_id having chars > 0""")


@query("sql_functions", oracle("""select 'm' || p_partkey || '.py.helper' || p_size as uid, 'helper' || p_size as name from part union all select 'm' || p_partkey || '.py.Box', 'Box' from part where p_partkey % 2 = 0"""))
def _(spark, d):
    """A Python file made of each part, parsed in SQL."""
    functions.register(spark)
    k = F.col("p_partkey").cast("string")
    box = F.when(F.col("p_partkey") % 2 == 0, 'class Box:\n    size = "def not_one(): pass"\n').otherwise("")
    text = F.concat(box, F.lit("@cached\nasync def helper"), F.col("p_size").cast("string"), F.lit('(x):\n    """def nor_this(): pass"""\n    return x\n'))
    spread(table(spark, d, "part").select("p_partkey", "p_size")).select(F.concat(F.lit("m"), k, F.lit(".py")).alias("path"), text.alias("text")).createOrReplaceTempView("_part_files")
    return spark.sql("select uid, name from _part_files, lateral parse_source(path, text) where seq_ratio(name, name) = 1.0")


@query("point_payloads", oracle("select doc_id, lang as project, case when doc_id % 2 = 0 then source end as path from documents"))
def _(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("uid"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("project"), F.col("lang").alias("project_name"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("file_path"), F.lit("x").alias("content"))
    return K.normalised_points(rows).select(F.col("uid").alias("doc_id"), "project", "path")


def _toolbox(spark, d) -> Toolbox:
    w = work_items(spark, d)
    links = changes(spark, d).where("linked").select("work_uid", F.col("file_path").alias("change_uid"), "commit_hash", "file_path", "ts", "confidence")
    n = nodes(spark, d).withColumn("path", F.concat_ws("/", "project", "uid"))
    return Toolbox(spark, {"nodes": n, "edges": edges(spark, d), "items": w.withColumn("updated_at", F.col("created_at")), "links": links, "turns": table(spark, d, "conversations").withColumn("project", F.lit("p")), "evidence": _evidence(spark, d)}, AS_OF)


@query("tool_list_projects", oracle("select project, count(*) as nodes from nodes where project is not null group by project", "nodes"))
def _(spark, d):
    return _toolbox(spark, d).call("list_projects")


@query("tool_query_work_items", oracle("select uid, title, status from work_items where project = 'p1' and status = 'open' order by title, uid limit 15 offset 5", "work_items"))
def _(spark, d):
    out = _toolbox(spark, d).call("query_work_items", project_name="p1", status="open", order_by="title", order_direction="ASC", offset=5, limit=15)
    return out.select("uid", "title", "status")


@query("tool_component_map", oracle("select uid, name, (select count(distinct dst) from edges e where e.src = n.uid and type in ('DEFINES', 'HAS_ASSET')) as children from nodes n where project = 'ASIA' and starts_with(project || '/' || uid, 'ASIA/nation')", "nodes", "edges"))
def _(spark, d):
    return _toolbox(spark, d).call("get_component_map", project_name="ASIA", component_path="ASIA/nation").select("uid", "name", "children")


@query("tool_file_relationships", oracle("with f as (select uid from nodes where project = 'ASIA' and contains(project || '/' || uid, 'customer:1')) select src as uid, 'out' as direction, type, dst as other from edges where src in (select uid from f) union all select dst, 'in', type, src from edges where dst in (select uid from f)", "nodes", "edges"))
def _(spark, d):
    return _toolbox(spark, d).call("get_file_relationships", project_name="ASIA", file_path="customer:1")


@query("tool_work_context", oracle("""with l as (select distinct commit_hash, ts, file_path from changes where linked and work_uid = 3), c as (select commit_hash, max(ts) as t from l group by 1)
select uid, (select string_agg(commit_hash, ',' order by t desc, commit_hash) from c) as commits, (select string_agg(distinct file_path, ',' order by file_path) from l) as files from work_items where uid = 3""", "work_items", "changes"))
def _(spark, d):
    out = _toolbox(spark, d).call("get_work_context", work_item_uid="3")
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, ",")).alias(c)
    return out.select(F.col("uid").cast("long").alias("uid"), joined("commits"), joined("files"))


@query("tool_update_work_item", oracle("select uid, 'closed' as status, priority, 'done' as closure_reason from work_items where uid = 5", "work_items"))
def _(spark, d):
    out = _toolbox(spark, d).call("update_work_item", work_item_uid="5", status="closed", closure_reason="done")
    return out.select(F.col("uid").cast("long").alias("uid"), "status", "priority", "closure_reason")


@query("tool_conversation_history", oracle(f"with {_EVIDENCE}, l as (select conv_id, turn, count(distinct node) as n from ev group by all) select c.conv_id, c.turn, c.text, coalesce(l.n, 0) as evidence from conversations c left join l on l.conv_id = c.conv_id and l.turn = c.turn where role = 'user' and c.conv_id = (select min(conv_id) from conversations) order by c.turn desc limit 5"))
def _(spark, d):
    box = _toolbox(spark, d)
    first = table(spark, d, "conversations").agg(F.min("conv_id").alias("c")).first()["c"]
    return box.call("get_conversation_history", session_id=str(first))


@query("citation_excerpts", oracle("""with c as (select distinct doc_id % 10 as answer_id, left(source, 3) as path from documents where source is not null), n as (select doc_id % 10 as answer_id, doc_id as rank, 'doc:' || doc_id as uid, source, substr(text, 1, 200) as excerpt from documents)
select c.answer_id, c.path, arg_min(uid, rank) as uid, arg_min(sha256(coalesce(excerpt, '')), rank) as excerpt from c join n on n.answer_id = c.answer_id and contains(n.source, c.path) group by 1, 2"""))
def _(spark, d):
    docs = table(spark, d, "documents")
    answer = (F.col("doc_id") % 10).alias("answer_id")
    asked = docs.where("source is not null").select(answer, F.substring("source", 1, 3).alias("path"))
    found = docs.select(answer, F.col("doc_id").alias("rank"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("uid"), F.col("source").alias("path"), "text")
    return R.excerpts(asked, found).select("answer_id", "path", "uid", F.sha2(F.coalesce("excerpt", F.lit("")), 256).alias("excerpt"))


@query("truncated_text", oracle("select doc_id, length(text) > 500 as cut, case when length(text) > 500 then length(substr(text, 1, 500) || chr(10) || '... [truncated]') else length(text) end as chars from documents where text is not null"))
def _(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", (F.length("text") > 500).alias("cut"), F.length(files.cut_short(F.col("text"), 500)).cast("long").alias("chars"))


@query("vector_store", oracle("""with now as (select vec_id, label, 0 as version from embeddings where vec_id % 3 <> 0), new as (select vec_id, label + 100 as label, 1 as version from embeddings where vec_id % 2 = 0),
merged as (select * from now where vec_id not in (select vec_id from new) union all select * from new) select label, version, count(*) as n from merged where vec_id % 5 <> 0 group by all"""))
def _(spark, d):
    """Vectors upserted by id, some deleted, the rest counted."""
    e = table(spark, d, "embeddings")
    now = e.where("vec_id % 3 <> 0").select("vec_id", "label", F.lit(0).alias("version"), "embedding")
    new = e.where("vec_id % 2 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(1).alias("version"), "embedding")
    left = K.without(K.upsert(now, new, ["vec_id"]), e.where("vec_id % 5 = 0").select("vec_id"), ["vec_id"])
    return left.groupBy("label", "version").agg(_n())


@query("packet_problems", oracle("select 'missing status,unknown version' as problems from (select 1) union all select ''"))
def _(spark, d):
    good = P.assemble(_hits(spark, d), TEXT, "en", AS_OF)
    bad = good.withColumn("status", F.lit(None).cast("string")).withColumn("meta", F.col("meta").withField("schema_version", F.lit("0")))
    return P.problems(good).unionByName(P.problems(bad)).select(F.array_join("problems", ",").alias("problems"))
