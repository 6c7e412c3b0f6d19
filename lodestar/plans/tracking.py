"""Queries: work items, commits, links, queue, conversations, store."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import store as K
from lodestar.operators import tracking as W

from .registry import query
from .views import AS_OF, changes, nodes, oracle, table, work_items


def _n(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


def _links(spark, d):
    return changes(spark, d).where("linked")


@query("work_items_filtered", oracle("select uid, title, status, priority from work_items where project = 'p1' and status = 'open' and priority in ('critical', 'high')", "work_items"))
def _(spark, d):
    return W.filtered(work_items(spark, d), project="p1", status="open", priority=["critical", "high"], work_type=None).select("uid", "title", "status", "priority")


@query("work_items_page", oracle("select uid, created_at from work_items where status = 'open' order by created_at desc, uid limit 20 offset 40", "work_items"))
def _(spark, d):
    return W.page(W.filtered(work_items(spark, d), status="open"), "created_at", True, 40, 20).select("uid", "created_at")


@query("work_item_by_id", oracle("select uid, title, status from work_items where uid = 7", "work_items"))
def _(spark, d):
    return work_items(spark, d).where("uid = 7").select("uid", "title", "status")


@query("work_context", oracle("""select uid, count(distinct commit_hash) as commits, count(distinct file_path) as files, coalesce(sum(lines_added), 0) as lines_added
from work_items left join changes on work_uid = uid and linked group by uid""", "work_items", "changes"))
def _(spark, d):
    return W.context(work_items(spark, d), _links(spark, d)).select("uid", "commits", "files", "lines_added")


@query("trace_file_to_work", oracle("""select uid, title, status, max(changes.confidence) as confidence, string_agg(distinct commit_hash, ',' order by commit_hash) as commits
from changes join work_items on uid = work_uid where linked and file_path = 'part/7' and changes.confidence >= 0.3 group by all""", "work_items", "changes"))
def _(spark, d):
    return W.trace_file(work_items(spark, d), _links(spark, d), "part/7", 0.3)


@query("orphan_commits", oracle("""select commit_hash, ts, count(distinct file_path) as files, sum(lines_added) as lines_added from changes
where ts >= timestamp '1997-01-01' and commit_hash not in (select commit_hash from changes where linked) group by all""", "changes"))
def _(spark, d):
    return W.orphan_commits(changes(spark, d), _links(spark, d), F.lit("1997-01-01").cast("timestamp_ntz"), None)


@query("linked_commits", oracle("select distinct commit_hash, ts, file_path from changes where linked and work_uid = 3 order by ts desc, commit_hash, file_path limit 20", "changes"))
def _(spark, d):
    return W.linked_commits(_links(spark, d), 3)


@query("board_delete", oracle("select project, status, count(*) as n from work_items where uid % 5 <> 0 group by 1, 2", "work_items"))
def _(spark, d):
    items = work_items(spark, d)
    left = W.deleted(items, items.where("uid % 5 = 0").select("uid"))
    return left.groupBy("project", "status").agg(F.count(F.lit(1)).alias("n"))


@query("kanban", oracle("""select uid, status, priority, case priority when 'critical' then 0 when 'high' then 1 when 'medium' then 2 else 3 end as position, count(distinct commit_hash) as n_commits
from work_items left join changes on work_uid = uid and linked where project = 'p2' group by all""", "work_items", "changes"))
def _(spark, d):
    return W.board(W.filtered(work_items(spark, d), project="p2"), _links(spark, d)).select("uid", "status", "priority", "position", "n_commits")


@query("board_search", oracle("select uid, title from work_items where lower(title) like '%12%' and priority = 'high' and work_type = 'bug'", "work_items"))
def _(spark, d):
    return W.search_board(work_items(spark, d), "12", "high", "bug").select("uid", "title")


@query("items_by_status", oracle("select project, count(*) filter (status = 'open') as open, count(*) filter (status = 'in_progress') as in_progress, count(*) filter (status = 'closed') as closed from work_items group by project", "work_items"))
def _(spark, d):
    return W.by_status(work_items(spark, d), ["open", "in_progress", "closed"])


@query("urgent_items", oracle("select uid, priority from work_items where status = 'open' and priority = 'critical' union all select uid, priority from work_items where status = 'open' and priority = 'high'", "work_items"))
def _(spark, d):
    open_ = work_items(spark, d).where("status = 'open'").select("uid", "priority")
    return open_.where("priority = 'critical'").unionByName(open_.where("priority = 'high'"))


def _edits(spark, d):
    return work_items(spark, d).where("uid % 11 = 0").select("uid", F.when(F.col("uid") % 2 == 0, "closed").alias("status"), F.when(F.col("uid") % 3 == 0, "critical").alias("priority"))


_EDITS = "with e as (select uid, case when uid % 2 = 0 then 'closed' end as status, case when uid % 3 = 0 then 'critical' end as priority from work_items where uid % 11 = 0)"


@query("update_items", oracle(f"{_EDITS} select w.uid, coalesce(e.status, w.status) as status, coalesce(e.priority, w.priority) as priority from work_items w left join e on e.uid = w.uid", "work_items"))
def _(spark, d):
    return W.updated(work_items(spark, d), _edits(spark, d), ["status", "priority"]).select("uid", "status", "priority")


@query("audit_events", oracle(f"""{_EDITS} select w.uid, 'status' as field, w.status as old, e.status as new from work_items w join e on e.uid = w.uid where e.status is not null and e.status <> w.status
union all select w.uid, 'priority', w.priority, e.priority from work_items w join e on e.uid = w.uid where e.priority is not null and e.priority <> w.priority""", "work_items"))
def _(spark, d):
    return W.audit(work_items(spark, d), _edits(spark, d))


def _queue(spark, d):
    w = work_items(spark, d)
    failed = F.col("uid") % 4 == 1
    return w.select("uid", "priority", "created_at", F.when(F.col("uid") % 4 == 0, "pending").when(failed, "failed").otherwise("completed").alias("status"), (F.col("uid") % 5).alias("retry_count"), F.when(failed, F.col("created_at")).alias("failed_at"))


_QUEUE = "with q as (select uid, priority, created_at, case uid % 4 when 0 then 'pending' when 1 then 'failed' else 'completed' end as status, uid % 5 as retry_count, case when uid % 4 = 1 then created_at end as failed_at from work_items)"


@query("queue_pending", oracle(f"{_QUEUE} select uid, priority from q where status = 'pending' order by case priority when 'critical' then 0 when 'high' then 1 when 'medium' then 2 else 3 end, created_at, uid limit 25", "work_items"))
def _(spark, d):
    return W.pending(_queue(spark, d), 25).select("uid", "priority")


@query("retry_queue", oracle(f"{_QUEUE} select uid, retry_count, pow(5, retry_count)::double as delay_minutes, failed_at + to_minutes(pow(5, retry_count)::int) as next_retry from q where status = 'failed' and retry_count < 3 and failed_at + to_minutes(pow(5, retry_count)::int) <= timestamp '1996-01-01'", "work_items"))
def _(spark, d):
    return W.due(W.retry_times(_queue(spark, d)), F.lit("1996-01-01").cast("timestamp_ntz")).select("uid", "retry_count", "delay_minutes", "next_retry")


@query("dead_letters", oracle(f"{_QUEUE} select retry_count, count(*) as n from q where status = 'failed' and retry_count >= 3 group by 1", "work_items"))
def _(spark, d):
    return W.dead(_queue(spark, d)).groupBy("retry_count").agg(_n())


@query("idempotent_create", oracle("""with r as (select event_id as seq, user_id, event_type as token0, case when event_id % 5 = 0 then null else user_id || ':' || event_type end as token from events)
select seq, token from r where token is null union all select min(seq), token from r where token is not null and user_id % 7 <> 0 group by token"""))
def _(spark, d):
    e = table(spark, d, "events")
    token = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    rows = e.select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 5 != 0, token).alias("token"))
    old = e.where("user_id % 7 = 0").select(token.alias("token")).distinct()
    return W.idempotent(rows, old).select("seq", "token")


@query("list_conversations", oracle("select conv_id, count(*) as turns, count(*) filter (role = 'user') as queries, min(turn) as first_turn, max(turn) as last_turn from conversations group by conv_id"))
def _(spark, d):
    return W.conversations(table(spark, d, "conversations"))


@query("conversation_context", oracle("select conv_id, turn, text from (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations where role = 'user') where n <= 2"))
def _(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "conversations").where("role = 'user'")
    return c.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("n <= 2").select("conv_id", "turn", "text")


@query("context_rewrite", oracle("""with q as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn desc) as n from conversations where role = 'user')
select conv_id, case when count(*) > 1 then 'Context: ' || string_agg(text, ' | ' order by turn) filter (n > 1) || ' Question: ' || max(text) filter (n = 1) else max(text) end as rewritten from q where n <= 3 group by conv_id"""))
def _(spark, d):
    return W.rewrite(table(spark, d, "conversations"))


@query("conversation_delete", oracle("select conv_id, count(*) as n from conversations where conv_id not in (select conv_id from conversations where turn > 5) group by 1"))
def _(spark, d):
    c = table(spark, d, "conversations")
    return K.without(c, c.where("turn > 5").select("conv_id").distinct(), ["conv_id"]).groupBy("conv_id").agg(_n())


def _snapshot(spark, d):
    docs = table(spark, d, "documents")
    seen = docs.select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    known = seen.where("path % 7 <> 0").withColumn("hash", F.when(F.col("path") % 5 == 0, F.concat(F.lit("x"), "hash")).otherwise(F.col("hash")))
    extra = seen.where("path % 50 = 0").select((-F.col("path") - 1).alias("path"), F.lit("gone").alias("hash"))
    return known.unionByName(extra), seen


@query("incremental_diff", oracle("""with seen as (select doc_id as path, sha256(text) as hash from documents),
known as (select path, case when path % 5 = 0 then 'x' || hash else hash end as hash from seen where path % 7 <> 0 union all select -path - 1, 'gone' from seen where path % 50 = 0)
select coalesce(k.path, s.path) as path, case when k.path is null then 'new' when s.path is null then 'deleted' when k.hash <> s.hash then 'changed' else 'same' end as status from known k full join seen s on s.path = k.path"""))
def _(spark, d):
    return K.diff(*_snapshot(spark, d))


@query("deleted_files", oracle("select -doc_id - 1 as path from documents where doc_id % 50 = 0"))
def _(spark, d):
    known, seen = _snapshot(spark, d)
    return known.select("path").join(seen.select("path"), "path", "left_anti")


@query("upsert_nodes", oracle("""select uid, case when uid like 'customer%' then 'moved' else project end as project, name from nodes where label in ('File', 'Class')
union all select 'new:' || r_regionkey, 'moved', r_name from region""", "nodes"))
def _(spark, d):
    n = nodes(spark, d).where(F.col("label").isin("File", "Class")).select("uid", "project", "name")
    fresh = n.where("uid like 'customer%'").withColumn("project", F.lit("moved"))
    more = table(spark, d, "region").select(F.concat(F.lit("new:"), F.col("r_regionkey").cast("string")).alias("uid"), F.lit("moved").alias("project"), F.col("r_name").alias("name"))
    return K.upsert(n, fresh.unionByName(more), ["uid"])


@query("delete_subtree", oracle("""with recursive gone(uid) as (select 'customer:' || c_custkey from customer where c_custkey % 3 = 0 union select dst from edges join gone on src = uid where type = 'DEFINES')
select label, count(*) as n from nodes where uid not in (select uid from gone) group by label""", "nodes", "edges"))
def _(spark, d):
    from .views import edges

    files = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("uid"))
    return K.delete_files(nodes(spark, d), edges(spark, d), files)[0].groupBy("label").agg(_n())


@query("clear_project", oracle("select label, count(*) as n from nodes where project <> 'ASIA' group by label", "nodes"))
def _(spark, d):
    return K.clear_project(nodes(spark, d), "ASIA").groupBy("label").agg(_n())


@query("retention", oracle("select event_type, count(*) as n from events where ts + interval 168 hour > timestamp '2024-02-01' group by 1"))
def _(spark, d):
    return K.retained(table(spark, d, "events"), AS_OF, 168).groupBy("event_type").agg(_n())


@query("active_ttl", oracle("select event_id, (604800 - (epoch(timestamp '2024-02-01') - floor(epoch(ts))))::bigint as seconds_left from events where 604800 - (epoch(timestamp '2024-02-01') - floor(epoch(ts))) > 0"))
def _(spark, d):
    return K.remaining(table(spark, d, "events"), AS_OF, 168).select("event_id", "seconds_left")


@query("vector_sync", oracle("select uid, project, substr(coalesce(docstring, ''), 1, 500) as text from evidence where len(embedding) = 64", "evidence"))
def _(spark, d):
    from .views import evidence

    return K.vector_points(evidence(spark, d), 64).select("uid", "project", "text")


@query("tree_fingerprint", oracle("select sha256(string_agg(doc_id || ':' || n_chars, chr(10) order by doc_id || ':' || n_chars)) as fingerprint from documents"))
def _(spark, d):
    return K.fingerprint(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "n_chars"), "doc_id", "n_chars")


@query("latest_report", oracle("select user_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1"))
def _(spark, d):
    from lodestar.operators.common import latest

    return latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value")
