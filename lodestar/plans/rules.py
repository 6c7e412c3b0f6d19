"""Queries: rule tables, rendering, embedding, ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import render as T
from lodestar.functions.embedding import embed, hashing
from lodestar.operators import rules as R

from .registry import query
from .views import changes, edges, health, metrics, nodes, oracle, table, work_items


@query("search_filter", oracle("select doc_id from documents where lang in ('en', 'de') and source in ('src1', 'src2', 'src3') and (lang = 'en' or doc_id % 2 = 0)"))
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("language"), F.col("source").alias("repo"), F.array("lang", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd")).alias("tags"))
    return R.SearchFilter(repos=["src1", "src2", "src3"], languages=["en", "de"], tags=["en", "even"]).apply(rows).select("doc_id")


@query("search_filter_dates", oracle("select uid from work_items where created_at >= timestamp '1996-01-01' and created_at <= timestamp '1996-06-30'", "work_items"))
def _(spark, d):
    return R.SearchFilter(since="1996-01-01", until="1996-06-30").apply(work_items(spark, d)).select("uid")


@query("confidence_levels", oracle("select priority, count(*) as n from work_items where priority in ('high', 'medium') group by 1", "work_items"))
def _(spark, d):
    rows = work_items(spark, d).withColumn("confidence", F.when(F.col("priority") == "critical", "NONE").otherwise(F.upper("priority")))
    return rows.where(R.at_least("MEDIUM")).groupBy("priority").agg(F.count(F.lit(1)).alias("n"))


RULES = (R.Rule("7", "unhealthy", 1, "restart"), R.Rule("*", "unhealthy", 2, "clear_cache"), R.Rule("*", "*", 3, "notify"))


@query("recovery_rules", oracle("""with h as (select service, seq, case when ok then 'healthy' else 'unhealthy' end as status, seq % 4 as failures from health)
select seq, case when service = 7 and status = 'unhealthy' and failures >= 1 then 'restart' when status = 'unhealthy' and failures >= 2 then 'clear_cache' when failures >= 3 then 'notify' end as action from h""", "health"))
def _(spark, d):
    rows = health(spark, d).select("service", "seq", F.when(F.col("ok"), "healthy").otherwise("unhealthy").alias("status"), (F.col("seq") % 4).alias("failures"))
    return R.first_rule(rows, RULES).select("seq", "action")


@query("citation_match", oracle("""with c as (select doc_id as answer_id, 'src' || (doc_id % 7) as path from documents where doc_id % 10 = 0), h as (select doc_id - doc_id % 10 as answer_id, doc_id % 10 as rank, source || '/x' as hit_path from documents)
select c.answer_id, c.path, arg_min(hit_path, rank) as hit_path from c left join h on h.answer_id = c.answer_id and (contains(hit_path, c.path) or contains(c.path, hit_path)) group by all"""))
def _(spark, d):
    docs, i = table(spark, d, "documents"), F.col("doc_id")
    c = docs.where(i % 10 == 0).select(i.alias("answer_id"), F.concat(F.lit("src"), (i % 7).cast("string")).alias("path"))
    h = docs.select((i - i % 10).alias("answer_id"), (i % 10).alias("rank"), F.concat("source", F.lit("/x")).alias("path"))
    return R.cited(c, h)


@query("tenancy_check", oracle("""with e as (select src, dst, type from edges where type in ('DEPENDS_ON', 'DEFINES') union all select 'customer:' || c_custkey, 'nowhere', 'CALLS' from customer)
select type, case when a.project is null or b.project is null then 'missing' when a.project <> b.project then 'cross' else 'ok' end as tenancy, count(*) as n from e left join nodes a on a.uid = src left join nodes b on b.uid = dst group by all""", "nodes", "edges"))
def _(spark, d):
    lost = table(spark, d, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("src"), F.lit("nowhere").alias("dst"), F.lit("CALLS").alias("type"))
    e = edges(spark, d).where(F.col("type").isin("DEPENDS_ON", "DEFINES")).unionByName(lost)
    return R.tenancy(e, nodes(spark, d)).groupBy("type", "tenancy").agg(F.count(F.lit(1)).alias("n"))


@query("guarded_edges", oracle("select type, count(*) as n from edges where exists (select 1 from nodes where uid = src and project = 'ASIA') and exists (select 1 from nodes where uid = dst and project = 'ASIA') group by type", "nodes", "edges"))
def _(spark, d):
    return R.guarded(edges(spark, d).withColumn("project", F.lit("ASIA")), nodes(spark, d)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("feedback_ratings", oracle("with f as (select event_id % 500 as query_id, event_type as rating0, case event_type when 'purchase' then 'useful' when 'error' then 'not_useful' when 'view' then 'partial' else 'bad' end as rating, ts from events) select query_id, arg_max(rating, ts) as rating from f where rating <> 'bad' and query_id % 3 = 0 group by query_id"))
def _(spark, d):
    e, kind = table(spark, d, "events"), F.col("event_type")
    f = e.select((F.col("event_id") % 500).alias("query_id"), F.when(kind == "purchase", "useful").when(kind == "error", "not_useful").when(kind == "view", "partial").otherwise("bad").alias("rating"), "ts")
    return R.ratings(f, e.select(F.col("event_id").alias("query_id")).where("query_id % 3 = 0"))


@query("ingestion_state", oracle("""select doc_id as path, case when doc_id % 13 = 0 then 'error' when doc_id % 7 = 0 then 'add' when doc_id % 5 = 0 then 'update' else 'skip' end as action, case when doc_id % 7 = 0 then 0 else doc_id % 3 end + case when doc_id % 13 = 0 then 1 else 0 end as errors from documents"""))
def _(spark, d):
    i = F.col("doc_id")
    seen = table(spark, d, "documents").select(i.alias("path"), F.sha2("text", 256).alias("hash"), (i % 13 == 0).alias("failed"))
    state = seen.where("path % 7 <> 0").select("path", F.when(F.col("path") % 5 == 0, "old").otherwise(F.col("hash")).alias("hash"), (F.col("path") % 3).alias("errors"))
    return R.ingestion(seen, state)


@query("ingestion_summary", oracle("""with a as (select doc_id as path, case when doc_id % 13 = 0 then 'error' when doc_id % 5 = 0 then 'update' else 'skip' end as action from documents)
select action, count(*) as n, case when action = 'error' then (select string_agg(path::varchar, ',' order by path) from (select path from a where action = 'error' order by path limit 10)) else '' end as error_paths from a group by action"""))
def _(spark, d):
    i = F.col("doc_id")
    return R.ingestion_summary(table(spark, d, "documents").select(i.alias("path"), F.when(i % 13 == 0, "error").when(i % 5 == 0, "update").otherwise("skip").alias("action")))


@query("enriched_queries", oracle("select uid, concat_ws('. ', title, case when uid % 2 = 0 then 'Focus: ' || priority end, 'Scope: ' || project, case when uid % 3 = 0 then 'Goal: ' || status end) as question from work_items", "work_items"))
def _(spark, d):
    k = F.col("uid")
    return work_items(spark, d).select("uid", T.enriched_query(F.col("title"), F.when(k % 2 == 0, F.col("priority")), F.col("project"), F.when(k % 3 == 0, F.col("status"))).alias("question"))


@query("result_status", oracle("select query_id, case when results > 0 and evidence_count > 0 then 'success' when results > 0 or evidence_count > 0 then 'partial' else 'unavailable' end as status from metrics", "metrics"))
def _(spark, d):
    return metrics(spark, d).select("query_id", T.result_status(F.col("results") > 0, F.col("evidence_count") > 0).alias("status"))


@query("answer_insights", oracle("select query_id, concat_ws('; ', case when results > 0 then results || ' code results' end, case when evidence_count > 0 then evidence_count || ' documents' end, case when evidence_count = 0 then 'No document covers this' end, case when confidence < 50 then 'Check the sources: confidence is low' end) as insights from metrics", "metrics"))
def _(spark, d):
    return metrics(spark, d).select("query_id", F.array_join(T.insights(F.col("results"), F.col("evidence_count"), F.col("confidence")), "; ").alias("insights"))


@query("issue_items", oracle("""select uid, '[' || k || '] ' || left(title, 60) as title, title || ' (' || project || ':' || uid || ')' as description, case k when 'TODO' then 'task' else 'bug' end as work_type, case when priority = 'critical' then 'medium' else priority end as priority
from (select *, case when uid % 2 = 0 then 'TODO' else 'FIXME' end as k from work_items)""", "work_items"))
def _(spark, d):
    w = work_items(spark, d)
    kind = F.when(F.col("uid") % 2 == 0, "TODO").otherwise("FIXME")
    return w.select("uid", T.issue_item(kind, F.upper("priority"), F.col("project"), F.col("uid"), F.col("title")).alias("i")).select("uid", "i.*")


@query("external_issues", oracle("""select uid, title, status || chr(10) || chr(10) || '<!-- uid: ' || uid || ' -->' as body, array_to_string(list_sort(list_distinct(['x', case work_type when 'bug' then 'bug' when 'feature' then 'enhancement' else 'chore' end, 'priority:' || priority])), ',') as labels, case when status = 'closed' then 'closed' else 'open' end as state, uid::varchar as found from work_items""", "work_items"))
def _(spark, d):
    w = work_items(spark, d)
    c = F.col
    i = T.external_issue(c("uid").cast("string"), c("title"), c("status"), c("work_type"), c("priority"), c("status"), F.array(F.lit("x")))
    out = w.select("uid", i.alias("i")).select("uid", "i.title", "i.body", F.array_join("i.labels", ",").alias("labels"), "i.state")
    return out.withColumn("found", T.uid_in_body(c("body")))


@query("commit_items", oracle("""select commit_hash, 'Bug (part): ' || 'work on ' || commit_hash as title, 'Commit ' || left(commit_hash, 8) || ' by x' || chr(10) || '- ' || array_to_string(list_slice(list_sort(list(distinct file_path)), 1, 3), chr(10) || '- ') || case when count(distinct file_path) > 3 then chr(10) || '... and ' || (count(distinct file_path) - 3) || ' more' else '' end as description from changes group by commit_hash""", "changes"))
def _(spark, d):
    g = changes(spark, d).groupBy("commit_hash").agg(F.collect_set("file_path").alias("files"))
    return g.select("commit_hash", T.commit_title(F.lit("bug"), F.lit("part"), F.concat(F.lit("work on "), "commit_hash")).alias("title"), T.commit_description(F.col("commit_hash"), F.lit("x"), F.col("files"), 3).alias("description"))


@query("node_labels", oracle("select case when label = 'Capability' then 'Capability' when label in ('Class', 'Function') then 'Code' else 'Node' end as kind, count(*) as n from nodes group by 1", "nodes"))
def _(spark, d):
    labels = F.array_compact(F.array("label", F.when(F.col("label").isin("Class", "Function"), "Code"), F.lit("Node")))
    return nodes(spark, d).groupBy(T.by_label(labels, ("Capability", "Code")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("hash_embeddings", oracle("""with w as (select doc_id, sha256(unnest(list_filter(regexp_split_to_array('search_document: ' || lower(text), '\\s+'), lambda x: x <> ''))) as h from documents where text is not null),
v as (select doc_id, (strpos('0123456789abcdef', substr(h, 1, 1)) - 1) % 4 * 16 + strpos('0123456789abcdef', substr(h, 2, 1)) - 1 as place, sum(case when strpos('13579bdf', substr(h, 10, 1)) > 0 then 1 else -1 end)::double as x from w group by all),
n as (select doc_id, sqrt(sum(x * x)) as n from v group by doc_id) select doc_id, place::int as place, round(x / n, 4) as value from v join n using (doc_id) where x <> 0"""))
def _(spark, d):
    """All components that are not zero."""
    vectors = table(spark, d, "documents").select("doc_id", F.posexplode(embed(F.col("text"), hashing(64), 64)).alias("place", "value"))
    return vectors.where("value <> 0").select("doc_id", "place", F.round(F.col("value").cast("double"), 4).alias("value"))
