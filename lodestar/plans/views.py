"""The engine's tables, laid over the star-schema fixtures.

Each view is a DataFrame of (spark, folder); SQL holds the same view as a common table expression for the oracle.
AS_OF stands for "now" everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-02-01 00:00:00"
AS_OF_EPOCH = 1706745600.0
#: Line items that a task makes edges of.
EDGES_A_TASK = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """A small table's rows dealt out, so that costly work on each has a task for every `most` of them and not one for a whole file."""
    return rows.repartition(max(1, -(-rows.count() // most)))


def _uid(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, label, project, name."""
    t = lambda n: table(spark, sf_dir, n)
    region = t("region")
    nation = t("nation").join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    place = F.broadcast(nation.select("n_nationkey", F.col("r_name").alias("project")))
    customer = t("customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = t("orders").join(customer.select("c_custkey", "project"), F.col("o_custkey") == F.col("c_custkey"))

    def part(df, kind, label, key, project, name):
        return df.select(_uid(kind, key).alias("uid"), F.lit(label).alias("label"), F.col(project).alias("project"), name.alias("name"))

    parts = [
        part(region, "region", "Capability", "r_regionkey", "r_name", F.col("r_name")),
        part(nation, "nation", "Feature", "n_nationkey", "r_name", F.col("n_name")),
        part(customer, "customer", "File", "c_custkey", "project", F.col("c_name")),
        part(t("supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey")), "supplier", "Class", "s_suppkey", "project", F.col("s_name")),
        part(t("part"), "part", "Function", "p_partkey", "p_brand", F.col("p_name")),
        part(orders, "order", "Document", "o_orderkey", "project", _uid("order", "o_orderkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, type; distinct."""
    t = lambda n: table(spark, sf_dir, n)

    def edge(df, a, b, kind):
        return df.select(_uid(*a).alias("src"), _uid(*b).alias("dst"), F.lit(kind).alias("type"))

    items = t("lineitem")
    out = edge(t("nation"), ("region", "n_regionkey"), ("nation", "n_nationkey"), "HAS_FEATURE")
    out = out.unionByName(edge(t("customer"), ("nation", "c_nationkey"), ("customer", "c_custkey"), "HAS_ASSET"))
    out = out.unionByName(edge(t("supplier"), ("nation", "s_nationkey"), ("supplier", "s_suppkey"), "HAS_ASSET"))
    out = out.unionByName(edge(t("orders"), ("customer", "o_custkey"), ("order", "o_orderkey"), "DEFINES"))
    # Made distinct as numbers, which is less to hash and to move than as text, in parts of bounded size (counted from the files' footers).
    n = max(1, -(-items.count() // EDGES_A_TASK))
    pairs = lambda a, b: items.select(a, b).repartition(n, a, b).distinct()
    out = out.unionByName(edge(pairs("l_orderkey", "l_partkey"), ("order", "l_orderkey"), ("part", "l_partkey"), "DEPENDS_ON"))
    return out.unionByName(edge(pairs("l_suppkey", "l_partkey"), ("supplier", "l_suppkey"), ("part", "l_partkey"), "CALLS"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of evidence_nodes() and embedding (null without a vector)."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return evidence_nodes(spark, sf_dir).join(vectors, F.col("doc_id") == F.col("vec_id"), "left").drop("vec_id")


def evidence_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, embedding of the documents that have a vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return vectors.join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi").select(_uid("doc", "doc_id").alias("uid"), "embedding")


def evidence_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, doc_id, project, path, name, docstring, label, last_modified."""
    return table(spark, sf_dir, "documents").select(
        _uid("doc", "doc_id").alias("uid"),
        "doc_id",
        F.col("lang").alias("project"),
        F.col("source").alias("path"),
        _uid("doc", "doc_id").alias("name"),
        F.col("text").alias("docstring"),
        F.when(F.col("doc_id") % 2 == 0, "Document").otherwise("Code").alias("label"),
        (F.lit(AS_OF_EPOCH) - (F.col("doc_id") % 200) * 86400.0).alias("last_modified"),
    )


def evidence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source -> document, document -> the document 20 ids on if it has the same source, document -> first of its source and language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    nxt = docs.select((F.col("doc_id") - 20).alias("doc_id"), F.col("source").alias("s2"), F.col("doc_id").alias("to"))
    first = docs.groupBy("source", "lang").agg(F.min("doc_id").alias("to"))
    return (
        docs.select(F.concat(F.lit("src:"), "source").alias("src"), _uid("doc", "doc_id").alias("dst"), F.lit("HAS_ASSET").alias("type"))
        .unionByName(docs.join(nxt, "doc_id").where("source = s2").select(_uid("doc", "doc_id").alias("src"), _uid("doc", "to").alias("dst"), F.lit("DEPENDS_ON").alias("type")))
        .unionByName(docs.join(first, ["source", "lang"]).where("doc_id <> to").select(_uid("doc", "doc_id").alias("src"), _uid("doc", "to").alias("dst"), F.lit("CALLS").alias("type")))
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, project, ts, ms, results, confidence, evidence_count, feedback."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("query_id"),
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("project"),
        "ts",
        (F.col("value") * 10).alias("ms"),
        (F.col("event_id") % 20).alias("results"),
        F.least(F.lit(100.0), F.col("value")).alias("confidence"),
        (F.col("event_id") % 7).alias("evidence_count"),
        F.when(kind == "purchase", "useful").when(kind == "error", "not_useful").when(kind == "view", "partial").alias("feedback"),
    )


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """service, ts, seq, ok, latency."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("service"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"), (F.col("value") * 100).alias("latency")
    )


def work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, project, title, status, priority, work_type, created_at, total."""
    status = F.col("o_orderstatus")
    level = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("uid"),
        F.concat(F.lit("p"), (F.col("o_custkey") % 5).cast("string")).alias("project"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.when(status == "F", "closed").when(status == "O", "open").otherwise("in_progress").alias("status"),
        F.when(level == "1", "critical").when(level == "2", "high").when(level == "3", "medium").otherwise("low").alias("priority"),
        F.when(F.col("o_orderkey") % 3 == 0, "bug").when(F.col("o_orderkey") % 3 == 1, "feature").otherwise("chore").alias("work_type"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("total"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit_hash, file_path, ts, lines_added, work_uid, linked, confidence; a row for each line item."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.col("l_suppkey").cast("string"), F.lit("-"), F.date_format("l_shipdate", "yyyyMMdd")).alias("commit_hash"),
        F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("file_path"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_quantity").alias("lines_added"),
        F.col("l_orderkey").alias("work_uid"),
        (F.col("l_returnflag") != "N").alias("linked"),
        (F.col("l_quantity") / 50).alias("confidence"),
    )


SQL = {
    "nodes": """nodes as (
  select 'region:' || r_regionkey as uid, 'Capability' as label, r_name as project, r_name as name from region
  union all select 'nation:' || n_nationkey, 'Feature', r_name, n_name from nation join region on n_regionkey = r_regionkey
  union all select 'customer:' || c_custkey, 'File', r_name, c_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  union all select 'supplier:' || s_suppkey, 'Class', r_name, s_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  union all select 'part:' || p_partkey, 'Function', p_brand, p_name from part
  union all select 'order:' || o_orderkey, 'Document', r_name, 'order:' || o_orderkey from orders join customer on o_custkey = c_custkey
    join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)""",
    "edges": """edges as (
  select 'region:' || n_regionkey as src, 'nation:' || n_nationkey as dst, 'HAS_FEATURE' as type from nation
  union all select 'nation:' || c_nationkey, 'customer:' || c_custkey, 'HAS_ASSET' from customer
  union all select 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'HAS_ASSET' from supplier
  union all select 'customer:' || o_custkey, 'order:' || o_orderkey, 'DEFINES' from orders
  union all select distinct 'order:' || l_orderkey, 'part:' || l_partkey, 'DEPENDS_ON' from lineitem
  union all select distinct 'supplier:' || l_suppkey, 'part:' || l_partkey, 'CALLS' from lineitem)""",
    "evidence": """evidence as (
  select 'doc:' || doc_id as uid, doc_id, lang as project, source as path, 'doc:' || doc_id as name, text as docstring,
    case when doc_id % 2 = 0 then 'Document' else 'Code' end as label, 1706745600.0::double - (doc_id % 200) * 86400.0::double as last_modified, embedding
  from documents left join embeddings on vec_id = doc_id)""",
    "evidence_edges": """evidence_edges as (
  select 'src:' || source as src, 'doc:' || doc_id as dst, 'HAS_ASSET' as type from documents
  union all select 'doc:' || a.doc_id, 'doc:' || b.doc_id, 'DEPENDS_ON' from documents a join documents b on b.doc_id = a.doc_id + 20 and a.source = b.source
  union all select 'doc:' || d.doc_id, 'doc:' || m, 'CALLS' from documents d join (select source, lang, min(doc_id) as m from documents group by all) f
    on f.source = d.source and f.lang = d.lang where d.doc_id <> m)""",
    "metrics": """metrics as (
  select event_id as query_id, 'p' || (user_id % 3) as project, ts, value * 10 as ms, event_id % 20 as results, least(100.0::double, value) as confidence,
    event_id % 7 as evidence_count, case event_type when 'purchase' then 'useful' when 'error' then 'not_useful' when 'view' then 'partial' end as feedback from events)""",
    "health": "health as (select user_id as service, ts, event_id as seq, event_type <> 'error' as ok, value * 100 as latency from events)",
    "work_items": """work_items as (
  select o_orderkey as uid, 'p' || (o_custkey % 5) as project, 'Order ' || o_orderkey as title,
    case o_orderstatus when 'F' then 'closed' when 'O' then 'open' else 'in_progress' end as status,
    case left(o_orderpriority, 1) when '1' then 'critical' when '2' then 'high' when '3' then 'medium' else 'low' end as priority,
    case o_orderkey % 3 when 0 then 'bug' when 1 then 'feature' else 'chore' end as work_type, o_orderdate as created_at, o_totalprice as total from orders)""",
    "changes": """changes as (
  select l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') as commit_hash, 'part/' || l_partkey as file_path, l_shipdate as ts, l_quantity as lines_added,
    l_orderkey as work_uid, l_returnflag <> 'N' as linked, l_quantity / 50 as confidence from lineitem)""",
}


def oracle(body: str, *views: str) -> str:
    """body with the named views in front. A body that begins with "with" goes on after them."""
    body = body.strip()
    ctes = ", ".join(SQL[v] for v in views)
    if not views:
        return body
    recursive = body.lower().startswith("with recursive")
    if body.lower().startswith("with"):
        body = ", " + body[len("with recursive" if recursive else "with") :].strip()
    return f"with {'recursive ' if recursive else ''}{ctes} {body}"


def values(rows) -> str:
    """Rows as an SQL list of values."""
    cell = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return "(values " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"
