"""Queries: graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import graph as G

from .registry import query
from .views import edges, nodes, oracle, table


def _count(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


@query("list_projects", oracle("select project, count(*) as n from nodes group by project", "nodes"))
def _(spark, d):
    return nodes(spark, d).groupBy("project").agg(_count())


@query("label_counts", oracle("select label, count(*) as n, count(distinct project) as projects from nodes group by label", "nodes"))
def _(spark, d):
    return nodes(spark, d).groupBy("label").agg(_count(), F.countDistinct("project").alias("projects"))


@query("edge_counts", oracle("select type, count(*) as n, count(distinct src) as sources, count(distinct dst) as targets, 2 * count(*) as endpoint_count from edges group by type", "edges"))
def _(spark, d):
    return edges(spark, d).groupBy("type").agg(_count(), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"), (2 * F.count(F.lit(1))).alias("endpoint_count"))


@query("tenant_missing", oracle("select o_orderpriority as name, count(*) as n from orders left join customer on c_custkey = o_custkey and c_acctbal > 0 where c_custkey is null group by 1"))
def _(spark, d):
    rich = table(spark, d, "customer").where("c_acctbal > 0")
    rows = table(spark, d, "orders").join(rich, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.where(F.col("c_custkey").isNull()).groupBy(F.col("o_orderpriority").alias("name")).agg(_count())


@query("structural_search", oracle("select uid, label, name from nodes where (name like '%Supplier%' or name like '%an%') and label in ('Class', 'Function') order by uid limit 100", "nodes"))
def _(spark, d):
    n = nodes(spark, d).where(F.col("label").isin("Class", "Function") & (F.col("name").contains("Supplier") | F.col("name").contains("an")))
    return n.select("uid", "label", "name").orderBy("uid").limit(100)


@query("resolve_edges", oracle("select type, count(*) as n from edges e where exists (select 1 from nodes where uid = src) and exists (select 1 from nodes where uid = dst) group by type", "nodes", "edges"))
def _(spark, d):
    return G.resolve(edges(spark, d), nodes(spark, d)).groupBy("type").agg(_count())


@query("resolve_by_name", oracle("""with raw as (select 'order:' || o_orderkey as src, r_name as project, n_name as target_name, 'CALLS' as type from orders join customer on c_custkey = o_custkey
  join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey)
select distinct src, uid as dst, raw.type from raw join nodes on nodes.project = raw.project and nodes.name = target_name""", "nodes"))
def _(spark, d):
    place = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    raw = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"))
    raw = raw.select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("src"), F.col("r_name").alias("project"), F.col("n_name").alias("target_name"), F.lit("CALLS").alias("type"))
    return G.resolve_by_name(raw, nodes(spark, d))


@query("component_map", oracle("""select n.uid, (select count(*) from edges where src = n.uid and type = 'DEFINES') as defines, (select count(*) from edges where dst = n.uid and type = 'HAS_ASSET') as holders
from nodes n where label = 'File'""", "nodes", "edges"))
def _(spark, d):
    e = edges(spark, d)
    files = nodes(spark, d).where("label = 'File'").select("uid")
    defines = e.where("type = 'DEFINES'").groupBy(F.col("src").alias("uid")).agg(_count("defines"))
    holders = e.where("type = 'HAS_ASSET'").groupBy(F.col("dst").alias("uid")).agg(_count("holders"))
    return files.join(defines, "uid", "left").join(holders, "uid", "left").na.fill(0)


@query("two_hop_calls", oracle("select distinct a.src, a.dst as mid, b.dst from edges a join edges b on b.src = a.dst where a.type = 'DEFINES' and b.type = 'DEPENDS_ON'", "edges"))
def _(spark, d):
    return G.two_hop(edges(spark, d), "DEFINES", "DEPENDS_ON")


@query("dependents", oracle("select dst, count(distinct src) as dependents from edges where type = 'DEPENDS_ON' group by dst", "edges"))
def _(spark, d):
    return G.dependents(edges(spark, d), "DEPENDS_ON")


@query("relationships", oracle("select 'out' as direction, type, dst as other from edges where src = 'customer:1' union all select 'in', type, src from edges where dst = 'customer:1'", "edges"))
def _(spark, d):
    return G.relationships(edges(spark, d), "customer:1")


@query("cross_project_edges", oracle("select type, a.project as src_project, b.project as dst_project, count(*) as n from edges join nodes a on a.uid = src join nodes b on b.uid = dst where a.project <> b.project group by all", "nodes", "edges"))
def _(spark, d):
    return G.cross_project(edges(spark, d), nodes(spark, d)).groupBy("type", "src_project", "dst_project").agg(_count())


@query("induced_subgraph", oracle("with s as (select uid from nodes where project = 'ASIA') select src, dst, type from edges where src in (select uid from s) and dst in (select uid from s)", "nodes", "edges"))
def _(spark, d):
    return G.induced(edges(spark, d), nodes(spark, d).where("project = 'ASIA'"))


@query("bfs_depth2", oracle("""with recursive e2 as (select src as uid, dst as to_ from edges where type <> 'DEPENDS_ON' union all select dst, src from edges where type <> 'DEPENDS_ON'),
b(uid, depth) as (select 'nation:1', 0 union select to_, depth + 1 from b join e2 on e2.uid = b.uid where depth < 2)
select uid, min(depth) as depth from b group by uid""", "edges"))
def _(spark, d):
    return G.bfs(edges(spark, d), ["nation:1"], 2, ["HAS_FEATURE", "HAS_ASSET", "DEFINES", "CALLS"])


@query("bfs_strength", oracle("""with recursive e2 as (select src as uid, dst as to_, case type when 'DEPENDS_ON' then 0.8 else 0.5 end::double as w from edges where type in ('DEFINES', 'DEPENDS_ON')),
b(uid, depth, s) as (select 'customer:1', 0, 1.0::double union all select to_, depth + 1, s * w from b join e2 on e2.uid = b.uid where depth < 3 and s * w >= 0.3)
select uid, min(depth) as depth, round(max(s), 6) as strength from b group by uid""", "edges"))
def _(spark, d):
    e = G.strengths(edges(spark, d).where(F.col("type").isin("DEFINES", "DEPENDS_ON")))
    out = G.bfs(e, ["customer:1"], 3, directed=True, strength="strength", least=0.3)
    return out.select("uid", "depth", F.round("strength", 6).alias("strength"))


@query("descendants", oracle("""with recursive r(root, uid) as (select uid, uid from nodes where label = 'Capability'
  union select root, dst from r join edges on src = r.uid where type in ('HAS_FEATURE', 'HAS_ASSET', 'DEFINES'))
select root, count(*) as n from r group by root""", "nodes", "edges"))
def _(spark, d):
    roots = nodes(spark, d).where("label = 'Capability'")
    return G.descendants(edges(spark, d), roots, ["HAS_FEATURE", "HAS_ASSET", "DEFINES"]).groupBy("root").agg(_count())


def _pagerank_sql(rounds: int = 5) -> str:
    steps = ["p0 as (select uid, 1.0::double / n as r from pn, pc)"]
    for i in range(1, rounds + 1):
        steps.append(f"p{i} as (select pn.uid, 0.15::double / n + 0.85::double * coalesce(g, 0) as r from pc, pn left join (select dst, sum(r / o) as g from pe join p{i - 1} on uid = src join po on po.src = pe.src group by dst) x on x.dst = pn.uid)")
    return f"""with pn as (select uid from nodes where label in ('Capability', 'Feature', 'File', 'Class')), pc as (select count(*) as n from pn),
pe as (select src, dst from edges where src in (select uid from pn) and dst in (select uid from pn)), po as (select src, count(*) as o from pe group by src),
{', '.join(steps)} select uid, round(r / (select max(r) from p{rounds}), 6) as rank from p{rounds}"""


@query("pagerank", oracle(_pagerank_sql(), "nodes", "edges"))
def _(spark, d):
    n = nodes(spark, d).where(F.col("label").isin("Capability", "Feature", "File", "Class"))
    return G.pagerank(n, edges(spark, d), rounds=5, stop=0).select("uid", F.round("rank", 6).alias("rank"))


@query("edge_strength", oracle("""select type, round(case type when 'DEPENDS_ON' then 0.8::double else 0.5::double end * case when src like 'order%' then 1.15::double else 1 end, 6) as strength, count(*) as n from edges group by all""", "edges"))
def _(spark, d):
    e = edges(spark, d).withColumn("same_package", F.col("src").startswith("order"))
    return G.strengths(e, ["same_package"]).groupBy("type", F.round("strength", 6).alias("strength")).agg(_count())


@query("inverse_edges", oracle("select type, count(*) as n from (select src, dst, type from edges union select dst, src, case type when 'DEPENDS_ON' then 'IS_DEPENDENCY_OF' else 'IS_CALLED_BY' end from edges where type in ('DEPENDS_ON', 'CALLS')) group by type", "edges"))
def _(spark, d):
    return G.with_inverses(edges(spark, d)).groupBy("type").agg(_count())


_PATHS = "select distinct 'r' || n_regionkey || '/n' || n_nationkey || '/c' || c_custkey as path from customer join nation on n_nationkey = c_nationkey"


def _paths(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/n"), F.col("n_nationkey").cast("string"), F.lit("/c"), F.col("c_custkey").cast("string")).alias("path"))


@query("nearest_ancestor", oracle(f"""with p as ({_PATHS}), k as (select 'r' || n_regionkey as path from nation union select 'r' || n_regionkey || '/n' || n_nationkey from nation where n_nationkey % 2 = 0)
select path, (select k.path from k where p.path like k.path || '/%' order by length(k.path) desc limit 1) as ancestor from p"""))
def _(spark, d):
    n = table(spark, d, "nation")
    r = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    known = n.select(r.alias("path")).union(n.where("n_nationkey % 2 = 0").select(F.concat(r, F.lit("/n"), F.col("n_nationkey").cast("string")))).distinct()
    return G.nearest_ancestor(_paths(spark, d), known)


@query("interval_join", oracle("""with s as (select p_partkey % 50 as f, p_partkey as id, p_partkey % 97 as a, p_partkey % 97 + p_size as b from part),
q as (select distinct l_partkey % 50 as f, l_linenumber * 13 + l_suppkey % 10 as line from lineitem)
select q.f as file, line, (select id from s where s.f = q.f and line between a and b order by a, b, id limit 1) as span_id from q"""))
def _(spark, d):
    p = table(spark, d, "part").select((F.col("p_partkey") % 50).alias("file"), F.col("p_partkey").alias("span_id"), (F.col("p_partkey") % 97).alias("start_line"), (F.col("p_partkey") % 97 + F.col("p_size")).alias("end_line"))
    q = table(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("file"), (F.col("l_linenumber") * 13 + F.col("l_suppkey") % 10).alias("line")).distinct()
    return G.within(q, p, ["file"]).select("file", "line", "span_id")


@query("children", oracle("select src, count(distinct dst) as children from edges where type in ('HAS_ASSET', 'DEFINES') and src in (select uid from nodes where label = 'Feature') group by src", "nodes", "edges"))
def _(spark, d):
    return G.children(edges(spark, d), nodes(spark, d).where("label = 'Feature'"), ["HAS_ASSET", "DEFINES"])


@query("import_files", oracle("""with files as (select 'src/m' || p_partkey || '.py' as path from part where p_partkey % 3 <> 0), imports as (select 'src/m' || p_partkey || '.py' as path, case when p_partkey % 2 = 0 then 'src.m' || (p_partkey + 1) else 'm' || (p_partkey + 2) end as module from part)
select imports.path, module, coalesce(a.path, b.path) as target from imports left join files a on replace(replace(a.path, '.py', ''), '/', '.') = module
left join files b on regexp_extract(b.path, '([^/]+)\\.py$', 1) = regexp_extract(module, '([^.]+)$', 1) where coalesce(a.path, b.path) is not null and coalesce(a.path, b.path) <> imports.path"""))
def _(spark, d):
    """Imports of every part; the file of every third one is missing, so some stay unresolved at each size."""
    p = table(spark, d, "part")
    name = lambda k: F.concat(F.lit("src/m"), k.cast("string"), F.lit(".py"))
    k = F.col("p_partkey")
    module = F.when(k % 2 == 0, F.concat(F.lit("src.m"), (k + 1).cast("string"))).otherwise(F.concat(F.lit("m"), (k + 2).cast("string")))
    return G.import_files(p.select(name(k).alias("path"), module.alias("module")), p.where("p_partkey % 3 <> 0").select(name(k).alias("path")))


@query("outline", oracle("with p as (select 'r' || n_regionkey as path from nation union select 'r' || n_regionkey || '/n' || n_nationkey from nation) select path, repeat('  ', len(string_split(path, '/')) - 1) || string_split(path, '/')[-1] as line from p"))
def _(spark, d):
    n = table(spark, d, "nation")
    r = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    return G.outline(n.select(r.alias("path")).union(n.select(F.concat(r, F.lit("/n"), F.col("n_nationkey").cast("string")))).distinct())


@query("graph_totals", oracle("select project, count(*) as n, count(*) filter (label = 'Document') as documents from nodes group by cube(project) having count(*) > 0", "nodes"))
def _(spark, d):
    return nodes(spark, d).cube("project").agg(_count(), F.count(F.when(F.col("label") == "Document", 1)).alias("documents"))


@query("common_projects", oracle("select project from nodes where label = 'File' intersect select project from nodes where label = 'Class'", "nodes"))
def _(spark, d):
    n = nodes(spark, d)
    return n.where("label = 'File'").select("project").intersect(n.where("label = 'Class'").select("project"))
