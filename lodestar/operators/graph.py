"""Property-graph operators over nodes (uid, label, project, name) and edges (src, dst, type)."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base strength of a relationship type, factors that raise or lower it, symmetric types.
BASE_STRENGTH = {"REFERENCES": 0.7, "DEPENDS_ON": 0.8, "IMPLEMENTS": 0.9, "EXTENDS_CLASS": 0.9, "SUPERSEDES": 0.95, "TESTS": 0.85, "DESCRIBES": 0.75}
FACTORS = {"direct_mention": 1.2, "multiple_occurrences": 1.1, "same_package": 1.15, "explicit_documentation": 1.3, "cross_package": 0.9, "indirect": 0.7, "deprecated": 0.5}
INVERSES = {
    "REFERENCES": "IS_REFERENCED_BY", "RELATED_TO": "RELATED_TO", "EXTENDS": "IS_EXTENDED_BY", "SUPERSEDES": "IS_SUPERSEDED_BY", "DEPENDS_ON": "IS_DEPENDENCY_OF",
    "IMPLEMENTS": "IS_IMPLEMENTED_BY", "EXTENDS_CLASS": "IS_EXTENDED_BY_CLASS", "CALLS": "IS_CALLED_BY", "PRECEDES": "FOLLOWS", "CONCEPT_RELATES": "CONCEPT_RELATES",
    "CONCEPT_SIMILAR": "CONCEPT_SIMILAR", "PART_OF": "HAS_PART", "EXAMPLE_OF": "HAS_EXAMPLE", "DESCRIBES": "IS_DESCRIBED_BY", "TESTS": "IS_TESTED_BY", "CONFIGURES": "IS_CONFIGURED_BY",
}
DEFAULT_STRENGTH = 0.5


def shared_folder(spark: SparkSession) -> str:
    """Where iterative operators write their rounds: spark.checkpoint.dir. Where none is set, a folder of our own in local mode; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: the executors need a shared folder")
        root = tempfile.mkdtemp(prefix="lodestar-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, which ends its lineage."""
    path = f"{shared_folder(df.sparkSession)}/lodestar-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lodestar_path = path
    return out


def forget(*frames: DataFrame | None) -> None:
    """Deletes what cut() wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_lodestar_path", None)
        if path:
            jpath = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)


def resolve(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends exist."""
    ids = nodes.select("uid")
    return edges.join(ids.withColumnRenamed("uid", "src"), "src", "left_semi").join(ids.withColumnRenamed("uid", "dst"), "dst", "left_semi")


def resolve_by_name(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges to a name (project, src, target_name, type) become edges to every node of that name in the project; distinct."""
    named = nodes.select("project", F.col("name").alias("target_name"), F.col("uid").alias("dst"))
    return raw.join(named, ["project", "target_name"]).select("src", "dst", "type").distinct()


def two_hop(edges: DataFrame, first: str, second: str) -> DataFrame:
    """(src, mid, dst) along an edge of one type and then one of another."""
    a = edges.where(F.col("type") == first).select("src", F.col("dst").alias("mid"))
    b = edges.where(F.col("type") == second).select(F.col("src").alias("mid"), "dst")
    return a.join(b, "mid").select("src", "mid", "dst").distinct()


def dependents(edges: DataFrame, type_: str) -> DataFrame:
    """For each target, how many distinct sources point to it."""
    return edges.where(F.col("type") == type_).groupBy("dst").agg(F.countDistinct("src").alias("dependents"))


def relationships(edges: DataFrame, uid: str) -> DataFrame:
    """Edges out of and into one node."""
    out = edges.where(F.col("src") == uid).select(F.lit("out").alias("direction"), "type", F.col("dst").alias("other"))
    return out.unionByName(edges.where(F.col("dst") == uid).select(F.lit("in").alias("direction"), "type", F.col("src").alias("other")))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return resolve(edges, nodes)


def cross_project(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between nodes of different projects."""
    of = nodes.select("uid", "project")
    a = edges.join(of.select(F.col("uid").alias("src"), F.col("project").alias("src_project")), "src")
    b = a.join(of.select(F.col("uid").alias("dst"), F.col("project").alias("dst_project")), "dst")
    return b.where("src_project <> dst_project").select("src", "dst", "type", "src_project", "dst_project")


def bfs(edges: DataFrame, starts: Sequence[str], depth: int = 2, types: Sequence[str] | None = None, directed: bool = False, strength: str | None = None, least: float = 0.0) -> DataFrame:
    """uid, depth and, with a strength column, the strongest path's product, of all that is reached within depth steps.

    Each level joins the frontier with the edges and leaves out what was visited; levels are written out.
    """
    e = edges if types is None else edges.where(F.col("type").isin(*types))
    w = F.col(strength) if strength else F.lit(1.0)
    step = e.select(F.col("src").alias("uid"), F.col("dst").alias("to"), w.alias("w"))
    if not directed:
        step = step.unionByName(e.select(F.col("dst").alias("uid"), F.col("src").alias("to"), w.alias("w")))
    if depth > 1:
        step = cut(step)  # once, not for each level
    spark = edges.sparkSession
    seen = spark.createDataFrame([(s, 0, 1.0) for s in starts], "uid string, depth int, strength double")
    frontier = seen
    for d in range(1, depth + 1):
        reached = frontier.join(step, "uid").select(F.col("to").alias("uid"), (F.col("strength") * F.col("w")).alias("strength")).where(F.col("strength") >= least)
        reached = reached.groupBy("uid").agg(F.max("strength").alias("strength")).join(seen, "uid", "left_anti")
        frontier = cut(reached.select("uid", F.lit(d).alias("depth"), "strength"))
        seen = seen.unionByName(frontier)
    forget(step)
    return seen if strength else seen.drop("strength")


def descendants(edges: DataFrame, roots: DataFrame, types: Sequence[str], longest: int | None = None) -> DataFrame:
    """(root, uid) of all that a root reaches along edges of the types, itself included.

    Levels go on until one finds nothing new; if that takes more than longest levels, where that is given, it is an error.
    """
    step = edges.where(F.col("type").isin(*types)).select(F.col("src").alias("uid"), F.col("dst").alias("to")).distinct()
    seen = frontier = roots.select(F.col("uid").alias("root"), "uid")
    for level in itertools.count(1):
        reached = frontier.join(step, "uid").select("root", F.col("to").alias("uid")).distinct().join(seen, ["root", "uid"], "left_anti")
        frontier = cut(reached)
        if frontier.isEmpty():
            return seen
        if longest is not None and level > longest:
            raise ValueError(f"descendants are more than {longest} levels deep")
        seen = seen.unionByName(frontier)
        if level % 16 == 0:
            seen = cut(seen)


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, stop: float = 1e-6, every: int = 5) -> DataFrame:
    """uid, rank over the largest rank. Multi-edges count; what dangling nodes hold is not handed on.

    Edges are dealt out by source once; ranks are written out every few rounds, where convergence (L1) is looked at too.
    """
    n = nodes.count()
    if n == 0:
        return nodes.select("uid", F.lit(0.0).alias("rank"))
    e = edges.select("src", "dst").join(nodes.select(F.col("uid").alias("src")), "src", "left_semi").join(nodes.select(F.col("uid").alias("dst")), "dst", "left_semi")
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    e = cut(e.join(out, "src").groupBy("src", "dst", "out").agg(F.count(F.lit(1)).alias("m")))
    base = (1 - damping) / n
    ranks = held = cut(nodes.select("uid", F.lit(1.0 / n).alias("rank")))
    for i in range(1, rounds + 1):
        given = e.join(ranks, e["src"] == ranks["uid"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("m") / F.col("out")).alias("got"))
        fresh = ranks.select("uid", F.col("rank").alias("old")).join(given, F.col("uid") == F.col("dst"), "left")
        fresh = fresh.select("uid", "old", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if i % every == 0 or i == rounds:
            fresh = cut(fresh)
            forget(held)
            held = fresh
            if stop and fresh.agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("d")).first()["d"] < stop:
                ranks = fresh.select("uid", "rank")
                break
        ranks = fresh.select("uid", "rank")
    forget(e)
    top = ranks.agg(F.max("rank").alias("m")).first()["m"]
    return ranks.select("uid", (F.col("rank") / F.lit(top)).alias("rank"))


def strengths(edges: DataFrame, flags: Sequence[str] = ()) -> DataFrame:
    """edges with strength: the type's base times the factor of each boolean flag column that is true, 1 at most."""
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in BASE_STRENGTH.items() for x in kv]), F.col("type")), F.lit(DEFAULT_STRENGTH))
    for f in flags:
        base = base * F.when(F.col(f), FACTORS[f]).otherwise(1.0)
    return edges.withColumn("strength", F.least(base, F.lit(1.0)))


def with_inverses(edges: DataFrame) -> DataFrame:
    """edges and, for each of a known type, the edge back under the inverse type; distinct."""
    names = {**INVERSES, **{v: k for k, v in INVERSES.items()}}
    back = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("type"))
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), back.alias("type")).where("type is not null")
    return edges.select("src", "dst", "type").unionByName(turned).distinct()


def nearest_ancestor(paths: DataFrame, known: DataFrame, path: str = "path") -> DataFrame:
    """paths with the longest proper prefix (by '/') that known has, or null: prefixes are exploded and equi-joined."""
    parts = F.split(path, "/")
    prefixes = paths.select(path, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("ancestor"))
    found = prefixes.where(F.col("ancestor") != F.col(path)).join(known.select(F.col(path).alias("ancestor")), "ancestor", "left_semi")
    best = found.groupBy(path).agg(F.max_by("ancestor", F.length("ancestor")).alias("ancestor"))
    return paths.join(best, path, "left")


def within(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str = "line", start: str = "start_line", end: str = "end_line", width: int = 64) -> DataFrame:
    """points with the first span of their keys that holds them (by start, then end), or none.

    Spans are cut into bins of width lines and joined by bin, so the join is an equi-join and long files don't make all pairs.
    Of spans with the same keys, start and end only the least can be the first, so one of each goes into the join.
    """
    told = [c for c in spans.columns if c not in (*keys, start, end)]
    one = [F.min(told[0]).alias(told[0])] if len(told) == 1 else [F.min(F.struct(*told)).alias("_t")] if told else []
    names, grouped = spans.columns, spans.groupBy(*keys, start, end)
    spans = (grouped.agg(*one) if one else spans.select(*keys, start, end).distinct()).select(*[F.col(f"_t.{c}").alias(c) if c in told and len(told) > 1 else F.col(c) for c in names])
    cut_spans = spans.withColumn("_bin", F.explode(F.sequence((F.col(start) / width).cast("long"), (F.col(end) / width).cast("long"))))
    hits = points.withColumn("_bin", (F.col(at) / width).cast("long")).join(cut_spans, [*keys, "_bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end)))
    rest = [c for c in spans.columns if c not in keys]
    best = hits.groupBy(*points.columns).agg(F.min(F.struct(start, end, *[c for c in rest if c not in (start, end)])).alias("_s"))
    found = best.select(*[F.col(c).alias(f"_p_{c}") for c in points.columns], *[F.col(f"_s.{c}").alias(c) for c in rest])
    same = [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in points.columns]
    return points.join(found, same, "left").select(*points.columns, *rest)


def children(edges: DataFrame, parents: DataFrame, types: Sequence[str]) -> DataFrame:
    own = edges.where(F.col("type").isin(*types)).join(parents.select(F.col("uid").alias("src")), "src", "left_semi")
    return own.groupBy("src").agg(F.countDistinct("dst").alias("children"))


def import_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, module) to the file it names: by dotted path first, then by stem (the last file of a stem wins); self-imports go."""
    dotted = files.select(F.regexp_replace(F.regexp_replace("path", r"\.[A-Za-z]+$", ""), "/", ".").alias("module"), F.col("path").alias("target"))
    stem = files.groupBy(F.regexp_extract("path", r"([^/]+)\.[A-Za-z]+$", 1).alias("stem")).agg(F.max("path").alias("by_stem"))
    out = imports.join(dotted, "module", "left").withColumn("stem", F.element_at(F.split("module", r"\."), -1)).join(stem, "stem", "left")
    return out.select("path", "module", F.coalesce("target", "by_stem").alias("target")).where("target is not null and target <> path")


def outline(paths: DataFrame, path: str = "path") -> DataFrame:
    """The lines (path, line) of an outline: each path indented by its depth, in order of path."""
    line = F.concat(F.repeat(F.lit("  "), F.size(F.split(path, "/")) - 1), F.element_at(F.split(path, "/"), -1))
    return paths.select(path, line.alias("line")).orderBy(path)


def path_strengths(edges: DataFrame, starts: Sequence[str], depth: int = 3, strength: str = "strength", least: float = 0.3) -> DataFrame:
    """uid, depth, strength, path, edges of all that is reached: the strongest path to each node and the types of its edges."""
    step = edges.select(F.col("src").alias("uid"), F.col("dst").alias("to"), F.col(strength).alias("w"), "type")
    step = step.unionByName(edges.select(F.col("dst").alias("uid"), F.col("src").alias("to"), F.col(strength).alias("w"), "type"))
    seen = edges.sparkSession.createDataFrame([(s, 0, 1.0, [s], []) for s in starts], "uid string, depth int, strength double, path array<string>, edges array<string>")
    frontier = seen
    for d in range(1, depth + 1):
        reached = frontier.join(step, "uid").select(F.col("to").alias("uid"), (F.col("strength") * F.col("w")).alias("strength"), F.concat("path", F.array("to")).alias("path"), F.concat("edges", F.array("type")).alias("edges"))
        reached = reached.where(F.col("strength") >= least).join(seen.select("uid"), "uid", "left_anti")
        top = F.max(F.struct("strength", "path", "edges")).alias("x")
        frontier = cut(reached.groupBy("uid").agg(top).select("uid", F.lit(d).alias("depth"), "x.strength", "x.path", "x.edges"))
        seen = seen.unionByName(frontier)
    return seen


def named(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose path contains a text, or whose name it is."""
    return nodes.where(F.contains("path", F.lit(text)) | (F.col("name") == text))


def faulted(nodes: DataFrame, faults: DataFrame) -> DataFrame:
    """nodes with faulty: whether a fault's message (project, message) names them as one of its words, in their project."""
    said = faults.select(F.col("project").alias("_p"), F.explode(F.split("message", r"[\s,;]+")).alias("_w")).distinct()
    hit = nodes.join(said, (F.col("project") == F.col("_p")) & (F.col("name") == F.col("_w")), "left_semi").select("uid", F.lit(True).alias("faulty"))
    return nodes.join(hit.distinct(), "uid", "left").withColumn("faulty", F.coalesce("faulty", F.lit(False)))


def shown(nodes: DataFrame, reports: DataFrame) -> DataFrame:
    """Nodes and reports in one table for display, with nulls for what either lacks."""
    return nodes.withColumn("kind", F.lit("node")).unionByName(reports.withColumn("kind", F.lit("report")), allowMissingColumns=True)
