"""Filters and rule tables: search filters, first matching rules, citations, guarded writes, ingestion state."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("LOW", "MEDIUM", "HIGH")


@dataclass(frozen=True)
class SearchFilter:
    """What a search may return; a field that is None asks nothing."""

    types: Sequence[str] | None = None
    repos: Sequence[str] | None = None
    languages: Sequence[str] | None = None
    tags: Sequence[str] | None = None
    since: str | None = None
    until: str | None = None

    def apply(self, rows: DataFrame) -> DataFrame:
        for column, values in (("type", self.types), ("repo", self.repos), ("language", self.languages)):
            if values is not None:
                rows = rows.where(F.col(column).isin(*values))
        if self.tags is not None:
            rows = rows.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in self.tags])))
        if self.since is not None:
            rows = rows.where(F.col("created_at") >= F.lit(self.since).cast("timestamp_ntz"))
        if self.until is not None:
            rows = rows.where(F.col("created_at") <= F.lit(self.until).cast("timestamp_ntz"))
        return rows


def at_least(level: str, column: str = "confidence") -> Column:
    """Rows of a confidence level or a higher one."""
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col(column)) > LEVELS.index(level)


@dataclass(frozen=True)
class Rule:
    """service and status may be *; the first rule in order that fits an event names its action."""

    service: str
    status: str
    failures: int
    action: str


def first_rule(events: DataFrame, rules: Sequence[Rule], default: str | None = None) -> DataFrame:
    """events (service, status, failures) with the action of the first rule that fits."""
    action = F
    for r in rules:
        hit = F.col("failures") >= r.failures
        for column, value in (("service", r.service), ("status", r.status)):
            if value != "*":
                hit = hit & (F.col(column).cast("string") == value)
        action = action.when(hit, r.action)
    return events.withColumn("action", action.otherwise(default))


def cited(citations: DataFrame, hits: DataFrame) -> DataFrame:
    """citations (answer_id, path) with the first hit (answer_id, rank, path) whose path contains theirs or lies in it; joined within an answer."""
    short = hits.select("answer_id", "rank", F.col("path").alias("hit_path"))
    both = citations.join(short, "answer_id").where(F.contains("hit_path", "path") | F.contains("path", "hit_path"))
    best = both.groupBy("answer_id", "path").agg(F.min_by("hit_path", "rank").alias("hit_path"))
    return citations.join(best, ["answer_id", "path"], "left")


def excerpts(citations: DataFrame, nodes: DataFrame, most: int = 200) -> DataFrame:
    """citations (answer_id, path) with the first node (answer_id, rank, uid, path, text) whose path contains theirs and
    the beginning of its text; each path counts once an answer, those without a node are left out."""
    asked = citations.select("answer_id", "path").distinct()
    found = nodes.select("answer_id", "rank", "uid", F.col("path").alias("node_path"), F.substring("text", 1, most).alias("excerpt"))
    both = asked.join(found, "answer_id").where(F.contains("node_path", "path"))
    return both.groupBy("answer_id", "path").agg(F.min_by(F.struct("uid", "excerpt"), "rank").alias("x")).select("answer_id", "path", "x.uid", "x.excerpt")


def guarded(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends exist in the edge's own project."""
    own = nodes.select("uid", "project")
    return edges.join(own.withColumnRenamed("uid", "src"), ["src", "project"], "left_semi").join(own.withColumnRenamed("uid", "dst"), ["dst", "project"], "left_semi")


def tenancy(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges (src, dst, type) with what is wrong with their projects: missing, cross, or ok."""
    own = nodes.select("uid", "project")
    a = edges.join(own.select(F.col("uid").alias("src"), F.col("project").alias("_a")), "src", "left")
    b = a.join(own.select(F.col("uid").alias("dst"), F.col("project").alias("_b")), "dst", "left")
    return b.withColumn("tenancy", F.when(F.col("_a").isNull() | F.col("_b").isNull(), "missing").when(F.col("_a") != F.col("_b"), "cross").otherwise("ok")).drop("_a", "_b")


def ratings(feedback: DataFrame, reports: DataFrame, allowed: Sequence[str] = ("useful", "not_useful", "partial")) -> DataFrame:
    """The feedback that counts: an allowed rating of a report that exists; the last one of each query."""
    good = feedback.where(F.col("rating").isin(*allowed)).join(reports.select("query_id"), "query_id", "left_semi")
    return good.groupBy("query_id").agg(F.max_by("rating", F.struct("ts", "rating")).alias("rating"))


def ingestion(seen: DataFrame, state: DataFrame) -> DataFrame:
    """path, action, errors: what to do with each file, by its hash and what went before; failed adds to its errors."""
    old = state.select("path", F.col("hash").alias("_old"), F.col("errors").alias("_errors"))
    out = seen.join(old, "path", "left")
    action = F.when(F.col("failed"), "error").when(F.col("_old").isNull(), "add").when(F.col("_old") == F.col("hash"), "skip").otherwise("update")
    return out.select("path", action.alias("action"), (F.coalesce("_errors", F.lit(0)) + F.col("failed").cast("int")).alias("errors"))


def ingestion_summary(actions: DataFrame, most: int = 10) -> DataFrame:
    """Counts of each action and the first paths with errors: the smallest `most`, kept by a bounded sort."""
    counts = actions.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    first = actions.where("action = 'error'").orderBy("path").limit(most).agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("error_paths"))
    from .common import with_totals

    return with_totals(counts, first).withColumn("error_paths", F.when(F.col("action") == "error", F.col("error_paths")).otherwise(""))
