"""Commit logs, webhook payloads and configuration."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ISSUE = "struct<number:int,title:string,body:string,state:string,labels:array<struct<name:string>>,user:struct<login:string>,created_at:string,html_url:string,merged:boolean>"
PAYLOAD = f"action string, issue {ISSUE}, pull_request {ISSUE}, repository struct<full_name:string>"


def commits(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Commits of an exported log with lines hash|author|epoch|subject|file,file; after `since` (its line left out) if given."""
    raw = spark.read.text(path)
    parts = F.split("value", r"\|", 5)
    out = raw.where("value <> ''").select(
        F.get(parts, F.lit(0)).alias("commit_hash"), F.get(parts, F.lit(1)).alias("author"), F.get(parts, F.lit(2)).cast("long").alias("ts"), F.get(parts, F.lit(3)).alias("message"),
        F.filter(F.split(F.coalesce(F.get(parts, F.lit(4)), F.lit("")), ","), lambda x: x != "").alias("files_changed"),
    )
    if since is None:
        return out
    at = out.where(F.col("commit_hash") == since).agg(F.coalesce(F.max("ts"), F.lit(-1)).alias("_at"))
    return out.withColumn("_one", F.lit(1)).join(F.broadcast(at.withColumn("_one", F.lit(1))), "_one").where("ts > _at").drop("_one", "_at")


def unprocessed(log: DataFrame, done: DataFrame, ignore: str = r"^(Merge|WIP|wip)") -> DataFrame:
    return log.join(done.select("commit_hash"), "commit_hash", "left_anti").where(~F.col("message").rlike(ignore))


def watched(path: Column, patterns: list[str], ignored: list[str]) -> Column:
    """Whether a changed path counts: no ignored directory in it, and one of the patterns (suffixes) at its end."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | path.endswith(p.lstrip("*"))
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in ignored])) & hit


def webhook(events: DataFrame, kind: str = "type", payload: str = "payload") -> DataFrame:
    """type, action, repository, number, title, state, merged, labels, author of issue and pull request events."""
    p = F.from_json(payload, PAYLOAD)
    item = F.when(F.col(kind) == "issues", p["issue"]).when(F.col(kind) == "pull_request", p["pull_request"])
    return events.withColumn("_p", p).withColumn("_i", item).select(
        F.col(kind).alias("type"), F.col("_p.action").alias("action"), F.col("_p.repository.full_name").alias("repository"), F.col("_i.number").alias("number"), F.col("_i.title").alias("title"), F.col("_i.body").alias("body"),
        F.col("_i.state").alias("state"), F.coalesce("_i.merged", F.lit(False)).alias("merged"), F.transform("_i.labels", lambda x: x["name"]).alias("labels"), F.col("_i.user.login").alias("author"),
    )


def issue_change(events: DataFrame) -> DataFrame:
    """What an event does to its work item: the new status, or nothing."""
    status = (
        F.when(F.col("action") == "opened", "open").when(F.col("action") == "reopened", "open").when((F.col("type") == "pull_request") & (F.col("action") == "closed") & F.col("merged"), "completed")
        .when((F.col("type") == "issues") & (F.col("action") == "closed"), "completed").when(F.col("action") == "labeled", "relabeled")
    )
    return events.withColumn("change", status)


def sync_action(items: DataFrame) -> DataFrame:
    """create without an external id, close when done, else update."""
    return items.withColumn("sync", F.when(F.col("external_id").isNull(), "create").when(F.col("status").isin("closed", "completed"), "close").otherwise("update"))


def configuration(defaults: Mapping, file: Mapping | None = None, arguments: Mapping | None = None, prefix: str = "LODESTAR_", env: Mapping[str, str] | None = None) -> dict:
    """Settings by precedence: arguments, environment, file, defaults. Nested settings merge; the environment has them as PREFIX_A__B."""

    def merge(a: Mapping, b: Mapping) -> dict:
        out = dict(a)
        for k, v in b.items():
            out[k] = merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
        return out

    out = merge(defaults, file or {})
    for name, value in (os.environ if env is None else env).items():
        if name.startswith(prefix):
            *path, last = name[len(prefix) :].lower().split("__")
            at = out
            for p in path:
                at = at.setdefault(p, {})
            at[last] = value
    return merge(out, {k: v for k, v in (arguments or {}).items() if v is not None})
