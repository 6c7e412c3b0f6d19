"""Mutations as new versions: upserts, deletions, diffs, retention. Nothing is changed in place."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import latest
from .graph import descendants


def upsert(current: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """current with the rows of new in place of those of the same keys; of repeated keys in new, any one of the largest row."""
    new = latest(new.select(*current.columns), list(keys), [c for c in current.columns if c not in keys])
    return current.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def diff(known: DataFrame, seen: DataFrame, key: str = "path", digest: str = "hash") -> DataFrame:
    """path, status: new, changed, same or deleted."""
    a, b = known.select(key, F.col(digest).alias("_old")), seen.select(key, F.col(digest).alias("_new"))
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "changed").otherwise("same")
    return a.join(b, key, "full").select(key, status.alias("status"))


def delete_files(nodes: DataFrame, edges: DataFrame, files: DataFrame, types: Sequence[str] = ("DEFINES",)) -> tuple[DataFrame, DataFrame]:
    """nodes and edges without some files and all that they define, directly or not."""
    gone = descendants(edges, files, types).select("uid").distinct()
    left = nodes.join(gone, "uid", "left_anti")
    ends = edges.join(gone.withColumnRenamed("uid", "src"), "src", "left_anti").join(gone.withColumnRenamed("uid", "dst"), "dst", "left_anti")
    return left, ends


def without(rows: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return rows.join(keys, list(on), "left_anti")


def clear_project(rows: DataFrame, project: str) -> DataFrame:
    return rows.where(F.coalesce(F.col("project") != project, F.lit(True)))


def retained(rows: DataFrame, as_of, hours: int, ts: str = "ts") -> DataFrame:
    """Rows that have not expired."""
    return rows.where(F.col(ts) + F.make_dt_interval(hours=F.lit(hours)) > F.lit(as_of).cast("timestamp_ntz"))


def remaining(rows: DataFrame, as_of, hours: int, ts: str = "ts") -> DataFrame:
    """Rows with the seconds that they have left, of those that have any."""
    left = hours * 3600 - (F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col(ts).cast("timestamp")))
    return rows.withColumn("seconds_left", left).where("seconds_left > 0")


def vector_points(nodes: DataFrame, dimension: int, most: int = 500) -> DataFrame:
    """Nodes with a vector of the right size, their text cut short."""
    return nodes.where(F.size("embedding") == dimension).select("uid", "project", "name", F.substring(F.coalesce("docstring", F.lit("")), 1, most).alias("text"), "embedding")


def fingerprint(rows: DataFrame, path: str, version: str) -> DataFrame:
    """One SHA-256 of all path:version lines in order, with line feeds between them.

    Such a hash has one reader by definition: the lines are dealt out by range and stream, sorted, through a single task
    that holds the state of the hash and one batch. No row gives the hash of nothing.
    """

    def digest(batches):
        state, before = hashlib.sha256(), b""
        for batch in batches:
            for x in batch.column(0).to_pylist():
                state.update(before + x.encode())
                before = b"\n"
        yield pa.RecordBatch.from_arrays([pa.array([state.hexdigest()])], names=["fingerprint"])

    line = F.concat_ws(":", F.col(path), F.col(version).cast("string")).alias("line")
    made = rows.select(line).orderBy("line").coalesce(1).mapInArrow(digest, "fingerprint string")
    return made.agg(F.coalesce(F.max("fingerprint"), F.lit(hashlib.sha256().hexdigest())).alias("fingerprint"))


def append_log(rows: DataFrame, folder: str, ts: str = "ts") -> None:
    """Appends JSON lines, a folder a month."""
    rows.withColumn("yyyymm", F.date_format(ts, "yyyyMM")).write.mode("append").partitionBy("yyyymm").json(folder)


def write_project(rows: DataFrame, folder: str) -> None:
    """Overwrites just the projects in rows."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(folder)


def without_prefix(rows: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """Cache entries whose key does not begin with a prefix; null keys stay."""
    return rows.where(~F.coalesce(F.startswith(F.col(key), F.lit(prefix)), F.lit(False)))


def ring(rows: DataFrame, keys: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """The last `most` rows of each key by order."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def health_history(samples: DataFrame, as_of, last: int = 10, latest_seconds: int = 300, history_seconds: int = 3600) -> tuple[DataFrame, DataFrame]:
    """The newest sample (service, ts, seq) of each service if it is not older than latest_seconds, and its last ones within history_seconds."""
    age = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))
    past = F.col("ts") <= F.lit(as_of).cast("timestamp_ntz")  # age is in whole seconds and would let the rest of as_of's second in
    kept = ring(samples.where(past & (age <= history_seconds)), ["service"], ["ts", "seq"], last)
    return ring(kept.where(age <= latest_seconds), ["service"], ["ts", "seq"], 1), kept


def normalised_points(payloads: DataFrame) -> DataFrame:
    """Vector payloads of two dialects (project or project_name, path or file_path, text or content) in one."""
    have = set(payloads.columns)
    first = lambda *names: F.coalesce(*[F.col(n) for n in names if n in have]) if have & set(names) else F.lit(None).cast("string")
    return payloads.select("uid", first("project", "project_name").alias("project"), first("path", "file_path").alias("path"), first("text", "content", "docstring").alias("text"))
