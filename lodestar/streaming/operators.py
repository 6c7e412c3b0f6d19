"""Streams of events (key, ts timestamp, seq, ok, value): sessions, limits, rates, duplicates and a circuit breaker.

All take a streaming (or batch) DataFrame with `ts` as timestamp; lateness is bounded by a watermark, so state is too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestar.operators.stateful import Breaker


def source(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream of Parquet files as they arrive; timestamps without zone are read as UTC."""
    out = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return out.withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, gap: str, key: str, late: str) -> DataFrame:
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("fires_at"), "events")


def counts(events: DataFrame, width: str, late: str, by: str, step: str | None = None) -> DataFrame:
    w = F.window("ts", width, step) if step else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(by, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), "n")


def error_ratio(events: DataFrame, width: str, late: str) -> DataFrame:
    w = F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg((~F.col("ok")).cast("double")).alias("error_ratio"))
    return out.select(F.col("w.start").alias("start"), "n", "error_ratio")


def over_limit(events: DataFrame, width: str, limit: int, key: str, late: str) -> DataFrame:
    """Windows in which a key went over its limit, and by how much."""
    return counts(events, width, late, key).where(F.col("n") > limit).withColumn("rejected", F.col("n") - limit)


def first_of(messages: DataFrame, keys: list[str], late: str) -> DataFrame:
    return messages.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def circuit_breaker(events: DataFrame, key: str, failure: int = 5, success: int = 3, reset: float = 30.0) -> DataFrame:
    """events (key, t, seq, ok) with state and rejected; a key's breaker lives in the state store between batches."""
    kind = events.schema[key].dataType.simpleString()

    def walk(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ("closed", 0, 0, 0.0)
        b = Breaker(failure, success, reset, *held)
        frame = pd.concat(list(frames)).sort_values(["t", "seq"], kind="stable")
        steps = [b.step(t, ok) for t, ok in zip(frame["t"], frame["ok"], strict=True)]
        # A breaker as it was at first needs no state, so only keys with failures hold any.
        if b.saved() == Breaker().saved():
            if state.exists:
                state.remove()
        else:
            state.update(b.saved())
        frame["state"] = [s for s, _ in steps]
        frame["rejected"] = [r for _, r in steps]
        yield frame[[key, "t", "seq", "ok", "state", "rejected"]]

    return events.select(key, "t", "seq", "ok").groupBy(key).applyInPandasWithState(
        walk, f"{key} {kind}, t double, seq long, ok boolean, state string, rejected boolean", "state string, failures int, successes int, opened_at double", "append", GroupStateTimeout.NoTimeout
    )


def new_commits(log: DataFrame, late: str) -> DataFrame:
    """A stream of commits (commit_hash, ts, ...), each hash once, however often the log is read again within the watermark."""
    return log.withWatermark("ts", late).dropDuplicatesWithinWatermark(["commit_hash"])


def health_samples(samples: DataFrame, width: str, late: str) -> DataFrame:
    """service, start, checks, healthy, latency of each window of health samples (service, ts, ok, latency)."""
    w = F.window("ts", width)
    out = samples.withWatermark("ts", late).groupBy("service", w.alias("w")).agg(F.count(F.lit(1)).alias("checks"), F.avg(F.col("ok").cast("double")).alias("healthy"), F.max("latency").alias("latency"))
    return out.select("service", F.col("w.start").alias("start"), "checks", "healthy", "latency")


def run(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, with its checkpoint in folder, and returns its result, which lies there too.

    Each micro-batch writes a folder of its own, over what a lost run of it has left, so rows come out once. In complete
    mode the last batch is the whole result.
    """
    spark = df.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = df.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], df.schema)
    out = spark.read.option("basePath", f"{folder}/rows").schema(df.schema.add("batch", "long")).parquet(f"{folder}/rows")
    if mode == "complete":
        last = out.agg(F.max("batch").alias("last"))
        out = out.join(F.broadcast(last), F.col("batch") == F.col("last")).drop("last")
    return out.drop("batch")


def to_folder(df: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
