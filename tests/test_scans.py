"""Scans over chunks against windows over whole keys, with one key that holds all rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.operators import scans, windows


@pytest.fixture(scope="module", params=["hot", "many"])
def rows(request, spark):
    rng = random.Random(9)
    key = (lambda: "one") if request.param == "hot" else (lambda: rng.choice(["a", "b", "c", None]))
    data = [(key(), t // 2, i, rng.random() < 0.8, rng.choice([None, 1.0, 5.0, 9.0]), float(rng.randint(0, 50))) for i, t in enumerate(sorted(rng.randint(0, 4000) for _ in range(900)))]
    rng.shuffle(data)
    frame = spark.createDataFrame(data, "service string, s long, seq long, failed boolean, known double, value double")
    return frame.withColumn("ts", F.timestamp_seconds("s")).repartition(3)


def same(got, want, *columns):
    pick = lambda f: sorted(f.select("seq", *columns).collect(), key=lambda r: r["seq"])
    assert pick(got) == pick(want)


def test_running_values(rows):
    order = ["ts", "seq"]
    w = Window.partitionBy("service").orderBy(*order)
    same(scans.running_sum(rows, F.col("value"), "service", order, "x"), rows.withColumn("x", F.sum("value").over(w)), "x")
    same(scans.last_known(rows, "known", "service", order, "x"), rows.withColumn("x", F.last("known", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))), "x")
    same(scans.previous(rows, "known", "service", order, "x"), rows.withColumn("x", F.lag("known").over(w)), "x")
    group = rows.withColumn("g", F.sum((~F.col("failed")).cast("int")).over(w))
    inner = Window.partitionBy("service", "g").orderBy(*order)
    same(windows.run_lengths(rows, F.col("failed"), "service"), group.withColumn("consecutive", F.sum(F.col("failed").cast("long")).over(inner)), "consecutive")
    wide = Window.partitionBy("service").orderBy("s").rangeBetween(-60, 0)
    same(windows.count_over(rows, F.col("failed"), "service", 60), rows.withColumn("count", F.sum(F.col("failed").cast("long")).over(wide)), "count")


def test_islands(rows):
    w = Window.partitionBy("service").orderBy("ts", "seq")
    marked = rows.withColumn("g", F.sum((~F.col("failed")).cast("int")).over(w)).where("failed")
    want = marked.groupBy("service", "g").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("rows")).drop("g")
    assert sorted(map(str, windows.islands(rows, F.col("failed"), "service").collect())) == sorted(map(str, want.collect()))


def test_a_hot_key_lies_in_all_chunks(spark, rows):
    part = scans.chunked(rows, "service", ["ts", "seq"], 8)
    sizes = [r["n"] for r in part.groupBy("_chunk").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) >= 6 and max(sizes) < 0.4 * sum(sizes)
    assert scans.running_sum(rows.limit(0), F.lit(1), "service", ["ts", "seq"], "x").count() == 0
