"""Running values over the ordered rows of a key, however many rows it has.

A window over a key puts the key's rows into one task. Here rows are dealt by ranges of (key, order), so a hot key lies in
many chunks. A first pass works within chunks and sums each up in a row; a window over these rows, a few for each key,
gives what a chunk gets from those before it; a second pass adds that to the chunk's rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def chunked(rows: DataFrame, key: str, order: Sequence[str], chunks: int | None = None) -> DataFrame:
    """rows with _chunk: ascending ranges of (key, order), written out, so that the ranges stay what they are."""
    n = chunks or max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut(rows.repartitionByRange(n, key, *order).withColumn("_chunk", F.spark_partition_id()))


def within(key: str, order: Sequence[str]):
    """The rows of a key's chunk up to the current one, peers by order left out."""
    return Window.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(key: str):
    """The chunks of a key before the current one."""
    return Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def carried(rows: DataFrame, key: str, sums: Mapping[str, Column], carries: Mapping[str, Column]) -> DataFrame:
    """rows with the carries: columns over before(key) of the chunks' rows, which have key, _chunk and the sums (aggregates)."""
    one = rows.groupBy(key, "_chunk").agg(*[c.alias(n) for n, c in sums.items()])
    given = one.select(F.col(key).alias("_key"), F.col("_chunk").alias("_of"), *[c.alias(n) for n, c in carries.items()])
    return rows.join(given, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_chunk") == F.col("_of"))).drop("_key", "_of")


def running_sum(rows: DataFrame, value: Column, key: str, order: Sequence[str], column: str) -> DataFrame:
    """rows with the sum of value over the key's rows up to each."""
    part = chunked(rows.withColumn("_v", value), key, order)
    out = carried(part, key, {"_s": F.sum("_v")}, {"_carry": F.coalesce(F.sum("_s").over(before(key)), F.lit(0))})
    return out.withColumn(column, F.sum("_v").over(within(key, order)) + F.col("_carry")).drop("_v", "_carry", "_chunk")


def last_known(rows: DataFrame, value: str, key: str, order: Sequence[str], column: str) -> DataFrame:
    """rows with the last value that is not null of the key's rows up to each."""
    part = chunked(rows, key, order)
    known = F.max(F.when(F.col(value).isNotNull(), F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(value).alias("v"))))["v"]
    out = carried(part, key, {"_l": known}, {"_carry": F.last("_l", ignorenulls=True).over(before(key))})
    return out.withColumn(column, F.coalesce(F.last(value, ignorenulls=True).over(within(key, order)), "_carry")).drop("_carry", "_chunk")


def previous(rows: DataFrame, value: str, key: str, order: Sequence[str], column: str) -> DataFrame:
    """rows with the value of the key's row before each (null for the first)."""
    part = chunked(rows, key, order)
    end = F.max(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(value).alias("v")))["v"]
    out = carried(part, key, {"_l": end}, {"_carry": F.last("_l").over(before(key))})
    at = Window.partitionBy(key, "_chunk").orderBy(*order)
    return out.withColumn(column, F.when(F.row_number().over(at) > 1, F.lag(value).over(at)).otherwise(F.col("_carry"))).drop("_carry", "_chunk")


def run_length(rows: DataFrame, failed: Column, key: str, order: Sequence[str], column: str) -> DataFrame:
    """rows with the number of failures in a row up to each (0 on success)."""
    part = chunked(rows.withColumn("_f", failed.cast("long")), key, order)
    part = part.withColumn("_n", F.sum("_f").over(within(key, order)))
    part = part.withColumn("_base", F.max(F.when(F.col("_f") == 0, F.col("_n"))).over(within(key, order)))
    # A chunk with a success hands on its failures after the last one; a chunk without adds its own to what it got.
    sums = {"_all": F.sum("_f"), "_last": F.max(F.when(F.col("_f") == 0, F.col("_n")))}
    total = F.coalesce(F.sum("_all").over(before(key)), F.lit(0))
    through = F.sum("_all").over(Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    one = part.groupBy(key, "_chunk").agg(*[c.alias(n) for n, c in sums.items()])
    # Failures of the key up to its last success in each chunk, counted from the key's start.
    one = one.withColumn("_mark", F.when(F.col("_last").isNotNull(), through - F.col("_all") + F.col("_last")))
    given = one.select(F.col(key).alias("_key"), F.col("_chunk").alias("_of"), (total - F.coalesce(F.last("_mark", ignorenulls=True).over(before(key)), F.lit(0))).alias("_carry"))
    out = part.join(given, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_chunk") == F.col("_of")))
    return out.withColumn(column, F.when(F.col("_base").isNull(), F.col("_n") + F.col("_carry")).otherwise(F.col("_n") - F.col("_base"))).drop("_f", "_n", "_base", "_carry", "_key", "_of", "_chunk")
