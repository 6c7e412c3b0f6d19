"""Small building blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """df with the columns of totals, a global aggregate and so one row, as a broadcast hash join on a constant."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(totals.withColumn("_one", F.lit(1))), "_one").drop("_one")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last version of each key; a partial aggregate, not a window, so a key with many versions is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    top = F.max(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"_v_{c}") for c in rest]))
    return df.groupBy(*keys).agg(top.alias("_x")).select(*keys, *[F.col(f"_x._v_{c}").alias(c) for c in rest]).select(*df.columns)
