"""Checks that say how far an answer can be trusted, and the score made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_totals

#: Days, neighbours, days, results.
STALE_DAYS, MIN_NEIGHBOURS, CONTRADICTION_DAYS, MIN_RESULTS = 90, 2, 30, 5
#: Points off for each fault.
PENALTIES = {"STALE_DOC": 15.0, "ORPHANED_NODE": 5.0, "CONTRADICTION": 20.0, "LOW_COVERAGE": 10.0}

_COLUMNS = ("type", "uid", "detail")


def age_days(as_of: float):
    return F.floor((F.lit(as_of) - F.col("last_modified")) / 86400.0)


def stale(results: DataFrame, as_of: float, days: int = STALE_DAYS) -> DataFrame:
    """Documents not changed for more than days; without a date (0 or null) none is checked."""
    rows = results.where((F.col("label") == "Document") & (F.col("last_modified") > 0) & (age_days(as_of) > days))
    return rows.select(F.lit("STALE_DOC").alias("type"), "uid", age_days(as_of).cast("double").alias("detail"))


def orphans(results: DataFrame, least: int = MIN_NEIGHBOURS) -> DataFrame:
    rows = results.where(F.size("neighbors") < least)
    return rows.select(F.lit("ORPHANED_NODE").alias("type"), "uid", F.size("neighbors").cast("double").alias("detail"))


def contradictions(results: DataFrame, as_of: float | None = None, days: int = CONTRADICTION_DAYS) -> DataFrame:
    """Documents with a neighbour among the results whose code is newer by more than days."""
    docs = results.where("label = 'Document' and last_modified > 0").select("uid", "last_modified", F.explode("neighbors").alias("near"))
    code = results.where("label = 'Code' and last_modified > 0").select(F.col("name").alias("near"), F.col("last_modified").alias("code_time"))
    gap = (F.col("code_time") - F.col("last_modified")) / 86400.0
    rows = docs.join(code, "near").where(gap > days)
    return rows.groupBy("uid").agg(F.max(gap).alias("detail")).select(F.lit("CONTRADICTION").alias("type"), "uid", "detail")


def coverage(results: DataFrame, least: int = MIN_RESULTS) -> DataFrame:
    """One fault without uid if there are too few results."""
    n = results.agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") < least).select(F.lit("LOW_COVERAGE").alias("type"), F.lit(None).cast("string").alias("uid"), F.col("n").cast("double").alias("detail"))


def faults(results: DataFrame, as_of: float) -> DataFrame:
    out = stale(results, as_of)
    for part in (orphans(results), contradictions(results, as_of), coverage(results)):
        out = out.unionByName(part)
    return out


def confidence(found: DataFrame) -> DataFrame:
    """One row: faults and the score, 100 less the penalties and 0 at least."""
    penalty = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PENALTIES.items() for x in kv]), F.col("type")), F.lit(0.0))
    total = F.coalesce(F.sum(penalty), F.lit(0.0))
    return found.agg(F.count(F.lit(1)).alias("faults"), F.greatest(F.lit(0.0), F.lit(100.0) - total).alias("confidence"))


def assess(results: DataFrame, as_of: float) -> DataFrame:
    """results with their own faults and the score of the whole answer."""
    found = faults(results, as_of)
    own = found.where("uid is not null").groupBy("uid").agg(F.array_sort(F.collect_list("type")).alias("faults"))
    total = confidence(found).select("confidence")
    out = results.join(own, "uid", "left").withColumn("faults", F.coalesce("faults", F.array().cast("array<string>")))
    return with_totals(out, total)


def basic(results: DataFrame, as_of: float, days: int = STALE_DAYS) -> DataFrame:
    """The plain variant: a missing date is very old, and only age and neighbours are checked."""
    age = F.floor((F.lit(as_of) - F.coalesce("last_modified", F.lit(0.0))) / 86400.0)
    off = F.when((F.col("label") == "Document") & (age > days), 15.0).otherwise(0.0) + F.when(F.size("neighbors") < 2, 5.0).otherwise(0.0)
    return results.agg(F.greatest(F.lit(0.0), F.lit(100.0) - F.coalesce(F.sum(off), F.lit(0.0))).alias("confidence"), F.count(F.lit(1)).alias("results"))


def answer_confidence(average, citations, structural=None):
    """0.7 average score + 0.1 if the graph has matches + 0.2 citations (full at three); without a graph 0.7 and 0.3."""
    full = F.least(citations / 3.0, F.lit(1.0))
    if structural is None:
        return average * 0.7 + full * 0.3
    return average * 0.7 + F.when(structural, 0.1).otherwise(0.0) + full * 0.2
