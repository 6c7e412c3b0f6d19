"""Connected components of an edge list: minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, staged


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node that each node of the edges (a, b) can reach.

    Labels are written to the shared folder in each round. A round takes the smallest label among a node and
    its neighbours, then that label's own label, so the rounds grow with the logarithm of a path's length.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    both = staged(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).select(F.col("a").alias("node"), "comp"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("low"))
        own = labels.join(near, labels["node"] == near["a"]).select("node", "comp", F.least("comp", "low").alias("low"))
        up = labels.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
        moved = staged(own.join(up, own["low"] == up["_n"], "left").select("node", F.col("comp").alias("old"), F.least("low", F.coalesce("_c", "low")).alias("comp")), "labels")
        changed = moved.where("old <> comp").limit(1).count()
        discard(labels)
        path = moved._lodestar_path
        labels = moved.select("node", "comp")
        labels._lodestar_path = path
        if not changed:
            discard(both)
            return labels
