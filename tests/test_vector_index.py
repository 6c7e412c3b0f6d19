"""The vector index against a scan of all vectors."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import vector_index as V
from lodestar.plans import registry

SF = "/root/testdata/sf0.1"


def nearest(ids, x, q, k, allowed=None):
    """Ids of the k rows with the greatest cosine to q, equal ones by id."""
    x, q = (v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-30) for v in (x, q))
    s = x @ q
    order = [i for i in np.lexsort((ids, -s)) if (allowed is None or allowed[i]) and x[i].any()]
    return [int(ids[i]) for i in order[:k]]


def by_query(rows, key="vec_id"):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        out[r[0]].append(r[key])
    return out


@pytest.fixture(scope="module")
def clustered(spark):
    """1600 vectors about 24 directions, a third of them the same one, some null, empty and of zeros."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(24, 24))
    x = centres[rng.integers(0, 24, 1600)] + 0.3 * rng.normal(size=(1600, 24))
    x[::3] = centres[0]
    x[7] = 0
    rows = [(i, [float(v) for v in r], i % 5) for i, r in enumerate(x)] + [(5000, None, 1), (5001, [], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, kind int").repartition(4)
    index = V.VectorIndex.create(frame.where("vec_id % 2 = 0 or vec_id >= 5000"), V.index_folder(spark), "vec_id", carry=["kind"], cells=24, rounds=4)
    index.add(frame.where("vec_id % 2 = 1 and vec_id < 5000"))
    return frame, np.arange(1600), x.astype(np.float32), index


def test_recall_over_the_fixture(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(np.float64)
    got = by_query(registry.queries()["vector_index_topk"](spark, SF).collect())
    queries = np.flatnonzero(ids % 100 == 0)
    assert len(got) == len(queries) >= 20
    recall = [len(set(nearest(ids, x, x[q], 50)) & set(got[int(ids[q])])) / 50 for q in queries]
    assert np.mean(recall) >= 0.9
    filtered = by_query(registry.queries()["vector_index_filtered"](spark, SF).collect())
    allowed = (rows["label"] == 3).to_numpy()
    hits, wanted = 0, 0
    for q in queries:
        own = [i for i in nearest(ids, x, x[q], 10, allowed) if x[ids == i][0] @ x[q] / np.linalg.norm(x[ids == i][0]) / np.linalg.norm(x[q]) >= 0.1]
        hits, wanted = hits + len(set(own) & set(filtered[int(ids[q])])), wanted + len(own)
    assert hits >= 0.9 * wanted > 0


def test_few_cells_are_read_and_find_most(spark, clustered):
    frame, ids, x, index = clustered
    some = [i for i in range(1, 1600, 47) if i % 3][:20]
    asked = frame.where(F.col("vec_id").isin(some)).select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    got = by_query(index.search(asked, 10, probes=4).collect())
    assert np.mean([len(set(nearest(ids, x, x[i], 10)) & set(got[i])) / 10 for i in some]) >= 0.9
    probes = index.probes_for(asked, 10, 0.95)
    assert probes <= 6
    one = index.search(asked.limit(1), 5, probes=2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    cells = {c for found in re.findall(r"cell#\d+ IN \(([\d,]+)\)", plan) for c in found.split(",")}
    assert 1 <= len(cells) <= 2 and "PartitionFilters" in plan
    assert len(index.batches) == 2 and len(V.VectorIndex(spark, index.folder).batches) == 2


def test_filters_thresholds_and_odd_vectors(spark, clustered):
    frame, ids, x, index = clustered
    asked = spark.createDataFrame([("a", [float(v) for v in x[1]]), ("zero", [0.0] * 24), ("null", None), ("none", [])], "query string, v array<float>")
    got = index.search(asked, 12, probes=24, refine=1600, where="kind = 2").collect()
    assert {r["query"] for r in got} == {"a"}
    assert by_query(got)["a"] == nearest(ids, x, x[1], 12, ids % 5 == 2)
    high = index.search(asked, 1600, probes=24, refine=1600, minimum=0.9).collect()
    s = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)) @ (x[1] / np.linalg.norm(x[1]))
    assert abs(len(high) - int((s >= 0.9).sum())) <= 2 and all(r["score"] >= 0.9 for r in high)
    assert index.search(asked.where("query = 'null'"), 5).count() == 0


def test_blocks_of_rows_and_queries(spark, clustered, monkeypatch):
    """A crowded cell in many blocks gives the same rows."""
    frame, ids, x, index = clustered
    asked = frame.where("vec_id < 60").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    whole = index.search(asked, 8, probes=3, refine=1600).collect()
    monkeypatch.setattr(V, "CHUNK", 50)
    monkeypatch.setattr(V, "QUERY_CHUNK", 7)
    assert sorted(map(tuple, index.search(asked, 8, probes=3, refine=1600).collect())) == sorted(map(tuple, whole))


def test_a_lost_batch_and_an_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    index = V.VectorIndex.create(rows, str(tmp_path / "a"), "vec_id", cells=2)
    (tmp_path / "a" / "batch-000002" / "codes").mkdir(parents=True)
    again = V.VectorIndex(spark, str(tmp_path / "a"))
    assert again.batches == index.batches == ["batch-000001"]
    again.add(rows.where("vec_id = 2").withColumn("vec_id", F.lit(3).cast("long")))
    asked = spark.createDataFrame([(0, [0.1, 1.0])], "query int, v array<float>")
    assert [r["vec_id"] for r in again.search(asked, 2, probes=2).orderBy("rank").collect()] == [2, 3]
    none = V.VectorIndex.create(rows.where("vec_id > 9"), str(tmp_path / "b"), "vec_id")
    assert none.search(asked, 2).count() == 0


def test_folders_do_not_grow_with_cells_and_small_cells_share_blocks(spark, tmp_path, monkeypatch):
    """150 cells lie in 64 folders; blocks of 60 rows give all rows of the cells asked, a crowded cell in several blocks."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[:90] = x[0]
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    index = V.VectorIndex.create(frame, str(tmp_path / "a"), "vec_id", cells=150, rounds=2)
    assert 0 < len([p for p in (tmp_path / "a" / "batch-000001" / "codes").iterdir() if p.is_dir()]) <= V.GROUPS
    first, blocks = V.VectorIndex._blocks({c: 20 for c in range(150)} | {150: 200_000}, 10)
    assert len({b for c in range(150) for b in blocks[c]}) < 20 and len(blocks[150]) > 1 and not set(blocks[150]) & set(blocks[0])
    monkeypatch.setattr(V, "CHUNK", 60)
    monkeypatch.setattr(V, "HELD", 500)
    asked = frame.where("vec_id % 50 = 7").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    got = by_query(index.search(asked, 9, probes=150, refine=600).collect())
    assert len(got) == 12
    for i, found in got.items():
        assert found == nearest(np.arange(600), x.astype(np.float64), x[i].astype(np.float64), 9)
