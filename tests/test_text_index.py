"""The inverted index against BM25 over all texts."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestar.operators import search, text_index


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    rows = [(f"d{i:04d}", " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(40)], k=rng.randint(1, 60)))) for i in range(600)]
    rows += [("same", rows[3][1]), ("same", rows[3][1]), ("none", None), ("empty", " .,"), ("é", "É w1 W1-w2"), ("long", "w7 w8 " * 20_000)]
    return spark.createDataFrame(rows, "uid string, docstring string").repartition(3)


@pytest.fixture(scope="module")
def index(spark, texts):
    out = text_index.TextIndex(spark, fanout=3)
    for i in range(4):
        out.add(texts.where(f"pmod(hash(docstring), 4) = {i}"))
    return out


def rounded(frame):
    return [(r["uid"], round(r["score"], 6)) for r in frame.collect()]


@pytest.mark.parametrize("query, k", [("w0 w1", 20), ("w30 W31 w32!", 50), ("w7 w8 w39", 5), ("w0", 1), ("nowhere w35", 300), ("w12 w12", 1000)])
def test_rows_equal_a_scan(texts, index, query, k):
    assert rounded(index.search(query, k)) == rounded(search.bm25(texts, query, k).where("score > 0"))


def test_segments_are_merged_by_size_and_reopened(spark, index):
    assert index.segments == [(1, 3), (4, 4)]
    again = text_index.TextIndex(spark, index.folder, fanout=3)
    assert again.segments == index.segments
    assert rounded(again.search("w3 w9", 10)) == rounded(index.search("w3 w9", 10))


def test_other_buckets_and_blocks_are_not_read(spark, texts, index, monkeypatch):
    plan = index.postings(["w0", "w1"])._jdf.queryExecution().executedPlan().toString()
    buckets = {x for found in re.findall(r"bucket#\d+ IN \(([\d,]+)\)|bucket#\d+ = (\d+)", plan) for x in ",".join(found).split(",") if x}
    assert 1 <= len(buckets) <= 2 and "PartitionFilters" in plan
    monkeypatch.setattr(text_index, "FIRST", 1)
    monkeypatch.setattr(text_index, "FETCHED", 2)
    assert rounded(index.search("w0 w20", 7)) == rounded(search.bm25(texts, "w0 w20", 7))


def test_small_blocks_are_left_out(spark, texts, monkeypatch):
    """With blocks of 8 documents most do not reach the threshold, and the rows are the same."""
    monkeypatch.setattr(text_index, "BLOCK", 8)
    index = text_index.TextIndex(spark)
    index.add(texts)
    assert rounded(index.search("w30 w33", 5)) == rounded(search.bm25(texts, "w30 w33", 5))


def test_empty(spark, texts):
    index = text_index.TextIndex(spark)
    assert index.search("w0").count() == 0
    index.add(texts.where("uid = '-'"))
    assert index.search("w0").count() == 0 and index.search(" ,").count() == 0


def test_postings_are_made_in_blocks_within_a_task(spark, texts, monkeypatch):
    """Blocks of 100 over frames of 7 rows and pieces of 50 characters hold each document's counts; no word by itself is shuffled."""
    monkeypatch.setattr(text_index, "BLOCK", 100)
    monkeypatch.setattr(text_index, "PIECE", 50)
    monkeypatch.setattr(text_index, "HANDED", 3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        index = text_index.TextIndex(spark)
        index.add(texts)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    rows = index.postings(["w0", "w1", "w2", "w39"])
    got = {r["term"]: (r["d"], r["n"], r["m"]) for r in rows.groupBy("term").agg(F.count("*").alias("d"), F.sum("n_docs").alias("n"), F.max("max_tf").alias("m")).collect()}
    split = [re.findall("[a-z0-9]+", (r["docstring"] or "").lower()) for r in texts.collect()]
    for w in ("w0", "w1", "w2", "w39"):
        assert got[w][1:] == (sum(w in t for t in split), max(t.count(w) for t in split)) and got[w][0] <= 7
    assert rounded(index.search("w1 w2", 30)) == rounded(search.bm25(texts, "w1 w2", 30))


def test_equal_texts_are_ordered_by_key(spark):
    """Scores are added up in the order of the terms, whatever order the rows come in, so copies tie to the last bit."""
    rows = [(f"c{i:03d}", "w1 w2 w2 w3 w4 w4 w4 w5 w6 w7") for i in range(60)] + [(f"o{i:03d}", " ".join(f"w{j}" for j in range(1, 8) if i % (j + 1))) for i in range(200)]
    index = text_index.TextIndex(spark)
    for i in range(3):
        index.add(spark.createDataFrame(rows[i::3], "uid string, docstring string").repartition(3))
    found = [r for r in index.search("w7 w1 w4 w6 w2 w3 w5", 300).collect() if r["uid"] < "d"]
    assert len({r["score"] for r in found}) == 1 and [r["uid"] for r in found] == [f"c{i:03d}" for i in range(60)]
