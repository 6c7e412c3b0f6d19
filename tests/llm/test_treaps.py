"""Ranked search over inverted treaps against a plain ranking."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestar.llm import treaps
from lodestar.llm.queries import op13_ranked_search

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=50):
    """(item row, rank, doc_id, score); docs and items are lists of (id, text)."""
    bags = [Counter(terms(t)) for _, t in docs]
    lengths = [sum(b.values()) for b in bags]
    count, total = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for (i, _), bag, n in zip(docs, bags, lengths, strict=True):
            m = 50 + (50 * n * count) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in set(terms(text)) if t in bag)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out


def rows_of(frame):
    return [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect()]


def test_treaps_are_trees_by_document_and_heaps_by_impact():
    rng = np.random.default_rng(1)
    sizes = [1, 2, 5, 400, 3]
    first = np.concatenate([[0], np.cumsum(sizes)])
    docs = np.concatenate([np.sort(rng.choice(1000, n, replace=False)) for n in sizes]).astype(np.int32)
    impacts = rng.integers(1, 6, len(docs))
    left, right, roots = treaps.treap(impacts, docs, first)
    for t, n in enumerate(sizes):
        lo = first[t]
        seen, depth, stack = [], 0, [(int(roots[t]), 0, n - 1, 10**9, 1)]
        while stack:
            i, a, b, most, d = stack.pop()
            assert a <= i <= b and impacts[lo + i] <= most
            seen.append(i)
            depth = max(depth, d)
            if left[lo + i] >= 0:
                stack.append((int(left[lo + i]), a, i - 1, impacts[lo + i], d + 1))
            if right[lo + i] >= 0:
                stack.append((int(right[lo + i]), i + 1, b, impacts[lo + i], d + 1))
        assert sorted(seen) == list(range(n)) and depth < 40


def test_walk_finds_the_best_and_leaves_subtrees_out():
    rng = np.random.default_rng(2)
    skipped = 0
    for turn in range(60):
        n_docs, n_terms, k = int(rng.integers(1, 300)), int(rng.integers(1, 12)), int(rng.integers(1, 8))
        lists = [np.sort(rng.choice(n_docs, int(rng.integers(1, n_docs + 1)), replace=False)) for _ in range(n_terms)]
        first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        doc = np.concatenate(lists)
        impacts = (1000 / rng.integers(1, 100, len(doc))).astype(np.int64) + 1
        left, right, roots = treaps.treap(impacts, doc, first)
        shift = np.repeat(first[:-1], np.diff(first))
        left, right = np.where(left >= 0, left + shift, -1), np.where(right >= 0, right + shift, -1)
        query = np.sort(rng.integers(0, 3, n_terms))
        weight = rng.integers(1, 50, n_terms)
        best = treaps._Best(np.ones(3, np.int64), k)
        scored = treaps.walk(doc, impacts, left, right, query, roots + first[:-1], weight, n_docs, best)
        got = list(zip(best.query.tolist(), best.score.tolist(), best.doc.tolist(), strict=True))
        want, possible = [], 0
        for q in range(3):
            total = np.zeros(n_docs, np.int64)
            for t in np.flatnonzero(query == q):
                total[lists[t]] += weight[t] * impacts[first[t] : first[t + 1]]
            order = sorted(np.flatnonzero(total).tolist(), key=lambda d: (-total[d], d))
            possible += len(order)
            want += [(q, int(total[d]), d) for d in order[:k]]
        assert got == want, turn
        assert scored <= possible
        skipped += possible - scored
    assert skipped > 1000


@pytest.fixture(scope="module")
def small():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "日本", "x9"]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([5, 20, 63])]) for _ in range(n))
    docs = [(i, text(rng.randint(1, 60))) for i in range(220)]
    docs += [(500 + i, docs[3][1]) for i in range(60)]
    docs += [(900, None), (901, ""), (902, " ,.; "), (903, "W1-w1_W1"), (3, "a repeated id w1"), (3, "a repeated id w1"), (None, "w1 w2"), (904, "w5 " * 20_000)]
    items = [("a", text(12)), ("b", text(25)), ("none", None), ("empty", " ;"), ("unknown", "nowhere"), ("c", "w1 W1 É"), ("d", docs[3][1])]
    return docs, items


@pytest.mark.parametrize("block, shard", [(8 << 20, 8192), (200, 16)])
def test_ranking(spark, small, monkeypatch, block, shard):
    """With one shard and block, and with many of both, so that thresholds pass from shard to shard."""
    docs, items = small
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, score int").repartition(3)
    asked = spark.createDataFrame(items, "item_id string, text string")
    monkeypatch.setattr(treaps, "BLOCK_BYTES", block)
    count, total = treaps.corpus_counts(frame)
    bags = [terms(t) for _, t in docs]
    assert (count, total) == (sum(map(bool, bags)), sum(map(len, bags)))
    if shard == 8192:
        assert sorted(rows_of(treaps.ranked(frame, asked)), key=str) == sorted(plain(docs, items), key=str)
        return
    whole = plain(docs, items, 7)
    index = treaps.build_index(frame.repartition(40), count, total)
    assert index.where("term is null").count() >= 35
    assert index.where("seed").where("term is null").count() > 0
    texts = [t or "" for _, t in items]
    got = [(items[r["query"]][0], r["rank"], r["doc_id"], r["score"]) for r in treaps.search(treaps.staged(index, "index"), count, texts, 7).collect()]
    assert sorted(got, key=str) == sorted(whole, key=str)
    assert sorted(rows_of(treaps.ranked(frame, asked, k=7)), key=str) == sorted(whole, key=str)


def test_empty_tables(spark, small):
    docs, items = (spark.createDataFrame(rows, "i long, text string" if rows is small[0] else "i string, text string") for rows in small)
    docs, items = docs.withColumnRenamed("i", "doc_id"), items.withColumnRenamed("i", "item_id")
    assert treaps.ranked(docs.where("doc_id = -1"), items).count() == 0
    assert treaps.ranked(docs, items.where("item_id = 'q'")).count() == 0


def test_query_over_the_fixture(spark):
    read = lambda name, i: [(r[i], r["text"]) for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]
    out = op13_ranked_search(spark, SF)
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "int", "bigint", "bigint"]
    assert sorted(rows_of(out)) == sorted(plain(read("documents", "doc_id"), read("benchmark", "item_id")))
