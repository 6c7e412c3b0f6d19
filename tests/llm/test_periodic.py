"""Periodic runs against a plain search, over sequences of numbers, small documents and the whole fixture."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa

from lodestar.llm import periodic
from lodestar.llm.queries import op12_periodic_runs
from lodestar.llm.shared import documents
from lodestar.llm.textcore import scan

SF = "/root/testdata/sf0.001"
WS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(a, repeats=4, shortest=6):
    """Every period is tried; a stretch counts for its smallest period."""
    found, n = [], len(a)
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if a[i] != a[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and a[i] == a[i + q]:
                i += 1
            size, part = i + q - start, a[start : i + q]
            if size >= max(shortest, repeats * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                found.append((start, size, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_of_random_sequences():
    rng, some = random.Random(3), 0
    for _ in range(1500):
        n, kinds = rng.randint(0, 70), rng.choice([1, 2, 2, 3, 6])
        a = [rng.randrange(kinds) for _ in range(n)]
        if n > 8 and rng.random() < 0.6:
            s = rng.randrange(n)
            p = 1 + (n - s) // rng.randint(3, 10)
            a = [a[i] if i < s else a[s + (i - s) % p] for i in range(n)]
        if n and rng.random() < 0.3:
            a[rng.randrange(n)] = 9
        got = periodic.runs_of(np.array(a, np.int64))
        assert got == plain_runs(a), a
        some += bool(got)
    assert some > 500


def test_a_false_hash_changes_nothing(monkeypatch):
    """With rolling hashes and word hashes that say everything is equal, the words decide."""
    monkeypatch.setattr(periodic._Extensions, "_equal", lambda self, i, j, size: True)
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.randrange(2) for _ in range(rng.randint(0, 50))]
        ext = periodic._Extensions(np.array(a, np.int64))
        for i in range(len(a)):
            for j in range(i + 1, len(a)):
                k = next((k for k in range(len(a) - j) if a[i + k] != a[j + k]), len(a) - j)
                assert ext.ahead(i, j) == k
    w = scan(pa.array(["a b a c", "b"], pa.string()))
    w.hashes[:] = 7
    ids = periodic.word_numbers(w).tolist()
    assert ids[0] == ids[2] and ids[1] == ids[4] and len(set(ids)) == 3


def test_long_periodic_sequences_end():
    began = time.time()
    n = 200_000
    assert periodic.runs_of(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert periodic.runs_of(np.tile(np.arange(777), 200)) == [(0, 777 * 200, 777)]
    fib, more = [0], [0, 1]
    while len(more) < n:
        fib, more = more, more + fib
    assert periodic.runs_of(np.array(more)) == []
    assert time.time() - began < 60


def planted(i, words):
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]


def expected(i, text):
    words = planted(i, WS.findall(text or ""))
    runs = plain_runs(words)
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *top, digest("".join(f"{s},{n},{p}\n" for s, n, p in runs)), digest(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_query_over_the_fixture(spark):
    got = {r["doc_id"]: tuple(r) for r in op12_periodic_runs(spark, SF).collect()}
    rows = documents(spark, SF).select("doc_id", "text").collect()
    assert len(got) == len(rows)
    short = [r for r in rows if len(r["text"] or "") < 12_000]
    assert len(short) > 150
    for r in short:
        assert got[r["doc_id"]] == expected(r["doc_id"], r["text"])
    assert sum(x[1] > 0 for x in got.values()) > 5


def test_edges(spark):
    texts = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "A a A a A a A a", "é é é é é é x", "a b " * 4, "x " + "a b c " * 5 + "a", "w " * 30_000, "a\x0bb\x0ca\rb\na\tb a b"]
    frame = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)] + [(None, "q q q q q q q", "c", 1), (3, "b b b b b b", "c", 1)], "doc_id long, text string, runs string, n_words int")
    got = periodic.find_runs(frame).collect()
    assert len(got) == len(texts) + 2
    plain = {i: plain_runs(WS.findall(t or "")) for i, t in enumerate(texts) if i != 10}
    for r in got:
        runs = [tuple(x) for x in r["runs"]]
        if r["doc_id"] is None:
            assert runs == [(0, 7, 1)] and r["text"] == "q"
        elif r["doc_id"] == 10:
            assert runs == [(0, 30_000, 1)] and r["text"] == "w"
        elif r["doc_id"] == 3:
            assert runs in ([], [(0, 6, 1)])
        else:
            assert runs == plain[r["doc_id"]]
    assert periodic.find_runs(frame.where("doc_id < 0")).count() == 0
    odd = periodic.with_periods(frame.select("doc_id", "text")).collect()
    for r in odd:
        if r["doc_id"] is not None and r["doc_id"] != 3:
            words = WS.findall(texts[r["doc_id"]] or "")
            assert WS.findall(r["text"] or "") == planted(r["doc_id"], words)
