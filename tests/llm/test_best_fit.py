"""Best-fit packing: plans against exhaustive search on small cases, pieces and sequences against the library."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np

from lodestar.llm import best_fit
from lodestar.llm.queries import op11_best_fit_packing
from lodestar.llm.shared import documents
from lodestar.llm.tokens import WORD_ENDS, vocabulary

SF = "/root/testdata/sf0.001"


def counted(lengths, capacity):
    return np.bincount(np.array(lengths, np.int64), minlength=capacity + 1)


def fewest(lengths, capacity):
    """The least number of sequences, by branch and bound."""
    best, lengths = [len(lengths)], sorted(lengths, reverse=True)

    def place(i, gaps):
        if len(gaps) >= best[0] and i < len(lengths):
            return
        if i == len(lengths):
            best[0] = min(best[0], len(gaps))
            return
        for g in sorted(set(gaps)):
            if g >= lengths[i]:
                rest = list(gaps)
                rest.remove(g)
                place(i + 1, [*rest, g - lengths[i]])
        place(i + 1, [*gaps, capacity - lengths[i]])

    place(0, [])
    return best[0]


def test_plan_uses_each_piece_once_and_few_sequences():
    rng, more = random.Random(1), 0
    for _ in range(300):
        capacity = rng.choice([10, 16, 30])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 9))]
        made = best_fit.plan(counted(lengths, capacity), capacity)
        assert Counter({x: sum(u.get(x, 0) * t for u, t in made) for u, _ in made for x in u}) == Counter(lengths)
        assert all(t > 0 and sum(x * n for x, n in u.items()) <= capacity for u, t in made)
        n, best = sum(t for _, t in made), fewest(lengths, capacity)
        assert best <= n <= best + 1
        more += n - best
    assert more < 15


def test_sum_index_stays_right_while_counts_fall():
    rng = random.Random(2)
    for _ in range(60):
        counts = np.array([0] + [rng.choice([0, 0, 1, 2, 5]) for _ in range(24)])
        index = best_fit.SumIndex(counts)
        while index.left.any():
            x = rng.choice(np.flatnonzero(index.left).tolist())
            index.take(x, rng.randint(1, int(index.left[x])))
            left = index.left.tolist()
            for s in range(25):
                pairs = [(a, s - a) for a in range(1, s // 2 + 1) if left[a] and left[s - a] and (2 * a != s or left[a] > 1)]
                assert index.pairs[s] == len(pairs)
                assert bool(index.pair(s, {})) == bool(pairs)
                there = any(a + b + c == s and all(left[x] >= n for x, n in Counter((a, b, c)).items()) for a, b, c in combinations_with_replacement([x for x in range(25) if left[x]], 3))
                got = index.triple(s, {})
                assert bool(got) == there and sum(got) == (s if there else 0)


def test_exact_sums_of_one_two_and_three():
    full = lambda lengths: [t for u, t in best_fit.plan(counted(lengths, 100), 100) if sum(x * n for x, n in u.items()) == 100]
    assert full([70, 30] * 50) == [50]
    assert full([60, 25, 15] * 7) == [7]
    assert full([55, 20, 14, 11] * 3) == [3]
    assert full([50] * 8) == [4]
    assert sum(full([1] * 1000)) == 10


def test_a_plan_does_not_grow_with_the_corpus():
    rng = np.random.default_rng(3)
    counts = np.bincount(rng.geometric(0.002, 20_000).clip(1, 4096), minlength=4097)
    few, many = best_fit.plan(counts), best_fit.plan(counts * 10**7)
    assert len(many) < 4 * len(few)
    bound = -(-int((np.arange(4097) * counts * 10**7).sum()) // 4096)
    assert bound <= sum(t for _, t in many) <= bound * 1.001


def test_places_are_gapless():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 65, 3000)
    places = best_fit.Places(counted(lengths, 64), 64)
    number = np.zeros(len(lengths), np.int64)
    for x in np.unique(lengths):
        number[lengths == x] = np.arange((lengths == x).sum())
    sequence, offset = places.find(lengths, number)
    order = np.lexsort((offset, sequence))
    ends = defaultdict(int)
    for s, o, n in zip(sequence[order].tolist(), offset[order].tolist(), lengths[order].tolist(), strict=True):
        assert ends[s] == o
        ends[s] += n
    assert max(ends.values()) <= 64 and len(ends) == places.sequences


def hold(rows, texts, capacity=4096, end_id=1):
    """The pieces of each row against the library's ids, and the sequences."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary(WORD_ENDS))
    tokenizer.encode_special_tokens = True
    wanted = Counter()
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end_id], "<u4")
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            wanted[(i, k, s, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(n for *_, n, _ in wanted.elements())


def test_query_over_the_fixture(spark):
    texts = [(r["doc_id"], r["text"]) for r in documents(spark, SF).collect()]
    rows = op11_best_fit_packing(spark, SF).collect()
    used, total = hold(rows, texts)
    assert -(-total // 4096) <= used <= -(-total // 4096) + 1
    assert [f.dataType.simpleString() for f in op11_best_fit_packing(spark, SF).schema] == ["bigint", "int", "bigint", "bigint", "bigint", "bigint", "bigint"]


def test_edges(spark):
    texts = [(1, None), (2, ""), (3, " \n"), (4, "word " * 9000), (5, "same text"), (5, "same text"), (None, "no id"), (6, "a b c")] + [(7, "copies of one text")] * 400
    rows = spark.createDataFrame([(i, t, 5, "x") for i, t in texts], "doc_id long, text string, length int, task string").repartition(5)
    out = best_fit.pack_best_fit(rows)
    got = out.collect()
    used, total = hold(got, texts)
    assert used == -(-total // 4096)
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)
    assert best_fit.pack_best_fit(rows.where("doc_id = 99")).count() == 0
