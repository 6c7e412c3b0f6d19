"""Best-fit packing by exact-complement hashing.

Only lengths matter to a packing, and there are at most `capacity` of them, so the plan is made from how many pieces
there are of each length: a table of fixed size, whatever the corpus. A sequence begins with the longest piece left.
What fills its gap exactly is looked up among single lengths, sums of two and sums of three; if there is nothing, the
longest piece that fits goes in and the lookup is made for the smaller gap. An exactly filled pattern is used as often
as the counts of its lengths allow, all at once. Lengths for which none is found are left to best fit, longest first.

A plan is a list of patterns with their numbers of sequences. Pieces of one length are numbered over all tasks, and
runs of these numbers are dealt to the patterns, so each piece finds its sequence and offset on its own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import map_arrow, prepare, staged
from .textcore import slices
from .tokens import SLICE, WORD_ENDS, encoder, vocabulary

CAPACITY, END_ID = 4096, 1


class SumIndex:
    """Available counts by length, and for each sum how many pairs of available lengths have it."""

    def __init__(self, counts: np.ndarray) -> None:
        self.left = counts.astype(np.int64).copy()
        self.size = len(counts)
        self.pairs = np.zeros(self.size, np.int64)
        have = np.flatnonzero(self.left)
        for i, a in enumerate(have.tolist()):
            sums = a + (have[i:] if self.left[a] > 1 else have[i + 1 :])
            self.pairs[sums[sums < self.size]] += 1

    def take(self, length: int, n: int) -> None:
        before, after = int(self.left[length]), int(self.left[length]) - n
        if before > 1 >= after and 2 * length < self.size:
            self.pairs[2 * length] -= 1
        self.left[length] = after
        if after == 0:
            others = np.flatnonzero(self.left[: max(0, self.size - length)])
            self.pairs[others + length] -= 1

    def longest(self, limit: int, used: dict[int, int]) -> int:
        """The longest length up to limit of which there is one besides those used; 0 if there is none."""
        for x in np.flatnonzero(self.left[: limit + 1])[::-1].tolist():
            if self.left[x] > used.get(x, 0):
                return x
        return 0

    def single(self, gap: int, used: dict[int, int]) -> tuple[int, ...]:
        return (gap,) if self.left[gap] > used.get(gap, 0) else ()

    def pair(self, gap: int, used: dict[int, int]) -> tuple[int, ...]:
        """Two lengths that sum to gap, the longer one as long as can be."""
        if not self.pairs[gap]:
            return ()
        low = np.arange(1, gap // 2 + 1)
        for b in low[(self.left[low] > 0) & (self.left[gap - low] > 0)].tolist():
            a = gap - b
            if self.left[a] > used.get(a, 0) and self.left[b] > used.get(b, 0) + (a == b):
                return (a, b)
        return ()

    def triple(self, gap: int, used: dict[int, int]) -> tuple[int, ...]:
        """Three lengths that sum to gap, the first as long as can be."""
        high = np.arange(gap - 2, (gap - 1) // 3, -1)
        high = high[(self.left[high] > 0) & (self.pairs[gap - high] > 0)]
        for a in high.tolist():
            if self.left[a] > used.get(a, 0):
                rest = self.pair(gap - a, used | {a: used.get(a, 0) + 1})
                if rest:
                    return (a, *rest)
        return ()

    def exact(self, gap: int, used: dict[int, int]) -> tuple[int, ...]:
        return self.single(gap, used) or self.pair(gap, used) or self.triple(gap, used)


def _exact_patterns(index: SumIndex, capacity: int) -> tuple[list, np.ndarray]:
    """Patterns (length: times) that fill capacity exactly, with how often each is used, and the counts of the lengths set aside."""
    made, aside = [], np.zeros(capacity + 1, np.int64)
    while True:
        first = index.longest(capacity, {})
        if not first:
            return made, aside
        used, gap = {first: 1}, capacity - first
        while gap:
            found = index.exact(gap, used)
            if not found:
                more = index.longest(gap, used)
                if not more:
                    break
                found = (more,)
            for x in found:
                used[x] = used.get(x, 0) + 1
                gap -= x
        if gap:
            aside[first] += index.left[first]
            index.take(first, int(index.left[first]))
            continue
        times = min(int(index.left[x]) // n for x, n in used.items())
        for x, n in used.items():
            index.take(x, n * times)
        made.append((used, times))


def _best_fit(counts: np.ndarray, capacity: int) -> list:
    """Patterns and their numbers by best fit, longest lengths first; sequences alike in their pieces are handled together."""
    open_: dict[int, list[list]] = {}
    for length in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[length])
        while n:
            fits = [g for g in open_ if g >= length]
            gap = min(fits) if fits else capacity
            used, there = open_[gap].pop() if fits else ({}, n)
            if fits and not open_[gap]:
                del open_[gap]
            each = min(gap // length, n)
            times = min(there, n // each)
            n -= each * times
            if fits and there > times:
                open_.setdefault(gap, []).append([used, there - times])
            open_.setdefault(gap - each * length, []).append([{**used, length: each}, times])
    return [(used, times) for group in open_.values() for used, times in group]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (how many pieces of which length a sequence has) and the number of sequences of each; counts[x] pieces have length x."""
    made, aside = _exact_patterns(SumIndex(counts[: capacity + 1]), capacity)
    return made + _best_fit(aside, capacity)


class Places:
    """Where the pieces go: the piece of a length with a number among those of that length has its sequence and offset."""

    def __init__(self, counts: np.ndarray, capacity: int = CAPACITY) -> None:
        self.first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        at, rows, sequence = self.first.tolist(), [], 0
        for used, times in plan(counts, capacity):
            offset = 0
            for x in sorted(used, reverse=True):
                rows.append((at[x], used[x], sequence, offset))
                at[x] += used[x] * times
                offset += x * used[x]
            sequence += times
        rows.sort()
        self.sequences = sequence
        self.begin, self.each, self.base, self.offset = np.array(rows, np.int64).reshape(-1, 4).T.copy()

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = self.first[length] + number
        i = np.searchsorted(self.begin, place, side="right") - 1
        t = place - self.begin[i]
        return self.base[i] + t // self.each[i], self.offset[i] + length * (t % self.each[i])


def pieces_of(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """Pieces of the documents' ids, with the task that made them and their number among that task's pieces of one length."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "doc_tokens", "task", "nth"]

    def cut(batches):
        from pyspark import TaskContext

        tokens, task = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                owner, piece, data, crc, total, length, nth = [], [], [], [], [], [], []
                for d, ids in enumerate(tokens.encode_column(part.column("text"))):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for i, s in enumerate(range(0, len(ids), capacity)):
                        raw = ids[s : s + capacity].tobytes()
                        n = len(raw) // 4
                        owner.append(d)
                        piece.append(i)
                        length.append(n)
                        data.append(raw if with_ids else None)
                        crc.append(zlib.crc32(raw))
                        total.append(len(ids))
                        nth.append(int(seen[n]))
                        seen[n] += 1
                long = lambda x: pa.array(x, pa.int64())
                start = [p * capacity for p in piece]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(long(owner)), pa.array(piece, pa.int32()), long(start), long(length), pa.array(data, pa.binary()), long(crc), long(total), long([task] * len(owner)), long(nth)],
                    names=names,
                )

    return map_arrow(rows, cut, "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, doc_tokens long, task long, nth long")


def pack_best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    Every document is its token ids and end_id. Only longer ones than capacity are cut, into pieces of capacity ids and
    a rest. Sequences hold at most capacity ids, gapless from offset 0. Null and empty texts are the end id alone. Rows
    that repeat an id, or have none, are packed one by one. An empty table gives no piece; other columns are ignored.

    The driver gets one count a length and broadcasts the patterns (a row for each length in each, some thousands; a
    pattern has at most 90 lengths). Pieces of one length, however many, are numbered by task, not sorted together.
    """
    spark = docs.sparkSession
    prepare(spark)
    pieces = staged(pieces_of(docs, path or vocabulary(WORD_ENDS), id_col, text_col, capacity, end_id, with_ids), "pieces")
    made = staged(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for r in made.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    places = spark.sparkContext.broadcast(Places(counts, capacity))

    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    based = made.select(F.col("task").alias("_t"), F.col("length").alias("_l"), F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = pieces.join(based, (F.col("task") == F.col("_t")) & (F.col("length") == F.col("_l")))
    kept = ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "doc_tokens"]
    numbered = numbered.select(*kept, (F.col("_before") + F.col("nth")).alias("number"))

    def deal(batches):
        for batch in batches:
            if len(batch):
                sequence, offset = places.value.find(batch.column("length").to_numpy(), batch.column("number").to_numpy())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return map_arrow(numbered, deal, "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
