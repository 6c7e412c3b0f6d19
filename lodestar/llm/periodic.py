"""Periodic runs of words, found from Lyndon roots.

A run is a stretch of words with a smallest period q that goes on for REPEATS periods at least and that no neighbouring
word extends. Every run is a repetition of a Lyndon word, and under one of the two orders of words (by number, and the
reverse) that word is the longest Lyndon word at the places in the run where it begins. So a stack is scanned from right
to left under each order; it gives the next smaller suffix of each word, thus the longest Lyndon word there. Those that
repeat at once are extended to both sides.

Suffixes are compared, and roots extended, by the longest common extension (LCE): a few words one by one, then binary
search over a rolling hash, and what the hash says is equal is compared word by word. Words are numbered by their
hashes, and the numbering is checked against the words' bytes, so nothing rests on a hash alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, prepare
from .substring_dedup import kept_texts
from .textcore import U64, Words, _pow_tables, mix64, scan, slices

REPEATS, SHORTEST = 4, 6
#: Words compared one by one before the hashes are asked.
DIRECT = 4
_MASK = (1 << 64) - 1
_CHECKED = 1 << 22


def _same_bytes(w: Words, rep: np.ndarray) -> bool:
    """Whether each word has the bytes of the word rep names, block by block."""
    size = w.ends - w.starts
    if not np.array_equal(size, size[rep]):
        return False
    total = np.concatenate([[0], np.cumsum(size)])
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + _CHECKED, side="right")) - 1)
        part = size[lo:hi]
        inner = np.arange(total[hi] - total[lo]) - np.repeat(total[lo:hi] - total[lo], part)
        if not np.array_equal(w.buf[np.repeat(w.starts[lo:hi], part) + inner], w.buf[np.repeat(w.starts[rep[lo:hi]], part) + inner]):
            return False
        lo = hi
    return True


def word_numbers(w: Words) -> np.ndarray:
    """A number for each word, equal for equal words alone."""
    if not len(w.hashes):
        return np.zeros(0, np.int64)
    _, first, ids = np.unique(w.hashes, return_index=True, return_inverse=True)
    if _same_bytes(w, first[ids]):
        return ids.astype(np.int64)
    raw, seen = w.buf.tobytes(), {}
    return np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True)], np.int64)


class _Extensions:
    """LCE queries over one sequence of numbers."""

    def __init__(self, a: np.ndarray) -> None:
        self.a, self.words, self.n = a, a.tolist(), len(a)
        self.power, _ = _pow_tables(self.n + 1)
        self.total = np.zeros(self.n + 1, U64)
        np.cumsum(mix64(a.astype(U64) + U64(1)) * self.power[: self.n], out=self.total[1:])
        self._list: list[int] | None = None
        #: For a distance d, a stretch lo to hi of places k known to have words[k] == words[k + d], with hi the first that has not.
        self.known: dict[int, tuple[int, int]] = {}

    def _equal(self, i: int, j: int, size: int) -> bool:
        t = self._list
        return (((t[i + size] - t[i]) * int(self.power[j - i]) - t[j + size] + t[j]) & _MASK) == 0

    def _longest(self, fits, limit: int) -> int:
        """The largest size up to limit that fits; what is less fits as well."""
        size = 8
        while size < limit and fits(size):
            size *= 2
        lo, hi = (size // 2 if size > 8 else 0), min(size, limit) + 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if fits(mid) else (lo, mid)
        return lo

    def ahead(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on, i < j."""
        words, n, d = self.words, self.n, j - i
        lo, hi = self.known.get(d, (n, n))
        if lo <= i <= hi:
            return hi - i
        if 0 < lo - i <= 64 and words[i:lo] == words[j : lo + d]:
            self.known[d] = (i, hi)
            return hi - i
        k, limit = 0, n - j
        while k < limit and k < DIRECT and words[i + k] == words[j + k]:
            k += 1
        if k < DIRECT or k == limit:
            return k
        if self._list is None:
            self._list = self.total.tolist()
        size = self._longest(lambda s: self._equal(i, j, s), limit)
        end = i + size
        if i < lo <= end:
            end, size = lo, hi - i
        differ = np.flatnonzero(self.a[i:end] != self.a[j : end + d])
        if len(differ):
            size = int(differ[0])
        self.known[d] = (i, i + size)
        return size

    def behind(self, i: int, j: int) -> int:
        """How many words before i equal those before j, i < j."""
        if self._list is None:
            self._list = self.total.tolist()
        size = self._longest(lambda s: self._equal(i - s, j - s, s), i)
        differ = np.flatnonzero(self.a[i - size : i] != self.a[j - size : j])
        return size - 1 - int(differ[-1]) if len(differ) else size


def next_smaller(words: list[int], ext: _Extensions) -> list[int]:
    """For each place, where the next smaller suffix begins; the stack is the chain of these places."""
    n = len(words)
    after = [n] * n
    for i in range(n - 1, -1, -1):
        x, j = words[i], i + 1
        while j < n:
            y = words[j]
            if x == y:
                same = ext.ahead(i, j)
                if j + same == n or words[i + same] > words[j + same]:
                    break
            elif x > y:
                break
            j = after[j]
        after[i] = j
    return after


def runs_of(a: np.ndarray, repeats: int = REPEATS, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one sequence of numbers, by start and period; repeats is 3 or more."""
    if len(a) < max(shortest, repeats):
        return []
    ext, found = _Extensions(a), set()
    for words in (ext.words, (-a).tolist()):
        at = np.arange(len(a))
        period = np.array(next_smaller(words, ext)) - at
        # A run holds a root with repeats - 1 periods from its first word on.
        reach = (repeats - 1) * period
        at = at[at + reach <= len(a)]
        p, size = period[at], reach[at] - period[at]
        at = at[(ext.total[at + size] - ext.total[at]) * ext.power[p] == ext.total[at + size + p] - ext.total[at + p]]
        last: dict[int, int] = {}
        for i in at.tolist():
            p = int(period[i])
            if i < last.get(p, 0):
                continue
            start, end = i - ext.behind(i, i + p), i + p + ext.ahead(i, i + p)
            last[p] = end - p
            if end - start >= max(shortest, repeats * p):
                found.add((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start and period) and text, the words without repeats joined by one space.

    Words are runs of anything but ASCII white space. A word is dropped if a run has it after the run's first period.
    Each document is one piece of work, in memory in proportion to its own length and time in proportion to its words
    (times a logarithm); there is no shuffle. Null, empty and blank texts have no words, no runs and an empty text.
    Rows that repeat an id, or have none, are judged one by one; an empty table gives no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def emit(batches):
        for batch in batches:
            for part in slices(batch):
                w = scan(part.column("text"))
                ids, keep, each = word_numbers(w), np.ones(len(w.starts), dtype=bool), []
                for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                    found = runs_of(ids[lo:hi])
                    for start, length, period in found:
                        keep[lo + start + period : lo + start + length] = False
                    each.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(w.first), pa.int64()), pa.array(each, kind), pa.array(kept_texts(w, keep), pa.string())],
                    names=["doc_id", "n_words", "runs", "text"],
                )

    return map_arrow(rows, emit, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string")


def with_periods(docs: DataFrame, every: int = 10) -> DataFrame:
    """docs (doc_id, text), where of about one in `every` the words from some place on are a period repeated, the others as they are.

    With h the crc32 of the id's decimal digits, g = h div every and n the number of words: if every divides h, each word
    i >= a becomes word a + (i - a) mod p, where a = g mod n and p = 1 + (n - a) div (3 + g mod 8); the words are joined by
    one space. Texts of null ids and texts without words stay as they are.
    """
    prepare(docs.sparkSession)
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.select("doc_id", "text", F.when(h % every == 0, F.expr(f"crc32(cast(doc_id as string)) div {every}")).alias("g"))

    def emit(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text")
                at = np.flatnonzero(part.column("g").is_valid().to_numpy(zero_copy_only=False))
                if len(at):
                    old, new = texts.take(pa.array(at)), texts.to_pylist()
                    w = scan(old)
                    raw, starts, ends = w.buf.tobytes(), w.starts.tolist(), w.ends.tolist()
                    for k, d in enumerate(at.tolist()):
                        lo, n, g = int(w.first[k]), int(w.first[k + 1] - w.first[k]), part.column("g")[d].as_py()
                        if n:
                            a = g % n
                            p = 1 + (n - a) // (3 + g % 8)
                            words = [raw[s:e] for s, e in zip(starts[lo : lo + a + p], ends[lo : lo + a + p], strict=True)]
                            cycle = words[a:]
                            more = n - a
                            new[d] = b" ".join([*words[:a], *(cycle * (more // len(cycle) + 1))[:more]]).decode() if cycle else new[d]
                    texts = pa.array(new, pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), texts], names=["doc_id", "text"])

    return map_arrow(chosen, emit, "doc_id long, text string")
