"""Benchmark decontamination: n-grams of the benchmark as a broadcast hash set, scanned over the corpus."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .shared import flag_maybe_in, free_names, map_arrow, prepare, staged
from .textcore import ALNUM_SEP, FOLD, cover, ngrams, scan, segments_any, slices

WINDOW = 13
#: Benchmark bytes to a block: a block's 1.3 million windows take 36 MB in a worker (a hash, a digest and an item each),
#: and some 250 MB in the driver while they are made.
BLOCK_BYTES = 8 << 20


def _digest(words: bytes, starts, ends) -> bytes:
    """128 bits of the words, which are already folded."""
    return blake2b(b" ".join([words[a:b] for a, b in zip(starts, ends, strict=True)]), digest_size=16).digest()


def _folded(w) -> bytes:
    return w.buf.tobytes().translate(FOLD.tobytes())


class Windows:
    """All windows of some benchmark items: sorted hashes, digests of the words, and the items that have each."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        """items: (id, text). An item with fewer words than the window is one window; without words, none."""
        self.names = [name for name, _ in items]
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        if not items:
            return
        w = scan(pa.array([t for _, t in items], pa.string()), ALNUM_SEP, FOLD)
        sizes, room, item = np.diff(w.first), w.room(), w.doc_of()
        words, own = _folded(w), np.minimum(sizes, window)[item]
        for k in sorted(set(own.tolist())):
            starts = np.flatnonzero((own == k) & (room >= k))
            keys = ngrams(w.hashes, k)[starts]
            digests = np.array([_digest(words, w.starts[s : s + k], w.ends[s : s + k]) for s in starts.tolist()], "V16")
            order = np.argsort(keys, kind="stable")
            self.by_length[k] = (keys[order], digests[order], item[starts[order]].astype(np.int32))

    def hits(self, w):
        """Which words lie in an occurrence of a window, and (document, item) of the occurrences."""
        hit, pairs, room, docs, words = np.zeros(len(w.hashes), dtype=bool), set(), w.room(), None, b""
        for k, (keys, digests, items) in self.by_length.items():
            g = ngrams(w.hashes, k)
            at = np.searchsorted(keys, g)
            at[at == len(keys)] = 0
            where = np.flatnonzero((keys[at] == g) & (room[: len(g)] >= k))
            if not len(where):
                continue
            if docs is None:
                docs, words = w.doc_of(), _folded(w)
            good = []
            for s in where.tolist():
                lo, hi = int(at[s]), int(np.searchsorted(keys, g[s], side="right"))
                digest = _digest(words, w.starts[s : s + k], w.ends[s : s + k])
                same = [i for i in range(lo, hi) if digests[i].tobytes() == digest]
                if same:
                    good.append(s)
                    pairs.update((int(docs[s]), self.names[items[i]]) for i in same)
            hit |= cover(np.array(good, np.int64), k, len(hit))
        return hit, pairs


def _blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """The benchmark in blocks of about BLOCK_BYTES, each fetched when it is its turn; one block at least."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    n = max(1, -(-int(total) // BLOCK_BYTES))
    for i in range(n):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i)
        yield [(r["id"] or "", r["text"]) for r in part.toLocalIterator()]


def _matched(rows: DataFrame, block: list[tuple[str, str]], window: int, text_col: str, carry: list[str], names: tuple[str, str, str]) -> DataFrame:
    """carry and the named columns of every row, for one broadcast block: how many words, ranges of hit words (flat), items."""
    windows = rows.sparkSession.sparkContext.broadcast(Windows(block, window))
    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry]
    schema = ", ".join([*fields, *(f"`{c}` {kind}" for c, kind in zip(names, ("long", "array<int>", "array<string>"), strict=True))])

    def match(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                w = scan(part.column(text_col), ALNUM_SEP, FOLD)
                hit, pairs = windows.value.hits(w)
                items, spans = [[] for _ in range(len(part))], [[] for _ in range(len(part))]
                for d, name in pairs:
                    items[d].append(name)
                for d in np.flatnonzero(segments_any(w.first, hit)):
                    flags = hit[w.first[d] : w.first[d + 1]].astype(np.int8)
                    spans[d] = np.flatnonzero(np.diff(np.concatenate([[0], flags, [0]]))).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in carry],
                        pa.array(np.diff(w.first), pa.int64()),
                        pa.array(spans, pa.list_(pa.int32())),
                        pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())),
                    ],
                    names=[*carry, *names],
                )

    return map_arrow(rows.select(*dict.fromkeys([*carry, text_col])), match, schema)


def annotate(docs: DataFrame, benchmark: DataFrame, carry: list[str], id_col: str, text_col: str, item_col: str, item_text: str, window: int, names: tuple[str, str, str]) -> DataFrame:
    """carry and the named columns (words, spans, items) of every row of docs.

    The benchmark's first block is broadcast and met in a scan that carries the rows on. Each further block is broadcast
    alone to a scan that keeps its hits only, which are written out and joined to the rows that have any. So no
    broadcast grows with the benchmark, no text is shuffled but those with such hits, and no occurrence is lost.
    """
    blocks = _blocks(benchmark, item_col, item_text)
    first = _matched(docs, next(blocks), window, text_col, list(dict.fromkeys([*carry, id_col, text_col])), names)
    row = lambda i, t: F.xxhash64(F.col(i).cast("string"), F.col(t))
    parts = []
    for block in blocks:
        keyed = docs.select(F.col(id_col).cast("string").alias("i"), row(id_col, text_col).alias("r"), F.col(text_col).alias("t"))
        parts.append(staged(_matched(keyed, block, window, "t", ["i", "r"], ("n", "spans", "items")).where(F.size("spans") > 0), "hits"))
    if not parts:
        return first.select(*carry, *names)
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    union = union.groupBy("i", "r").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.flatten(F.collect_set("items")).alias("items"))
    union = staged(union, "block_hits")
    mark, i, r, spans, items = free_names(first, "_hit", "_i", "_r", "_s", "_t")
    flagged = flag_maybe_in(first, row(id_col, text_col), union.select(F.col("r").alias("key")), union.count(), mark)
    more = union.select(F.col("i").alias(i), F.col("r").alias(r), F.col("spans").alias(spans), F.col("items").alias(items))
    met = flagged.where(mark).join(more, (row(id_col, text_col) == F.col(r)) & F.col(id_col).cast("string").eqNullSafe(F.col(i)), "left")
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    both = F.concat(F.col(names[1]), none(spans, "array<int>"))
    pair = lambda j: F.struct(F.get(both, j * 2).alias("a"), F.get(both, j * 2 + 1).alias("b"))
    each = F.when(F.size(both) > 0, F.array_sort(F.transform(F.sequence(F.lit(0), (F.size(both) / 2).cast("int") - 1), pair))).otherwise(F.array().cast("array<struct<a:int,b:int>>"))
    merged = F.aggregate(
        each,
        F.array().cast("array<int>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1) >= x["a"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.greatest(F.element_at(acc, -1), x["b"])))).otherwise(F.concat(acc, F.array(x["a"], x["b"]))),
    )
    named = F.array_sort(F.array_distinct(F.concat(F.col(names[2]), none(items, "array<string>"))))
    met = met.select(*carry, names[0], merged.alias(names[1]), named.alias(names[2]))
    return flagged.where(~F.col(mark)).select(*carry, *names).unionByName(met)


def _n_hit(spans: str):
    ends = F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0), lambda a, x: a + x)
    return ends.cast("long")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (inside an occurrence of a benchmark window), items, spans, contaminated.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. The windows' hashes are
    broadcast and hits are checked against a 128-bit digest of the words themselves. A benchmark beyond
    BLOCK_BYTES is taken block by block (see annotate), so what is broadcast has a bound.

    Null or empty texts have no words, match nothing and are not contaminated; items without words give no
    window, shorter ones than the window are one; rows of one item id count as one item, null ids as the item "".
    Rows with a repeated or null document id are reported one by one; other columns are ignored. Without benchmark
    rows nothing is hit. contaminated: n_hit > 0 and share * n_hit >= n_words.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = annotate(docs, benchmark, ["doc_id"], "doc_id", "text", item_col, item_text, window, ("n_words", "spans", "items"))
    out = out.select("doc_id", "n_words", _n_hit("spans").alias("n_hit"), "items", "spans")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


@F.pandas_udf(StringType())
def _cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, flat in zip(texts, spans, strict=True):
        if text is None or flat is None or len(flat) == 0:
            out.append(text)
            continue
        w = scan(pa.array([text], pa.string()), ALNUM_SEP, FOLD)
        raw, keep, prev = text.encode(), [], 0
        for a, b in zip(flat[::2], flat[1::2], strict=True):
            keep.append(raw[prev : w.starts[a]])
            prev = w.ends[b - 1]
        out.append(b"".join([*keep, raw[prev:]]).decode())
    return pd.Series(out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = 20, remove: str = "documents") -> DataFrame:
    """docs without contaminated documents or, with remove="spans", with their hit words cut out.

    A span goes with the bytes between its words; the rest of a text is not changed. Null and empty texts, repeats,
    null ids and empty tables as in contamination(); rows are judged one by one. All columns come back as they are,
    whatever their names.
    """
    prepare(docs.sparkSession)
    columns = docs.columns
    n, spans, items = free_names(docs, "_n_words", "_spans", "_items")
    out = annotate(docs, benchmark, columns, id_col, text_col, item_col, item_text, window, (n, spans, items))
    bad = (_n_hit(spans) > 0) & (_n_hit(spans) * share >= F.col(n))
    if remove == "documents":
        return out.where(~bad).select(*columns)
    text = F.when(bad, _cut(F.col(text_col), F.col(spans))).otherwise(F.col(text_col)).alias(text_col)
    return out.select(*[text if c == text_col else F.col(f"`{c}`") for c in columns])
