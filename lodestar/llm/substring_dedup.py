"""Substring deduplication over a log-structured index of fingerprints.

Every window of 35 words holds one selected fingerprint at least: the hashes of runs of K words are
sampled by the smallest of SPREAD neighbours (winnowing), and K + SPREAD - 1 <= window. Batches of
documents enter the index one after another. A batch's fingerprints become an immutable run, sorted by
fingerprint, which is merge-joined with each run there is; what occurs twice, in the batch or in history,
is noted. FANOUT runs of one level are merged into one of the next, so a fingerprint is written about once a level, and
levels grow with the logarithm of the number of batches. The index stays in its folder for later batches.

A window that holds a fingerprint seen once in all batches is unique. Documents without a repeated fingerprint
have no other windows and are done. The windows left are verified by two independent hashes of all their
words: first whole blocks of neighbouring windows, then, where a block has no equal, window by window.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import complete_folders, delete_folder, discard, flag_maybe_in, key_filter, map_arrow, maybe_in, new_folder, prepare, staged
from .textcore import U64, cover, mix64, ngrams, scan, second_hashes, slices

WINDOW, K, SPREAD, FANOUT = 35, 8, 20, 3
_BASE_B = 0xD6E8FEB86659FD93


def _sliding(x: np.ndarray, n: int, best) -> np.ndarray:
    """best of each n neighbours, by doubling."""
    size = 1
    part = x
    while size * 2 <= n:
        part = best(part[:-size], part[size:])
        size *= 2
    rest = n - size
    return best(part[: len(part) - rest], part[rest:]) if rest else part


def _lowest(w, window: int, k: int, spread: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and the smallest of each spread neighbours within a document (else 0)."""
    grams = ngrams(w.hashes, k)
    low = _sliding(grams, spread, np.minimum)
    low[w.room()[: len(low)] < k + spread - 1] = 0
    return grams, low


def selected(w, window: int = WINDOW, k: int = K, spread: int = SPREAD) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints of documents that have a window."""
    if len(w.hashes) < window:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    grams, low = _lowest(w, window, k, spread)
    padded = np.concatenate([np.zeros(spread - 1, U64), low, np.zeros(spread - 1, U64)])
    high = _sliding(padded, spread, np.maximum)
    at = np.flatnonzero(grams == high[: len(grams)])
    length = np.repeat(np.diff(w.first), np.diff(w.first))
    at = at[length[at] >= window]
    return at, grams[at]


def _candidates(w, known, window: int = WINDOW, k: int = K, spread: int = SPREAD) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows without a unique fingerprint, and for each the next fingerprint's position.

    Only fingerprints that a window's own words select count, since these are selected wherever the words stand.
    """
    at, _ = selected(w, window, k, spread)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, low = _lowest(w, window, k, spread)
    alone = np.zeros(len(low) + 1, np.int64)
    np.cumsum(~known.test(low) & (low != 0), out=alone[1:])
    starts = np.flatnonzero(w.room() >= window)
    starts = starts[alone[starts + window - k - spread + 2] == alone[starts]]
    return starts, at[np.minimum(np.searchsorted(at, starts), len(at) - 1)]


class _Blocks:
    """Neighbouring candidate windows that share the next fingerprint, with hashes of all their words."""

    def __init__(self, w, known) -> None:
        self.starts, nxt = _candidates(w, known)
        # Two hashes of a window from two hashes of its words, 128 bits in all.
        self.a = ngrams(w.hashes, WINDOW)[self.starts] if len(self.starts) else np.zeros(0, U64)
        self.b = ngrams(second_hashes(w), WINDOW, _BASE_B)[self.starts] if len(self.starts) else np.zeros(0, U64)
        new = np.ones(len(self.starts), dtype=bool)
        new[1:] = (np.diff(self.starts) != 1) | (np.diff(nxt) != 0)
        self.head = np.flatnonzero(new)
        self.size = np.diff(np.append(self.head, len(self.starts)))
        tail = self.head + self.size - 1
        # The first and the last window cover all words of a block, as it has fewer windows than a window has words.
        extra = self.size.astype(U64) * U64(0x9E3779B97F4A7C15)
        self.key = mix64(mix64(self.a[self.head] + extra) * U64(3) + mix64(self.a[tail]))
        self.check = mix64(mix64(self.b[self.head] + extra) * U64(5) + mix64(self.b[tail]))


class FingerprintIndex:
    """Immutable runs of (fp, n) in a folder, and the fingerprints found twice.

    A run is a folder run-FIRST-LAST-BUCKETS of Parquet for the batches FIRST to LAST, cut into buckets by fp and sorted
    by fp in each, so a new batch is joined to it bucket by bucket and history is neither shuffled nor written again
    before it is compacted. A folder can be opened again: a run counts once it is complete, and runs that a wider one
    covers do not, so a job that is lost while it appends or compacts leaves a whole index behind. found-BATCH holds
    what a batch showed to be repeated. One job at a time may append.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT, buckets: int | None = None) -> None:
        self.spark, self.fanout, self._names = spark, fanout, []
        self.folder = folder or new_folder(spark, "fingerprint_index")
        names = complete_folders(spark, self.folder)
        found = [re.fullmatch(r"run-(\d+)-(\d+)-(\d+)", x) for x in names]
        spans = [(int(m[1]), int(m[2]), int(m[3])) for m in found if m]
        self.runs = sorted(x for x in spans if not any((y[0] <= x[0] and x[1] <= y[1]) and y[:2] != x[:2] for y in spans))
        self.batches = max((hi for _, hi, _ in self.runs), default=0)
        self.noted = sorted(x for x in names if x.startswith("found-") and int(x.split("-")[1]) <= self.batches)
        self.buckets = self.runs[0][2] if self.runs else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _path(self, run: tuple[int, int, int]) -> str:
        return f"{self.folder}/run-{run[0]:06d}-{run[1]:06d}-{run[2]}"

    def _name(self) -> str:
        self._names.append(f"lodestar_run_{uuid.uuid4().hex}")
        return self._names[-1]

    def _forget(self) -> None:
        """Takes the runs' names out of the catalog; the files stay."""
        for name in self._names:
            self.spark.sql(f"drop table if exists {name}")
        self._names = []

    def _open(self, run: tuple[int, int, int]) -> DataFrame:
        name = self._name()
        self.spark.sql(f"create table {name} (fp bigint, n bigint) using parquet clustered by (fp) sorted by (fp) into {run[2]} buckets location '{self._path(run)}'")
        return self.spark.table(name)

    def _write(self, prints: DataFrame, run: tuple[int, int, int]) -> DataFrame:
        name = self._name()
        summed = prints.repartition(run[2], "fp").groupBy("fp").agg(F.sum("n").alias("n"))
        summed.write.format("parquet").bucketBy(run[2], "fp").sortBy("fp").option("path", self._path(run)).saveAsTable(name)
        return self.spark.table(name)

    def append(self, prints: DataFrame) -> None:
        """Takes a batch's fingerprints (fp, n), and notes those that this batch shows to be repeated."""
        batch = self.batches + 1
        run = (batch, batch, self.buckets)
        try:
            fresh = self._write(prints.select("fp", "n"), run)
            hits = fresh.where("n > 1").select("fp")
            for old in self.runs:
                hits = hits.unionByName(fresh.select("fp").hint("merge").join(self._open(old).select("fp"), "fp"))
            hits.write.parquet(f"{self.folder}/found-{batch:06d}")
        finally:
            self._forget()
        self.noted.append(f"found-{batch:06d}")
        self.runs.append(run)
        self.batches = batch
        self.compact()

    def _level(self, run: tuple[int, int, int]) -> int:
        level, size = 0, run[1] - run[0] + 1
        while size >= self.fanout:
            level, size = level + 1, size // self.fanout
        return level

    def compact(self) -> None:
        """Merges the last FANOUT runs into one for as long as they are of one level."""
        while len(self.runs) >= self.fanout and len({self._level(r) for r in self.runs[-self.fanout :]}) == 1:
            old = self.runs[-self.fanout :]
            # As plain files: a union of bucketed tables is summed bucket by bucket and table by table, that is not at all.
            union = self.spark.read.schema("fp long, n long").parquet(*[self._path(r) for r in old])
            merged = (old[0][0], old[-1][1], self.buckets)
            try:
                self._write(union, merged)
            finally:
                self._forget()
            self.runs = [*self.runs[: -self.fanout], merged]
            for r in old:
                delete_folder(self.spark, self._path(r))

    def repeated(self) -> DataFrame:
        """The fingerprints (fp) that occur twice in all batches."""
        paths = [f"{self.folder}/{x}" for x in self.noted]
        return self.spark.read.schema("fp long").parquet(*paths).distinct() if paths else self.spark.createDataFrame([], "fp long")


def fingerprints(rows: DataFrame) -> DataFrame:
    """(batch, row, fp, n) of rows (text, row, batch): the fingerprints of each document, and how often it has each."""

    def emit(parts):
        for batch in parts:
            for part in slices(batch):
                w = scan(part.column("text"))
                at, fp = selected(w)
                doc = np.searchsorted(w.first, at, side="right") - 1
                order = np.lexsort((fp, doc))
                doc, fp = doc[order], fp[order]
                new = np.ones(len(fp), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (fp[1:] != fp[:-1])
                head = np.flatnonzero(new)
                own = pa.array(doc[head])
                yield pa.RecordBatch.from_arrays(
                    [part.column("batch").take(own), part.column("row").take(own), pa.array(fp[head].view(np.int64)), pa.array(np.diff(np.append(head, len(fp))), pa.int64())],
                    names=["batch", "row", "fp", "n"],
                )

    return map_arrow(rows.select("text", "row", "batch"), emit, "batch int, row long, fp long, n long")


class _Known:
    """The repeated fingerprints of some documents (a list column); any others that they have are not repeated."""

    def __init__(self, lists: pa.Array) -> None:
        self.values = np.unique(lists.flatten().to_numpy(zero_copy_only=False).view(U64))

    def test(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.values):
            return np.zeros(len(keys), dtype=bool)
        at = np.searchsorted(self.values, keys)
        at[at == len(self.values)] = 0
        return self.values[at] == keys


def _emit(rows: DataFrame, make, schema: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def run(parts):
        for batch in parts:
            for part in slices(batch):
                columns = make(part, scan(part.column("text")))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    return map_arrow(rows, run, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 3, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, text: without each word of a window whose words also start anywhere else.

    Words are runs of anything but ASCII white space, unchanged; a window is WINDOW consecutive words of one
    document, and all its occurrences go, judged on the input. The documents enter the index in the given
    number of batches, as a corpus that grows would; the result does not depend on how many.

    With an index, docs are a further batch of a corpus: they are appended to it, and their windows are judged
    against themselves and the documents that it has from before. These are given as history, since windows are
    verified by their words; they are not judged again and not in the result. Without one, an index is made for
    this call and deleted.

    Null or empty texts have no words and give an empty text; texts under WINDOW words have no window. Rows that
    repeat an id are separate documents (equal rows repeat each other), also those without id. An empty table gives
    an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    broadcast = spark.sparkContext.broadcast
    if index is not None and index.runs and history is None:
        raise ValueError("an index with batches needs the documents that are in it as history")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.lit(True).alias("own"))
    if history is not None:
        rows = rows.unionByName(history.select(F.lit(None).cast("long").alias("doc_id"), text.alias("text"), F.lit(False).alias("own")))
    rows = rows.withColumn("row", F.xxhash64("own", "doc_id", "text"))

    batch = F.when(F.col("own"), F.pmod(F.xxhash64("doc_id"), F.lit(batches))).otherwise(-1).cast("int")
    prints = staged(fingerprints(rows.withColumn("batch", batch)), "fingerprints")
    own_index = index or FingerprintIndex(spark)
    for b in range(batches):
        own_index.append(prints.where(F.col("batch") == b).select("fp", "n"))
    repeated = staged(own_index.repeated(), "repeated")
    # A bit array first takes out most fingerprints that are not repeated, then a join takes out all of them.
    near = maybe_in(prints.select("fp", "row"), F.col("fp"), repeated.select(F.col("fp").alias("key")), repeated.count())
    known = near.join(repeated, "fp", "left_semi").groupBy("row").agg(F.collect_set("fp").alias("fps"))
    known = staged(known.select(F.col("row").alias("_row"), "fps"), "known")
    discard(prints, repeated)
    if index is None:
        delete_folder(spark, own_index.folder)

    # Documents with a repeated fingerprint are written out with all that they have; no other is looked at again.
    flagged = flag_maybe_in(rows, F.col("row"), known.select(F.col("_row").alias("key")), known.count(), "marked")
    met = staged(flagged.where("marked").join(known, F.col("row") == F.col("_row"), "left").select("doc_id", "text", "own", "row", "fps"), "candidates")
    some = met.where("fps is not null")
    rest = flagged.where("own and not marked").select("doc_id", "text").unionByName(met.where("own and fps is null").select("doc_id", "text"))

    def blocks_of(part, w):
        return _Blocks(w, _Known(part.column("fps")))

    def count_blocks(part, w):
        x = blocks_of(part, w)
        order = np.lexsort((x.check, x.key))
        key, check = x.key[order], x.check[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
        head = np.flatnonzero(new)
        return key[head].view(np.int64), check[head].view(np.int64), np.diff(np.append(head, len(order)))

    blocks = _emit(some.select("text", "fps"), count_blocks, "key long, check long, n long").groupBy("key", "check").agg(F.sum("n").alias("n"))
    single = staged(blocks.where("n = 1").select("key"), "single_blocks")
    lone = broadcast(key_filter(single, "key", single.count()))
    discard(single)

    def windows(part, w):
        """Each window of blocks that may have no equal."""
        x = blocks_of(part, w)
        at = np.flatnonzero(np.repeat(lone.value.test(x.key), x.size))
        doc = np.searchsorted(w.first, x.starts[at], side="right") - 1
        own = lambda c: part.column(c).take(pa.array(doc))
        return own("own"), own("doc_id"), own("row"), (x.starts[at] - w.first[doc]).astype(np.int64), x.a[at].view(np.int64), x.b[at].view(np.int64)

    open_ = staged(_emit(some, windows, "own boolean, doc_id long, row long, start long, a long, b long"), "open_windows")
    asked = broadcast(key_filter(open_, "a", open_.count()))

    def others(part, w):
        """Windows of blocks known to repeat, where an open window may equal them."""
        x = blocks_of(part, w)
        at = np.flatnonzero(~np.repeat(lone.value.test(x.key), x.size))
        at = at[asked.value.test(x.a[at])]
        _, first = np.unique(x.a[at], return_index=True)
        return x.a[at[first]].view(np.int64), x.b[at[first]].view(np.int64), np.full(len(first), 2, np.int64)

    seen = open_.select("a", "b", F.lit(1).cast("long").alias("n")).unionByName(_emit(some.select("text", "fps"), others, "a long, b long, n long"))
    again = staged(seen.groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 1"), "repeated_windows")
    marks = open_.where("own").join(again.select("a", "b"), ["a", "b"], "left_semi")
    marks = staged(marks.groupBy(F.col("doc_id").alias("_d"), F.col("row").alias("_r")).agg(F.collect_set("start").alias("marks")), "marks")
    discard(open_, again)
    # Only documents with marks are shuffled to meet them.
    own_some = flag_maybe_in(some.where("own"), F.col("row"), marks.select(F.col("_r").alias("key")), marks.count(), "marked")
    joined = own_some.where("marked").join(marks, (F.col("row") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left").select("doc_id", "text", "fps", "marks")
    joined = own_some.where("not marked").select("doc_id", "text", "fps", F.lit(None).cast("array<long>").alias("marks")).unionByName(joined)

    def whole(part, w):
        none = np.zeros(len(part), np.int64)
        return part.column("doc_id"), np.diff(w.first), none, pa.array(kept_texts(w, np.ones(len(w.starts), dtype=bool)), pa.string())

    def clean(part, w):
        x = blocks_of(part, w)
        starts = x.starts[~np.repeat(lone.value.test(x.key), x.size)]
        marked = part.column("marks")
        more = marked.flatten().to_numpy(zero_copy_only=False)
        if len(more):
            sizes = np.nan_to_num(np.asarray(marked.value_lengths().fill_null(0)))
            starts = np.concatenate([starts, more + np.repeat(w.first[:-1], sizes.astype(np.int64))])
        gone = cover(starts.astype(np.int64), WINDOW, len(w.hashes))
        total = np.zeros(len(gone) + 1, np.int64)
        np.cumsum(gone, out=total[1:])
        return part.column("doc_id"), np.diff(w.first), total[w.first[1:]] - total[w.first[:-1]], pa.array(kept_texts(w, ~gone), pa.string())

    schema = "doc_id long, n_words long, n_removed long, text string"
    return _emit(joined, clean, schema).unionByName(_emit(rest, whole, schema))


def kept_texts(w, keep: np.ndarray) -> list[str]:
    """The kept words of each document, joined by one space."""
    inside = np.zeros(len(w.buf) + 1, np.int8)
    inside[w.starts[keep]] += 1
    inside[w.ends[keep]] -= 1
    mask = np.cumsum(inside[:-1], dtype=np.int8) > 0
    brk = np.zeros(len(w.buf) + 1, dtype=bool)
    brk[w.off] = True
    after = w.ends[keep]
    after = after[~brk[after]]
    buf = w.buf.copy()
    buf[after] = 0x20
    mask[after] = True
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    cut, data = total[w.off], buf[mask].tobytes()
    return [data[cut[i] : cut[i + 1]].decode().removesuffix(" ") for i in range(len(w.off) - 1)]
