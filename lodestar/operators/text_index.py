"""An inverted index of texts on files: postings by term bucket in blocks with maxima, segments merged by size.

A batch of documents becomes a segment: a table of documents, and postings partitioned by a hash of the term. Documents are
numbered, and a row of postings holds what one term has in one block of numbers: places in the block, occurrences and lengths (as
bytes, which are far cheaper to move and write than arrays), and the largest occurrence and smallest length, which bound the BM25 score of every document in the block. FANOUT segments of
one level are merged into one of the next. A search reads the maxima of its terms' buckets, scores the most
promising blocks, and then only those blocks whose bound reaches the k-th best score.
"""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import cut, forget, shared_folder

BUCKETS, BLOCK, FANOUT = 32, 4096, 4
#: Blocks scored first, for a threshold; documents whose keys are fetched by a filter on their numbers instead of a join.
FIRST, FETCHED = 16, 2000
#: Documents to a task, characters that a task splits at once, rows of postings that it hands on at once.
TASK, PIECE, HANDED = 12_000, 1 << 22, 10_000
#: A segment of no words has no file of postings to tell their columns.
POSTINGS = "term string, batch int, block long, lists binary, n_docs int, max_tf int, min_length int, bucket int"


def _counted(texts: pa.Array, first: int) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of some lower-case texts, runs of a-z and 0-9: term, place (from first) and occurrences of each text's
    distinct words, and the number of words of each text."""
    split = pc.split_pattern_regex(texts, "[^a-z0-9]+")
    words, place = split.flatten(), pc.list_parent_indices(split).to_numpy()
    real = pc.not_equal(words, "")
    words, place = words.filter(real).dictionary_encode(), place[real.to_numpy(zero_copy_only=False)]
    each, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(texts) + place, return_counts=True)
    term = pa.DictionaryArray.from_arrays(pa.array((each // len(texts)).astype(np.int32)), words.dictionary)
    return term, (each % len(texts)).astype(np.int32) + first, tf.astype(np.int32), np.bincount(place, minlength=len(texts)).astype(np.int32)


def _pieces(texts: pa.Array):
    """(first place, texts) of at most PIECE characters, or one text."""
    ends = np.cumsum(pc.utf8_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
        yield at, texts.slice(at, end - at)
        at = end


def _maker(key: str, size: int):
    """For mapInArrow of (key, lower-case text): a row (key, doc, n) of each document, and the postings (term, block, lists) of each block."""

    def block(keys: pa.Array, texts: pa.Array, first: int):
        terms, places, tfs, lengths = zip(*(_counted(part, at) for at, part in _pieces(texts)), strict=True)
        lengths = np.concatenate(lengths)
        n = len(keys)
        names = [key, "doc", "n", "term", "block", "lists", "n_docs", "max_tf", "min_length"]
        none = [pa.nulls(n, x) for x in (pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32())]
        yield pa.RecordBatch.from_arrays([keys, pa.array(np.arange(first, first + n)), pa.array(lengths), *none], names=names)
        term = pa.chunked_array(terms).unify_dictionaries().combine_chunks()
        term = term if isinstance(term, pa.DictionaryArray) else term.chunk(0)
        of, place, tf = term.indices.to_numpy(), np.concatenate(places), np.concatenate(tfs)
        order = np.lexsort((place, of))
        of, lists = of[order], np.stack([place[order], tf[order], lengths[place[order]]], 1).astype("<i4")
        starts = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
        # Rows of postings are handed on some at a time, so that frames stay small.
        for lo in range(0, len(starts) - 1, HANDED):
            at = starts[lo : lo + HANDED + 1]
            some, at = lists[at[0] : at[-1]], at - at[0]
            offsets = pa.py_buffer((at * some.itemsize * 3).astype(np.int32))
            m, word = len(at) - 1, term.dictionary.take(pa.array(of[starts[lo : lo + HANDED + 1][:-1]]))
            packed = pa.Array.from_buffers(pa.binary(), m, [None, offsets, pa.py_buffer(some)])
            best = [np.diff(at).astype(np.int32), np.maximum.reduceat(some[:, 1], at[:-1]), np.minimum.reduceat(some[:, 2], at[:-1])]
            empty = [pa.nulls(m, x) for x in (keys.type, pa.int64(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*empty, word, pa.array(np.full(m, first // size)), packed, *map(pa.array, best)], names=names)

    def run(batches):
        from pyspark import TaskContext

        first, held = TaskContext.get().partitionId() << 33, None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            while len(held) >= size:
                yield from block(*(_whole(c) for c in held.slice(0, size).columns), first)
                first, held = first + size, held.slice(size)
        if held is not None and len(held):
            yield from block(*(_whole(c) for c in held.columns), first)

    return run


def _unpacked(batches):
    """For mapInArrow of rows of postings (term, batch, first, lists): term, batch, doc, tf, n of each document in them."""
    for batch in batches:
        for i in range(0, len(batch), 64):
            part = batch.slice(i, 64)
            lists = [np.frombuffer(x, "<i4").reshape(-1, 3) for x in part.column("lists").to_pylist()]
            at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            place, tf, n = np.concatenate(lists).T
            doc = part.column("first").to_numpy()[at] + place
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(at)) for c in ("term", "batch")), *map(pa.array, (doc, tf.copy(), n.copy()))], names=["term", "batch", "doc", "tf", "n"])


def _whole(column: pa.ChunkedArray) -> pa.Array:
    out = column.combine_chunks()
    return pa.concat_arrays(out.chunks) if isinstance(out, pa.ChunkedArray) else out


class TextIndex:
    """The index in a folder. A segment is a folder seg-FIRST-LAST of the batches in it; it counts once its last table is
    written, and segments that a wider one covers do not, so a job lost while it adds or merges leaves a whole index."""

    def __init__(self, spark: SparkSession, folder: str | None = None, key: str = "uid", column: str = "docstring", fanout: int = FANOUT) -> None:
        self.spark, self.key, self.column, self.fanout = spark, key, column, fanout
        self.folder = folder or f"{shared_folder(spark)}/lodestar-text-{uuid.uuid4().hex}"
        jpath = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in self._fs.listStatus(jpath)] if self._fs.exists(jpath) else []
        done = [n for n in names if n.startswith("seg-") and self._fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/stats/_SUCCESS"))]
        spans = [tuple(map(int, n.split("-")[1:])) for n in done]
        self.segments = sorted(s for s in spans if not any(t != s and t[0] <= s[0] and s[1] <= t[1] for t in spans))

    def _path(self, segment: tuple[int, int], table: str) -> str:
        return f"{self.folder}/seg-{segment[0]:06d}-{segment[1]:06d}/{table}"

    def _read(self, table: str, segments=None) -> DataFrame:
        read = self.spark.read.schema(POSTINGS) if table == "postings" else self.spark.read
        parts = [read.parquet(self._path(s, table)) for s in segments or self.segments]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _write(self, segment: tuple[int, int], docs: DataFrame, postings: DataFrame, stats: DataFrame) -> None:
        for table in ("docs", "postings", "stats"):
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._path(segment, table)), True)
        docs.write.parquet(self._path(segment, "docs"))
        # A bucket goes to several tasks, by block, so a frequent term is not one task.
        dealt = postings.repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(8))).sortWithinPartitions("bucket", "term", "block")
        dealt.write.partitionBy("bucket").parquet(self._path(segment, "postings"))
        stats.coalesce(1).write.parquet(self._path(segment, "stats"))

    def add(self, rows: DataFrame) -> None:
        """A further batch of documents (key, column); null texts have no words. A key that is there already is a further document.

        A task numbers its documents one after another, so a block lies within a task, and its postings are made there: what is
        shuffled are the texts, dealt out by TASK documents whatever files they come in, and the rows of postings, no single words.
        """
        batch = 1 + max((s[1] for s in self.segments), default=0)
        texts = rows.select(F.col(self.key), F.lower(F.coalesce(F.col(self.column), F.lit(""))).alias("_t"))
        texts = texts.repartition(max(1, -(-rows.count() // TASK)), self.key, "_t")
        kind = texts.schema[self.key].dataType.simpleString()
        bounds = "lists binary, n_docs int, max_tf int, min_length int"
        made = cut(texts.mapInArrow(_maker(self.key, BLOCK), f"`{self.key}` {kind}, doc long, n int, term string, block long, {bounds}"))
        docs = made.where("term is null").select(F.lit(batch).alias("batch"), "doc", self.key, "n")
        bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket")
        postings = made.where("term is not null").select("term", F.lit(batch).alias("batch"), "block", "lists", "n_docs", "max_tf", "min_length", bucket)
        stats = docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
        self._write((batch, batch), docs, postings, stats)
        forget(made)
        self.segments.append((batch, batch))
        self._merge()

    def _level(self, segment: tuple[int, int]) -> int:
        level, size = 0, segment[1] - segment[0] + 1
        while size >= self.fanout:
            level, size = level + 1, size // self.fanout
        return level

    def _merge(self) -> None:
        """Merges the last segments for as long as FANOUT of them are of one level; postings are copied, texts are not read again."""
        while len(self.segments) >= self.fanout and len({self._level(s) for s in self.segments[-self.fanout :]}) == 1:
            old = self.segments[-self.fanout :]
            merged = (old[0][0], old[-1][1])
            stats = self._read("stats", old).agg(F.sum("docs").alias("docs"), F.sum("total").alias("total"))
            self._write(merged, self._read("docs", old), self._read("postings", old), stats)
            self.segments = [*self.segments[: -self.fanout], merged]
            for s in old:
                self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/seg-{s[0]:06d}-{s[1]:06d}"), True)

    def postings(self, words: list[str]) -> DataFrame:
        """The rows of some terms: a filter on their buckets' partitions, so no other bucket is read."""
        buckets = [self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(w)), F.lit(BUCKETS)).cast("int").alias("b")).first()["b"] for w in words]
        return self._read("postings").where(F.col("bucket").isin(*sorted(set(buckets))) & F.col("term").isin(*words))

    def search(self, query: str, k: int = 100, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """key, score of the k documents with the highest BM25 scores, equal ones by key; no other document could be among them."""
        words = sorted(set(re.findall("[a-z0-9]+", query.lower())))
        none = self.spark.createDataFrame([], "uid string, score double").withColumnRenamed("uid", self.key)
        if not words or not self.segments:
            return none
        stats = self._read("stats").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total")).first()
        rows = self.postings(words)
        found = {r["term"]: r["df"] for r in rows.groupBy("term").agg(F.sum("n_docs").alias("df")).collect()}
        if not found:
            return none
        average, size = stats["total"] / stats["docs"], BLOCK
        idf = F.element_at(F.create_map(*[x for t, df in sorted(found.items()) for x in (F.lit(t), F.lit(math.log(1 + (stats["docs"] - df + 0.5) / (df + 0.5))))]), F.col("term"))
        gain = lambda tf, n: idf * F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.col(n) / average))
        bounds = cut(rows.groupBy("batch", "block").agg(F.sum(gain("max_tf", "min_length")).alias("bound")))

        def scores(blocks: DataFrame) -> DataFrame:
            each = rows.join(blocks.select("batch", "block"), ["batch", "block"], "left_semi").select("term", "batch", (F.col("block") * size).alias("first"), "lists")
            each = each.mapInArrow(_unpacked, "term string, batch int, doc long, tf int, n int")
            # Added up in the order of the terms, so that equal documents have equal scores to the last bit.
            parts = F.array_sort(F.collect_list(F.struct("term", gain("tf", "n").alias("g"))))
            return each.groupBy("batch", "doc").agg(F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["g"]).alias("score"))

        def reached(scored: DataFrame) -> float:
            top = [r["score"] for r in scored.select("score").orderBy(F.desc("score")).limit(k).collect()]
            return top[-1] - 1e-9 if len(top) == k else 0.0

        least = reached(scores(bounds.orderBy(F.desc("bound")).limit(FIRST)))
        scored = cut(scores(bounds.where(F.col("bound") >= least)))
        scored = scored.where(F.col("score") >= reached(scored))
        docs, hits = self._read("docs"), scored.limit(FETCHED + 1).collect()
        if len(hits) <= FETCHED:
            docs = docs.where(F.col("doc").isin(*sorted({r["doc"] for r in hits})))
        named = docs.join(scored, ["batch", "doc"]).select(self.key, "score")
        return named.orderBy(F.desc("score"), self.key).limit(k)
