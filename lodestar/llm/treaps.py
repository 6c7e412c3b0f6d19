"""Ranked lexical search over inverted treaps.

The index is cut into shards of whole documents. In a shard each term has a treap of its postings: a search tree by
document in order of doc_id, and a heap by impact (what the term adds to a document's score, without the term's
weight), so the root of any subtree has the subtree's greatest impact. A query walks the treaps of its terms at once, over
intervals of documents: the terms' roots within an interval, weighted and summed, bound every score in it. An interval
whose bound cannot enter the top k is left out whole. Else the document of the heaviest root is scored, and splits
the interval and each of its treaps in two. Intervals of several queries are walked level by level, by array operations.

Scores are sums of integers, so that they don't depend on the order of shards. Impacts follow from the counts of the
whole corpus, which are taken first; weights follow from the terms' document frequencies, which the index has.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import discard, map_arrow, prepare, staged
from .textcore import ALNUM_SEP, FOLD, U64, mix64, scan, slices, utf8

TOP = 50
#: Bytes of text to a shard (a longer document is one alone), and documents in it at most.
SHARD_BYTES, SHARD_DOCS = 8 << 20, 8192
#: Queries walked together; bytes of query texts that are broadcast at once; one shard in so many sets the first thresholds.
TOGETHER, BLOCK_BYTES, SEED = 16, 8 << 20, 16
INDEX = "shard long, seed boolean, term string, docs array<int>, impacts array<int>, lefts array<int>, rights array<int>, root int, doc_ids array<long>"


def corpus_counts(docs: DataFrame) -> tuple[int, int]:
    """How many documents (text) have a term, and how many terms all have with repeats."""

    def count(batches):
        n, total = 0, 0
        for batch in batches:
            for part in slices(batch):
                sizes = np.diff(scan(part.column("text"), ALNUM_SEP, FOLD).first)
                n, total = n + int((sizes > 0).sum()), total + int(sizes.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], names=["n", "total"])

    row = map_arrow(docs.select("text"), count, "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    return row["n"] or 0, row["total"] or 0


def impact(tf: np.ndarray, n: np.ndarray, count: int, total: int) -> np.ndarray:
    """What a term with tf occurrences adds to a document of n terms, before its weight; integers, rounded down."""
    m = 50 + (50 * n * count) // max(total, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def treap(impacts: np.ndarray, docs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right children, as places in their own list (-1: none), and roots, of lists first[t]..first[t+1] of postings
    in order of document. Equal impacts are ordered by a hash of the document, so that trees of them stay shallow."""
    rank = (impacts.astype(np.int64) << 32) | (mix64(docs.astype(U64)) >> U64(32)).astype(np.int64)
    left, right = np.full(len(docs), -1, np.int32), np.full(len(docs), -1, np.int32)
    roots = np.zeros(len(first) - 1, np.int32)
    for t in np.flatnonzero(np.diff(first) > 1).tolist():
        a, b = int(first[t]), int(first[t + 1])
        r, lo, hi, stack = rank[a:b].tolist(), [-1] * (b - a), [-1] * (b - a), []
        for i, x in enumerate(r):
            last = -1
            while stack and r[stack[-1]] < x:
                last = stack.pop()
            lo[i] = last
            if stack:
                hi[stack[-1]] = i
            stack.append(i)
        left[a:b], right[a:b], roots[t] = lo, hi, stack[0]
    return left, right, roots


def _shard(ids: pa.Array, texts: pa.Array, shard: int, count: int, total: int):
    """The rows of one shard: one with the documents' ids, and one a term."""
    order = pa.array(np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))))
    ids, texts = ids.take(order), texts.take(order)
    w = scan(texts, ALNUM_SEP, FOLD)
    doc = w.doc_of()
    by = np.lexsort((doc, w.hashes))
    h, d = w.hashes[by], doc[by]
    new_term = np.ones(len(h), dtype=bool)
    new_term[1:] = h[1:] != h[:-1]
    new = new_term.copy()
    new[1:] |= d[1:] != d[:-1]
    at = np.flatnonzero(new)
    tf, docs = np.diff(np.append(at, len(h))), d[at].astype(np.int32)
    score = impact(tf, np.diff(w.first)[docs], count, total).astype(np.int32)
    first = np.append(np.flatnonzero(new_term[at]), len(at))
    left, right, roots = treap(score, docs, first)
    words, sample = FOLD[w.buf].tobytes(), by[at[first[:-1]]]
    terms = [words[a:b].decode() for a, b in zip(w.starts[sample].tolist(), w.ends[sample].tolist(), strict=True)]
    seed = int(mix64(np.array([shard], U64))[0]) % SEED == 0
    names = [x.split()[0] for x in INDEX.split(", ")]
    one = lambda x, kind: pa.array([x], kind)
    none = one(None, pa.list_(pa.int32()))
    yield pa.RecordBatch.from_arrays([one(shard, pa.int64()), one(seed, pa.bool_()), one(None, pa.string()), none, none, none, none, one(None, pa.int32()), one(ids.to_pylist(), pa.list_(pa.int64()))], names=names)
    for lo in range(0, len(terms), 8192):
        hi = min(lo + 8192, len(terms))
        cut = first[lo : hi + 1]
        lists = [pa.ListArray.from_arrays(pa.array(cut - cut[0], pa.int32()), pa.array(x[cut[0] : cut[-1]])) for x in (docs, score, left, right)]
        same = lambda x, kind: pa.array(np.full(hi - lo, x), kind)  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays([same(shard, pa.int64()), same(seed, pa.bool_()), pa.array(terms[lo:hi], pa.string()), *lists, pa.array(roots[lo:hi]), pa.nulls(hi - lo, pa.list_(pa.int64()))], names=names)


def build_index(docs: DataFrame, count: int, total: int) -> DataFrame:
    """The treaps of all terms of docs (doc_id, text), a row for each term of a shard (see INDEX); term is null in the row that has a shard's doc_ids.

    Nothing is shuffled: a shard is what a task reads one after another, up to SHARD_BYTES. Write the result before it is used.
    """

    def build(batches):
        from pyspark import TaskContext

        shard, held, size, rows = TaskContext.get().partitionId() << 32, [], 0, 0

        def made():
            column = lambda c: pa.concat_arrays([x.column(c) for x in held])
            return _shard(column("doc_id"), column("text"), shard, count, total)

        for batch in batches:
            for part in slices(batch, limit=SHARD_BYTES // 8):
                off = utf8(part.column("text"))[1]
                if held and (size + off[-1] > SHARD_BYTES or rows + len(part) > SHARD_DOCS):
                    yield from made()
                    shard, held, size, rows = shard + 1, [], 0, 0
                held.append(part)
                size, rows = size + int(off[-1]), rows + len(part)
        if held:
            yield from made()

    return map_arrow(docs.select("doc_id", "text"), build, INDEX)


class Queries:
    """Distinct terms of some query texts, and what each adds to a score."""

    def __init__(self, texts: list[str]) -> None:
        w = scan(pa.array(texts, pa.string()), ALNUM_SEP, FOLD)
        words, own = FOLD[w.buf].tobytes(), w.doc_of().tolist()
        found = {(words[a:b].decode(), q) for a, b, q in zip(w.starts.tolist(), w.ends.tolist(), own, strict=True)}
        self.asked: dict[str, list[int]] = {}
        for term, q in sorted(found):
            self.asked.setdefault(term, []).append(q)
        self.size, self.weight, self.least = len(texts), {}, np.ones(len(texts), np.int64)

    def weigh(self, frequency: dict[str, int], count: int) -> None:
        self.weight = {t: int(math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1)))) for t, df in frequency.items()}


class _Best:
    """The k best (score, document) of each query so far; least[q] is what a score must reach."""

    def __init__(self, least: np.ndarray, k: int) -> None:
        self.least, self.k = least.copy(), k
        self.query, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        good = score >= self.least[query]
        if not good.any():
            return
        query, score, doc = (np.concatenate([a, b[good]]) for a, b in ((self.query, query), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, query))
        query, score, doc = query[order], score[order], doc[order]
        head = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        place = np.arange(len(query)) - np.repeat(head, np.diff(np.append(head, len(query))))
        kept, last = place < self.k, place == self.k - 1
        self.query, self.score, self.doc = query[kept], score[kept], doc[kept]
        self.least[query[last]] = np.maximum(self.least[query[last]], score[last])


def walk(doc, impacts, left, right, query, root, weight, n_docs: int, best: _Best) -> int:
    """Walks treaps in arrays of nodes (children as node numbers, -1: none) from one root for each term of each query, which
    come in order of query. Gives how many documents it scored."""
    scored = 0
    row, node = np.unique(query, return_inverse=True)[1], root
    owner = np.unique(query)
    low, high = np.zeros(len(owner), np.int64), np.full(len(owner), n_docs - 1, np.int64)
    while len(node):
        head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        gain = weight * impacts[node]
        good = np.add.reduceat(gain, head) >= best.least[owner]
        if not good.all():
            stay = good[row]
            row, node, weight, gain = (np.cumsum(good) - 1)[row[stay]], node[stay], weight[stay], gain[stay]
            owner, low, high = owner[good], low[good], high[good]
            if not len(node):
                break
            head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        # The document of each interval's heaviest root.
        top = np.flatnonzero(gain == np.maximum.reduceat(gain, head)[row])
        top = top[np.concatenate([[True], row[top][1:] != row[top][:-1]])]
        split = doc[node[top]].astype(np.int64)
        d, lo, hi = split[row], low[row], high[row]
        before, after, found = (np.full(len(node), -1, np.int64) for _ in range(3))
        # Down each treap towards the document; the first nodes met on its two sides are the roots of what is there.
        at, now = np.arange(len(node)), node
        while len(at):
            x = doc[now]
            aim = d[at]
            is_less, is_more = x < aim, x > aim
            side = is_less & (x >= lo[at]) & (before[at] < 0)
            before[at[side]] = now[side]
            side = is_more & (x <= hi[at]) & (after[at] < 0)
            after[at[side]] = now[side]
            same = ~(is_less | is_more)
            found[at[same]] = now[same]
            now = np.where(is_less, right[now], np.where(is_more, left[now], -1))
            on = now >= 0
            at, now = at[on], now[on]
        for out, children, others, inside in ((before, left, right, lambda x, i: x >= lo[i]), (after, right, left, lambda x, i: x <= hi[i])):
            at = np.flatnonzero((found >= 0) & (out < 0))
            now = children[found[at]]
            while len(at):
                on = now >= 0
                at, now = at[on], now[on]
                here = inside(doc[now], at)
                out[at[here]] = now[here]
                at, now = at[~here], others[now[~here]]
        score = np.add.reduceat(np.where(found >= 0, weight * impacts[found], 0), head)
        best.add(owner, score, split)
        scored += len(split)
        a, b, n = np.flatnonzero(before >= 0), np.flatnonzero(after >= 0), len(owner)
        row = np.concatenate([row[a], row[b] + n])
        node, weight = np.concatenate([before[a], after[b]]), np.concatenate([weight[a], weight[b]])
        used = np.zeros(2 * n, dtype=bool)
        used[row] = True
        row = (np.cumsum(used) - 1)[row]
        owner, low, high = (np.concatenate(x)[used] for x in ((owner, owner), (low, split + 1), (split - 1, high)))
    return scored


def _search_shard(table: pa.Table, queries: Queries, k: int) -> pa.Table:
    """query, doc_id, score of a shard's best for each query, of those that reach queries.least."""
    terms = table.column("term").to_pylist()
    ids = table.column("doc_ids").filter(pc.is_null(table.column("term"))).to_pylist()[0]
    lists = [table.column(c).combine_chunks() for c in ("docs", "impacts", "lefts", "rights")]
    doc, impacts, left, right = (x.flatten().to_numpy().astype(np.int64) for x in lists)
    sizes = lists[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    base = np.cumsum(sizes) - sizes
    shift = np.repeat(base, sizes)
    left, right = np.where(left >= 0, left + shift, -1), np.where(right >= 0, right + shift, -1)
    roots = table.column("root").to_pylist()
    rows = [(q, int(base[i]) + roots[i], queries.weight[t]) for i, t in enumerate(terms) if t is not None for q in queries.asked[t]]
    rows = np.array(sorted(r for r in rows if r[2] > 0), np.int64).reshape(-1, 3)
    out = []
    for lo in range(0, queries.size, TOGETHER):
        some = rows[np.searchsorted(rows[:, 0], lo) : np.searchsorted(rows[:, 0], lo + TOGETHER)]
        if len(some):
            best = _Best(queries.least, k)
            walk(doc, impacts, left, right, some[:, 0], some[:, 1], some[:, 2], len(ids), best)
            out.append(best)
    join = lambda f: np.concatenate([np.zeros(0, np.int64), *[getattr(x, f) for x in out]])
    return pa.table({"query": join("query"), "doc_id": pa.array(ids, pa.int64()).take(pa.array(join("doc"))), "score": join("score")})


def _searcher(queries, k: int):
    return lambda table: _search_shard(table, queries.value, k)


def _top(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each query, of parts of the rows first."""
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(32))
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query", part).orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def search(index: DataFrame, count: int, texts: list[str], k: int = TOP) -> DataFrame:
    """query (the text's place in the list), doc_id, score, rank of the k best documents of each text, with a score above 0.

    Reads the rows of the texts' terms alone. The shards marked as seed are walked first; the k-th best score that
    they give for a query is a threshold for all others.
    """
    spark = index.sparkSession
    queries = Queries(texts)
    asked = spark.createDataFrame([(t,) for t in [None, *queries.asked]], "asked string")
    hits = staged(index.join(F.broadcast(asked), F.col("term").eqNullSafe(F.col("asked")), "left_semi"), "hits")
    frequency = hits.where("term is not null").groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    queries.weigh({r["term"]: r["df"] for r in frequency.toLocalIterator()}, count)
    results = []
    for first in (True, False):
        sent = spark.sparkContext.broadcast(queries)
        groups = hits.where(F.col("seed") == first).groupBy("shard")
        results.append(staged(_top(groups.applyInArrow(_searcher(sent, k), "query long, doc_id long, score long"), k), "results"))
        if first:
            for r in results[0].groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).toLocalIterator():
                queries.least[r["query"]] = r["least"]
    discard(hits)
    return _top(results[0].drop("rank").unionByName(results[1].drop("rank")), k)


def ranked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k documents with the highest scores above 0; equal scores by doc_id.

    Terms are runs of digits, letters and non-ASCII characters, A-Z lower-cased; null and empty texts have none, and items
    without terms, or with terms that no document has, no rows. Rows of docs that repeat an id, or have none (they come
    last among equal scores), are ranked one by one, and so is each row of items; an empty table gives no rows. Other columns are
    ignored. Items are taken in blocks of about BLOCK_BYTES of text; a block is a search of the whole index.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = StructType([StructField("query", LongType()), StructField("item_id", items.schema[item_col].dataType)])
    rows = items.select(F.col(item_col).alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).where("text <> ''")
    size = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    count, total = corpus_counts(docs)
    index = staged(build_index(docs, count, total), "treaps")
    blocks, out = max(1, -(-int(size) // BLOCK_BYTES)), None
    for i in range(blocks):
        part = [(r["id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64(F.col("id").cast("string"), "text"), F.lit(blocks)) == i).toLocalIterator()]
        names = spark.createDataFrame([(q, name) for q, (name, _) in enumerate(part)], schema)
        found = search(index, count, [t for _, t in part], k).join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    discard(index)
    return out
