"""Sequence packing by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, prepare
from .tokens import SLICE, WORD_ENDS, encoder, vocabulary
from .textcore import slices

CAPACITY, END_ID = 4096, 2
#: Documents to a packing group; a group is one differencing problem.
GROUP = 3000


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest differencing method over k bins: each size's bin, and the bins' sums.

    A partial partition is a list of up to k sums, largest first. The two with the widest spread are merged,
    the largest sums of one with the smallest of the other, so that their imbalances cancel out.
    """
    left, right = [-1] * len(sizes), [-1] * len(sizes)
    heap = [(-int(s), i, np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a, na = heapq.heappop(heap)
        _, _, b, nb = heapq.heappop(heap)
        shared = max(0, len(a) + len(b) - k)
        free = len(a) - shared
        b, nb = b[::-1], nb[::-1]
        sums = np.concatenate([a[:free], a[free:] + b[:shared], b[shared:]])
        joined = np.arange(len(left), len(left) + shared)
        left.extend(na[free:].tolist())
        right.extend(nb[:shared].tolist())
        nodes = np.concatenate([na[:free], joined, nb[shared:]])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        low = int(sums[-1]) if len(sums) == k else 0
        count += 1
        heapq.heappush(heap, (low - int(sums[0]), count, sums, nodes))
    bins = np.zeros(len(sizes), np.int64)
    if not heap:
        return bins, np.zeros(0, np.int64)
    _, _, sums, nodes = heap[0]
    for at, node in enumerate(nodes.tolist()):
        stack = [node]
        while stack:
            x = stack.pop()
            if left[x] < 0:
                bins[x] = at
            else:
                stack += [left[x], right[x]]
    return bins, sums


def windows(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Bins of at most capacity, as few as the sizes' sum allows; their count rises whenever one is exceeded."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        bins, sums = difference(sizes, k)
        if len(sums) == 0 or sums[0] <= capacity:
            return bins, len(sums)
        k += max(1, int(np.maximum(sums - capacity, 0).sum()) // (4 * capacity))


def tokenized(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces of the documents' ids: whole windows of capacity from the start, then what is left.

    doc_id, start, length, ids (little-endian unsigned 32-bit; null unless with_ids), ids_crc32, doc_tokens, copy: the
    task in its upper bits, and how many rows with the same id and ids that task has met before.
    """
    import zlib

    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def cut(batches):
        from pyspark import TaskContext

        tokens, task = encoder(path), TaskContext.get().partitionId() << 32
        met: dict[int, int] = {}
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                owner, start, length, data, crc, total, copy = [], [], [], [], [], [], []
                doc_ids = part.column("doc_id").to_pylist()
                for d, ids in enumerate(tokens.encode_column(part.column("text"))):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    own = hash((doc_ids[d], zlib.crc32(ids)))
                    n = met[own] = met.get(own, -1) + 1
                    for s in range(0, len(ids), capacity):
                        piece = ids[s : s + capacity].tobytes()
                        owner.append(d)
                        start.append(s)
                        length.append(len(piece) // 4)
                        data.append(piece if with_ids else None)
                        crc.append(zlib.crc32(piece))
                        total.append(len(ids))
                        copy.append(task + n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(data, pa.binary()), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(copy, pa.int64())],
                    names=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "copy"],
                )

    return map_arrow(rows, cut, "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, copy long")


def pack(pieces: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset. Pieces of a document's full windows fill a sequence each; the others
    are dealt into groups by hash, and each group is packed by differencing. A sequence_id is the group's number
    in its upper bits and the window's in the lower ones; sequences are gapless from offset 0. Rows that repeat are
    told apart by their copy, so that however many there are they are dealt into all groups.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name != "copy")
    names = [c for c in pieces.columns if c != "copy"]

    def fill(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        sizes = frame["length"].to_numpy(np.int64)
        full = sizes == capacity
        rest = np.flatnonzero(~full)
        bins, used = windows(sizes[rest], capacity)
        window = np.zeros(len(frame), np.int64)
        window[rest] = bins
        window[full] = used + np.arange(int(full.sum()))
        order = np.argsort(window, kind="stable")
        ends = np.cumsum(sizes[order])
        base = ends - sizes[order]
        head = np.ones(len(order), dtype=bool)
        head[1:] = np.diff(window[order]) != 0
        offset = np.zeros(len(frame), np.int64)
        offset[order] = base - np.repeat(base[head], np.diff(np.append(np.flatnonzero(head), len(order))))
        frame["sequence_id"] = (int(key[0]) << 32) + window
        frame["offset"] = offset
        return frame[[*names, "sequence_id", "offset"]]

    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "length", "ids_crc32", "copy"), F.lit(groups))).drop("copy")
    return dealt.groupBy("_group").applyInPandas(lambda key, frame: fill(key, frame.drop(columns="_group")), f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    Every document is its token ids and end_id; each id lies in exactly one piece. Null and empty texts are
    the end id alone. Rows that repeat an id, or have none, are packed one by one. Other columns are ignored. An empty table
    gives no piece. The number of groups follows the number of documents, so a group has about `group`
    documents and their further pieces, whatever the size of the corpus.
    """
    groups = max(1, -(-docs.count() // group))
    pieces = tokenized(docs, path or vocabulary(WORD_ENDS), id_col, text_col, capacity, end_id, with_ids)
    return pack(pieces, groups, capacity)
