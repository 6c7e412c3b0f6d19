"""Token ids in binary shards, each a wavelet matrix in one compressed file.

A shard has its documents' ids one after another. The ids are mapped to the shard's own alphabet, and its
bit-planes, highest bit first, are kept each in the order that the planes above it lead to. A plane is cut into
blocks of BLOCK bits that are compressed one by one; the file also holds how many ones lie before each block, and
where it begins. So access, count and select read the header, these directories and the blocks they touch, one or
two of each plane, and no other. Layout, little-endian: magic, u32 header length, JSON header, the compressed
parts in the header's order, then the blocks, plane by plane.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import map_arrow, new_folder, prepare
from .textcore import slices
from .tokens import BYTE_LEVEL, SLICE, encoder, vocabulary

MAGIC = b"LSWAVE3\n"
END_ID = 0
SHARD_TOKENS = 1 << 20
PART_BYTES = 128 << 20
#: Bits to a block of a plane.
BLOCK = 1 << 16


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, block: int = BLOCK) -> bytes:
    """A shard of ids; lengths has the number of ids of each document. block is a multiple of 8."""
    top = int(ids.max()) + 1 if len(ids) else 1
    present = np.zeros(top, dtype=bool)
    present[ids] = True
    alphabet = np.flatnonzero(present)
    symbol = np.zeros(top, np.uint32)
    symbol[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
    kind = np.uint16 if len(alphabet) <= 1 << 16 else np.uint32
    x = symbol.astype(kind)[ids]
    levels = max(1, int(max(1, len(alphabet)) - 1).bit_length())
    pack = zstandard.ZstdCompressor(level=1)
    blocks, zeros, ranks = [], [], []
    for level in range(levels - 1, -1, -1):
        bit = (x >> kind(level)) & kind(1) == 1
        plane = np.packbits(bit)
        ranks.append(np.cumsum([0, *(np.bitwise_count(plane[i : i + block // 8]).sum(dtype=np.int64) for i in range(0, len(plane), block // 8))]))
        blocks += [pack.compress(plane[i : i + block // 8].tobytes()) for i in range(0, len(plane), block // 8)]
        low = np.flatnonzero(~bit)
        zeros.append(len(low))
        x = x.take(np.concatenate([low, np.flatnonzero(bit)]))
    known = [d for d in doc_ids if d is not None]
    parts = [
        alphabet.astype("<u4"), lengths.astype("<u4"), np.array(known, "<i8"), np.packbits([d is None for d in doc_ids]),
        np.concatenate(ranks).astype("<u4"), np.cumsum([0, *map(len, blocks)]).astype("<u4"),
    ]
    packed = [pack.compress(p.tobytes()) for p in parts]
    header = json.dumps({"n": len(ids), "docs": len(doc_ids), "levels": levels, "zeros": zeros, "block": block, "parts": [len(p) for p in packed]}).encode()
    return b"".join([MAGIC, np.array([len(header)], "<u4").tobytes(), header, *packed, *blocks])


class Shard:
    """Reads a shard: access, counts, rank, occurrences, documents. data is the file's bytes, or reads a range of them:
    read(offset, size). Parts and blocks are read when they are asked for, and blocks are held for HELD of them at most."""

    HELD = 64

    def __init__(self, data: bytes | Callable[[int, int], bytes]) -> None:
        self._read = data if callable(data) else lambda at, size: data[at : at + size]
        first = len(MAGIC) + 4
        start = self._read(0, first)
        if start[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        size = int(np.frombuffer(start[len(MAGIC) :], "<u4")[0])
        head = json.loads(self._read(first, size))
        self.n, self.levels, self.zeros, self.block, self.docs = head["n"], head["levels"], head["zeros"], head["block"], head["docs"]
        self._ends = np.cumsum([first + size, *head["parts"]]).tolist()
        self._held: dict[tuple[int, int], np.ndarray] = {}

    def _part(self, i: int, kind: str) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(self._read(self._ends[i], self._ends[i + 1] - self._ends[i])), kind)

    @cached_property
    def alphabet(self) -> np.ndarray:
        return self._part(0, "<u4")

    @cached_property
    def lengths(self) -> np.ndarray:
        return self._part(1, "<u4").astype(np.int64)

    @cached_property
    def doc_ids(self) -> list[int | None]:
        missing = np.unpackbits(self._part(3, "u1"), count=self.docs).astype(bool)
        known = iter(self._part(2, "<i8").tolist())
        return [None if m else next(known) for m in missing]

    @cached_property
    def _ranks(self) -> np.ndarray:
        """Ones before each block of each plane."""
        return self._part(4, "<u4").astype(np.int64).reshape(self.levels, -1)

    @cached_property
    def _offsets(self) -> list[int]:
        return (self._part(5, "<u4").astype(np.int64) + self._ends[-1]).tolist()

    def _block(self, level: int, number: int) -> np.ndarray:
        key = (level, number)
        if key not in self._held:
            if len(self._held) >= self.HELD:
                del self._held[next(iter(self._held))]
            at = level * (self._ranks.shape[1] - 1) + number
            packed = self._read(self._offsets[at], self._offsets[at + 1] - self._offsets[at])
            self._held[key] = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
        return self._held[key]

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        number, rest = divmod(i, self.block)
        ones = int(self._ranks[level, number])
        if rest:
            data = self._block(level, number)
            ones += int(np.bitwise_count(data[: rest >> 3]).sum(dtype=np.int64))
            if rest & 7:
                ones += (int(data[rest >> 3]) >> (8 - (rest & 7))).bit_count()
        return ones

    def _bit(self, level: int, i: int) -> int:
        number, rest = divmod(i, self.block)
        return int(self._block(level, number)[rest >> 3]) >> (7 - (rest & 7)) & 1

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit = self._bit(level, i)
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return int(self.alphabet[value])

    def _symbol(self, token: int) -> int:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else -1

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        symbol = self._symbol(token)
        if symbol < 0:
            return 0, 0
        for level in range(self.levels):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if symbol >> (self.levels - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id in positions lo to hi."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def select(self, token: int, k: int) -> int:
        """The position of the k-th occurrence of an id, from 0."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i, symbol = a + k, self._symbol(token)
        for level in range(self.levels - 1, -1, -1):
            if symbol >> (self.levels - 1 - level) & 1:
                i = self._find(level, i - self.zeros[level], True)
            else:
                i = self._find(level, i, False)
        return i

    def _find(self, level: int, k: int, one: bool) -> int:
        """The position of the k-th bit of a kind in a plane, by the directory and then within its block."""
        ones = self._ranks[level]
        before = ones if one else np.arange(len(ones)) * self.block - ones
        number = min(int(np.searchsorted(before, k, side="right")) - 1, len(ones) - 2)
        bits = np.unpackbits(self._block(level, number))
        return number * self.block + int(np.flatnonzero(bits == one)[k - int(before[number])])

    def positions(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def ids(self) -> np.ndarray:
        """All ids: the planes are undone from the lowest one up."""
        x = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        unpack, at, per = zstandard.ZstdDecompressor(), self._offsets, self._ranks.shape[1] - 1
        for level in range(self.levels - 1, -1, -1):
            first = at[level * per]
            data = self._read(first, at[(level + 1) * per] - first)
            plane = b"".join(unpack.decompress(data[at[i] - first : at[i + 1] - first]) for i in range(level * per, (level + 1) * per))
            bit = np.unpackbits(np.frombuffer(plane, np.uint8), count=self.n).astype(bool)
            x[self.zeros[level] :] |= x.dtype.type(1 << (self.levels - 1 - level))
            y = np.empty_like(x)
            y[np.concatenate([np.flatnonzero(~bit), np.flatnonzero(bit)])] = x
            x = y
        return self.alphabet[x] if self.n else np.zeros(0, "<u4")


def write_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, partitions: int | None = None) -> None:
    """Writes the documents' ids, each with end_id after it, in ascending id order into shards under folder.

    Documents are range-partitioned by id, into as many parts as keep their mean below PART_BYTES of text, and sorted.
    A task writes its shards one after another, each as one file with one row (part, number, before: ids of the
    part's earlier shards, n_tokens, shard) through Spark's own commit, so a task that is lost and run again leaves
    no half shard, and any file system will do. A shard ends at the first document boundary beyond shard_tokens; a document is never split. Null texts count as
    empty; null ids come first; rows that repeat an id stay apart, ordered by a hash of their texts. An empty table
    gives no shard. Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    path = path or vocabulary(BYTE_LEVEL)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if partitions is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
        partitions = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // PART_BYTES))
    # Rows of one id are apart by a hash of their text, so that many of them are no single task's.
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(partitions, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def write(batches):
        from pyspark import TaskContext

        part, number, before = TaskContext.get().partitionId(), 0, 0
        tokens, end = encoder(path), np.array([end_id], np.uint32)
        ids, owners, size = [], [], 0

        def shard():
            lengths = np.array([len(x) for x in ids], np.int64)
            data = build(np.concatenate(ids), owners, lengths)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())],
                names=["part", "number", "before", "n_tokens", "shard"],
            )

        for batch in batches:
            for some in slices(batch, limit=SLICE):
                for doc, x in zip(some.column("doc_id").to_pylist(), tokens.encode_column(some.column("text")), strict=True):
                    ids.append(np.concatenate([x, end]))
                    owners.append(doc)
                    size += len(x) + 1
                    if size >= shard_tokens:
                        yield shard()
                        number, before = number + 1, before + size
                        ids, owners, size = [], [], 0
        if ids:
            yield shard()

    shards = map_arrow(rows, write, "part int, number int, before long, n_tokens long, shard binary")
    shards.write.option("maxRecordsPerFile", 1).option("compression", "none").parquet(folder)


def read_shards(spark, folder: str, end_id: int = END_ID) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids."""
    files = spark.read.parquet(folder)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    # One row for each part, whose number is a setting; not a row for each document.
    base = parts.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("base"))
    placed = files.join(F.broadcast(base), "part").select("shard", (F.col("base") + F.col("before")).alias("base"))

    def read(batches):
        for batch in batches:
            for data, base_ in zip(batch.column("shard"), batch.column("base").to_pylist(), strict=True):
                s = Shard(data.as_py())
                ids = s.ids().astype("<u4")
                if s.count(end_id) != int(np.count_nonzero(ids == end_id)):
                    raise ValueError("damaged shard: its directories and planes do not agree")
                ends = np.cumsum(s.lengths)
                begin = ends - s.lengths
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.doc_ids, pa.int64()), pa.array(begin + base_, pa.int64()), pa.array(s.lengths, pa.int64()), pa.array([ids[a:b].tobytes() for a, b in zip(begin, ends, strict=True)], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return map_arrow(placed, read, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Writes the documents into shards in the shared folder and reads them back."""
    spark = docs.sparkSession
    folder = new_folder(spark, "token_shards")
    write_shards(docs, folder, **options)
    return read_shards(spark, folder, options.get("end_id", END_ID))
