"""An index of vectors: coarse cells, product codes of what is left, exact scores for the best.

Vectors count by their direction. k-means cuts the sphere into cells, and in each of PARTS parts of the dimensions a
second k-means gives CODES typical residuals, so that a vector is its cell and PARTS bytes. Both are fitted on a bounded
sample in rounds of Spark jobs; all rows are indexed. The index is a folder: the model, and for each batch a table of
codes and a table of vectors, both partitioned by groups of cells and sorted by cell, so files do not grow with cells. A search
reads the codes of the cells nearest to a query, keeps the best by code in blocks of many cells, and fetches the vectors of
these alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import cut, forget, shared_folder
from .search import dot

#: Vectors to a cell and cells at most (for the default number of cells), and rows of the sample that is fitted on.
PER_CELL, MAX_CELLS, SAMPLE = 64, 4096, 65_536
PARTS, CODES, ROUNDS = 16, 256, 8
#: Rows to a file of a group of cells and to a block, queries to a block, and blocks to have at least (if rows are enough).
CHUNK, QUERY_CHUNK, BLOCKS = 65_536, 1024, 32
#: Groups of cells (folders of a table) at most; distances that a task holds at once.
GROUPS, HELD = 64, 1 << 22


@dataclass
class Model:
    cells: np.ndarray
    books: list[np.ndarray]

    def nearest(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        """The n nearest cells of each row, the nearest first."""
        away = (self.cells**2).sum(1)[None, :] - 2 * x @ self.cells.T
        if n == 1:
            return away.argmin(1)[:, None]
        some = np.argpartition(away, min(n, away.shape[1]) - 1, axis=1)[:, :n]
        return np.take_along_axis(some, np.argsort(np.take_along_axis(away, some, 1), axis=1, kind="stable"), 1)

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, len(self.books), axis=1)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """The code bytes of each row in its cell."""
        left = self.parts(x - self.cells[cell])
        return np.stack([((b**2).sum(1)[None, :] - 2 * p @ b.T).argmin(1) for p, b in zip(left, self.books, strict=True)], 1).astype(np.uint8)

    def decode(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What the codes of some rows stand for."""
        return self.cells[cell] + np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)


def unit_rows(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows of length 1 (of zeros, if they are)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 1), np.float32)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)
    length = np.sqrt((x**2).sum(1, keepdims=True))
    return x / np.where(length > 0, length, 1)


def _lloyd(sample: DataFrame, centres: np.ndarray, members, rounds: int) -> np.ndarray:
    """k-means of what members(rows) gives: (group, vectors) pairs, group g with the centres centres[g]. Each round is a
    job; tasks send sums by centre, never rows."""
    spark = sample.sparkSession
    groups, k, width = centres.shape
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(centres)

        def sums(batches, sent=sent):
            total, n = np.zeros((groups, k, width)), np.zeros((groups, k), np.int64)
            for batch in batches:
                if len(batch):
                    for g, x in members(unit_rows(batch.column("v"))):
                        c = sent.value[g]
                        near = ((c**2).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
                        np.add.at(total[g], near, x)
                        n[g] += np.bincount(near, minlength=k)
            g, c = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c), pa.array(n[g, c]), pa.array(list(total[g, c]), pa.list_(pa.float64()))], names=["g", "c", "n", "s"])

        def add(frame: pd.DataFrame) -> pd.DataFrame:
            c, at = np.unique(frame["c"], return_inverse=True)
            s = np.zeros((len(c), width))
            np.add.at(s, at, np.stack(frame["s"]))
            return pd.DataFrame({"g": frame["g"].iloc[0], "c": c, "n": np.bincount(at, frame["n"]).astype(np.int64), "s": list(s)})

        made = sample.mapInArrow(sums, "g long, c long, n long, s array<double>").groupBy("g", F.expr("c div 256")).applyInPandas(add, "g long, c long, n long, s array<double>")
        new, count = centres.copy(), np.zeros((groups, k), np.int64)
        for r in made.collect():
            new[r["g"], r["c"]], count[r["g"], r["c"]] = np.array(r["s"]) / r["n"], r["n"]
        for g in range(groups):
            # An empty centre moves next to a crowded one.
            crowded = np.argsort(-count[g], kind="stable")
            for i, c in enumerate(np.flatnonzero(count[g] == 0).tolist()):
                new[g, c] = new[g, crowded[i % max(1, int((count[g] > 0).sum()))]] * np.float32(1 + 1e-3 * (i + 1))
        sent.destroy()
        centres = new.astype(np.float32)
    return centres


def fit(vectors: DataFrame, key: str = "uid", column: str = "embedding", cells: int | None = None, parts: int = PARTS, rounds: int = ROUNDS, sample: int = SAMPLE) -> Model:
    """Cells and code books from about `sample` rows at most, those with the lowest hashes of their key. Null vectors do not count."""
    rows = vectors.where(F.col(column).isNotNull() & (F.size(column) > 0)).select(F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(column).alias("v"))
    n = rows.count()
    if not n:
        return Model(np.zeros((0, 1), np.float32), [np.zeros((1, 1), np.float32)])
    cells = min(cells or max(1, min(MAX_CELLS, n // PER_CELL)), n)
    if n > sample:
        rows = rows.where(F.pmod("h", F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    some = cut(rows)
    first = some.orderBy("h", F.col("v").cast("string")).limit(max(cells, CODES)).select("v").toArrow()
    first = unit_rows(first.column("v"))
    centres = _lloyd(some, first[None, :cells], lambda x: [(0, x)], rounds)[0]

    model = Model(centres, [first[:1]])
    left = first - centres[model.nearest(first)[:, 0]]
    parts = min(parts, left.shape[1])
    width = max(p.shape[1] for p in np.array_split(left, parts, axis=1))
    padded = lambda x: [np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in np.array_split(x, parts, axis=1)]
    books = _lloyd(some, np.stack(padded(left[:CODES])), lambda x: list(enumerate(padded(x - model.cells[model.nearest(x)[:, 0]]))), max(2, rounds // 2))
    forget(some)
    sizes = [p.shape[1] for p in np.array_split(left, parts, axis=1)]
    return Model(centres, [np.ascontiguousarray(b[:, :s]) for b, s in zip(books, sizes, strict=True)])


class VectorIndex:
    """The index in a folder; carry are further columns that searches may filter by.

    A batch counts once both of its tables are complete, so a job lost while it adds one leaves the index as it was.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        row = spark.read.parquet(f"{self.folder}/model").first()
        matrix = lambda x: np.frombuffer(bytes(x["data"]), np.float32).reshape(x["rows"], -1 if x["rows"] else 1)
        self.model, self.key, self.column, self.carry = Model(matrix(row["cells"]), [matrix(x) for x in row["books"]]), row["key"], row["column"], list(row["carry"])
        jpath = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
        names = sorted(x.getPath().getName() for x in fs.listStatus(jpath))
        done = lambda n: all(fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/{t}/_SUCCESS")) for t in ("codes", "vectors"))
        self.batches = [n for n in names if n.startswith("batch-") and done(n)]
        self._next = 1 + max((int(n.split("-")[1]) for n in names if n.startswith("batch-")), default=0)

    @classmethod
    def create(cls, vectors: DataFrame, folder: str, key: str = "uid", column: str = "embedding", carry: Sequence[str] = (), **options) -> VectorIndex:
        """Fits a model on vectors and makes them the first batch. An index of no vectors finds nothing and takes no batches."""
        model = fit(vectors, key, column, **options)
        one = lambda x: {"rows": len(x), "data": np.ascontiguousarray(x, np.float32).tobytes()}
        rows = [(one(model.cells), [one(b) for b in model.books], key, column, list(carry))]
        matrix = "struct<rows:int,data:binary>"
        vectors.sparkSession.createDataFrame(rows, f"cells {matrix}, books array<{matrix}>, key string, column string, carry array<string>").coalesce(1).write.parquet(f"{folder}/model")
        index = cls(vectors.sparkSession, folder)
        if len(model.cells):
            index.add(vectors)
        return index

    def add(self, vectors: DataFrame) -> None:
        """A further batch: its rows get cells and codes of the model there is; what is in the index is not touched.

        Null and empty vectors are left out; a key that is there already is a further row. A group's rows go to as many
        files as they need, so a crowded cell is not one task.
        """
        if not len(self.model.cells):
            raise ValueError("the index was fitted on no vectors")
        model = self.spark.sparkContext.broadcast(self.model)
        rows = vectors.where(F.col(self.column).isNotNull() & (F.size(self.column) > 0)).select(self.key, self.column, *self.carry)
        kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]

        def place(batches):
            for batch in batches:
                if len(batch):
                    x = unit_rows(batch.column(1))
                    cell = model.value.nearest(x)[:, 0]
                    codes = [c.tobytes() for c in model.value.encode(x, cell)]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(codes, pa.binary())], names=[*batch.schema.names, "cell", "code"])

        placed = cut(rows.mapInArrow(place, ", ".join([*kinds, "cell int", "code binary"])))
        placed = placed.withColumn("part", F.col("cell") % GROUPS)
        files = placed.groupBy(F.col("part").alias("_p")).agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_files"))
        dealt = placed.join(F.broadcast(files), F.col("part") == F.col("_p")).withColumn("_file", F.pmod(F.xxhash64(self.key), F.col("_files")))
        dealt = dealt.repartition("part", "_file").sortWithinPartitions("part", "cell")
        path = f"{self.folder}/batch-{self._next:06d}"
        dealt.select(self.key, "code", *self.carry, "cell", "part").write.partitionBy("part").parquet(f"{path}/codes")
        dealt.select(self.key, self.column, "cell", "part").write.partitionBy("part").parquet(f"{path}/vectors")
        forget(placed)
        self.batches.append(path.rsplit("/", 1)[1])
        self._next += 1

    def _table(self, name: str, cells: Sequence[int]) -> DataFrame:
        """One of the two tables, of the given cells: a partition filter, so other groups are not listed or read, and one by cell, which
        passes over the rest of a group by its files' statistics."""
        asked = F.col("part").isin(*sorted({c % GROUPS for c in cells})) & F.col("cell").isin(*cells)
        parts = [self.spark.read.parquet(f"{self.folder}/{b}/{name}").where(asked if len(cells) < len(self.model.cells) else F.lit(True)).drop("part") for b in self.batches]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _asked(self, queries: DataFrame, probes: int) -> list[int]:
        """The cells that any of the queries asks."""
        if probes >= len(self.model.cells):
            return list(range(len(self.model.cells)))
        model = self.spark.sparkContext.broadcast(self.model)

        def ask(batches):
            cells = [np.unique(model.value.nearest(unit_rows(b.column("v")), probes)) for b in batches if len(b)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(cells)).astype(np.int32) if cells else [], pa.int32())], names=["cell"])

        return sorted(r["cell"] for r in queries.select("v").mapInArrow(ask, "cell int").distinct().toLocalIterator())

    def probes_for(self, queries: DataFrame, k: int = 50, recall: float = 0.9, most: int = 64) -> int:
        """The fewest cells to ask for a mean recall of the k nearest, measured on the first `most` of some queries (query, v)
        against a search of all cells."""
        some = cut(queries.where("v is not null and size(v) > 0").orderBy(F.xxhash64("query")).limit(most))
        asked = some.toArrow()
        order = self.model.nearest(unit_rows(asked.column("v")), len(self.model.cells))
        place = {q: {int(c): i for i, c in enumerate(row)} for q, row in zip(asked.column("query").to_pylist(), order, strict=True)}
        needed = np.zeros(len(self.model.cells), np.int64)
        for r in self._search(some, k, len(self.model.cells), 8 * k).toLocalIterator():
            needed[place[r["query"]][r["_cell"]]] += 1
        forget(some)
        return 1 + int(np.searchsorted(np.cumsum(needed), recall * needed.sum())) if needed.any() else 1

    def search(self, queries: DataFrame, k: int = 50, probes: int = 8, refine: int | None = None, where: Column | str | None = None, minimum: float | None = None) -> DataFrame:
        """query, the key, score (cosine), rank: the k nearest rows of each query (query, v) among the cells it asks.

        By code the best `refine` (8 k if not given) are kept, in each group of rows and then on the whole; these are
        scored exactly, equal scores by key. where filters the rows by the columns carried, before anything is cut.
        Null and empty vectors of queries, and vectors of zeros, which are like nothing, give no rows.
        """
        found = self._search(queries, k, probes, refine or 8 * k, where, minimum)
        return found.select("query", F.col("_key").alias(self.key), "score", "rank")

    @staticmethod
    def _blocks(held: dict[int, int], queries: int) -> tuple[dict[int, tuple[int, int]], dict[int, np.ndarray]]:
        """For each cell its first block and how many blocks its rows are dealt into, and these blocks. Small cells share a block."""
        most = BLOCKS // max(1, -(-queries // QUERY_CHUNK))
        size = min(CHUNK, max(1024, -(-sum(held.values()) // max(1, most))))
        first, block, rows = {}, 0, 0
        for c, n in sorted(held.items()):
            if rows and rows + n > size:
                block, rows = block + 1, 0
            n_blocks = max(1, -(-n // size))
            first[c], rows = (block, n_blocks), rows + n
            if n_blocks > 1:
                block, rows = block + n_blocks, 0
        return first, {c: np.arange(b, b + n, dtype=np.int32) for c, (b, n) in first.items()}

    def _search(self, queries: DataFrame, k: int, probes: int, refine: int, where: Column | str | None = None, minimum: float | None = None) -> DataFrame:
        if not self.batches:
            kinds = [f"query {queries.schema['query'].dataType.simpleString()}", "_key string, score double, _cell int, rank int"]
            return self.spark.createDataFrame([], ", ".join(kinds))
        model, probes = self.spark.sparkContext.broadcast(self.model), min(probes, len(self.model.cells))
        queries = cut(queries.where("v is not null and size(v) > 0").select("query", "v"))
        wanted = self._asked(queries, probes)
        codes = self._table("codes", wanted or [-1])
        if where is not None:
            codes = codes.where(where)
        first, blocks = self._blocks({r["cell"]: r["n"] for r in codes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}, queries.count())
        # Rows and queries meet in blocks of bounded size: each row for each block of queries, and each query for the blocks of its cells.
        grid = self.spark.createDataFrame([(c, *x) for c, x in first.items()], "_c int, _first int, _blocks int")
        shares = max(1, -(-queries.count() // QUERY_CHUNK))
        each = F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("j")
        left = codes.join(F.broadcast(grid), F.col("cell") == F.col("_c"))
        left = left.select("cell", F.col(self.key).alias("_key"), "code", (F.col("_first") + F.pmod(F.xxhash64(self.key), F.col("_blocks"))).cast("int").alias("i"), each)
        of = self.spark.sparkContext.broadcast(blocks)

        def send(batches):
            for batch in batches:
                if len(batch):
                    cells = model.value.nearest(unit_rows(batch.column("v")), probes)
                    to = [np.unique(np.concatenate([np.zeros(0, np.int32), *(of.value[c] for c in row.tolist() if c in of.value)])) for row in cells]
                    at = pa.array(np.repeat(np.arange(len(batch)), [len(x) for x in to]))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("query", "v")), pa.array(np.concatenate(to).astype(np.int32))], names=["query", "v", "i"])

        kinds = queries.schema["query"].dataType.simpleString(), codes.schema[self.key].dataType.simpleString(), queries.schema["v"].dataType.simpleString()
        right = queries.mapInArrow(send, f"query {kinds[0]}, v {kinds[2]}, i int").withColumn("j", F.pmod(F.xxhash64("query"), F.lit(shares)).cast("int"))

        def near(rows: pa.Table, asks: pa.Table) -> pa.Table:
            none = {"query": asks.column("query").slice(0, 0), "_key": rows.column("_key").slice(0, 0), "cell": pa.array([], pa.int32()), "away": pa.array([], pa.float32())}
            if not len(rows) or not len(asks):
                return pa.table(none)
            rows = rows.sort_by([("cell", "ascending"), ("_key", "ascending")])
            cell = rows.column("cell").to_numpy()
            x = model.value.decode(cell, np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(rows), -1))
            size, starts = (x**2).sum(1), np.flatnonzero(np.diff(cell, prepend=-1)).tolist()
            spans = list(zip(cell[starts].tolist(), starts, [*starts[1:], len(cell)], strict=True))
            v, at, who, away = unit_rows(asks.column("v")), [], [], []
            step = max(1, HELD // max(len(rows), len(model.value.cells)))
            for lo in range(0, len(v), step):
                some = v[lo : lo + step]
                asked = np.zeros((len(some), len(model.value.cells)), bool)
                np.put_along_axis(asked, model.value.nearest(some, probes), True, 1)
                d = np.full((len(some), len(rows)), np.inf, np.float32)
                for c, a, b in spans:  # only pairs of a query and a cell that it asks
                    q = np.flatnonzero(asked[:, c])
                    if len(q):
                        d[q, a:b] = size[a:b] - 2 * some[q] @ x[a:b].T
                best = np.argpartition(d, refine - 1, axis=1)[:, :refine] if len(rows) > refine else np.tile(np.arange(len(rows)), (len(some), 1))
                far = np.take_along_axis(d, best, 1)
                real = np.isfinite(far)
                at.append(best[real])
                who.append(lo + np.nonzero(real)[0])
                away.append(far[real])
            at, who = np.concatenate(at), pa.array(np.concatenate(who))
            return pa.table({"query": asks.column("query").take(who), "_key": rows.column("_key").take(pa.array(at)), "cell": pa.array(cell[at].astype(np.int32)), "away": np.concatenate(away)})

        by = ("i", "j")
        found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(near, f"query {kinds[0]}, _key {kinds[1]}, cell int, away float")
        order = Window.partitionBy("query").orderBy("away", "_key")
        some = cut(found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= refine).select("query", "_key", "cell"))
        vectors = self._table("vectors", wanted or [-1]).withColumnsRenamed({self.key: "_k", "cell": "_cell"})
        full = some.join(vectors, (F.col("cell") == F.col("_cell")) & (F.col("_key") == F.col("_k")))
        full = full.join(queries.select(F.col("query").alias("_q"), F.col("v").alias("_v")), F.col("query") == F.col("_q"))
        length = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
        full = full.select("query", "_key", (dot(F.col(self.column), F.col("_v")) / F.nullif(length(self.column) * length("_v"), F.lit(0.0))).alias("score"), "_cell").where("score is not null").distinct()
        if minimum is not None:
            full = full.where(F.col("score") >= minimum)
        return full.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "_key"))).where(F.col("rank") <= k)


def index_folder(spark: SparkSession) -> str:
    """A new folder for an index that lasts as long as the shared folder's files do."""
    return f"{shared_folder(spark)}/lodestar-vectors-{uuid.uuid4().hex}"
