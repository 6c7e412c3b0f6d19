"""Spark helpers of the training-data operators: shared folder, staging, fixed-size key filters."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bits of a broadcast key filter: 2**29 bits are 64 MB, whatever the input. It has 16 bits a key until then.
MAX_FILTER_BITS = 29
ARROW_ROWS = 1000


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where none is set, as in tests, a folder of our own in local mode; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            root = found.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: the executors need a shared folder")
        else:
            root = tempfile.mkdtemp(prefix="lodestar-")
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def prepare(spark: SparkSession) -> None:
    """Arrow batches small enough for tables with very long texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def give_back() -> None:
    """This process's free memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow; at a task's end the worker, which later tasks use again, gives its free memory back."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(whole, schema)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as it takes to be none of df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/lodestar-{uuid.uuid4().hex}/{tag}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, and lost executors cost a reread."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestar_path = path
    return out


def _file_system(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_folder(spark: SparkSession, path: str) -> None:
    jpath, fs = _file_system(spark, path)
    fs.delete(jpath, True)


def complete_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in path that a job has written to its end."""
    jpath, fs = _file_system(spark, path)
    if not fs.exists(jpath):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(jpath) if x.isDirectory()]
    return sorted(n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def discard(*frames: DataFrame) -> None:
    """Deletes what staged() wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_lodestar_path", None)
        if path:
            delete_folder(df.sparkSession, path)


class KeyFilter:
    """A bit for each key's low bits: no key of the set is missed, others pass now and then.

    The size is fixed by bits (MAX_FILTER_BITS at most, 64 MB), so the broadcast has a bound at any
    scale; a crowded filter lets more through, which costs work and never changes results.
    """

    def __init__(self, bits: int, data: np.ndarray) -> None:
        self.bits, self.data = bits, data

    def test(self, keys: np.ndarray) -> np.ndarray:
        at = (keys.astype(np.uint64) & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def key_filter(df: DataFrame, column: str, count: int, max_bits: int = MAX_FILTER_BITS) -> KeyFilter:
    """A filter of a long column, built on the executors; the driver gets the bit array alone."""
    bits = min(max_bits, max(15, int(max(1, count) * 16 - 1).bit_length()))
    at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(1)
    rows = (
        df.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("at"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("at").alias("bitmap"))
        .collect()
    )
    data = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in rows:
        b = (r["bucket"] - 1) * 4096
        part = np.frombuffer(bytes(r["bitmap"]), np.uint8)[: len(data) - b]
        data[b : b + len(part)] |= part
    return KeyFilter(bits, data)


def flag_maybe_in(df: DataFrame, key, keys: DataFrame, count: int, column: str, max_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """df with a boolean column: whether a row's key (a long column) may be in keys ("key"). False is certain.

    The keys are a bit array of fixed size, broadcast as rows of 32768 bits and looked up by built-in functions,
    so df is not shuffled and nothing leaves the JVM.
    """
    bits = min(max_bits, max(15, int(max(1, count) * 16 - 1).bit_length()))
    at = lambda k: k.bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(1)
    bucket, place, found, bitmap = free_names(df, "_bucket", "_at", "_found", "_bitmap")
    maps = (
        keys.select(F.bitmap_bucket_number(at(F.col("key"))).alias(found), F.bitmap_bit_position(at(F.col("key"))).alias("_p"))
        .groupBy(found)
        .agg(F.bitmap_construct_agg("_p").alias(bitmap))
    )
    probed = df.withColumn(place, F.bitmap_bit_position(at(key))).withColumn(bucket, F.bitmap_bucket_number(at(key)))
    byte = F.conv(F.hex(F.expr(f"substring(`{bitmap}`, cast(`{place}` div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.expr(f"cast(shiftleft(1, cast(`{place}` % 8 as int)) as int)")) > 0
    joined = probed.join(F.broadcast(maps), F.col(bucket) == F.col(found), "left")
    return joined.select(*df.columns, F.coalesce(hit, F.lit(False)).alias(column))


def maybe_in(df: DataFrame, key, keys: DataFrame, count: int, max_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """Rows of df whose key (a long column) may be in keys ("key"): none of them is missed, a few others pass."""
    (column,) = free_names(df, "_maybe")
    return flag_maybe_in(df, key, keys, count, column, max_bits).where(F.col(column)).select(*df.columns)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
