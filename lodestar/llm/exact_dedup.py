"""Exact deduplication by progressive refinement, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import MAX_FILTER_BITS, discard, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text):
    """Null counts as empty; A-Z alone are lower-cased."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _survivor_bits(keys: DataFrame, bits: int) -> DataFrame:
    """One row for each 32768 positions in use: at most 2**bits / 8 bytes in all, so it may be broadcast."""
    at = F.col("sig").bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(1)
    return (
        keys.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("at"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("at").alias("bitmap"))
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, digest_all: bool = False) -> DataFrame:
    """Groups of equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    Level 1 groups by byte length, level 2 the rows of lengths that occur twice by a hash of the first
    prefix_chars characters, level 3 hashes the whole content of the rows whose (length, prefix) occurs
    twice, and of no others (text_sha256 is null for these, unless digest_all). Texts never move: the
    keys that survive level 2 come back to the scan as a bit array of fixed size (64 MB at most), which
    may let some other rows through to level 3 but misses none. Groups are counted before they are
    shuffled, and the join back is one that adaptive execution splits if a group is hot.

    Null texts count as empty texts. Of equal texts the row with the largest id stays; if rows repeat
    that id, each of them is kept; null ids lose to others, and a group of null ids only has keep_id null
    and keeps all its rows. Other columns of docs are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    signed = base.select("doc_id", "norm", F.octet_length("norm").alias("n"), F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("prefix"))
    keys = staged(signed.select("n", "prefix"), "level2")
    lengths = keys.groupBy("n").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("n")
    level2 = keys.groupBy("n", "prefix").agg(F.count(F.lit(1)).alias("c")).where("c > 1").join(lengths, "n", "left_semi")
    level2 = staged(level2.select(F.xxhash64("n", "prefix").alias("sig")), "survivors")
    bits = min(MAX_FILTER_BITS, max(15, int(max(1, level2.count()) * 16 - 1).bit_length()))
    bitmap = _survivor_bits(level2, bits)

    at = F.xxhash64("n", "prefix").bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(1)
    probed = signed.withColumn("at", F.bitmap_bit_position(at)).withColumn("bucket", F.bitmap_bucket_number(at))
    probed = probed.join(F.broadcast(bitmap), "bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(bitmap, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    survives = F.coalesce(F.shiftrightunsigned(byte, 0).bitwiseAND(F.expr("cast(shiftleft(1, cast(at % 8 as int)) as int)")) > 0, F.lit(False))
    digest = F.sha2("norm", 256)
    rows = staged(
        probed.select("doc_id", "n", survives.alias("survives"), (digest if digest_all else F.when(survives, digest)).alias("text_sha256")),
        "level3",
    )
    groups = staged(
        rows.where("survives").groupBy("n", "text_sha256").agg(F.max("doc_id").alias("keep"), F.count(F.lit(1)).alias("size")).where("size > 1"),
        "groups",
    )
    discard(keys, level2)
    out = rows.join(groups, ["n", "text_sha256"], "left")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
