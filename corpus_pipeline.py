"""A training corpus from documents: quality, lines, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; run() writes each stage's
result to the shared folder and rereads it, and deletes it once the next one's is there. All stages but the last
return the columns of docs, whatever their names. Rows are judged one by one, so rows that repeat an id, or have
none, are apart; an empty table passes every stage as an empty table. What null, empty and very long texts, ties and
repeats mean to a stage is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, jaccard, line_dedup, packing, quality
from lodestar.llm.queries import THRESHOLD
from lodestar.llm.shared import discard, documents, flag_maybe_in, free_names, staged


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (fitted on this corpus's labels) does not reject.

    Null and empty texts have the score of the model's bias; whole texts are scored, however long; equal texts score
    alike. A score of exactly the threshold stays.
    """
    model = quality.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = free_names(docs, "_score")
    return quality.score(docs, model, column=score).where(F.col(score) >= THRESHOLD).select(*docs.columns)


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that other documents repeat; n_chars, where docs has it, follows the text.

    Null and empty texts stay as they are. All documents stay, also those that lose every line. Of documents that share
    a line the one with the largest id keeps it, in each row of that id; null ids are the smallest.
    """
    out = line_dedup.dedup_lines(docs, counts=tuple(free_names(docs, "_n_lines", "_n_dropped")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id; rows that share an id are judged each by its text.

    Null and empty texts, and texts without words, are like nothing and stay. Of rows that repeat id and text all stay
    or all go. Null ids lose to others; texts of null ids only stay.
    """
    key, own, flag = free_names(docs, "_go", "_id", "_maybe")
    rows = jaccard.similar_groups(docs).groupBy("row_key", "doc_id").agg(F.max("kept").alias("kept"))
    go = staged(rows.where(~F.col("kept")).select(F.col("row_key").alias("key"), F.col("doc_id").alias("id")), "go")
    # Only texts that may have to go are shuffled.
    marked = flag_maybe_in(docs, jaccard.row_key(), go, go.count(), flag)
    named = go.select(F.col("key").alias(key), F.col("id").alias(own))
    asked = marked.where(F.col(flag)).join(named, (jaccard.row_key() == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(own)), "left_anti")
    return marked.where(~F.col(flag)).unionByName(asked).drop(flag)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items. Null and empty texts stay; so does all without a benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of 4096. Null and empty texts are their end id; long texts are cut into pieces."""
    return packing.pack_documents(docs, with_ids=False).drop("ids")


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", line_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_filter),
    ("packing", pack),
]

#: SQL cannot fit the classifier; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
