"""Versioned evidence packets: one row with an answer's evidence, in a fixed order, and its hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "1.0"
REQUIRED = ("meta", "status", "code_truth", "doc_claims")


def assemble(results: DataFrame, question: str = "", project: str = "", as_of: str = "", mode: str = "evidence", most: int = 100) -> DataFrame:
    """The best `most` of the results as one row: meta, status, code_truth, doc_claims, ranked; order is -score, path, uid."""
    results = results.orderBy(F.desc("score"), "path", "uid").limit(most)
    item = F.struct((-F.col("score")).alias("rank"), "path", "uid", "name", "label", "score")
    one = results.agg(F.array_sort(F.collect_list(item)).alias("all"))
    view = lambda label: F.transform(F.filter("all", lambda x: x["label"] == label), lambda x: F.struct(x["uid"].alias("id"), x["name"].alias("name"), x["path"].alias("path"), x["score"].alias("score")))
    meta = F.struct(F.lit(mode).alias("mode"), F.lit(project).alias("project"), F.lit(question).alias("question"), F.lit(VERSION).alias("schema_version"), F.lit(as_of).alias("timestamp"))
    return one.select(
        meta.alias("meta"),
        F.when(F.size("all") == 0, "insufficient_evidence").otherwise("success").alias("status"),
        view("Code").alias("code_truth"),
        view("Document").alias("doc_claims"),
        F.transform("all", lambda x: x["uid"]).alias("ranked"),
    )


def hashed(packet: DataFrame) -> DataFrame:
    """packet with the SHA-256 of its canonical JSON."""
    from lodestar.functions.text import packet_hash

    return packet.withColumn("packet_hash", packet_hash(F.to_json(F.struct(*[c for c in packet.columns if c != "packet_hash"]), {"ignoreNullFields": "false"})))


def problems(packet: DataFrame) -> DataFrame:
    """packet with a list of what it lacks."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), f"missing {c}") for c in REQUIRED]))
    version = F.array_compact(F.array(F.when(F.col("meta.schema_version") != VERSION, "unknown version")))
    return packet.withColumn("problems", F.concat(missing, version))


def rendered(packet: DataFrame) -> DataFrame:
    """status, text: the packet as Markdown, with its code, its documents and what to do without evidence."""
    lines = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- `"), F.coalesce(x["path"], F.lit("unknown")), F.lit("` **"), x["name"], F.lit("** "), F.format_number(x["score"], 3))), "\n")
    part = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"## {title}\n"), lines(F.col(c))))
    none = F.when(F.col("status") != "success", "No evidence: ask about a file, a class or a function by name.")
    return packet.select("status", F.concat_ws("\n\n", part("Code", "code_truth"), part("Documents", "doc_claims"), none).alias("text"))


def audit_entry(packet: DataFrame, as_of: str) -> DataFrame:
    return hashed(packet).select(F.lit(as_of).alias("logged_at"), "packet_hash", F.to_json(F.struct(*packet.columns)).alias("packet"))
