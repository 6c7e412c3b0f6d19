"""What the fingerprint index writes while batches come in."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.llm.substring_dedup import FingerprintIndex


def test_a_fingerprint_is_written_once_a_level(spark, tmp_path, monkeypatch):
    written, write = [], FingerprintIndex._write

    def counted(self, prints, run):
        out = write(self, prints, run)
        written.append(out.count())
        return out

    monkeypatch.setattr(FingerprintIndex, "_write", counted)
    index = FingerprintIndex(spark, str(tmp_path / "index"), buckets=2)
    batches, size = 10, 20
    for b in range(batches):
        index.append(spark.range(size).select((F.col("id") + b * size - (1 if b else 0)).alias("fp"), F.lit(1).cast("long").alias("n")))
    assert index.runs == [(1, 9, 2), (10, 10, 2)]
    # Three levels for ten batches; all of history every other batch would be some thirty times a batch more.
    assert sum(written) <= 3 * batches * size
    whole = FingerprintIndex(spark, index.folder)
    assert whole.runs == index.runs and whole.batches == batches
    assert {r["fp"] for r in whole.repeated().collect()} == {size - 1}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("lodestar_run_")]


def test_names_leave_the_catalog_when_an_append_fails(spark, tmp_path, monkeypatch):
    index = FingerprintIndex(spark, str(tmp_path / "index"), buckets=2)
    rows = spark.range(5).select(F.col("id").alias("fp"), F.lit(1).cast("long").alias("n"))
    index.append(rows)
    monkeypatch.setattr(FingerprintIndex, "_open", lambda self, run: 1 / 0)
    try:
        index.append(rows)
    except ZeroDivisionError:
        pass
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("lodestar_run_")]
    assert FingerprintIndex(spark, index.folder).batches in (1, 2)
