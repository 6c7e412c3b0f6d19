"""The pipeline's stages on the smallest tables, each against a plain version on its own input."""

from __future__ import annotations

from pathlib import Path

import pytest

import corpus_pipeline as P
from lodestar.llm import decontaminate, exact_dedup, quality
from lodestar.llm.shared import documents, flag_maybe_in, staged

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


def test_stages(spark):
    before = documents(spark, SF)
    columns, texts = before.columns, {}
    for name, stage in P.STAGES[:-1]:
        after = staged(stage(spark, before, SF), name)
        assert after.columns == columns
        old, new = ({r["doc_id"]: r["text"] for r in df.collect()} for df in (before, after))
        assert new.keys() <= old.keys() and len(new) > 0
        if name == "quality":
            model = quality.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert new.keys() == {r["doc_id"] for r in quality.score(before, model).collect() if r["score"] >= 0.7}
        elif name == "line_dedup":
            assert new.keys() == old.keys()
        else:
            assert all(new[i] == old[i] for i in new)
        if name == "near_duplicates":
            assert exact_dedup.exact_duplicates(after).where("group_size > 1 and text_sha256 is not null").select("text_sha256").distinct().count() <= 1
            again = staged(stage(spark, after, SF), "again")
            assert again.count() == after.count()
        if name == "decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert decontaminate.contamination(after, bench).where("contaminated").count() == 0
        before, texts = after, new
    pieces = P.STAGES[-1][1](spark, before, SF).collect()
    assert {r["doc_id"] for r in pieces} == texts.keys()
    by = {}
    for r in pieces:
        by.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert all(sum(x[1] for x in v) == v[0][2] for v in by.values())


def test_stages_null_ids_empty_texts_repeats_and_clashes(spark, tmp_path):
    """Each stage on rows without ids, repeated rows, null, empty and long texts and columns named like its own."""
    from tests.llm.test_small import LINE, clashing, held

    good = "A calm sentence with some words in it, as people write them. Another one follows, and it ends well."
    rows = [(None, f"{good} First."), (None, f"{good} First."), (1, f"{good} Second {'long ' * 20_000}"), (2, None), (2, ""), (3, f"{good}\n{LINE}"), (3, f"{good}\n{LINE}")]
    rows += [(10 + i, f"{LINE}\nown text number {i} of many others, {good}") for i in range(6)]
    docs = clashing(spark, rows)
    sf = str(tmp_path)
    spark.createDataFrame([(i, 1, 0) for i in range(1, 40)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([("b", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen")], "item_id string, text string").write.parquet(f"{sf}/benchmark.parquet")
    for name, stage in P.STAGES[:-1]:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, sf)
            assert out.columns == docs.columns
            got = held(out)
            assert len(got) <= table.count()
            if name in ("line_dedup", "decontamination") and table is docs:
                assert len(got) == len(rows)
            if name == "near_duplicates" and table is docs:
                assert [r for r in got if not r[1]] == [(2, None), (2, "")] and sum(r[0] is None for r in got) == 2
                assert sum(r[0] == 3 for r in got) == 2
    assert {r["doc_id"] for r in P.STAGES[-1][1](spark, docs, sf).collect()} == {i for i, _ in rows}
    assert P.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0


def test_pipeline_against_a_plain_version(spark):
    """run() on the smallest tables: lines, near duplicates and benchmark passages by brute force after the classifier."""
    from collections import defaultdict

    from lodestar.llm import packing, tokens
    from tests.llm.test_small import ALNUM, brute_components, fold

    docs = documents(spark, SF).select("doc_id", "text")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] or "" for r in quality.score(docs, model).collect() if r["score"] >= 0.7}
    key = lambda x: fold(x.strip(" \t\n\x0b\x0c\r"))
    owners = defaultdict(set)
    for i, t in texts.items():
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                owners[key(x)].add(i)
    last = {k: max(v) for k, v in owners.items() if len(v) >= 5}
    texts = {i: "\n".join(x for x in t.split("\n") if last.get(key(x), i) == i) for i, t in texts.items()}
    groups = brute_components(sorted(texts.items()))
    texts = {i: t for i, t in texts.items() if groups[i][1] == i}
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = ALNUM.findall(fold(r["text"]))
        windows |= {tuple(w[s : s + min(13, len(w))]) for s in range(max(1, len(w) - 12)) if w}

    def hit(t):
        w = ALNUM.findall(fold(t))
        at = {p for k in {len(x) for x in windows} for s in range(len(w) - k + 1) if tuple(w[s : s + k]) in windows for p in range(s, s + k)}
        return at and 20 * len(at) >= len(w)

    texts = {i: t for i, t in texts.items() if not hit(t)}
    e = tokens.encoder(tokens.vocabulary(tokens.WORD_ENDS))
    want = {i: len(e.whole(t)) // 4 + 1 for i, t in texts.items()}
    pieces, windows_ = defaultdict(int), defaultdict(list)
    for r in P.run(spark, SF).collect():
        pieces[r["doc_id"]] += r["length"]
        assert r["doc_tokens"] == want[r["doc_id"]]
        windows_[r["sequence_id"]].append((r["offset"], r["length"]))
    assert dict(pieces) == want
    for w in windows_.values():
        assert [a for a, _ in sorted(w)] == [sum(n for _, n in sorted(w)[:i]) for i in range(len(w))] and sum(n for _, n in w) <= packing.CAPACITY


def test_near_duplicates_shuffles_no_text_that_stays(spark, monkeypatch):
    """Texts meet the rows to drop only where they may be among them; null ids and repeats as the stage says."""
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    rows = [(1, words(1)), (2, words(1) + " more"), (None, words(1)), (None, words(2)), (3, words(3)), (3, words(3)), (3, words(1)), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, _maybe int")
    asked = []
    monkeypatch.setattr(P, "flag_maybe_in", lambda *a: asked.append(flag_maybe_in(*a)) or asked[0])
    got = P.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(((r[0] or 0, r[1] or "") for r in got.collect())) == sorted([(1, words(1)), (0, words(2)), (3, words(3)), (3, words(3)), (4, ""), (5, "")])
    plan = asked[0]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
