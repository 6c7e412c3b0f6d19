"""The ten operators on small inputs, against brute force, with nulls, empty texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import components, decontaminate, exact_dedup, html_text, jaccard, language, line_dedup, packing, quality, substring_dedup, textcore, token_store, tokens

WS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
EDGE = [None, "", " ", "\n\n", "x", "É é 日本 語", "a\tb\r\nc", "w " * 3000]


def fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def corpus():
    """Random texts with exact copies, near copies, shared passages and shared lines."""
    rng = random.Random(5)
    word = lambda: rng.choice("alpha beta Gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randint(0, 60))
    passage = [word() for _ in range(60)]
    line = "A boilerplate line that is longer than forty characters, yes."
    texts = list(EDGE)
    for i in range(120):
        words = [word() for _ in range(rng.randint(1, 120))]
        if i % 4 == 0:
            words[len(words) // 2 : len(words) // 2] = passage[: rng.randint(20, 60)]
        text = " ".join(words)
        texts.append(text + ("\n" + line + "\n tail" if i % 5 == 0 else ""))
        if i % 6 == 0:
            texts.append(text.upper())
            w = text.split()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "n", 1) for i, t in corpus], "doc_id long, text string, keep_id string, n int").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_scan_and_ngrams_match_python(corpus):
    texts = [t for _, t in corpus]
    for block in (1 << 20, 50):
        old, textcore._BLOCK = textcore._BLOCK, block
        try:
            w = textcore.scan(pa.array(texts, pa.string()))
        finally:
            textcore._BLOCK = old
        seen = {}
        for i, t in enumerate(texts):
            own = slice(w.first[i], w.first[i + 1])
            got = [bytes(w.buf[a:b]) for a, b in zip(w.starts[own], w.ends[own], strict=True)]
            assert got == [x.encode() for x in WS.findall(t or "")]
            assert all(seen.setdefault(x, h) == h for x, h in zip(got, w.hashes[own].tolist(), strict=True))
        assert len(set(seen.values())) == len(seen)


def test_exact_duplicates(spark, docs, corpus):
    groups = defaultdict(list)
    for i, t in corpus:
        groups[fold(t)].append(i)
    got = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(docs, digest_all=True).collect()}
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
    lazy = exact_dedup.exact_duplicates(docs).collect()
    assert all(r["text_sha256"] is not None for r in lazy if r["group_size"] > 1)
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0
    odd = spark.createDataFrame([(None, "a"), (1, "A"), (1, "a"), (None, None), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(odd).collect()) == [(0, 0, 2, True), (0, 0, 2, True), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]


def test_line_dedup(spark, docs, corpus):
    key = lambda x: fold(x.strip(" \t\n\x0b\x0c\r"))
    owners = defaultdict(set)
    for i, t in corpus:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                owners[key(x)].add(i)
    last = {k: max(v) for k, v in owners.items() if len(v) >= 5}
    assert last
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    for i, t in corpus:
        lines = (t or "").split("\n")
        kept = [x for x in lines if last.get(key(x), i) == i]
        assert (got[i]["text"] or "") == "\n".join(kept) and got[i]["_n_lines"] == len(lines) and got[i]["_n_dropped"] == len(lines) - len(kept)
    assert got[0]["keep_id"] == "n" and line_dedup.dedup_lines(empty(spark)).count() == 0


def test_substring_dedup(spark, docs, corpus):
    words = {i: WS.findall(t or "") for i, t in corpus}
    seen = Counter(tuple(w[s : s + 35]) for w in words.values() for s in range(len(w) - 34))
    assert any(n > 1 for n in seen.values())
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs).collect()}
    for i, w in words.items():
        gone = {p for s in range(len(w) - 34) if seen[tuple(w[s : s + 35])] > 1 for p in range(s, s + 35)}
        assert got[i]["n_words"] == len(w) and got[i]["n_removed"] == len(gone)
        assert got[i]["text"] == " ".join(x for p, x in enumerate(w) if p not in gone)
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0
    one = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(docs, batches=1).collect()}
    assert one == {i: r["text"] for i, r in got.items()}


def test_index_takes_further_batches(spark, docs, corpus, tmp_path):
    """Two appends to a folder, the second through an index opened again, find what one call finds; history is not shuffled."""
    folder = str(tmp_path / "index")
    old, new = docs.where("doc_id % 3 <> 1"), docs.where("doc_id % 3 = 1")
    substring_dedup.remove_repeats(old, batches=2, index=substring_dedup.FingerprintIndex(spark, folder, buckets=3)).count()
    index = substring_dedup.FingerprintIndex(spark, folder)
    assert index.batches == 2 and index.buckets == 3 and len(index.runs) == 2
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(new, index=index)
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in substring_dedup.remove_repeats(new, batches=1, index=index, history=old).collect()}
    whole = {r["doc_id"]: (r["n_removed"], r["text"]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == {i: x for i, x in whole.items() if i % 3 == 1} and any(n for n, _ in got.values())
    again = substring_dedup.FingerprintIndex(spark, folder)
    assert again.runs == [(1, 3, 3)] and again.batches == 3
    prints = lambda x: {r["fp"]: r["n"] for r in x.collect()}
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.lit(0).alias("batch"), F.col("doc_id").alias("row"))
    want = prints(substring_dedup.fingerprints(rows).groupBy("fp").agg(F.sum("n").alias("n")))
    assert prints(again._open(again.runs[0])) == want
    assert {r["fp"] for r in again.repeated().collect()} == {fp for fp, n in want.items() if n > 1}
    both = again._open(again.runs[0]).hint("merge").join(again._open(again.runs[0]).withColumnRenamed("n", "m"), "fp")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = both._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


@pytest.mark.parametrize("block", [8 << 20, 60])
def test_contamination(spark, docs, corpus, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    source = max((t for _, t in corpus if t), key=len)
    long = next(t for _, t in corpus if t and 40 < len(t.split()) < 90)
    items = [(1, " ".join(long.split()[3:30])), (2, "alpha1 beta2"), (3, None), (10, "日本"), (2, source[:40])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = defaultdict(set)
    for name, t in items:
        w = ALNUM.findall(fold(t))
        k = min(13, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            found[tuple(w[s : s + k])].add(str(name))
    for r in decontaminate.contamination(docs, bench).collect():
        w = ALNUM.findall(fold(dict(corpus)[r["doc_id"]]))
        hit, names = set(), set()
        for k in {len(x) for x in found}:
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in found:
                    hit |= set(range(s, s + k))
                    names |= found[tuple(w[s : s + k])]
        assert (r["n_words"], r["n_hit"], sorted(r["items"])) == (len(w), len(hit), sorted(names))
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))
    bad = {r["doc_id"] for r in decontaminate.contamination(docs, bench).collect() if r["contaminated"]}
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()} == {i for i, _ in corpus} - bad
    cut = decontaminate.decontaminate(docs, bench, remove="spans")
    assert cut.count() == len(corpus) and cut.columns == docs.columns
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty(spark), bench).count() == 0


def brute_components(corpus):
    def shingles(t):
        w = WS.findall(fold(t))
        return {tuple(w[s : s + 5]) for s in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in corpus}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_components(spark, docs, corpus):
    want = brute_components(corpus)
    assert len({c for _, c in want.values()}) < len(want) - 20
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(docs).collect()}
    assert got == want
    assert jaccard.similar_groups(empty(spark)).count() == 0


def test_jaccard_chain_of_near_copies(spark):
    """Each text is near the next one only, and the hot ones share most tokens."""
    rng = random.Random(3)
    words, rows = [f"w{i}" for i in range(150)], []
    for i in range(40):
        rows.append((i, " ".join(words)))
        words[rng.randrange(150)] = f"x{i}"
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows).items()}


def brute_sets(rows):
    def shingles(t):
        w = WS.findall(fold(t))
        return frozenset(tuple(w[s : s + 5]) for s in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} if w else ())

    return [(i, t, shingles(t)) for i, t in rows]


def near(a, b):
    return bool(a & b) and 100 * len(a & b) >= 80 * len(a | b)


def test_jaccard_pairs_are_all_links_between_classes(spark, docs, corpus):
    links, members = jaccard.similar_pairs(docs)
    owner = {r["node"]: [] for r in members.collect() if r["node"] is not None}
    for r in members.collect():
        if r["node"] is not None:
            owner[r["node"]].append(r["doc_id"])
    sets = {i: s for i, _, s in brute_sets(corpus)}
    classes = {sets[ids[0]]: sorted(ids) for ids in owner.values()}
    assert classes == {s: sorted(i for i in sets if sets[i] == s) for s in sets.values() if s}
    want = {tuple(sorted((min(x), min(y)))) for a, x in classes.items() for b, y in classes.items() if a != b and near(a, b)}
    got = [tuple(sorted((min(owner[r["a"]]), min(owner[r["b"]])))) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10
    degree = Counter(i for pair in want for i in pair)
    assert {r["doc_id"]: r["n_links"] for r in members.collect()} == {i: degree[min(classes[s])] if s else 0 for i, s in sets.items()}


def test_jaccard_hot_group_with_rounds_that_find_nothing(spark, monkeypatch):
    """Many near copies of one text, in chains and alone, beside texts that share its passage; also without any round."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(80)] = f"e{rng.randint(0, 9)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join([f"p{i}w{j}" for j in range(rng.randint(5, 60))] + base[:40])) for i in range(30)]
    rows += [(200, " ".join(f"long{i % 700}" for i in range(60_000))), (201, " ".join(f"long{i % 700}" for i in range(30_000)))]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, comp int, node string").repartition(5)
    want = {i: c for i, (_, c) in brute_components(rows).items()}
    for rounds in (6, 0):
        monkeypatch.setattr(jaccard, "ROUNDS", rounds)
        assert {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(docs).collect()} == want


def test_counts_of_the_sketch_never_fill():
    big = np.array([0, 1, 16, 17, 255, 1e4, 1e9, 1e12], np.float32)
    back = jaccard.COUNTS[jaccard.packed_counts(big)]
    assert (back[:3] == big[:3]).all() and (np.abs(back[1:] / big[1:] - 1) < 0.08).all()


def test_jaccard_judges_repeated_ids_by_their_texts(spark):
    text = lambda c, n=60: " ".join(f"{c}{i}" for i in range(n))
    rows = [(1, text("a")), (2, text("a") + " x"), (2, text("c")), (4, text("c") + " y"), (3, text("d")), (3, text("d") + " z"), (5, text("e")), (5, text("E")), (6, None), (None, text("f")), (None, text("a"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["row_key"]): r["component_id"] for r in jaccard.similar_groups(docs).collect()}
    keys = {(r["doc_id"], r["text"]): r["k"] for r in docs.withColumn("k", jaccard.row_key()).collect()}
    assert [got[i, keys[i, t]] for i, t in rows] == [1, 1, 2, 2, 3, 3, 5, 5, 6, None, 1]
    kept = Counter((r["doc_id"], (r["text"] or "-")[0].lower()) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == Counter([(1, "a"), (2, "c"), (3, "d"), (5, "e"), (6, "-"), (None, "f")])


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 7), (200, 201), (5, 5)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(31)}, 100: 0, 200: 200, 201: 200}


@pytest.mark.parametrize("name", [tokens.BYTE_LEVEL, tokens.WORD_ENDS])
def test_encoder_is_exact(corpus, name):
    e = tokens.WordEncoder(tokens.vocabulary(name), limit=50)
    rng = random.Random(1)
    odd = ["".join(rng.choice(["a", "B", " ", "  ", "\n", "\t", "é", "'s", "1", "!!", ",", "\x1c", "Σ", "<|endoftext|>", "\x01", "日本", " ", "　", "’"]) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    texts = [t for _, t in corpus] + odd
    for at in range(0, len(texts), 90):
        part = texts[at : at + 90]
        for t, ids in zip(part, e.encode_column(pa.array(part, pa.string())), strict=True):
            assert ids.astype("<u4").tobytes() == e.whole(t or "")


def test_encoder_gives_other_vocabularies_whole_texts(corpus, tmp_path):
    import json

    file = json.load(open(tokens.vocabulary(tokens.BYTE_LEVEL)))
    assert tokens._in_pieces(file) and tokens._in_pieces(json.load(open(tokens.vocabulary(tokens.WORD_ENDS))))
    file["pre_tokenizer"] = {"type": "Split", "pattern": {"Regex": "e"}, "behavior": "Isolated", "invert": False}
    (tmp_path / "other.json").write_text(json.dumps(file))
    e = tokens.WordEncoder(str(tmp_path / "other.json"))
    texts = [t for _, t in corpus if t is None or t.isascii()][:20]
    assert not e.in_pieces
    assert [x.astype("<u4").tobytes() for x in e.encode_column(pa.array(texts, pa.string()))] == [e.whole(t or "") for t in texts]


def test_packing(spark, docs, corpus):
    out = packing.pack_documents(docs, capacity=64, group=50).collect()
    e = tokens.encoder(tokens.vocabulary(tokens.WORD_ENDS))
    want = {i: np.frombuffer(e.whole(t or ""), "<u4").tolist() + [2] for i, t in corpus}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in out:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(ids) == r["length"]
        pieces[r["doc_id"]].append((r["start"], ids))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {i: [x for _, p in sorted(v) for x in p] for i, v in pieces.items()} == want
    for w in windows.values():
        end = 0
        for offset, length in sorted(w):
            assert offset == end
            end += length
        assert end <= 64
    total = sum(map(len, want.values()))
    assert total / (64 * len(windows)) > 0.9
    assert packing.pack_documents(empty(spark)).count() == 0


def test_packing_deals_copies_of_one_row_into_all_groups(spark):
    docs = spark.range(1200).select(F.lit(5).cast("long").alias("doc_id"), F.lit("the same words").alias("text")).repartition(4)
    out = packing.pack_documents(docs, capacity=64, group=100, with_ids=False).collect()
    assert len(out) == 1200
    per = Counter(r["sequence_id"] >> 32 for r in out)
    assert len(per) == 12 and max(per.values()) < 200


def test_differencing_balances():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 1000, 400)
    bins, sums = packing.difference(sizes, 20)
    assert sorted(np.bincount(bins, weights=sizes, minlength=20).astype(int).tolist()) == sorted(sums.tolist())
    assert sums.max() - sums.min() <= 20
    for n in (0, 1, 2):
        bins, used = packing.windows(sizes[:n], 1000)
        assert len(bins) == n and used <= max(n, 1)


def test_wavelet_shards(spark, docs, corpus):
    out = token_store.round_trip(docs, shard_tokens=500, partitions=3).orderBy("doc_id").collect()
    e, start = tokens.encoder(tokens.vocabulary(tokens.BYTE_LEVEL)), 0
    assert [r["doc_id"] for r in out] == sorted(i for i, _ in corpus)
    for r in out:
        ids = e.whole(dict(corpus)[r["doc_id"]] or "") + b"\0\0\0\0"
        assert bytes(r["ids"]) == ids and r["start"] == start and r["n_tokens"] == len(ids) // 4
        start += r["n_tokens"]
    assert token_store.round_trip(empty(spark)).count() == 0
    x = np.random.default_rng(4).integers(0, 70000, 3000).astype(np.uint32)
    x[::3] = 7
    s = token_store.Shard(token_store.build(x, [None, 5], np.array([1000, 2000])))
    assert (s.ids() == x).all() and s.doc_ids == [None, 5] and s.count(123456) == 0
    assert s.positions(7) == np.flatnonzero(x == 7).tolist() and s.count(7, 10, 20) == int((x[10:20] == 7).sum())
    assert all(s.access(i) == x[i] for i in range(0, 3000, 117))


def test_shards_read_only_the_blocks_they_need():
    x = np.random.default_rng(9).integers(0, 4000, 200_000).astype(np.uint32)
    for ids, block in ((x, 1024), (x[:1], 64), (x[:64], 64), (x[:4096], 64), (np.zeros(0, np.uint32), 64), (np.full(70, 5, np.uint32), 64)):
        data, taken = token_store.build(ids, [1], np.array([len(ids)]), block), []

        def read(at, size, data=data, taken=taken):
            taken.append(size)
            return data[at : at + size]

        s = token_store.Shard(read)
        for i in range(0, len(ids), max(1, len(ids) // 40)):
            token = int(ids[i])
            assert s.access(i) == token and s.count(token, 0, i) == int((ids[:i] == token).sum())
            assert s.select(token, s.count(token, 0, i)) == i
        assert (s.ids() == ids).all()
        for i in (-1, len(ids)):
            with pytest.raises(IndexError):
                s.access(i)
    data, taken = token_store.build(x, [1], np.array([len(x)]), 1024), []
    s = token_store.Shard(lambda at, size: taken.append(size) or data[at : at + size])
    assert s.access(123_456) == x[123_456]
    directories = sum(s._ends[i + 1] - s._ends[i] for i in (0, 4, 5))
    assert sum(taken) - directories < 4000 < len(data) / 50


def test_quality_learns_and_holds_out(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(40)]
        rows.append((i, " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((i, int(good) if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - int(good)))  # held-out labels are wrong on purpose
    docs = spark.createDataFrame([*rows, (None, None), (900, "")], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([*labels, (None, 1), (901, None)], "doc_id long, quality int"))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs.withColumn("score", F.lit("x")), model).collect()}
    right = [(got[i] >= 0.7) == (lab == 1) for (i, lab) in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    wrong = [(got[i] >= 0.7) == (lab == 1) for (i, lab) in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean(right) > 0.98 and np.mean(wrong) < 0.05
    assert 0 <= got[900] <= 1 and 0 <= got[None] <= 1
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.score(empty(spark), none).count() == 0


def test_html_extraction(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=/>Home</a></nav><div class='ad'>Buy this, now. Really!</div>"
        "<article><h1>Head &amp; more</h1><p>One <b>bo</b>ld,\n two.<br>three<p>Four.<script>var x='</p>';</script><form>name <input></form><!-- no --><aside>side</aside></article>"
        "<div id=comments><p>First, great, really great text. I like it.</p></div><footer>&copy; x</footer>"
    )
    plain = "<body><div id='menu'><a>Home</a> <a>News</a></div><div><p>A long text, with words, and more of it. It goes on.<p>Short.</div><div class=comments>Nice, very nice. Yes.</div>"
    df = spark.createDataFrame([(1, "u", page), (2, None, plain), (3, "u", None), (3, "u", ""), (4, "u", "<p>unclosed"), (5, "u", "<<<>>>")], "page_id long, url string, html string")
    got = defaultdict(list)
    for r in html_text.extract(df.withColumn("text", F.lit(1))).collect():
        got[r["page_id"]].append(r["text"])
    assert got[1] == ["Head & more One bold, two. three Four."]
    assert got[2] == ["A long text, with words, and more of it. It goes on. Short."]
    assert got[3] == ["", ""] and got[4] == ["unclosed"] and len(got[5]) == 1


def test_html_ratios_decide_beside_and_within_an_article():
    prose = "A long body text, with many words and commas, that goes on. It has several sentences, too, and says a lot. "
    links = "".join(f"<li><a href=/{i}>Other story {i}</a></li>" for i in range(4))
    teaser = f"<body><div id=story><h1>Body head</h1><p>{prose * 3}</p><p>{prose}</p></div><article class=teaser><h3><a href=/x>Other story</a></h3><p>Short teaser.</p></article>"
    assert html_text.main_text(teaser).startswith("Body head " + prose * 4)
    held = f"<body><article><h1>Head</h1><p>{prose * 3}</p><ul>{links}</ul><h2>Items</h2><p>One <a href=/q>linked</a> <b>word</b>, two.</p><ol><li>Eggs</li><li>a</li></ol><pre><code>x = 1</code></pre></article><div>All rights reserved.</div>"
    assert html_text.main_text(held) == f"Head {prose * 3}Items One linked word, two. Eggs a x = 1"


def test_language_fusion(spark):
    rng = random.Random(6)
    syll = {"aa": ["lo", "mi", "ra", "te"], "bb": ["sch", "ung", "ver", "ich"]}
    text = lambda lang, n=40: " ".join("".join(rng.choice(syll[lang]) for _ in range(3)) for _ in range(n))
    docs = spark.createDataFrame([(i, lang, text(lang)) for i in range(60) for lang in ("aa", "bb")] + [(None, "aa", "x"), (7, None, "y")], "doc_id long, lang string, text string")
    pages, truth = [], {}
    for i in range(80):
        lang = "aa" if i % 2 else "bb"
        truth[i] = lang
        pages.append((i, f"http://{'one' if lang == 'aa' else 'two'}.example/{i}", f"<html lang='{lang}'><body><article><p>{text(lang)}</p></article></body></html>"))
    pages += [(100, "http://one.example/none", None), (101, None, ""), (102, "http://two.example/x", "<html><body></body></html>")]
    model = language.train(docs)
    got = {r["page_id"]: r for r in language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    assert all(got[i]["lang"] == lang and got[i]["probability"] > 0.5 for i, lang in truth.items())
    assert got[100]["lang"] == "aa" and got[102]["lang"] == "bb" and got[100]["text_lang"] is None and got[101]["lang"] in ("aa", "bb")
    assert language.identify(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


def test_language_against_a_plain_version(spark):
    """Likelihoods, priors of host and suffix and the table of declarations, page by page in plain Python."""
    import math

    rng = random.Random(12)
    syll = {"aa": ["lo", "mi", "ra"], "bb": ["lo", "sch", "ung"], "cc": ["mi", "ich", "qu"]}
    text = lambda lang, n: " ".join("".join(rng.choice(syll[lang]) for _ in range(3)) for _ in range(n))
    docs = spark.createDataFrame([(i, lang, text(lang, 25), "x") for i in range(30) for lang in syll], "doc_id long, lang string, text string, k string")
    model = language.train(docs)
    langs, n = model.languages, len(model.languages)
    pages = []
    for i in range(60):
        lang = rng.choice(list(syll))
        said = rng.choice([lang, lang, rng.choice(list(syll)), "zz", None])
        body = text(lang, rng.randint(0, 6))
        pages.append((i % 50, f"http://h{rng.randint(0, 4)}.example.{rng.choice(['aa', 'org'])}/p", f"<html{f' lang={said}' if said else ''}><body><article><p>{body}</p></article></body></html>"))
    pages += [(70, None, None), (None, "odd", "")]
    got = language.identify(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1)), model).collect()

    def likelihood(t):
        raw = t.encode().lower()
        ids = [int(textcore.mix64(np.array([raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]], np.uint64))[0]) & ((1 << language.BITS) - 1) for i in range(len(raw) - 2)]
        weight = min(len(ids), language.EFFECTIVE) / max(len(ids), 1)
        return [sum(model.logs[j][x] for x in ids) * weight for j in range(n)]

    def normal(logs):
        top = max(logs)
        e = [math.exp(x - top) for x in logs]
        return [x / sum(e) for x in e]

    rows = []
    for pid, url, html in pages:
        t = html_text.main_text(html)
        m, said = re.match(r"[a-z]+://([^/]*)", url or ""), re.search(r"<html lang=(\w+)", html or "")
        host = m[1] if m else ""
        kind = -2 if not said else langs.index(said[1]) if said[1] in langs else -1
        rows.append((pid, host, host.rpartition(".")[2], kind, likelihood(t), len(t)))
    p = [normal(r[4]) for r in rows]
    total = lambda keep: [sum(p[i][j] for i, r in enumerate(rows) if keep(r)) for j in range(n)]
    size = lambda keep: sum(map(keep, rows))
    whole = [(x + 1) / (len(rows) + n) for x in total(lambda r: True)]
    table = {k: total(lambda r, k=k: r[3] == k) for k in range(-2, n)}
    want = []
    for i, (pid, host, suffix, kind, ll, _) in enumerate(rows):
        lean = [(x + language.LEAN * w) / (size(lambda r: r[2] == suffix) + language.LEAN) for x, w in zip(total(lambda r: r[2] == suffix), whole, strict=True)]
        prior = [(max(x - own, 0) + language.LEAN * q) / (size(lambda r: r[1] == host) - 1 + language.LEAN) for x, own, q in zip(total(lambda r: r[1] == host), p[i], lean, strict=True)]
        word = [math.log((table[kind][j] + 1) / (sum(table[k][j] for k in table) + n + 2)) for j in range(n)]
        q = normal([a + b + math.log(c) for a, b, c in zip(ll, word, prior, strict=True)])
        want.append((pid, langs[q.index(max(q))], max(q)))
    key = lambda r: (str(r[0]), r[1], round(r[2], 6))
    assert sorted(map(key, want)) == sorted(key((r["page_id"], r["lang"], r["probability"])) for r in got)
    assert len({w[1] for w in want}) == 3


def test_every_language_gets_a_model(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, "rare").otherwise("much").alias("lang"), F.lit("some text here").alias("text"))
    assert language.train(docs, sample=20).languages == ["much", "rare"]
    assert language.train(docs.limit(0)).languages == []


def test_support_vectors_against_a_plain_solver():
    """Ratios by counting, the dual optimum by slow projected gradient, margins by the sum over features."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 30, rng.integers(1, 9)) + (15 if i % 2 else 0)) for i in range(40)]
    y = np.array([1 if i % 2 else -1 for i in range(40)])
    y[[3, 8]] *= -1
    ratios = quality.log_count_ratios(rows, y, 64)
    seen = {s: [sum(f in r for r, t in zip(rows, y, strict=True) if t == s) + 1 for f in range(64)] for s in (1, -1)}
    assert np.allclose(ratios, [np.log(seen[1][f] / sum(seen[1]) / (seen[-1][f] / sum(seen[-1]))) for f in range(64)])
    x = np.zeros((40, 65))
    for i, r in enumerate(rows):
        x[i, r] = ratios[r] / max(1e-12, np.sqrt((ratios[r] ** 2).sum()))
    x[:, 64] = 1
    cap = np.array([len(y) / (2 * (y == s).sum()) for s in y])
    q = (x * y[:, None]) @ (x * y[:, None]).T
    alpha = np.zeros(40)
    for _ in range(200_000):
        alpha = np.clip(alpha - 0.01 * (q @ alpha - 1), 0, cap)
    w, bias = quality.dual_coordinate_descent(rows, y, ratios, epochs=3000)
    value = lambda v: v @ v / 2 + (cap * np.maximum(0, 1 - y * (x @ v))).sum()
    best = value((alpha * y) @ x)
    assert abs(value(np.append(w, bias)) - best) < 0.02 * best
    model = quality.Model(w, ratios, bias, 1.0, 0.0, 6)
    doc = np.repeat(np.arange(40), [len(r) for r in rows])
    assert np.allclose(model.margins(doc, np.concatenate(rows), 40), [(w[r] * ratios[r]).sum() / np.sqrt((ratios[r] ** 2).sum()) + bias for r in rows])


def test_quality_features_against_sets():
    """Words and pairs of a text are those of plain Python, by the same hashes; a document's features are distinct."""
    texts = ["One two two. One two", "x", "", None, "One"]
    doc, f = quality.features(pa.array(texts, pa.string()))
    per = [set(f[doc == d].tolist()) for d in range(len(texts))]
    assert all(len(p) == int((doc == d).sum()) for d, p in enumerate(per)) and not per[2] and not per[3]
    mask = np.uint64((1 << quality.BITS) - 1)
    for d, t in enumerate(texts):
        w = textcore.scan(pa.array([t], pa.string()), textcore.SPACE_SEP, textcore.FOLD).hashes
        ones = {int(textcore.mix64(np.array([h], np.uint64) + np.uint64(9))[0] & mask) for h in textcore.mix64(w).tolist()} if len(w) else set()
        assert ones <= per[d]
    assert per[4] < per[0]


def test_quality_sample_has_a_bound_in_bytes(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 50) for i in range(60)] + [(3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(60)] + [(5, 7, "y"), (70, 1, "z")], "doc_id long, quality int, text string")
    wide, narrow = (quality.train(docs, labels, sample_bytes=b) for b in (1 << 20, 1500))
    assert (wide.ratios != 0).sum() > (narrow.ratios != 0).sum() > 0


CLASHES = ["_lines", "_d", "_r", "_dd", "_rr", "_drop", "_loses", "_n_lines", "_n_dropped", "_items", "_spans", "_n_words", "_hit", "_i", "_s", "_t", "_stay", "_id", "_score", "_maybe", "_bucket", "_at", "_found", "_bitmap", "drop", "key", "n", "row", "marks", "own", "h", "k", "y"]


def clashing(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return docs.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHES])


def held(df, change=()):
    """The clashing columns must come back as they went in."""
    out = []
    for r in df.collect():
        assert all(r[c] == f"{c}:{'-' if r['doc_id'] is None else r['doc_id']}" for c in CLASHES if c not in change)
        out.append((r["doc_id"], r["text"]))
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))


LINE = "This line is repeated and is longer than forty characters."


def test_line_dedup_null_ids_repeats_and_clashes(spark):
    rows = [(None, f"{LINE}\nown"), (None, f"{LINE}\nown"), (1, f"  {LINE.upper()}\nb\n{LINE}"), (2, LINE), (2, LINE), (3, f"c\n{LINE}"), (3, f"{LINE}\nother"), (4, None), (5, ""), (6, "x\n" * 30_000 + LINE)]
    got = held(line_dedup.dedup_lines(clashing(spark, rows)), ("_n_lines", "_n_dropped"))
    want = [(None, "own"), (None, "own"), (1, "b"), (2, ""), (2, ""), (3, "c"), (3, "other"), (4, None), (5, ""), (6, "x\n" * 30_000 + LINE)]
    assert got == sorted(want, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    alone = [(None, LINE)] * 6
    assert held(line_dedup.dedup_lines(clashing(spark, alone)), ("_n_lines", "_n_dropped")) == alone
    counted = line_dedup.dedup_lines(clashing(spark, rows), counts=("a", "b"))
    assert held(counted) == got and {(r["doc_id"], r["a"], r["b"]) for r in counted.collect()} >= {(1, 3, 2), (4, 1, 0), (6, 30_001, 0)}


@pytest.mark.parametrize("block", [8 << 20, 40])
def test_decontamination_null_ids_repeats_and_clashes(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    item = " ".join(f"q{i}" for i in range(20))
    rows = [(None, f"Before, {item.upper()}; after"), (1, f"Before, {item}; after"), (1, f"Before, {item}; after"), (1, "clean"), (2, None), (3, ""), (4, f"{item} " + "w " * 2000), (5, "short one here"), (6, f"{item} and q0 q1")]
    bench = spark.createDataFrame([(1, item), (2, "Short one"), (None, "short one"), (3, None), (4, "!!")], "item_id long, text string")
    docs = clashing(spark, rows)
    stay = [r for r in rows if r[1] in ("clean", None, "") or r[0] == 4]
    assert held(decontaminate.decontaminate(docs, bench)) == sorted(stay, key=lambda x: (x[0], x[1] or ""))
    cut = dict((r[0], r[1]) for r in held(decontaminate.decontaminate(docs, bench, remove="spans")))
    assert cut[None] == "Before, ; after" and cut[5] == " here" and cut[6] == " and q0 q1" and cut[4] == f"{item} " + "w " * 2000
    found = decontaminate.contamination(docs, bench).where("doc_id = 5").first()
    assert (found["n_words"], found["n_hit"], sorted(found["items"]), found["contaminated"]) == (3, 2, ["", "2"], True)
    assert held(decontaminate.decontaminate(docs, bench.limit(0))) == held(docs)


def test_hits_are_verified_by_their_words(spark, monkeypatch):
    """With hashes that are all alike only the digests of the words can tell windows apart."""
    monkeypatch.setattr(decontaminate, "ngrams", lambda h, k: np.zeros(max(0, len(h) - k + 1), np.uint64))
    w = decontaminate.Windows([("a", "one two three"), ("b", "four five six"), ("c", "one two three")], 3)
    hit, pairs = w.hits(textcore.scan(pa.array(["zero one TWO three", "five six"]), textcore.ALNUM_SEP, textcore.FOLD))
    assert hit.tolist() == [False, True, True, True, False, False] and pairs == {(0, "a"), (0, "c")}


def test_second_hashes_are_independent_and_the_same_in_blocks(corpus):
    texts = pa.array([t for _, t in corpus], pa.string())
    w = textcore.scan(texts)
    one = textcore.second_hashes(w)
    old, textcore._BLOCK = textcore._BLOCK, 64
    try:
        assert (textcore.second_hashes(textcore.scan(texts)) == one).all()
    finally:
        textcore._BLOCK = old
    assert len(np.unique(one)) == len(np.unique(w.hashes)) and not np.isin(one, w.hashes).any()


def test_packing_and_shards_null_ids_repeats_and_clashes(spark):
    e = tokens.encoder(tokens.vocabulary(tokens.WORD_ENDS))
    rows = [(None, "a b"), (None, "a b"), (3, "x"), (3, "x"), (3, "y z"), (9, None), (8, " ".join(f"w{i % 90}" for i in range(9000)))]
    docs = clashing(spark, rows).withColumn("length", F.lit("s")).withColumn("ids", F.lit(0))
    got = Counter()
    for r in packing.pack_documents(docs, capacity=64, group=2).collect():
        got[r["doc_id"], r["doc_tokens"]] += r["length"]
    sizes = Counter()
    for i, t in rows:
        n = len(e.whole(t or "")) // 4 + 1
        sizes[i, n] += n
    assert got == sizes
    out = [(r["doc_id"], bytes(r["ids"])) for r in token_store.round_trip(docs, partitions=2).orderBy("start").collect()]
    b = tokens.encoder(tokens.vocabulary(tokens.BYTE_LEVEL))
    assert Counter(out) == Counter((i, b.whole(t or "") + bytes(4)) for i, t in rows)
    assert [i for i, _ in out] == [None, None, 3, 3, 3, 8, 9]


def test_substring_dedup_null_ids_and_repeats(spark):
    words = " ".join(f"v{i}" for i in range(40))
    rows = [(None, f"a {words}"), (None, "b"), (1, f"{words} c"), (2, "d " * 34), (2, None), (4, " ".join(f"u{i % 50}" for i in range(20_000))), (5, " ".join(f"z{i}" for i in range(36))), (5, " ".join(f"z{i}" for i in range(36)))]
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup.remove_repeats(clashing(spark, rows)).collect())
    assert got == Counter([(None, 41, 40, "a"), (None, 1, 0, "b"), (1, 41, 40, "c"), (2, 34, 0, " ".join(["d"] * 34)), (2, 0, 0, ""), (4, 20_000, 20_000, ""), (5, 36, 36, ""), (5, 36, 36, "")])


def plain_ratios(page):
    """Scores of a tidy page's paths, each block by itself; tags in class-free markup only."""
    from html.parser import HTMLParser

    blocks = []

    class Reader(HTMLParser):
        path, linked = [], 0

        def handle_starttag(self, tag, attrs):
            self.linked += tag == "a"
            if tag not in ("a", "b"):
                self.path.append(tag)
                blocks.append([tuple(self.path), "", 0])

        def handle_endtag(self, tag):
            self.linked -= tag == "a"
            if tag not in ("a", "b"):
                self.path.pop()
                blocks.append([tuple(self.path), "", 0])

        def handle_data(self, data):
            if blocks:
                blocks[-1][1] += data
                blocks[-1][2] += len("".join(data.split())) * bool(self.linked)

    Reader().feed(page)
    blocks = [(p, " ".join(t.split()), k) for p, t, k in blocks if t.strip()]
    size = lambda t: len("".join(t.split()))
    paths = {p for p, _, _ in blocks}
    mine = {p: [b for b in blocks if b[0] == p] for p in paths}
    sums = {p: (len(b), sum(size(t) for _, t, _ in b), sum(sum(c in ",.;:!?" for c in t) for _, t, _ in b), sum(k for _, _, k in b)) for p, b in mine.items()}
    ratio = {p: np.log1p(c / n) * (1 + np.log1p(d / n)) * (1 - k / c) for p, (n, c, d, k) in sums.items()}
    row, total = [ratio[p] for p, _, _ in blocks], dict.fromkeys(paths, 0.0)
    for i, (p, _, _) in enumerate(blocks):
        near = [(w, row[i + d]) for d, w in ((-1, 1.0), (0, 2.0), (1, 1.0)) if 0 <= i + d < len(row)]
        smooth = sum(w * v for w, v in near) / sum(w for w, _ in near)
        total[p] += smooth + np.sqrt(ratio[p] * smooth)
    score = {p: v / sums[p][0] for p, v in total.items()}
    inside = {p for p in paths if "article" in p}
    held = sum(sums[p][1] - sums[p][3] for p in inside)
    share = held / max(1, sum(s[1] - s[3] for s in sums.values()))
    prior = {p: 1 + html_text.HELD * share * (1 - sums[p][3] / sums[p][1]) if p in inside else 1 - share for p in paths}
    limit = html_text.THRESHOLD * sum(score.values()) / len(score)
    return " ".join(t for p, t, _ in blocks if prior[p] * score[p] > limit)


def test_html_ratios_against_a_plain_version(monkeypatch):
    """Unmarked link lists, adverts and notes within and beside an article: ratios tell them from the text, as computed by hand."""
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) + rng.choice(["", "", "", ","]) for _ in range(n)) + "."
    kept = 0
    for i in range(30):
        links = "".join(f"<li><a href='/{j}'>{prose(3)}</a></li>" for j in range(rng.randint(2, 7)))
        body = "".join(f"<p>{prose(rng.randint(10, 80))}</p>" for _ in range(rng.randint(1, 6)))
        advert, note = f"<section><div><a href='/buy'>{prose(2)}</a> now</div></section>", f"<dl><dt>{prose(1)}</dt></dl>"
        parts = [f"<h1>{prose(5)}</h1>", body, f"<ul>{links}</ul>", advert, note]
        page = f"<html><body><div><p>{prose(4)}</p></div>" + (f"<article>{''.join(parts)}</article>" if i % 2 else f"<div>{''.join(parts)}</div>") + f"<ol>{links}</ol></body></html>"
        text = html_text.main_text(page)
        assert text == plain_ratios(page)
        with monkeypatch.context() as m:
            m.setattr(html_text, "THRESHOLD", -1.0)
            everything = html_text.main_text(page)
        assert text and text != everything and all(p in text for p in re.findall(r"<p>([^<]{200,})</p>", body))
        kept += len(text) / len(everything)
    assert 0.5 < kept / 30 < 0.95


def test_key_filters_miss_nothing(spark):
    from lodestar.llm import shared

    rng = np.random.default_rng(6)
    keys = rng.integers(-(1 << 63), (1 << 63) - 1, 500)
    others = rng.integers(-(1 << 63), (1 << 63) - 1, 2000)
    df = spark.createDataFrame([(int(k),) for k in keys], "key long")
    rows = spark.createDataFrame([(int(k), "x", "y") for k in [*keys, *others]], "k long, _bucket string, _found string")
    for bits in (29, 6):
        held = shared.key_filter(df, "key", 500, bits)
        assert held.test(keys.view(np.uint64)).all()
        flagged = shared.flag_maybe_in(rows, F.col("k"), df, 500, "_maybe", bits)
        assert flagged.columns == [*rows.columns, "_maybe"]
        passed = {r["k"] for r in flagged.where("_maybe").collect()}
        assert passed >= {int(k) for k in keys} and flagged.count() == 2500
        assert passed == {int(k) for k in [*keys, *others] if held.test(np.array([k]).view(np.uint64))[0]}
        assert {r["k"] for r in shared.maybe_in(rows, F.col("k"), df, 500, bits).collect()} == passed
    assert shared.maybe_in(rows, F.col("k"), df.limit(0), 0).count() == 0
    assert shared.free_names(rows, "K", "_found", "z", "z") == ["K_", "_found_", "z", "z_"]


def test_shared_folder_is_needed_on_a_cluster(spark):
    from types import SimpleNamespace as Fake

    from lodestar.llm import shared

    assert shared.shared_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    none = Fake(sc=lambda: Fake(getCheckpointDir=lambda: Fake(isDefined=lambda: False)))
    bare = Fake(conf=Fake(get=lambda name, default: default), sparkContext=Fake(master="spark://host:7077", _jsc=none))
    with pytest.raises(RuntimeError, match="shared folder"):
        shared.shared_root(bare)


def test_jaccard_merges_tokens_of_the_same_classes(spark):
    """Near copies meet in few tokens, however many they share; a word sequence by chance in two texts of other sizes in none."""
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, chance = [], words(5)
    for i in range(40):
        text = words(300)
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join([*text[:-4], *words(4)]))]
    rows += [(1000 + i, " ".join([*words(60 * 2**i), *chance])) for i in range(2)]
    docs = spark.createDataFrame([*rows, rows[0], rows[0]], "doc_id long, text string")
    _, _, entries, _ = jaccard._prepared(docs, "doc_id", "text", 80)
    of = Counter(r["node"] for r in entries.collect())
    assert len(of) == 80 and max(of.values()) <= 2
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(docs).collect()}
    assert got == {i: i // 2 * 2 if i < 1000 else i for i, _ in rows}
