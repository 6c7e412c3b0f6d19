"""Jaccard join of word shingles with adaptive multi-match prefixes, its links and its components.

Sets with 100 |A n B| >= 80 |A u B| have an overlap of o = ceil(80 (|A| + |B|) / 180) or more, so the first
|A| - o + L tokens of A and |B| - o + L of B share L tokens, in any one order of all tokens. The order here is by
estimated document frequency, rare tokens first. A document whose prefix for L = 1 promises many candidates takes
a longer prefix and a larger L; a pair is verified if it shares as many tokens in its two prefixes as the smaller
L of the two. Prefixes are written out for the longest a document may need, |A| - ceil(0.8 |A|) + L.

Equal sets are one class, and one row stands for each class: its node is the hash of id and text of the row with the
smallest id, so rows that share an id are apart unless their sets are equal. Ids come back at the end only.

Components need no link inside a component found already. Rounds first compare each class with one leader for each
of its prefix tokens, which joins groups of near copies by work in proportion to their tokens. Tokens left with classes
of different components then give every pair of such classes, and all links that are missing are among these. Each set
also has 256 parity bits of its tokens: sets differ in at least as many tokens as their parities in bits, so pairs
that differ in too many bits are left out there, and no link is lost.

Near copies share many tokens, and chance gives many pairs of texts one. So tokens of the same classes are one, with a
number and the first place in each prefix, before anything is joined; a token of two classes that its places or their
sizes keep from being a link is left out. Both only ask less of a pair before it is verified.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import discard, give_back, key_filter, map_arrow, maybe_in, prepare, staged
from .textcore import FOLD, SPACE_SEP, U64, mix64, ngrams, scan, slices

SHINGLE = 5
#: Counters of the frequency sketch (a byte each, 32 MB in SEGMENTS parts), the same at any size of the corpus.
SKETCH, SEGMENTS = 1 << 25, 8
#: What a counter's byte stands for: exact up to 16, then in steps of 12 %, so that no corpus fills it.
COUNTS = np.concatenate([np.arange(17), 16 * 1.12 ** np.arange(1, 240)]).astype(np.float32)
#: Estimated candidates from which a prefix is lengthened to L = 2, 3 and 4.
COSTS = (16, 128, 1024)
#: Rounds of comparing with leaders, at most; the share of a round's pairs that must be links for another one.
ROUNDS, WORTH = 6, 0.02
PARITY = ("p1", "p2", "p3", "p4")


def shingle_sets(arr: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of fewer than k words, the whole sequence is one."""
    w = scan(arr, SPACE_SEP, FOLD)
    grams, out = ngrams(w.hashes, k), []
    for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if hi - lo >= k:
            out.append(np.unique(grams[lo : hi - k + 1]))
        elif hi > lo:
            out.append(mix64(ngrams(w.hashes[lo:hi], hi - lo) + U64(hi - lo)))
        else:
            out.append(np.zeros(0, U64))
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int = 80) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum()) if len(large) else 0
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """256 parity bits of each set, as four integers."""
    out = np.zeros((len(sets), 4), np.int64)
    for i, s in enumerate(sets):
        bits = np.bincount((s >> U64(56)).astype(np.int64), minlength=256).astype(np.uint8) & 1
        out[i] = np.packbits(bits).view(np.int64)
    return out


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """What rows are told apart by: a hash of id and text."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def packed_counts(total: np.ndarray) -> np.ndarray:
    """The nearest byte of COUNTS for each count."""
    return np.searchsorted((COUNTS[1:] + COUNTS[:-1]) / 2, total, side="right").astype(np.uint8)


def _signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, h1, h2, PARITY) of each document, and the parts of a sketch of shingle counts of each task (n = -1 - part)."""
    names = ["doc_id", "key", "n", "h1", "h2", *PARITY, "sketch"]

    def run(batches):
        from pyspark import TaskContext

        sketch = np.zeros(SKETCH, np.uint8)
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"))
                for s in sets:
                    at = (s & U64(SKETCH - 1)).astype(np.int64)
                    now = sketch[at]
                    sketch[at] = now + (now < 255)
                h1 = np.array([mix64(s).sum(dtype=U64) for s in sets], U64)
                h2 = np.array([mix64(s ^ U64(0x1F83D9ABFB41BD6B)).sum(dtype=U64) for s in sets], U64)
                n = np.array([len(s) for s in sets], np.int64)
                bits = [pa.array(x) for x in parities(sets).T.copy()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), *bits, pa.nulls(len(part), pa.binary())], names=names)
        one, task = pa.array([0], pa.int64()), pa.array([TaskContext.get().partitionId()], pa.int64())
        table = packed_counts(np.arange(256))
        for i, part in enumerate(np.split(sketch, SEGMENTS)):
            if part.any():
                packed = zlib.compress(table[part].tobytes(), 1)
                yield pa.RecordBatch.from_arrays([one, task, pa.array([-1 - i], pa.int64()), *[one] * 6, pa.array([packed], pa.binary())], names=names)

    return map_arrow(docs, run, ", ".join([*(f"{c} long" for c in names[:-1]), "sketch binary"]))


def _sketch(parts: DataFrame) -> tuple[np.ndarray, float]:
    """The sum of all tasks' sketches (task, segment, sketch), and its median count: sixteen tasks' parts at a time are added up on the
    executors until one of each segment is left, so the driver gets 32 MB at most."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH // SEGMENTS, np.float32)
        for x in table.column("sketch"):
            total += COUNTS[np.frombuffer(zlib.decompress(x.as_py()), np.uint8)]
        return pa.table({"task": [table.column("task")[0].as_py() // 16], "segment": [table.column("segment")[0].as_py()], "sketch": pa.array([zlib.compress(packed_counts(total).tobytes(), 1)], pa.binary())})

    tasks = parts.agg(F.max("task").alias("m")).first()["m"] or 0
    made = []
    while True:
        grouped = parts.withColumn("_of", F.expr("task div 16")).groupBy("segment", "_of")
        parts = staged(grouped.applyInArrow(lambda t: add(t), "task long, segment long, sketch binary"), "sketch")
        made.append(parts)
        tasks //= 16
        if tasks == 0:
            break
    total = np.zeros((SEGMENTS, SKETCH // SEGMENTS), np.uint8)
    for r in parts.toLocalIterator():
        total[r["segment"]] = np.frombuffer(zlib.decompress(bytes(r["sketch"])), np.uint8)
    discard(*made)
    often = sum(np.bincount(part, minlength=256) for part in total.reshape(SEGMENTS * 8, -1))
    return total.reshape(-1), float(COUNTS[np.searchsorted(np.cumsum(often), SKETCH // 2)])


def _prefixes(s: np.ndarray, counts: np.ndarray, base: float, percent: int) -> tuple[np.ndarray, int, float]:
    """A set's longest prefix, its L, and how common its tokens are on the whole."""
    n = len(s)
    freq = COUNTS[counts[(s & U64(SKETCH - 1)).astype(np.int64)]]
    order = np.lexsort((s, freq))
    need = -(-percent * n // 100)
    cost = float(np.maximum(freq[order[: n - need + 1]] - base, 0).sum())
    ell = min(1 + sum(cost > c for c in COSTS), need)
    return s[order[: n - need + ell]], ell, float(np.log1p(freq).mean())


def _tokens(docs: DataFrame, sketch, base: float, percent: int) -> DataFrame:
    """The prefix tokens of each set."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = [_prefixes(s, sketch.value, base, percent)[0] for s in shingle_sets(part.column("text")) if len(s)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["token"])

    return map_arrow(docs.select("text"), run, "token long")


def _entries(docs: DataFrame, sketch, base: float, percent: int, keys) -> DataFrame:
    """(token, node, n, pos, ell, pop) of the prefix tokens that pass a broadcast filter; pos: the place in the prefix."""
    schema = "token long, node long, n int, pos int, ell int, pop float"

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                rows, tokens, places = [], [], []
                for key, s in zip(part.column("key").to_pylist(), shingle_sets(part.column("text")), strict=True):
                    if not len(s):
                        continue
                    prefix, ell, pop = _prefixes(s, sketch.value, base, percent)
                    pos = np.flatnonzero(keys.value.test(prefix))
                    if len(pos):
                        rows.append((key, len(s), ell, pop, len(pos)))
                        tokens.append(prefix[pos])
                        places.append(pos.astype(np.int32))
                if rows:
                    key, n, ell, pop, sizes = zip(*rows, strict=True)
                    each = lambda x, kind: pa.array(np.repeat(np.array(x, kind), sizes))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(tokens).view(np.int64)), each(key, np.int64), each(n, np.int32), pa.array(np.concatenate(places)), each(ell, np.int32), each(pop, np.float32)],
                        names=["token", "node", "n", "pos", "ell", "pop"],
                    )

    return map_arrow(docs.select("key", "text"), run, schema)


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of keys whose texts' shingle sets are similar. Texts are fetched for these pairs alone."""
    ids = staged(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct(), "ids")
    some = maybe_in(texts, F.col("key"), ids, ids.count()).dropDuplicates(["key"])
    left = some.select(F.col("key").alias("a"), F.col("text").alias("ta"))
    right = some.select(F.col("key").alias("b"), F.col("text").alias("tb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "ta"):
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                held = {k: held[k] for k in {*a, *b} & held.keys()}
                for ids, column in ((a, "ta"), (b, "tb")):
                    new = {x: i for i, x in enumerate(ids) if x not in held}
                    if new:
                        held.update(zip(new, shingle_sets(part.column(column).take(pa.array(list(new.values())))), strict=True))
                good = pa.array([similar(held[x], held[y], percent) for x, y in zip(a, b, strict=True)], pa.bool_())
                yield part.select(["a", "b"]).filter(good)

    out = staged(map_arrow(both, run, "a long, b long"), "links")
    discard(ids)
    return out


def _merged_tokens(entries: DataFrame, percent: int) -> DataFrame:
    """(token, node, n, pos, ell, pop, k): tokens of the same classes as one, k of them, pos the first of their places.

    Tokens are told apart by a hash of their classes; if two sets of classes had the same one, they would be one token,
    and a pair would count too much in common, never too little. So it is with entries that are there twice.
    """
    place = F.expr("shiftleft(cast(n as bigint), 32) + pos * 4L + ell - 1")  # n, pos and ell in one long
    ends = entries.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min(place).alias("lo"), F.max(place).alias("hi"))
    for s in ("lo", "hi"):
        ends = ends.withColumns({f"{s}n": F.shiftright(s, 32), f"{s}pos": F.expr(f"({s} & 4294967295L) div 4"), f"{s}ell": F.expr(f"({s} & 3) + 1")})
    useful = ends.where((F.col("c") > 2) | (F.col("c") == 2) & (F.col("x") != 0) & _may_link("lo", "hi", percent))
    names = useful.select("token", F.xxhash64("c", "x").alias("_as"))
    same = entries.join(names, "token").groupBy(F.col("_as").alias("token"), "node")
    return same.agg(*[F.max(c).alias(c) for c in ("n", "ell", "pop")], F.min("pos").alias("pos"), F.count(F.lit(1)).alias("k"))


def _may_link(x: str, y: str, percent: int):
    """Sizes near enough, and the shared token within the prefixes that these sizes call for."""
    xn, yn, xp, yp = (F.col(c).cast("long") for c in (f"{x}n", f"{y}n", f"{x}pos", f"{y}pos"))
    overlap = F.ceil((xn + yn) * percent / (100 + percent))
    ell = F.least(F.col(f"{x}ell"), F.col(f"{y}ell"))
    near = F.least(xn, yn) * 100 >= F.greatest(xn, yn) * percent
    return near & (xp < xn - overlap + ell) & (yp < yn - overlap + ell)


def _pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Pairs (a, b), a < b, that share as many prefix tokens as the smaller L of the two asks for."""
    a, b = F.least(f"{x}node", f"{y}node").alias("a"), F.greatest(f"{x}node", f"{y}node").alias("b")
    counted = rows.groupBy(a, b).agg(F.sum(F.least(f"{x}k", f"{y}k")).alias("c"), F.min(F.least(f"{x}ell", f"{y}ell")).alias("ell"))
    return counted.where("c >= ell").select("a", "b")


def _with_comp(entries: DataFrame, found: DataFrame | None) -> DataFrame:
    """entries with comp, the component of each node so far, and size, how many classes are in it."""
    if found is None:
        return entries.withColumn("comp", F.col("node")).withColumn("size", F.lit(1).cast("long"))
    sizes = found.groupBy("comp").agg(F.count(F.lit(1)).alias("_s")).withColumnRenamed("comp", "_k")
    known = found.join(sizes, F.col("comp") == F.col("_k")).select(F.col("node").alias("_n"), F.col("comp").alias("_c"), "_s")
    out = entries.join(known, F.col("node") == F.col("_n"), "left")
    return out.withColumn("comp", F.coalesce("_c", "node")).withColumn("size", F.coalesce("_s", F.lit(1).cast("long"))).drop("_n", "_c", "_s")


def _merged(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, comp after more links, which are first taken as links between the components so far."""
    if found is None:
        return components(links)
    a, b = (found.select(F.col("node").alias(f"_{s}n"), F.col("comp").alias(f"_{s}c")) for s in "ab")
    linked = links.join(a, F.col("a") == F.col("_an"), "left").join(b, F.col("b") == F.col("_bn"), "left")
    moved = components(linked.select(F.coalesce("_ac", "a").alias("a"), F.coalesce("_bc", "b").alias("b")))
    to = moved.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
    old = found.join(to, F.col("comp") == F.col("_n"), "left").select("node", F.coalesce("_c", "comp").alias("comp"))
    out = staged(old.unionByName(moved.join(found.select("node"), "node", "left_anti")), "components")
    discard(moved, found)
    return out


def _side(rows: DataFrame, name: str, columns) -> DataFrame:
    return rows.select("token", *[F.col(c).alias(f"{name}{c}") for c in columns])


def _round(state: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of a class and the leader of one of its tokens, from different components. The first leaders are the
    classes with the most common tokens on the whole, later ones are drawn alike for all tokens."""
    columns = ("node", "comp", "n", "pos", "ell", "k")
    weight = F.col("pop").cast("double") if turn == 0 else F.xxhash64(F.lit(turn), "node").cast("double")
    lead = F.max(F.struct(weight.alias("w"), *[F.col(c).alias(f"lead_{c}") for c in columns])).alias("x")
    leaders = state.groupBy("token").agg(lead, F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token", "x.*").drop("w")
    met = _side(state, "own_", columns).join(leaders, "token").where((F.col("own_comp") != F.col("lead_comp")) & _may_link("own_", "lead_", percent))
    return _pairs(met, "own_", "lead_")


def _rest(state: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """All pairs of classes of a token that lie in different components and whose parities are near enough. One of the
    two is outside the token's largest component, so classes inside it meet the others alone."""
    columns = ("node", "comp", "n", "pos", "ell", "k")
    main = F.max(F.struct("size", "comp")).alias("m")
    mixed = state.groupBy("token").agg(main, F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token", F.col("m.comp").alias("main"))
    here = state.join(mixed, "token").select("token", *columns, "main").join(classes.select("node", *PARITY), "node")
    here = staged(here, "open")
    x, y = _side(here.where("comp <> main"), "x", [*columns, *PARITY]), _side(here, "y", [*columns, *PARITY, "main"])
    once = (F.col("ycomp") == F.col("ymain")) | (F.col("xnode") < F.col("ynode"))
    apart = sum(F.bit_count(F.col(f"x{p}").bitwiseXOR(F.col(f"y{p}"))) for p in PARITY)
    sizes = F.col("xn").cast("long") + F.col("yn")
    near = apart <= sizes - 2 * F.ceil(sizes * percent / (100 + percent))
    met = x.join(y, "token").where((F.col("xcomp") != F.col("ycomp")) & once & near & _may_link("x", "y", percent))
    out = staged(_pairs(met, "x", "y"), "pairs")
    discard(here)
    return out


def _without(pairs: DataFrame, tried: list[DataFrame]) -> DataFrame:
    for t in tried:
        pairs = pairs.join(t, ["a", "b"], "left_anti")
    return pairs


def _linked(entries: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """node, comp of all classes that have a link."""
    found: DataFrame | None = None
    tried: list[DataFrame] = []
    for turn in range(ROUNDS):
        pairs = staged(_without(_round(_with_comp(entries, found), turn, percent), tried), "pairs")
        links = _verified(pairs, texts, percent)
        tried.append(pairs)
        n, new = pairs.count(), links.count()
        if new or found is None:
            found = _merged(found, links)
        discard(links)
        if new <= WORTH * n:
            break
    pairs = _rest(_with_comp(entries, found), classes, percent)
    links = _verified(_without(pairs, tried), texts, percent)
    found = _merged(found, links)
    discard(links, pairs, *tried)
    return found


def _prepared(docs: DataFrame, id_col: str, text_col: str, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, key, n, h1, h2), classes (h1, h2, n, low, node, PARITY), entries of the prefix tokens that are shared, texts by key."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))
    signed = staged(_signatures(docs), "signatures")
    table, base = _sketch(signed.where("n < 0").select(F.col("key").alias("task"), (-1 - F.col("n")).alias("segment"), "sketch"))
    sketch = spark.sparkContext.broadcast(table)
    del table
    rows = signed.where("n >= 0").select("doc_id", "key", "n", "h1", "h2")
    low = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key"))).alias("low")
    classes = signed.where("n > 0").groupBy("h1", "h2", "n").agg(low, *[F.max(p).alias(p) for p in PARITY])
    classes = staged(classes.select("h1", "h2", "n", F.col("low.doc_id").alias("low"), F.col("low.key").alias("node"), *PARITY), "classes")

    known = classes.where("node is not null").select("node")
    texts = docs.where("doc_id is not null").select("key", "text")
    first = maybe_in(texts, F.col("key"), known.select(F.col("node").alias("key")), known.count())
    shared = staged(_tokens(first, sketch, base, percent).groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token"), "shared_tokens")
    keys = spark.sparkContext.broadcast(key_filter(shared, "token", shared.count()))
    # Rows that repeat both id and text are one node, and the few that first lets through besides are left out, once tokens are merged.
    every = staged(_entries(first, sketch, base, percent, keys), "entries")
    entries = staged(_merged_tokens(every, percent).join(known, "node", "left_semi"), "merged_tokens")
    discard(shared, every)
    for b in (sketch, keys):  # nothing that reads them is run again
        b.destroy()
    give_back()
    return rows, classes, entries, texts


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """All links, as pairs (a, b) of class nodes, and the members of the classes: doc_id, row_key, node, n_shingles, n_links.

    n_links: to how many other classes the row's class is linked. Links within a component are not left out here, so
    a group of k texts that are all similar has k (k - 1) / 2 links. Null ids, empty texts and repeats as in
    similar_groups(); rows without a set have a null node and no link.
    """
    rows, classes, entries, texts = _prepared(docs, id_col, text_col, percent)
    pairs = _rest(_with_comp(entries, None), classes, percent)
    links = _verified(pairs, texts, percent)
    discard(entries, pairs)
    degree = links.select(F.explode(F.array("a", "b")).alias("_n")).groupBy("_n").agg(F.count(F.lit(1)).alias("_d"))
    named = classes.join(degree, F.col("node") == F.col("_n"), "left").select("h1", "h2", "n", "node", F.coalesce("_d", F.lit(0)).cast("long").alias("n_links"))
    members = rows.join(named, ["h1", "h2", "n"], "left").select("doc_id", F.col("key").alias("row_key"), "node", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return links, members


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (smallest id with the same set), component_id (smallest id reachable), row_key, kept.

    Null and empty texts, and texts without words, have an empty set and link with nothing. Rows that repeat an id
    with different texts are compared and judged each by itself. A null id never is the smallest of several; a class
    of null ids only keeps null and links with nothing. kept marks one text of each component, with the smallest id,
    and all that links with nothing; rows that repeat both id and text are marked alike. Other columns are ignored.
    """
    rows, classes, entries, texts = _prepared(docs, id_col, text_col, percent)
    found = _linked(entries, classes, texts, percent)
    discard(entries)

    labels = found.select(F.col("node").alias("_n"), "comp")
    known = classes.where("node is not null").select("node", "low")
    labels = staged(known.join(labels, F.col("node") == F.col("_n")).drop("_n"), "labels")
    firsts = staged(labels.groupBy("comp").agg(F.min(F.struct("low", "node")).alias("first")), "firsts")
    labels = labels.join(firsts, "comp").select(F.col("node").alias("_n"), F.col("first.low").alias("comp"), F.col("first.node").alias("first"))
    named = staged(classes.drop(*PARITY).join(labels, F.col("node") == F.col("_n"), "left").drop("_n"), "named")
    discard(found, firsts, classes)
    out = rows.join(named, ["h1", "h2", "n"], "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("low", "doc_id").alias("class_id"),
        F.coalesce("comp", "low", "doc_id").alias("component_id"),
        F.col("key").alias("row_key"),
        F.coalesce(F.col("key") == F.coalesce("first", "node"), F.lit(True)).alias("kept"),
    )
