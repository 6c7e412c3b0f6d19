"""Quality classifier: naive Bayes features in a linear support vector machine.

Features are indicators of n-grams: of single words and pairs, and of runs of one to three word shapes (case,
length, digits, signs at the end, whether the word repeats the one before it, whether it begins a line). An indicator is
scaled by the log of the ratio of its class frequencies; a hinge-loss model is fitted to the scaled vectors by
dual coordinate descent, and its margins are turned into probabilities by a logistic curve fitted on rows that the
model has not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, map_arrow, prepare
from .textcore import FOLD, SPACE_SEP, U64, mix64, ngrams, scan, slices

BITS = 18
#: Most labelled documents that the model is fitted on, and most bytes of their texts: what the driver gets and fits
#: has these bounds.
SAMPLE, SAMPLE_BYTES = 8000, 48 << 20

_CLASS = np.zeros((4, 256), dtype=np.int64)  # upper, lower or other letters, digits, signs
_CLASS[0, 65:91] = 1
_CLASS[1, 97:123] = 1
_CLASS[1, 0xC0:] = 1
_CLASS[2, 48:58] = 1
_CLASS[3, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1


def _shapes(w) -> np.ndarray:
    """A code for the shape of each word."""
    counts = []
    latin_upper = np.zeros(len(w.buf), dtype=bool)
    if len(w.buf) > 1:
        latin_upper[:-1] = (w.buf[:-1] == 0xC3) & (w.buf[1:] >= 0x80) & (w.buf[1:] <= 0x9E)
    for c in range(4):
        flag = _CLASS[c][w.buf]
        if c == 0:
            flag = flag + latin_upper
        if c == 1:
            flag = flag - latin_upper
        total = np.concatenate([[0], np.cumsum(flag)])
        counts.append(total[w.ends] - total[w.starts])
    upper, lower, digit, sign = counts
    first = w.buf[w.starts] if len(w.starts) else np.zeros(0, np.uint8)
    first_upper = (_CLASS[0][first] > 0) | (latin_upper[w.starts] if len(w.starts) else False)
    case = np.where(upper == 0, 0, np.where((lower == 0) & (upper > 1), 2, np.where((upper == 1) & first_upper, 1, 3)))
    size = np.searchsorted([2, 3, 6, 10, 15, 30], w.ends - w.starts, side="right")
    last = w.buf[w.ends - 1] if len(w.ends) else np.zeros(0, np.uint8)
    tail = np.where(_CLASS[3][last] > 0, last, 0).astype(np.int64)
    run = np.minimum(sign, 3)
    digits = np.where(digit == 0, 0, np.where(upper + lower == 0, 2, 1))
    letters = upper + lower > 0
    same = np.zeros(len(w.hashes), dtype=np.int64)
    same[1:] = w.hashes[1:] == w.hashes[:-1]
    same[w.first[:-1][np.diff(w.first) > 0]] = 0
    before = w.buf[np.maximum(w.starts - 1, 0)] if len(w.starts) else np.zeros(0, np.uint8)
    line = (before == 0x0A).astype(np.int64)
    code = ((((((case * 8 + size) * 256 + tail) * 4 + run) * 4 + digits) * 2 + letters) * 2 + same) * 2 + line
    return mix64(code.astype(U64) + U64(0x51ED270B))


def features(arr: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) of a column of texts, by document."""
    w = scan(arr, SPACE_SEP, FOLD)
    doc, room = w.doc_of().astype(np.int64), w.room()
    keys = []
    for base, values in ((1, w.hashes), (2, _shapes(w))):
        for k in (1, 2, 3)[: 2 if base == 1 else 3]:
            g = ngrams(values, k)
            ok = room[: len(g)] >= k
            f = (mix64(g[ok] + U64(base * 8 + k)) & U64((1 << bits) - 1)).astype(np.int64)
            keys.append(doc[: len(g)][ok] << bits | f)
    keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return keys >> bits, keys & ((1 << bits) - 1)


@dataclass
class Model:
    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    slope: float
    shift: float
    bits: int = BITS

    def margins(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        scaled = self.ratios[feature]
        norm = np.sqrt(np.bincount(doc, scaled * scaled, n))
        total = np.bincount(doc, scaled * self.weights[feature], n)
        return np.divide(total, norm, out=np.zeros(n), where=norm > 0) + self.bias

    def scores(self, arr: pa.Array) -> np.ndarray:
        z = self.slope * self.margins(*features(arr, self.bits), len(arr)) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, size: int, smoothing: float = 1.0) -> np.ndarray:
    """log of p/|p| over q/|q|, with p and q the smoothed document counts of each feature in either class."""
    p, q = np.full(size, smoothing), np.full(size, smoothing)
    for r, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[r] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Hinge loss with L2 penalty, one dual variable at a time; the last weight is the bias (a constant feature)."""
    w, bias, alpha = np.zeros(len(ratios)), 0.0, np.zeros(len(rows))
    scale = [1 / max(1e-12, float(np.sqrt(ratios[r] @ ratios[r]))) for r in rows]
    share = {s: len(y) / (2 * max(1, int((y == s).sum()))) for s in (-1, 1)}
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(rows)):
            r, cap = rows[i], c * share[int(y[i])]
            x = ratios[r] * scale[i]
            gradient = y[i] * (w[r] @ x + bias) - 1
            step = min(max(alpha[i] - gradient / (float(x @ x) + 1), 0.0), cap) - alpha[i]
            if step:
                alpha[i] += step
                w[r] += step * y[i] * x
                bias += step * y[i]
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return w, bias


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability of label 1, with smoothed targets (Platt)."""
    n1, n0 = max(1, int((y > 0).sum())), max(1, int((y < 0).sum()))
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -60, 60)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margin * margin).sum() + 1e-6, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS) -> Model:
    """A model of feature rows and 0/1 labels. Without rows of both classes it gives the share of label 1."""
    y = np.where(labels > 0, 1, -1)
    size = 1 << bits
    if len(set(y.tolist())) < 2:
        share = (float((y > 0).sum()) + 1) / (len(y) + 2)
        return Model(np.zeros(size), np.zeros(size), 0.0, 0.0, float(np.log(share / (1 - share))), bits)
    fold = np.arange(len(rows)) % 4 == 3
    if len(set(y[fold].tolist())) < 2 or len(set(y[~fold].tolist())) < 2:
        fold[:] = False
    inner, inner_y = [r for r, f in zip(rows, fold, strict=True) if not f], y[~fold]
    held, held_y = ([r for r, f in zip(rows, fold, strict=True) if f], y[fold]) if fold.any() else (rows, y)
    ratios = log_count_ratios(inner, inner_y, size)
    w, bias = dual_coordinate_descent(inner, inner_y, ratios)
    model = Model(w, ratios, bias, 1.0, 0.0, bits)
    doc = np.repeat(np.arange(len(held)), [len(r) for r in held])
    margin = model.margins(doc, np.concatenate(held) if held else np.zeros(0, np.int64), len(held))
    model.slope, model.shift = _logistic(margin, held_y)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, bits: int = BITS) -> Model:
    """Fits on labelled rows whose crc32(id as text) mod 4 is not 2: on all, or, beyond `sample` rows or `sample_bytes`
    of text, on those with the smallest hashes of their ids.

    Rows without id or label are left out, also those with a label other than 0 and 1; of rows with one id, texts or
    labels, each counts. Null and empty texts are rows without features. The bytes are a bound on whole texts: the one
    that passes it still counts, if it is the first. Other columns of either table are ignored.
    """
    prepare(docs.sparkSession)
    own = F.crc32(F.col("k").cast("string")) % 4 != 2
    chosen = labels.select(F.col(id_col).cast("long").alias("k"), F.col(label_col).cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isNotNull() & own)
    chosen = chosen.where("y in (0, 1)").withColumn("h", F.xxhash64("k")).orderBy("h", "k", "y").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("text"))
    sizes = texts.join(F.broadcast(chosen), "k").groupBy("h", "k").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b"))
    total, last = 0, None
    for r in sizes.orderBy("h", "k").collect():  # `sample` rows at most
        total += r["b"]
        if last is not None and total > sample_bytes:
            break
        last = (r["h"], r["k"])
    if last is not None:
        chosen = chosen.where((F.col("h") < last[0]) | ((F.col("h") == last[0]) & (F.col("k") <= last[1])))
    texts = texts.join(F.broadcast(chosen.drop("h")), "k")

    def rows(batches):
        for batch in batches:
            for part in slices(batch):
                doc, feature = features(part.column("text"), bits)
                cut = np.searchsorted(doc, np.arange(len(part) + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(feature, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("y"), lists], names=["k", "y", "f"])

    got = map_arrow(texts.select("k", "y", "text"), rows, "k long, y int, f array<int>").toArrow()
    order = sorted(range(len(got)), key=lambda i: (got["k"][i].as_py() * 2654435761 % (1 << 32), got["k"][i].as_py(), got["y"][i].as_py()))
    model = fit([got["f"][i].values.to_numpy() for i in order], np.array([got["y"][i].as_py() for i in order]), bits)
    del got
    give_back()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", column: str = "score", carry: list[str] | None = None) -> DataFrame:
    """docs, or the columns in carry, with the probability of label 1; an input column of that name is replaced.

    Null and empty texts have no feature and get the score of the bias alone.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in (carry if carry is not None else docs.columns) if c != column]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), f"`{column}` double"])

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(shared.value.scores(part.column(text_col)))], names=[*kept, column])

    return map_arrow(docs.select(*dict.fromkeys([*kept, text_col])), run, schema)
