"""Language of web pages by fusion of evidence.

For each page four things speak: its main text (character trigrams, one model a language), the language its markup
declares, the suffix of its address, and its host. The last two are priors computed by grouped aggregation of the
texts' own posteriors: a host's prior leans on its suffix's, and that on the corpus's, the more the fewer pages it
has. What a declaration is worth is counted as well, as a table of declared language against the texts' verdict.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_text import main_text
from .shared import map_arrow, prepare, staged
from .textcore import FOLD, U64, mix64, slices, utf8

BITS = 14
#: About how many documents of each language the text models are fitted on, and how many languages a model may have (128 KB
#: each); with more, training stops with an error. Every row takes part in finding the languages.
SAMPLE, LANGUAGES = 1500, 500
#: Trigrams neighbour each other, so a text weighs like this many independent ones at most.
EFFECTIVE = 60.0
#: Pages by which a host leans on its suffix, and a suffix on the whole corpus.
LEAN = 8.0

_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.IGNORECASE)
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.IGNORECASE)


@dataclass
class TextModel:
    languages: list[str]
    logs: np.ndarray

    def log_likelihoods(self, arr: pa.Array) -> np.ndarray:
        """For each text and language; the mean over trigrams times their number, or EFFECTIVE if that is less."""
        buf, off = utf8(arr)
        out = np.zeros((len(off) - 1, len(self.languages)))
        t, ok = trigrams(buf, off)
        doc = np.searchsorted(off, np.flatnonzero(ok), side="right") - 1
        n = np.bincount(doc, minlength=len(out))
        for j in range(len(self.languages)):
            out[:, j] = np.bincount(doc, self.logs[j][t[ok]], len(out))
        return out * (np.minimum(n, EFFECTIVE) / np.maximum(n, 1))[:, None]


def trigrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams, and which of them lie within one text."""
    if len(buf) < 3:
        return np.zeros(0, np.int64), np.zeros(0, dtype=bool)
    x = FOLD[buf].astype(U64)
    t = (mix64(x[:-2] << U64(16) | x[1:-1] << U64(8) | x[2:]) & U64((1 << BITS) - 1)).astype(np.int64)
    ok = np.ones(len(t), dtype=bool)
    for d in (1, 2):
        cut = off[1:-1] - d
        ok[cut[(cut >= 0) & (cut < len(t))]] = False
    return t, ok


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE, languages: int = LANGUAGES) -> TextModel:
    """Trigram models of the languages that the documents name.

    Of each language those documents count whose hash of their id is low enough that about `sample` of them are; of a
    language with fewer, all. Rows without id or language are left out, rows that repeat an id count alike, null texts
    are empty. Without rows the model knows no language. Other columns are ignored. No language is left out: where there are
    more than `languages`, what is broadcast would have no bound, and that is a ValueError.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("k"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and k is not null")
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(languages + 1).collect()
    if len(found) > languages:
        raise ValueError(f"the documents name more than {languages} languages")
    if not found:
        return TextModel([], np.zeros((0, 1 << BITS)))
    share = F.create_map(*[x for r in found for x in (F.lit(r["lang"]), F.lit(min(1.0, sample / r["n"])))])
    texts = rows.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))

    def count(batches):
        for batch in batches:
            for part in slices(batch):
                buf, off = utf8(part.column("text"))
                t, ok = trigrams(buf, off)
                doc = np.searchsorted(off, np.flatnonzero(ok), side="right") - 1
                names = np.array(part.column("lang").to_pylist(), dtype=object)
                for lang in sorted(set(names.tolist())):
                    n = np.bincount(t[ok][names[doc] == lang], minlength=1 << BITS)
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "t", "n"])

    def model(table: pa.Table) -> pa.Table:
        counts = np.full(1 << BITS, 0.5)
        counts[table.column("t").to_numpy()] += table.column("n").to_numpy()
        return pa.table({"lang": table.column("lang").slice(0, 1), "logs": pa.array([np.log(counts / counts.sum()).tobytes()], pa.binary())})

    sums = map_arrow(texts, count, "lang string, t long, n long").groupBy("lang", "t").agg(F.sum("n").alias("n"))
    got = sorted((r["lang"], bytes(r["logs"])) for r in sums.groupBy("lang").applyInArrow(lambda t: model(t), "lang string, logs binary").toLocalIterator())
    logs = np.array([np.frombuffer(x) for _, x in got]).reshape(-1, 1 << BITS)
    return TextModel([lang for lang, _ in got], logs)


def _evidence(pages: DataFrame, model, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, host, suffix, declared, n_chars, ll): declared is an index of a language, -1 for another, -2 for none."""

    def run(batches):
        languages = model.value.languages
        for batch in batches:
            for part in slices(batch, html_col):
                texts = pa.array([main_text(x) for x in part.column(html_col).to_pylist()], pa.string())
                ll = model.value.log_likelihoods(texts)
                hosts = [m[1].lower().strip(".") if (m := _HOST.match(u or "")) else "" for u in part.column(url_col).to_pylist()]
                said = [m[1].lower() if (m := _LANG.search(x or "")) else None for x in part.column(html_col).to_pylist()]
                declared = [-2 if s is None else languages.index(s) if s in languages else -1 for s in said]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column(url_col), pa.array(hosts, pa.string()), pa.array([h.rpartition(".")[2] for h in hosts], pa.string()), pa.array(declared, pa.int32()),
                     pa.array([len(x.as_py()) for x in texts], pa.int64()), pa.array(list(ll), pa.list_(pa.float64()))],
                    names=["page_id", "url", "host", "suffix", "declared", "n_chars", "ll"],
                )

    return map_arrow(pages, run, "page_id long, url string, host string, suffix string, declared int, n_chars long, ll array<double>")


def _normalised(logs, n: int):
    """Probabilities of an array of n logs."""
    top = F.array_max(logs)
    return F.transform(logs, lambda x: F.exp(x - top) / F.aggregate(logs, F.lit(0.0), lambda a, y: a + F.exp(y - top)))


def _sums(p: str, n: int) -> list:
    return [F.sum(F.get(p, F.lit(i))).alias(f"s{i}") for i in range(n)]


def identify(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, lang, probability, text_lang, declared_lang, n_chars.

    Null or empty html leaves the declaration out and the text mute, so the priors of host and suffix decide; a null
    or odd url counts as the host ''. lang is null only if the model knows no language. Of languages that are equally
    likely the first by name is taken. Rows that repeat an id, or have none, are judged one by one; an empty table gives
    an empty result. Other columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    prepare(spark)
    n = len(model.languages)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    if not n:
        none = F.lit(None).cast("string")
        return rows.select("page_id", "url", none.alias("lang"), F.lit(0.0).alias("probability"), none.alias("text_lang"), none.alias("declared_lang"), F.lit(0).cast("long").alias("n_chars"))
    seen = staged(_evidence(rows, spark.sparkContext.broadcast(model), "url", "html"), "evidence").withColumn("p", _normalised(F.col("ll"), n))

    by_host = staged(seen.groupBy("host", "suffix").agg(F.count(F.lit(1)).alias("c"), *_sums("p", n)), "hosts")
    all_ = by_host.agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(n)], F.sum("c").alias("c")).first()
    whole = [((all_[f"s{i}"] or 0.0) + 1.0) / ((all_["c"] or 0) + n) for i in range(n)]
    by_suffix = by_host.groupBy("suffix").agg(F.sum("c").alias("cs"), *[F.sum(f"s{i}").alias(f"t{i}") for i in range(n)])
    host = by_host.join(by_suffix, "suffix")
    suffix_prior = [(F.col(f"t{i}") + LEAN * whole[i]) / (F.col("cs") + LEAN) for i in range(n)]
    host = staged(host.select("host", "suffix", "c", F.array(*[F.col(f"s{i}") for i in range(n)]).alias("s"), F.array(*suffix_prior).alias("lean")), "host_priors")

    table = {r["declared"]: [r[f"s{i}"] for i in range(n)] for r in seen.groupBy("declared").agg(*_sums("p", n)).collect()}
    kinds = range(-2, n)
    weights = [F.array(*[F.lit(float(np.log((table.get(k, [0.0] * n)[i] + 1.0) / (sum(table.get(j, [0.0] * n)[i] for j in kinds) + len(kinds))))) for i in range(n)]) for k in kinds]

    out = seen.join(host, ["host", "suffix"])
    declared = F.get(F.array(*weights), F.col("declared") + 2)
    # A page's own share is taken out of its host's counts.
    prior = F.zip_with(F.zip_with("s", "p", lambda s, p: F.greatest(s - p, F.lit(0.0))), "lean", lambda s, q: (s + LEAN * q) / (F.col("c") - 1 + LEAN))
    logs = F.zip_with(F.zip_with("ll", declared, lambda a, b: a + b), F.transform(prior, lambda x: F.log(x)), lambda a, b: a + b)
    names = F.array(*[F.lit(x) for x in model.languages])
    out = out.withColumn("q", _normalised(logs, n))
    best = lambda c: F.get(names, F.array_position(F.col(c), F.array_max(F.col(c))).cast("int") - 1)
    return out.select(
        "page_id",
        "url",
        best("q").alias("lang"),
        F.array_max("q").alias("probability"),
        F.when(F.col("n_chars") > 0, best("p")).alias("text_lang"),
        F.when(F.col("declared") >= 0, F.get(names, F.col("declared"))).alias("declared_lang"),
        "n_chars",
    )
