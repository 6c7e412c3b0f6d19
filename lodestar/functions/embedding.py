"""Embedding of text by any function, in Arrow batches; a hashing embedder stands in where no model is at hand."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]
PREFIXES = {"document": "search_document: ", "query": "search_query: "}
BATCH = 32


def hashing(dimension: int = 64) -> Embedder:
    """Signed hashes of lower-case words, summed and scaled to length 1; the same everywhere."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dimension)
            for w in t.lower().split():
                h = hashlib.sha256(w.encode()).digest()
                v[int.from_bytes(h[:4], "little") % dimension] += 1 if h[4] & 1 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    return embed


def embed(text, embedder: Embedder, dimension: int, kind: str = "document", tries: int = 3, wait: float = 1.0) -> Column:
    """text as vectors, BATCH texts a call, with the prefix of their kind. A call that fails is tried again after 1, 2, 4 ... waits,
    and then its texts get null. Vectors longer than dimension are cut; shorter ones are an error. Null text gives null."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        out: list = [None] * len(texts)
        at = [i for i, t in enumerate(texts) if t is not None]
        for i in range(0, len(at), BATCH):
            part = at[i : i + BATCH]
            for n in range(tries):
                try:
                    got = embedder([PREFIXES[kind] + texts.iloc[j] for j in part])
                except Exception:  # whatever a provider raises
                    if n + 1 < tries:
                        time.sleep(wait * 2**n)
                    continue
                for j, v in zip(part, got, strict=True):
                    if len(v) < dimension:
                        raise ValueError(f"{len(v)} values, {dimension} wanted")
                    out[j] = [float(x) for x in v[:dimension]]
                break
        return pd.Series(out, dtype=object)

    return run(text)
