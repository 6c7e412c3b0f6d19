"""Functions of the engine for use in SQL."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

from . import chunking

_CHUNKS = StructType().add("chunk_index", IntegerType()).add("content", StringType())
_SYMBOLS = StructType().add("uid", StringType()).add("label", StringType()).add("name", StringType()).add("start_line", IntegerType()).add("end_line", IntegerType())


@F.pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """How alike two texts are, by matching blocks; null counts as empty."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a.fillna(""), b.fillna(""), strict=True)])


@F.udtf(returnType=_CHUNKS)
class ChunkText:
    """chunk_text(text, size): whole lines packed into chunks of at most size characters, a longer line alone."""

    def eval(self, text: str, size: int):
        for i, piece in enumerate(chunking.pack_lines(text, size) if text else []):
            yield i, piece


@F.udtf(returnType=_SYMBOLS)
class ParseSource:
    """parse_source(path, text): classes and functions of a Python file."""

    def eval(self, path: str, text: str):
        from lodestar.sources.code import _walk

        for _, uid, label, name, _, start, end, *_ in _walk(path, text or "")[0]:
            yield uid, label, name, start, end


def register(spark: SparkSession) -> None:
    """Makes seq_ratio, chunk_text and parse_source known to SQL in a session."""
    spark.udf.register("seq_ratio", seq_ratio)
    spark.udtf.register("chunk_text", ChunkText)
    spark.udtf.register("parse_source", ParseSource)
