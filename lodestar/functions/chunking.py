"""Overlapping chunks of text with stable ids."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import chunk_id


@dataclass(frozen=True)
class Sizes:
    """chunk and overlap in characters; shorter pieces than least are left out unless last, none exceeds most."""

    chunk: int = 1200
    overlap: int = 200
    least: int = 100
    most: int = 2000
    by: str = "paragraph"

    def check(self) -> Sizes:
        if self.chunk <= 0 or self.overlap < 0 or self.overlap >= self.chunk or self.least < 0 or self.most < self.chunk:
            raise ValueError("sizes don't fit together")
        return self


#: Sizes by extension.
CODE, PROSE, CONFIG = Sizes(1000, 150, by="line"), Sizes(1500, 200), Sizes(800, 100, by="line")
BY_EXTENSION = {
    **dict.fromkeys((".py", ".js", ".ts", ".go", ".java", ".rs"), CODE),
    **dict.fromkeys((".md", ".txt", ".rst"), PROSE),
    **dict.fromkeys((".json", ".yaml", ".yml", ".toml"), CONFIG),
}
_ENDS = {"paragraph": re.compile(r"\n+"), "line": re.compile(r"\n"), "sentence": re.compile(r"[.!?]\s+")}
TOLERANCE = 100
#: Characters of chunks that a task gathers before it hands them on.
HELD = 1 << 20


def sizes_for(extension: str) -> Sizes:
    return BY_EXTENSION.get(extension.lower(), Sizes())


def _ends(text: str, by: str) -> list[int]:
    if by == "paragraph":  # every line end is a place to cut, a run of them its last as well
        return sorted({m.end() for m in re.finditer(r"\n\n+", text)} | {m.end() for m in re.finditer(r"\n", text)})
    return [m.end() for m in _ENDS[by].finditer(text)] if by in _ENDS else []


def spans(text: str, s: Sizes) -> list[tuple[int, int]]:
    """(start, end) of the chunks: each ends at the natural place nearest to its size, within TOLERANCE, or at its size."""
    n = len(text)
    if n <= s.chunk:
        return [(0, n)] if n else []
    ends, out, at = _ends(text, s.by), [], 0
    while True:
        goal = at + s.chunk
        if goal >= n:
            out.append((at, n))
            return out
        i = bisect_left(ends, goal)
        near = [e for e in ends[max(0, i - 1) : i + 1] if abs(e - goal) <= TOLERANCE]
        end = min(near, key=lambda e: (abs(e - goal), e)) if near else goal
        end = min(end, at + s.most)
        if end <= at:
            end = min(goal, n)
        if end - at >= s.least or end >= n:
            out.append((at, end))
        if end >= n:
            return out
        at = end - s.overlap if end - s.overlap > at else end


def chunk(docs: DataFrame, sizes: Sizes | None = None, path: str = "path", text: str = "text") -> DataFrame:
    """path, chunk_index, start, end, content, content_hash, chunk_id, lines; sizes by the path's extension unless given."""

    names = ["path", "chunk_index", "start", "end", "content", "content_hash", "chunk_id", "lines"]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, held = [], 0
            for p, t in zip(frame["path"], frame["text"], strict=True):
                ext = re.search(r"\.[^./]+$", p or "")
                for i, (a, b) in enumerate(spans(t or "", (sizes or sizes_for(ext[0] if ext else "")).check())):
                    piece = t[a:b]
                    digest = hashlib.sha256(piece.encode()).hexdigest()
                    rows.append((p, i, a, b, piece, digest, hashlib.sha256(f"{p}:{i}:{digest}".encode()).hexdigest()[:16], piece.count("\n") + 1))
                    held += b - a
                    if held > HELD:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    return docs.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInPandas(cut, "path string, chunk_index int, start long, end long, content string, content_hash string, chunk_id string, lines int")


def fixed(docs: DataFrame, size: int, overlap: int, path: str = "path", text: str = "text") -> DataFrame:
    """Chunks of a fixed size, by built-in functions alone."""
    step, n = size - overlap, F.length(text)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.ceil((n - size) / step).cast("int") * step, F.lit(step)))
    cut = docs.where(n > 0).select(F.col(path).alias("path"), F.col(text).alias("_t"), F.posexplode(starts).alias("chunk_index", "start"))
    content = F.substring("_t", F.col("start") + 1, F.lit(size))
    out = cut.withColumn("content", content)
    return out.select("path", "chunk_index", "start", (F.col("start") + F.length("content")).alias("end"), chunk_id(F.col("path"), F.col("chunk_index"), F.col("content")).alias("chunk_id"), F.length("content").alias("chars"))


def pack_lines(text: str, most: int = 4000) -> list[str]:
    """Whole lines packed into pieces of `most` characters, trimmed."""
    if len(text) <= most:
        return [text]
    out, held = [], ""
    for line in text.split("\n"):
        if held and len(held) + len(line) + 1 > most:
            out.append(held.strip())
            held = ""
        held += line + "\n"
    return [*out, held.strip()] if held.strip() else out
