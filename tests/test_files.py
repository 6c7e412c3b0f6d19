"""A small tree of files, written out and found again."""

from __future__ import annotations

import hashlib

from lodestar.plans.sources import FILES, _written
from lodestar.sources import files

TREE = [*FILES, (".gitignore", "# local\n\nscratch/\n*.tmp\n"), (".git/config", "x"), ("build/out.log", "y"), ("data/blob.dat", "a\x00b"), ("scratch/try.py", "x = 1\n"), ("notes.tmp", "z"), ("docs/ARCH.md", "# Parts\n"), ("docs/guide.md", "# Use\n\nstart\n")]


_SEEN = {p: t for p, t in TREE if p not in (".gitignore", ".git/config", "build/out.log", "scratch/try.py", "notes.tmp")}
_KINDS = {".py": ("Code", "text/x-python"), ".ts": ("Code", "application/octet-stream"), ".go": ("Code", "application/octet-stream"), ".proto": ("Text", "application/octet-stream"), ".json": ("Config", "application/json"), ".yaml": ("Config", "application/octet-stream"), ".md": ("Documentation", "text/markdown")}


def _found(path: str, text: str) -> tuple:
    """What discovery must say of a file, worked out from its name and text."""
    ext = "." + path.rsplit(".", 1)[1]
    category, mime = _KINDS.get(ext, ("Unknown", "application/octet-stream"))
    if path == "data/blob.dat":
        category = "Binary"
    if ext == ".proto":
        category = "Unknown"
    return path, category, len(text.encode()), hashlib.sha1(text.encode()).hexdigest(), None if category == "Binary" else text.count("\n") + 1, mime


def test_tree_of_files(spark):
    got = files.metadata(files.in_project(spark, _written(spark, TREE))).select("path", "category", "size", "sha1", "lines", "mime").collect()
    assert sorted(map(tuple, got)) == sorted(_found(p, t) for p, t in _SEEN.items())
