"""File discovery, classification and metadata over Spark's binaryFile source."""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import doc_type, extension, file_category

MAX_BYTES = 10 << 20
#: What is never read. Other tools that fill the same store skip the same files.
EXCLUDED = (
    ".git", ".git/*", ".git/**", "*.pyc", "__pycache__", "__pycache__/*", "*.pyo", ".env", ".env.*", ".env.local", ".env.*.local", "*.pem", "*.key", "*.p12", "*.keystore",
    "id_rsa", "id_rsa.*", "id_ed25519", "id_ed25519.*", ".graph_hashes_*.json", "node_modules", "node_modules/*", "node_modules/**", "venv", "venv/*", ".venv", ".venv/*",
    "*.egg-info", "*.egg-info/*", "dist", "dist/*", "build", "build/*", ".pytest_cache", ".pytest_cache/*", ".mypy_cache", ".mypy_cache/*", ".tox", ".tox/*", "*.log",
    ".DS_Store", "Thumbs.db",
)
MIME = {".py": "text/x-python", ".md": "text/markdown", ".json": "application/json", ".html": "text/html", ".txt": "text/plain", ".css": "text/css", ".js": "text/javascript", ".csv": "text/csv", ".xml": "text/xml", ".png": "image/png"}
MARKER = "\n... [truncated]"


def ignore_patterns(text: str) -> list[str]:
    """The patterns of an ignore file: trimmed lines without blanks and comments, folders without their slash."""
    each = (line.strip() for line in text.splitlines())
    return [x.rstrip("/") for x in each if x and not x.startswith("#")]


def _regex(pattern: str) -> str:
    return "(?s)^" + fnmatch.translate(pattern).replace("(?s:", "(?:").removesuffix(r"\Z").removesuffix(r"\z") + "$"


def _like(regex: str):
    return lambda x: x.rlike(regex)


def excluded(path: Column, name: Column, patterns: Iterable[str]) -> Column:
    """Whether a glob matches the name, a directory of the path, or the path; ** stands for any depth."""
    out = F.lit(False)
    parts = F.split(path, "/")
    for p in patterns:
        r = _regex(p)
        out = out | name.rlike(r) | path.rlike(r) | F.exists(parts, _like(r))
        if "**" in p:
            out = out | name.rlike(_regex(p.replace("**/", "").replace("/**", "")))
    return out


def discover(spark: SparkSession, root: str, ignore: Iterable[str] = (), largest: int = MAX_BYTES, content: bool = True) -> DataFrame:
    """path (relative), name, extension, modified, size, content of all files under root that are not excluded.

    Spark's file sources pass over empty files, and over names that begin with a dot or an underscore.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    relative = F.regexp_replace(F.col("path"), r"^[a-z]+:/*" + base.lstrip("/").replace(".", r"\.") + "/", "")
    out = raw.where(F.col("length") <= largest).withColumn("path", relative).withColumn("name", F.element_at(F.split("path", "/"), -1))
    out = out.where(~excluded(F.col("path"), F.col("name"), [*EXCLUDED, *ignore]))
    columns = ["path", "name", extension(F.col("name")).alias("extension"), F.unix_timestamp("modificationTime").cast("double").alias("modified"), F.col("length").alias("size")]
    return out.select(*columns, *(["content"] if content else [])).orderBy("path")


def is_binary(content: Column, sample: int = 8192) -> Column:
    """A NUL byte, or no valid UTF-8, among the first bytes (a character cut at their end doesn't count)."""
    head = F.substring(content, 1, sample)
    valid = F.is_valid_utf8(head)
    for cut in (1, 2, 3):
        valid = valid | ((F.octet_length(content) > sample) & F.is_valid_utf8(F.substring(content, 1, sample - cut)))
    pairs = F.regexp_replace(F.hex(head), "(..)", "$1 ")
    return pairs.contains("00 ") | ~valid


def cut_short(text: Column, most: int) -> Column:
    """Text of `most` characters at most, a longer one with a marker at its end."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(MARKER))).otherwise(text)


def metadata(files: DataFrame, truncate: int = 1 << 20) -> DataFrame:
    """files with category, binary, mime, sha1, text (LF not changed, long ones cut with a marker) and lines."""
    binary = F.when(file_category(F.col("name")) == "Unknown", is_binary(F.col("content"))).otherwise(file_category(F.col("name")) == "Binary")
    mime = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), F.col("extension")), F.lit("application/octet-stream"))
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    out = files.withColumn("binary", binary).withColumn("category", F.when(F.col("binary"), "Binary").otherwise(file_category(F.col("name"))))
    out = out.withColumn("mime", mime).withColumn("sha1", F.sha1("content")).withColumn("encoding", F.when(F.is_valid_utf8("content"), "utf-8").otherwise("latin-1"))
    out = out.withColumn("text", F.when(~F.col("binary"), cut_short(text, truncate)))
    return out.withColumn("lines", F.size(F.split("text", "\n"))).drop("content")


def hierarchy(paths: DataFrame, project: str) -> DataFrame:
    """Capabilities, features and components: the first three levels of directories, each with its parent."""
    parts = F.split("path", "/")
    kinds = (("Capability", "cap", 1), ("Feature", "feat", 2), ("Component", "comp", 3))
    out = None
    for label, short, n in kinds:
        here = F.array_join(F.slice(parts, 1, n), "/")
        parent = F.lit(None).cast("string") if n == 1 else F.concat(F.lit(f"{project}:{kinds[n - 2][1]}:"), F.array_join(F.slice(parts, 1, n - 1), "/"))
        level = paths.where(F.size(parts) > n).select(F.concat(F.lit(f"{project}:{short}:"), here).alias("uid"), F.lit(label).alias("label"), here.alias("path"), parent.alias("parent")).distinct()
        out = level if out is None else out.unionByName(level)
    return out


#: Extensions of code that is indexed, and folders whose insides are never looked at.
CODE = (".py", ".js", ".jsx", ".ts", ".tsx", ".go", ".rs", ".java")
PRUNED = ("node_modules", ".git", "__pycache__", "venv", ".venv", "dist", "build")


def in_project(spark: SparkSession, root: str, **options) -> DataFrame:
    """discover(), leaving out what the ignore file at the root, if there is one, names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/.gitignore")
    fs, text = path.getFileSystem(spark._jsc.hadoopConfiguration()), ""
    if fs.exists(path):  # read by hand, as Spark's sources pass over names that begin with a dot
        stream = fs.open(path)
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
    return discover(spark, root, ignore_patterns(text), **options)


def code_files(paths: DataFrame) -> DataFrame:
    """Paths of code that lie in no pruned folder."""
    own = paths.where(extension(F.element_at(F.split("path", "/"), -1)).isin(*CODE))
    return own.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in PRUNED])))


def documents(paths: DataFrame) -> DataFrame:
    """Markdown files with the kind of document that their name tells."""
    name = F.element_at(F.split("path", "/"), -1)
    return paths.where(F.lower(name).endswith(".md")).select("path", doc_type(name).alias("doc_type"))


def contained(root: str, path: str) -> bool:
    """Whether a path, relative to root or absolute, stays inside root once its dots are resolved."""
    base = posixpath.normpath(root)
    return (posixpath.normpath(posixpath.join(base, path)) + "/").startswith(base.rstrip("/") + "/")
