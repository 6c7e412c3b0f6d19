"""Text rules as column expressions: ids, hashes, classification, commit messages, citations, display."""

from __future__ import annotations

import hashlib
import hmac
import json
import uuid
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def lf(text) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def text_hash(text) -> Column:
    """SHA-256 of the text with LF line ends."""
    return F.sha2(lf(text), 256)


def short_id(size: int, *parts) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, size)


def chunk_id(path, index, content) -> Column:
    return short_id(16, path, index.cast("string"), F.sha2(content, 256))


def node_uid(kind: str, *key) -> Column:
    return F.concat(F.lit(f"{kind}::"), F.substring(F.sha2(F.concat_ws("::", *key), 256), 1, 12))


def work_item_uid(project, title, description) -> Column:
    return F.concat(project, F.lit("::workitem::"), F.substring(F.sha2(F.concat(title, F.lit("::"), description), 256), 1, 16))


#: Fixed value: the second part of a change's uid is spelled like this.
CHANGE_KIND = "codechanqge"


def change_uid(project, commit, path) -> Column:
    return F.concat(project, F.lit(f"::{CHANGE_KIND}::"), commit, F.lit("-"), F.substring(F.sha2(path, 256), 1, 8))


def valid_uid(uid, kinds=("workitem", CHANGE_KIND)) -> Column:
    parts = F.split(uid, "::")
    return (F.size(parts) == 3) & F.get(parts, F.lit(1)).isin(*kinds) & (F.length(F.get(parts, F.lit(2))) >= 8)


def query_hash(text) -> Column:
    """The 32-bit hash h = 31 h + code unit, absolute, in hex (for text of the basic plane)."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    wrap = lambda x: F.pmod(x + F.lit(2147483648), F.lit(4294967296)) - F.lit(2147483648)
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: wrap(a * 31 + c.cast("long")))
    return F.lower(F.hex(F.abs(h)))


#: Words that make a question unclear.
PRONOUNS = ("it", "they", "that", "this thing", "these", "those")
VAGUE = ("something", "anything", "stuff", "whatever", "things", "thing")
BROAD = ("all", "everything", "the whole", "each", "any")
CLEAR_STARTS = ("show me", "what is", "how does", "explain", "where is", "find", "locate")
#: Intents in the order in which they are looked for.
INTENTS = (
    ("relationship", r"\b(depend on|depends on|calls|imports|used by|connected to?)\b"),
    ("code", r"\b(show me|code|implement|function|class|source)\b"),
    ("explanation", r"\b(explain|how does|why|what is|describe|overview|documentation)\b"),
    ("location", r"\b(where|find|locate|which file)\b"),
)


def intent(query) -> Column:
    q = F.lower(F.trim(query))
    out = F.when(F.length(q) == 0, "unknown")
    for name, pattern in INTENTS:
        out = out.when(q.rlike(pattern), name)
    return out.otherwise("both")


def ambiguity(query) -> Column:
    """The unclear words of a question, in the order of the lists."""
    q = F.lower(F.trim(query))
    return F.array_compact(F.array(*[F.when(q.rlike(rf"\b{w}\b"), w) for w in (*PRONOUNS, *VAGUE, *BROAD)]))


def clarity(query) -> Column:
    """struct(clarity, confidence, mode)."""
    q = F.lower(F.trim(query))
    n = F.size(ambiguity(query))
    clear = F.lit(False)
    for s in CLEAR_STARTS:
        clear = clear | q.startswith(s)
    level = F.when(F.length(q) == 0, "requires_context").when(n == 0, "clear").when(n <= 2, "ambiguous").otherwise("requires_context")
    sure = F.when(F.length(q) == 0, 0.1).when(n == 0, F.when(clear, 0.9).otherwise(0.8)).when(n <= 2, F.when(clear, 0.7).otherwise(0.6)).otherwise(0.3)
    mode = F.when((n == 0) & (F.length(q) > 0), "one-shot").otherwise("conversational")
    return F.struct(level.alias("clarity"), sure.alias("confidence"), mode.alias("mode"))


#: Clarifying questions by what is missing.
QUESTIONS = (("pronoun", PRONOUNS, "Which item do you mean?"), ("vague", VAGUE, "What exactly are you looking for?"), ("broad", BROAD, "Which part should the answer cover?"))


def clarifications(query, round_, most: int = 3) -> Column:
    q = F.lower(query)
    padded = F.concat(F.lit(" "), q, F.lit(" "))

    def has(words):
        out = F.lit(False)
        for w in words:
            out = out | padded.contains(f" {w} ")
        return out

    asks = F.array_compact(F.array(*[F.when(has(words), text) for _, words, text in QUESTIONS]))
    return F.when(round_ >= most, F.array().cast("array<string>")).otherwise(asks)


#: Commit types and the kinds of work they stand for.
COMMIT_TYPES = {
    "feat": "feature", "fix": "bug", "docs": "docs", "style": "chore", "refactor": "refactor", "perf": "enhancement", "test": "chore", "build": "chore", "ci": "chore", "chore": "chore", "revert": "bug",
}


def commit(message) -> Column:
    """struct(type, scope, breaking, description, body, footer, work_type, refs) of a conventional commit message.

    What stands before the first colon of the header is a type, perhaps a scope in parentheses and perhaps a "!".
    A header that is not built like that, or whose type is unknown, is a description as a whole.
    """
    parts = F.split(F.trim(message), "\n\n", 3)
    header = F.trim(F.get(parts, F.lit(0)))
    head, rest = F.substring_index(header, ":", 1), F.btrim(F.substring(header, F.instr(header, ":") + 1, F.length(header)))
    breaking = F.endswith(head, F.lit("!"))
    name = F.when(breaking, F.substring(head, F.lit(1), F.length(head) - 1)).otherwise(head)
    scoped = F.endswith(name, F.lit(")")) & (F.instr(name, "(") > 0)
    scope = F.when(scoped, F.substring(name, F.instr(name, "(") + 1, F.length(name) - F.instr(name, "(") - 1))
    kind = F.lower(F.when(scoped, F.substring_index(name, "(", 1)).otherwise(name))
    built = (F.instr(header, ":") > 0) & (rest != "") & ~F.contains(rest, F.lit("\n")) & F.coalesce((scope != "") & ~F.contains(scope, F.lit(")")), F.lit(True))
    known = F.coalesce(built & kind.isin(*COMMIT_TYPES), F.lit(False))
    return F.struct(
        F.when(known, kind).alias("type"),
        F.when(known, scope).alias("scope"),
        (known & breaking).alias("breaking"),
        F.when(known, rest).otherwise(header).alias("description"),
        F.trim(F.get(parts, F.lit(1))).alias("body"),
        F.trim(F.get(parts, F.lit(2))).alias("footer"),
        F.when(known, F.element_at(_map(COMMIT_TYPES), kind)).otherwise("chore").alias("work_type"),
        F.array_sort(F.array_distinct(F.regexp_extract_all(message, F.lit(r"(#\d+)"), F.lit(1)))).alias("refs"),
    )


#: Words of a message that tell its priority, in the order in which they are looked for.
PRIORITY_WORDS = (
    ("critical", ("critical", "urgent", "hotfix", "emergency")),
    ("high", ("high", "important", "major", "bug", "fix", "error", "fail")),
    ("medium", ("medium", "feature", "enhancement", "improve")),
    ("low", ("low", "minor", "cleanup", "refactor", "style", "docs")),
)


def priority(message) -> Column:
    m = F.lower(message)
    out = F
    for name, words in PRIORITY_WORDS:
        out = out.when(m.rlike("|".join(words)), name)
    return out.otherwise("medium")


def from_labels(labels, table: dict[str, str], default: str) -> Column:
    """What the first known label stands for."""
    known = F.filter(F.transform(labels, lambda x: F.element_at(_map(table), F.lower(x))), lambda x: x.isNotNull())
    return F.coalesce(F.get(known, F.lit(0)), F.lit(default))


#: Words before a reference that close the issue.
CLOSING = ("fix", "fixes", "close", "closes", "closed", "resolve", "resolves", "resolved")


def closing_refs(text) -> Column:
    """Numbers of the issues that a text closes: a word that ends like a closing one, white space, # and the number."""
    words = F.split(F.lower(text), r"\s+")
    after = F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.struct(F.get(words, i).alias("word"), F.regexp_extract(F.coalesce(F.get(words, i + 1), F.lit("")), r"^#(\d+)", 1).alias("ref")))
    closes = lambda x: (x["ref"] != "") & F.exists(F.array(*[F.lit(w) for w in CLOSING]), lambda w: F.endswith(x["word"], w))
    return F.transform(F.filter(after, closes), lambda x: x["ref"].cast("int"))


def work_refs(text) -> Column:
    return F.regexp_extract_all(text, F.lit(r"((?:WORK-|#)\d+)"), F.lit(1))


STOP = ("with", "from", "that", "this", "will", "should")


def keyword_matches(message, title, description, most: int = 5) -> Column:
    """Words of an item, longer than three letters and not in STOP, that the message holds; sorted, the first `most`."""
    words = F.array_distinct(F.split(F.lower(F.concat_ws(" ", title, description)), r"\s+"))
    good = F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(*STOP) & F.contains(F.lower(message), w))
    return F.slice(F.array_sort(good), 1, most)


@F.pandas_udf(DoubleType())
def similarity(message: pd.Series, title: pd.Series, description: pd.Series) -> pd.Series:
    """0.4 title, 0.3 description, 0.3 both, each by matching blocks."""
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    out = []
    for m, t, d in zip(message.fillna("").str.lower(), title.fillna("").str.lower(), description.fillna("").str.lower(), strict=True):
        out.append(0.4 * ratio(m, t) + 0.3 * ratio(m, d) + 0.3 * ratio(m, f"{t} {d}"))
    return pd.Series(out)


def link_confidence(similar, same_type, n_keywords, same_priority) -> Column:
    raw = similar + F.when(same_type, 0.2).otherwise(0.0) + F.least(F.lit(0.3), n_keywords * 0.1) + F.when(same_priority, 0.1).otherwise(0.0)
    return F.round(F.least(raw, F.lit(1.0)), 3)


#: Categories of files by name and by extension. A file's category is stored with its node, so these are part of the data format.
FILE_NAMES = {
    "Infrastructure": ("Dockerfile", "docker-compose.yml", "docker-compose.yaml", "Makefile"),
    "Config": (".gitignore", ".gitattributes", ".dockerignore", ".editorconfig", "requirements.txt", "pyproject.toml", "package.json", "tsconfig.json"),
    "Code": ("setup.py",),
    "Documentation": ("LICENSE", "README", "CHANGELOG", "CONTRIBUTING"),
}
BINARY = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".webp", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".odt", ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z",
    ".rar", ".exe", ".dll", ".so", ".dylib", ".bin", ".pyc", ".pyo", ".class", ".o", ".obj", ".a", ".mp3", ".mp4", ".wav", ".avi", ".mov", ".webm", ".ttf", ".otf", ".woff",
    ".woff2", ".eot", ".db", ".sqlite", ".sqlite3", ".jar", ".war", ".ear", ".whl", ".egg",
)
EXTENSIONS = {
    "Code": (".py", ".pyw", ".pyi", ".js", ".jsx", ".ts", ".tsx", ".go", ".rs", ".java", ".kt", ".c", ".cpp", ".h", ".hpp", ".cs", ".rb", ".php", ".swift", ".scala", ".lua", ".pl", ".sh", ".bash", ".ps1", ".sql", ".graphql", ".r", ".css", ".scss", ".sass", ".less"),
    "Documentation": (".md", ".markdown", ".rst", ".txt", ".adoc", ".tex", ".html", ".htm"),
    "Config": (".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".properties", ".xml"),
    "Data": (".csv", ".tsv"),
    "Infrastructure": (".dockerfile", ".tf", ".hcl"),
}


def extension(name) -> Column:
    return F.lower(F.regexp_extract(name, r".(\.[^./]+)$", 1))


def file_category(name) -> Column:
    """By name, then binary extension, then extension; else Unknown."""
    ext = extension(name)
    out = F
    for category, names in FILE_NAMES.items():
        out = out.when(name.isin(*names), category)
    out = out.when(ext.isin(*BINARY), "Binary")
    for category, exts in EXTENSIONS.items():
        out = out.when(ext.isin(*exts), category)
    return out.otherwise("Unknown")


def asset_class(name) -> Column:
    ext = extension(name)
    return (
        F.when(ext.isin(".py", ".js", ".jsx", ".ts", ".tsx", ".go", ".java", ".cpp", ".h", ".rs"), "Code")
        .when(name.isin("Dockerfile", "docker-compose.yml", "Makefile") | ext.isin(".tf", ".env", ".toml"), "Infrastructure")
        .when(ext.isin(".md", ".txt", ".rst"), "Documentation")
        .when(ext.isin(".json", ".yaml", ".yml", ".xml", ".ini"), "Config")
        .otherwise("Data")
    )


def node_type(path) -> Column:
    return F.when(path.endswith(".md"), "MARKDOWN").when(path.rlike(r"\.(ts|js|tsx|jsx|py|go|rs)$"), "CODE").otherwise("DOCUMENT")


def doc_type(name) -> Column:
    u = F.upper(name)
    return F.when(u.contains("ARCH"), "ARCHITECTURE").when(u.contains("PRD"), "PRD").when(u.contains("SPEC"), "SPEC").when(u.contains("TODO"), "TODO").otherwise("DOC")


def page_text(html) -> Column:
    """The main part of a page as text: scripts, styles, navigation, header and footer go, block tags are blank lines."""
    main = F.regexp_extract(html, r"(?is)<main[^>]*>(.*?)</main>", 1)
    x = F.when(main != "", main).otherwise(html)
    for tag in ("script", "style", "nav", "header", "footer"):
        x = F.regexp_replace(x, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    x = F.regexp_replace(x, r"(?i)<(?:div|p|br|h[1-6]|li|ul|ol|section|article)[^>]*>", "\n\n")
    x = F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", ""), r"\n{3,}", "\n\n")
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def page_title(html) -> Column:
    return F.regexp_extract(html, r"(?i)<title>(.*?)</title>", 1)


def citations(answer) -> Column:
    """[Source: path:a-b] as an array of structs."""
    each = F.regexp_extract_all(answer, F.lit(r"\[Source: ([^\]]+)\]"), F.lit(1))
    return F.transform(each, lambda x: F.struct(F.regexp_extract(x, r"^([^:]+)", 1).alias("path"), F.regexp_extract(x, r":(\d+)", 1).try_cast("int").alias("start"), F.regexp_extract(x, r"-(\d+)$", 1).try_cast("int").alias("end")))


def graph_citations(answer) -> Column:
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[Graph: ([^\]]+)\]"), F.lit(1)), lambda x: F.split(x, " (?:->|→) "))


def evidence_lines(text) -> Column:
    """Lines "- a -> b (type)" as structs."""
    each = F.regexp_extract_all(text, F.lit(r"(?m)^- (\S+ -> \S+ \([^)]*\))"), F.lit(1))
    return F.transform(each, lambda x: F.struct(F.regexp_extract(x, r"^(\S+)", 1).alias("src"), F.regexp_extract(x, r"-> (\S+)", 1).alias("dst"), F.regexp_extract(x, r"\(([^)]*)\)", 1).alias("type")))


def fault_type(message) -> Column:
    kind = F.regexp_extract(message, "^([A-Z_]+):", 1)
    return F.when(kind != "", kind).otherwise("UNKNOWN")


def freshness(last_modified, as_of: float) -> Column:
    age = (F.lit(as_of) - last_modified) / 86400.0
    return F.when(F.coalesce(last_modified, F.lit(0.0)) == 0, "unknown").when(age < 7, "fresh").when(age < 30, "recent").when(age < 90, "aging").otherwise("stale")


def shortened(text, most: int = 100) -> Column:
    return F.when(text.isNull(), "").when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def short_hash(text, chars: int = 16) -> Column:
    half = chars // 2
    return F.when(text.isNull(), "").when(F.length(text) <= chars, text).otherwise(F.concat(F.substring(text, 1, half), F.lit("..."), F.substring(text, -half, half)))


def short_path(path, most: int = 50) -> Column:
    parts = F.split(path, "/")
    n = F.size(parts)
    middle = F.concat(F.get(parts, F.lit(0)), F.lit("/.../"), F.get(parts, n - 2), F.lit("/"), F.get(parts, n - 1))
    return F.when(path.isNull() | (path == ""), "unknown").when(F.length(path) <= most, path).when(n <= 2, shortened(path, most)).otherwise(middle)


def line_range(start, end) -> Column:
    s = start.cast("string")
    return F.when(start.isNull(), "").when(end.isNull() | (end == start), F.concat(F.lit(":"), s)).otherwise(F.concat(F.lit(":"), s, F.lit("-"), end.cast("string")))


def token_estimate(text) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) * 0.25)).cast("long")


def hours(text) -> Column:
    """Hours of a window like 24h or 7d, or null."""
    n = F.regexp_extract(text, r"^(\d+)[hd]$", 1).try_cast("int")
    return F.when(text.endswith("d"), n * 24).otherwise(n)


def trigger(error) -> Column:
    """Why a provider failed, by what its message says."""
    return (
        F.when(error.rlike("timeout|ETIMEDOUT|ESOCKETTIMEDOUT"), "timeout")
        .when(error.rlike("ECONNREFUSED|ENOTFOUND|connect|Network error"), "container_down")
        .when(error.contains("model") & error.rlike("not found|does not exist|unknown"), "model_not_found")
        .otherwise("retry_exceeded")
    )


def project_errors(name) -> Column:
    """What is wrong with a project name; empty if nothing is."""
    n = F.lower(F.trim(name))
    return F.array_compact(
        F.array(
            F.when(name.isNull() | (n == ""), "empty"),
            F.when(F.length(n) > 64, "too long"),
            F.when((n != "") & ~n.rlike("^[a-z0-9][a-z0-9._-]*$"), "bad characters"),
            F.when(n.contains(".."), "dots"),
        )
    )


def provenance_errors(file_hash, full_hash, start, end) -> Column:
    return F.array_compact(
        F.array(F.when(F.length(file_hash) != 40, "file hash"), F.when(F.length(full_hash) != 64, "text hash"), F.when(start < 0, "start"), F.when(end < start, "end"))
    )


@F.pandas_udf(BooleanType())
def signature_ok(payload: pd.Series, signature: pd.Series, secret: pd.Series) -> pd.Series:
    """Whether signature is sha256=HMAC of the payload."""
    check = lambda p, s, k: hmac.compare_digest("sha256=" + hmac.new(k.encode(), p.encode(), hashlib.sha256).hexdigest(), s or "")
    return pd.Series([check(p, s, k) for p, s, k in zip(payload, signature, secret, strict=True)])


@F.pandas_udf(StringType())
def point_id(uid: pd.Series) -> pd.Series:
    return uid.map(lambda x: str(uuid.uuid5(uuid.NAMESPACE_DNS, x)))


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON with sorted keys and no spaces, non-ASCII escaped."""
    return text.map(lambda x: json.dumps(json.loads(x), sort_keys=True, separators=(",", ":")))


def packet_hash(text) -> Column:
    return F.sha2(canonical_json(text), 256)
