"""Symbols, edges, issues and routes of source files."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SYMBOLS = "path string, uid string, label string, name string, parent string, start_line int, end_line int, is_async boolean, docstring string, signature string"
EDGES = "path string, src string, target string, type string"


def _walk(path: str, text: str) -> tuple[list[tuple], list[tuple]]:
    symbols, edges = [], []
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return symbols, edges

    def name_of(node) -> str | None:
        return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None

    def visit(node, owner: str, ours: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                uid = f"{owner}.{child.name}"
                is_class = isinstance(child, ast.ClassDef)
                sign = f"class {child.name}({', '.join(ast.unparse(b) for b in child.bases)})" if is_class else f"{child.name}({ast.unparse(child.args)})" + (f" -> {ast.unparse(child.returns)}" if child.returns else "")
                symbols.append((path, uid, "Class" if is_class else "Function", child.name, owner, child.lineno, child.end_lineno, isinstance(child, ast.AsyncFunctionDef), ast.get_docstring(child), sign))
                edges.append((path, owner, uid, "DEFINES"))
                if is_class:
                    edges.extend((path, uid, n, "EXTENDS") for n in map(name_of, child.bases) if n)
                visit(child, uid, True)
            else:
                if isinstance(child, ast.Import):
                    edges.extend((path, path, a.name, "DEPENDS_ON") for a in child.names)
                elif isinstance(child, ast.ImportFrom):
                    edges.append((path, path, "." * child.level + (child.module or ""), "DEPENDS_ON"))
                elif isinstance(child, ast.Call) and ours and (n := name_of(child.func)):
                    edges.append((path, owner, n, "CALLS"))
                visit(child, owner, ours)

    visit(tree, path, False)
    return symbols, edges


def python_symbols(files: DataFrame) -> DataFrame:
    """Classes and functions of Python files (path, text); files that don't parse have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([s for p, t in zip(f["path"], f["text"], strict=True) for s in _walk(p, t or "")[0]], columns=[x.split()[0] for x in SYMBOLS.split(", ")])

    return files.select("path", "text").mapInPandas(run, SYMBOLS)


def python_edges(files: DataFrame) -> DataFrame:
    """DEFINES, CALLS, EXTENDS and DEPENDS_ON edges; targets of the last three are names."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([e for p, t in zip(f["path"], f["text"], strict=True) for e in _walk(p, t or "")[1]], columns=["path", "src", "target", "type"])

    return files.select("path", "text").mapInPandas(run, EDGES)


#: Patterns of definitions by language: label, pattern with the name as its group.
DEFINITIONS = {
    "py": (("Function", r"^\s*(?:async\s+)?def\s+(\w+)"), ("Class", r"^\s*class\s+(\w+)")),
    "js": (("Function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("Function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>"), ("Class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)")),
    "go": (("Function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("Class", r"^type\s+(\w+)\s+(?:struct|interface)")),
    "rs": (("Function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"), ("Class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)")),
    "java": (("Class", r"^\s*(?:public|private|protected)?\s*(?:abstract\s+|final\s+)*(?:class|interface|enum)\s+(\w+)"), ("Function", r"^\s*(?:public|private|protected)\s+(?:static\s+)?[\w<>\[\]]+\s+(\w+)\s*\(")),
    "rb": (("Function", r"^\s*def\s+(?:self\.)?(\w+)"), ("Class", r"^\s*(?:class|module)\s+(\w+)")),
    "php": (("Function", r"^\s*(?:public|private|protected)?\s*(?:static\s+)?function\s+(\w+)"), ("Class", r"^\s*(?:abstract\s+|final\s+)?(?:class|interface|trait)\s+(\w+)")),
    "c": (("Function", r"^[\w*]+\s+\*?(\w+)\s*\([^;]*\)\s*\{?$"), ("Class", r"^\s*(?:struct|class)\s+(\w+)")),
}
FAMILY = {"py": "py", "js": "js", "jsx": "js", "ts": "js", "tsx": "js", "go": "go", "rs": "rs", "java": "java", "kt": "java", "rb": "rb", "php": "php", "c": "c", "cpp": "c", "h": "c", "cc": "c"}


def lines(files: DataFrame) -> DataFrame:
    """path, line (from 1), text of each line."""
    return files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def pattern_symbols(files: DataFrame) -> DataFrame:
    """Symbols by the patterns of a file's language, for languages without a parser; one of each uid."""
    ext = F.regexp_extract("path", r"\.(\w+)$", 1)
    family = F.element_at(F.create_map(*[F.lit(x) for kv in FAMILY.items() for x in kv]), ext)
    each = lines(files).withColumn("family", family)
    found = F.array_compact(
        F.array(*[F.when((F.col("family") == fam) & F.col("text").rlike(p), F.struct(F.lit(label).alias("label"), F.regexp_extract("text", p, 1).alias("name"))) for fam, rules in DEFINITIONS.items() for label, p in rules])
    )
    out = each.where("family is not null").select("path", "line", F.explode(found).alias("s")).select("path", "line", "s.*")
    uid = F.when(F.col("label") == "Class", F.concat_ws(":", "path", "name")).otherwise(F.concat_ws(":", "path", "name", F.col("line").cast("string")))
    return out.withColumn("uid", uid).groupBy("uid", "path", "label", "name").agg(F.min("line").alias("line"))


def comments_above(files: DataFrame) -> DataFrame:
    """For each line the comment lines right above it, joined; blank lines in between are passed over."""
    w = Window.partitionBy("path").orderBy("line")
    t = F.trim("text")
    kind = F.when(t == "", "blank").when(t.rlike(r"^(#|//|\*|/\*)"), "comment").otherwise("code")
    each = lines(files).withColumn("kind", kind)
    each = each.withColumn("block", F.coalesce(F.sum(F.when(F.col("kind") == "code", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    notes = each.where("kind = 'comment'").groupBy("path", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.trim(F.regexp_replace(F.trim("text"), r"^(#+|/+\*?|\*+)", "")).alias("c")))), lambda x: x["c"]), "\n").alias("comment"))
    return each.where("kind = 'code'").join(notes, ["path", "block"], "left").select("path", "line", "text", "comment")


def _begins(word: str):
    return lambda x: F.upper(x).startswith(word)


def todos(files: DataFrame) -> DataFrame:
    """path, line, type, message, confidence of TODO and FIXME remarks.

    Inside a docstring (an odd number of quote lines so far) confidence is MEDIUM; a remark in a string is left out.
    """
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    text = F.col("text")
    marks = text.contains('"""') | text.contains("'''")
    each = lines(files).withColumn("open", F.sum(marks.cast("int")).over(w) % 2 == 1)
    before = F.substring_index("text", "#", 1)
    quoted = F.when(text.contains("#") & before.rlike("TODO|FIXME"), before.rlike("[\"']")).otherwise(text.rlike("[\"'](TODO|FIXME)"))
    each = each.withColumn("quoted", quoted & text.rlike("[\"']"))
    sure = F.when(F.col("open") | marks, "MEDIUM").otherwise("HIGH")
    # A remark begins the line or follows a comment sign, white space aside; what stands after the word and a colon is its message.
    parts = F.transform(F.split(F.regexp_replace("text", "//", "#"), "#"), lambda x: F.ltrim(x))
    found = []
    for word in ("TODO", "FIXME"):
        own = F.get(F.filter(parts, _begins(word)), F.lit(0))
        message = F.trim(F.regexp_replace(F.substring(own, len(word) + 1, 1 << 30), "^:", ""))
        found.append(F.when(F.length(message) > 0, F.struct(F.lit(word).alias("type"), message.alias("message"))))
    each = each.where(~F.col("quoted") & F.upper("text").rlike("TODO|FIXME")).select("path", "line", sure.alias("confidence"), F.explode(F.array_compact(F.array(*found))).alias("x"))
    return each.select("path", "line", "x.type", "x.message", "confidence")


ISSUES = "path string, line int, type string, message string, confidence string"


def _issues(path: str, text: str) -> list[tuple]:
    out = []
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return out

    def hollow(body) -> bool:
        rest = [b for b in body if not (isinstance(b, ast.Expr) and isinstance(b.value, ast.Constant) and isinstance(b.value.value, str))]
        return all(isinstance(b, ast.Pass) or (isinstance(b, ast.Expr) and isinstance(b.value, ast.Constant) and b.value.value is Ellipsis) for b in rest)

    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            raised = [r.exc for r in node.body if isinstance(r, ast.Raise) and r.exc is not None]
            if any("NotImplementedError" in ast.unparse(r) for r in raised):
                out.append((path, node.lineno, "INCOMPLETE", f"{node.name} is not implemented", "HIGH"))
            elif hollow(node.body):
                out.append((path, node.lineno, "INCOMPLETE", f"{node.name} is empty", "HIGH"))
        elif isinstance(node, ast.ClassDef) and hollow(node.body):
            out.append((path, node.lineno, "INCOMPLETE", f"class {node.name} is empty", "MEDIUM"))
        elif isinstance(node, ast.ExceptHandler):
            if node.type is None:
                out.append((path, node.lineno, "ERROR_PATTERN", "bare except", "HIGH"))
            if hollow(node.body):
                out.append((path, node.lineno, "ERROR_PATTERN", "empty except", "HIGH"))
    return out


#: What is looked for in JavaScript and TypeScript: type, pattern, message ({0} is the name), confidence.
_SCRIPT = tuple(
    (kind, re.compile(p), message, sure)
    for kind, p, message, sure in (
        ("INCOMPLETE", r"\bfunction\s*\*?\s*(\w+)\s*\([^)]*\)\s*(?::\s*[\w<>\[\]| ]+)?\{\s*\}", "{0} is empty", "HIGH"),
        ("INCOMPLETE", r"\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>\s*\{\s*\}", "{0} is empty", "HIGH"),
        ("INCOMPLETE", r"\bclass\s+(\w+)[^{]*\{\s*\}", "class {0} is empty", "MEDIUM"),
        ("INCOMPLETE", r"\bthrow\s+new\s+\w*Error\(\s*[\"'`][^\"'`]*[Nn]ot (?:yet )?implemented[^\"'`]*()", "not implemented", "HIGH"),
        ("ERROR_PATTERN", r"\bconsole\.log\s*\(()", "console.log", "MEDIUM"),
        ("ERROR_PATTERN", r"\bcatch\s*(?:\([^)]*\)\s*)?\{\s*\}()", "empty catch", "MEDIUM"),
    )
)


def _script_issues(path: str, text: str) -> list[tuple]:
    """What the patterns find, over line ends too; comments within braces do not count as code."""
    bare = re.sub(r"//[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.DOTALL)
    found = [(path, bare.count("\n", 0, m.start()) + 1, kind, message.format(m[1]), sure) for kind, p, message, sure in _SCRIPT for m in p.finditer(bare)]
    return sorted(found, key=lambda x: (x[1], x[3]))


def issues(files: DataFrame) -> DataFrame:
    """Empty functions and classes, what is not implemented, bare and empty handlers, console calls; test files are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([i for p, t in zip(f["path"], f["text"], strict=True) for i in (_issues if p.endswith(".py") else _script_issues)(p, t or "")], columns=[x.split()[0] for x in ISSUES.split(", ")])

    own = files.where(~F.col("path").rlike(r"(^|/)(tests?/|test_)|_test\.|\.test\."))
    return own.where(F.col("path").rlike(r"\.(py|js|ts|jsx|tsx)$")).select("path", "text").mapInPandas(run, ISSUES)


def by_severity(found: DataFrame) -> DataFrame:
    """Issues in order of confidence, HIGH first, then of path and line, with their place."""
    rank = F.when(F.col("confidence") == "HIGH", 0).when(F.col("confidence") == "MEDIUM", 1).otherwise(2)
    return found.withColumn("rank", rank).orderBy("rank", "path", "line", "message")


def by_file(found: DataFrame) -> DataFrame:
    """path, issues: each file's issues as structs in order of line."""
    return found.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "type", "message", "confidence"))).alias("issues"))


_DECORATED = re.compile(r"\.(get|post|put|delete|patch|route)$")


def routes(files: DataFrame) -> DataFrame:
    """HTTP routes that decorators declare: path, method, route, handler."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, t in zip(f["path"], f["text"], strict=True):
                try:
                    tree = ast.parse(t or "")
                except (SyntaxError, ValueError):
                    continue
                for node in ast.walk(tree):
                    for d in getattr(node, "decorator_list", []):
                        if isinstance(d, ast.Call) and d.args and isinstance(d.args[0], ast.Constant) and (m := _DECORATED.search(ast.unparse(d.func))):
                            verbs = next((ast.literal_eval(k.value) for k in d.keywords if k.arg == "methods"), ["GET"]) if m[1] == "route" else [m[1].upper()]
                            rows += [(p, v, str(d.args[0].value), node.name) for v in verbs]
            yield pd.DataFrame(rows, columns=["path", "method", "route", "handler"])

    return files.where(F.col("path").endswith(".py")).select("path", "text").mapInPandas(run, "path string, method string, route string, handler string")


_VERBS = ("get", "post", "put", "delete", "patch")


def _yaml_endpoints(text: str) -> list[tuple[str, str, str | None]]:
    """(route, METHOD, summary or operationId) of an OpenAPI document in block-style YAML, read by indentation."""
    out: list[tuple[str, str, str | None]] = []
    trail: list[tuple[int, str]] = []
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        bare = line.strip()
        if not bare or bare.startswith(("#", "- ", "---")):
            continue
        indent = len(line) - len(line.lstrip())
        name, colon, value = bare.rpartition(":") if bare.endswith(":") else bare.partition(": ")
        if not colon:
            continue
        while trail and trail[-1][0] >= indent:
            trail.pop()
        trail.append((indent, name.strip("\"'")))
        keys = [k for _, k in trail]
        if keys[0] == "paths" and len(keys) == 3 and keys[2].lower() in _VERBS:
            out.append((keys[1], keys[2].upper(), None))
        elif keys[0] == "paths" and len(keys) == 4 and out and out[-1][:2] == (keys[1], keys[2].upper()) and keys[3] in ("summary", "operationId"):
            if keys[3] == "summary" or out[-1][2] is None:
                out[-1] = (*out[-1][:2], value.strip().strip("\"'"))
    return out


def openapi(files: DataFrame) -> DataFrame:
    """Endpoints of OpenAPI documents in JSON and in block-style YAML: path, route, method, summary."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(p, *e) for p, t in zip(f["path"], f["text"], strict=True) for e in _yaml_endpoints(t or "")], columns=["path", "route", "method", "summary"])

    yaml = files.where(F.col("path").rlike(r"\.ya?ml$")).select("path", "text").mapInPandas(run, "path string, route string, method string, summary string")
    doc = F.from_json("text", "paths map<string, map<string, struct<summary: string, operationId: string>>>")
    each = files.where(F.col("path").endswith(".json")).select("path", F.explode(doc["paths"]).alias("route", "methods")).select("path", "route", F.explode("methods").alias("method", "m"))
    json = each.where(F.col("method").isin(*_VERBS)).select("path", "route", F.upper("method").alias("method"), F.coalesce("m.summary", "m.operationId").alias("summary"))
    return json.unionByName(yaml)


def protobuf(files: DataFrame) -> DataFrame:
    """Messages, services and methods of .proto files."""
    own = files.where(F.col("path").endswith(".proto"))
    out = None
    for kind, p in (("message", r"(?m)^\s*message\s+(\w+)"), ("service", r"(?m)^\s*service\s+(\w+)"), ("rpc", r"(?m)^\s*rpc\s+(\w+)\s*\(")):
        one = own.select("path", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(p), F.lit(1))).alias("name"))
        out = one if out is None else out.unionByName(one)
    return out


def taxonomy(files: DataFrame) -> DataFrame:
    """All API definitions of all files in one list, in order."""
    a = routes(files).select("path", F.lit("route").alias("kind"), F.concat_ws(" ", "method", "route").alias("name"))
    b = openapi(files).select("path", F.lit("endpoint").alias("kind"), F.concat_ws(" ", "method", "route").alias("name"))
    return a.unionByName(b).unionByName(protobuf(files)).orderBy("kind", "name", "path")
