"""Texts made of rows: prompts, summaries, titles, and the mapping of items between systems."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a finding becomes as a work item.
ISSUE_WORK = {"TODO": "task", "FIXME": "bug", "INCOMPLETE": "feature", "ERROR_PATTERN": "bug"}
ISSUE_PRIORITY = {"HIGH": "high", "MEDIUM": "medium", "LOW": "low"}
TYPE_LABELS = {"bug": "bug", "feature": "enhancement", "docs": "documentation", "chore": "chore", "refactor": "refactor"}


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def enriched_query(question, focus, scope, goal) -> Column:
    """A question with what was learned about it, part by part; parts that are null are left out."""
    part = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws(". ", question, part("Focus", focus), part("Scope", scope), part("Goal", goal))


def context(hits, most: int = 5) -> Column:
    """The first hits of an array of struct(path, score) as lines."""
    return F.array_join(F.transform(F.slice(hits, 1, most), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["path"], F.lit(" ("), F.format_number(x["score"], 2), F.lit(")"))), "\n")


def insights(n_code, n_docs, confidence) -> Column:
    """What an answer rests on, as short sentences."""
    return F.array_compact(
        F.array(
            F.when(n_code > 0, F.concat(n_code.cast("string"), F.lit(" code results"))),
            F.when(n_docs > 0, F.concat(n_docs.cast("string"), F.lit(" documents"))),
            F.when(n_docs == 0, "No document covers this"),
            F.when(confidence < 50, "Check the sources: confidence is low"),
        )
    )


def result_status(semantic_ok, structural_ok) -> Column:
    return F.when(semantic_ok & structural_ok, "success").when(semantic_ok | structural_ok, "partial").otherwise("unavailable")


def issue_item(kind, confidence, path, line, message) -> Column:
    """struct(title, description, work_type, priority) of a finding in code."""
    return F.struct(
        F.concat(F.lit("["), kind, F.lit("] "), F.substring(message, 1, 60)).alias("title"),
        F.concat(message, F.lit(" ("), path, F.lit(":"), line.cast("string"), F.lit(")")).alias("description"),
        F.coalesce(F.element_at(_map(ISSUE_WORK), kind), F.lit("task")).alias("work_type"),
        F.coalesce(F.element_at(_map(ISSUE_PRIORITY), confidence), F.lit("medium")).alias("priority"),
    )


def external_issue(uid, title, description, work_type, priority, status, labels) -> Column:
    """struct(title, body, labels, state) for an issue tracker; the body carries the uid."""
    own = F.array_compact(F.array(F.element_at(_map(TYPE_LABELS), work_type), F.concat(F.lit("priority:"), priority)))
    return F.struct(
        title.alias("title"),
        F.concat(F.coalesce(description, F.lit("")), F.lit("\n\n<!-- uid: "), uid, F.lit(" -->")).alias("body"),
        F.array_sort(F.array_union(F.coalesce(labels, F.array().cast("array<string>")), own)).alias("labels"),
        F.when(status.isin("closed", "completed"), "closed").otherwise("open").alias("state"),
    )


def uid_in_body(body) -> Column:
    found = F.regexp_extract(body, r"<!-- uid: (\S+) -->", 1)
    return F.when(found != "", found)


def commit_title(work_type, scope, description) -> Column:
    return F.concat(F.initcap(work_type), F.when(scope.isNotNull(), F.concat(F.lit(" ("), scope, F.lit(")"))).otherwise(""), F.lit(": "), F.substring(description, 1, 80))


def commit_description(commit_hash, author, files, most: int = 10) -> Column:
    shown = F.array_join(F.slice(F.array_sort(files), 1, most), "\n- ")
    more = F.when(F.size(files) > most, F.concat(F.lit("\n... and "), (F.size(files) - most).cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(F.lit("Commit "), F.substring(commit_hash, 1, 8), F.lit(" by "), author, F.lit("\n- "), shown, more)


def by_label(labels, order) -> Column:
    """The first label of order that a node has, else Node."""
    out = F
    for x in order:
        out = out.when(F.array_contains(labels, x), x)
    return out.otherwise("Node")


def markdown(items) -> Column:
    """An array of struct(path, name, score) as a list."""
    return F.when(F.size(items) == 0, "No evidence").otherwise(F.array_join(F.transform(items, lambda x: F.concat(F.lit("- `"), x["path"], F.lit("` **"), x["name"], F.lit("** "), F.format_number(x["score"], 3))), "\n"))


#: Labels of the second mapping to an issue tracker.
WORK_LABELS = {"bug": "bug", "feature": "enhancement", "todo": "todo", "chore": "chore", "docs": "documentation"}
PRIORITY_LABELS = {"high": "high-priority", "medium": "medium-priority", "low": "low-priority"}


def plain_issue(title, description, work_type, priority, source, status) -> Column:
    """struct(title, body, labels, state): the second mapping, without a uid; found items are marked as generated."""
    labels = F.array_compact(F.array(F.element_at(_map(WORK_LABELS), work_type), F.element_at(_map(PRIORITY_LABELS), priority), F.when(source == "code_analyzer", "auto-generated")))
    return F.struct(
        title.alias("title"), F.coalesce(description, F.lit("")).alias("body"), labels.alias("labels"),
        F.when(F.coalesce(status, F.lit("open")).isin("closed", "resolved", "done"), "closed").otherwise("open").alias("state"),
    )
