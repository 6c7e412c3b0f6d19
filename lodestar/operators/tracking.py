"""Work items, commits, links, queue and conversations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRIORITIES = ("critical", "high", "medium", "low")


def priority_rank(column: str = "priority", order: Sequence[str] = PRIORITIES):
    rank = F
    for i, p in enumerate(order):
        rank = rank.when(F.col(column) == p, i)
    return rank.otherwise(len(order))


def filtered(items: DataFrame, **equal) -> DataFrame:
    """Rows that meet all conditions given; an argument of None asks nothing, a list means any of it."""
    for column, value in equal.items():
        if value is not None:
            items = items.where(F.col(column).isin(*value) if isinstance(value, list | tuple) else F.col(column) == value)
    return items


def page(items: DataFrame, order: str = "created_at", descending: bool = True, offset: int = 0, limit: int = 20, key: str = "uid", allowed: Sequence[str] = ("created_at", "priority", "status", "title", "total")) -> DataFrame:
    if order not in allowed:
        raise ValueError(f"can't order by {order}")
    column = F.desc(order) if descending else F.asc(order)
    return items.orderBy(column, key).offset(offset).limit(limit)


def orphan_commits(changes: DataFrame, links: DataFrame, since, limit: int | None = 50) -> DataFrame:
    """Commits without a link, changed since a time, newest first, with their files and lines."""
    bare = changes.where(F.col("ts") >= since).join(links.select("commit_hash").distinct(), "commit_hash", "left_anti")
    out = bare.groupBy("commit_hash", "ts").agg(F.countDistinct("file_path").alias("files"), F.sum("lines_added").alias("lines_added"))
    return out.orderBy(F.desc("ts"), "commit_hash").limit(limit) if limit else out


def context(items: DataFrame, links: DataFrame) -> DataFrame:
    """Per item: its linked commits, files and lines; items without links have zeros."""
    own = links.groupBy("work_uid").agg(F.countDistinct("commit_hash").alias("commits"), F.countDistinct("file_path").alias("files"), F.sum("lines_added").alias("lines_added"))
    out = items.join(own, F.col("uid") == F.col("work_uid"), "left").drop("work_uid")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("commits", "files", "lines_added")})


def trace_file(items: DataFrame, links: DataFrame, file_path: str, confidence: float = 0.5) -> DataFrame:
    """Items that a file's changes are linked to with that confidence or more, with the commits in order."""
    near = links.where((F.col("file_path") == file_path) & (F.col("confidence") >= confidence))
    own = near.groupBy("work_uid").agg(F.max("confidence").alias("confidence"), F.array_join(F.array_sort(F.collect_set("commit_hash")), ",").alias("commits"))
    return own.join(items, F.col("uid") == F.col("work_uid")).select("uid", "title", "status", "confidence", "commits")


def linked_commits(links: DataFrame, uid, limit: int = 20) -> DataFrame:
    return links.where(F.col("work_uid") == uid).select("commit_hash", "ts", "file_path").distinct().orderBy(F.desc("ts"), "commit_hash", "file_path").limit(limit)


def deleted(items: DataFrame, uids: DataFrame) -> DataFrame:
    """items without those that uids (uid) names; unknown and repeated uids change nothing."""
    return items.join(uids.select("uid"), "uid", "left_anti")


def board(items: DataFrame, links: DataFrame) -> DataFrame:
    """Items with the number of their linked commits and a sort position by priority."""
    n = links.groupBy("work_uid").agg(F.countDistinct("commit_hash").alias("n_commits"))
    out = items.join(n, F.col("uid") == F.col("work_uid"), "left").drop("work_uid")
    return out.withColumn("n_commits", F.coalesce("n_commits", F.lit(0))).withColumn("position", priority_rank())


def by_status(items: DataFrame, statuses: Sequence[str]) -> DataFrame:
    return items.groupBy("project").pivot("status", list(statuses)).agg(F.count(F.lit(1))).na.fill(0)


def search_board(items: DataFrame, text: str = "", priority: str = "all", work_type: str = "all") -> DataFrame:
    out = items.where(F.lower("title").contains(text.lower())) if text else items
    for column, value in (("priority", priority), ("work_type", work_type)):
        if value != "all":
            out = out.where(F.col(column) == value)
    return out


def updated(items: DataFrame, changes: DataFrame, fields: Sequence[str], key: str = "uid") -> DataFrame:
    """items with the fields of changes where these are not null."""
    new = changes.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    out = items.join(new, key, "left")
    return out.withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).select(*items.columns)


def audit(items: DataFrame, changes: DataFrame, fields: Sequence[str] = ("status", "priority"), key: str = "uid") -> DataFrame:
    """One event for each field that changes alter: uid, field, old, new."""
    new = changes.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    each = F.array_compact(
        F.array(*[F.when(F.col(f"_{f}").isNotNull() & ~F.col(f"_{f}").eqNullSafe(F.col(f)), F.struct(F.lit(f).alias("field"), F.col(f).alias("old"), F.col(f"_{f}").alias("new"))) for f in fields])
    )
    return items.join(new, key).select(key, F.explode(each).alias("e")).select(key, "e.field", "e.old", "e.new")


def pending(queue: DataFrame, limit: int = 10) -> DataFrame:
    return queue.where("status = 'pending'").withColumn("position", priority_rank()).orderBy("position", "created_at", "uid").limit(limit)


def retry_times(queue: DataFrame, base: int = 5):
    """queue with next_retry: base ** retries minutes after the failure."""
    return queue.withColumn("delay_minutes", F.pow(F.lit(float(base)), F.col("retry_count").cast("double"))).withColumn("next_retry", F.col("failed_at") + F.make_dt_interval(mins=F.col("delay_minutes").cast("int")))


def due(queue: DataFrame, as_of, retries: int = 3) -> DataFrame:
    return queue.where((F.col("status") == "failed") & (F.col("retry_count") < retries) & (F.col("next_retry").isNull() | (F.col("next_retry") <= as_of)))


def dead(queue: DataFrame, retries: int = 3) -> DataFrame:
    return queue.where((F.col("status") == "failed") & (F.col("retry_count") >= retries))


def conversations(turns: DataFrame) -> DataFrame:
    """Per conversation its turns, user queries (0 if none) and the first and last turn."""
    return turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), F.count(F.when(F.col("role") == "user", 1)).alias("queries"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn")
    )


def last_queries(turns: DataFrame, n: int = 3) -> DataFrame:
    """The last n user queries of each conversation, oldest first; n rows of each are kept before any list is made."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("text")))
    last = turns.where("role = 'user'").select("conv_id", "turn", "text", place.alias("_n")).where(F.col("_n") <= n)
    asked = last.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("q"))
    return asked.select("conv_id", F.transform("q", lambda x: x["text"]).alias("queries"))


def rewrite(turns: DataFrame, n: int = 3) -> DataFrame:
    """Each conversation's last query with those before it as context."""
    q = last_queries(turns, n)
    before = F.array_join(F.slice("queries", 1, F.size("queries") - 1), " | ")
    return q.select("conv_id", F.when(F.size("queries") > 1, F.concat(F.lit("Context: "), before, F.lit(" Question: "), F.element_at("queries", -1))).otherwise(F.element_at("queries", -1)).alias("rewritten"))


def idempotent(rows: DataFrame, existing: DataFrame, token: str = "token", order: str = "seq") -> DataFrame:
    """The first row of each token that does not exist yet; rows without token all pass."""
    first = rows.where(F.col(token).isNotNull()).join(existing.select(token), token, "left_anti")
    rest = [c for c in rows.columns if c not in (token, order)]
    best = first.groupBy(token).agg(F.min(F.struct(order, *rest)).alias("_x")).select(token, "_x.*").select(*rows.columns)
    return best.unionByName(rows.where(F.col(token).isNull()))


#: What a work item and a change may be.
WORK_TYPES = ("feature", "bug", "task", "enhancement", "refactor")
CHANGE_TYPES = ("modified", "added", "deleted", "renamed")
SNIPPET = 1000


def missing(required: Sequence[str], choices: dict[str, Sequence[str]] | None = None):
    """What a row lacks: required columns that are null or empty, and values that are not among the allowed ones."""
    lacks = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", f"missing {c}") for c in required]
    wrong = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*values), f"unknown {c}") for c, values in (choices or {}).items()]
    return F.array_compact(F.array(*lacks, *wrong))


def create_items(rows: DataFrame, project: str, as_of: str) -> DataFrame:
    """New open work items of rows (title, description, work_type, priority), with problems; only rows without any count."""
    from lodestar.functions.text import work_item_uid

    uid = work_item_uid(F.lit(project), F.col("title"), F.col("description"))
    bad = missing(("title", "description", "work_type"), {"work_type": WORK_TYPES, "priority": PRIORITIES})
    when = F.lit(as_of).cast("timestamp_ntz")
    out = rows.withColumn("problems", bad).withColumn("uid", F.when(F.size("problems") == 0, uid))
    return out.withColumns({"project": F.lit(project), "priority": F.coalesce("priority", F.lit("medium")), "status": F.lit("open"), "created_at": when, "updated_at": when})


def record_changes(rows: DataFrame, project: str) -> DataFrame:
    """Changes (commit_hash, file_path, change_type, diff) with their uid, the diff cut to SNIPPET characters, and problems."""
    from lodestar.functions.text import change_uid

    uid = change_uid(F.lit(project), F.col("commit_hash"), F.col("file_path"))
    out = rows.withColumn("problems", missing(("commit_hash", "file_path", "change_type"), {"change_type": CHANGE_TYPES}))
    return out.withColumns({"uid": F.when(F.size("problems") == 0, uid), "project": F.lit(project), "diff": F.substring("diff", 1, SNIPPET)})


def link(pairs: DataFrame, items: DataFrame, recorded: DataFrame, confidence: float = 0.5, reason: str | None = None) -> DataFrame:
    """Links (work_uid, change_uid) whose item and change exist, with confidence and reason; one for each pair."""
    known = pairs.join(items.select(F.col("uid").alias("work_uid")), "work_uid", "left_semi").join(recorded.select(F.col("uid").alias("change_uid")), "change_uid", "left_semi")
    return known.select("work_uid", "change_uid").distinct().withColumns({"confidence": F.lit(confidence), "reason": F.lit(reason).cast("string")})


def item(items: DataFrame, uid) -> DataFrame:
    """The one item with a uid; an error if there is none."""
    found = items.where(F.col("uid") == uid)
    if found.isEmpty():
        raise KeyError(f"no work item {uid}")
    return found


def enqueue(items: DataFrame, action, as_of) -> DataFrame:
    """Queue rows for items: uid, action, priority, status pending, as the queue's next state of each."""
    return items.select("uid", action.alias("action"), "priority", F.lit("pending").alias("status"), F.lit(0).alias("retry_count"), as_of.alias("at"))


def settled(states: DataFrame) -> DataFrame:
    """The queue's last state of each uid; of equal times a completed one counts."""
    from .common import latest

    ranked = states.withColumn("_done", (F.col("status") == "completed").cast("int"))
    return latest(ranked, ["uid"], ["at", "_done"]).drop("_done")


def file_paths(links: DataFrame, most: int = 100) -> DataFrame:
    """work_uid, place, file_path: the first distinct paths of each item in order, `most` of them."""
    from pyspark.sql import Window

    each = links.select("work_uid", "file_path").distinct()
    return each.withColumn("place", F.row_number().over(Window.partitionBy("work_uid").orderBy("file_path"))).where(F.col("place") <= most)


def create_conversations(rows: DataFrame, as_of: str) -> DataFrame:
    """Conversations (token, project) as rows to append: conv_id made of both, so asking twice makes one."""
    conv = F.substring(F.sha2(F.concat_ws("::", "project", "token"), 256), 1, 16)
    return rows.select(conv.alias("conv_id"), "project", F.lit(as_of).cast("timestamp_ntz").alias("created_at")).distinct()


def add_queries(asked: DataFrame, evidence: DataFrame, most: int = 10) -> DataFrame:
    """conv_id, turn, node, place: the links of each query (conv_id, turn) to its first evidence (conv_id, turn, rank, node)."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("rank", "node"))
    found = evidence.join(asked.select("conv_id", "turn").distinct(), ["conv_id", "turn"], "left_semi")
    return found.withColumn("place", place).where(F.col("place") <= most).select("conv_id", "turn", "node", "place")


def history(turns: DataFrame, links: DataFrame, last: int = 5) -> DataFrame:
    """conv_id, turn, text, evidence: the last user queries of each conversation, with how many nodes each rests on (0 if none)."""
    from pyspark.sql import Window

    own = turns.where("role = 'user'").withColumn("_n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("_n") <= last)
    n = links.groupBy("conv_id", "turn").agg(F.countDistinct("node").alias("evidence"))
    return own.join(n, ["conv_id", "turn"], "left").select("conv_id", "turn", "text", F.coalesce("evidence", F.lit(0)).cast("long").alias("evidence"))


def continued(turns: DataFrame, most: int = 3) -> DataFrame:
    """conv_id, round, next, query: what each conversation does next. A query that is clear, or the last round, is
    executed with the answers so far; an unclear one is asked about again."""
    from lodestar.functions.text import clarity

    asked = turns.where("role = 'user'").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("text", "turn").alias("first"), F.max_by("text", "turn").alias("last"))
    round_ = F.least(F.col("n"), F.lit(most))
    ready = (round_ >= most) | (clarity(F.col("last"))["clarity"] == "clear")
    query = F.when(F.col("n") > 1, F.concat_ws(". ", "first", F.concat(F.lit("Focus: "), "last"))).otherwise(F.col("last"))
    return asked.select("conv_id", round_.alias("round"), F.when(ready, "execute").otherwise("questions").alias("next"), query.alias("query"))
