"""Queries: text rules, ids, classification, commits, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import chunking as C
from lodestar.functions import text as X

from .registry import query
from .views import changes, oracle, table, work_items


def _literal(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def _values(rows) -> str:
    q = lambda v: "null" if v is None else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return "(values " + ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in rows) + ")"


def _docs(spark, d):
    return table(spark, d, "documents")


@query("text_hash", oracle("select doc_id, sha256(regexp_replace(text, '\\r\\n?', chr(10), 'g')) as hash from documents"))
def _(spark, d):
    return _docs(spark, d).select("doc_id", X.text_hash(F.col("text")).alias("hash"))


@query("chunk_fixed", oracle("""with n as (select doc_id, source || '/' || doc_id as path, text, length(text) as n from documents where length(text) > 0),
c as (select path, i as chunk_index, i * 1000 as start, substr(text, i * 1000 + 1, 1200) as content from n, unnest(range(0, case when n <= 1200 then 1 else ceil((n - 1200) / 1000.0)::int + 1 end)) as u(i))
select path, chunk_index, start, start + length(content) as "end", substr(sha256(path || ':' || chunk_index || ':' || sha256(content)), 1, 16) as chunk_id, length(content) as chars from c"""))
def _(spark, d):
    return C.fixed(_docs(spark, d).withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string"))), 1200, 200)


@query("chunk_text")
def _(spark, d):
    return C.chunk(_docs(spark, d).withColumn("path", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")))).drop("content")


@query("chunk_changed", oracle("select doc_id from documents where doc_id % 5 = 0"))
def _(spark, d):
    now = _docs(spark, d).select("doc_id", X.text_hash(F.col("text")).alias("hash"))
    old = now.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("hash")).alias("old"))
    return now.join(old, "doc_id").where(~F.col("hash").eqNullSafe(F.col("old"))).select("doc_id")


@query("node_uids", oracle("""select p_partkey, 'api::' || substr(sha256(p_brand || '::' || p_name), 1, 12) as api, p_brand || '::workitem::' || substr(sha256(p_name || '::' || p_type), 1, 16) as item,
p_brand || '::codechanqge::' || p_partkey || '-' || substr(sha256(p_name), 1, 8) as change from part"""))
def _(spark, d):
    p = table(spark, d, "part")
    return p.select(
        "p_partkey", X.node_uid("api", "p_brand", "p_name").alias("api"), X.work_item_uid(F.col("p_brand"), F.col("p_name"), F.col("p_type")).alias("item"),
        X.change_uid(F.col("p_brand"), F.col("p_partkey").cast("string"), F.col("p_name")).alias("change"),
    )


@query("uid_validation", oracle("select p_partkey % 2 = 0 as ok, count(*) as n from part group by 1"))
def _(spark, d):
    p = table(spark, d, "part")
    good = X.work_item_uid(F.col("p_brand"), F.col("p_name"), F.col("p_type"))
    return p.select(X.valid_uid(F.when(F.col("p_partkey") % 2 == 0, good).otherwise(F.concat(F.lit("x"), good, F.lit("::y")))).alias("ok")).groupBy("ok").agg(F.count(F.lit(1)).alias("n"))


@query("query_hash", oracle("""with recursive q as (select distinct p_type as q from part), h(q, i, h) as (select q, 0, 0::bigint from q union all
  select q, i + 1, ((h * 31 + unicode(substr(q, i + 1, 1)) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 from h where i < length(q))
select q, printf('%x', abs(h)) as hash from h where i = length(q)"""))
def _(spark, d):
    return table(spark, d, "part").select(F.col("p_type").alias("q")).distinct().select("q", X.query_hash(F.col("q")).alias("hash"))


QUESTIONS = [
    ("Show me the router module",), ("Where does it start?",), ("Tell me anything about caching",), ("List everything",), ("Say something about all of those things",), ("Show me the scheduler code",),
    ("What depends on the tokenizer",), ("Where is the cache filled",), ("locate the worker",), ("Explain why they crash",), ("",), ("which modules are used by the loader",), ("any of these",),
]
_Q = _values(QUESTIONS)
#: The samples and the distinct questions of the conversations.
_ASKED = f"(select * from {_Q} as s(q) union select distinct text from conversations where role = 'user' and text is not null)"


def _asked(spark, d):
    real = table(spark, d, "conversations").where("role = 'user' and text is not null").select(F.col("text").alias("question"))
    return _literal(spark, QUESTIONS, "question string").unionByName(real).distinct()


def _intent_sql(q: str) -> str:
    return (
        f"case when length({q}) = 0 then 'unknown' when regexp_matches({q}, '\\b(depend on|depends on|calls|imports|used by|connected to?)\\b') then 'relationship' when regexp_matches({q}, '\\b(show me|code|implement|function|class|source)\\b') then 'code' "
        f"when regexp_matches({q}, '\\b(explain|how does|why|what is|describe|overview|documentation)\\b') then 'explanation' when regexp_matches({q}, '\\b(where|find|locate|which file)\\b') then 'location' else 'both' end"
    )


@query("query_intent", oracle(f"select q as question, {_intent_sql('lower(trim(q))')} as intent from {_Q} as t(q) union all select text, {_intent_sql('lower(trim(text))')} from (select distinct text from conversations where role = 'user')"))
def _(spark, d):
    asked = table(spark, d, "conversations").where("role = 'user'").select(F.col("text").alias("question")).distinct()
    return _literal(spark, QUESTIONS, "question string").unionByName(asked).select("question", X.intent(F.col("question")).alias("intent"))


_WORDS = "(values " + ", ".join(f"({i}, '{w}')" for i, w in enumerate((*X.PRONOUNS, *X.VAGUE, *X.BROAD))) + ")"
_CLEAR = " or ".join(f"lower(trim(q)) like '{s}%'" for s in X.CLEAR_STARTS)


@query("query_clarity", oracle(f"""with q as (select q from {_ASKED} as t(q)), a as (select q, count(w) as n, coalesce(string_agg(w, ',' order by i), '') as words from q left join {_WORDS} as v(i, w) on regexp_matches(lower(trim(q)), '\\b' || w || '\\b') group by q)
select q as question, words, case when q = '' then 'requires_context' when n = 0 then 'clear' when n <= 2 then 'ambiguous' else 'requires_context' end as clarity,
case when q = '' then 0.1 when n = 0 then case when {_CLEAR} then 0.9 else 0.8 end when n <= 2 then case when {_CLEAR} then 0.7 else 0.6 end else 0.3 end::double as confidence,
case when n = 0 and q <> '' then 'one-shot' else 'conversational' end as mode from a"""))
def _(spark, d):
    return _asked(spark, d).select("question", F.array_join(X.ambiguity(F.col("question")), ",").alias("words"), X.clarity(F.col("question")).alias("c")).select("question", "words", "c.*")


@query("clarification_questions", oracle(f"""select q as question, len(string_split(trim(concat_ws('|', case when {' or '.join(f"' ' || lower(q) || ' ' like '% {w} %'" for w in X.PRONOUNS)} then 'p' end, case when {' or '.join(f"' ' || lower(q) || ' ' like '% {w} %'" for w in X.VAGUE)} then 'v' end,
case when {' or '.join(f"' ' || lower(q) || ' ' like '% {w} %'" for w in X.BROAD)} then 'b' end)), '|')) - case when {' or '.join(f"' ' || lower(q) || ' ' like '% {w} %'" for w in (*X.PRONOUNS, *X.VAGUE, *X.BROAD))} then 0 else 1 end as n from {_ASKED} as t(q)"""))
def _(spark, d):
    return _asked(spark, d).select("question", F.size(X.clarifications(F.col("question"), F.lit(1))).cast("long").alias("n"))


COMMITS = [
    ("feat: let users export their boards",), ("fix(cache): keep pinned rows",), ("feat!: drop the old wire format",), ("Reworded the guide",), ("perf(index)!: faster merges #12\n\nCloses #7 and fixes #9\n\nRefs #12",),
    ("docs: describe the urgent hotfix",), ("revert: undo #3",), ("chore: minor cleanup",), ("Merge branch x",), ("wip: half done: later",), ("fix(): no scope",), ("Test(unit): Hotfix #4, resolved  #5",),
]
_C = "(values " + ", ".join("('" + m.replace("'", "''").replace("\n", "' || chr(10) || '") + "')" for (m,) in COMMITS) + ")"
#: The samples and a message for each order.
_SAID = f"""(select m from {_C} as s(m) union all select case o_orderkey % 4 when 0 then 'feat(c' || o_custkey || '): add ' || o_orderkey when 1 then 'fix!: stop' || chr(10) || chr(10) || 'closes #' || o_orderkey
when 2 then 'docs(a)(b): minor ' || o_orderkey else 'Order ' || o_orderkey || ' fixes #' || (o_orderkey + 1) end from orders)"""


def _said(spark, d):
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    kind = F.col("o_orderkey") % 4
    message = (
        F.when(kind == 0, F.concat(F.lit("feat(c"), c, F.lit("): add "), k)).when(kind == 1, F.concat(F.lit("fix!: stop\n\ncloses #"), k)).when(kind == 2, F.concat(F.lit("docs(a)(b): minor "), k))
        .otherwise(F.concat(F.lit("Order "), k, F.lit(" fixes #"), (F.col("o_orderkey") + 1).cast("string")))
    )
    return _literal(spark, COMMITS, "message string").unionByName(table(spark, d, "orders").select(message.alias("message")))


_TYPES = " ".join(f"when '{k}' then '{v}'" for k, v in X.COMMIT_TYPES.items())


@query("commit_parse", oracle(f"""with m as (select m, trim(string_split(m, chr(10) || chr(10))[1]) as h from {_SAID} as t(m)),
a as (select m, h, strpos(h, ':') as c, string_split(h, ':')[1] as head, trim(h[strpos(h, ':') + 1:]) as rest from m),
b as (select *, suffix(head, '!') as bang, case when suffix(head, '!') then head[:-2] else head end as name from a),
e as (select *, case when suffix(name, ')') and strpos(name, '(') > 0 then name[strpos(name, '(') + 1:-2] end as scope, lower(case when suffix(name, ')') then string_split(name, '(')[1] else name end) as k from b),
p as (select *, c > 0 and rest <> '' and coalesce(scope <> '' and not contains(scope, ')'), true) and k in ({", ".join(f"'{k}'" for k in X.COMMIT_TYPES)}) as known from e)
select m as message, case when known then k end as type, case when known then scope end as scope, known and bang as breaking, case when known then rest else h end as description,
case when known then case k {_TYPES} end else 'chore' end as work_type, array_to_string(list_sort(list_distinct(regexp_extract_all(m, '(#\\d+)', 1))), ',') as refs from p"""))
def _(spark, d):
    return _said(spark, d).select("message", X.commit(F.col("message")).alias("c")).select("message", "c.type", "c.scope", "c.breaking", "c.description", "c.work_type", F.array_join("c.refs", ",").alias("refs"))


@query("infer_priority", oracle(f"""select m as message, case when regexp_matches(lower(m), 'critical|urgent|hotfix|emergency') then 'critical' when regexp_matches(lower(m), 'high|important|major|bug|fix|error|fail') then 'high'
when regexp_matches(lower(m), 'medium|feature|enhancement|improve') then 'medium' when regexp_matches(lower(m), 'low|minor|cleanup|refactor|style|docs') then 'low' else 'medium' end as priority from {_SAID} as t(m)"""))
def _(spark, d):
    return _said(spark, d).select("message", X.priority(F.col("message")).alias("priority"))


_ENDS = " or ".join(f"suffix(w[i], '{x}')" for x in X.CLOSING)


@query("issue_refs", oracle(f"""with t as (select m, regexp_split_to_array(lower(m), '\\s+') as w from {_SAID} as t(m)), r as (select m, regexp_extract(w[i + 1], '^#(\\d+)', 1)::int as ref from t, unnest(range(1, len(w))) as u(i) where regexp_matches(w[i + 1], '^#\\d') and ({_ENDS}))
select m as message, ref, title, status from r join work_items on uid = ref""", "work_items"))
def _(spark, d):
    refs = _said(spark, d).select("message", F.explode(X.closing_refs(F.col("message"))).alias("ref"))
    return refs.join(work_items(spark, d), F.col("ref") == F.col("uid")).select("message", "ref", "title", "status")


@query("work_refs", oracle("select uid, array_to_string(regexp_extract_all('done WORK-' || uid || ' see #' || (uid % 10), '((?:WORK-|#)\\d+)', 1), ',') as refs from work_items", "work_items"))
def _(spark, d):
    m = F.concat(F.lit("done WORK-"), F.col("uid").cast("string"), F.lit(" see #"), (F.col("uid") % 10).cast("string"))
    return work_items(spark, d).select("uid", F.array_join(X.work_refs(m), ",").alias("refs"))


LABELS = {"bug": "bug", "enhancement": "enhancement", "feature": "feature", "documentation": "docs"}


@query("label_types", oracle("""select uid, case when uid % 3 = 0 then 'bug' when uid % 3 = 1 then 'feature' else 'task' end as work_type from work_items""", "work_items"))
def _(spark, d):
    labels = F.array(F.lit("other"), F.when(F.col("uid") % 3 == 0, "Bug").when(F.col("uid") % 3 == 1, "Feature").otherwise("none"), F.lit("misc"))
    return work_items(spark, d).select("uid", X.from_labels(labels, LABELS, "task").alias("work_type"))


def _pick(literals, key: str):
    """One of the literals by key."""
    return F.element_at(F.array(*[F.lit(x) for x in literals]), (F.col(key) % len(literals) + 1).cast("int"))


def _pick_sql(literals, key: str) -> str:
    quoted = ", ".join("'" + x.replace("'", "''") + "'" for x in literals)
    return f"([{quoted}])[{key} % {len(literals)} + 1]"


@query("keyword_matches", oracle("""with p as (select p_partkey, 'fix(' || p_brand || '): ' || p_name || case when p_partkey % 3 = 0 then ' with ' || p_type else '' end as m, p_name as t, 'Make it ' || p_type || ' from now' as x from part)
select p_partkey as uid, array_to_string(list_slice(list_sort(list_filter(list_distinct(regexp_split_to_array(lower(t || ' ' || x), '\\s+')), lambda z: length(z) > 3 and z not in ('with', 'from', 'that', 'this', 'will', 'should') and contains(lower(m), z))), 1, 5), ',') as words from p"""))
def _(spark, d):
    more = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" with "), "p_type")).otherwise("")
    message = F.concat(F.lit("fix("), "p_brand", F.lit("): "), "p_name", more)
    words = X.keyword_matches(message, F.col("p_name"), F.concat(F.lit("Make it "), "p_type", F.lit(" from now")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("uid"), F.array_join(words, ",").alias("words"))


_ANSWER = """(select conv_id, turn, case turn % 3 when 0 then 'See [Source: src/m' || conv_id || '.py:' || turn || '-' || (turn + 9) || '] and [Graph: a -> b]. ' when 1 then 'Only [Source: docs/c' || conv_id || '.md] here. ' else '' end || coalesce(text, '')
|| case when conv_id % 2 = 0 then chr(10) || '- m' || conv_id || '.login -> db.t' || turn || ' (CALLS)' || chr(10) || '- a -> b (DEFINES)' else '' end as a from conversations)"""


def _answers(spark, d):
    """The turns of conversations as answers that cite files and edges."""
    c, t = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    cited = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("See [Source: src/m"), c, F.lit(".py:"), t, F.lit("-"), (F.col("turn") + 9).cast("string"), F.lit("] and [Graph: a -> b]. "))).when(F.col("turn") % 3 == 1, F.concat(F.lit("Only [Source: docs/c"), c, F.lit(".md] here. "))).otherwise("")
    edges = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("\n- m"), c, F.lit(".login -> db.t"), t, F.lit(" (CALLS)\n- a -> b (DEFINES)"))).otherwise("")
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(cited, F.coalesce("text", F.lit("")), edges).alias("answer"))


@query("citations", oracle(f"""with c as (select conv_id, turn, unnest(regexp_extract_all(a, '\\[Source: ([^\\]]+)\\]', 1)) as c from {_ANSWER})
select conv_id, turn, regexp_extract(c, '^([^:]+)', 1) as path, try_cast(nullif(regexp_extract(c, ':(\\d+)', 1), '') as int) as start, try_cast(nullif(regexp_extract(c, '-(\\d+)$', 1), '') as int) as "end" from c"""))
def _(spark, d):
    return _answers(spark, d).select("conv_id", "turn", F.explode(X.citations(F.col("answer"))).alias("c")).select("conv_id", "turn", "c.*")


@query("evidence_lines", oracle(f"""with c as (select conv_id, turn, unnest(regexp_extract_all(a, '(?m)^- (\\S+ -> \\S+ \\([^)]*\\))', 1)) as c from {_ANSWER}) select conv_id, turn, regexp_extract(c, '^(\\S+)', 1) as src, regexp_extract(c, '-> (\\S+)', 1) as dst, regexp_extract(c, '\\(([^)]*)\\)', 1) as type from c"""))
def _(spark, d):
    return _answers(spark, d).select("conv_id", "turn", F.explode(X.evidence_lines(F.col("answer"))).alias("c")).select("conv_id", "turn", "c.*")


@query("fault_types", oracle("select type, count(*) as n from (select case event_type when 'error' then 'STALE_DOC' when 'view' then 'ORPHANED_NODE' else 'UNKNOWN' end as type from events) group by type"))
def _(spark, d):
    m = F.when(F.col("event_type") == "error", "STALE_DOC: old").when(F.col("event_type") == "view", "ORPHANED_NODE: alone").otherwise("no type here")
    return table(spark, d, "events").groupBy(X.fault_type(m).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("display_utils", oracle("""with p as (select distinct file_path as f, commit_hash as h, lines_added::int as s from changes)
select f, h, s, case when length(h) <= 8 then h else left(h, 4) || '...' || right(h, 4) end as short_hash, case when length('a/very/long/directory/name/' || f) <= 30 then 'a/very/long/directory/name/' || f else 'a/.../' || f end as short_path,
case when s % 2 = 0 then ':' || s else ':' || s || '-' || (s + 3) end as lines, case when length(f) > 6 then left(f, 6) || '...' else f end as short_text from p""", "changes"))
def _(spark, d):
    p = changes(spark, d).select(F.col("file_path").alias("f"), F.col("commit_hash").alias("h"), F.col("lines_added").cast("int").alias("s")).distinct()
    return p.select(
        "f", "h", "s", X.short_hash(F.col("h"), 8).alias("short_hash"), X.short_path(F.concat(F.lit("a/very/long/directory/name/"), "f"), 30).alias("short_path"),
        X.line_range(F.col("s"), F.when(F.col("s") % 2 != 0, F.col("s") + 3)).alias("lines"), X.shortened(F.col("f"), 6).alias("short_text"),
    )


NAMES = ["main.py", "README.md", "config.yaml", "data.csv", "Dockerfile", "logo.png", "notes", "a.TF", "x.proto", "setup.py", "index.html", ".gitignore", "lib.so", "ARCH.md", "PRD.txt"]
_NAMED = f"(select p_partkey, case when p_partkey % 2 = 0 then '' else 'm' || p_partkey || '_' end || {_pick_sql(NAMES, 'p_partkey')} as n from part)"


def _names(spark, d):
    """File names made of parts: known names as they are, and with a prefix that leaves their extension alone."""
    prefix = F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit("_")))
    return table(spark, d, "part").select("p_partkey", F.concat(prefix, _pick(NAMES, "p_partkey")).alias("name"))


_EXT = "lower(regexp_extract(n, '.(\\.[^./]+)$', 1))"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query("file_categories", oracle(f"""select p_partkey, n as name, case {' '.join(f"when n in {_in(v)} then '{k}'" for k, v in X.FILE_NAMES.items())} when {_EXT} in {_in(X.BINARY)} then 'Binary' {' '.join(f"when {_EXT} in {_in(v)} then '{k}'" for k, v in X.EXTENSIONS.items())} else 'Unknown' end as category from {_NAMED}"""))
def _(spark, d):
    return _names(spark, d).select("p_partkey", "name", X.file_category(F.col("name")).alias("category"))


@query("asset_classes", oracle(f"""select p_partkey, n as name, case when {_EXT} in ('.py','.js','.jsx','.ts','.tsx','.go','.java','.cpp','.h','.rs') then 'Code' when n in ('Dockerfile','docker-compose.yml','Makefile') or {_EXT} in ('.tf','.env','.toml') then 'Infrastructure'
when {_EXT} in ('.md','.txt','.rst') then 'Documentation' when {_EXT} in ('.json','.yaml','.yml','.xml','.ini') then 'Config' else 'Data' end as class,
case when n like '%.md' then 'MARKDOWN' when regexp_matches(n, '\\.(ts|js|tsx|jsx|py|go|rs)$') then 'CODE' else 'DOCUMENT' end as node_type,
case when upper(n) like '%ARCH%' then 'ARCHITECTURE' when upper(n) like '%PRD%' then 'PRD' when upper(n) like '%SPEC%' then 'SPEC' when upper(n) like '%TODO%' then 'TODO' else 'DOC' end as doc_type from {_NAMED}"""))
def _(spark, d):
    n = F.col("name")
    return _names(spark, d).select("p_partkey", "name", X.asset_class(n).alias("class"), X.node_type(n).alias("node_type"), X.doc_type(n).alias("doc_type"))


@query("html_extract", oracle(r"""with m as (select page_id, html, regexp_extract(html, '(?is)<main[^>]*>(.*?)</main>', 1) as m from pages), a as (select page_id, html, case when m <> '' then m else html end as x from m),
b as (select page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?is)<nav[^>]*>.*?</nav>', '', 'g'), '(?is)<header[^>]*>.*?</header>', '', 'g'), '(?is)<footer[^>]*>.*?</footer>', '', 'g') as x from a),
c as (select page_id, html, regexp_replace(regexp_replace(regexp_replace(x, '(?i)<(?:div|p|br|h[1-6]|li|ul|ol|section|article)[^>]*>', chr(10) || chr(10), 'g'), '<[^>]+>', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') as x from b)
select page_id, regexp_extract(html, '(?i)<title>(.*?)</title>', 1) as title, sha256(regexp_replace(x, '^\s+|\s+$', '', 'g')) as text_hash from c"""))
def _(spark, d):
    return table(spark, d, "pages").select("page_id", X.page_title(F.col("html")).alias("title"), F.sha2(X.page_text(F.col("html")), 256).alias("text_hash"))


ERRORS = ["Request timeout after 5s", "connect ECONNREFUSED 127.0.0.1", "model llama not found", "boom", "unknown model"]


@query("failure_triggers", oracle(f"""select event_id, case when regexp_matches(e, 'timeout|ETIMEDOUT|ESOCKETTIMEDOUT') then 'timeout' when regexp_matches(e, 'ECONNREFUSED|ENOTFOUND|connect|Network error') then 'container_down'
when e like '%model%' and regexp_matches(e, 'not found|does not exist|unknown') then 'model_not_found' else 'retry_exceeded' end as trigger from (select event_id, event_type || ': ' || {_pick_sql(ERRORS, 'event_id')} as e from events)"""))
def _(spark, d):
    return table(spark, d, "events").select("event_id", X.trigger(F.concat("event_type", F.lit(": "), _pick(ERRORS, "event_id"))).alias("trigger"))


UNITS = ["h", "d", "", "x"]


@query("window_parse", oracle("select p_partkey, w as \"window\", case when regexp_matches(w, '^\\d+d$') then regexp_extract(w, '^(\\d+)', 1)::int * 24 when regexp_matches(w, '^\\d+h$') then regexp_extract(w, '^(\\d+)', 1)::int end as hours from (select p_partkey, p_size || " + _pick_sql(UNITS, "p_partkey") + " as w from part)"))
def _(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), _pick(UNITS, "p_partkey")).alias("window"))
    return rows.select("p_partkey", "window", X.hours(F.col("window")).alias("hours"))


@query("provenance_validate", oracle("""select doc_id, concat_ws(',', case when doc_id % 3 = 0 then 'file hash' end, case when doc_id % 4 = 0 then 'text hash' end, case when doc_id % 10 - 2 < 0 then 'start' end, case when doc_id % 5 - 1 < doc_id % 10 - 2 then 'end' end) as errors from documents"""))
def _(spark, d):
    i = F.col("doc_id")
    file_hash = F.when(i % 3 == 0, "x").otherwise(F.sha1("text"))
    full = F.when(i % 4 == 0, "y").otherwise(F.sha2("text", 256))
    return _docs(spark, d).select("doc_id", F.array_join(X.provenance_errors(file_hash, full, i % 10 - 2, i % 5 - 1), ",").alias("errors"))


PROJECTS = ["My-Project", "bad name", "a..b", "", "x" * 70, "ok_1"]


@query("project_names", oracle(f"""select c_custkey, concat_ws(',', case when lower(trim(p)) = '' then 'empty' end, case when length(trim(p)) > 64 then 'too long' end, case when lower(trim(p)) <> '' and not regexp_matches(lower(trim(p)), '^[a-z0-9][a-z0-9._-]*$') then 'bad characters' end, case when p like '%..%' then 'dots' end) as errors from (select c_custkey, {_pick_sql(PROJECTS, 'c_custkey')} || case when c_custkey % 4 = 0 then c_name else '' end as p from customer)"""))
def _(spark, d):
    name = F.concat(_pick(PROJECTS, "c_custkey"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_name")).otherwise(""))
    return table(spark, d, "customer").select("c_custkey", F.array_join(X.project_errors(name), ",").alias("errors"))


@query("point_ids", oracle("""with h as (select doc_id, sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || ('doc:' || doc_id)::blob) as h from documents)
select doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as point_id from h"""))
def _(spark, d):
    return _docs(spark, d).select("doc_id", X.point_id(F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("point_id"))


#: A published HMAC-SHA256 value: of this text with the key "key".
_SIGNED = ("The quick brown fox jumps over the lazy dog", "sha256=f7bc83f430538424b13298e6aa6fb143ef4d59a14946175997479dbc2d1a3cd8")


@query("webhook_signatures", oracle("select event_id, event_id % 3 = 0 as ok from events"))
def _(spark, d):
    """Every third event is signed well; of the others the text or the signature is another."""
    k = F.col("event_id") % 3
    payload = F.when(k == 1, F.col("props")).otherwise(_SIGNED[0])
    return table(spark, d, "events").select("event_id", X.signature_ok(payload, F.when(k == 2, F.lit("sha256=0")).otherwise(_SIGNED[1]), F.lit("key")).alias("ok"))


@query("packet_hashes", oracle("select event_id, sha256('{\"k\":' || regexp_extract(props, '\\d+') || '}') as hash from events"))
def _(spark, d):
    return table(spark, d, "events").select("event_id", X.packet_hash(F.col("props")).alias("hash"))


@query("json_props", oracle("select (props->>'$.k')::bigint as k, count(*) as n from events group by 1"))
def _(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))
