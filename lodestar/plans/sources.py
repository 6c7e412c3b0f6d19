"""Queries: sources over files, code, logs and payloads. Their inputs are written from literals to the shared folder first."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from lodestar.operators.graph import cut, shared_folder
from lodestar.sources import code, feeds, files

from .registry import query
from .views import oracle, spread, table, values

MAIN = '''"""Entry."""
from .utils import helper
import config

# TODO: split this up
VERSION = "1.0"


class Application:
    """Runs it."""

    def __init__(self, name: str) -> None:
        self.name = name

    def run(self):
        return process(self.name)

    async def status(self):
        pass


def process(data):
    try:
        return helper(data)
    except:
        pass


@app.get("/items/{id}")
def read_item(id: int) -> dict:
    """TODO: describe"""
    raise NotImplementedError
'''
FILES = [
    ("src/main.py", MAIN),
    ("src/utils.py", "def helper(x):\n    return x  # FIXME: slow\n\n\ndef total(xs):\n    return sum(xs)\n"),
    ("src/app.ts", "export class Box {\n}\n// opens it\nexport function open(a) {\n  console.log(a)\n}\nconst shut = (b) => { try { b() } catch (e) {\n  // nothing\n} }\nconst later = () => {\n}\nfunction soon() {\n  throw new Error('not implemented yet')\n}\n"),
    ("src/svc.go", "type Server struct {\n}\nfunc (s *Server) Start() error {\n\treturn nil\n}\n"),
    ("api/users.proto", "message User {\n}\nservice Users {\n  rpc Get (User) returns (User);\n}\n"),
    ("api/admin.yaml", "openapi: 3.0.0\npaths:\n  /jobs:\n    get:\n      summary: List jobs\n      parameters:\n        - name: q\n          in: query\n    delete:  # all\n      operationId: clear\n  '/jobs/{id}':\n    put:\n      tags: [x]\ncomponents:\n  get: {}\n"),
    ("api/openapi.json", json.dumps({"paths": {"/users": {"get": {"summary": "List users"}, "post": {"operationId": "create"}}}})),
]


#: What the sources must give for FILES, read off the files by hand: columns and rows. A line with docstring quotes
#: opens or closes a docstring, one that has both too, so what follows it counts as inside until the next such line.
EXPECTED = {
    "python_symbols": (
        "path, uid, label, name, parent, start_line, end_line, is_async, docstring, signature",
        [
            ('src/main.py', 'src/main.py.Application', 'Class', 'Application', 'src/main.py', 9, 19, False, 'Runs it.', 'class Application()'),
            ('src/main.py', 'src/main.py.Application.__init__', 'Function', '__init__', 'src/main.py.Application', 12, 13, False, None, '__init__(self, name: str) -> None'),
            ('src/main.py', 'src/main.py.Application.run', 'Function', 'run', 'src/main.py.Application', 15, 16, False, None, 'run(self)'),
            ('src/main.py', 'src/main.py.Application.status', 'Function', 'status', 'src/main.py.Application', 18, 19, True, None, 'status(self)'),
            ('src/main.py', 'src/main.py.process', 'Function', 'process', 'src/main.py', 22, 26, False, None, 'process(data)'),
            ('src/main.py', 'src/main.py.read_item', 'Function', 'read_item', 'src/main.py', 30, 32, False, 'TODO: describe', 'read_item(id: int) -> dict'),
            ('src/utils.py', 'src/utils.py.helper', 'Function', 'helper', 'src/utils.py', 1, 2, False, None, 'helper(x)'),
            ('src/utils.py', 'src/utils.py.total', 'Function', 'total', 'src/utils.py', 5, 6, False, None, 'total(xs)'),
        ],
    ),
    "python_edges": (
        "path, src, target, type",
        [
            ('src/main.py', 'src/main.py', '.utils', 'DEPENDS_ON'),
            ('src/main.py', 'src/main.py', 'config', 'DEPENDS_ON'),
            ('src/main.py', 'src/main.py', 'src/main.py.Application', 'DEFINES'),
            ('src/main.py', 'src/main.py.Application', 'src/main.py.Application.__init__', 'DEFINES'),
            ('src/main.py', 'src/main.py.Application', 'src/main.py.Application.run', 'DEFINES'),
            ('src/main.py', 'src/main.py.Application.run', 'process', 'CALLS'),
            ('src/main.py', 'src/main.py.Application', 'src/main.py.Application.status', 'DEFINES'),
            ('src/main.py', 'src/main.py', 'src/main.py.process', 'DEFINES'),
            ('src/main.py', 'src/main.py.process', 'helper', 'CALLS'),
            ('src/main.py', 'src/main.py', 'src/main.py.read_item', 'DEFINES'),
            ('src/main.py', 'src/main.py.read_item', 'get', 'CALLS'),
            ('src/utils.py', 'src/utils.py', 'src/utils.py.helper', 'DEFINES'),
            ('src/utils.py', 'src/utils.py', 'src/utils.py.total', 'DEFINES'),
            ('src/utils.py', 'src/utils.py.total', 'sum', 'CALLS'),
        ],
    ),
    "pattern_symbols": (
        "path, label, name, line",
        [
            ('src/main.py', 'Class', 'Application', 9),
            ('src/main.py', 'Function', '__init__', 12),
            ('src/main.py', 'Function', 'run', 15),
            ('src/main.py', 'Function', 'status', 18),
            ('src/main.py', 'Function', 'process', 22),
            ('src/main.py', 'Function', 'read_item', 30),
            ('src/utils.py', 'Function', 'helper', 1),
            ('src/utils.py', 'Function', 'total', 5),
            ('src/app.ts', 'Class', 'Box', 1),
            ('src/app.ts', 'Function', 'open', 4),
            ('src/app.ts', 'Function', 'shut', 7),
            ('src/app.ts', 'Function', 'later', 10),
            ('src/app.ts', 'Function', 'soon', 12),
            ('src/svc.go', 'Class', 'Server', 1),
            ('src/svc.go', 'Function', 'Start', 3),
        ],
    ),
    "comments_above": (
        "path, line, text, comment",
        [
            ('src/app.ts', 4, 'export function open(a) {', 'opens it'),
            ('src/app.ts', 9, '} }', 'nothing'),
            ('src/main.py', 6, 'VERSION = "1.0"', 'TODO: split this up'),
        ],
    ),
    "todo_scan_code": (
        "path, line, type, message, confidence",
        [
            ('src/main.py', 5, 'TODO', 'split this up', 'MEDIUM'),
            ('src/utils.py', 2, 'FIXME', 'slow', 'HIGH'),
        ],
    ),
    "api_taxonomy": (
        "path, kind, name",
        [
            ('api/admin.yaml', 'endpoint', 'DELETE /jobs'),
            ('api/admin.yaml', 'endpoint', 'GET /jobs'),
            ('api/openapi.json', 'endpoint', 'GET /users'),
            ('api/openapi.json', 'endpoint', 'POST /users'),
            ('api/admin.yaml', 'endpoint', 'PUT /jobs/{id}'),
            ('api/users.proto', 'message', 'User'),
            ('src/main.py', 'route', 'GET /items/{id}'),
            ('api/users.proto', 'rpc', 'Get'),
            ('api/users.proto', 'service', 'Users'),
        ],
    ),
    "code_issues": (
        "path, line, type, message, confidence",
        [
            ('src/app.ts', 5, 'ERROR_PATTERN', 'console.log', 'MEDIUM'),
            ('src/app.ts', 7, 'ERROR_PATTERN', 'empty catch', 'MEDIUM'),
            ('src/app.ts', 1, 'INCOMPLETE', 'class Box is empty', 'MEDIUM'),
            ('src/app.ts', 10, 'INCOMPLETE', 'later is empty', 'HIGH'),
            ('src/app.ts', 13, 'INCOMPLETE', 'not implemented', 'HIGH'),
            ('src/main.py', 18, 'INCOMPLETE', 'status is empty', 'HIGH'),
            ('src/main.py', 25, 'ERROR_PATTERN', 'bare except', 'HIGH'),
            ('src/main.py', 25, 'ERROR_PATTERN', 'empty except', 'HIGH'),
            ('src/main.py', 30, 'INCOMPLETE', 'read_item is not implemented', 'HIGH'),
        ],
    ),
}


#: The same for the files that are made of the tables, a Python file for each part and a .proto file for each supplier.
_GENERATED = {
    "python_symbols": """select p, p || '.C' || k, 'Class', 'C' || k, p, 4, 6, false, null, 'class C' || k || '(Base)' from g union all select p, p || '.C' || k || '.run', 'Function', 'run', p || '.C' || k, 5, 6, false, null, 'run(self)' from g
union all select p, p || '.empty' || k, 'Function', 'empty' || k, p, 9, 10, false, null, 'empty' || k || '()' from g""",
    "python_edges": """select p, p, 'm' || k, 'DEPENDS_ON' from g union all select p, p, p || '.C' || k, 'DEFINES' from g union all select p, p || '.C' || k, 'Base', 'EXTENDS' from g
union all select p, p || '.C' || k, p || '.C' || k || '.run', 'DEFINES' from g union all select p, p || '.C' || k || '.run', 'call' || k, 'CALLS' from g union all select p, p, p || '.empty' || k, 'DEFINES' from g""",
    "pattern_symbols": "select p, 'Class', 'C' || k, 4 from g union all select p, 'Function', 'run', 5 from g union all select p, 'Function', 'empty' || k, 9 from g",
    "comments_above": "select p, 9, 'def empty' || k || '():', 'part ' || k from g",
    "todo_scan_code": "select p, 10, 'TODO', 'fill ' || k, 'HIGH' from g",
    "code_issues": "select p, 9, 'INCOMPLETE', 'empty' || k || ' is empty', 'HIGH' from g",
    "api_taxonomy": "select 'gen/s' || s_suppkey || '.proto', 'message', 'M' || s_suppkey from supplier union all select 'gen/s' || s_suppkey || '.proto', 'service', 'S' || s_suppkey from supplier",
}


def expected(name: str) -> str:
    columns, rows = EXPECTED[name]
    return f"(with g as (select 'gen/p' || p_partkey || '.py' as p, p_partkey as k from part), t({columns}) as (select * from {values(rows)} union all {_GENERATED[name]}) select * from t)"


def _files(spark, d):
    """FILES and the files made of the tables."""
    part = spread(table(spark, d, "part").select("p_partkey")).select(F.col("p_partkey").cast("string").alias("k"))
    text = F.concat(
        F.lit("import m"), "k", F.lit("\n\n\nclass C"), "k", F.lit("(Base):\n    def run(self):\n        return call"), "k", F.lit("(1)\n\n# part "), "k",
        F.lit("\ndef empty"), "k", F.lit("():\n    pass  # TODO: fill "), "k", F.lit("\n"),
    )
    made = part.select(F.concat(F.lit("gen/p"), "k", F.lit(".py")).alias("path"), text.alias("text"))
    api = spread(table(spark, d, "supplier").select("s_suppkey")).select(F.col("s_suppkey").cast("string").alias("k"))
    made = made.unionByName(api.select(F.concat(F.lit("gen/s"), "k", F.lit(".proto")).alias("path"), F.concat(F.lit("message M"), "k", F.lit(" {\n}\nservice S"), "k", F.lit(" {\n}\n")).alias("text")))
    return spark.createDataFrame(FILES, "path string, text string").unionByName(made)


@query("python_symbols", oracle(f"select * from {expected('python_symbols')}"))
def _(spark, d):
    return code.python_symbols(_files(spark, d).where("path like '%.py'"))


@query("python_edges", oracle(f"select * from {expected('python_edges')}"))
def _(spark, d):
    return code.python_edges(_files(spark, d).where("path like '%.py'"))


@query("pattern_symbols", oracle(f"select path || ':' || name || case when label = 'Class' then '' else ':' || line end as uid, path, label, name, line from {expected('pattern_symbols')}"))
def _(spark, d):
    return code.pattern_symbols(_files(spark, d))


@query("comments_above", oracle(f"select * from {expected('comments_above')}"))
def _(spark, d):
    return code.comments_above(_files(spark, d)).where("comment is not null")


_TODO_DOCS = "with l as (select doc_id, u.i as line, string_split(text, chr(10))[u.i] as t from documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) as u(i))"


@query("todo_scan", oracle(f"""{_TODO_DOCS} select 'doc' || doc_id || '.txt' as path, line, 'TODO' as type, 'line ' || line as message, 'HIGH' as confidence from l where line % 3 = 1"""))
def _(spark, d):
    """Every third line of the documents gets a remark; quotes in the text are taken out so that none opens a string."""
    docs = table(spark, d, "documents").where("text is not null")
    marked = F.transform(F.split(F.regexp_replace("text", "[\"'#]", ""), "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("x // TODO: line "), (i + 1).cast("string"))).otherwise(F.regexp_replace(x, "(?i)todo|fixme", "")))
    return code.todos(docs.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.array_join(marked, "\n").alias("text")))


@query("todo_scan_code", oracle(f"select * from {expected('todo_scan_code')}"))
def _(spark, d):
    return code.todos(_files(spark, d))


@query("code_issues", oracle(f"select * from {expected('code_issues')}"))
def _(spark, d):
    return code.issues(_files(spark, d))


@query("issue_summary", oracle(f"select type, confidence, count(*) as n from {expected('code_issues')} group by all"))
def _(spark, d):
    return code.issues(_files(spark, d)).groupBy("type", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query("api_taxonomy", oracle(f"select * from {expected('api_taxonomy')}"))
def _(spark, d):
    return code.taxonomy(_files(spark, d))


def _log(spark, d):
    lines = table(spark, d, "orders").select(F.concat_ws("|", F.concat(F.lit("h"), F.col("o_orderkey").cast("string")), F.col("o_custkey").cast("string"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string"), F.when(F.col("o_orderkey") % 4 == 0, "Merge branch").otherwise("fix: order"), F.lit("a.py,b.py")).alias("value"))
    path = f"{shared_folder(spark)}/lodestar-log-{uuid.uuid4().hex}"
    lines.write.text(path)
    return path


@query("commit_log", oracle("select 'h' || o_orderkey as commit_hash, o_custkey::varchar as author, floor(epoch(o_orderdate))::bigint as ts, case when o_orderkey % 4 = 0 then 'Merge branch' else 'fix: order' end as message, 2 as files from orders"))
def _(spark, d):
    return feeds.commits(spark, _log(spark, d)).select("commit_hash", "author", "ts", "message", F.size("files_changed").alias("files"))


@query("unprocessed_commits", oracle("select 'h' || o_orderkey as commit_hash from orders where o_orderkey % 4 <> 0 and o_orderkey % 3 <> 0"))
def _(spark, d):
    done = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.concat(F.lit("h"), F.col("o_orderkey").cast("string")).alias("commit_hash"))
    return feeds.unprocessed(feeds.commits(spark, _log(spark, d)), done).select("commit_hash")


def _hooks(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, "pull_request").otherwise("issues")
    action = F.when(k % 4 == 0, "opened").when(k % 4 == 1, "closed").when(k % 4 == 2, "labeled").otherwise("reopened")
    item = F.struct(k.cast("int").alias("number"), F.concat(F.lit("Order "), k.cast("string")).alias("title"), F.lit("open").alias("state"), F.array(F.struct(F.lit("bug").alias("name"))).alias("labels"), (k % 2 == 1).alias("merged"))
    body = F.when(k % 3 == 0, F.to_json(F.struct(action.alias("action"), item.alias("pull_request")))).otherwise(F.to_json(F.struct(action.alias("action"), item.alias("issue"))))
    return o.select(kind.alias("type"), body.alias("payload"))


@query("webhook_changes", oracle("""with h as (select o_orderkey as k, case when o_orderkey % 3 = 0 then 'pull_request' else 'issues' end as type, case o_orderkey % 4 when 0 then 'opened' when 1 then 'closed' when 2 then 'labeled' else 'reopened' end as action from orders)
select k as number, type, action, case when action in ('opened', 'reopened') then 'open' when type = 'pull_request' and action = 'closed' and k % 2 = 1 then 'completed' when type = 'issues' and action = 'closed' then 'completed' when action = 'labeled' then 'relabeled' end as change from h"""))
def _(spark, d):
    return feeds.issue_change(feeds.webhook(_hooks(spark, d))).select("number", "type", "action", "change")


@query("sync_actions", oracle("select o_orderkey as uid, case when o_orderkey % 5 = 0 then 'create' when o_orderstatus = 'F' then 'close' else 'update' end as sync from orders"))
def _(spark, d):
    o = table(spark, d, "orders")
    items = o.select(F.col("o_orderkey").alias("uid"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey")).alias("external_id"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("status"))
    return feeds.sync_action(items).select("uid", "sync")


@query("watched_paths", oracle("select p_partkey from part where p_partkey % 2 = 0 and p_partkey % 3 <> 0"))
def _(spark, d):
    k = F.col("p_partkey")
    path = F.concat(F.when(k % 3 == 0, "node_modules/").otherwise("src/"), k.cast("string"), F.when(k % 2 == 0, ".py").otherwise(".bin"))
    return table(spark, d, "part").where(feeds.watched(path, ["*.py", "*.md"], ["node_modules", ".git"])).select("p_partkey")


def _written(spark, files) -> str:
    """The files (path, text) under a new folder of the shared file system, which all executors can read."""
    root = f"{shared_folder(spark)}/lodestar-files-{uuid.uuid4().hex}"
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for path, text in files:
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{root}/{path}"))
        out.write(bytearray(text.encode()))
        out.close()
    return root


@query("file_discovery", oracle("""with t as (select p_size, string_agg(p_name, chr(10) order by p_partkey) || chr(10) as text, count(*) as n from part group by p_size)
select p_size, 'src' as folder, 'Documentation' as category, strlen(text) as size, sha1(text) as sha1, n + 1 as lines, 'text/plain' as mime from t"""))
def _(spark, d):
    """A file of part names for each size, written to three folders and found again in the one that neither the rules nor .gitignore leave out."""
    root = _written(spark, [(".gitignore", "# local\n\nscratch/\n*.tmp\n")])
    lists = table(spark, d, "part").groupBy("p_size").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("p"))
    text = lists.select("p_size", F.array_join("p.p_name", "\n").alias("text"))
    for folder in ("src", "scratch", "venv"):
        text.repartition("p_size").write.partitionBy("p_size").text(f"{root}/{folder}")
    found = files.metadata(files.in_project(spark, root)).where("extension = '.txt'")
    size = F.regexp_extract("path", r"p_size=(\d+)/", 1).cast("int").alias("p_size")
    return cut(found.select(size, F.substring_index("path", "/", 1).alias("folder"), "category", "size", "sha1", "lines", "mime"))


_PLACES = [("docs/ARCH.md", "ARCHITECTURE"), ("docs/guide.md", "DOC"), ("src/app.ts", "code"), ("src/main.py", "code"), ("src/svc.go", "code"), ("scratch/try.py", "code"), ("venv/a.py", None), ("web/node_modules/b.js", None), ("data/x.bin", None)]


@query("code_and_documents", oracle("with t as (select p_partkey, ([" + ", ".join(f"'{p}'" for p, _ in _PLACES) + f"])[p_partkey % {len(_PLACES)} + 1] as f, ([" + ", ".join(f"'{k}'" if k else "null" for _, k in _PLACES) + f"])[p_partkey % {len(_PLACES)} + 1] as kind from part) select 'm' || p_partkey || '/' || f as path, kind from t where kind is not null"))
def _(spark, d):
    """Paths made of parts: code, documents and their kinds, and what lies in folders that are left out."""
    place = F.element_at(F.array(*[F.lit(p) for p, _ in _PLACES]), (F.col("p_partkey") % len(_PLACES) + 1).cast("int"))
    paths = table(spark, d, "part").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit("/"), place).alias("path"))
    return files.documents(paths).withColumnRenamed("doc_type", "kind").unionByName(files.code_files(paths).select("path", F.lit("code").alias("kind")))


@query("hierarchy", oracle("""with p as (select string_split('r' || n_regionkey || '/n' || n_nationkey || '/c' || c_custkey || '/x.py', '/') as s from customer join nation on n_nationkey = c_nationkey)
select distinct 'p:cap:' || s[1] as uid, 'Capability' as label, s[1] as path, null as parent from p union select distinct 'p:feat:' || s[1] || '/' || s[2], 'Feature', s[1] || '/' || s[2], 'p:cap:' || s[1] from p
union select distinct 'p:comp:' || s[1] || '/' || s[2] || '/' || s[3], 'Component', s[1] || '/' || s[2] || '/' || s[3], 'p:feat:' || s[1] || '/' || s[2] from p"""))
def _(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    path = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/n"), F.col("n_nationkey").cast("string"), F.lit("/c"), F.col("c_custkey").cast("string"), F.lit("/x.py"))
    return files.hierarchy(c.select(path.alias("path")), "p")
