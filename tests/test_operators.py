"""Operators on small literal inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestar.functions import chunking
from lodestar.functions import text as X
from lodestar.operators import graph, linking, metrics, packet, rules, search, stateful, store, tracking, trust, windows
from lodestar.sources import feeds

AS_OF = 1706745600.0
DAY = 86400.0


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def results(spark):
    data = [
        ("old", "old", "Document", AS_OF - 100 * DAY, ["old", "fresh_code"]),
        ("new", "new", "Document", AS_OF - 10 * DAY, ["new", "x"]),
        ("fresh_code", "fresh_code", "Code", AS_OF - 5 * DAY, ["fresh_code"]),
        ("undated", "undated", "Document", 0.0, ["undated", "y"]),
    ]
    return spark.createDataFrame(data, "uid string, name string, label string, last_modified double, neighbors array<string>")


def test_trust_checks(results):
    assert [r["uid"] for r in trust.stale(results, AS_OF).collect()] == ["old"]
    assert [r["uid"] for r in trust.orphans(results).collect()] == ["fresh_code"]
    assert [(r["uid"], round(r["detail"])) for r in trust.contradictions(results).collect()] == [("old", 95)]
    assert trust.coverage(results).count() == 1
    one = trust.confidence(trust.faults(results, AS_OF)).first()
    assert (one["faults"], one["confidence"]) == (4, 50.0)


def test_confidence_never_negative(spark):
    found = spark.createDataFrame([("CONTRADICTION", str(i), 1.0) for i in range(9)], "type string, uid string, detail double")
    assert trust.confidence(found).first()["confidence"] == 0.0
    assert trust.confidence(found.limit(0)).first()["confidence"] == 100.0


def test_pagerank_hub_and_single(spark):
    n = spark.createDataFrame([("a",), ("b",), ("c",), ("hub",)], "uid string")
    e = spark.createDataFrame([("a", "hub", "X"), ("b", "hub", "X"), ("c", "hub", "X")], "src string, dst string, type string")
    got = dict(graph.pagerank(n, e).collect())
    assert got["hub"] == 1.0 and got["a"] == got["b"] < 1
    assert got == dict(graph.pagerank(n, e).collect())
    assert dict(graph.pagerank(n.where("uid = 'a'"), e).collect()) == {"a": 1.0}
    assert set(dict(graph.pagerank(n, e.limit(0)).collect()).values()) == {1.0}


def test_bfs_and_descendants_stop_at_cycles(spark):
    e = spark.createDataFrame([("a", "b", "D"), ("b", "c", "D"), ("c", "a", "D"), ("c", "d", "E")], "src string, dst string, type string")
    assert rows(graph.bfs(e, ["a"], 2, directed=True)) == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(graph.bfs(e, ["a"], 1)) == [("a", 0), ("b", 1), ("c", 1)]
    got = graph.descendants(e, spark.createDataFrame([("b",)], "uid string"), ["D"])
    assert rows(got) == [("b", "a"), ("b", "b"), ("b", "c")]


def test_descendants_of_a_deep_chain(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "DEFINES") for i in range(53)], "src string, dst string, type string").coalesce(1)
    root = spark.createDataFrame([("n0",)], "uid string")
    assert {r["uid"] for r in graph.descendants(e, root, ["DEFINES"]).collect()} == {f"n{i}" for i in range(54)}
    assert graph.descendants(e.limit(3), root, ["DEFINES"], longest=3).count() == 4
    with pytest.raises(ValueError, match="more than 2 levels"):
        graph.descendants(e, root, ["DEFINES"], longest=2)


def test_interval_join_first_span_and_bin_borders(spark):
    spans = spark.createDataFrame([("f", 1, 200, 300), ("f", 2, 1, 1000), ("f", 3, 60, 70)], "file string, span_id int, start_line int, end_line int")
    points = spark.createDataFrame([("f", 64), ("f", 250), ("f", 2000), ("g", 1)], "file string, line int")
    got = {(r["file"], r["line"]): r["span_id"] for r in graph.within(points, spans, ["file"]).collect()}
    assert got == {("f", 64): 2, ("f", 250): 2, ("f", 2000): None, ("g", 1): None}


def test_cosine_and_topk_ties(spark):
    n = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0]), ("n", None)], "uid string, embedding array<float>")
    got = [(r["uid"], r["score"]) for r in search.vector_topk(n, [1.0, 0.0], 3).collect()]
    assert got[:2] == [("a", 1.0), ("b", 1.0)] and got[2][0] in ("c", "z")
    assert [r["uid"] for r in search.vector_topk(n, [1.0, 0.0], 9, minimum=0.5).collect()] == ["a", "b"]


def test_bm25_prefers_rare_and_short(spark):
    n = spark.createDataFrame([("a", "rare word"), ("b", "word " * 50), ("c", None), ("d", "other")], "uid string, docstring string")
    got = search.bm25(n, "rare word").collect()
    assert [r["uid"] for r in got] == ["a", "b"] and got[0]["score"] > got[1]["score"] > 0


def test_circuit_breaker(spark):
    e = [("s", float(i), i, ok) for i, ok in enumerate([False, False, True, True])] + [("s", 40.0, 4, True), ("s", 41.0, 5, False), ("s", 42.0, 6, True)]
    df = spark.createDataFrame(e, "service string, t double, seq long, ok boolean")
    got = stateful.circuit_breaker(df, failure=2, success=2, reset=30.0).orderBy("seq").collect()
    assert [r["state"] for r in got] == ["closed", "open", "open", "open", "half_open", "open", "open"]
    assert [r["rejected"] for r in got] == [False, False, True, True, False, False, True]


def test_calls_behind_a_breaker():
    now, made = [0.0], []

    def call(good):
        made.append(good)
        if not good:
            raise ValueError("down")
        return "up"

    guarded = stateful.protected(call, stateful.Breaker(2, 1, 30.0), lambda: now[0])
    assert guarded(True) == "up"
    for _ in range(2):
        with pytest.raises(ValueError):
            guarded(False)
    with pytest.raises(stateful.Rejected):
        guarded(True)
    now[0] = 31.0
    assert guarded(True) == "up" and guarded(True) == "up" and made == [True, False, False, True, True]


def test_cooldown_and_recovery(spark):
    df = spark.createDataFrame([("s", float(t), t) for t in (0, 100, 299, 300, 650)], "service string, t double, seq long")
    assert [r["sent"] for r in stateful.cooldown(df, "service").orderBy("seq").collect()] == [True, False, False, True, True]
    assert [r["allowed"] for r in stateful.recovery_limit(df, "service", 60, 2).orderBy("seq").collect()] == [True, True, False, False, False]


def test_windows(spark):
    df = spark.sql("select * from values ('a', timestamp '2024-01-01 00:00:00', 1, false), ('a', timestamp '2024-01-01 00:05:00', 2, false), ('a', timestamp '2024-01-01 00:06:00', 3, true), ('a', timestamp '2024-01-01 01:00:00', 4, false) as t(service, ts, seq, ok)")
    assert [r["consecutive"] for r in windows.run_lengths(df, ~F.col("ok"), "service").orderBy("seq").collect()] == [1, 2, 0, 1]
    assert windows.firing(df, ~F.col("ok"), "service", 300).count() == 1
    assert sorted(r["events"] for r in windows.sessions(df, "30 minutes", "service").collect()) == [1, 3]


def test_store(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "uid string, v int")
    assert rows(store.upsert(old, spark.createDataFrame([("b", 3), ("b", 5), ("c", 4)], "uid string, v int"), ["uid"])) == [("a", 1), ("b", 5), ("c", 4)]
    known = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    seen = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, hash string")
    assert rows(store.diff(known, seen)) == [("a", "same"), ("b", "changed"), ("c", "deleted"), ("d", "new")]


def test_tracking_audit_and_page(spark):
    items = spark.createDataFrame([("1", "open", "low"), ("2", "open", None)], "uid string, status string, priority string")
    edits = spark.createDataFrame([("1", "closed", None), ("2", "open", "high")], "uid string, status string, priority string")
    assert rows(tracking.audit(items, edits)) == [("1", "status", "open", "closed"), ("2", "priority", None, "high")]
    with pytest.raises(ValueError):
        tracking.page(items, "secret")


def test_metrics_correlation_and_histogram(spark):
    up = [(float(i), f) for i, f in zip((10, 50, 90), ("not_useful", "partial", "useful"), strict=True)]
    df = spark.createDataFrame(up, "confidence double, feedback string")
    assert metrics.correlation(df).first()[0] == pytest.approx(1.0)
    assert metrics.correlation(df.limit(1)).first()[0] == 0.0
    got = {r["le"]: r["count"] for r in metrics.histogram(df, "confidence", [10.0, 60.0]).collect()}
    assert got == {"10.0": 1, "60.0": 2, "+Inf": 3}


def test_chunks(spark):
    with pytest.raises(ValueError):
        chunking.Sizes(0).check()
    with pytest.raises(ValueError):
        chunking.Sizes(100, 100).check()
    text = "\n\n".join("word " * 60 for _ in range(20))
    s = chunking.Sizes(1000, 100, 50, 1500)
    spans = chunking.spans(text, s)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= 1500 for a, b in spans) and all(x[1] > y[0] for x, y in zip(spans, spans[1:], strict=False))
    df = spark.createDataFrame([("a.py", text), ("b.md", ""), ("c.md", None)], "path string, text string")
    assert rows(chunking.chunk(df)) == rows(chunking.chunk(df))
    assert chunking.pack_lines("a\n" * 5, 4) == ["a\na", "a\na", "a"]


def test_commit_and_text_rules(spark):
    df = spark.createDataFrame([("fix(auth)!: x\n\nbody\n\nCloses #2, fixes #10",), ("plain",)], "m string")
    a, b = (r["c"] for r in df.select(X.commit(F.col("m")).alias("c")).collect())
    assert (a["type"], a["scope"], a["breaking"], a["work_type"], a["body"], a["refs"]) == ("fix", "auth", True, "bug", "body", ["#10", "#2"])
    assert (b["type"], b["description"], b["work_type"]) == (None, "plain", "chore")
    ends = spark.createDataFrame([("a\nb",), ("a\r\nb",), ("a\rb",)], "t string").select(X.text_hash(F.col("t")).alias("h")).distinct()
    assert ends.count() == 1


def test_packet_hash_is_stable_and_checked(spark, results):
    hits = results.withColumn("score", F.lit(0.5)).withColumn("path", F.lit("p"))
    one = packet.assemble(hits, "q", "p", "2024")
    assert packet.hashed(one).first()["packet_hash"] == packet.hashed(packet.assemble(hits.orderBy("uid"), "q", "p", "2024")).first()["packet_hash"]
    assert packet.problems(one).first()["problems"] == []
    assert packet.assemble(hits.limit(0)).first()["status"] == "insufficient_evidence"


def test_configuration_precedence():
    got = feeds.configuration({"a": 1, "b": {"c": 2, "d": 3}}, {"b": {"c": 4}}, {"a": None}, env={"LODESTAR_B__D": "5"})
    assert got == {"a": 1, "b": {"c": 4, "d": "5"}}


def test_stream_matches_batch_breaker(spark, tmp_path):
    from lodestar.streaming import operators as R

    data = [(k, float(i), i, ok) for k in ("s", "t") for i, ok in enumerate([True, False, False, False, True, False, False, True, True, True, False, True])]
    df = spark.createDataFrame(data, "service string, t double, seq long, ok boolean")
    for i in range(3):
        df.where(F.floor(F.col("seq") / 4) == i).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = R.run(R.circuit_breaker(stream, "service", 2, 1, 3.0), str(tmp_path / "out"))
    want = stateful.circuit_breaker(df, "service", 2, 1, 3.0)
    assert rows(got.select("service", "seq", "state", "rejected")) == rows(want.select("service", "seq", "state", "rejected"))
    assert {r["state"] for r in want.collect()} == {"closed", "open"} and any(r["rejected"] for r in want.collect())


def test_linking_against_all_pairs(spark):
    from difflib import SequenceMatcher

    items = [("1", "Board export", "Let users export boards as tables", "feature", "high"), ("2", "Cache loses rows", "Pinned rows of the cache go missing", "bug", "critical"), ("3", "Guide cleanup", "Minor work", "docs", "low"), ("4", "Cache loses rows", "Pinned rows of the cache go missing", "bug", "critical")]
    said = [("a", "feat: users export boards as tables"), ("b", "fix(cache): urgent, pinned rows of the cache go missing"), ("c", "chore: nothing alike"), ("d", "Guide"), ("e", None)]
    commits = spark.createDataFrame(said, "commit_hash string, message string")
    work = spark.createDataFrame(items, "uid string, title string, description string, work_type string, priority string")
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    types, priorities = {"a": "feature", "b": "bug", "d": "chore"}, {"a": "medium", "b": "critical", "d": "medium"}
    want = {}
    for c, m in said:
        for uid, title, text, kind, level in items:
            low, t, x = (m or "").lower(), title.lower(), text.lower()
            words = {w.strip(",.") for w in f"{t} {x}".split()}
            shared = {w for w in words if len(w) > 3 and w not in X.STOP and w in {v.strip(",.():") for v in low.replace("(", " ").split()}}
            if shared:
                n = min(5, len({w for w in f"{t} {x}".split() if len(w) > 3 and w not in X.STOP and w in low}))
                score = 0.4 * ratio(low, t) + 0.3 * ratio(low, x) + 0.3 * ratio(low, f"{t} {x}") + 0.2 * (types[c] == kind) + min(0.3, 0.1 * n) + 0.1 * (priorities[c] == level)
                want[c, uid] = round(min(1.0, score), 3)
    got = {(r["commit_hash"], r["uid"]): r["score"] for r in linking.scored(commits, work).collect()}
    assert got == pytest.approx(want) and len(want) >= 4
    assert linking.candidates(commits, work, common=1).count() < len(want)
    best = {r["commit_hash"]: r["uid"] for r in linking.best(linking.scored(commits, work)).collect()}
    assert best == {"a": "1", "b": "2", "d": "3"}
    links = spark.createDataFrame([("d",)], "commit_hash string")
    acts = {r["commit_hash"]: r["action"] for r in linking.auto_link(commits, links, work, dry_run=True).collect()}
    assert acts == {c: "would_link" if max((v for (k, _), v in want.items() if k == c), default=0) >= 0.7 else "none" for c in "abce"} and acts["b"] == "would_link"
    done = {r["commit_hash"]: (r["action"], r["reason"]) for r in linking.outcomes(commits, linking.best(linking.scored(commits, work)), least=2.0).collect()}
    assert done == {"a": ("created_work_item", None), "b": ("created_work_item", None), "c": ("skipped", "non_trackable_type"), "d": ("skipped", "non_conventional_commit"), "e": ("skipped", "non_conventional_commit")}


def test_interval_join_with_null_columns(spark):
    spans = spark.createDataFrame([("f", 1, 1, 10)], "file string, span_id int, start_line int, end_line int")
    points = spark.createDataFrame([("f", 5, None), ("f", 5, "x"), (None, 5, None)], "file string, line int, note string")
    got = {(r["file"], r["note"]): r["span_id"] for r in graph.within(points, spans, ["file"]).collect()}
    assert got == {("f", None): 1, ("f", "x"): 1, (None, None): None}


def test_citations_beyond_the_first_hundred_hits(spark):
    hits = spark.createDataFrame([("a", i, f"src/f{i}.py") for i in range(200)], "answer_id string, rank int, path string")
    asked = spark.createDataFrame([("a", "f150.py"), ("a", "none")], "answer_id string, path string")
    assert rows(rules.cited(asked, hits).select("path", F.coalesce("hit_path", F.lit("-")))) == [("f150.py", "src/f150.py"), ("none", "-")]


def test_budget_without_groups(spark):
    df = spark.createDataFrame([(i, 2) for i in range(50)], "id int, cost int")
    assert [r["id"] for r in metrics.fit_budget(df, "cost", 7, ["id"]).orderBy("id").collect()] == [0, 1, 2]


def test_commit_headers(spark):
    said = ["fix(a(b)): x", "feat:", "feat : x", "fix(a)(b): x", "FEAT(API)!:  spaced  ", "fix: a\nb", None, "nocolon fix(a)", "docs!!: x", ": x"]
    df = spark.createDataFrame([(m,) for m in said], "m string")
    got = [(r["c"]["type"], r["c"]["scope"], r["c"]["breaking"]) for r in df.select(X.commit(F.col("m")).alias("c")).collect()]
    assert got == [(None, None, False), (None, None, False), (None, None, False), (None, None, False), ("feat", "API", True), (None, None, False), (None, None, False), (None, None, False), (None, None, False), (None, None, False)]


def test_fingerprint_is_the_hash_of_the_sorted_lines(spark):
    import hashlib

    data = [(f"p{i}", i * 7 % 50) for i in range(300)]
    df = spark.createDataFrame(data, "path string, v int").repartition(5)
    want = hashlib.sha256("\n".join(sorted(f"{p}:{v}" for p, v in data)).encode()).hexdigest()
    assert store.fingerprint(df, "path", "v").first()["fingerprint"] == want
    assert store.fingerprint(df.limit(0), "path", "v").first()["fingerprint"] == hashlib.sha256(b"").hexdigest()


def test_script_issues_and_yaml_endpoints():
    from lodestar.sources import code

    found = [(x[1], x[3]) for x in code._script_issues("a.ts", "class A extends B {\n}\nfunction f(a) {\n  // later\n}\nconst g = async (x) => {}\nfunction h() { return 1 }\ntry { h() } catch {\n}\nthrow new Error('Not yet implemented: x')\n// console.log(1)\n")]
    assert found == [(1, "class A is empty"), (3, "f is empty"), (6, "g is empty"), (8, "empty catch"), (10, "not implemented")]
    text = "paths:\n  /a:\n    get:\n      operationId: one\n      summary: 'Two'\n    parameters:\n      - name: x\n  /b:\n    post: {}\n    trace:\n      summary: no\nother:\n  /c:\n    get:\n"
    assert code._yaml_endpoints(text) == [("/a", "GET", "Two"), ("/b", "POST", None)]


def test_paths_stay_inside():
    from lodestar.sources import files

    assert files.contained("/r", "a/b") and files.contained("/r", "/r/x/../y") and files.contained("/r", ".")
    assert not files.contained("/r", "../x") and not files.contained("/r", "/rest") and not files.contained("/r", "a/../../x")
    assert files.ignore_patterns(" a/ \n\n# no\n*.tmp\n") == ["a", "*.tmp"]


def test_packet_text_and_audit(spark, results):
    hits = results.withColumn("score", F.lit(0.5)).withColumn("path", F.concat(F.lit("p/"), "uid"))
    one = packet.rendered(packet.assemble(hits, most=3)).first()
    assert one["status"] == "success" and one["text"] == "## Code\n- `p/fresh_code` **fresh_code** 0.500\n\n## Documents\n- `p/new` **new** 0.500\n- `p/old` **old** 0.500"
    assert packet.rendered(packet.assemble(hits.limit(0))).first()["text"].startswith("No evidence")
    entry = packet.audit_entry(packet.assemble(hits), "2024-01-01").first()
    assert entry["logged_at"] == "2024-01-01" and len(entry["packet_hash"]) == 64 and '"ranked"' in entry["packet"]


def test_functions_in_sql(spark):
    from lodestar.functions import registry as functions

    functions.register(spark)
    text = "aaa\nbbb\n\n" + "c" * 9
    got = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string")
    got.createOrReplaceTempView("_texts")
    assert rows(spark.sql("select id, chunk_index, content from _texts, lateral chunk_text(text, 8)")) == [(1, i, x) for i, x in enumerate(chunking.pack_lines(text, 8))]
    assert spark.sql("select seq_ratio('abcd', 'bcde') as r").first()["r"] == pytest.approx(0.75)


def test_tools_check_their_arguments(spark):
    from lodestar import tools

    items = spark.createDataFrame([("1", "p", "T", "open", "low", "bug", "d", "2024-01-01", None), ("2", "q", "U", "open", "low", "bug", "d", "2024-01-02", "tok")], "uid string, project string, title string, status string, priority string, work_type string, description string, created_at string, token string")
    commits = spark.createDataFrame([("p", "c1", "fix: T d", "2024-01-30 00:00:00")], "project string, commit_hash string, message string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    links = spark.createDataFrame([], "work_uid string, commit_hash string, change_uid string, file_path string, ts timestamp_ntz, confidence double")
    files = spark.createDataFrame([("p", "a.py", "def f():\n    pass\n"), ("p", "b.py", "x = 1  # TODO: y\n"), ("q", "c.py", "")], "project string, path string, text string")
    known = spark.createDataFrame([("p", "gone.py", "h")], "project string, path string, hash string")
    nodes = spark.createDataFrame([("n1", "p", "p/a", "A", "Code", "alpha text", 1.0), ("n2", "q", "q/b", "B", "Document", "alpha", 1.0)], "uid string, project string, path string, name string, label string, docstring string, last_modified double")
    edges = spark.createDataFrame([("n1", "n2", "CALLS")], "src string, dst string, type string")
    vectors = spark.createDataFrame([("n1", [1.0, 0.0]), ("n2", [0.0, 1.0])], "uid string, embedding array<double>")
    turns = spark.createDataFrame([("s", "p", 0, "user", "all of it")], "conv_id string, project string, turn long, role string, text string")
    reports = spark.createDataFrame([("q1",)], "query_id string")
    changes = spark.createDataFrame([("ch",)], "uid string")
    box = tools.Toolbox(spark, {"items": items, "commits": commits, "links": links, "files": files, "known": known, "nodes": nodes, "edges": edges, "vectors": vectors, "turns": turns, "reports": reports, "changes": changes}, "2024-02-01 00:00:00", embed=lambda q: [1.0, 0.0])
    for name, given, words in (
        ("query_work_items", {}, "missing project_name"), ("query_work_items", {"project_name": "../x"}, "not valid"), ("query_work_items", {"project_name": "p", "limit": "9"}, "limit is no integer"),
        ("query_work_items", {"project_name": "p", "limit": True}, "limit is no integer"), ("provide_feedback", {"query_id": "q1", "rating": "good"}, "rating must be one of"), ("list_projects", {"x": 1}, "unknown argument x"),
    ):
        with pytest.raises(ValueError, match=words):
            box.call(name, **given)
    with pytest.raises(KeyError, match="no tool"):
        box.call("drop_everything")
    assert len(tools.SCHEMAS) == 22 and all(hasattr(box, f"_{n}") for n in tools.SCHEMAS)
    assert [r["uid"] for r in box.call("query_work_items", project_name="p").collect()] == ["1"]
    answer = box.call("query_codebase", project_name="p", question="alpha").first()
    assert answer["ranked"] == ["n1"] and answer["status"] == "success" and answer["faults"] >= 1
    assert box.call("provide_feedback", query_id="q1", rating="useful").first()["rating"] == "useful"
    for bad in (lambda: box.call("provide_feedback", query_id="zz", rating="useful"), lambda: box.call("update_work_item", work_item_uid="9"), lambda: box.call("link_code_to_work", work_item_uid="9", code_change_uid="ch")):
        with pytest.raises(KeyError):
            bad()
    assert box.call("link_code_to_work", work_item_uid="1", code_change_uid="ch", link_confidence=1).first()["confidence"] == 1.0
    assert box.call("register_project", project_name="New", root_dir="/r").first()["project"] == "new"
    assert {r["path"]: r["status"] for r in box.call("index_project", project_name="p").collect()} == {"a.py": "new", "b.py": "new", "gone.py": "deleted"}
    assert {r["path"]: r["action"] for r in box.call("ingest_files", project_name="p", files=["a.py", "no.py"]).collect()} == {"a.py": "add", "no.py": "error"}
    assert box.call("create_conversation", project_name="p").count() == 1
    assert box.call("continue_conversation", session_id="s", project_name="p", question="Show me the router").first()["next"] == "execute"
    assert box.call("list_conversations", project_name="q").count() == 0
    assert box.call("create_work_item", title="a", description="b", work_type="bug").first()["status"] == "open"
    assert box.call("create_work_item", title="a", description="b", work_type="bug", idempotency_token="tok").count() == 0
    assert len(box.call("record_code_change", commit_hash="c", file_path="f", change_type="added", diff_snippet="x" * 3000).first()["diff"]) == 1000
    assert box.call("update_work_item", work_item_uid="1", status="closed", labels=["x"]).first()["labels"] == ["x"]
    assert {r["type"] for r in box.call("analyze_code_for_work", project_name="p").collect()} == {"INCOMPLETE", "TODO"}
    assert box.call("analyze_code_for_work", project_name="p", create_items=True).count() == 2
    box.tables["items"] = items.withColumn("external_id", F.lit(None).cast("string"))
    assert [r["sync"] for r in box.call("sync_work_to_github", project_name="p", github_repo="o/r").collect()] == ["create"]
    assert box.call("auto_link_orphan_commits", project_name="p", dry_run=True).count() == 1


def test_rest_works_without_the_training_data_part(tmp_path):
    """A copy without the two folders, as when they are deleted: the entry point has all other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", "*.parquet"))
    said = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and not [n for n in q if n.startswith('op') and n[2:3].isdigit() or n == 'pipeline']; assert set(o) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", said], cwd=copy, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), "PYTHONPATH": ":".join([str(copy), *[p for p in sys.path if "site-packages" in p]])})
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout) > 190
