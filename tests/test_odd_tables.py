"""Queries on tables that the fixtures don't hold: the rows of the smallest ones, changed, against the same SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from lodestar.plans import registry

from .test_queries import SF, _rows

pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables here")


def same_as_sql(spark, folder: Path, name: str, **tables: str) -> list[tuple]:
    """Runs a query and its SQL on the tables, some of them made by a statement; gives the rows."""
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in SF.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
        con.execute(f"copy ({tables.get(p.stem, f'select * from {p.stem}')}) to '{folder / p.name}' (format parquet)")
    for p in SF.glob("*.parquet"):
        con.execute(f"create or replace view {p.stem} as select * from '{folder / p.name}'")
    df = registry.queries()[name](spark, str(folder))
    got = [tuple(r) for r in df.collect()]
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert _rows(df.columns, got) == _rows(names, found.fetchall())
    return got


def test_work_context_of_an_item_without_links(spark, tmp_path):
    got = same_as_sql(spark, tmp_path, "tool_work_context", lineitem="select * from lineitem where l_orderkey <> 3")
    assert got == [(3, None, None)]


def test_work_context_of_an_item_with_many_links(spark, tmp_path):
    many = "select * from lineitem where l_orderkey <> 3 union all select l.* replace (3 as l_orderkey, 'R' as l_returnflag, i as l_partkey, l_shipdate + to_days((i // 3)::int) as l_shipdate) from range(150) r(i), (from lineitem limit 1) l"
    got = same_as_sql(spark, tmp_path, "tool_work_context", lineitem=many)
    assert got[0][1].count(",") == 49 and got[0][2].count(",") == 149


def test_health_history_ends_at_its_time_to_the_microsecond(spark, tmp_path):
    late = "select * from events union all select e.* replace (event_id + 1000000 + i as event_id, timestamp '2024-01-15' + to_microseconds(i * 250000 - 250000) as ts) from range(5) r(i), (from events limit 1) e"
    same_as_sql(spark, tmp_path, "health_history", events=late)


def test_equal_spans_are_joined_once(spark):
    from lodestar.operators import graph

    spans = spark.createDataFrame([("a", 1, 9, i) for i in (None, 7, 5)] + [("a", 1, 9, 6)] * 50 + [("a", 0, None, 1), (None, 1, 9, 1), ("a", 2, 9, 2)], "file string, start_line int, end_line int, span_id int")
    points = spark.createDataFrame([("a", 3), ("a", 30), ("b", 3)], "file string, line int")
    assert sorted(graph.within(points, spans, ["file"]).select("file", "line", "span_id").collect()) == [("a", 3, 5), ("a", 30, None), ("b", 3, None)]
    wide = spans.withColumn("name", spans["span_id"].cast("string"))
    assert graph.within(points, wide.where("span_id is not null"), ["file"]).where("line = 3 and file = 'a'").first()["name"] == "5"
    assert graph.within(points, spans.drop("span_id"), ["file"]).where("end_line = 9").count() == 1


def test_edges_are_made_in_tasks_of_bounded_size(spark, monkeypatch):
    from lodestar.plans import views

    monkeypatch.setattr(views, "EDGES_A_TASK", 500)
    n = spark.read.parquet(str(SF / "lineitem.parquet")).count()
    assert views.edges(spark, str(SF)).where("type = 'CALLS'").rdd.getNumPartitions() >= n // 500


def test_chunks_leave_a_task_in_small_frames(spark, monkeypatch):
    from lodestar.functions import chunking

    text = "a line of text\n" * 1000
    docs = spark.createDataFrame([(f"d{i}.md", text) for i in range(5)], "path string, text string")
    whole = sorted(map(tuple, chunking.chunk(docs).collect()))
    monkeypatch.setattr(chunking, "HELD", 2000)
    sizes = []
    monkeypatch.setattr(type(docs), "mapInPandas", lambda self, f, schema: sizes.extend(len(x) for x in f(iter([self.toPandas()]))))
    chunking.chunk(docs)
    assert sum(sizes) == len(whole) and max(sizes) <= 2


def test_files_are_read_by_many_tasks(spark, monkeypatch):
    from lodestar.plans import sources, views

    monkeypatch.setattr(views.spread, "__defaults__", (50,))
    assert sources._files(spark, str(SF)).rdd.getNumPartitions() >= 4
