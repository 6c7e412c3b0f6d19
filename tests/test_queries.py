"""Every query that has SQL gives the same rows as DuckDB on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from lodestar.plans import registry

SF = Path("/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), registry.oracle_sql()

pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in SF.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool) or not isinstance(v, int | float):
        return (2, str(v).lower() if isinstance(v, bool) else str(v))
    return (1, f"{round(float(v), 5) + 0.0:.5f}")


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    got = [tuple(r) for r in df.collect()]
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    want = found.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    assert _rows(df.columns, got) == _rows(names, want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, str(SF)).collect()


def test_import_files_reads_every_part(spark):
    keys = {r["p_partkey"] for r in spark.read.parquet(str(SF / "part.parquet")).select("p_partkey").collect()}
    wanted = {f"src/m{k}.py": k + 1 if k % 2 == 0 else k + 2 for k in keys}
    got = {r["path"]: r["target"] for r in QUERIES["import_files"](spark, str(SF)).collect()}
    assert got == {path: f"src/m{t}.py" for path, t in wanted.items() if t in keys and t % 3}


def test_flagship(spark):
    assert registry.flagship(spark, str(SF)).count() == 20
