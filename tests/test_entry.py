"""The driver's contract, and every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def _plain(rows, names, order):
    at = [names.index(n) for n in order]
    return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else repr(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan  # nothing compares all rows with all
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert _plain(df.collect(), df.columns, sorted(names)) == _plain(cur.fetchall(), names, sorted(names))
