"""Every registered query with a SQL twin gives the same table as DuckDB."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tools_check import connect, difference

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db(small) -> duckdb.DuckDBPyConnection:
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, db, small, name):
    mine = QUERIES[name](spark, small).toPandas()
    assert difference(mine, db.execute(SQL[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() >= 0


def test_entry_is_not_empty(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream")))
def test_plan_shape(spark, small, name):
    """No cross joins, no row-at-a-time Python, no window over a whole table."""
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in FORBIDDEN if w in plan]
    if name == "run_leaderboard":
        return  # ranks the distinct best values of all runs: one group, split once it is large
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "- Window [" in line or "+- Window [" in line:
            below = "\n".join(lines[i : i + 4])
            assert "SinglePartition" not in below
