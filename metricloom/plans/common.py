"""Shared pieces of the registered queries: rounding and the SQL twins of the tables.

Every query is a Spark function over a data folder; most have a SQL text that
DuckDB runs on the same files. Averages and the like are rounded on both sides
because engines add up in different orders. ``NUDGE`` keeps values that sit
exactly on a rounding tie from falling either way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.session import configure
from metricloom.sources import driver_tables as tables

NUDGE = 3.7e-9


def rounded(column: Column | str, digits: int = 6) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column + F.lit(NUDGE), digits)


def r(expression: str, digits: int = 6) -> str:
    """SQL twin of :func:`rounded`."""
    return f"round(({expression}) + {NUDGE}, {digits})"


def clock(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def clock_sql(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S')"


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


class Registry(dict):
    """Query name -> :class:`Query`, filled by the decorator."""

    def query(self, sql: str | None = None):
        def add(function: Callable[[SparkSession, str], DataFrame]):
            def run(spark: SparkSession, folder: str) -> DataFrame:
                return function(configure(spark), folder)

            self[function.__name__] = Query(run, sql)
            return function

        return add


# -- SQL twins of the derived tables ------------------------------------------

_NAMES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tables.METRIC_OF_EVENT.items())
_STATUS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tables.STATUS_OF_ORDER.items())
RUN_OF_USER = f"CAST(user_id % {tables.N_RUNS} AS VARCHAR)"

CTES = {
    "metrics": f"""SELECT {RUN_OF_USER} AS run_id, CASE event_type {_NAMES} ELSE event_type END AS name,
        value, event_id AS step, ts, props FROM events""",
    "runs": f"""SELECT CAST(o_orderkey AS VARCHAR) AS id, 'order-' || o_orderkey AS name,
        o_orderpriority AS project, CASE o_orderstatus {_STATUS} ELSE o_orderstatus END AS status,
        o_custkey AS custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS totalprice,
        o_orderpriority AS priority, o_orderdate AS created_at,
        CASE WHEN o_orderstatus <> 'O' THEN 86400.0 END AS duration_seconds FROM orders""",
    "run_tags": "SELECT CAST(l_orderkey AS VARCHAR) AS run_id, l_returnflag AS tag FROM lineitem",
    "artifacts": """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS id,
        CAST(l_orderkey AS VARCHAR) AS run_id, p_brand AS name,
        CASE WHEN l_linestatus = 'O' THEN 'checkpoint' ELSE 'tensor' END AS artifact_type,
        CAST(floor(l_extendedprice) AS BIGINT) AS size_bytes, l_linenumber AS step,
        l_shipdate AS created_at FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "insights": """SELECT CAST(d.doc_id AS VARCHAR) AS id, substr(source, 4) AS run_id,
        lang AS insight_type, 'Insight ' || d.doc_id AS title,
        'Document of ' || n_chars || ' characters' AS description,
        CASE WHEN toxic = 1 THEN 'critical' WHEN quality = 0 THEN 'warning' ELSE 'info' END AS severity,
        d.doc_id AS seq FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "votes": """SELECT CAST(doc_id AS VARCHAR) AS insight_id,
        CASE WHEN quality = 1 THEN 1 ELSE -1 END AS vote FROM labels""",
    "audit": f"""SELECT strftime(ts, '%Y-%m-%d') AS log, event_id AS line_no, 'e' || event_id AS id,
        strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS stamp, event_type AS action,
        CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS severity,
        'user' || user_id AS actor, 'run' AS resource_type, {RUN_OF_USER} AS resource_id,
        props AS details, value FROM events""",
    "elements": """SELECT 'layer' || label AS param, vec_id, pos - 1 AS pos,
        CAST(embedding[pos] AS DOUBLE) AS value
        FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(pos)""",
}


def with_tables(*names: str, body: str) -> str:
    parts = ", ".join(f"{n} AS ({CTES[n]})" for n in names)
    glue = ", " if body.lstrip().startswith("+") else " "
    return f"WITH {parts}{glue}{body.lstrip().lstrip('+')}"
