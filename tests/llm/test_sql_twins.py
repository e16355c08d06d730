"""The dealt queries that SQL can express give the same table as DuckDB; the others keep their contract's columns."""

from __future__ import annotations

import duckdb
import pytest

from metricloom.llm.queries import REGISTRY
from tools_check import connect, difference


@pytest.fixture(scope="module")
def db(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(n for n in REGISTRY if REGISTRY[n].sql))
def test_same_as_sql(spark, db, small, name):
    assert difference(REGISTRY[name].run(spark, small).toPandas(), db.execute(REGISTRY[name].sql).df()) is None


COLUMNS = {
    "op1_": "doc_id held_out score predicted",
    "op2_": "query_id rank vec_id score",
    "op6_": "doc_id n_shingles component_id",
    "op7_": "doc_id held_out lang_pred score",
    "op8_": "doc_id piece start length ids_crc32 sequence_id offset",
    "op9_": "doc_id piece start length ids_crc32 sequence_id offset",
}


@pytest.mark.parametrize("start", sorted(COLUMNS))
def test_columns(spark, small, start):
    name = next(n for n in REGISTRY if n.startswith(start))
    assert REGISTRY[name].run(spark, small).columns == COLUMNS[start].split()


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in REGISTRY] == [f"op{i}" for i in range(1, 14)]


def test_copies_and_cut_lines(spark, tmp_path):
    """Where copies are above the ratio and lines are cut, the twin of the line operator says the same as the operator."""
    rows = [(i, "a", f"own {i}\nfooter line\nrare {i % 7}") for i in range(60)]
    rows += [(100 + i, "a", "copied first\ncopied second") for i in range(30)]
    rows += [(200 + i, "b", f"other {i}\nseldom" if i < 3 else f"other {i}") for i in range(40)] + [(300, "b", None), (301, "b", None), (302, None, "footer line"), (303, "b", "")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    query = REGISTRY["op3_site_lines"]
    mine = query.run(spark, str(tmp_path)).toPandas()
    assert difference(mine, db.execute(query.sql).df()) is None
    cut = mine[mine["n_dropped"] > 0]
    assert len(cut) == 60 and set(mine[mine["doc_id"] == 100]["text"]) == {"copied first\ncopied second"}
