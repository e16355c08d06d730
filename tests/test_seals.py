"""Hash trees over audit segments: tampering that leaves every chain whole is found."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from metricloom.operators import audit as U
from metricloom.operators import seals as S

TREE = {"fan_out": 2, "depth": 4}


@pytest.fixture(scope="module")
def chain(spark):
    rows = [(log, i, f"e{i}", "t", "run.create", "u", "run", "r", "{}") for log, n in (("a", 95), ("b", 7)) for i in range(n)]
    events = spark.createDataFrame(
        rows,
        "log string, line_no long, id string, timestamp string, action string, actor string, "
        "resource_type string, resource_id string, details string",
    )
    return U.build_chain(events, segment_lines=10).checkpoint()


@pytest.fixture(scope="module")
def leaves(chain):
    return S.seal_leaves(chain).checkpoint()


def errors(lines, leaves, roots=None):
    return rows_of(S.verify_segments(lines, leaves, S.roots(leaves, **TREE) if roots is None else roots, **TREE))


def test_root_is_the_written_out_tree(leaves):
    def sha(*parts):
        return hashlib.sha256("\x1f".join(str(p) for p in parts).encode()).hexdigest()

    rows = sorted((r for r in leaves.collect() if r["log"] == "a"), key=lambda r: r["segment"])
    level = {r["segment"]: sha("leaf", r["segment"], r["head"], r["lines"]) for r in rows}
    for depth in range(1, 5):
        units = sorted({u // 2 for u in level})
        level = {u: sha(f"node {depth}", u, *[f"{c}:{h}" for c, h in sorted(level.items()) if c // 2 == u]) for u in units}
    got = {r["log"]: r for r in S.roots(leaves, **TREE).collect()}
    assert got["a"]["root"] == level[0] and got["a"]["segments"] == 10 and got["a"]["lines"] == 95


def test_whole_log_is_clean(chain, leaves):
    assert errors(chain, leaves) == []


def test_removed_segment_cut_tail_and_log(chain, leaves):
    s = ~((F.col("log") == "a") & (F.col("segment") == 4))
    assert rows_of(U.verify_chain(chain.where(s)).select("log", "error")) == []  # the chains alone see nothing
    assert errors(chain.where(s), leaves) == [("a", 4, S.MISSING)]
    assert errors(chain.where("log = 'b' OR line_no < 93"), leaves) == [("a", 9, S.LINES), ("a", 9, S.HEAD)]
    assert errors(chain.where("log = 'a'"), leaves) == [("b", 0, S.MISSING)]


def test_swapped_and_added_segments(chain, leaves):
    swapped = chain.withColumn(
        "segment", F.expr("CASE WHEN log = 'a' AND segment IN (2, 6) THEN 8 - segment ELSE segment END")
    )
    assert errors(swapped, leaves) == [("a", 2, f"{S.MOVED} (sealed as 6)"), ("a", 6, f"{S.MOVED} (sealed as 2)")]
    added = chain.unionByName(chain.where("log = 'b'").withColumn("log", F.lit("c")))
    assert errors(added, leaves) == [("c", 0, S.UNKNOWN)]


def test_edited_seal_does_not_lead_to_the_root(chain, leaves):
    kept = S.roots(leaves, **TREE).checkpoint()
    cut = chain.where("log = 'b' OR segment < 9")
    hidden = leaves.where("log = 'b' OR segment < 9")  # log and stored leaves cut alike
    assert errors(cut, hidden, kept) == [("a", None, S.ROOT)]
    assert errors(chain, leaves, kept.where("log = 'a'")) == [("b", None, S.ROOT)]
    assert errors(chain.where("log = 'a'"), leaves.where("log = 'a'"), kept) == [("b", None, S.ROOT)]


def test_members_by_path(chain, leaves):
    nodes, kept = S.seal_nodes(leaves, **TREE), S.roots(leaves, **TREE)
    claims = leaves.select("log", "segment", "head", "lines")
    false = claims.where("log = 'a'").withColumn("segment", F.col("segment") + 1)
    got = S.verify_members(claims.withColumn("log", F.lit("a")).where("segment = 3"), nodes, kept, **TREE)
    assert rows_of(got) == [("a", 3, True)]
    assert {r["member"] for r in S.verify_members(claims, nodes, kept, **TREE).collect()} == {True}
    assert {r["member"] for r in S.verify_members(false, nodes, kept, **TREE).collect()} == {False}
    assert {r["member"] for r in S.verify_members(claims, nodes, kept.where("log = 'z'"), **TREE).collect()} == {False}


def test_empty_and_too_many_segments(spark, chain, leaves):
    none = leaves.limit(0)
    assert errors(chain.limit(0), none) == []
    assert {e for _, _, e in errors(chain, none)} == {S.UNKNOWN}
    with pytest.raises(Exception, match="outside the tree"):
        S.seal_nodes(leaves, fan_out=2, depth=3).collect()
