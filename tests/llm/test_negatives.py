"""Residue products and hard negatives against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.llm import negatives, residues


@pytest.mark.parametrize(("dim", "most"), [(1, 5), (64, 256), (64, 4000), (700, 300), (3, 2**23), (4, 2**40), (2, 2**61)])
def test_products_are_exact(dim, most):
    rng = np.random.default_rng(dim)
    a, b = (rng.integers(-most, most + 1, (n, dim)) for n in (17, 23))
    a[0], b[0] = most, -most
    wanted = np.clip(a.astype(object) @ b.astype(object).T, -residues.SCORE_LIMIT, residues.SCORE_LIMIT).astype(np.int64)
    assert (residues.exact_products(a, b) == wanted).all()


def test_one_wide_row_leaves_the_others_exact():
    a = np.array([[3, 4], [2**61, 1]])
    assert residues.exact_products(a, a).tolist() == [[25, residues.SCORE_LIMIT], [residues.SCORE_LIMIT, residues.SCORE_LIMIT]]


def test_sums_of_residues_stay_exact_in_float32():
    for chunk in (1, 64, 256):
        half = max(p // 2 for p in residues.moduli(2**40, chunk))
        assert chunk * half * half <= residues.EXACT


def brute(rows, anchor):
    scaled = [(i, [int(np.floor(256 * x)) for x in v], c) for i, v, c in rows]
    out = set()
    for i, v, c in scaled:
        if not anchor(i):
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), j, d == c) for j, w, d in scaled if j != i and len(w) == len(v))
        for p, j, _ in [s for s in scores if s[2]][:5]:
            inside = [(-n, k) for n, k, same in scores if not same and 30 * -p <= 100 * -n <= 90 * -p][:10]
            out |= {(i, j, r, k, -p, n) for r, (n, k) in enumerate(inside, 1)}
    return out


def mined(spark, rows, schema="vec_id long, embedding array<double>, label int", **options):
    df = spark.createDataFrame(rows, schema)
    return {tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **options).collect()}


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_against_all_pairs(spark, monkeypatch, block_rows):
    """Ties by repeated vectors, a hot label, several blocks and portions."""
    monkeypatch.setattr(negatives, "TILE_ANCHORS", 5)
    monkeypatch.setattr(negatives, "packed", lambda rows, n=block_rows, f=negatives.packed: f(rows, n))
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 6)).round(2)
    rows = [(i, base[rng.integers(60)].tolist(), int(0 if i % 3 else rng.integers(4))) for i in range(400)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_odd_rows(spark):
    good = [(0, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.5, 0.3], 2), (3, [0.5, 0.3], 2), (10, [-1.0, 0.0], 1), (20, [0.1], 3)]
    bad = [(4, None, 1), (5, [1.0, None], 1), (6, [float("nan"), 1.0], 1), (7, [float("inf"), 0.0], 1), (8, [1.0, 0.5], None), (9, [], 1), (None, [1.0, 0.5], 1)]
    assert mined(spark, good + bad + good[:2]) == brute(good, lambda i: i % 10 == 0)
    huge = [(0, [1e300, 0.0], 1), (1, [1e300, 0.0], 1), (2, [1.0, 0.0], 2), (3, [1e307, 1e308], 1)]
    assert mined(spark, huge) == set()  # its negative scores less than 30 % of the positive, and 256 x the last is not finite
    assert mined(spark, []) == set()


def test_relabelled_and_repeated(spark):
    rows = [(0, [1.0], 1), (1, [1.0], 2), (2, [0.5], 1), (2, [0.4], 5), (3, [0.7], 3)]
    once = [r for r in rows if r != (2, [0.4], 5)]
    relabel = F.when(F.col("vec_id") == 1, 1).otherwise(F.col("label"))
    assert mined(spark, rows, relabel=relabel) == brute([(i, v, 1 if i == 1 else c) for i, v, c in once], lambda i: i % 10 == 0)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2)], "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS v", "2 AS chunk", "3 AS number")
    assert negatives.hard_negatives(df, F.col("vec_id") == 0).count() == 1
