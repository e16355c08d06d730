"""Near-duplicate vectors against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from metricloom.llm import descent


def brute(rows, threshold=descent.THRESHOLD):
    """vec_id -> (links, smallest reachable id), all pairs compared."""
    usable = {i: np.asarray(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    ids, n, part = sorted(usable), {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in usable.items()}
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                n[i], n[j] = n[i] + 1, n[j] + 1
                a, b = root(i), root(j)
                part[max(a, b)] = min(a, b)
    return {i: (n[i], root(i)) for i in part}


def groups(seed, sizes, dim, noise):
    rng = np.random.default_rng(seed)
    for size in sizes:
        base = rng.normal(size=dim)
        for _ in range(size):
            yield (base + noise * rng.normal(size=dim) * np.linalg.norm(base) / dim**0.5).tolist()


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return {r["vec_id"]: r for r in descent.near_duplicate_vectors(df, **options).collect()}


@pytest.mark.parametrize(("noise", "k"), [(0.05, 12), (0.2, 6)])
def test_links_and_components(spark, noise, k):
    """Tight and loose groups, some far larger than a list, copies among them, and single vectors."""
    vectors = list(groups(1, [90, 40, 5, 2, 2, *[1] * 300], 24, noise))
    vectors += vectors[:10] * 3 + [[2 * x for x in vectors[3]]]
    rows = list(enumerate(vectors))
    got, wanted = found(spark, rows, k=k), brute(rows)
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == wanted
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    assert got[0]["audited_recall"] == 1.0


def test_a_chain_is_one_component(spark):
    """Neighbours link, ends do not: the whole is compared in tiles, not counted by its centre."""
    angles = np.linspace(0, 1.5, 60)
    rows = [(i, [float(np.cos(a)), float(np.sin(a)), 0.0]) for i, a in enumerate(angles)]
    assert {i: (r["n_links"], r["component_id"]) for i, r in found(spark, rows).items()} == brute(rows)


def test_counts_do_not_depend_on_tiles(spark):
    rows = list(enumerate(groups(3, [70], 8, 0.5)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    nodes = descent.directions(df).selectExpr("vec_id AS node", "size(unit) AS dim", "unit AS direction", "1L AS copies")
    parts = nodes.selectExpr("node", "0L AS part")
    wanted = {i: n for i, (n, _) in brute(rows).items() if n}
    for tile in (7, 4096):
        assert {r["node"]: r["links"] for r in descent.count_links(nodes, parts, tile=tile).collect() if r["links"]} == wanted


def test_odd_rows(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]),
        (8, [float("inf"), 1.0]), (9, [1e200, 1e190]), (10, [1e-200, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [-1.0, 0.0]), (None, [1.0, 0.0]),
    ]
    got = {i: (r["n_links"], r["component_id"]) for i, r in found(spark, rows).items()}
    assert got == {1: (3, 1), 2: (3, 1), 9: (3, 1), 10: (3, 1), **{i: (0, i) for i in (3, 4, 5, 6, 7, 8, 11, 12)}}
    clash = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>").selectExpr("*", "1 AS unit", "2 AS node", "3 AS part")
    assert descent.near_duplicate_vectors(clash).count() == 2


def test_empty(spark):
    assert found(spark, []) == {}
