"""Tensor statistics against NumPy."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.operators import artifacts as A
from metricloom.operators import tensors as T

RNG = np.random.default_rng(1)


@pytest.fixture(scope="module")
def values(spark):
    arrays = {"n": RNG.normal(size=500), "flat": np.full(20, 3.0), "edge": np.array([0.0, 1.0, 1.0, 0.5])}
    rows = [(k, float(x)) for k, v in arrays.items() for x in v]
    return arrays, spark.createDataFrame(rows, "param string, value double").repartition(4)


def test_histogram_matches_numpy(values):
    arrays, df = values
    rows = T.histogram(df, ["param"]).collect()
    for name, v in arrays.items():
        counts, edges = np.histogram(v, bins=64)
        got = np.zeros(64, int)
        for r in rows:
            if r["param"] == name:
                got[r["bin"]] = r["count"]
                assert r["lower"] == pytest.approx(edges[r["bin"]])
        assert got.sum() == len(v)
        if name != "n":
            assert (got == counts).all()
        else:  # a point within rounding of an edge may fall either side
            assert np.abs(got - counts).sum() <= 2
    meta = {r["param"]: json.loads(r["metadata"]) for r in T.histogram_metric(df, ["param"]).collect()}
    assert meta["flat"]["histogram"][32] == 20 and len(meta["flat"]["bin_edges"]) == 65
    assert meta["n"]["std"] == pytest.approx(arrays["n"].std())


def test_statistics_and_summary(spark):
    data = {"a": [0.0, 3.0, 4.0], "b": [1.0, float("nan")], "c": [float("inf"), 1.0], "d": [0.0, 0.0]}
    df = spark.createDataFrame([(k, x) for k, v in data.items() for x in v], "param string, value double")
    stats = T.tensor_statistics(df, ["param"])
    rows = {r["param"]: r for r in stats.collect()}
    assert rows["a"]["norm"] == 5.0 and rows["a"]["num_zeros"] == 1
    assert rows["a"]["std"] == pytest.approx(np.std(data["a"], ddof=1))
    assert rows["b"]["has_nan"] and not rows["b"]["has_inf"] and rows["c"]["has_inf"]
    assert rows["d"]["sparsity"] == 1.0
    s = T.gradient_summary(stats).first()
    assert (s["total_norm"], s["max_norm"], s["mean_norm"]) == (5.0, 5.0, 2.5)
    assert (s["num_layers"], s["num_nan"], s["num_inf"]) == (4, 1, 1)
    p = T.parameter_summary(stats.where("param IN ('a', 'd')")).first()
    assert p["mean_sparsity"] == pytest.approx((1 / 3 + 1) / 2)
    broken = T.gradient_summary(stats.where("has_nan")).first()
    assert (broken["total_norm"], broken["max_norm"], broken["mean_norm"]) == (0.0, 0.0, 0.0)
    tree = T.tree_statistics(df.where("param IN ('a', 'd')"), "param").first()
    assert (tree["num_tensors"], tree["total_elements"], tree["mean_norm"]) == (2, 5, 2.5)
    assert T.gradient_norms(df.where("param = 'none'"), "param").first()["max_norm"] == 0.0


def test_layer_choice(spark):
    df = spark.createDataFrame([("enc.w",), ("enc.bias",), ("dec.w",)], "param string")
    pick = lambda **k: sorted(r[0] for r in T.select_layers(df, **k).collect())
    assert pick() == ["dec.w", "enc.bias", "enc.w"]
    assert pick(exclude=["bias"]) == ["dec.w", "enc.w"]
    assert pick(include=["enc"], exclude=["bias"]) == ["enc.w"]


@pytest.fixture(scope="module")
def states(spark):
    groups = {"l0": RNG.normal(size=(40, 6)), "l1": RNG.normal(1, 1, size=(5, 6)), "l2": RNG.normal(size=(1, 6))}
    rows = [(g, i, row.tolist()) for g, m in groups.items() for i, row in enumerate(m)]
    return groups, spark.createDataFrame(rows, "layer string, pos long, vec array<double>").repartition(5)


def matrix(h):
    u = h / (np.linalg.norm(h, axis=1, keepdims=True) + 1e-8)
    return u @ u.T


@pytest.mark.parametrize("whole", [0, 5000])
def test_similarity_summary(states, whole):
    groups, df = states
    rows = {r["layer"]: r for r in T.similarity_summary(df, ["layer"], whole_positions=whole).collect()}
    for g, h in groups.items():
        off = matrix(h)[~np.eye(len(h), dtype=bool)]
        if len(off):
            assert rows[g]["similarity_mean"] == pytest.approx(off.mean(), abs=1e-9)
            assert rows[g]["similarity_std"] == pytest.approx(off.std(), abs=1e-7)
        else:
            assert rows[g]["similarity_mean"] is None


def test_full_matrix_through_anchors(states):
    groups, df = states
    anchors = df.select("layer", F.col("pos").alias("anchor_pos"), F.col("vec").alias("anchor_vec"))
    rows = T.similarity_to(df, anchors, ["layer"]).collect()
    assert len(rows) == sum(len(h) ** 2 for h in groups.values())
    want = {g: matrix(h) for g, h in groups.items()}
    for r in rows:
        assert r["similarity"] == pytest.approx(want[r["layer"]][r["anchor_pos"], r["pos"]], abs=1e-9)
    dots = T.similarity_to(df, anchors, ["layer"], "dot_product").where("layer = 'l1'").collect()
    h = groups["l1"]
    assert all(r["similarity"] == pytest.approx(h[r["anchor_pos"]] @ h[r["pos"]]) for r in dots)


def test_attention(spark):
    w = RNG.dirichlet(np.ones(8), size=12)
    df = spark.createDataFrame([("a", row.tolist()) for row in w], "layer string, weights array<double>")
    row = T.attention_summary(df, ["layer"]).first()
    assert row["mean"] == pytest.approx(w.mean()) and row["max"] == pytest.approx(w.max())
    assert row["entropy"] == pytest.approx((-(w * np.log(w + 1e-10)).sum(axis=1)).mean())
    shapes = spark.createDataFrame([([2, 3],), ([1, 2, 3],), ([1, 1, 2, 3],)], "shape array<int>")
    assert T.check_rank(shapes, T.ATTENTION_RANKS).count() == 1
    assert T.check_rank(shapes, T.HIDDEN_STATE_RANKS).count() == 1


def test_slice_and_info(spark):
    rows = [("w", i, j, float(10 * i + j)) for i in range(4) for j in range(3)]
    df = spark.createDataFrame(rows, "name string, i int, j int, value double")
    got = A.tensor_slice(df, i=(1, 3), j=(0, 2)).collect()
    assert sorted(r["value"] for r in got) == [10.0, 11.0, 20.0, 21.0]
    info = A.tensor_info(df, ["name"], ["i", "j"]).first()
    assert (info["shape"], info["size_bytes"]) == ([4, 3], 48)
