"""Metric queries and log shaping on hand-made frames."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from metricloom.functions import expressions as X
from metricloom.operators import metrics as M


def test_range_bounds_and_limit(series):
    m = series({"loss": range(20), "acc": range(20)})
    got = [r["step"] for r in M.metric_range(m, "loss", 5, 15, 4, "r").collect()]
    assert got == [5, 6, 7, 8]
    assert M.metric_range(m, "loss", 5, 15).count() == 11


def test_range_reaches_the_scan(spark, tmp_path, series):
    path = str(tmp_path / "m")
    series({"loss": range(20)}).write.parquet(path)
    df = M.metric_range(spark.read.parquet(path), "loss", 5, 15).select("step", "value")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(step,5)" in plan and "EqualTo(name,loss)" in plan
    assert "ReadSchema: struct<name:string,value:double,step:bigint>" in plan


def test_statistics(series):
    v = [3.0, 1.0, 4.0, 1.5, None]
    (row,) = M.series_statistics(series({"x": v})).collect()
    known = np.array(v[:4], float)
    assert row["count"] == 5
    assert row["std"] == pytest.approx(known.std(ddof=1))
    assert row["median"] == pytest.approx(np.median(known))


def test_moving_average(series):
    v = np.arange(30.0) ** 2
    rows = M.moving_average(series({"x": v}), 7).orderBy("step").collect()
    want = [v[max(0, i - 6) : i + 1].mean() for i in range(30)]
    assert [r["moving_avg"] for r in rows] == pytest.approx(want)


def test_live_metrics(spark, series):
    m = series({"a": [1, 2], "b": [2, 1], "c": [1, 1], "d": [5], "e": [0, 1e-5], "f": [1, 2]})
    runs = spark.createDataFrame(
        [("r", "run r", "running"), ("x", "run x", "failed")], "id string, name string, status string"
    ).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    rows = {r["name"]: r for r in M.live_metrics(m, runs).collect()}
    assert {k: r["trend"] for k, r in rows.items()} == {
        "a": "up", "b": "down", "c": "flat", "d": "flat", "e": "up",
    }  # only the first five names
    assert rows["a"]["label"] == "2.0000 @ step 1"
    assert rows["e"]["label"] == "1.000e-5 @ step 1"
    assert len(M.live_metrics(m, runs, max_names=None).collect()) == 6


def test_short_number(spark):
    df = spark.createDataFrame([(0.00012,), (12345.678,), (1.5,), (-20000.0,), (1e-12,)], "v double")
    got = [r[0] for r in df.select(X.short_number(F.col("v"))).collect()]
    assert got == ["1.200e-4", "1.235e+4", "1.5000", "-2.000e+4", "1.000e-12"]


def test_melt_and_coerce(spark):
    wide = spark.createDataFrame([(1, 0.5, None, [2, 3, 4])], "step long, a double, b double, t array<int>")
    rows = {r["name"]: r for r in M.melt(wide, ["step"], ["a", "b"], ["t"]).collect()}
    assert set(rows) == {"a", "t/shape"}
    assert rows["t/shape"]["value"] == 24.0 and rows["t/shape"]["metadata"] == '{"shape":[2,3,4]}'
    raw = spark.createDataFrame([("1.5", {"k": "v"}), ("text", None)], "value string, metadata map<string,string>")
    assert rows_of(M.coerce_values(raw)) == sorted(
        [(1.5, '{"k":"v"}'), (None, None)], key=lambda t: tuple(str(x) for x in t)
    )


def test_log_keys(spark):
    keys = {
        "train_loss": "train/loss",
        "eval_loss": "eval/loss",
        "learning_rate": "learning_rate",
        "train_learning_rate": "learning_rate",
        "learning_rate_loss": "learning_rate_loss",
        "epoch": "epoch",
        "train_runtime": None,
        "train_samples_per_second": None,
        "train_steps_per_second": None,
    }
    df = spark.createDataFrame([(k, "1") for k in keys] + [("note", "abc")], "key string, value string")
    got = {r["key"]: r["name"] for r in M.normalise_log_keys(df).collect()}
    assert got == {k: v for k, v in keys.items() if v is not None}
    evals = M.evaluation_keys(spark.createDataFrame([("eval_f1",), ("f1",)], "key string"))
    assert sorted(r["name"] for r in evals.collect()) == ["eval/f1", "eval/f1"]


def test_event_rows(spark):
    lrs = spark.createDataFrame(
        [("r", 1, [0.1]), ("r", 2, [0.1, 0.2])], "run_id string, step long, lrs array<double>"
    )
    assert rows_of(M.learning_rate_rows(lrs).select("step", "name")) == [
        (1, "learning_rate"), (2, "learning_rate/group_0"), (2, "learning_rate/group_1"),
    ]
    save = spark.createDataFrame([("r", 9, None)], "run_id string, global_step long, best_metric double")
    assert rows_of(M.named_rows(save, ["run_id"], M.SAVE_ROWS)) == [("r", "checkpoint/step", 9.0)]
    jit = spark.createDataFrame([("r", 1, "f", 2.5)], "run_id string, step long, fn string, time_ms double")
    assert M.compile_time_rows(jit).first()["name"] == "jit/f_compile_ms"
    one = spark.createDataFrame([("r", 1, 0, 1, 2**30, 2**31, 2**32)],
                                "run_id string, step long, device int, device_count int, allocated long, reserved long, max_allocated long")
    assert rows_of(M.device_memory_rows(one).select("name", "value")) == [
        ("memory/allocated_gb", 1.0), ("memory/max_allocated_gb", 4.0), ("memory/reserved_gb", 2.0),
    ]


def test_compare_and_rank(series):
    m = series({"loss": [3, 1, 2]}, "a").unionByName(series({"loss": [5, 1]}, "b"))
    m = m.unionByName(series({"loss": [9]}, "c"))
    wide = {r["step"]: (r["a"], r["b"]) for r in M.compare_runs_wide(m, ["a", "b"], "loss").collect()}
    assert wide == {0: (3.0, 5.0), 1: (1.0, 1.0), 2: (2.0, None)}
    assert rows_of(M.leaderboard(m, "loss").select("run_id", "rank")) == [("a", 1), ("b", 1), ("c", 3)]


def test_buckets(series):
    m = series({"x": [1, 5, 3, 10]})
    want = {"mean": [3, 6.5], "min": [1, 3], "max": [5, 10], "last": [5, 10]}
    for how, values in want.items():
        rows = M.bucket_values(m, 2, how).orderBy("bucket").collect()
        assert [r["value"] for r in rows] == values


def lttb(x, y, target):
    """Plain loop over buckets and points."""
    n = len(x)
    edges = np.linspace(1, n - 1, target - 1).astype(int)
    keep = [0]
    for b in range(target - 2):
        lo, hi = edges[b], edges[b + 1]
        nlo, nhi = (hi, edges[b + 2]) if b + 2 < len(edges) else (hi, n)
        cx, cy = np.mean(x[nlo:nhi]), np.mean(y[nlo:nhi])
        best, area = lo, -1.0
        for i in range(lo, hi):
            a = abs((x[keep[-1]] - cx) * (y[i] - y[keep[-1]]) - (x[keep[-1]] - x[i]) * (cy - y[keep[-1]]))
            if a > area:
                best, area = i, a
        keep.append(best)
    return keep + [n - 1]


def test_downsample_matches_plain_loop(series):
    v = np.cumsum(np.random.default_rng(2).normal(size=150))
    got = sorted(r["step"] for r in M.downsample(series({"x": v}), 20).collect())
    assert got == lttb(np.arange(150.0), v, 20)


def test_downsample_of_long_series(series):
    v = np.zeros(5000)
    v[1234], v[4321] = 100.0, -100.0
    got = M.downsample(series({"x": v, "short": [1, 2]}), 20)
    steps = {r["step"] for r in got.where("name = 'x'").collect()}
    assert len(steps) == 20 and {0, 1234, 4321, 4999} <= steps
    assert got.where("name = 'short'").count() == 2


@pytest.mark.parametrize("shape", ["walk", "convex", "steps", "ties"])
def test_downsample_of_any_length_is_the_plain_rule(spark, series, shape):
    """Several Arrow batches per bucket, curves that are all corners, plateaus, repeated steps."""
    n, rng = 3 + 18 * 500, np.random.default_rng(5)
    v = {
        "walk": rng.integers(-50, 50, n).cumsum().astype(float),
        "convex": (np.arange(n, dtype=float) - 2000) ** 2,
        "steps": np.repeat(rng.integers(0, 9, n // 100 + 1), 100)[:n].astype(float),
        "ties": rng.integers(0, 3, n).astype(float),
    }[shape]
    m = series({"x": v})
    inner, left = (n - 2), 18
    edges = [1 + j * inner // left for j in range(left + 1)] + [n]
    keep = [0]
    for j in range(left):
        cx, cy = np.arange(edges[j + 1], edges[j + 2]).mean(), v[edges[j + 1] : edges[j + 2]].mean()
        at = np.arange(edges[j], edges[j + 1])
        a = keep[-1]
        keep.append(int(at[np.abs((a - cx) * (v[at] - v[a]) - (a - at) * (cy - v[a])).argmax()]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        for limit in (M.CANDIDATES, 1) if shape in ("convex", "ties") else (M.CANDIDATES,):  # without and with narrowing
            got = sorted(r["step"] for r in M.downsample(m, 20, most_candidates=limit).collect())
            assert got == [*keep, n - 1]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_downsample_of_repeated_steps_and_odd_values(series):
    steps = [0, 1, 1, 1, 2, 2, 3, 4, 5, 5, 6]
    values = [0, 5, -9, 5, 1, None, 2, float("nan"), 3, float("inf"), 0]
    got = rows_of(M.downsample(series({"x": values, "none": [None] * 9}, steps={"x": steps, "none": range(9)}), 3).select("step", "value"))
    assert got == [(0, 0.0), (1, -9.0), (6, 0.0)]


def test_leaderboard_loses_no_run(spark):
    inf = float("inf")
    rows = [("a", 1.0), ("b", None), ("c", inf), ("d", float("nan")), ("e", -inf), ("f", None), ("g", 1.0)]
    points = spark.createDataFrame(
        [(r, "loss", v, 1, None) for r, v in rows], "run_id string, name string, value double, step long, timestamp timestamp"
    )
    ranks = {r["run_id"]: r["rank"] for r in M.leaderboard(points, "loss").collect()}
    assert ranks == {"e": 1, "a": 2, "g": 2, "c": 4, "d": 5, "b": 6, "f": 6}
