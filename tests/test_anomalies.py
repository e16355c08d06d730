"""Detectors against their rules, written out with NumPy on small series."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.operators import anomalies as D

RNG = np.random.default_rng(11)


def expected_outliers(v, z_limit=2.4, iqr_factor=1.3):
    """(index, type, confidence) by the written rule; NumPy only."""
    v = np.asarray(v, float)
    mean, std = v.mean(), v.std()
    q1, q3 = np.percentile(v, [25, 75])
    lo, hi = q1 - iqr_factor * (q3 - q1), q3 + iqr_factor * (q3 - q1)
    out = []
    for i, x in enumerate(v):
        z = abs(x - mean) / std if std > 0 else 0
        if z > z_limit:
            confidence = min(1.0, z / 5)
        elif x < lo or x > hi:
            confidence = 0.7
        else:
            continue
        spike = x > 10 * mean or (i > 10 and x > 5 * v[i - 10 : i].mean())
        out.append((i, "loss_spike" if spike else "unusual_pattern", round(confidence, 9)))
    return out


@pytest.mark.parametrize(
    "values",
    [
        RNG.exponential(10, 200),
        RNG.normal(0, 1, 60),
        [1.0 if i % 50 else 100.0 for i in range(500)],
        list(RNG.normal(5, 1, 29)) + [90.0],
    ],
)
def test_outliers(series, values):
    rows = D.outliers(series({"x": values})).collect()
    got = sorted((r["step"], r["anomaly_type"], round(r["confidence"], 9)) for r in rows)
    assert got == expected_outliers(values)
    for r in rows:
        assert r["severity"] == ("critical" if r["confidence"] > 0.9 else "warning")


@pytest.mark.parametrize("at, kind", [(10, "unusual_pattern"), (11, "loss_spike")])
def test_spike_rule_starts_at_index_11(series, at, kind):
    """The same jump is unusual at index 10 and a spike at index 11."""
    values = [1.0] * 100
    values[at] = 6.0  # below ten times the mean
    rows = D.outliers(series({"x": values})).collect()
    assert [(r["step"], r["anomaly_type"]) for r in rows] == [(at, kind)]


def test_short_and_flat_series_give_nothing(series):
    assert D.detect_anomalies(series({"x": list(RNG.exponential(1, 29))})).count() == 0
    flat = D.detect_anomalies(series({"x": [3.0] * 60}))
    assert flat.count() == 0


def test_nonfinite(series):
    values = list(RNG.normal(0, 1, 100))
    values[10], values[20], values[30], values[40] = float("nan"), float("inf"), -float("inf"), None
    rows = D.nonfinite(series({"x": values, "short": [float("nan")] * 29})).collect()
    assert sorted((r["step"], r["severity"]) for r in rows) == [(s, "critical") for s in (10, 20, 30)]
    assert {r["step"]: r["value"] for r in rows}[10] == 0.0
    # Finite points are still judged, on the finite values alone.
    finite = [v for v in values if v is not None and np.isfinite(v)]
    assert D.outliers(series({"x": values})).count() == len(expected_outliers(finite))


def first_plateau(v):
    for s in range(len(v) - 50):
        w = v[s : s + 50]
        if w.std() < 0.001 * np.abs(w).mean():
            return s
    return None


@pytest.mark.parametrize("n", [49, 50, 51, 99, 100])
def test_plateau_lengths(series, n):
    rows = D.plateaus(series({"loss": [2.0] * n})).collect()
    assert len(rows) == (1 if n > 50 else 0)


def test_plateau_found_late(series):
    v = np.concatenate([np.linspace(10, 1, 80), 1 + RNG.normal(0, 1e-5, 120)])
    (row,) = D.plateaus(series({"a_Loss": v, "other": v})).collect()
    start = first_plateau(v)
    assert row["metric_name"] == "a_Loss" and row["step"] == start
    assert row["value"] == pytest.approx(v[start : start + 50].mean())
    assert row["description"] == f"Loss plateau detected from step {start} to {start + 50}"


@pytest.mark.parametrize("hot_rows", [50, 10**9])
def test_plateaus_near_the_threshold(series, hot_rows):
    """Noise around a thousandth of the level, with and without trend, sign and scale."""
    rng = np.random.default_rng(17)
    shapes = {}
    for i, noise in enumerate([2e-4, 8e-4, 9.5e-4, 1e-3, 1.05e-3, 1.2e-3, 5e-3, 0.1]):
        level = [5.0, -300.0, 1e-6, 40.0][i % 4]
        flat = level * (1 + rng.normal(0, noise, 260))
        shapes[f"loss_{i}"] = flat
        shapes[f"loss_{i}_late"] = np.concatenate([level * rng.uniform(1, 3, 111), flat])
        shapes[f"loss_{i}_drift"] = flat + level * np.linspace(0, 20 * noise, 260)
    shapes["loss_zero"] = np.zeros(80)
    found = D.plateaus(series(shapes), hot_rows=hot_rows)
    got = {r["metric_name"]: (r["step"], r["value"]) for r in found.collect()}
    want = {k: first_plateau(v) for k, v in shapes.items()}
    assert {k: s for k, (s, _) in got.items()} == {k: s for k, s in want.items() if s is not None}
    assert 5 < len(got) < len(shapes)
    for k, (s, value) in got.items():
        assert value == pytest.approx(shapes[k][s : s + 50].mean())


def test_divergence(series):
    v = np.array([0.05 * i for i in range(200)])
    (row,) = D.divergences(series({"train_loss": v})).collect()
    early = v[:10].mean()
    want = next(i for i in range(10, 200) if v[i] > early * 10)
    assert (row["step"], row["severity"], row["confidence"]) == (want, "critical", 0.9)
    assert D.divergences(series({"train_loss": v[::-1]})).count() == 0
    assert D.divergences(series({"accuracy": v})).count() == 0


def test_deduplicate_keeps_first_detector(series):
    found = D.outliers(series({"x": list(RNG.exponential(10, 100))}))
    twice = found.unionByName(found.withColumn("detector", F.lit(9)).withColumn("confidence", F.lit(0.1)))
    out = D.deduplicate(twice)
    assert out.count() == found.count()
    assert out.where("detector = 9").count() == 0


def test_summary_and_order(spark, series):
    metrics = series({"loss": [1.0 if i % 50 else 100.0 for i in range(500)]})
    found = D.detect_anomalies(metrics)
    ids = spark.createDataFrame([("r",), ("quiet",)], "id string")
    rows = {r["run_id"]: r for r in D.anomaly_summary(found, ids).collect()}
    assert rows["quiet"]["status"] == "healthy" and rows["quiet"]["anomaly_count"] == 0
    assert rows["r"]["by_type"] == {"loss_spike": 10}
    ranks = [r["severity"] for r in D.sort_anomalies(found).collect()]
    assert ranks == sorted(ranks, key=["critical", "warning", "info"].index)


def test_texts(series):
    metrics = series({"loss": [1.0 if i % 50 else 100.0 for i in range(500)]})
    row = D.outliers(metrics).orderBy("step").first()
    assert row["description"] == "Sudden spike in loss to 100.0000 at step 0"
    assert row["suggested_actions"][0] == "Check for corrupted data batches"
    assert row["related_metrics"] == ["learning_rate", "gradient_norm", "accuracy"]


def test_gradient_rules(series):
    rows = D.gradient_anomalies(series({"gradient_norm": [1.0, 50.0, 1e-9]})).collect()
    assert sorted((r["step"], r["anomaly_type"]) for r in rows) == [
        (1, "gradient_explosion"),
        (2, "gradient_vanishing"),
    ]
