"""Insights, votes, feeds, summaries and reports."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from metricloom.operators import anomalies as D
from metricloom.operators import insights as I


def runs_frame(spark, rows):
    df = spark.createDataFrame(rows, "id string, name string, status string, t int")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t"))
    return df.select(
        "id", "name", F.lit("p").alias("project"), "status", F.lit('{"lr":1}').alias("config"),
        at.alias("created_at"), F.lit(12.4).alias("duration_seconds"),
    )


@pytest.fixture(scope="module")
def spiky(series):
    values = [1.0 if i % 50 else 100.0 for i in range(500)]
    return series({"train_loss": values, "gradient_norm": [20.0] * 500})


def test_insights(spark, spiky):
    runs = runs_frame(spark, [("r", "run", "running", 1), ("other", "o", "completed", 2)])
    anomalies, insights = I.analyse_runs(spiky, runs)
    rows = {r["anomaly_type"]: r for r in insights.collect()}
    assert set(rows) == {"loss_spike"}
    spike = rows["loss_spike"]
    assert spike["description"] == "Detected 10 loss spike(s) during training"
    assert len(spike["evidence"]) == 5 and [e["step"] for e in spike["evidence"]] == [0, 50, 100, 150, 200]
    assert "at steps: [0, 50, 100, 150, 200]..." in spike["detailed_analysis"]
    assert "regularly every ~50 steps" in spike["detailed_analysis"]
    assert "SEVERE" in spike["detailed_analysis"]
    assert json.loads(spike["visualization_spec"])["data"] == {"name": "loss_spikes"}
    assert I.spike_points(anomalies).count() == 10
    stored = I.to_insight_table(insights).first()
    assert json.loads(stored["related_metrics"]) == ["loss", "learning_rate", "gradient_norm"]
    assert I.analyse_runs(spiky, runs.where("status = 'completed'"))[0].count() == 0


def test_types_without_insight(series):
    found = D.detect_anomalies(series({"x": list(np.random.default_rng(0).normal(size=300))}))
    assert found.where("anomaly_type = 'unusual_pattern'").count() > 0
    only = found.where("anomaly_type = 'unusual_pattern'")
    assert I.insights_from_anomalies(only).count() == 0


def test_irregular_spikes(spark):
    rows = [("r", "loss", s, 1.5, "loss_spike") for s in (1, 2, 50, 51, 300)]
    df = spark.createDataFrame(rows, "run_id string, metric_name string, step long, value double, anomaly_type string")
    row = I.spike_regularity(df).first()
    gaps = np.diff([1, 2, 50, 51, 300])
    assert row["std_interval"] == pytest.approx(gaps.std()) and not row["regular"]
    assert row["size"] == "MINOR"
    single = I.spike_regularity(df.where("step = 1")).first()
    assert single["regular"] is False and single["spikes"] == 1


def test_cap(spark):
    rows = [("r", f"i{i:02}", "warning", i / 10) for i in range(10)]
    df = spark.createDataFrame(rows, "run_id string, id string, severity string, confidence double")
    assert I.cap_per_run(df, cap=3).count() == 3
    assert rows_of(I.cap_per_run(df, df.limit(8), cap=10).select("id")) == [("i08",), ("i09",)]


def test_training_summary(spark, spiky):
    figures = I.training_figures(spiky)
    f = figures.first()
    assert (f["loss_initial"], f["loss_current"], f["loss_best"]) == (100.0, 1.0, 1.0)
    assert f["total_steps"] == 499 and f["elapsed_seconds"] == 499.0
    row = I.training_summary(figures, D.detect_anomalies(spiky)).first()
    assert row["severity"] == "critical" and row["loss_reduction"] == pytest.approx(0.99)
    assert "Found 10 critical issues" in row["summary"]
    assert "Enable gradient clipping to prevent instability" in row["recommendations"]
    quiet = I.training_summary(figures, D.detect_anomalies(spiky).where("false")).first()
    assert quiet["title"] == "Training Progressing Normally"


def test_comparison(spark, series):
    m = series({"loss": [4, 2]}, "a").unionByName(series({"loss": [3, 2, 5]}, "b")).unionByName(series({"loss": [1]}, "c"))
    pairs = spark.createDataFrame([("a", "b"), ("c", "a"), ("a", "none")], "run_a string, run_b string")
    rows = {(r["run_a"], r["run_b"]): r for r in I.compare_pairs(m, pairs, "loss").collect()}
    assert rows[("a", "b")]["winner"] == "b" and rows[("a", "b")]["improvement"] == 0.0
    assert rows[("c", "a")]["winner"] == "c" and rows[("c", "a")]["improvement"] == 50.0
    assert rows[("c", "a")]["summary"] == "Run A achieved 50.0% better loss"
    assert rows[("a", "none")]["winner"] == "none" and rows[("a", "none")]["best_b"] == 0.0
    spec = json.loads(rows[("a", "b")]["visualization_spec"])
    assert spec["encoding"]["color"]["legend"]["title"] == "Run" and spec["height"] == 300


def test_votes(spark):
    insights = spark.createDataFrame(
        [("1", "a", 1, 0), ("2", "a", 0, 0), ("3", "b", 0, 0)],
        "id string, insight_type string, votes_up long, votes_down long",
    )
    votes = spark.createDataFrame([("1", 1), ("1", -1), ("2", 0)], "insight_id string, vote int")
    assert rows_of(I.vote_statistics(insights, votes)) == [("a", 1, 1), ("b", 0, 0)]
    assert rows_of(I.apply_votes(insights, votes).select("id", "votes_up", "votes_down")) == [
        ("1", 2, 1), ("2", 0, 1), ("3", 0, 0),
    ]


def insight_rows(spark, rows):
    df = spark.createDataFrame(rows, "id string, run_id string, severity string, t int")
    return df.select(
        "id", "run_id", "severity", F.concat(F.lit("T"), "id").alias("title"), F.lit("text").alias("description"),
        F.lit('["loss"]').alias("related_metrics"), F.timestamp_seconds(F.col("t")).alias("timestamp"),
    )


def test_feed(spark):
    runs = runs_frame(spark, [(str(i), f"n{i}", "running", i) for i in range(12)])
    notes = insight_rows(spark, [(f"{r}-{k}", str(r), "info", 100 * r + k) for r in range(12) for k in range(7)])
    feed = I.insight_feed(runs, notes).collect()
    assert len(feed) == 20
    assert [r["id"] for r in feed[:6]] == ["11-6", "11-5", "11-4", "11-3", "11-2", "10-6"]
    assert {r["run_id"] for r in I.insight_feed(runs, notes, total=1000).collect()} == {str(i) for i in range(2, 12)}


def test_report(spark, series):
    runs = runs_frame(spark, [("r", "run", "completed", 1), ("empty", "e", "running", 2)])
    tags = spark.createDataFrame([("r", "b"), ("r", "a")], "run_id string, tag string")
    metrics = series({"loss": [1, 2, 3], "one": [5]})
    notes = insight_rows(spark, [("1", "r", "critical", 10), ("2", "r", "info", 20), ("3", "gone", "info", 1)])
    lines = I.run_report(runs, tags, metrics, notes)
    text = "\n".join(
        r["line"] for r in lines.where("run_id = 'r'").orderBy("section", "item").collect()
    )
    assert text.startswith("# Run Report: run\n\n**ID:** r\n**Project:** p\n**Status:** completed\n")
    assert "**Duration:** 12s\n**Tags:** a, b" in text
    assert "### loss\n- Count: 3\n- Min: 1.0000\n- Max: 3.0000\n- Mean: 2.0000\n- Std: 1.0000" in text
    assert "### one\n- Count: 1" in text and "- Std: undefined" in text
    assert text.index("🔵 T2") < text.index("🔴 T1")  # newest first
    assert lines.where("run_id = 'gone'").count() == 0
    assert lines.where("run_id = 'empty' AND section > 0").count() == 0


def test_report_head_needs_no_join(spark, series):
    """Head lines come from a run's own row, also for ids that repeat; only tags, by bare ids, and the rest are joined."""
    runs = runs_frame(spark, [("r", "one", "running", 1), ("r", "two", "running", 2), (None, "x", "running", 3), ("s", "three", "running", 4)])
    tags = spark.createDataFrame([("r", "b"), ("r", "a"), ("r", "b"), ("s", None), (None, "n"), ("gone", "g")], "run_id string, tag string")
    given = runs, tags, series({"loss": [1]}, run_id="s"), insight_rows(spark, [("1", "r", "info", 1)])
    lines = I.run_report(*given)
    assert rows_of(I.run_report(*given, task_rows=1)) == rows_of(lines)  # ids and tags in more tasks
    head = rows_of(lines.where("section = 0 AND item IN ('0000', '0007', '0011')").select("run_id", "item", "line"))
    metrics = "## Metrics Summary\n"
    assert head == [
        ("r", "0000", "# Run Report: one"), ("r", "0000", "# Run Report: two"), ("r", "0007", "**Tags:** a, b"), ("r", "0007", "**Tags:** a, b"),
        ("r", "0011", metrics), ("r", "0011", metrics), ("s", "0000", "# Run Report: three"), ("s", "0007", "**Tags:** "), ("s", "0011", metrics),
    ]
    assert rows_of(lines.where("section > 0").select("run_id", "section")) == [("r", 2), ("r", 3), ("s", 1)]
    plan = lines._jdf.queryExecution().executedPlan().toString()
    before, found, _ = plan.partition("Generate posexplode")
    assert found and "Join" not in before


def test_dashboard(spark, series):
    runs = runs_frame(spark, [("r", "run", "running", 1)])
    metrics = series({f"m{i:02}": [1, 2] for i in range(12)})
    assert I.dashboard_points(metrics, runs).select("name").distinct().count() == 10
    assert I.dashboard_points(metrics, runs, first=None).count() == 24
    assert I.dashboard_points(metrics, runs, names=["m11"]).count() == 2


def test_template_insights(series):
    m = series({"train_loss": [3, 2, 1], "val_loss": [1, 2, 3], "gpu_utilization": [60, 65, 50]})
    rows = {r["scenario"]: r for r in I.template_insights(m).collect()}
    assert set(rows) == {"overfitting_detected", "gpu_underutilized"}
    assert rows["overfitting_detected"]["severity"] == "warning"
    worded = I.word_scenarios(m.select(F.lit("lr_too_low").alias("scenario")).limit(1)).first()
    assert worded["title"] == "Learning Rate May Be Too Low"
