"""Whole and split plans of the ordered primitives agree; both agree with plain Python."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows_of
from metricloom.operators import anomalies as D
from metricloom.operators import insights as I
from metricloom.operators import metrics as M
from metricloom.operators import patterns as P
from metricloom.operators.ordered import GroupProfile, OrderedGroups, exact_quantiles, profile_groups
from metricloom.sources import driver_tables as tables

KEYS = ["run_id", "name"]


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, with repeated order values."""
    df = spark.range(4000).select(
        F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("g"),
        F.floor(F.col("id") / 3).alias("o"),
        F.col("id").alias("tie"),
        ((F.col("id") * 37) % 101).cast("double").alias("v"),
    )
    return df.repartition(7)


def test_profile(skewed):
    profile = profile_groups(skewed, ["g"])
    sizes = {r["g"]: r["count"] for r in skewed.groupBy("g").count().collect()}
    assert profile == GroupProfile(len(sizes), max(sizes.values()))


@pytest.mark.parametrize("block", [64, 1000])
def test_split_equals_whole(skewed, block):
    def build(hot_rows):
        ordered = OrderedGroups(skewed, ["g"], ["o", "tie"], hot_rows=hot_rows, block_rows=block)
        ordered = ordered.index().running("total", "sum", F.col("v")).running("top", "max", F.col("v"))
        ordered = ordered.attach(mean=F.avg("v"))
        ordered = ordered.frames(
            5,
            4,
            lambda w: {
                "near": F.sum("v").over(w.rowsBetween(-5, 4)),
                "prev": F.lag("v", 2).over(w),
                "next": F.lead("v", 4).over(w),
            },
        )
        assert ordered.split is (hot_rows == 10)
        return ordered.result().select(
            "g", "tie", "idx", "n", "total", "top", F.round("mean", 9), "near", "prev", "next"
        )

    assert rows_of(build(10)) == rows_of(build(10**9))


def test_split_index_is_dense(skewed):
    out = OrderedGroups(skewed, ["g"], ["o", "tie"], hot_rows=10).index().result()
    bad = out.groupBy("g").agg(
        F.count_distinct("idx").alias("d"), F.max("idx").alias("m"), F.first("n").alias("n")
    ).where("d <> n OR m <> n - 1")
    assert bad.count() == 0


def test_frames_need_room(skewed):
    ordered = OrderedGroups(skewed, ["g"], ["o", "tie"], hot_rows=10, block_rows=5)
    with pytest.raises(ValueError):
        ordered.frames(5, 0, lambda w: {})


@pytest.mark.parametrize("hot_rows", [5, 10**9])
def test_quantiles_match_numpy(spark, hot_rows):
    rng = np.random.default_rng(3)
    groups = {
        "a": rng.exponential(5, 301),
        "b": np.repeat([1.0, 2.0], 50),
        "c": np.array([4.0]),
        "d": rng.normal(0, 1, 30_000),
        "e": rng.integers(0, 3, 20_000).astype(float),
        "f": np.concatenate([rng.normal(0, 1e-6, 10_000), [1e12, -1e12]]),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None)]
    frame = pd.DataFrame(rows, columns=["g", "v"]).astype({"v": "float64"})
    df = spark.createDataFrame(frame).select("g", F.nanvl("v", F.lit(None)).alias("v")).repartition(5)
    probs = {"q1": 0.25, "median": 0.5, "q9": 0.9}
    out = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", probs, hot_rows=hot_rows).collect()}
    for g, vs in groups.items():
        for name, p in probs.items():
            assert out[g][name] == pytest.approx(np.percentile(vs, p * 100), rel=1e-12)


def test_operators_agree_when_split(spark, small):
    """Detectors, patterns and statistics give the same rows on either plan."""
    metrics = tables.metrics(spark, small)
    more = metrics
    for i in range(1, 4):  # longer series, so that rules apply
        more = more.unionByName(metrics.withColumn("step", F.col("step") + 1000 * i))
    key = ["run_id", "metric_name", "step", "anomaly_type", "severity"]
    pairs = [
        (lambda h: M.series_statistics(more, hot_rows=h).select(*KEYS, "count", "min", "max", F.round("median", 6))),
        (lambda h: M.moving_average(more, 30, hot_rows=h).select(*KEYS, "step", F.round("moving_avg", 4))),
        (lambda h: D.detect_anomalies(more, hot_rows=h).select(*key, F.round("confidence", 6))),
        (lambda h: P.detect_patterns(more, hot_rows=h).select(*KEYS, "pattern_type", "start_step", "end_step")),
        (lambda h: I.spike_regularity(D.outliers(more, hot_rows=h), hot_rows=h).select("run_id", "spikes", F.round("std_interval", 6))),
        (lambda h: M.downsample(more, 10, hot_rows=h)),
    ]
    for build in pairs:
        assert rows_of(build(20)) == rows_of(build(10**9))


def test_results_do_not_depend_on_layout_or_other_runs(spark, small):
    """Other partitions, other row order, or the same run under a second id: same rows."""
    metrics = tables.metrics(spark, small)
    twin = metrics.withColumn("run_id", F.concat(F.lit("twin-"), "run_id"))
    key = ["metric_name", "step", "anomaly_type", "severity", "detector"]
    base = rows_of(D.detect_anomalies(metrics, min_samples=10).select("run_id", *key))
    assert base
    shuffled = metrics.orderBy(F.rand(3)).repartition(11)
    assert rows_of(D.detect_anomalies(shuffled, min_samples=10).select("run_id", *key)) == base
    both = D.detect_anomalies(metrics.unionByName(twin), min_samples=10)
    again = both.where(F.col("run_id").startswith("twin-")).withColumn(
        "run_id", F.substring("run_id", 6, 10)
    )
    assert rows_of(again.select("run_id", *key)) == base


def counter(steps):
    """The run counter, row by row."""
    at, out = 0, []
    for s in steps:
        if s is None:
            out.append(at)
            at += 1
        else:
            out.append(s)
            at = max(at, s + 1)
    return out


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.one_of(st.none(), st.integers(0, 30)), min_size=1, max_size=12), min_size=1, max_size=20))
def test_autonumber_equals_counter(spark, runs):
    rows = [(str(r), i, s) for r, steps in enumerate(runs) for i, s in enumerate(steps)]
    df = spark.createDataFrame(rows, "run_id string, i long, step long").repartition(4)
    want = sorted((str(r), i, s) for r, steps in enumerate(runs) for i, s in enumerate(counter(steps)))
    for hot_rows in (3, 10**9):
        out = M.autonumber_steps(df, "i", hot_rows=hot_rows).select("run_id", "i", "step")
        assert sorted(tuple(r) for r in out.collect()) == want


def test_autonumber_card(spark):
    rows = [("r", i, s) for i, s in enumerate([None, None, 10, None, 3, None])]
    df = spark.createDataFrame(rows, "run_id string, i long, step long")
    out = M.autonumber_steps(df, "i").orderBy("i").collect()
    assert [r["step"] for r in out] == [0, 1, 10, 11, 3, 12]
