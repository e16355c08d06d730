"""Metric queries: look-ups, statistics, windows and comparisons over all series at once.

A series is ``(run_id, name)`` ordered by ``step``; where steps repeat, the
timestamp and then the value break the tie.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions import expressions as X
from metricloom.operators.ordered import (
    HOT_ROWS,
    QUANTILE_ROWS,
    GroupProfile,
    OrderedGroups,
    exact_quantiles,
    profile_groups,
)
from metricloom.session import ensure_checkpoint_dir

SERIES = ["run_id", "name"]


def series_order(df: DataFrame) -> list[str]:
    return [c for c in ("step", "timestamp", "value") if c in df.columns]


def ordered_series(
    metrics: DataFrame, profile: GroupProfile | None = None, hot_rows: int = HOT_ROWS
) -> OrderedGroups:
    return OrderedGroups(metrics, SERIES, series_order(metrics), profile, hot_rows)


# -- look-ups ----------------------------------------------------------------


def metric_range(
    metrics: DataFrame,
    name: str,
    start_step: int | None = None,
    end_step: int | None = None,
    limit: int | None = None,
    run_id: str | None = None,
) -> DataFrame:
    """Points of a metric with inclusive step bounds, in step order.

    The conditions are plain column comparisons, so they reach the Parquet scan.
    """
    out = metrics.where(F.col("name") == name)
    if run_id is not None:
        out = out.where(F.col("run_id") == run_id)
    if start_step is not None:
        out = out.where(F.col("step") >= start_step)
    if end_step is not None:
        out = out.where(F.col("step") <= end_step)
    out = out.orderBy("step")
    return out if limit is None else out.limit(limit)


def latest_points(metrics: DataFrame, n: int = 1) -> DataFrame:
    """The newest ``n`` points of each series, ``rank`` 1 being the latest.

    The rank filter is applied per input partition before the shuffle, so a long
    series sends at most ``n`` rows per partition.
    """
    w = Window.partitionBy(*SERIES).orderBy(*[F.desc(c) for c in series_order(metrics)])
    return metrics.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def metric_names(metrics: DataFrame) -> DataFrame:
    return metrics.select(*SERIES).distinct().orderBy(*SERIES)


def first_names(metrics: DataFrame, k: int) -> DataFrame:
    """The first ``k`` metric names of each run in alphabetical order."""
    w = Window.partitionBy("run_id").orderBy("name")
    names = metrics.select(*SERIES).distinct()
    return names.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def step_range(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("run_id").agg(
        F.min("step").alias("min_step"), F.max("step").alias("max_step")
    )


def thin_every(metrics: DataFrame, freq: int) -> DataFrame:
    """Keep the steps a logger with this frequency would keep."""
    return metrics.where(F.pmod(F.col("step"), F.lit(freq)) == 0)


# -- statistics --------------------------------------------------------------


def series_statistics(
    metrics: DataFrame, profile: GroupProfile | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Count, min, max, mean, sample deviation and interpolated median per series."""
    profile = profile or profile_groups(metrics, SERIES)
    basics = [
        F.count(F.lit(1)).alias("count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
    ]
    if not profile.is_hot(min(hot_rows, QUANTILE_ROWS)):
        return metrics.groupBy(*SERIES).agg(*basics, F.percentile("value", 0.5).alias("median"))
    medians = exact_quantiles(metrics, SERIES, "value", {"median": 0.5}, profile, hot_rows)
    return metrics.groupBy(*SERIES).agg(*basics).join(medians, SERIES, "left")


def bucket_values(metrics: DataFrame, width: int, how: str = "mean") -> DataFrame:
    """One value per series and step bucket: ``mean``, ``min``, ``max`` or ``last``."""
    value = {
        "mean": F.avg("value"),
        "min": F.min("value"),
        "max": F.max("value"),
        "last": F.max_by("value", F.struct(*series_order(metrics))),
    }[how]
    bucket = F.floor(F.col("step") / width).cast("long")
    return metrics.groupBy(*SERIES, bucket.alias("bucket")).agg(value.alias("value"))


# -- windows -----------------------------------------------------------------


def moving_average(
    metrics: DataFrame,
    window_size: int = 100,
    profile: GroupProfile | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Average over the current and the ``window_size - 1`` preceding points."""
    before = window_size - 1
    columns = [c for c in ("run_id", "name", "step", "timestamp", "value") if c in metrics.columns]
    ordered = ordered_series(metrics.select(*columns), profile, hot_rows)
    return (
        ordered.frames(
            before, 0, lambda w: {"moving_avg": F.avg("value").over(w.rowsBetween(-before, 0))}
        )
        .result()
        .select(*SERIES, "step", "value", "moving_avg")
    )


def live_metrics(
    metrics: DataFrame, runs: DataFrame, max_runs: int | None = 10, max_names: int | None = 5
) -> DataFrame:
    """Latest value of each series of the newest running runs, with its direction.

    ``None`` for a limit means all runs or all metrics.
    """
    active = runs.where(F.col("status") == "running")
    if max_runs is not None:
        active = active.orderBy(F.desc("created_at"), F.desc("id")).limit(max_runs)
    active = active.select(F.col("id").alias("run_id"), F.col("name").alias("run_name"))
    shown = metrics.join(active.select("run_id"), "run_id", "left_semi")
    if max_names is not None:
        keep = first_names(shown, max_names).select(*SERIES)
        shown = shown.join(keep, SERIES, "left_semi")
    pairs = latest_points(shown.select(*SERIES, *series_order(shown)), 2)
    now, before = F.col("rank") == 1, F.col("rank") == 2
    out = pairs.groupBy(*SERIES).agg(
        F.max(F.when(now, F.col("value"))).alias("value"),
        F.max(F.when(now, F.col("step"))).alias("step"),
        F.max(F.when(before, F.col("value"))).alias("previous"),
    )
    return out.join(active, "run_id").select(
        *SERIES,
        "run_name",
        "step",
        "value",
        trend(F.col("value"), F.col("previous")).alias("trend"),
        F.concat(X.short_number(F.col("value")), F.lit(" @ step "), F.col("step")).alias("label"),
    )


def trend(value: Column, previous: Column) -> Column:
    return F.when(value > previous, "up").when(value < previous, "down").otherwise("flat")


# -- ingest shaping ----------------------------------------------------------


def coerce_values(metrics: DataFrame) -> DataFrame:
    """Numbers become doubles, anything else null; maps become JSON text."""
    out = metrics.withColumn("value", F.expr("try_cast(value AS double)"))
    if "metadata" in out.columns and out.schema["metadata"].dataType.typeName() in ("map", "struct"):
        out = out.withColumn("metadata", F.to_json("metadata"))
    return out


def melt(
    wide: DataFrame,
    ids: Sequence[str],
    values: Sequence[str],
    shapes: Sequence[str] = (),
) -> DataFrame:
    """One metric row per value column; shape columns give ``<name>/shape`` rows.

    All rows come from a single pass: one array of (name, value, metadata)
    entries is exploded per input row.
    """
    entries = [
        F.struct(
            F.lit(c).alias("name"),
            F.col(c).cast("double").alias("value"),
            F.lit(None).cast("string").alias("metadata"),
        )
        for c in values
    ]
    entries += [
        F.struct(
            F.lit(f"{c}/shape").alias("name"),
            X.shape_product(F.col(c)).cast("double").alias("value"),
            F.to_json(F.struct(F.col(c).alias("shape"))).alias("metadata"),
        )
        for c in shapes
    ]
    rows = wide.select(*ids, F.explode(F.array(*entries)).alias("_m"))
    return rows.select(*ids, "_m.*").where(F.col("value").isNotNull())


def autonumber_steps(
    rows: DataFrame,
    arrival: str,
    step: str = "step",
    run: str = "run_id",
    profile: GroupProfile | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Fill missing steps the way a run's counter does.

    A row without a step takes the counter and moves it on by one; a row with
    step *s* lifts the counter to at least *s + 1*. With ``N`` the number of
    step-less rows so far, the counter before a row is ``N + max(0, max over
    earlier numbered rows of (s + 1 - N at that row))``: two running aggregates.
    """
    missing = F.col(step).isNull()
    ordered = OrderedGroups(rows, [run], [arrival], profile, hot_rows)
    ordered = ordered.running("_nulls", "sum", F.when(missing, 1).otherwise(0).cast("long"))
    nulls = F.coalesce(F.col("_nulls"), F.lit(0))
    ordered = ordered.running("_lift", "max", F.when(~missing, F.col(step) + 1 - nulls))
    counter = nulls + F.greatest(F.lit(0), F.coalesce(F.col("_lift"), F.lit(0)))
    out = ordered.result().withColumn(step, F.coalesce(F.col(step), counter).cast("long"))
    return out.drop("_nulls", "_lift")


# Keys a trainer reports once per run, and key rewrites.
RUNTIME_KEYS = ("train_runtime", "train_samples_per_second", "train_steps_per_second")


def normalise_log_keys(logs: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Trainer log keys to metric names; run-time keys and non-numbers are dropped."""
    k = F.col(key)
    slashed = F.replace(F.replace(k, F.lit("train_"), F.lit("train/")), F.lit("eval_"), F.lit("eval/"))
    name = F.when(k.contains("learning_rate") & ~k.contains("loss"), "learning_rate")
    return (
        logs.where(~k.isin(*RUNTIME_KEYS))
        .withColumn("name", name.otherwise(slashed))
        .withColumn("value", F.expr(f"try_cast({value} AS double)"))
        .where(F.col("value").isNotNull())
    )


def evaluation_keys(logs: DataFrame, key: str = "key") -> DataFrame:
    """Evaluation results are filed under ``eval/``."""
    bare = F.replace(F.col(key), F.lit("eval_"), F.lit(""))
    return logs.withColumn("name", F.concat(F.lit("eval/"), bare))


def stage_metrics(metrics: DataFrame, stage: str) -> DataFrame:
    """Metrics whose name mentions ``val`` or ``test``, whatever the case."""
    return metrics.where(F.lower("name").contains(stage))


def token_throughput(metrics: DataFrame, seq_length: int = 512) -> DataFrame:
    """Tokens per second from samples per second."""
    rows = metrics.where(F.col("name") == "train_samples_per_second")
    entries = F.array(
        F.struct(
            F.lit("throughput/tokens_per_second").alias("name"),
            (F.col("value") * seq_length).alias("value"),
        ),
        F.struct(F.lit("throughput/samples_per_second").alias("name"), F.col("value").alias("value")),
    )
    return rows.select("run_id", "step", F.explode(entries).alias("_m")).select(
        "run_id", "step", "_m.*"
    )


def named_rows(events: DataFrame, ids: Sequence[str], names: dict[str, str]) -> DataFrame:
    """Event rows to metric rows: ``names`` maps metric name to source column."""
    entries = [
        F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value"))
        for n, c in names.items()
    ]
    return (
        events.select(*ids, F.explode(F.array(*entries)).alias("_m"))
        .select(*ids, "_m.*")
        .where(F.col("value").isNotNull())
    )


# Metric names of callback events.
CHECKPOINT_ROWS = {"checkpoint/epoch": "epoch", "checkpoint/global_step": "global_step"}
SAVE_ROWS = {"checkpoint/step": "global_step", "checkpoint/best_metric": "best_metric"}
EPOCH_ROWS = {"epoch": "epoch"}
SUMMARY_ROWS = {"summary/total_steps": "global_step", "summary/total_tokens": "total_tokens"}


def compile_time_rows(events: DataFrame, fn: str = "fn", millis: str = "time_ms") -> DataFrame:
    return events.select(
        "run_id",
        "step",
        F.concat(F.lit("jit/"), F.col(fn), F.lit("_compile_ms")).alias("name"),
        F.col(millis).cast("double").alias("value"),
    )


def learning_rate_rows(events: DataFrame, rates: str = "lrs") -> DataFrame:
    """``learning_rate`` for one group, ``learning_rate/group_i`` for several."""
    many = F.size(rates) > 1
    out = events.select("run_id", "step", many.alias("_many"), F.posexplode(rates).alias("_i", "value"))
    name = F.when(
        F.col("_many"), F.concat(F.lit("learning_rate/group_"), F.col("_i"))
    ).otherwise("learning_rate")
    return out.select("run_id", "step", name.alias("name"), F.col("value").cast("double").alias("value"))


def device_memory_rows(stats: DataFrame, kind: str = "gpu") -> DataFrame:
    """Device memory bytes to metric rows; the prefix appears with several devices.

    ``stats`` has run_id, step, device, device_count, allocated, reserved and
    max_allocated (bytes).
    """
    prefix = X.device_prefix(kind, F.col("device"), F.col("device_count"))
    entries = [
        F.struct(
            F.concat(prefix, F.lit(f"memory/{c}_gb")).alias("name"),
            X.bytes_to_gb(F.col(c)).alias("value"),
        )
        for c in ("allocated", "reserved", "max_allocated")
    ]
    return stats.select("run_id", "step", F.explode(F.array(*entries)).alias("_m")).select(
        "run_id", "step", "_m.*"
    )


# -- comparison --------------------------------------------------------------


def compare_runs(metrics: DataFrame, run_ids: Sequence[str], name: str) -> DataFrame:
    """Points of one metric for several runs, one row per run and step."""
    return metrics.where((F.col("name") == name) & F.col("run_id").isin(*run_ids)).select(
        "run_id", "step", "value"
    )


def compare_runs_wide(
    metrics: DataFrame, run_ids: Sequence[str], name: str, width: int = 1
) -> DataFrame:
    """One row per step (or step bucket) and one column per run; gaps are null.

    One grouped aggregate does the N-way outer join on the step.
    """
    points = compare_runs(metrics, run_ids, name)
    step = F.floor(F.col("step") / width).cast("long") if width > 1 else F.col("step")
    first = [
        F.min_by("value", F.when(F.col("run_id") == r, F.col("step"))).alias(r) for r in run_ids
    ]
    return points.groupBy(step.alias("step")).agg(*first)


def leaderboard(metrics: DataFrame, name: str) -> DataFrame:
    """Runs ranked by their best (lowest) value of a metric."""
    per_run = (
        metrics.where(F.col("name") == name)
        .groupBy("run_id")
        .agg(
            F.min("value").alias("best"),
            F.max_by("value", F.struct(*series_order(metrics))).alias("final"),
            F.count(F.lit(1)).alias("points"),
        )
    )
    return rank_runs(per_run)


def rank_runs(per_run: DataFrame) -> DataFrame:
    """Competition rank by ``best``: one more than the number of strictly better runs.

    NaN comes after all numbers; runs without any value come last and share a rank.

    Runs are few compared with points, yet not bounded, so the rank is read from
    a running count over distinct best values instead of one window over all runs.
    """
    valued = per_run.where(F.col("best").isNotNull())
    by_best = valued.groupBy("best").agg(F.count(F.lit(1)).alias("_runs"))
    one = by_best.withColumn("_all", F.lit(1))
    ahead = OrderedGroups(one, ["_all"], ["best"]).running("_ahead", "sum", F.col("_runs")).result()
    ranked = ahead.select("best", (F.coalesce(F.col("_ahead"), F.lit(0)) + 1).alias("rank"))
    last = F.lit(valued.count() + 1)
    return per_run.join(ranked, "best", "left").withColumn("rank", F.coalesce("rank", last))


# -- chart thinning ----------------------------------------------------------


#: Candidates of one series that its sequential choice may hold; more are narrowed first.
CANDIDATES = 1_000_000
#: Passes of the corner filter over a batch; whatever is left is a superset of the corners.
CORNER_PASSES = 200
_POINT = "run_id string, name string, bucket long, idx long, step long, value double"


def _corners(points: pd.DataFrame) -> pd.DataFrame:
    """Rows that may be corners of the convex hull of their bucket, for many buckets at once.

    A point between two others in x is no corner of the upper hull if it is not above their line, and
    none of the lower hull if it is not below. Such points leave in passes over every other row, so both
    neighbours of a row that leaves are still there. First and last rows of a bucket stay.
    """
    points = points.sort_values(["run_id", "name", "bucket", "idx"], ignore_index=True)
    keys = points[["run_id", "name", "bucket"]]
    new = np.ones(len(points), bool)
    new[1:] = (keys.iloc[1:].to_numpy() != keys.iloc[:-1].to_numpy()).any(axis=1)
    group = np.cumsum(new)
    x, y = points["step"].to_numpy(float), points["value"].to_numpy(float)
    keep = np.zeros(len(points), bool)
    for sign in (1.0, -1.0):
        left, idle, parity = np.arange(len(points)), 0, 0
        for _ in range(CORNER_PASSES):
            mid = np.arange(1 + parity, len(left) - 1, 2)
            a, b, c = left[mid - 1], left[mid], left[mid + 1]
            inner = (group[a] == group[c]) & (x[a] != x[c])
            side = (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])
            out = mid[inner & (sign * side >= 0)]
            idle = 0 if len(out) else idle + 1
            if idle == 2:
                break
            left, parity = np.delete(left, out), 1 - parity
        keep[left] = True
    return points[keep]


def _area(ax, ay, bx, by, cx, cy):
    """Twice the signed area of a triangle; columns and arrays alike."""
    return (ax - cx) * (by - ay) - (ax - bx) * (cy - ay)


def _narrow(candidates: DataFrame) -> DataFrame:
    """Drop candidates that cannot be chosen, whichever candidate of the bucket before is.

    The area is linear in the earlier point, so over the box of the earlier candidates its size is
    largest at a box corner, and smallest at one unless the sign changes. A candidate whose largest
    size stays below another's smallest is out. A bucket behind a settled one is settled by one round.
    """
    box = candidates.groupBy(*SERIES, (F.col("bucket") + 1).alias("bucket")).agg(
        F.min("step").cast("double").alias("_x0"),
        F.max("step").cast("double").alias("_x1"),
        F.min("value").alias("_y0"),
        F.max("value").alias("_y1"),
    )
    b = (F.col("step").cast("double"), F.col("value"), F.col("cx"), F.col("cy"))
    areas = [_area(F.col(x), F.col(y), *b) for x in ("_x0", "_x1") for y in ("_y0", "_y1")]
    low, high = F.least(*areas), F.greatest(*areas)
    smallest = F.when((low < 0) & (high > 0), 0.0).otherwise(F.least(F.abs(low), F.abs(high)))
    rated = candidates.join(box, [*SERIES, "bucket"], "left").withColumns(
        {"_most": F.greatest(F.abs(low), F.abs(high)), "_least": smallest}
    )
    bar = rated.groupBy(*SERIES, "bucket").agg(F.max("_least").alias("_bar"))
    kept = rated.join(bar, [*SERIES, "bucket"]).where(
        F.col("_bar").isNull() | (F.col("_most") >= F.col("_bar") * (1 - 1e-9))
    )
    return kept.select(*candidates.columns)


def _walk(points: pd.DataFrame) -> pd.DataFrame:
    """The triangle rule over the candidates of one series, bucket after bucket."""
    points = points.sort_values(["bucket", "idx"], ignore_index=True)
    x, y = points["step"].to_numpy(float), points["value"].to_numpy(float)
    cx, cy = points["cx"].to_numpy(float), points["cy"].to_numpy(float)
    bucket = points["bucket"].to_numpy()
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    keep = [0]
    for lo, hi in zip(starts[1:], [*starts[2:], len(points)]):
        a = keep[-1]
        keep.append(lo + int(np.abs(_area(x[a], y[a], x[lo:hi], y[lo:hi], cx[lo], cy[lo])).argmax()))
    return points.iloc[keep][["run_id", "name", "step", "value"]]


def downsample(
    metrics: DataFrame,
    points: int = 10_000,
    profile: GroupProfile | None = None,
    hot_rows: int = HOT_ROWS,
    most_candidates: int = CANDIDATES,
) -> DataFrame:
    """At most ``points`` (3 or more) points per series, by the largest-triangle-three-buckets rule.

    One rule for every length. For a fixed earlier point and mean of the next bucket the area is the
    size of a linear function, so its largest value in a bucket lies on the bucket's convex hull: only
    hull corners are carried to the choice, which alone goes from bucket to bucket. Corners are found
    batch by batch where the rows lie, then per bucket. Should a series still have more than
    ``most_candidates`` (a smooth curve is all corners), they are narrowed until it has not. Ties go to
    the earlier point. Null and non-finite values take no part; shorter series stay whole.
    """
    if points < 3:
        raise ValueError("a thinned curve has 3 points or more")
    finite = F.abs("value") < float("inf")
    source = metrics.where(finite).select(*SERIES, *series_order(metrics))
    df = ordered_series(source, profile, hot_rows).index().result().select(*SERIES, "step", "value", "idx", "n")
    whole = df.where(F.col("n") <= points).select(*SERIES, "step", "value")

    # Bucket 0 is the first point, the last bucket the last point; between them ``inner`` of equal length.
    inner = points - 2
    place = F.expr(f"(idx * {inner} - 1) div (n - 2)") + 1
    bucket = F.when(F.col("idx") == 0, 0).when(F.col("idx") == F.col("n") - 1, points - 1).otherwise(place)
    long = df.where(F.col("n") > points).select(*SERIES, bucket.cast("long").alias("bucket"), "idx", "step", "value")
    ensure_checkpoint_dir(metrics.sparkSession)
    centres = long.groupBy(*SERIES, (F.col("bucket") - 1).alias("bucket")).agg(
        F.avg("step").alias("cx"), F.avg("value").alias("cy")
    )
    corners = (
        long.mapInPandas(lambda batches: map(_corners, batches), _POINT)
        .groupBy(*SERIES, "bucket")
        .applyInPandas(_corners, _POINT)
        .join(centres, [*SERIES, "bucket"], "left")
        .checkpoint()
    )
    for _ in range(points):
        most = corners.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("_c")).agg(F.max("_c")).first()[0] or 0
        if most <= max(most_candidates, points):
            break
        corners = _narrow(corners).checkpoint()
    thin = corners.groupBy(*SERIES).applyInPandas(_walk, "run_id string, name string, step long, value double")
    return whole.unionByName(thin)
