"""Anomaly detection over all metric series in one job."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from metricloom.functions import expressions as X
from metricloom.operators.metrics import SERIES, ordered_series, series_order
from metricloom.operators.ordered import (
    HOT_ROWS,
    GroupProfile,
    OrderedGroups,
    attach_groups,
    exact_quantiles,
)
from metricloom.session import ensure_checkpoint_dir

# Detector rules.
MIN_SAMPLES = 30
RECENT_ROWS = 10
PLATEAU_ROWS = 50
PLATEAU_THRESHOLD = 0.001
LOOK_AHEAD = (1, 5, 13, 29, 49)
DIVERGENCE_EDGE = 10
DIVERGENCE_FACTOR = 10.0
IQR_CONFIDENCE = 0.7
PLATEAU_CONFIDENCE = 0.8
DIVERGENCE_CONFIDENCE = 0.9
# Rules for the two gradient types the type list names without a rule.
EXPLODING_NORM = 10.0
VANISHING_NORM = 1e-7

# Anomaly types.
TYPES = [
    "loss_spike",
    "loss_plateau",
    "loss_divergence",
    "loss_nan",
    "gradient_explosion",
    "gradient_vanishing",
    "gradient_nan",
    "learning_rate_issue",
    "metric_discontinuity",
    "unusual_pattern",
    "performance_degradation",
]

# Texts by anomaly type.
DESCRIPTIONS = {
    "loss_spike": "Sudden spike in %1$s to %2$.4f at step %3$d",
    "loss_plateau": "%1$s has plateaued around %2$.4f",
    "loss_divergence": "%1$s is diverging (%2$.4f)",
    "loss_nan": "NaN/Inf detected in %1$s at step %3$d",
    "gradient_explosion": "Gradient explosion detected at step %3$d",
    "gradient_vanishing": "Vanishing gradients detected at step %3$d",
    "unusual_pattern": "Unusual value in %1$s: %2$.4f",
}
ACTIONS = {
    "loss_spike": [
        "Check for corrupted data batches",
        "Verify data augmentation parameters",
        "Consider gradient clipping",
        "Review recent model changes",
    ],
    "loss_plateau": [
        "Try increasing learning rate",
        "Add learning rate warmup or decay",
        "Check for mode collapse (if GAN)",
        "Increase model capacity",
    ],
    "loss_divergence": [
        "Reduce learning rate immediately",
        "Enable gradient clipping",
        "Check for numerical instability",
        "Verify loss function implementation",
    ],
    "loss_nan": [
        "Check for division by zero",
        "Add epsilon to log operations",
        "Use mixed precision carefully",
        "Verify input data normalization",
    ],
    "gradient_explosion": [
        "Enable gradient clipping (max_norm=1.0)",
        "Reduce learning rate",
        "Use gradient scaling with AMP",
        "Check model initialization",
    ],
    "gradient_vanishing": [
        "Use skip connections (ResNet style)",
        "Try different activation functions (GELU, SiLU)",
        "Use gradient checkpointing",
        "Check layer normalization",
    ],
}
DEFAULT_ACTIONS = ["Investigate metric history"]
RELATED_TO_LOSS = ["learning_rate", "gradient_norm", "accuracy"]
RELATED_TO_GRADIENT = ["loss", "learning_rate", "weight_norm"]
NONFINITE_ACTIONS = ["Check for numerical instability"]
PLATEAU_ACTIONS = ["Consider adjusting learning rate", "Check for underfitting"]
DIVERGENCE_ACTIONS = ["Immediately reduce learning rate", "Enable gradient clipping"]
PLATEAU_RELATED = ["learning_rate"]
DIVERGENCE_RELATED = ["gradient_norm", "learning_rate"]

COLUMNS = [
    "id",
    "run_id",
    "metric_name",
    "step",
    "value",
    "anomaly_type",
    "severity",
    "expected_range",
    "confidence",
    "description",
    "suggested_actions",
    "related_metrics",
    "detector",
]


def z_threshold(sensitivity: float = 0.8) -> float:
    return 4.0 - sensitivity * 2


def iqr_multiplier(sensitivity: float = 0.8) -> float:
    return 2.5 - sensitivity * 1.5


def _texts(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def description(kind: Column, metric: Column, value: Column, step: Column) -> Column:
    out = None
    for name, pattern in DESCRIPTIONS.items():
        text = F.format_string(pattern, metric, value, step)
        out = F.when(kind == name, text) if out is None else out.when(kind == name, text)
    return out.otherwise(F.concat(F.lit("Anomaly in "), metric))


def suggested_actions(kind: Column) -> Column:
    out = None
    for name, words in ACTIONS.items():
        out = (F.when if out is None else out.when)(kind == name, _texts(words))
    return out.otherwise(_texts(DEFAULT_ACTIONS))


def related_metrics(metric: Column) -> Column:
    low = F.lower(metric)
    return (
        F.when(low.contains("loss"), _texts(RELATED_TO_LOSS))
        .when(low.contains("gradient"), _texts(RELATED_TO_GRADIENT))
        .otherwise(_texts([]))
    )


def _anomaly(
    df: DataFrame,
    kind: Column,
    severity: Column,
    low: Column,
    high: Column,
    confidence: Column,
    detector: int | Column,
    text: Column | None = None,
    actions: Column | None = None,
    related: Column | None = None,
) -> DataFrame:
    """Result rows; the id is a digest of what makes an anomaly distinct."""
    rank = detector if isinstance(detector, Column) else F.lit(detector)
    name, step, value = F.col("name"), F.col("step"), F.col("value")
    return df.select(
        F.sha2(F.concat_ws("|", "run_id", name, step, kind), 256).alias("id"),
        "run_id",
        name.alias("metric_name"),
        step.alias("step"),
        value.alias("value"),
        kind.alias("anomaly_type"),
        severity.alias("severity"),
        F.struct(low.cast("double").alias("lo"), high.cast("double").alias("hi")).alias(
            "expected_range"
        ),
        confidence.cast("double").alias("confidence"),
        (description(kind, name, value, step) if text is None else text).alias("description"),
        (suggested_actions(kind) if actions is None else actions).alias("suggested_actions"),
        (related_metrics(name) if related is None else related).alias("related_metrics"),
        rank.cast("int").alias("detector"),
    )


def finite_points(metrics: DataFrame) -> DataFrame:
    columns = [*SERIES, *series_order(metrics)]
    return metrics.select(*columns).where(X.is_finite(F.col("value")))


@dataclass(frozen=True)
class Measure:
    """What the detectors know about the series before they look at points.

    ``moments`` has one row per series: points, finite, mean, std (population).
    """

    moments: DataFrame
    profile: GroupProfile
    all_finite: bool


def measure_series(metrics: DataFrame) -> Measure:
    """Length, mean and deviation of every series in one narrow scan.

    The per-series table is checkpointed because several detectors and the
    choice of plan read it.
    """
    ensure_checkpoint_dir(metrics.sparkSession)
    finite = F.when(X.is_finite(F.col("value")), F.col("value"))
    moments = (
        metrics.where(F.col("value").isNotNull())
        .groupBy(*SERIES)
        .agg(
            F.count(F.lit(1)).alias("points"),
            F.count(finite).alias("finite"),
            F.avg(finite).alias("mean"),
            F.stddev_pop(finite).alias("std"),
        )
        .checkpoint()
    )
    row = moments.agg(
        F.count(F.lit(1)).alias("groups"),
        F.max("points").alias("largest"),
        F.max(F.col("points") - F.col("finite")).alias("bad"),
    ).first()
    return Measure(moments, GroupProfile(row["groups"], row["largest"] or 0), not row["bad"])


def series_bounds(
    points: DataFrame,
    moments: DataFrame,
    sensitivity: float,
    min_samples: int,
    profile: GroupProfile,
    hot_rows: int,
) -> DataFrame:
    """Z-score and inter-quartile limits of every long enough series."""
    quarters = exact_quantiles(points, SERIES, "value", {"q1": 0.25, "q3": 0.75}, profile, hot_rows)
    long = moments.where(F.col("finite") >= min_samples).select(*SERIES, "mean", "std")
    z, m = z_threshold(sensitivity), iqr_multiplier(sensitivity)
    iqr = F.col("q3") - F.col("q1")
    return attach_groups(quarters, long, SERIES, profile.groups).select(
        *SERIES,
        "mean",
        "std",
        (F.col("mean") - z * F.col("std")).alias("z_lo"),
        (F.col("mean") + z * F.col("std")).alias("z_hi"),
        (F.col("q1") - m * iqr).alias("iqr_lo"),
        (F.col("q3") + m * iqr).alias("iqr_hi"),
    )


def outliers(
    metrics: DataFrame,
    sensitivity: float = 0.8,
    min_samples: int = MIN_SAMPLES,
    measured: Measure | None = None,
    hot_rows: int = HOT_ROWS,
    series: OrderedGroups | None = None,
) -> DataFrame:
    """Z-score outliers (detector 0) and, beyond them, inter-quartile outliers (detector 1).

    Limits come from one small aggregate joined back to the points; only the
    mean of the preceding rows needs an ordered frame. ``series`` may pass in the
    finite points already ordered.
    """
    points = finite_points(metrics)
    measured = measured or measure_series(metrics)
    profile = measured.profile
    bounds = series_bounds(points, measured.moments, sensitivity, min_samples, profile, hot_rows)
    series = series or ordered_series(points, profile, hot_rows)
    recent = series.frames(
        RECENT_ROWS + 1,
        0,
        lambda w: {
            "recent": F.avg("value").over(w.rowsBetween(-RECENT_ROWS, -1)),
            # The rule starts at index 11: eleven earlier rows must exist.
            "_eleventh": F.lag(F.lit(True), RECENT_ROWS + 1).over(w),
        },
    )
    df = attach_groups(recent.result(), bounds, SERIES, profile.groups)
    v = F.col("value")
    z = F.try_divide(F.abs(v - F.col("mean")), F.col("std"))
    by_z = F.coalesce(z > z_threshold(sensitivity), F.lit(False))
    by_iqr = (v < F.col("iqr_lo")) | (v > F.col("iqr_hi"))
    hits = df.where(by_z | by_iqr)
    spike = (v > F.col("mean") * 10) | (
        F.col("_eleventh").isNotNull() & (v > F.col("recent") * 5)
    )
    kind = F.when(spike, "loss_spike").otherwise("unusual_pattern")
    confidence = F.when(by_z, X.clamp_high(z / 5.0)).otherwise(IQR_CONFIDENCE)
    return _anomaly(
        hits,
        kind,
        F.when(confidence > 0.9, "critical").otherwise("warning"),
        F.when(by_z, F.col("z_lo")).otherwise(F.col("iqr_lo")),
        F.when(by_z, F.col("z_hi")).otherwise(F.col("iqr_hi")),
        confidence,
        F.when(by_z, 0).otherwise(1),
    )


def nonfinite(
    metrics: DataFrame,
    min_samples: int = MIN_SAMPLES,
    measured: Measure | None = None,
) -> DataFrame:
    """NaN and infinite points of series that are long enough (detector 2)."""
    measured = measured or measure_series(metrics)
    value = F.col("value")
    bad = metrics.where(value.isNotNull() & ~X.is_finite(value))
    long = measured.moments.where(F.col("points") >= min_samples).select(*SERIES)
    hits = attach_groups(bad, long, SERIES, measured.profile.groups, "left_semi")
    name = F.col("name")
    zero = F.lit(0.0)
    shown = hits.withColumn("value", F.when(F.isnan("value"), 0.0).otherwise(F.col("value")))
    return _anomaly(
        shown,
        F.lit("loss_nan"),
        F.lit("critical"),
        zero,
        zero,
        F.lit(1.0),
        2,
        F.concat(F.lit("NaN/Inf detected in "), name),
        _texts(NONFINITE_ACTIONS),
        _texts([]),
    )


def loss_points(metrics: DataFrame) -> DataFrame:
    columns = [*SERIES, *series_order(metrics)]
    return metrics.select(*columns).where(
        X.is_loss(F.col("name")) & F.col("value").isNotNull()
    )


def _first_plateau(series: OrderedGroups, min_samples: int) -> DataFrame:
    """Earliest flat stretch per series: a frame of PLATEAU_ROWS starting at each row."""
    size = PLATEAU_ROWS
    v = F.col("value")
    # Two values of a frame differ by at most sqrt(2 size) deviations. A flat frame
    # therefore stays within this share of its first value, which a few look-aheads
    # rule out for most rows of a live metric. Only stretches that pass are framed.
    share = PLATEAU_THRESHOLD * math.sqrt(2 * size)
    limit = F.abs(v) * (share / (1 - share) * 1.01)

    def may_be_flat(w: WindowSpec) -> dict[str, Column]:
        close = F.lit(True)
        for k in LOOK_AHEAD:
            close = close & (F.abs(F.lead(v, k).over(w) - v) <= limit)
        return {"_may": F.coalesce(close, F.lit(False))}

    def last_start(w: WindowSpec) -> dict[str, Column]:
        start = F.when(F.col("_may"), F.col("idx"))
        return {"_start": F.max(start).over(w.rowsBetween(Window.unboundedPreceding, 0))}

    stretches = series.frames(size, size - 1, may_be_flat, last_start).keep(
        F.col("idx") - F.col("_start") <= size
    )
    ahead = lambda w: w.rowsBetween(0, size - 1)
    framed = stretches.frames(
        0,
        size,
        lambda w: {
            "_std": F.stddev_pop("value").over(ahead(w)),
            "_abs": F.avg(F.abs("value")).over(ahead(w)),
            "_mean": F.avg("value").over(ahead(w)),
            "_end": F.lead("step", size).over(w),
        },
    ).result()
    flat = framed.where(
        (F.col("n") >= F.greatest(F.lit(min_samples), F.lit(size)))
        & (F.col("idx") < F.col("n") - size)
        & F.col("_may")
        & (F.col("_std") < PLATEAU_THRESHOLD * F.col("_abs"))
    )
    first = F.min_by(F.struct("step", "_mean", "_end"), "idx").alias("_f")
    return flat.groupBy(*SERIES).agg(first).select(
        *SERIES, F.col("_f.step").alias("step"), F.col("_f._mean").alias("value"), "_f._end"
    )


def plateaus(
    metrics: DataFrame,
    min_samples: int = MIN_SAMPLES,
    profile: GroupProfile | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """First stretch of a loss that barely moves (detector 3)."""
    series = ordered_series(loss_points(metrics), profile, hot_rows).index()
    return _plateau_rows(_first_plateau(series, min_samples))


def _plateau_rows(found: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return _anomaly(
        found,
        F.lit("loss_plateau"),
        F.lit("warning"),
        zero,
        zero,
        F.lit(PLATEAU_CONFIDENCE),
        3,
        F.format_string("Loss plateau detected from step %d to %d", "step", "_end"),
        _texts(PLATEAU_ACTIONS),
        _texts(PLATEAU_RELATED),
    )


def _first_divergence(series: OrderedGroups, min_samples: int) -> DataFrame:
    """First point far above the start of a loss whose end is far above it too."""
    edge, factor = DIVERGENCE_EDGE, DIVERGENCE_FACTOR
    v, idx, n = F.col("value"), F.col("idx"), F.col("n")
    framed = series.attach(
        _early=F.avg(F.when(idx < edge, v)), _late=F.avg(F.when(idx >= n - edge, v))
    ).result()
    early, late = F.col("_early"), F.col("_late")
    over = framed.where(
        (n >= F.greatest(F.lit(min_samples), F.lit(2 * edge)))
        & (early > 0)
        & (late > early * factor)
        & (idx >= edge)
        & (v > early * factor)
    )
    first = F.min_by(F.struct("step", "value"), "idx").alias("_f")
    return over.groupBy(*SERIES).agg(first).select(*SERIES, "_f.*")


def divergences(
    metrics: DataFrame,
    min_samples: int = MIN_SAMPLES,
    profile: GroupProfile | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """First runaway point of a loss that ended far above its start (detector 4)."""
    series = ordered_series(loss_points(metrics), profile, hot_rows).index()
    return _divergence_rows(_first_divergence(series, min_samples))


def _divergence_rows(found: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return _anomaly(
        found,
        F.lit("loss_divergence"),
        F.lit("critical"),
        zero,
        zero,
        F.lit(DIVERGENCE_CONFIDENCE),
        4,
        F.format_string("Loss divergence detected at step %d", "step"),
        _texts(DIVERGENCE_ACTIONS),
        _texts(DIVERGENCE_RELATED),
    )


def deduplicate(anomalies: DataFrame) -> DataFrame:
    """One anomaly per run, metric, step and type: that of the first detector.

    A plain aggregate, so repeats are merged before the shuffle.
    """
    rest = [c for c in anomalies.columns if c not in ("run_id", "metric_name", "step", "anomaly_type")]
    best = anomalies.groupBy("run_id", "metric_name", "step", "anomaly_type").agg(
        F.min_by(F.struct(*rest), F.struct("detector", "value")).alias("_a")
    )
    return best.select("run_id", "metric_name", "step", "anomaly_type", "_a.*").select(
        *anomalies.columns
    )


def rank_order() -> list[Column]:
    """Worst severity first, then confidence; detector order breaks ties."""
    return [
        X.severity_rank(F.col("severity")),
        F.desc("confidence"),
        F.asc("run_id"),
        F.asc("metric_name"),
        F.asc("detector"),
        F.asc("step"),
    ]


def detect_anomalies(
    metrics: DataFrame,
    sensitivity: float = 0.8,
    min_samples: int = MIN_SAMPLES,
    measured: Measure | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """All detectors over all series, without repeats (unordered).

    The series are measured once (:func:`measure_series`); plateau and divergence share one
    numbered frame.
    """
    measured = measured or measure_series(metrics)
    finite = None
    if measured.profile.is_hot(hot_rows):
        # Spreading long series over the cluster is the costly step: do it once.
        columns = [*SERIES, *series_order(metrics)]
        known = metrics.select(*columns).where(F.col("value").isNotNull())
        series = ordered_series(known, measured.profile, hot_rows).index()
        losses = series.keep(X.is_loss(F.col("name")))
        finite = series if measured.all_finite else None
    else:
        losses = ordered_series(loss_points(metrics), measured.profile, hot_rows).index()
    found = (
        outliers(metrics, sensitivity, min_samples, measured, hot_rows, finite)
        .unionByName(nonfinite(metrics, min_samples, measured))
        .unionByName(_plateau_rows(_first_plateau(losses, min_samples)))
        .unionByName(_divergence_rows(_first_divergence(losses, min_samples)))
    )
    return deduplicate(found)


def sort_anomalies(anomalies: DataFrame) -> DataFrame:
    return anomalies.orderBy(*rank_order())


def anomaly_summary(anomalies: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Status, counts by severity and type, and the top anomaly of each run.

    One aggregate over the anomalies. With ``runs`` given, runs without anomalies are reported as healthy.
    """
    top = F.struct(
        X.severity_rank(F.col("severity")).alias("s"),
        (-F.col("confidence")).alias("c"),
        F.col("metric_name").alias("m"),
        F.col("detector").alias("d"),
        F.col("step").alias("t"),
    )
    shown = F.struct("id", "metric_name", "step", "value", "anomaly_type", "severity", "confidence")
    by_type = []
    for kind in TYPES:
        by_type += [F.lit(kind), F.count_if(F.col("anomaly_type") == kind)]
    counts = anomalies.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("anomaly_count"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("info", "warning", "critical")],
        F.create_map(*by_type).alias("by_type"),
        F.min_by(shown, top).alias("most_recent"),
    )
    status = F.when(F.col("critical") > 0, "critical").when(F.col("warning") > 0, "warning")
    out = counts.withColumns(
        {
            "status": status.otherwise("info"),
            "by_type": F.map_filter("by_type", lambda kind, count: count > 0),
        }
    )
    if runs is None:
        return out
    every = runs.select(F.col("id").alias("run_id"))
    return every.join(out, "run_id", "left").withColumns(
        {
            "status": F.coalesce("status", F.lit("healthy")),
            **{
                c: F.coalesce(c, F.lit(0))
                for c in ("anomaly_count", "info", "warning", "critical")
            },
        }
    )


def gradient_anomalies(
    norms: DataFrame, high: float = EXPLODING_NORM, low: float = VANISHING_NORM
) -> DataFrame:
    """Exploding (detector 5) and vanishing (detector 6) gradient norms.

    ``norms`` is a metric frame whose values are gradient norms.
    """
    v = F.col("value")
    hits = norms.where((v > high) | (v < low))
    explodes = v > high
    kind = F.when(explodes, "gradient_explosion").otherwise("gradient_vanishing")
    return _anomaly(
        hits,
        kind,
        F.when(explodes, "critical").otherwise("warning"),
        F.lit(low),
        F.lit(high),
        F.lit(1.0),
        F.when(explodes, 5).otherwise(6),
    )
