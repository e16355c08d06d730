"""Shape patterns of metric series: oscillation, convergence, divergence, saturation, schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions import expressions as X
from metricloom.operators.metrics import SERIES, ordered_series, series_order
from metricloom.operators.ordered import HOT_ROWS, GroupProfile, OrderedGroups

# Pattern rules.
OSCILLATION_MIN = 50
OSCILLATION_RATE = 0.3
OSCILLATION_AMPLITUDE = 0.1
CHUNK_ROWS = 20
CONVERGENCE_MIN = 100
CONVERGENCE_NOISE = 0.3
RECENT_ROWS = 50
DIVERGENCE_SLOPE = 0.01
DIVERGENCE_RATIO = 1.5
DIVERGENCE_EDGE = 20
SATURATION_MIN = 100
SATURATION_STD = 0.01
SCHEDULE_MIN = 100
SCHEDULE_ROWS = 20
SCHEDULE_STRIDE = 10
SCHEDULE_FACTOR = 3.0
SCHEDULE_CONFIDENCE = 0.7
EPS = 1e-8
# Slope changes below this are rounding noise of a straight line.
SLOPE_NOISE = 1e-9

# Scenario and advice by pattern, in order of priority.
SCENARIOS = [
    (
        "healthy_convergence",
        "healthy_training",
        ["Training is progressing well - continue monitoring"],
    ),
    (
        "oscillation",
        "lr_too_high",
        [
            "Reduce learning rate by 2-10x",
            "Enable gradient clipping",
            "Consider warmup schedule",
        ],
    ),
    (
        "divergence",
        "training_failing",
        [
            "Immediately reduce learning rate",
            "Check for data issues",
            "Review model architecture",
        ],
    ),
    (
        "saturation",
        "convergence_or_stuck",
        [
            "Check validation metrics",
            "Try learning rate warmup restart",
            "Increase model capacity if underfitting",
        ],
    ),
]


def numbered_series(
    metrics: DataFrame, profile: GroupProfile | None = None, hot_rows: int = HOT_ROWS
) -> OrderedGroups:
    """Points with their index and series length, and the two previous values.

    One shuffle serves every pattern rule below.
    """
    points = metrics.where(F.col("value").isNotNull()).select(*SERIES, *series_order(metrics))
    return (
        ordered_series(points, profile, hot_rows)
        .index()
        .frames(2, 0, lambda w: {"_v1": F.lag("value", 1).over(w), "_v2": F.lag("value", 2).over(w)})
    )


def series_shape(numbered: DataFrame) -> DataFrame:
    """Every figure the rules need that is a plain aggregate, in a single pass."""
    v, i, n = F.col("value"), F.col("idx"), F.col("n")
    turn = (i >= 2) & (F.signum(v - F.col("_v1")) != F.signum(F.col("_v1") - F.col("_v2")))
    tail = lambda k: i >= n - k
    x = i.cast("double")
    recent = F.when(tail(RECENT_ROWS), v)
    return numbered.groupBy(*SERIES).agg(
        F.max(n).alias("n"),
        F.min_by("step", i).alias("first_step"),
        F.max_by("step", i).alias("last_step"),
        F.min(F.when(tail(RECENT_ROWS), F.struct(i, "step"))).getField("step").alias("recent_step"),
        F.sum(F.when(turn, 1).otherwise(0)).alias("turns"),
        F.avg(v).alias("mean"),
        F.avg(F.abs(v)).alias("mean_abs"),
        F.regr_slope(v, x).alias("slope"),
        F.regr_syy(v, x).alias("syy"),
        F.regr_sxx(v, x).alias("sxx"),
        F.regr_sxy(v, x).alias("sxy"),
        F.regr_slope(recent, x).alias("recent_slope"),
        F.avg(recent).alias("recent_mean"),
        F.stddev_pop(recent).alias("recent_std"),
        F.avg(F.when(i < DIVERGENCE_EDGE, v)).alias("early"),
        F.avg(F.when(tail(DIVERGENCE_EDGE), v)).alias("late"),
    )


def _pattern(
    df: DataFrame,
    kind: str,
    confidence: Column,
    start: Column,
    end: Column,
    text: Column,
    involved: Column,
    metadata: dict[str, Column],
) -> DataFrame:
    entries = []
    for key, value in metadata.items():
        entries += [F.lit(key), value.cast("double")]
    return df.select(
        *SERIES,
        F.lit(kind).alias("pattern_type"),
        confidence.alias("confidence"),
        start.cast("long").alias("start_step"),
        end.cast("long").alias("end_step"),
        text.alias("description"),
        involved.alias("metrics_involved"),
        F.create_map(*entries).alias("metadata"),
    )


def _none() -> Column:
    return F.array().cast("array<string>")


def oscillation(numbered: DataFrame, shape: DataFrame) -> DataFrame:
    """Frequent turns of noticeable size."""
    i, n = F.col("idx"), F.col("n")
    size = F.least(F.lit(CHUNK_ROWS), F.floor(n / 5))
    chunk = F.floor(i / size)
    swings = (
        numbered.where((n >= OSCILLATION_MIN) & (chunk * size < n - size))
        .groupBy(*SERIES, chunk.alias("_chunk"))
        .agg((F.max("value") - F.min("value")).alias("_swing"))
        .groupBy(*SERIES)
        .agg(F.avg("_swing").alias("amplitude"))
    )
    rate = F.col("turns") / (F.col("n") - 1)
    relative = F.col("amplitude") / (F.col("mean_abs") + EPS)
    hits = shape.join(swings, SERIES).select(
        "*", rate.alias("rate"), relative.alias("relative")
    ).where(
        (F.col("n") >= OSCILLATION_MIN)
        & (F.col("rate") > OSCILLATION_RATE)
        & (F.col("relative") > OSCILLATION_AMPLITUDE)
    )
    return _pattern(
        hits,
        "oscillation",
        X.clamp_high(F.col("rate") * 2),
        F.col("first_step"),
        F.col("last_step"),
        F.format_string("High oscillation detected (rate: %.2f, amplitude: %.2f)", "rate", "relative"),
        _none(),
        {"oscillation_rate": F.col("rate"), "relative_amplitude": F.col("relative")},
    )


def healthy_convergence(shape: DataFrame) -> DataFrame:
    """A falling loss that stays close to its trend line."""
    residual = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    noise = F.sqrt(residual / F.col("n")) / (F.abs("mean") + EPS)
    hits = shape.where((F.col("n") >= CONVERGENCE_MIN) & X.is_loss(F.col("name"))).select(
        "*", noise.alias("noise")
    ).where((F.col("slope") < 0) & (F.col("noise") < CONVERGENCE_NOISE))
    return _pattern(
        hits,
        "healthy_convergence",
        X.clamp_low(1.0 - F.col("noise")),
        F.col("first_step"),
        F.col("last_step"),
        F.lit("Training shows healthy convergence pattern"),
        F.array("name"),
        {"trend": F.col("slope"), "noise_ratio": F.col("noise")},
    )


def divergence(shape: DataFrame) -> DataFrame:
    """A loss that rises lately and ends well above its start."""
    ratio = F.try_divide(F.col("late"), F.col("early"))
    hits = shape.where(
        (F.col("n") >= RECENT_ROWS)
        & X.is_loss(F.col("name"))
        & (F.col("recent_slope") > DIVERGENCE_SLOPE)
        & (F.col("late") > F.col("early") * DIVERGENCE_RATIO)
    )
    return _pattern(
        hits,
        "divergence",
        X.clamp_high((ratio - 1) / 2),
        F.col("recent_step"),
        F.col("last_step"),
        F.lit("Loss is diverging - training may be failing"),
        F.array("name"),
        {"trend": F.col("recent_slope"), "increase_ratio": ratio},
    )


def saturation(shape: DataFrame) -> DataFrame:
    """A metric whose latest values hardly vary."""
    relative = F.col("recent_std") / (F.abs("recent_mean") + EPS)
    hits = shape.where((F.col("n") >= SATURATION_MIN) & (relative < SATURATION_STD))
    return _pattern(
        hits,
        "saturation",
        X.clamp_low(1.0 - relative * 10),
        F.col("recent_step"),
        F.col("last_step"),
        F.format_string("Metric has saturated around %.4f", "recent_mean"),
        F.array("name"),
        {"saturated_value": F.col("recent_mean"), "relative_std": relative},
    )


def window_slopes(numbered: DataFrame) -> DataFrame:
    """Trend of each half-overlapping window; one row per series and window.

    Each point is copied to the windows it lies in; the point right after a
    window goes along to name the step where the window ends.
    """
    i, n = F.col("idx"), F.col("n")
    stride, rows = SCHEDULE_STRIDE, SCHEDULE_ROWS
    first = F.greatest(F.ceil((i - rows) / stride), F.lit(0))
    last = F.floor(i / stride)
    spread = (
        numbered.where(n >= SCHEDULE_MIN)
        .select(*SERIES, "step", "value", i, n, F.explode(F.sequence(first, last)).alias("win"))
        .where(F.col("win") * stride < n - rows)
    )
    inside = i < F.col("win") * stride + rows
    v = F.when(inside, F.col("value"))
    x = (i - F.col("win") * stride).cast("double")
    return spread.groupBy(*SERIES, "win").agg(
        F.regr_slope(v, x).alias("slope"),
        F.min_by("step", i).alias("start_step"),
        F.max(F.when(~inside, F.col("step"))).alias("end_step"),
    )


def schedule_change(numbered: DataFrame) -> DataFrame:
    """One slope change that stands out from the others.

    Neighbouring windows meet in an aggregate keyed by window number, so a very
    long series needs no single-task window over its windows.
    """
    slopes = window_slopes(numbered)
    sides = F.array(
        F.struct(F.col("win").alias("k"), F.lit(True).alias("left")),
        F.struct((F.col("win") - 1).alias("k"), F.lit(False).alias("left")),
    )
    pairs = slopes.select("*", F.explode(sides).alias("_s")).where(F.col("_s.k") >= 0)
    left, right = F.col("_s.left"), ~F.col("_s.left")
    changes = (
        pairs.groupBy(*SERIES, F.col("_s.k").alias("k"))
        .agg(
            F.max(F.when(left, F.col("slope"))).alias("before"),
            F.max(F.when(right, F.col("slope"))).alias("after"),
            F.max(F.when(left, F.col("start_step"))).alias("start_step"),
            F.max(F.when(left, F.col("end_step"))).alias("end_step"),
        )
        .where(F.col("before").isNotNull() & F.col("after").isNotNull())
        .withColumn("delta", F.abs(F.col("after") - F.col("before")))
    )
    # The largest change; of equal ones the first.
    top = F.max_by(
        F.struct("k", "before", "after", "start_step", "end_step"), F.struct("delta", -F.col("k"))
    )
    per_series = changes.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("_changes"),
        F.max("delta").alias("_max"),
        F.avg("delta").alias("_avg"),
        top.alias("_t"),
    )
    hits = per_series.where(
        (F.col("_changes") >= 2)
        & (F.col("_max") > SCHEDULE_FACTOR * F.col("_avg"))
        & (F.col("_max") > SLOPE_NOISE)
    )
    return _pattern(
        hits,
        "lr_decay_effect",
        F.lit(SCHEDULE_CONFIDENCE),
        F.col("_t.start_step"),
        F.col("_t.end_step"),
        F.lit("Detected learning rate schedule effect"),
        F.array(F.col("name"), F.lit("learning_rate")),
        {
            "change_step": F.col("_t.k") * SCHEDULE_STRIDE,
            "trend_before": F.col("_t.before"),
            "trend_after": F.col("_t.after"),
        },
    )


def detect_patterns(
    metrics: DataFrame, profile: GroupProfile | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """All patterns of all series."""
    numbered = numbered_series(metrics, profile, hot_rows).result()
    shape = series_shape(numbered)
    return (
        oscillation(numbered, shape)
        .unionByName(healthy_convergence(shape))
        .unionByName(divergence(shape))
        .unionByName(saturation(shape))
        .unionByName(schedule_change(numbered))
    )


def match_scenario(patterns: DataFrame, series: DataFrame | None = None) -> DataFrame:
    """The known training situation a series' patterns point to, with advice.

    ``series`` (run_id, name) adds series without any pattern as ``unknown``.
    """
    kinds = patterns.groupBy(*SERIES).agg(
        F.array_sort(F.collect_set("pattern_type")).alias("patterns_detected")
    )
    if series is not None:
        kinds = series.select(*SERIES).distinct().join(kinds, SERIES, "left")
        kinds = kinds.withColumn("patterns_detected", F.coalesce("patterns_detected", _none()))
    scenario, advice = None, None
    for kind, name, texts in SCENARIOS:
        hit = F.array_contains("patterns_detected", kind)
        words = F.array(*[F.lit(t) for t in texts])
        scenario = (F.when if scenario is None else scenario.when)(hit, name)
        advice = (F.when if advice is None else advice.when)(hit, words)
    return kinds.select(
        *SERIES,
        "patterns_detected",
        scenario.otherwise("unknown").alias("scenario"),
        advice.otherwise(_none()).alias("recommendations"),
    )
