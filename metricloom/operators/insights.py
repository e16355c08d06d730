"""Insights, votes, feeds, summaries and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions import expressions as X
from metricloom.operators.anomalies import detect_anomalies, rank_order
from metricloom.operators.metrics import SERIES, first_names, series_order, series_statistics
from metricloom.operators.ordered import HOT_ROWS, GroupProfile, OrderedGroups
from metricloom.operators.runs import active_only, newest_first
from metricloom.session import ensure_checkpoint_dir

# What each anomaly type turns into. Types without an entry give no insight.
# type -> (category, title, summary, recommendations or None for those of the anomaly,
#          confidence or None, severity or None, related metrics)
INSIGHTS = {
    "loss_spike": (
        "training_progress",
        "Loss Spike Detected",
        "Detected %d loss spike(s) during training",
        None,
        None,
        None,
        ["loss", "learning_rate", "gradient_norm"],
    ),
    "loss_plateau": (
        "convergence",
        "Training Plateau Detected",
        "Loss has stopped decreasing significantly",
        [
            "Try cosine annealing or cyclical learning rate",
            "Consider increasing model capacity",
            "Add regularization if overfitting",
            "Check if more data would help",
        ],
        None,
        "warning",
        ["loss", "learning_rate"],
    ),
    "gradient_explosion": (
        "optimization",
        "Gradient Explosion Detected",
        "Gradients are growing unboundedly - immediate action required",
        [
            "Enable gradient clipping (recommended: max_norm=1.0)",
            "Reduce learning rate by 10x",
            "Check for numerical overflow in loss computation",
            "Review model architecture for instability",
        ],
        1.0,
        "critical",
        ["gradient_norm", "loss", "learning_rate"],
    ),
    "loss_nan": (
        "optimization",
        "NaN Values Detected",
        "Training produced NaN values - training has failed",
        [
            "Add epsilon (1e-8) to log and division operations",
            "Enable anomaly detection: torch.autograd.set_detect_anomaly(True)",
            "Check input data for NaN/Inf values",
            "Use torch.nan_to_num() for intermediate computations",
        ],
        1.0,
        "critical",
        ["loss"],
    ),
}
EVIDENCE_ROWS = 5
MAX_INSIGHTS_PER_RUN = 50

# Longer explanations.
NAN_ANALYSIS = (
    "NaN values indicate numerical instability. Common causes:\n"
    "1. Division by zero in loss computation\n"
    "2. Log of zero or negative numbers\n"
    "3. Gradient explosion followed by overflow\n"
    "4. Incorrect loss function implementation"
)
PLATEAU_CAUSES = (
    "This could indicate:\n"
    "1. Model has converged (check validation metrics)\n"
    "2. Learning rate is too low to make further progress\n"
    "3. Model capacity is insufficient\n"
    "4. Local minimum - consider warm restarts\n"
)
EXPLOSION_ANALYSIS = (
    "Gradient explosion occurs when gradient magnitudes grow exponentially.\n\n"
    "Root causes:\n"
    "1. Learning rate too high for this architecture\n"
    "2. Deep networks without proper normalization\n"
    "3. Recurrent networks with long sequences\n"
    "4. Unstable loss landscape\n\n"
    "Immediate mitigation: torch.nn.utils.clip_grad_norm_(model.parameters(), max_norm=1.0)"
)
SPIKE_SIZES = [
    (10, "SEVERE: Spikes are very large, indicating potential data issues or LR problems."),
    (2, "MODERATE: Spikes are notable but may be recoverable."),
    (None, "MINOR: Spikes are small and may self-correct."),
]
REGULAR_SPIKES = "This may indicate issues with specific data batches or a cyclic LR schedule."

# Insight templates by scenario: (title, summary, category, severity).
TEMPLATES = {
    "healthy_training": (
        "Training Progressing Normally",
        "Loss is decreasing steadily with no anomalies detected.",
        "training_progress",
        "info",
    ),
    "convergence_detected": (
        "Model Approaching Convergence",
        "Loss reduction rate has slowed significantly, suggesting convergence.",
        "convergence",
        "info",
    ),
    "lr_too_high": (
        "Learning Rate May Be Too High",
        "Loss oscillations suggest the learning rate should be reduced.",
        "hyperparameter",
        "warning",
    ),
    "lr_too_low": (
        "Learning Rate May Be Too Low",
        "Slow convergence suggests the learning rate could be increased.",
        "hyperparameter",
        "info",
    ),
    "overfitting_detected": (
        "Potential Overfitting Detected",
        "Training loss continues to decrease while validation loss increases.",
        "training_progress",
        "warning",
    ),
    "gpu_underutilized": (
        "GPU Underutilization",
        "GPU utilization is below optimal levels. Consider increasing batch size.",
        "resource_utilization",
        "info",
    ),
    "gradient_issues": (
        "Gradient Health Warning",
        "Gradient statistics indicate potential training instability.",
        "optimization",
        "warning",
    ),
}
GPU_TARGET = 70.0
GRADIENT_LIMIT = 10.0


def _words(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _by_type(position: int, default: dict[str, Column] | None = None) -> Column:
    """A literal of the insight table by anomaly type; None falls to ``default``."""
    out = None
    for kind, row in INSIGHTS.items():
        value = row[position]
        if value is None:
            column = (default or {})[kind]
        else:
            column = _words(value) if isinstance(value, list) else F.lit(value)
        out = (F.when if out is None else out.when)(F.col("anomaly_type") == kind, column)
    return out


# -- from anomalies ----------------------------------------------------------


def top_evidence(anomalies: DataFrame, rows: int = EVIDENCE_ROWS) -> DataFrame:
    """The leading anomalies of each run and type, as one array of structs.

    The rank limit is applied before the shuffle, so an array never sees more
    than ``rows`` entries whatever the group size.
    """
    w = Window.partitionBy("run_id", "anomaly_type").orderBy(*rank_order())
    shown = F.struct(
        "rank", "id", "metric_name", "step", "value", "severity", "confidence", "description"
    )
    ranked = anomalies.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= rows)
    return ranked.groupBy("run_id", "anomaly_type").agg(
        F.array_sort(F.collect_list(shown)).alias("evidence"),
        F.array_sort(F.collect_list(F.struct("rank", "step"))).alias("_steps"),
    )


def spike_regularity(
    anomalies: DataFrame, profile: GroupProfile | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Spacing and mean size of each run's loss spikes, in step order."""
    spikes = anomalies.where(F.col("anomaly_type") == "loss_spike").select(
        "run_id", "step", "metric_name", "value"
    )
    gaps = OrderedGroups(spikes, ["run_id"], ["step", "metric_name"], profile, hot_rows).frames(
        1, 0, lambda w: {"_gap": F.col("step") - F.lag("step", 1).over(w)}
    )
    stats = gaps.result().groupBy("run_id").agg(
        F.count(F.lit(1)).alias("spikes"),
        F.avg("value").alias("mean_spike"),
        F.avg("_gap").alias("mean_interval"),
        F.stddev_pop("_gap").alias("std_interval"),
    )
    size = None
    for limit, text in SPIKE_SIZES:
        word = F.lit(text.split(":")[0])
        if limit is None:
            size = size.otherwise(word)
        else:
            size = (F.when if size is None else size.when)(F.col("mean_spike") > limit, word)
    regular = (F.col("spikes") > 1) & (F.col("std_interval") < F.col("mean_interval") * 0.1)
    return stats.select("*", F.coalesce(regular, F.lit(False)).alias("regular"), size.alias("size"))


def spike_spec() -> str:
    """Chart description of loss spikes; the points are the named data set ``loss_spikes``."""
    return (
        '{"$schema":"https://vega.github.io/schema/vega-lite/v5.json","title":"Loss Spikes",'
        '"data":{"name":"loss_spikes"},"mark":{"type":"point","size":100,"color":"red"},'
        '"encoding":{"x":{"field":"step","type":"quantitative"},'
        '"y":{"field":"value","type":"quantitative"}}}'
    )


def spike_points(anomalies: DataFrame) -> DataFrame:
    """The data set :func:`spike_spec` names."""
    return anomalies.where(F.col("anomaly_type") == "loss_spike").select(
        "run_id", "step", "value", F.lit("spike").alias("type")
    )


def comparison_spec(metric: Column) -> Column:
    """Chart description of a run comparison over the named data set ``comparison``."""
    axis = lambda f: F.struct(F.lit(f).alias("field"), F.lit("quantitative").alias("type"))
    return F.to_json(
        F.struct(
            F.lit("https://vega.github.io/schema/vega-lite/v5.json").alias("$schema"),
            F.concat(F.lit("Comparison: "), metric).alias("title"),
            F.lit("container").alias("width"),
            F.lit(300).alias("height"),
            F.struct(F.lit("comparison").alias("name")).alias("data"),
            F.lit("line").alias("mark"),
            F.struct(
                axis("step").alias("x"),
                axis("value").alias("y"),
                F.struct(
                    F.lit("run_id").alias("field"),
                    F.lit("nominal").alias("type"),
                    F.struct(F.lit("Run").alias("title")).alias("legend"),
                ).alias("color"),
            ).alias("encoding"),
        )
    )


def insights_from_anomalies(anomalies: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One insight per run and anomaly type, for the types that have one."""
    known = anomalies.where(F.col("anomaly_type").isin(*INSIGHTS))
    keys = ["run_id", "anomaly_type"]
    first = F.struct(
        (-F.col("confidence")).alias("c"),
        X.severity_rank(F.col("severity")).alias("s"),
        F.col("metric_name").alias("m"),
        F.col("detector").alias("d"),
        F.col("step").alias("t"),
    )
    groups = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("anomalies"),
        F.min_by(
            F.struct("suggested_actions", "confidence", "severity", "value", "step"), first
        ).alias("_p"),
    )
    regularity = spike_regularity(known, hot_rows=hot_rows).withColumn(
        "anomaly_type", F.lit("loss_spike")
    )
    df = groups.join(top_evidence(known), keys).join(regularity, keys, "left")

    steps = F.concat_ws(", ", F.transform("_steps", lambda s: s["step"].cast("string")))
    pattern = F.when(
        F.col("regular"),
        F.format_string(
            "Pattern: Spikes occur regularly every ~%.0f steps. " + REGULAR_SPIKES + "\n\n",
            "mean_interval",
        ),
    ).otherwise("")
    verdict = None
    for limit, text in SPIKE_SIZES:
        if limit is None:
            verdict = verdict.otherwise(text)
        else:
            verdict = (F.when if verdict is None else verdict.when)(
                F.col("mean_spike") > limit, text
            )
    spike_text = F.concat(
        F.format_string("Detected %d loss spike(s) at steps: [", "anomalies"),
        steps,
        F.lit("]...\n\n"),
        pattern,
        F.format_string("Average spike magnitude: %.4f\n", "mean_spike"),
        verdict,
        F.lit("\n"),
    )
    plateau_text = F.concat(
        F.format_string(
            "Loss has plateaued around %.4f starting at step %d.\n\n", "_p.value", "_p.step"
        ),
        F.lit(PLATEAU_CAUSES),
    )
    analysis = (
        F.when(F.col("anomaly_type") == "loss_spike", spike_text)
        .when(F.col("anomaly_type") == "loss_plateau", plateau_text)
        .when(F.col("anomaly_type") == "gradient_explosion", EXPLOSION_ANALYSIS)
        .otherwise(NAN_ANALYSIS)
    )
    same = lambda c: {k: c for k in INSIGHTS}
    summary = F.when(
        F.col("anomaly_type") == "loss_spike",
        F.format_string(INSIGHTS["loss_spike"][2], "anomalies"),
    ).otherwise(_by_type(2))
    return df.select(
        F.sha2(F.concat_ws("|", *keys), 256).alias("id"),
        *keys,
        _by_type(0).alias("insight_type"),
        _by_type(1).alias("title"),
        summary.alias("description"),
        analysis.alias("detailed_analysis"),
        "anomalies",
        "evidence",
        _by_type(3, same(F.col("_p.suggested_actions"))).alias("recommendations"),
        _by_type(4, same(F.col("_p.confidence"))).alias("confidence"),
        _by_type(5, same(F.col("_p.severity"))).alias("severity"),
        _by_type(6).alias("related_metrics"),
        F.when(F.col("anomaly_type") == "loss_spike", spike_spec()).alias("visualization_spec"),
    )


def analyse_runs(
    metrics: DataFrame,
    runs: DataFrame,
    sensitivity: float = 0.8,
    max_names: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Anomalies and insights of all running runs in one job.

    ``max_names`` keeps only the first metric names of a run; all by default.
    """
    active = active_only(metrics, runs)
    if max_names is not None:
        keep = first_names(active, max_names).select(*SERIES)
        active = active.join(keep, SERIES, "left_semi")
    # Anomalies are few beside the points they come from; storing them once saves
    # every later step from running the detectors again.
    ensure_checkpoint_dir(metrics.sparkSession)
    anomalies = detect_anomalies(active, sensitivity, hot_rows=hot_rows).checkpoint()
    return anomalies, insights_from_anomalies(anomalies, hot_rows)


def to_insight_table(insights: DataFrame, at: Column | None = None) -> DataFrame:
    """The stored columns of an insight."""
    return insights.select(
        "id",
        "run_id",
        "insight_type",
        "title",
        "description",
        "severity",
        F.to_json("related_metrics").alias("related_metrics"),
        "visualization_spec",
        (F.current_timestamp() if at is None else at).alias("timestamp"),
        F.lit(0).cast("long").alias("votes_up"),
        F.lit(0).cast("long").alias("votes_down"),
    )


def cap_per_run(
    insights: DataFrame, stored: DataFrame | None = None, cap: int = MAX_INSIGHTS_PER_RUN
) -> DataFrame:
    """New insights up to ``cap`` per run, counting those already stored."""
    w = Window.partitionBy("run_id").orderBy(
        X.severity_rank(F.col("severity")), F.desc("confidence"), "id"
    )
    ranked = insights.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= cap)
    if stored is None:
        return ranked.drop("_rank")
    counts = stored.groupBy("run_id").agg(F.count(F.lit(1)).alias("_stored"))
    room = cap - F.coalesce("_stored", F.lit(0))
    return (
        ranked.join(counts, "run_id", "left").where(F.col("_rank") <= room).drop("_rank", "_stored")
    )


def analysis_statistics(insights: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Insights generated per run; with ``runs``, runs without any are listed too."""
    counts = insights.groupBy("run_id").agg(F.count(F.lit(1)).alias("insights"))
    if runs is None:
        return counts
    every = runs.select(F.col("id").alias("run_id"))
    return every.join(counts, "run_id", "left").withColumn(
        "insights", F.coalesce("insights", F.lit(0))
    )


# -- summaries ---------------------------------------------------------------


def training_figures(
    metrics: DataFrame,
    loss: str = "train_loss",
    gradient: str = "gradient_norm",
    gpu: str = "gpu_utilization",
    memory: str = "memory_utilization",
    throughput: str = "samples_per_second",
    recent: int = 50,
) -> DataFrame:
    """The inputs of a training summary per run.

    Everything but the recent slope is one aggregate over the table; the slope
    uses the last ``recent`` loss points, kept by a rank limit.
    """
    order = F.struct(*series_order(metrics))
    v, name = F.col("value"), F.col("name")
    is_loss = name == loss
    base = metrics.groupBy("run_id").agg(
        F.max("step").alias("total_steps"),
        (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))).alias("_us"),
        F.max_by(v, F.when(is_loss, order)).alias("loss_current"),
        F.min_by(v, F.when(is_loss, order)).alias("loss_initial"),
        F.min(F.when(is_loss, v)).alias("loss_best"),
        F.avg(F.when(name == gradient, v)).alias("gradient_norm_mean"),
        F.max(F.when(name == gradient, v)).alias("gradient_norm_max"),
        F.avg(F.when(name == gpu, v)).alias("gpu_utilization_mean"),
        F.avg(F.when(name == memory, v)).alias("memory_utilization_mean"),
        F.avg(F.when(name == throughput, v)).alias("throughput"),
    )
    w = Window.partitionBy("run_id").orderBy(*[F.desc(c) for c in series_order(metrics)])
    last = (
        metrics.where(is_loss)
        .select("run_id", *series_order(metrics))
        .withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= recent)
    )
    slope = last.groupBy("run_id").agg(
        F.coalesce(F.regr_slope(v, (-F.col("_r")).cast("double")), F.lit(0.0)).alias("loss_trend")
    )
    return base.join(slope, "run_id", "left").select(
        "*", (F.col("_us") / 1e6).alias("elapsed_seconds")
    ).drop("_us")


def training_summary(figures: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Overall state, progress and advice for each run."""
    counts = anomalies.groupBy("run_id").agg(
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "warning").alias("warning"),
    )
    df = figures.join(counts, "run_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("critical", "warning")}
    )
    bad, warned = F.col("critical") > 0, F.col("warning") > 0
    reduction = F.try_divide(F.col("loss_initial") - F.col("loss_current"), F.col("loss_initial"))
    advice = F.array_compact(
        F.array(
            F.when(
                F.col("gpu_utilization_mean") < GPU_TARGET,
                "Consider increasing batch size to improve GPU utilization",
            ),
            F.when(
                F.col("loss_trend") >= 0,
                "Loss is not decreasing - review learning rate and architecture",
            ),
            F.when(
                F.col("gradient_norm_max") > GRADIENT_LIMIT,
                "Enable gradient clipping to prevent instability",
            ),
        )
    )
    number = lambda pattern, c: F.coalesce(X.formatted(pattern, c), F.lit("n/a"))
    detail = F.concat(
        F.lit("\n## Training Progress Summary\n\n**Steps Completed:** "),
        F.format_string("%,d", "total_steps"),
        F.lit("\n**Time Elapsed:** "),
        F.format_string("%.1f hours", F.col("elapsed_seconds") / 3600),
        F.lit("\n**Throughput:** "),
        number("%.1f samples/sec", "throughput"),
        F.lit("\n\n### Loss Analysis\n- Current Loss: "),
        number("%.4f", "loss_current"),
        F.lit("\n- Best Loss: "),
        number("%.4f", "loss_best"),
        F.lit("\n- Loss Reduction: "),
        number("%.1f%%", reduction * 100),
        F.lit("\n- Trend: "),
        F.when(F.col("loss_trend") < 0, "Decreasing").otherwise("Increasing/Stable"),
        F.lit("\n\n### Resource Utilization\n- GPU Utilization: "),
        number("%.1f%%", "gpu_utilization_mean"),
        F.lit("\n- Memory Utilization: "),
        number("%.1f%%", "memory_utilization_mean"),
        F.lit("\n\n### Gradient Health\n- Mean Gradient Norm: "),
        number("%.4f", "gradient_norm_mean"),
        F.lit("\n- Max Gradient Norm: "),
        number("%.4f", "gradient_norm_max"),
        F.lit("\n"),
    )
    return df.select(
        "*",
        reduction.alias("loss_reduction"),
        F.when(bad, "critical").when(warned, "warning").otherwise("info").alias("severity"),
        F.when(bad, "Training Issues Detected - Action Required")
        .when(warned, "Training Progressing with Warnings")
        .otherwise("Training Progressing Normally")
        .alias("title"),
        F.when(
            bad,
            F.format_string("Found %d critical issues requiring immediate attention.", "critical"),
        )
        .when(
            warned,
            F.format_string("Training is progressing but %d warnings detected.", "warning"),
        )
        .otherwise("No significant issues detected.")
        .alias("summary"),
        detail.alias("detailed_analysis"),
        F.when(F.size(advice) > 0, advice)
        .otherwise(_words(["Continue monitoring"]))
        .alias("recommendations"),
        F.lit(0.9).alias("confidence"),
    )


def compare_pairs(metrics: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """Which of two runs reached the lower value; a tie goes to run B.

    ``pairs`` has run_a and run_b. A run without points counts as zero.
    """
    stats = (
        metrics.where(F.col("name") == name)
        .groupBy("run_id")
        .agg(
            F.max_by("value", F.struct(*series_order(metrics))).alias("final"),
            F.min("value").alias("best"),
            F.count(F.lit(1)).alias("points"),
        )
    )
    df = pairs
    for side in ("a", "b"):
        part = stats.select(
            F.col("run_id").alias(f"run_{side}"),
            *[F.col(c).alias(f"{c}_{side}") for c in ("final", "best", "points")],
        )
        df = df.join(part, f"run_{side}", "left").withColumns(
            {f"{c}_{side}": F.coalesce(f"{c}_{side}", F.lit(0)) for c in ("final", "best", "points")}
        )
    a_wins = F.col("best_a") < F.col("best_b")
    lost = F.when(a_wins, F.col("best_b")).otherwise(F.col("best_a"))
    won = F.when(a_wins, F.col("best_a")).otherwise(F.col("best_b"))
    gain = F.try_divide(lost - won, lost) * 100
    letter = F.when(a_wins, "A").otherwise("B")
    table = F.concat(
        F.lit(f"\n## Run Comparison: {name}\n\n| Metric | Run A | Run B |\n|--------|-------|-------|\n"),
        F.format_string("| Final Value | %.4f | %.4f |\n", "final_a", "final_b"),
        F.format_string("| Best Value | %.4f | %.4f |\n", "best_a", "best_b"),
        F.format_string("| Total Steps | %d | %d |\n\n**Winner:** ", "points_a", "points_b"),
        F.when(a_wins, F.col("run_a")).otherwise(F.col("run_b")),
        F.lit("\n"),
    )
    return df.select(
        "*",
        F.when(a_wins, F.col("run_a")).otherwise(F.col("run_b")).alias("winner"),
        gain.alias("improvement"),
        F.concat(
            F.lit("Run "), letter, F.lit(" achieved "),
            F.coalesce(X.formatted("%.1f", gain), F.lit("0.0")), F.lit(f"% better {name}"),
        ).alias("summary"),
        table.alias("detailed_analysis"),
        F.concat(
            F.lit("Review config differences to understand why "), letter, F.lit(" performed better")
        ).alias("recommendation"),
        comparison_spec(F.lit(name)).alias("visualization_spec"),
    )


def template_insights(
    metrics: DataFrame,
    train: str = "train_loss",
    validation: str = "val_loss",
    gpu: str = "gpu_utilization",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Overfitting and device under-use per run, worded from the template table."""
    two = metrics.where(F.col("name").isin(train, validation)).select(*SERIES, *series_order(metrics))
    slopes = (
        OrderedGroups(two, SERIES, series_order(two), hot_rows=hot_rows)
        .index()
        .result()
        .groupBy("run_id")
        .agg(
            F.regr_slope(
                F.when(F.col("name") == train, F.col("value")), F.col("idx").cast("double")
            ).alias("train_slope"),
            F.regr_slope(
                F.when(F.col("name") == validation, F.col("value")), F.col("idx").cast("double")
            ).alias("val_slope"),
        )
    )
    use = metrics.where(F.col("name") == gpu).groupBy("run_id").agg(F.avg("value").alias("gpu"))
    df = slopes.join(use, "run_id", "full_outer")
    found = F.array_compact(
        F.array(
            F.when((F.col("train_slope") < 0) & (F.col("val_slope") > 0), "overfitting_detected"),
            F.when(F.col("gpu") < GPU_TARGET, "gpu_underutilized"),
        )
    )
    return word_scenarios(df.select("run_id", F.explode(found).alias("scenario")))


def word_scenarios(df: DataFrame, column: str = "scenario") -> DataFrame:
    """Title, summary, category and severity of known scenarios."""
    def pick(position: int) -> Column:
        out = None
        for key, row in TEMPLATES.items():
            out = (F.when if out is None else out.when)(F.col(column) == key, row[position])
        return out

    names = ("title", "summary", "category", "severity")
    return df.select("*", *[pick(i).alias(n) for i, n in enumerate(names)])


# -- votes -------------------------------------------------------------------


def vote_statistics(insights: DataFrame, votes: DataFrame) -> DataFrame:
    """Up and down votes by insight type; types without votes count zero.

    Votes are summed per insight before the join, so a much-voted insight does
    not travel vote by vote.
    """
    per_insight = votes.groupBy(F.col("insight_id").alias("id")).agg(
        F.count_if(F.col("vote") > 0).alias("_up"), F.count_if(F.col("vote") < 0).alias("_down")
    )
    return (
        insights.select("id", "insight_type")
        .join(per_insight, "id", "left")
        .groupBy("insight_type")
        .agg(
            F.coalesce(F.sum("_up"), F.lit(0)).alias("up"),
            F.coalesce(F.sum("_down"), F.lit(0)).alias("down"),
        )
    )


def apply_votes(insights: DataFrame, votes: DataFrame) -> DataFrame:
    """Insights with their counters moved on by new votes; a zero vote counts as down."""
    per_insight = votes.groupBy(F.col("insight_id").alias("id")).agg(
        F.count_if(F.col("vote") > 0).alias("_up"), F.count_if(F.col("vote") <= 0).alias("_down")
    )
    add = lambda c, d: F.coalesce(c, F.lit(0)) + F.coalesce(d, F.lit(0))
    return (
        insights.join(per_insight, "id", "left")
        .withColumns({"votes_up": add("votes_up", "_up"), "votes_down": add("votes_down", "_down")})
        .select(*insights.columns)
    )


# -- lists and feeds ---------------------------------------------------------


def list_insights(
    insights: DataFrame, run_id: str | None = None, severity: str | None = None
) -> DataFrame:
    """Newest first, the related metrics parsed."""
    out = insights
    if run_id is not None:
        out = out.where(F.col("run_id") == run_id)
    if severity is not None:
        out = out.where(F.col("severity") == severity)
    names = F.coalesce(
        F.from_json("related_metrics", "array<string>"), F.array().cast("array<string>")
    )
    return out.withColumn("related_metrics", names).orderBy(F.desc("timestamp"), "id")


def insight_feed(
    runs: DataFrame,
    insights: DataFrame,
    recent_runs: int = 10,
    per_run: int = 5,
    total: int = 20,
) -> DataFrame:
    """The newest insights of the newest runs: a few per run, then the newest overall."""
    newest = (
        runs.orderBy(*newest_first(runs))
        .limit(recent_runs)
        .select(F.col("id").alias("run_id"), F.col("name").alias("run_name"))
    )
    # At most ``recent_runs`` rows.
    mine = insights.join(F.broadcast(newest), "run_id")
    w = Window.partitionBy("run_id").orderBy(F.desc("timestamp"), "id")
    return (
        mine.withColumn("_rank", F.row_number().over(w))
        .where(F.col("_rank") <= per_run)
        .drop("_rank")
        .orderBy(F.desc("timestamp"), "id")
        .limit(total)
    )


# Metric sets of the dashboards.
PRESETS = {
    "training_dashboard_basic": ["loss", "accuracy", "learning_rate"],
    "discrete_flow_dashboard": [
        "bpc",
        "flow_improvement",
        "entropy_source",
        "entropy_target",
        "kl_divergence",
        "gradient_norm",
    ],
}


def dashboard_points(
    metrics: DataFrame,
    runs: DataFrame,
    names: Sequence[str] | None = None,
    first: int | None = 10,
) -> DataFrame:
    """Chart points of all runs with the run's name and status.

    ``names`` picks a metric set (see :data:`PRESETS`); otherwise the first
    ``first`` names of each run are taken, or all with ``None``. Points stay
    rows: a series is never packed into one value.
    """
    if names is not None:
        shown = metrics.where(F.col("name").isin(*names))
    elif first is not None:
        shown = metrics.join(first_names(metrics, first).select(*SERIES), SERIES, "left_semi")
    else:
        shown = metrics
    info = runs.select(
        F.col("id").alias("run_id"), F.col("name").alias("run_name"), "project", "status"
    )
    return shown.select(*SERIES, "step", "value").join(info, "run_id")


# -- reports -----------------------------------------------------------------

#: Ids and tags of runs that one task sorts, about.
TAG_ROWS = 500_000
# Marks in front of insight titles.
MARKS = {"critical": "🔴", "warning": "🟡", "info": "🔵"}


def run_report(
    runs: DataFrame,
    run_tags: DataFrame,
    metrics: DataFrame,
    insights: DataFrame,
    first: int | None = None,
    profile: GroupProfile | None = None,
    hot_rows: int = HOT_ROWS,
    task_rows: int = TAG_ROWS,
) -> DataFrame:
    """Markdown reports of all runs as lines: (run_id, section, item, line).

    Sorting by (run_id, section, item) and joining the lines gives the text. As
    rows, a report of any length is written without gathering it in one value. All metrics are
    reported unless ``first`` limits them to the first names of each run.
    """
    known = runs.select(F.col("id").alias("run_id")).where(F.col("run_id").isNotNull())
    ids, marks = known, run_tags.select("run_id", "tag")
    tasks = -(-(runs.count() + run_tags.count()) // task_rows)
    if tasks > int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")):  # more tasks, not larger ones
        ids, marks = ids.repartition(tasks, "run_id"), marks.repartition(tasks, "run_id")
    tags = marks.groupBy("run_id").agg(
        F.array_join(F.array_sort(F.collect_set("tag")), ", ").alias("_tags")
    )
    at = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    # Lines of a run's own row need no join; that of its tags is a row beside them, joined to the bare ids.
    head = runs.where(F.col("id").isNotNull()).select(
        F.col("id").alias("run_id"),
        F.posexplode(
            F.array(
                F.concat(F.lit("# Run Report: "), "name"),
                F.lit(""),
                F.concat(F.lit("**ID:** "), "id"),
                F.concat(F.lit("**Project:** "), "project"),
                F.concat(F.lit("**Status:** "), "status"),
                F.concat(F.lit("**Created:** "), at),
                F.when(
                    F.col("duration_seconds") > 0,
                    F.concat(
                        F.lit("**Duration:** "), F.round("duration_seconds").cast("long"), F.lit("s")
                    ),
                ),
                F.lit(None).cast("string"),  # the place of the tags
                F.lit("\n## Configuration\n\n```json"),
                F.coalesce("config", F.lit("{}")),
                F.lit("```\n"),
                F.lit("## Metrics Summary\n"),
            )
        ).alias("item", "line"),
    )
    head = head.where(F.col("line").isNotNull()).select(
        "run_id", F.lit(0).alias("section"), F.format_string("%04d", "item").alias("item"), "line"
    )
    tagged = tags.join(ids, "run_id").select(
        "run_id",
        F.lit(0).alias("section"),
        F.lit("0007").alias("item"),
        F.concat(F.lit("**Tags:** "), "_tags").alias("line"),
    )

    shown = metrics
    if first is not None:
        shown = metrics.join(first_names(metrics, first).select(*SERIES), SERIES, "left_semi")
    stats = series_statistics(shown, profile, hot_rows)
    body = stats.select(
        "run_id",
        F.lit(1).alias("section"),
        F.col("name").alias("item"),
        F.concat(
            F.format_string("### %s\n- Count: %d\n", "name", "count"),
            *[
                F.concat(
                    F.lit(f"- {label}: "),
                    F.coalesce(X.formatted("%.4f\n", c), F.lit("undefined\n")),
                )
                for label, c in (("Min", "min"), ("Max", "max"), ("Mean", "mean"), ("Std", "std"))
            ],
        ).alias("line"),
    )

    mark = None
    for severity, sign in MARKS.items():
        mark = (F.when if mark is None else mark.when)(F.col("severity") == severity, sign)
    newest = F.lit(10**18) - F.unix_micros("timestamp")
    notes = insights.select(
        "run_id",
        F.lit(3).alias("section"),
        F.concat(newest.cast("string"), F.lit("/"), F.col("id")).alias("item"),
        F.concat(
            F.lit("### "), mark.otherwise(MARKS["info"]), F.lit(" "), "title", F.lit("\n"),
            "description", F.lit("\n"),
        ).alias("line"),
    )
    titles = insights.select("run_id").distinct().select(
        "run_id", F.lit(2).alias("section"), F.lit("").alias("item"), F.lit("## Insights\n").alias("line")
    )
    lines = body.unionByName(titles).unionByName(notes).join(known, "run_id", "left_semi")
    return head.unionByName(tagged).unionByName(lines)
