"""Anomaly, pattern, scenario and insight queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.operators import anomalies as D
from metricloom.operators import insights as I
from metricloom.operators import patterns as P
from metricloom.plans.common import Registry, r, rounded, tables, with_tables

REGISTRY = Registry()
query = REGISTRY.query


# The event values have no trend. ``shaped`` gives the runs different forms: two
# nearly flat, two growing with the step, two decaying, two as they are. ``gappy``
# turns very large values infinite and very small ones NaN.


def shaped(metrics: DataFrame) -> DataFrame:
    v, s = F.col("value"), F.col("step")
    form = (
        F.when(F.col("run_id").isin("0", "1"), 100.0 + v * 0.0001)
        .when(F.col("run_id").isin("2", "3"), v * s / 1000.0)
        .when(F.col("run_id").isin("4", "5"), 1000.0 / (1.0 + s * 0.001) + v * 0.01)
        .otherwise(v)
    )
    return metrics.withColumn("value", form)


def gappy(metrics: DataFrame) -> DataFrame:
    v = F.col("value")
    form = F.when(v > 300, float("inf")).when(v < 0.05, float("nan")).otherwise(v)
    return metrics.withColumn("value", form)


SHAPED = """shaped AS (SELECT run_id, name, step, ts, CASE WHEN run_id IN ('0', '1') THEN 100.0::DOUBLE + value * 0.0001::DOUBLE
    WHEN run_id IN ('2', '3') THEN value * step / 1000.0::DOUBLE
    WHEN run_id IN ('4', '5') THEN 1000.0::DOUBLE / (1.0::DOUBLE + step * 0.001::DOUBLE) + value * 0.01::DOUBLE
    ELSE value END AS value FROM metrics)"""
GAPPY = """gappy AS (SELECT run_id, name, step, ts, CASE WHEN value > 300 THEN 'inf'::DOUBLE
    WHEN value < 0.05 THEN 'nan'::DOUBLE ELSE value END AS value FROM metrics)"""


def outlier_ctes(source: str) -> str:
    """Outliers of ``source`` at the default sensitivity."""
    return f"""fin AS (SELECT * FROM {source} WHERE isfinite(value)),
    st AS (SELECT run_id, name, avg(value) AS mean, stddev_pop(value) AS std,
        quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
        FROM fin GROUP BY run_id, name HAVING count(*) >= 30),
    fr AS (SELECT *, row_number() OVER w - 1 AS idx, avg(value) OVER
        (PARTITION BY run_id, name ORDER BY step ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS recent
        FROM fin WINDOW w AS (PARTITION BY run_id, name ORDER BY step)),
    sc AS (SELECT fr.*, mean, std, q1, q3, CASE WHEN std > 0 THEN abs((value - mean) / std) END AS z
        FROM fr JOIN st USING (run_id, name)),
    hit AS (SELECT *, coalesce(z > 2.4, false) AS by_z,
        value < q1 - 1.3 * (q3 - q1) OR value > q3 + 1.3 * (q3 - q1) AS by_iqr FROM sc),
    out AS (SELECT run_id, name AS metric_name, step, value,
        CASE WHEN value > mean * 10 OR (idx > 10 AND value > recent * 5) THEN 'loss_spike'
            ELSE 'unusual_pattern' END AS anomaly_type,
        CASE WHEN by_z THEN least(1.0, z / 5.0) ELSE 0.7 END AS confidence,
        CASE WHEN by_z THEN mean - 2.4 * std ELSE q1 - 1.3 * (q3 - q1) END AS lo,
        CASE WHEN by_z THEN mean + 2.4 * std ELSE q3 + 1.3 * (q3 - q1) END AS hi,
        CASE WHEN by_z THEN 0 ELSE 1 END AS detector FROM hit WHERE by_z OR by_iqr)"""


NONFINITE = """bad AS (SELECT run_id, name AS metric_name, step,
    CASE WHEN isnan(value) THEN 0.0 ELSE value END AS value FROM {source} JOIN
    (SELECT run_id, name FROM {source} GROUP BY ALL HAVING count(*) >= 30) USING (run_id, name)
    WHERE NOT isfinite(value))"""

LOSSES = """ix AS (SELECT *, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY run_id, name) AS n,
    stddev_pop(value) OVER f AS f_std, avg(abs(value)) OVER f AS f_abs, avg(value) OVER f AS f_mean,
    lead(step, 50) OVER w AS f_end FROM {source} WHERE contains(lower(name), 'loss')
    WINDOW w AS (PARTITION BY run_id, name ORDER BY step),
        f AS (PARTITION BY run_id, name ORDER BY step ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
    plateau AS (SELECT run_id, name AS metric_name, arg_min(step, idx) AS step, arg_min(f_mean, idx) AS value,
        arg_min(f_end, idx) AS end_step FROM ix
        WHERE n >= 50 AND idx < n - 50 AND f_std < 0.001 * f_abs GROUP BY run_id, name),
    edge AS (SELECT run_id, name, avg(value) FILTER (idx < 10) AS early,
        avg(value) FILTER (idx >= n - 10) AS late FROM ix GROUP BY run_id, name HAVING max(n) >= 30),
    diverged AS (SELECT run_id, name AS metric_name, arg_min(step, idx) AS step, arg_min(value, idx) AS value
        FROM ix JOIN edge USING (run_id, name)
        WHERE early > 0 AND late > early * 10 AND idx >= 10 AND value > early * 10 GROUP BY run_id, name)"""


def all_ctes(source: str) -> str:
    bad = NONFINITE.format(source=source)
    losses = LOSSES.format(source=source)
    return f"""{outlier_ctes(source)}, {bad}, {losses},
    found AS (
        SELECT run_id, metric_name, step, value, anomaly_type, confidence, detector,
            CASE WHEN confidence > 0.9 THEN 'critical' ELSE 'warning' END AS severity FROM out
        UNION ALL SELECT run_id, metric_name, step, value, 'loss_nan', 1.0, 2, 'critical' FROM bad
        UNION ALL SELECT run_id, metric_name, step, value, 'loss_plateau', 0.8, 3, 'warning' FROM plateau
        UNION ALL SELECT run_id, metric_name, step, value, 'loss_divergence', 0.9, 4, 'critical' FROM diverged)"""


# -- anomalies ---------------------------------------------------------------

_SHOW = "run_id, metric_name, step, value, anomaly_type"


def _outlier_query(detector: int) -> str:
    return with_tables(
        "metrics",
        body=f"""+ {outlier_ctes("metrics")} SELECT {_SHOW}, {r("confidence")} AS confidence,
        {r("lo")} AS lo, {r("hi")} AS hi FROM out WHERE detector = {detector}""",
    )


def _outliers(spark, folder, detector: int):
    rows = D.outliers(tables.metrics(spark, folder)).where(F.col("detector") == detector)
    return rows.select(
        "run_id",
        "metric_name",
        "step",
        "value",
        "anomaly_type",
        rounded("confidence").alias("confidence"),
        rounded("expected_range.lo").alias("lo"),
        rounded("expected_range.hi").alias("hi"),
    )


@query(_outlier_query(0))
def anomaly_zscore(spark, folder):
    return _outliers(spark, folder, 0)


@query(_outlier_query(1))
def anomaly_iqr(spark, folder):
    return _outliers(spark, folder, 1)


@query(
    with_tables(
        "metrics",
        body=f"""+ {GAPPY}, {NONFINITE.format(source="gappy")}
        SELECT run_id, metric_name, step, isinf(value) AS infinite,
            'NaN/Inf detected in ' || metric_name AS description FROM bad""",
    )
)
def anomaly_nonfinite(spark, folder):
    rows = D.nonfinite(gappy(tables.metrics(spark, folder)))
    infinite = (F.abs("value") == float("inf")).alias("infinite")
    return rows.select("run_id", "metric_name", "step", infinite, "description")


@query(
    with_tables(
        "metrics",
        body=f"""+ {SHAPED}, {LOSSES.format(source="shaped")}
        SELECT run_id, metric_name, step, {r("value")} AS value,
            'Loss plateau detected from step ' || step || ' to ' || end_step AS description FROM plateau""",
    )
)
def anomaly_plateau(spark, folder):
    rows = D.plateaus(shaped(tables.metrics(spark, folder)))
    return rows.select("run_id", "metric_name", "step", rounded("value").alias("value"), "description")


@query(
    with_tables(
        "metrics",
        body=f"""+ {SHAPED}, {LOSSES.format(source="shaped")}
        SELECT run_id, metric_name, step, {r("value")} AS value,
            'Loss divergence detected at step ' || step AS description FROM diverged""",
    )
)
def anomaly_divergence(spark, folder):
    rows = D.divergences(shaped(tables.metrics(spark, folder)))
    return rows.select("run_id", "metric_name", "step", rounded("value").alias("value"), "description")


@query(
    with_tables(
        "metrics",
        body=f"""+ {SHAPED}, {all_ctes("shaped")}
        SELECT run_id, metric_name, step, {r("value")} AS value, anomaly_type, severity,
            {r("confidence")} AS confidence FROM found""",
    )
)
def anomaly_all(spark, folder):
    rows = D.sort_anomalies(D.detect_anomalies(shaped(tables.metrics(spark, folder))))
    return rows.select(
        "run_id",
        "metric_name",
        "step",
        rounded("value").alias("value"),
        "anomaly_type",
        "severity",
        rounded("confidence").alias("confidence"),
    )


@query(
    with_tables(
        "metrics",
        body=f"""+ {GAPPY}, {all_ctes("gappy")},
        t AS (SELECT run_id, anomaly_type, count(*) AS c FROM found GROUP BY ALL)
        SELECT run_id, CASE WHEN sum(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END) > 0 THEN 'critical'
                ELSE 'warning' END AS status, count(*) AS anomaly_count,
            CAST(count(*) FILTER (severity = 'warning') AS BIGINT) AS warning,
            CAST(count(*) FILTER (severity = 'critical') AS BIGINT) AS critical,
            (SELECT string_agg(anomaly_type || '=' || c, ',' ORDER BY anomaly_type) FROM t WHERE t.run_id = found.run_id) AS by_type
        FROM found GROUP BY run_id""",
    )
)
def anomaly_summary(spark, folder):
    found = D.detect_anomalies(gappy(tables.metrics(spark, folder)))
    rows = D.anomaly_summary(found)
    pairs = F.transform(
        F.array_sort(F.map_entries("by_type")),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return rows.select(
        "run_id", "status", "anomaly_count", "warning", "critical", F.array_join(pairs, ",").alias("by_type")
    )


@query(
    with_tables(
        "metrics",
        body="""SELECT run_id, step, value, CASE WHEN value > 10 THEN 'gradient_explosion'
        ELSE 'gradient_vanishing' END AS anomaly_type FROM metrics
        WHERE name = 'gradient_norm' AND (value > 10 OR value < 1e-7)""",
    )
)
def gradient_anomalies(spark, folder):
    norms = tables.metrics(spark, folder).where(F.col("name") == "gradient_norm")
    return D.gradient_anomalies(norms).select("run_id", "step", "value", "anomaly_type")


# -- patterns ----------------------------------------------------------------

NUMBERED = f"""{SHAPED}, nb AS (SELECT run_id, name, step, value, row_number() OVER w - 1 AS idx,
    count(*) OVER (PARTITION BY run_id, name) AS n, lag(value, 1) OVER w AS v1, lag(value, 2) OVER w AS v2
    FROM shaped WINDOW w AS (PARTITION BY run_id, name ORDER BY step)),
    shape AS (SELECT run_id, name, max(n) AS n, min(step) AS first_step, max(step) AS last_step,
        min(step) FILTER (idx >= n - 50) AS recent_step,
        count(*) FILTER (idx >= 2 AND sign(value - v1) <> sign(v1 - v2)) AS turns,
        avg(value) AS mean, avg(abs(value)) AS mean_abs, regr_slope(value, idx) AS slope,
        regr_syy(value, idx) AS syy, regr_sxx(value, idx) AS sxx, regr_sxy(value, idx) AS sxy,
        regr_slope(value, idx) FILTER (idx >= n - 50) AS recent_slope,
        avg(value) FILTER (idx >= n - 50) AS recent_mean,
        stddev_pop(value) FILTER (idx >= n - 50) AS recent_std,
        avg(value) FILTER (idx < 20) AS early, avg(value) FILTER (idx >= n - 20) AS late
        FROM nb GROUP BY run_id, name),
    ch AS (SELECT run_id, name, max(value) - min(value) AS swing FROM
        (SELECT *, least(20, n // 5) AS size FROM nb WHERE n >= 50)
        WHERE (idx // size) * size < n - size GROUP BY run_id, name, idx // size),
    osc AS (SELECT shape.*, turns / (n - 1) AS rate, amplitude / (mean_abs + 1e-8) AS relative
        FROM shape JOIN (SELECT run_id, name, avg(swing) AS amplitude FROM ch GROUP BY run_id, name)
        USING (run_id, name)),
    con AS (SELECT *, sqrt(greatest(syy - sxy * sxy / sxx, 0) / n) / (abs(mean) + 1e-8) AS noise FROM shape
        WHERE n >= 100 AND contains(name, 'loss')),
    win AS (SELECT run_id, name, w, any_value(n) AS n, regr_slope(value, idx - w * 10) FILTER (idx < w * 10 + 20) AS slope,
        min(step) AS start_step, max(step) FILTER (idx = w * 10 + 20) AS end_step
        FROM nb, unnest(range(0, n // 10 + 1)) AS t(w)
        WHERE n >= 100 AND idx BETWEEN w * 10 AND w * 10 + 20 AND w * 10 < n - 20 GROUP BY run_id, name, w),
    chg AS (SELECT a.run_id, a.name, a.w AS k, a.slope AS before, b.slope AS after, abs(b.slope - a.slope) AS delta,
        a.start_step, a.end_step FROM win a JOIN win b
        ON a.run_id = b.run_id AND a.name = b.name AND b.w = a.w + 1),
    found AS (
        SELECT run_id, name, 'oscillation' AS pattern_type, least(1.0, rate * 2) AS confidence,
            first_step AS start_step, last_step AS end_step, rate AS figure FROM osc
            WHERE n >= 50 AND rate > 0.3 AND relative > 0.1
        UNION ALL SELECT run_id, name, 'healthy_convergence', greatest(0.5, 1.0 - noise), first_step, last_step, noise
            FROM con WHERE slope < 0 AND noise < 0.3
        UNION ALL SELECT run_id, name, 'divergence', least(1.0, (late / early - 1) / 2), recent_step, last_step, recent_slope
            FROM shape WHERE n >= 50 AND contains(name, 'loss') AND recent_slope > 0.01 AND late > early * 1.5
        UNION ALL SELECT run_id, name, 'saturation', greatest(0.5, 1.0 - recent_std / (abs(recent_mean) + 1e-8) * 10),
            recent_step, last_step, recent_mean
            FROM shape WHERE n >= 100 AND recent_std / (abs(recent_mean) + 1e-8) < 0.01
        UNION ALL SELECT run_id, name, 'lr_decay_effect', 0.7, arg_min(start_step, k) FILTER (delta = top),
            arg_min(end_step, k) FILTER (delta = top), arg_min(before, k) FILTER (delta = top)
            FROM (SELECT *, max(delta) OVER (PARTITION BY run_id, name) AS top FROM chg)
            GROUP BY run_id, name HAVING count(*) >= 2 AND max(delta) > 3 * avg(delta) AND max(delta) > 1e-9)"""


def _pattern_sql(kind: str) -> str:
    return with_tables(
        "metrics",
        body=f"""+ {NUMBERED} SELECT run_id, name, start_step, end_step, {r("confidence")} AS confidence,
        {r("figure")} AS figure FROM found WHERE pattern_type = '{kind}'""",
    )


def _pattern_rows(rows: DataFrame, figure: str) -> DataFrame:
    return rows.select(
        "run_id",
        "name",
        "start_step",
        "end_step",
        rounded("confidence").alias("confidence"),
        rounded(F.col("metadata")[figure]).alias("figure"),
    )


def _numbered(spark, folder):
    return P.numbered_series(shaped(tables.metrics(spark, folder))).result()


@query(_pattern_sql("oscillation"))
def pattern_oscillation(spark, folder):
    numbered = _numbered(spark, folder)
    return _pattern_rows(P.oscillation(numbered, P.series_shape(numbered)), "oscillation_rate")


@query(_pattern_sql("healthy_convergence"))
def pattern_convergence(spark, folder):
    return _pattern_rows(P.healthy_convergence(P.series_shape(_numbered(spark, folder))), "noise_ratio")


@query(_pattern_sql("divergence"))
def pattern_divergence(spark, folder):
    return _pattern_rows(P.divergence(P.series_shape(_numbered(spark, folder))), "trend")


@query(_pattern_sql("saturation"))
def pattern_saturation(spark, folder):
    return _pattern_rows(P.saturation(P.series_shape(_numbered(spark, folder))), "saturated_value")


@query(_pattern_sql("lr_decay_effect"))
def pattern_schedule(spark, folder):
    return _pattern_rows(P.schedule_change(_numbered(spark, folder)), "trend_before")


@query(
    with_tables(
        "metrics",
        body=f"""+ {NUMBERED},
        kinds AS (SELECT run_id, name, string_agg(DISTINCT pattern_type, ',' ORDER BY pattern_type) AS patterns
            FROM found GROUP BY run_id, name)
        SELECT s.run_id, s.name, coalesce(patterns, '') AS patterns,
            CASE WHEN contains(patterns, 'healthy_convergence') THEN 'healthy_training'
                WHEN contains(patterns, 'oscillation') THEN 'lr_too_high'
                WHEN contains(patterns, 'divergence') THEN 'training_failing'
                WHEN contains(patterns, 'saturation') THEN 'convergence_or_stuck' ELSE 'unknown' END AS scenario
        FROM (SELECT DISTINCT run_id, name FROM metrics) s LEFT JOIN kinds USING (run_id, name)""",
    )
)
def pattern_scenario(spark, folder):
    metrics = shaped(tables.metrics(spark, folder))
    rows = P.match_scenario(P.detect_patterns(metrics), metrics)
    return rows.select(
        "run_id", "name", F.array_join("patterns_detected", ",").alias("patterns"), "scenario"
    )


# -- insights ----------------------------------------------------------------


@query(
    with_tables(
        "metrics",
        "runs",
        body=f"""+ act AS (SELECT * FROM metrics WHERE run_id IN (SELECT id FROM runs WHERE status = 'running')),
        {GAPPY.replace("FROM metrics", "FROM act")}, {all_ctes("gappy")},
        ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id, anomaly_type ORDER BY
            CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, confidence DESC,
            metric_name, detector, step) AS rank FROM found)
        SELECT run_id, anomaly_type, count(*) AS anomalies, {r("max(confidence)")} AS confidence,
            CASE anomaly_type WHEN 'loss_nan' THEN 'optimization' WHEN 'loss_plateau' THEN 'convergence'
                ELSE 'training_progress' END AS insight_type,
            string_agg(step, ',' ORDER BY rank) FILTER (rank <= 5) AS evidence_steps,
            CASE anomaly_type WHEN 'loss_spike' THEN 'Detected ' || count(*) || ' loss spike(s) during training'
                WHEN 'loss_nan' THEN 'Training produced NaN values - training has failed'
                ELSE 'Loss has stopped decreasing significantly' END AS description
        FROM ranked WHERE anomaly_type IN ('loss_spike', 'loss_plateau', 'loss_nan') GROUP BY run_id, anomaly_type""",
    )
)
def insights_by_type(spark, folder):
    _, insights = I.analyse_runs(gappy(tables.metrics(spark, folder)), tables.runs(spark, folder))
    steps = F.transform("evidence", lambda e: e["step"].cast("string"))
    return insights.select(
        "run_id",
        "anomaly_type",
        "anomalies",
        rounded("confidence").alias("confidence"),
        "insight_type",
        F.array_join(steps, ",").alias("evidence_steps"),
        "description",
    )


@query(
    with_tables(
        "metrics",
        body=f"""+ {SHAPED}, {all_ctes("shaped")},
        c AS (SELECT run_id, count(*) FILTER (severity = 'critical') AS critical,
            count(*) FILTER (severity = 'warning') AS warning FROM found GROUP BY run_id),
        b AS (SELECT run_id, max(step) AS total_steps,
            arg_max(value, step) FILTER (name = 'train_loss') AS current,
            arg_min(value, step) FILTER (name = 'train_loss') AS initial,
            min(value) FILTER (name = 'train_loss') AS best,
            max(value) FILTER (name = 'gradient_norm') AS grad FROM shaped GROUP BY run_id),
        l AS (SELECT run_id, value, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS k
            FROM shaped WHERE name = 'train_loss'),
        s AS (SELECT run_id, regr_slope(value, -k) AS trend FROM l WHERE k <= 50 GROUP BY run_id)
        SELECT b.run_id, total_steps, {r("current")} AS loss_current, {r("best")} AS loss_best,
            {r("trend")} AS loss_trend, {r("(initial - current) / nullif(initial, 0)")} AS loss_reduction,
            CASE WHEN critical > 0 THEN 'critical' WHEN warning > 0 THEN 'warning' ELSE 'info' END AS severity,
            CASE WHEN critical > 0 THEN 'Found ' || critical || ' critical issues requiring immediate attention.'
                WHEN warning > 0 THEN 'Training is progressing but ' || warning || ' warnings detected.'
                ELSE 'No significant issues detected.' END AS summary,
            concat_ws(';', CASE WHEN trend >= 0 THEN 'Loss is not decreasing - review learning rate and architecture' END,
                CASE WHEN grad > 10 THEN 'Enable gradient clipping to prevent instability' END) AS advice
        FROM b LEFT JOIN s USING (run_id) LEFT JOIN c USING (run_id)""",
    )
)
def training_summary(spark, folder):
    metrics = shaped(tables.metrics(spark, folder))
    rows = I.training_summary(I.training_figures(metrics), D.detect_anomalies(metrics))
    advice = F.array_join("recommendations", ";")
    return rows.select(
        "run_id",
        "total_steps",
        *[rounded(c).alias(c) for c in ("loss_current", "loss_best", "loss_trend", "loss_reduction")],
        "severity",
        "summary",
        F.when(advice == "Continue monitoring", "").otherwise(advice).alias("advice"),
    )


@query(
    with_tables(
        "metrics",
        body=f"""+ {outlier_ctes("metrics")},
        g AS (SELECT run_id, value, step - lag(step) OVER (PARTITION BY run_id ORDER BY step) AS gap
            FROM out WHERE anomaly_type = 'loss_spike')
        SELECT run_id, count(*) AS spikes, {r("avg(value)")} AS mean_spike, {r("avg(gap)")} AS mean_interval,
            {r("stddev_pop(gap)")} AS std_interval,
            coalesce(count(*) > 1 AND stddev_pop(gap) < avg(gap) * 0.1, false) AS regular,
            CASE WHEN avg(value) > 10 THEN 'SEVERE' WHEN avg(value) > 2 THEN 'MODERATE' ELSE 'MINOR' END AS size
        FROM g GROUP BY run_id""",
    )
)
def spike_regularity(spark, folder):
    rows = I.spike_regularity(D.outliers(tables.metrics(spark, folder)))
    return rows.withColumns({c: rounded(c) for c in ("mean_spike", "mean_interval", "std_interval")})


@query(
    with_tables(
        "metrics",
        body=f"""+ {SHAPED}, ix AS (SELECT run_id, name, value, row_number() OVER
            (PARTITION BY run_id, name ORDER BY step) - 1 AS idx FROM shaped),
        s AS (SELECT run_id, regr_slope(value, idx) FILTER (name = 'train_loss') AS a,
            regr_slope(value, idx) FILTER (name = 'val_loss') AS b FROM ix GROUP BY run_id),
        g AS (SELECT run_id, avg(value) AS gpu FROM shaped WHERE name = 'accuracy' GROUP BY run_id)
        SELECT run_id, 'overfitting_detected' AS scenario, 'Potential Overfitting Detected' AS title FROM s
            WHERE a < 0 AND b > 0
        UNION ALL SELECT run_id, 'gpu_underutilized', 'GPU Underutilization' FROM g WHERE gpu < 70""",
    )
)
def template_insights(spark, folder):
    rows = I.template_insights(shaped(tables.metrics(spark, folder)), gpu="accuracy")
    return rows.select("run_id", "scenario", "title")
