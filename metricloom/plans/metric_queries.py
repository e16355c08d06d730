"""Metric look-ups, statistics, windows and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom import model
from metricloom.operators import insights as I
from metricloom.operators import metrics as M
from metricloom.plans.common import Registry, r, rounded, tables, with_tables

REGISTRY = Registry()
query = REGISTRY.query


@query(
    with_tables(
        "metrics",
        body="""SELECT run_id, step, value FROM metrics
        WHERE name = 'train_loss' AND step >= 100 AND step <= 1000000000""",
    )
)
def metric_range(spark, folder):
    rows = M.metric_range(tables.metrics(spark, folder), "train_loss", 100, 1_000_000_000)
    return rows.select("run_id", "step", "value")


@query(with_tables("metrics", body="SELECT DISTINCT run_id, name FROM metrics"))
def metric_names(spark, folder):
    return M.metric_names(tables.metrics(spark, folder))


@query(
    with_tables(
        "metrics",
        body="SELECT run_id, min(step) AS min_step, max(step) AS max_step FROM metrics GROUP BY run_id",
    )
)
def step_range(spark, folder):
    return M.step_range(tables.metrics(spark, folder))


@query(
    with_tables(
        "metrics",
        body=f"""SELECT run_id, name, count(*) AS "count", min(value) AS "min", max(value) AS "max",
        {r("avg(value)")} AS "mean", {r("stddev_samp(value)")} AS "std",
        {r("quantile_cont(value, 0.5)")} AS "median" FROM metrics GROUP BY run_id, name""",
    )
)
def series_stats(spark, folder):
    stats = M.series_statistics(tables.metrics(spark, folder))
    return stats.withColumns({c: rounded(c) for c in ("mean", "std", "median")})


@query(
    with_tables(
        "metrics",
        body=f"""SELECT run_id, name, step, value, {r("avg(value) OVER w")} AS moving_avg FROM metrics
        WINDOW w AS (PARTITION BY run_id, name ORDER BY step ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""",
    )
)
def moving_average(spark, folder):
    rows = M.moving_average(tables.metrics(spark, folder), 100)
    return rows.withColumn("moving_avg", rounded("moving_avg"))


@query(
    with_tables(
        "metrics",
        body="""SELECT run_id, name, step, value, rank FROM (SELECT *, row_number() OVER
        (PARTITION BY run_id, name ORDER BY step DESC) AS rank FROM metrics) WHERE rank <= 5""",
    )
)
def latest_n(spark, folder):
    rows = M.latest_points(tables.metrics(spark, folder), 5)
    return rows.select("run_id", "name", "step", "value", F.col("rank").cast("long").alias("rank"))


@query(
    with_tables(
        "metrics",
        "runs",
        body="""+ ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id, name ORDER BY step DESC) AS rank,
            lead(value) OVER (PARTITION BY run_id, name ORDER BY step DESC) AS previous FROM metrics)
        SELECT m.run_id, m.name, r.name AS run_name, step, value,
            CASE WHEN value > previous THEN 'up' WHEN value < previous THEN 'down' ELSE 'flat' END AS trend,
            printf('%.4f', value) || ' @ step ' || step AS label
        FROM ranked m JOIN runs r ON m.run_id = r.id WHERE rank = 1 AND status = 'running'""",
    )
)
def live_trend(spark, folder):
    return M.live_metrics(
        tables.metrics(spark, folder), tables.runs(spark, folder), max_runs=None, max_names=5
    )


@query(
    with_tables(
        "metrics", body="SELECT run_id, name, step, value FROM metrics WHERE step % 10 = 0"
    )
)
def metric_thin_every_n(spark, folder):
    rows = M.thin_every(tables.metrics(spark, folder), 10)
    return rows.select("run_id", "name", "step", "value")


@query(
    " UNION ALL ".join(
        f"SELECT CAST(l_orderkey AS VARCHAR) AS run_id, CAST(l_linenumber AS BIGINT) AS step, "
        f"'{c}' AS name, l_{c} AS value FROM lineitem"
        for c in ("quantity", "extendedprice", "discount", "tax")
    )
)
def metric_melt(spark, folder):
    lines = tables.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("run_id"),
        F.col("l_linenumber").cast("long").alias("step"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("extendedprice"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )
    values = ["quantity", "extendedprice", "discount", "tax"]
    return M.melt(lines, ["run_id", "step"], values).drop("metadata")


@query(
    """WITH shapes AS (SELECT vec_id, len(embedding) AS d FROM embeddings)
    SELECT CAST(vec_id AS BIGINT) AS step, 'vector/shape' AS name, CAST(d AS DOUBLE) AS value,
        '{"shape":[1,' || d || ']}' AS metadata FROM shapes"""
)
def metric_melt_shapes(spark, folder):
    rows = tables.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("step"), F.array(F.lit(1), F.size("embedding")).alias("vector")
    )
    return M.melt(rows, ["step"], [], ["vector"])


@query(
    """WITH rows AS (SELECT CAST(user_id % 8 AS VARCHAR) AS run_id, event_id,
        CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE event_id // 16 END AS step FROM events),
    counted AS (SELECT *, coalesce(sum(CASE WHEN step IS NULL THEN 1 ELSE 0 END) OVER
        (PARTITION BY run_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nulls
        FROM rows),
    lifted AS (SELECT *, max(step + 1 - nulls) OVER
        (PARTITION BY run_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lift
        FROM counted)
    SELECT run_id, event_id, CAST(coalesce(step, nulls + greatest(0, coalesce(lift, 0))) AS BIGINT) AS step
    FROM lifted"""
)
def step_autonumber(spark, folder):
    rows = tables.table(spark, folder, "events").select(
        tables.run_of_user().alias("run_id"),
        "event_id",
        F.when(
            ~F.col("event_type").isin("view", "click"), F.floor(F.col("event_id") / 16)
        ).alias("step"),
    )
    return M.autonumber_steps(rows, "event_id")


_KEYS = {
    "error": "train_loss",
    "signup": "eval_loss",
    "click": "train_learning_rate",
    "purchase": "train_runtime",
    "view": "eval_accuracy",
}


@query(
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'train/loss' WHEN 'signup' THEN 'eval/loss'
        WHEN 'click' THEN 'learning_rate' ELSE 'eval/accuracy' END AS name, value
    FROM events WHERE event_type <> 'purchase'"""
)
def log_key_normalise(spark, folder):
    events = tables.table(spark, folder, "events")
    keyed = events.withColumn("key", tables.mapped("event_type", _KEYS))
    return M.normalise_log_keys(keyed).select("event_id", "name", "value")


@query(with_tables("metrics", body="SELECT run_id, step, value FROM metrics WHERE name LIKE '%val%'"))
def stage_metrics(spark, folder):
    return M.stage_metrics(tables.metrics(spark, folder), "val").select("run_id", "step", "value")


@query(
    with_tables(
        "metrics",
        body=f"""SELECT run_id, name, step // 500 AS bucket, {r("avg(value)")} AS value
        FROM metrics GROUP BY ALL""",
    )
)
def bucket_mean(spark, folder):
    rows = M.bucket_values(tables.metrics(spark, folder), 500, "mean")
    return rows.withColumn("value", rounded("value"))


@query(
    with_tables(
        "metrics",
        body="""SELECT run_id, name, step // 500 AS bucket, max_by(value, step) AS value
        FROM metrics GROUP BY ALL""",
    )
)
def bucket_last(spark, folder):
    return M.bucket_values(tables.metrics(spark, folder), 500, "last")


ALL_RUNS = [str(i) for i in range(tables.N_RUNS)]


@query(with_tables("metrics", body="SELECT run_id, step, value FROM metrics WHERE name = 'val_loss'"))
def compare_runs_long(spark, folder):
    return M.compare_runs(tables.metrics(spark, folder), ALL_RUNS, "val_loss")


@query(
    with_tables(
        "metrics",
        body="SELECT step // 100 AS step, "
        + ", ".join(f"arg_min(value, step) FILTER (run_id = '{i}') AS run_{i}" for i in ALL_RUNS)
        + " FROM metrics WHERE name = 'val_loss' GROUP BY ALL",
    )
)
def compare_runs_wide(spark, folder):
    wide = M.compare_runs_wide(tables.metrics(spark, folder), ALL_RUNS, "val_loss", 100)
    return wide.select("step", *[F.col(i).alias(f"run_{i}") for i in ALL_RUNS])


@query(
    with_tables(
        "metrics",
        body="""SELECT run_id, min(value) AS best, max_by(value, step) AS final, count(*) AS points,
        rank() OVER (ORDER BY min(value)) AS rank FROM metrics WHERE name = 'train_loss' GROUP BY run_id""",
    )
)
def run_leaderboard(spark, folder):
    board = M.leaderboard(tables.metrics(spark, folder), "train_loss")
    return board.select("run_id", "best", "final", "points", F.col("rank").cast("long").alias("rank"))


@query(
    with_tables(
        "metrics",
        body=f"""+ s AS (SELECT run_id, max_by(value, step) AS final, min(value) AS best, count(*) AS points
            FROM metrics WHERE name = 'train_loss' GROUP BY run_id),
        p AS (SELECT a.run_id AS run_a, b.run_id AS run_b, a.best AS best_a, b.best AS best_b,
            a.final AS final_a, b.final AS final_b, a.points AS points_a, b.points AS points_b
            FROM s a JOIN s b ON CAST(b.run_id AS INT) = CAST(a.run_id AS INT) + 1)
        SELECT *, CASE WHEN best_a < best_b THEN run_a ELSE run_b END AS winner,
            {r("(greatest(best_a, best_b) - least(best_a, best_b)) / nullif(greatest(best_a, best_b), 0) * 100")} AS improvement
        FROM p""",
    )
)
def comparison_insight(spark, folder):
    metrics = tables.metrics(spark, folder)
    ids = metrics.select("run_id").distinct()
    nxt = (F.col("run_id").cast("int") + 1).cast("string")
    pairs = (
        ids.select(F.col("run_id").alias("run_a"), nxt.alias("run_b"))
        .join(ids.select(F.col("run_id").alias("run_b")), "run_b", "left_semi")
    )
    out = I.compare_pairs(metrics, pairs, "train_loss")
    return out.select(
        "run_a", "run_b", "best_a", "best_b", "final_a", "final_b", "points_a", "points_b",
        "winner", rounded("improvement").alias("improvement"),
    )


CHART_POINTS = 10


@query(
    with_tables(
        "metrics",
        body=f"""+ p AS (SELECT run_id, name, step, value, row_number() OVER w - 1 AS idx,
            count(*) OVER (PARTITION BY run_id, name) AS n FROM metrics WHERE isfinite(value)
            WINDOW w AS (PARTITION BY run_id, name ORDER BY step, ts, value)),
        b AS (SELECT *, CASE WHEN idx = 0 THEN 0 WHEN idx = n - 1 THEN {CHART_POINTS - 1}
            ELSE (idx * {CHART_POINTS - 2} - 1) // (n - 2) + 1 END AS bucket FROM p WHERE n > {CHART_POINTS}),
        c AS (SELECT run_id, name, bucket - 1 AS bucket, avg(step) AS cx, avg(value) AS cy FROM b GROUP BY ALL),
        q AS (SELECT b.*, cx, cy FROM b LEFT JOIN c USING (run_id, name, bucket)),
        walk AS (SELECT run_id, name, bucket, {{'x': step, 'y': value}} AS pt FROM q WHERE bucket = 0
            UNION ALL
            SELECT q.run_id, q.name, q.bucket, first({{'x': q.step, 'y': q.value}} ORDER BY
                abs((w.pt.x - cx) * (q.value - w.pt.y) - (w.pt.x - q.step) * (cy - w.pt.y)) DESC, q.idx)
            FROM walk w JOIN q ON q.run_id = w.run_id AND q.name = w.name AND q.bucket = w.bucket + 1
            GROUP BY q.run_id, q.name, q.bucket)
        SELECT run_id, name, step, value FROM p WHERE n <= {CHART_POINTS}
        UNION ALL SELECT run_id, name, pt.x, pt.y FROM walk""",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def lttb_downsample(spark, folder):
    return M.downsample(tables.metrics(spark, folder), CHART_POINTS)


@query(
    with_tables(
        "metrics",
        body="""SELECT run_id, step, 'throughput/tokens_per_second' AS name, value * 512 AS value
            FROM metrics WHERE name = 'accuracy'
        UNION ALL SELECT run_id, step, 'throughput/samples_per_second', value FROM metrics
            WHERE name = 'accuracy'""",
    )
)
def token_throughput(spark, folder):
    rows = tables.metrics(spark, folder).where(F.col("name") == "accuracy")
    return M.token_throughput(rows.withColumn("name", F.lit("train_samples_per_second")))


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS run_id, 'checkpoint/epoch' AS name,
        CAST(o_custkey AS DOUBLE) AS value FROM orders
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'checkpoint/global_step', o_totalprice FROM orders"""
)
def checkpoint_rows(spark, folder):
    orders = tables.table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.col("o_custkey").alias("epoch"),
        F.col("o_totalprice").alias("global_step"),
    )
    return M.named_rows(orders, ["run_id"], M.CHECKPOINT_ROWS)


@query(
    """SELECT CAST(label AS VARCHAR) AS run_id, vec_id AS step, 'learning_rate/group_' || (pos - 1) AS name,
        CAST(embedding[pos] AS DOUBLE) AS value
    FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(pos)"""
)
def learning_rate_rows(spark, folder):
    rows = tables.table(spark, folder, "embeddings").select(
        F.col("label").cast("string").alias("run_id"),
        F.col("vec_id").alias("step"),
        F.col("embedding").alias("lrs"),
    )
    return M.learning_rate_rows(rows)


@query(
    """WITH s AS (SELECT CAST(l_orderkey AS VARCHAR) AS run_id, l_linenumber AS device,
        l_extendedprice AS b, count(*) OVER (PARTITION BY l_orderkey) AS devices FROM lineitem)
    SELECT run_id, CASE WHEN devices > 1 THEN 'gpu' || device || '/' ELSE '' END || 'memory/' || k || '_gb' AS name,
        round(b * f / 1073741824.0, 9) AS value
    FROM s, (VALUES ('allocated', 1.0), ('reserved', 2.0), ('max_allocated', 4.0)) AS t(k, f)"""
)
def device_memory_rows(spark, folder):
    lines = tables.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    devices = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("device_count"))
    b = F.col("l_extendedprice")
    stats = lines.join(devices, "l_orderkey").select(
        F.col("l_orderkey").cast("string").alias("run_id"),
        F.lit(0).alias("step"),
        F.col("l_linenumber").alias("device"),
        "device_count",
        b.alias("allocated"),
        (b * 2).alias("reserved"),
        (b * 4).alias("max_allocated"),
    )
    rows = M.device_memory_rows(stats)
    return rows.select("run_id", "name", F.round("value", 9).alias("value"))


@query(
    with_tables(
        "metrics",
        body="""SELECT name, count(*) AS points, min(step) AS first_step
        FROM metrics WHERE step >= 10 GROUP BY name""",
    )
)
def raw_sql(spark, folder):
    model.register_views({"metrics": tables.metrics(spark, folder)})
    return model.sql(
        spark,
        "SELECT name, count(*) AS points, min(step) AS first_step FROM metrics "
        "WHERE step >= :first GROUP BY name",
        {"first": 10},
    )
