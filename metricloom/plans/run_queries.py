"""Run catalogue, artifact, vote and feed queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.functions.expressions import safe_file_name
from metricloom.operators import artifacts as A
from metricloom.operators import insights as I
from metricloom.operators import runs as R
from metricloom.plans.common import Registry, clock, clock_sql, r, rounded, tables, with_tables

REGISTRY = Registry()
query = REGISTRY.query


# -- runs --------------------------------------------------------------------


@query(
    with_tables(
        "runs",
        body=f"""SELECT id, name, project, status, {clock_sql("created_at")} AS created FROM runs
        WHERE status = 'completed' ORDER BY created_at DESC, id DESC LIMIT 100 OFFSET 10""",
    )
)
def runs_list(spark, folder):
    rows = R.list_runs(tables.runs(spark, folder), status="completed", limit=100, offset=10)
    return rows.select("id", "name", "project", "status", clock("created_at").alias("created"))


@query(
    with_tables(
        "runs",
        body="""SELECT substr(id, 1, 8) AS id, name, project, status,
        strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at FROM runs""",
    )
)
def runs_short(spark, folder):
    return R.short_listing(tables.runs(spark, folder))


@query(
    with_tables(
        "runs",
        "run_tags",
        body="""SELECT id, status FROM runs WHERE id IN (SELECT run_id FROM run_tags
        WHERE tag IN ('A', 'R') GROUP BY run_id HAVING count(DISTINCT tag) = 2)""",
    )
)
def runs_by_tag(spark, folder):
    rows = R.runs_with_tags(tables.runs(spark, folder), tables.run_tags(spark, folder), ["A", "R"])
    return rows.select("id", "status")


@query(with_tables("run_tags", body="SELECT DISTINCT run_id, tag FROM run_tags"))
def tags_deduped(spark, folder):
    return R.dedupe_tags(tables.run_tags(spark, folder))


@query(
    with_tables(
        "runs",
        "run_tags",
        body="""+ t AS (SELECT run_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM run_tags GROUP BY run_id)
        SELECT id, status, CAST(custkey AS VARCHAR) AS custkey, CAST(totalprice AS VARCHAR) AS totalprice,
            priority, coalesce(tags, '') AS tags FROM runs LEFT JOIN t ON id = run_id""",
    )
)
def run_detail(spark, folder):
    rows = R.run_detail(tables.runs(spark, folder), tables.run_tags(spark, folder))
    return rows.select(
        "id",
        "status",
        F.col("config")["custkey"].alias("custkey"),
        F.col("config")["totalprice"].cast("decimal(18,2)").cast("string").alias("totalprice"),
        F.col("config")["priority"].alias("priority"),
        F.array_join("tags", ",").alias("tags"),
    )


@query(
    with_tables(
        "runs",
        body=f"""SELECT id, status, {clock_sql("created_at")} AS created FROM
        (SELECT * FROM runs ORDER BY created_at DESC, id DESC LIMIT 50)
        ORDER BY CASE WHEN status = 'running' THEN 0 ELSE 1 END, created_at DESC, id DESC LIMIT 1""",
    )
)
def default_run(spark, folder):
    rows = R.default_run(tables.runs(spark, folder))
    return rows.select("id", "status", clock("created_at").alias("created"))


_EVENTS_SQL = """events_ AS (SELECT CAST(l_orderkey AS VARCHAR) AS id,
    CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'R' THEN 'failed' ELSE 'running' END AS status,
    l_quantity AS duration, l_shipdate AS moment FROM lineitem)"""


@query(
    with_tables(
        "runs",
        body=f"""+ {_EVENTS_SQL},
        last AS (SELECT id, max({{'moment': moment, 'status': status, 'duration': duration}}) AS l,
            max({{'moment': moment, 'status': status, 'duration': duration}}) FILTER (status <> 'running') AS e
            FROM events_ GROUP BY id)
        SELECT runs.id, coalesce(l.status, runs.status) AS status,
            {clock_sql("coalesce(l.moment, created_at)")} AS updated,
            {clock_sql("coalesce(e.moment, CASE WHEN runs.status <> 'running' THEN created_at + INTERVAL 1 DAY END)")} AS finished,
            CASE WHEN e IS NOT NULL THEN e.duration ELSE duration_seconds END AS duration_seconds
        FROM runs LEFT JOIN last ON runs.id = last.id""",
    )
)
def run_status_latest(spark, folder):
    events = tables.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("run_id"),
        F.when(F.col("l_returnflag") == "A", "completed")
        .when(F.col("l_returnflag") == "R", "failed")
        .otherwise("running")
        .alias("status"),
        F.col("l_quantity").alias("duration_seconds"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
    )
    rows = R.apply_status_events(tables.runs(spark, folder), events)
    return rows.select(
        "id",
        "status",
        clock("updated_at").alias("updated"),
        clock("finished_at").alias("finished"),
        "duration_seconds",
    )


def _neighbours(runs):
    """Pairs of consecutive runs."""
    nxt = (F.col("id").cast("long") + 1).cast("string")
    pairs = runs.select(F.col("id").alias("run_a"), nxt.alias("run_b"))
    return pairs.join(runs.select(F.col("id").alias("run_b")), "run_b", "left_semi")


_CONFIG_SQL = """+ k AS (SELECT id, 'custkey' AS key, CAST(custkey AS VARCHAR) AS v FROM runs
        UNION ALL SELECT id, 'totalprice', CAST(totalprice AS VARCHAR) FROM runs
        UNION ALL SELECT id, 'priority', priority FROM runs),
    p AS (SELECT id AS run_a, CAST(CAST(id AS BIGINT) + 1 AS VARCHAR) AS run_b FROM runs
        WHERE CAST(CAST(id AS BIGINT) + 1 AS VARCHAR) IN (SELECT id FROM runs))"""


@query(
    with_tables(
        "runs",
        body=_CONFIG_SQL
        + """ SELECT run_a, run_b, a.key AS key, a.v AS a, b.v AS b FROM p JOIN k a ON a.id = run_a
        JOIN k b ON b.id = run_b AND a.key = b.key WHERE a.v <> b.v""",
    )
)
def config_diff(spark, folder):
    runs = tables.runs(spark, folder)
    number = F.col("key") == "totalprice"
    plain = lambda c: F.when(number, F.col(c).cast("decimal(18,2)").cast("string")).otherwise(F.col(c))
    rows = R.config_diff(runs, _neighbours(runs)).where("differs")
    return rows.select("run_a", "run_b", "key", plain("a").alias("a"), plain("b").alias("b"))


_ODD_SQL = """+ c AS (SELECT id, CASE WHEN status = 'running' THEN ['custkey', 'priority']
        WHEN status = 'failed' THEN ['note', 'priority'] ELSE ['custkey', 'priority', 'totalprice'] END AS keys
        FROM runs),
    p AS (SELECT a.id AS run_a, b.id AS run_b, a.keys AS ka, b.keys AS kb FROM c a JOIN c b
        ON CAST(b.id AS BIGINT) = CAST(a.id AS BIGINT) + 1)"""


def _uneven(runs):
    """Runs whose configuration keys depend on the status."""
    config = (
        F.when(F.col("status") == "running", '{"custkey":"1","priority":"x"}')
        .when(F.col("status") == "failed", '{"note":"n","priority":"x"}')
        .otherwise('{"custkey":"1","totalprice":"2","priority":"x"}')
    )
    return runs.select("id", config.alias("config"))


@query(
    with_tables(
        "runs",
        body=_ODD_SQL
        + """ SELECT run_a, run_b,
            array_to_string(list_sort(list_distinct(list_concat(ka, kb))), ',') AS all_keys,
            array_to_string(list_sort(list_filter(ka, lambda x: NOT list_contains(kb, x))), ',') AS only_in_a,
            array_to_string(list_sort(list_filter(kb, lambda x: NOT list_contains(ka, x))), ',') AS only_in_b
        FROM p""",
    )
)
def config_only_in(spark, folder):
    runs = tables.runs(spark, folder)
    rows = R.config_key_sets(_uneven(runs), _neighbours(runs))
    return rows.select(
        "run_a",
        "run_b",
        *[F.array_join(c, ",").alias(c) for c in ("all_keys", "only_in_a", "only_in_b")],
    )


@query(
    with_tables(
        "runs",
        body=_ODD_SQL
        + """, k AS (SELECT run_a, run_b, unnest(list_distinct(list_concat(ka, kb))) AS key, ka, kb FROM p)
        SELECT run_a, run_b, key, list_contains(ka, key) AND NOT list_contains(kb, key) AS only_in_a,
            list_contains(kb, key) AND NOT list_contains(ka, key) AS only_in_b
        FROM k WHERE list_contains(ka, key) <> list_contains(kb, key)""",
    )
)
def config_diff_exclusive(spark, folder):
    runs = tables.runs(spark, folder)
    rows = R.config_diff(_uneven(runs), _neighbours(runs), mode="exclusive")
    return rows.select("run_a", "run_b", "key", "only_in_a", "only_in_b")


@query(
    with_tables(
        "runs",
        body="""SELECT id, CAST(custkey AS VARCHAR) AS custkey, status AS run_status,
        'x' AS priority FROM runs""",
    )
)
def config_merge(spark, folder):
    runs = tables.runs(spark, folder)
    updates = runs.select(
        "id", F.create_map(F.lit("priority"), F.lit("x"), F.lit("status"), F.col("status")).alias("entries")
    )
    merged = R.merge_config(runs, updates)
    config = F.from_json("config", R.CONFIG_TYPE)
    return merged.select(
        "id",
        config["custkey"].alias("custkey"),
        config["status"].alias("run_status"),
        config["priority"].alias("priority"),
    )


@query(
    with_tables(
        "runs",
        body=f"""SELECT id, {clock_sql("created_at")} AS created FROM runs
        WHERE created_at >= TIMESTAMP '2000-01-01 00:00:00' - INTERVAL 365 DAY""",
    )
)
def retention_filter(spark, folder):
    rows = R.within_retention(tables.runs(spark, folder), 365, "2000-01-01 00:00:00")
    return rows.select("id", clock("created_at").alias("created"))


@query(
    with_tables(
        "runs",
        "run_tags",
        "artifacts",
        body="""+ gone AS (SELECT id FROM runs WHERE status = 'failed')
        SELECT 'runs' AS part, count(*) AS rows FROM runs WHERE id NOT IN (FROM gone)
        UNION ALL SELECT 'run_tags', count(*) FROM run_tags WHERE run_id NOT IN (FROM gone)
        UNION ALL SELECT 'artifacts', count(*) FROM artifacts WHERE run_id NOT IN (FROM gone)""",
    )
)
def run_delete(spark, folder):
    runs = tables.runs(spark, folder)
    gone = runs.where("status = 'failed'").select(F.col("id").alias("run_id"))
    kept = R.delete_runs(
        {
            "runs": runs,
            "run_tags": tables.run_tags(spark, folder),
            "artifacts": tables.artifacts(spark, folder),
        },
        gone,
    )
    out = None
    for name, df in kept.items():
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("part"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


# -- artifacts ---------------------------------------------------------------


@query(
    with_tables(
        "artifacts",
        body=f"""SELECT id, run_id, replace(replace(name, '/', '_'), '.', '_') AS safe_name, size_bytes,
        substr(sha256(id), 1, 16) AS checksum, step, {clock_sql("created_at")} AS created
        FROM artifacts WHERE artifact_type = 'tensor'""",
    )
)
def artifact_catalog(spark, folder):
    rows = A.list_artifacts(tables.artifacts(spark, folder), "tensor")
    return rows.select(
        "id",
        "run_id",
        safe_file_name(F.col("name")).alias("safe_name"),
        "size_bytes",
        "checksum",
        A.artifact_step().cast("int").alias("step"),
        clock("created_at").alias("created"),
    )


@query(
    with_tables(
        "artifacts",
        body="""SELECT id, run_id, name, step FROM artifacts
        WHERE name = 'Brand#7' AND step = 3 ORDER BY created_at, id LIMIT 1""",
    )
)
def artifact_by_step(spark, folder):
    hit = A.artifact_at_step(tables.artifacts(spark, folder), "Brand#7", 3)
    return hit.select("id", "run_id", "name", A.artifact_step().cast("int").alias("step"))


@query(
    with_tables(
        "artifacts",
        body="""SELECT id, run_id, name FROM (SELECT *, row_number() OVER
        (PARTITION BY run_id, name ORDER BY step DESC, id DESC) AS rank FROM artifacts) WHERE rank > 1""",
    )
)
def artifact_keep_last_n(spark, folder):
    return A.expired_artifacts(tables.artifacts(spark, folder), 1).select("id", "run_id", "name")


@query(
    with_tables(
        "runs",
        "artifacts",
        body="""+ newest AS (SELECT id, name FROM runs ORDER BY created_at DESC, id DESC LIMIT 20)
        SELECT a.id, a.run_id, a.name, a.artifact_type, n.name AS run_name
        FROM artifacts a JOIN newest n ON a.run_id = n.id""",
    )
)
def artifact_join_runs(spark, folder):
    rows = A.recent_tensors(tables.runs(spark, folder), tables.artifacts(spark, folder))
    return rows.select("id", "run_id", "name", "artifact_type", "run_name")


# -- votes and feeds ---------------------------------------------------------


@query(
    with_tables(
        "insights",
        "votes",
        body="""SELECT insight_type, CAST(sum(CASE WHEN vote > 0 THEN 1 ELSE 0 END) AS BIGINT) AS up,
        CAST(sum(CASE WHEN vote < 0 THEN 1 ELSE 0 END) AS BIGINT) AS down
        FROM insights i LEFT JOIN votes v ON i.id = v.insight_id GROUP BY insight_type""",
    )
)
def vote_stats(spark, folder):
    return I.vote_statistics(tables.insights(spark, folder), tables.votes(spark, folder))


@query(
    with_tables(
        "insights",
        "votes",
        body="""SELECT i.id, CAST(count(*) FILTER (vote > 0) AS BIGINT) AS votes_up,
        CAST(count(*) FILTER (vote <= 0) AS BIGINT) AS votes_down
        FROM insights i LEFT JOIN votes v ON i.id = v.insight_id GROUP BY i.id""",
    )
)
def vote_apply(spark, folder):
    rows = I.apply_votes(tables.insights(spark, folder), tables.votes(spark, folder))
    return rows.select("id", "votes_up", "votes_down")


@query(
    with_tables(
        "insights",
        body="""SELECT id, run_id, severity, 'loss,learning_rate' AS related FROM insights
        WHERE severity = 'critical'""",
    )
)
def insight_list(spark, folder):
    rows = I.list_insights(tables.insights(spark, folder), severity="critical")
    return rows.select("id", "run_id", "severity", F.array_join("related_metrics", ",").alias("related"))


_FEED_RUNS = """newest AS (SELECT id, name FROM runs WHERE id IN (SELECT run_id FROM insights)
    ORDER BY created_at DESC, id DESC LIMIT 10)"""


@query(
    with_tables(
        "runs",
        "insights",
        body=f"""+ {_FEED_RUNS},
        ranked AS (SELECT i.*, n.name AS run_name, row_number() OVER
            (PARTITION BY i.run_id ORDER BY seq DESC) AS rank
            FROM insights i JOIN newest n ON i.run_id = n.id)
        SELECT id, run_id, run_name, title FROM ranked WHERE rank <= 5 ORDER BY seq DESC LIMIT 20""",
    )
)
def insight_feed(spark, folder):
    insights = tables.insights(spark, folder)
    runs = tables.runs(spark, folder)
    # Only some orders carry insights in these tables; the feed looks at those.
    noted = runs.join(insights.select(F.col("run_id").alias("id")), "id", "left_semi")
    return I.insight_feed(noted, insights).select("id", "run_id", "run_name", "title")


@query(
    with_tables(
        "metrics",
        "runs",
        body="""SELECT m.run_id, m.name, step, value, r.name AS run_name, project, status
        FROM metrics m JOIN runs r ON m.run_id = r.id""",
    )
)
def run_dashboard(spark, folder):
    return I.dashboard_points(tables.metrics(spark, folder), tables.runs(spark, folder))


@query(
    with_tables(
        "metrics",
        "runs",
        body="""SELECT m.run_id, m.name, step, value, status FROM metrics m JOIN runs r ON m.run_id = r.id
        WHERE m.name IN ('loss', 'accuracy', 'learning_rate')""",
    )
)
def run_dashboard_preset(spark, folder):
    rows = I.dashboard_points(
        tables.metrics(spark, folder),
        tables.runs(spark, folder),
        names=I.PRESETS["training_dashboard_basic"],
    )
    return rows.select("run_id", "name", "step", "value", "status")


@query(
    with_tables(
        "insights",
        body="SELECT run_id, count(*) AS insights FROM insights GROUP BY run_id",
    )
)
def analysis_stats(spark, folder):
    return I.analysis_statistics(tables.insights(spark, folder))


@query(
    with_tables(
        "metrics",
        "runs",
        "run_tags",
        "insights",
        body=f"""+ t AS (SELECT run_id, string_agg(DISTINCT tag, ', ' ORDER BY tag) AS tags FROM run_tags GROUP BY run_id),
        s AS (SELECT run_id, name, count(*) AS n, min(value) AS lo, max(value) AS hi,
            avg(value) AS mean, stddev_samp(value) AS std FROM metrics GROUP BY run_id, name),
        lines AS (
        SELECT id AS run_id, 0 AS section, 'name' AS part, '# Run Report: ' || name AS line FROM runs
        UNION ALL SELECT id, 0, 'status', '**Status:** ' || status FROM runs
        UNION ALL SELECT id, 0, 'duration', '**Duration:** 86400s' FROM runs WHERE duration_seconds > 0
        UNION ALL SELECT id, 0, 'tags', '**Tags:** ' || tags FROM runs JOIN t ON t.run_id = runs.id
        UNION ALL SELECT id, 0, 'fixed', unnest(['', '**ID:** ' || id, '**Project:** ' || project,
            '**Created:** ' || strftime(created_at, '%Y-%m-%dT%H:%M:%S'),
            chr(10) || '## Configuration' || chr(10) || chr(10) || '```json',
            '{{"custkey":' || custkey || ',"totalprice":' || totalprice || ',"priority":"' || priority || '"}}',
            '```' || chr(10), '## Metrics Summary' || chr(10)]) FROM runs
        UNION ALL SELECT run_id, 1, name, '### ' || name || chr(10) || '- Count: ' || n || chr(10)
            || '- Min: ' || printf('%.4f', lo) || chr(10) || '- Max: ' || printf('%.4f', hi) || chr(10)
            || '- Mean: ' || printf('%.4f', mean) || chr(10) || '- Std: ' || printf('%.4f', std) || chr(10) FROM s
        UNION ALL SELECT DISTINCT run_id, 2, '', '## Insights' || chr(10) FROM insights
        UNION ALL SELECT run_id, 3, '', '### ' || CASE severity WHEN 'critical' THEN '🔴' WHEN 'warning' THEN '🟡'
            ELSE '🔵' END || ' ' || title || chr(10) || description || chr(10) FROM insights)
        SELECT run_id, section, line FROM lines WHERE run_id IN (SELECT id FROM runs)""",
    )
)
def run_report(spark, folder):
    lines = I.run_report(
        tables.runs(spark, folder),
        tables.run_tags(spark, folder),
        tables.metrics(spark, folder),
        tables.insights(spark, folder),
    )
    return lines.select("run_id", "section", "line")


@query(
    with_tables(
        "runs",
        body=f"""SELECT count(*) AS total_runs, {r("avg(totalprice)", 2)} AS mean_price FROM runs""",
    )
)
def store_info(spark, folder):
    runs = tables.runs(spark, folder)
    price = F.get_json_object("config", "$.totalprice").cast("double")
    return runs.agg(F.count(F.lit(1)).alias("total_runs"), rounded(F.avg(price), 2).alias("mean_price"))
