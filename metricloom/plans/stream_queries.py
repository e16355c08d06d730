"""Telemetry rollups and Structured Streaming queries.

The streaming queries replay the event table as a file stream until it is used
up and return what the sink holds.
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.operators import telemetry as T
from metricloom.operators.audit import verify_chain, verify_summary
from metricloom.plans.analysis_queries import GAPPY, all_ctes, gappy
from metricloom.plans.common import (
    RUN_OF_USER,
    Registry,
    clock,
    clock_sql,
    r,
    rounded,
    tables,
    with_tables,
)
from metricloom.plans.security_queries import _recursive, chain_sql
from metricloom.session import STATE_STORE, new_work_folder
from metricloom.sources import messages as M
from metricloom.streaming import analysis, ingest, rollup, state

REGISTRY = Registry()
query = REGISTRY.query

_READINGS = f"""readings AS (
    SELECT {RUN_OF_USER} AS run_id, event_id, ts, 'cpu_percent' AS key, value AS v FROM events
    UNION ALL SELECT {RUN_OF_USER}, event_id, ts, 'memory_percent', value / 2 FROM events
    UNION ALL SELECT {RUN_OF_USER}, event_id, ts, 'memory_used_gb', value / 4 FROM events
    UNION ALL SELECT {RUN_OF_USER}, event_id, ts, 'gpu' || (user_id % 2) || '_util', value FROM events
    UNION ALL SELECT {RUN_OF_USER}, event_id, ts, 'gpu' || (user_id % 2) || '_mem', value / 10 FROM events
    UNION ALL SELECT {RUN_OF_USER}, event_id, ts, 'gpu' || (user_id % 2) || '_temp', value / 8 + 30 FROM events)"""


# -- telemetry, batch --------------------------------------------------------


@query(
    f"""WITH {_READINGS} SELECT run_id, {clock_sql("time_bucket(INTERVAL 1 HOUR, ts)")} AS start, key,
        {r("avg(v)")} AS avg, {r("max(v)")} AS max, count(*) AS samples FROM readings
    GROUP BY run_id, time_bucket(INTERVAL 1 HOUR, ts), key"""
)
def telemetry_rollup(spark, folder):
    rows = T.rollup_by_time(tables.telemetry(spark, folder), "1 hour")
    return rows.select(
        "run_id",
        clock("window_start").alias("start"),
        "key",
        rounded("avg").alias("avg"),
        rounded("max").alias("max"),
        "samples",
    )


@query(
    f"""WITH {_READINGS}, numbered AS (SELECT {RUN_OF_USER} AS run_id, event_id,
        (row_number() OVER (PARTITION BY {RUN_OF_USER} ORDER BY event_id) - 1) // 60 AS grp FROM events)
    SELECT n.run_id, grp AS "group", key, {r("avg(v)")} AS avg, {r("max(v)")} AS max, count(*) AS samples
    FROM numbered n JOIN readings USING (event_id) GROUP BY n.run_id, grp, key"""
)
def telemetry_rollup_count(spark, folder):
    rows = T.rollup_by_count(tables.telemetry(spark, folder), "seq")
    return rows.withColumns({"avg": rounded("avg"), "max": rounded("max")})


@query(
    f"""WITH {_READINGS}, b AS (SELECT run_id, time_bucket(INTERVAL 1 HOUR, ts) AS w, key, avg(v) AS a, max(v) AS m
        FROM readings GROUP BY run_id, w, key)
    SELECT run_id, {clock_sql("w")} AS start, 'system/' || key || '_avg' AS name, {r("a")} AS value FROM b
    UNION ALL SELECT run_id, {clock_sql("w")}, 'system/' || key || '_max', {r("m")} FROM b
        WHERE key <> 'memory_used_gb'"""
)
def telemetry_metrics(spark, folder):
    rolled = T.rollup_by_time(tables.telemetry(spark, folder), "1 hour")
    rows = T.system_metrics(rolled, "window_start")
    return rows.select("run_id", clock("window_start").alias("start"), "name", rounded("value").alias("value"))


# -- messages ----------------------------------------------------------------


def _messages(events: DataFrame) -> DataFrame:
    """Events as log messages of all kinds; some texts are cut short."""
    f = F.col
    run = tables.run_of_user().alias("run_id")
    at = (F.unix_micros(f("ts").cast("timestamp")) / 1e6).alias("timestamp")
    kind = lambda k: F.lit(k).alias("msg_type")
    step = f("event_id").alias("step")
    reading = F.struct(f("value").alias("value"), F.lit("loss").alias("name"), step)
    single = F.to_json(
        F.struct(kind("metric"), run, at, F.lit("loss").alias("name"), "value", step)
    )
    batch = F.to_json(
        F.struct(kind("metrics_batch"), run, at, F.array(reading, reading).alias("metrics"))
    )
    system = F.to_json(
        F.struct(kind("telemetry"), run, at, step, F.struct(f("value").alias("cpu")).alias("data"))
    )
    finish = F.to_json(
        F.struct(
            kind("control"),
            run,
            at,
            F.lit("finish").alias("command"),
            F.lit("failed").alias("status"),
            f("value").alias("duration"),
        )
    )
    text = (
        F.when(f("event_type") == "error", single)
        .when(f("event_type") == "signup", batch)
        .when(f("event_type") == "click", system)
        .when(f("event_type") == "purchase", finish)
        .otherwise(F.concat(F.lit('{"msg_type": "metric", "value": '), f("event_id").cast("string")))
    )
    return events.select(text.alias("value"))


_MESSAGE_ROWS = f"""SELECT {RUN_OF_USER} AS run_id, 'loss' AS name, event_id AS step, value FROM events
        WHERE event_type IN ('error', 'signup')
    UNION ALL SELECT {RUN_OF_USER}, 'loss', event_id, value FROM events WHERE event_type = 'signup'
    UNION ALL SELECT {RUN_OF_USER}, 'system/cpu', event_id, value FROM events WHERE event_type = 'click'"""


@query(_MESSAGE_ROWS)
def message_metrics(spark, folder):
    messages = M.decode(_messages(tables.table(spark, folder, "events")))
    return M.metric_rows(messages).select("run_id", "name", "step", "value")


@query(
    f"""SELECT {RUN_OF_USER} AS run_id, 'failed' AS status, value AS duration_seconds,
        {clock_sql("ts")} AS moment FROM events WHERE event_type = 'purchase'"""
)
def message_status(spark, folder):
    messages = M.decode(_messages(tables.table(spark, folder, "events")))
    rows = M.status_events(messages)
    return rows.select("run_id", "status", "duration_seconds", clock("timestamp").alias("moment"))


@query(
    """SELECT '{"msg_type": "metric", "value": ' || event_id AS raw, 'not JSON' AS reason FROM events WHERE event_type = 'view'"""
)
def message_quarantine(spark, folder):
    return M.quarantine(M.decode(_messages(tables.table(spark, folder, "events"))))


#: What becomes of an event by its number modulo the length of this list: a JSON text, its kind and how it is accounted for.
_SHAPES = [
    ('{"msg_type":"metric","name":"loss","step":STEP,"value":1}', "metric", "taken"),
    ('{"name":"loss","step":STEP,"value":"high"}', "metric", "taken"),
    ('{"msg_type":"metric","step":STEP,"value":1}', "metric", "no name or step"),
    ('{"msg_type":"metric","name":"loss","step":STEP,"value":1,"metric_type":"odd"}', "metric", "unknown metric type"),
    ('{"msg_type":"tensor","name":"w","step":STEP,"data":[[1,NaN],[2.5,STEP]]}', "tensor", "taken"),
    ('{"msg_type":"tensor","name":"w","step":STEP}', "tensor", "no elements"),
    ('{"msg_type":"tensor","name":"w","step":STEP,"data":[]}', "tensor", "no elements"),
    ('{"msg_type":"tensor","data":[1]}', "tensor", "no name or step"),
    ('{"msg_type":"telemetry","data":{"cpu":STEP}}', "telemetry", "taken"),
    ('{"msg_type":"telemetry","step":STEP}', "telemetry", "no readings"),
    ('{"msg_type":"telemetry","step":STEP,"data":{}}', "telemetry", "no readings"),
    ('{"msg_type":"control","command":"finish"}', "control", "taken"),
    ('{"msg_type":"control","command":"flush"}', "control", "taken"),
    ('{"msg_type":"control","command":"reboot"}', "control", "unknown command"),
    ('{"msg_type":"control"}', "control", "unknown command"),
    ('{"msg_type":"metrics_batch","metrics":[]}', "metrics_batch", "empty batch"),
    ('{"msg_type":"metrics_batch"}', "metrics_batch", "empty batch"),
    ('{"msg_type":"metrics_batch","metrics":[{"name":"a","step":STEP,"value":1},{"value":2}]}', "metrics_batch", "entry without name or step"),
    ('{"msg_type":"metrics_batch","metrics":[{"name":"a","step":STEP,"value":1}]}', "metrics_batch", "taken"),
    ('{"msg_type":"gossip","step":STEP}', "unknown", "unknown kind"),
    ('{"msg_type":"metric","name":"lo', "unknown", "not JSON"),
    ("", "unknown", "not JSON"),
]


def _shaped_messages(events: DataFrame) -> DataFrame:
    """Events as messages, whole and broken ones of every kind."""
    shapes = F.array(*(F.lit(t) for t, *_ in _SHAPES))
    shape = F.get(shapes, F.pmod("event_id", F.lit(len(_SHAPES))).cast("int"))
    return events.select(F.replace(shape, F.lit("STEP"), F.col("event_id").cast("string")).alias("value"))


_SHAPE_SQL = "shapes(place, kind, outcome) AS (VALUES " + ", ".join(f"({i}, '{k}', '{o}')" for i, (_, k, o) in enumerate(_SHAPES)) + ")"


@query(
    f"""WITH {_SHAPE_SQL} SELECT kind, outcome, count(*) AS messages
    FROM events JOIN shapes ON event_id % {len(_SHAPES)} = place GROUP BY kind, outcome"""
)
def message_accounts(spark, folder):
    """What became of every message, by kind and reason."""
    return M.message_accounts(M.decode(_shaped_messages(tables.table(spark, folder, "events"))))


_TENSOR_ROWS = f"""SELECT 'w' AS name, event_id AS step, pos, CASE pos WHEN 0 THEN 1.0 WHEN 2 THEN 2.5 WHEN 3 THEN event_id::DOUBLE END AS value
    FROM events, range(4) AS p(pos) WHERE event_id % {len(_SHAPES)} = {next(i for i, (t, k, o) in enumerate(_SHAPES) if k == "tensor" and o == "taken")}"""


def _tensor_rows(rows: DataFrame) -> DataFrame:
    """Elements with NaN shown as null, as it equals nothing."""
    return rows.select("name", "step", F.col("pos").cast("long").alias("pos"), F.when(~F.isnan("value"), F.col("value")).alias("value"))


@query(_TENSOR_ROWS)
def message_tensors(spark, folder):
    return _tensor_rows(M.tensor_elements(M.decode(_shaped_messages(tables.table(spark, folder, "events")))))


# -- streams -----------------------------------------------------------------


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = tables.table(spark, folder, "events").schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    )


@query(with_tables("metrics", body="SELECT run_id, name, step, value FROM metrics"))
def stream_ingest_equals_batch(spark, folder):
    work = new_work_folder(spark, "ingest")
    rows = tables.metrics_from_events(event_stream(spark, folder))
    ingest.start_metric_sink(rows, f"{work}/out", f"{work}/state").awaitTermination()
    stored = spark.read.parquet(f"{work}/out")
    return stored.select(F.col("run_id").cast("string").alias("run_id"), "name", "step", "value")


@query(_MESSAGE_ROWS)
def stream_messages(spark, folder):
    work = new_work_folder(spark, "messages")
    raw = _messages(event_stream(spark, folder))
    ingest.start_message_ingest(raw, f"{work}/out", f"{work}/state").awaitTermination()
    rows = ingest.read_ingested(spark, f"{work}/out", "metrics")
    return rows.select("run_id", "name", "step", "value")


@query(_TENSOR_ROWS)
def stream_tensors(spark, folder):
    work = new_work_folder(spark, "tensors")
    ingest.start_message_ingest(_shaped_messages(event_stream(spark, folder)), f"{work}/out", f"{work}/state").awaitTermination()
    return _tensor_rows(ingest.read_ingested(spark, f"{work}/out", "tensors"))


@query(
    f"""WITH {_SHAPE_SQL} SELECT outcome AS reason, count(*) AS messages
    FROM events JOIN shapes ON event_id % {len(_SHAPES)} = place WHERE outcome <> 'taken' GROUP BY outcome"""
)
def stream_quarantine(spark, folder):
    """Reasons of the texts that a stream put aside."""
    work = new_work_folder(spark, "quarantine")
    ingest.start_message_ingest(_shaped_messages(event_stream(spark, folder)), f"{work}/out", f"{work}/state").awaitTermination()
    return ingest.read_ingested(spark, f"{work}/out", "quarantine").groupBy("reason").agg(F.count("*").alias("messages"))


@query(
    f"""WITH {_READINGS}, late AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events)
    SELECT run_id, {clock_sql("time_bucket(INTERVAL 1 HOUR, ts)")} AS start, key,
        {r("avg(v)")} AS avg, {r("max(v)")} AS max, count(*) AS samples FROM readings, late
    WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= mark
    GROUP BY run_id, time_bucket(INTERVAL 1 HOUR, ts), key"""
)
def stream_telemetry_rollup(spark, folder):
    work = new_work_folder(spark, "rollup")
    samples = tables.telemetry_from_events(event_stream(spark, folder))
    rollup.start_rollup(samples, f"{work}/out", f"{work}/state", "1 hour").awaitTermination()
    return spark.read.parquet(f"{work}/out").select(
        "run_id",
        clock("window_start").alias("start"),
        "key",
        rounded("avg").alias("avg"),
        rounded("max").alias("max"),
        "samples",
    )


def _with_state_store(spark: SparkSession, work):
    """Run ``work`` with the state store that stateful processors need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STATE_STORE)
    try:
        return work()
    finally:
        spark.conf.set(key, before)


_DROPS = [("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2999-01-01")]


@query(
    with_tables(
        "metrics",
        body="""+ d AS (SELECT *, CASE WHEN ts < '2024-01-11' THEN 0 WHEN ts < '2024-01-21' THEN 1 ELSE 2 END AS drop_no
            FROM metrics),
        l AS (SELECT run_id, name, drop_no, max(step) AS step, arg_max(value, step) AS value FROM d GROUP BY ALL),
        p AS (SELECT *, lag(value) OVER (PARTITION BY run_id, name ORDER BY drop_no) AS before FROM l)
        SELECT run_id, name, step, value, CASE WHEN value > before THEN 'up' WHEN value < before THEN 'down'
            ELSE 'flat' END AS trend FROM p""",
    )
)
def stream_trend(spark, folder):
    """Events arrive in three drops; each drop updates the live view once."""
    work = new_work_folder(spark, "trend")
    events = tables.table(spark, folder, "events")

    def replay():
        for start, end in _DROPS:
            events.where((F.col("ts") >= start) & (F.col("ts") < end)).write.mode("append").parquet(
                f"{work}/in"
            )
            stream = spark.readStream.schema(events.schema).parquet(f"{work}/in")
            trends = state.live_trend(tables.metrics_from_events(stream))
            state.start_append(trends, f"{work}/out", f"{work}/state").awaitTermination()

    _with_state_store(spark, replay)
    return spark.read.parquet(f"{work}/out")


@query(
    _recursive(
        "audit",
        body=f"""+ {chain_sql("CAST(line_no // 1000 AS BIGINT)", "SELECT * FROM audit")}
        SELECT log, segment, line_no, coalesce(previous_hash, '') AS previous_hash, event_hash FROM chain""",
    )
)
def stream_chain(spark, folder):
    work = new_work_folder(spark, "chain")
    stream = tables.audit_from_events(event_stream(spark, folder))
    stream = stream.withColumn("segment", F.floor(F.col("line_no") / 1000).cast("long"))

    def run():
        links = state.chain_stream(stream)
        state.start_append(links, f"{work}/out", f"{work}/state").awaitTermination()

    _with_state_store(spark, run)
    links = spark.read.parquet(f"{work}/out")
    return links.withColumn("previous_hash", F.coalesce("previous_hash", F.lit("")))


@query(
    with_tables(
        "audit",
        body="""+ good AS (SELECT log, count(*) AS lines FROM audit GROUP BY log)
        SELECT log, lines, 0::BIGINT AS errors, true AS valid FROM good""",
    )
)
def stream_chain_verified(spark, folder):
    """The streamed chain, joined back to its events, passes the batch check."""
    links = stream_chain(spark, folder).withColumn(
        "previous_hash", F.when(F.col("previous_hash") != "", F.col("previous_hash"))
    )
    lines = tables.audit_events(spark, folder).join(links, ["log", "line_no"])
    return verify_summary(lines, verify_chain(lines))


#: Seconds between two analyses of a run in the query below; its second drop comes sooner.
_INTERVAL = 10


@query(
    with_tables(
        "metrics",
        "runs",
        body=f"""+ act AS (SELECT * FROM metrics WHERE run_id IN (SELECT id FROM runs WHERE status = 'running')),
        {GAPPY.replace("FROM metrics", "FROM act")}, {all_ctes("gappy")}
        SELECT run_id, anomaly_type, count(*) AS anomalies, count(*) FILTER (severity = 'critical') AS alerts, true AS ids_unique
        FROM found GROUP BY run_id, anomaly_type""",
    )
)
def stream_analysis(spark, folder):
    """What the last analysis of every run found, its alerts read back, after data in two drops.

    The second drop comes inside the interval of most runs, so their timers must bring them back.
    """
    work = new_work_folder(spark, "analysis")
    events = tables.table(spark, folder, "events")
    read = lambda: gappy(tables.metrics_from_events(spark.read.schema(events.schema).parquet(f"{work}/in")))

    def turn(done):
        running = analysis.start_analysis(
            tables.metrics_from_events(spark.readStream.schema(events.schema).parquet(f"{work}/in")),
            history=read,
            runs=lambda: tables.runs(spark, folder),
            path=f"{work}/out",
            checkpoint=f"{work}/state",
            alert=analysis.alert_sink(f"{work}/alerts"),
            interval=_INTERVAL,
        )
        analysis.run_until(running, done, 600)

    def complete(runs, since):
        """Whether all these runs were analysed after a time, with all outputs written."""
        try:
            analysed = spark.read.parquet(f"{work}/out/analysed").where(F.unix_millis("at") >= since)
            analysed = analysed.join(spark.read.parquet(f"{work}/out/done").select("run_id", "batch").distinct(), ["run_id", "batch"])
        except AnalysisException:
            return False  # nothing written yet
        return runs.join(analysed, "run_id", "left_anti").isEmpty()

    def replay():
        for late in (False, True):
            part = events.where((F.col("event_id") % 3 == 0) == late)
            part.write.mode("append").parquet(f"{work}/in")
            began = int(time.time() * 1000)
            touched = tables.metrics_from_events(part).select("run_id").distinct()
            turn(lambda runs=touched, since=began: complete(runs, since))

    _with_state_store(spark, replay)
    last = spark.read.parquet(f"{work}/out/analysed").groupBy("run_id").agg(F.max("batch").alias("batch"))
    anomalies = spark.read.parquet(f"{work}/out/anomalies").join(last, ["run_id", "batch"])
    alerts = spark.read.json(f"{work}/alerts").join(last, ["run_id", "batch"]).groupBy("run_id", "anomaly_type").agg(F.count("*").alias("alerts"))
    insights = spark.read.parquet(f"{work}/out/insights").unionByName(spark.read.parquet(f"{work}/out/held"))
    unique = insights.agg(F.count("*") == F.count_distinct("id")).first()[0]
    found = anomalies.groupBy("run_id", "anomaly_type").agg(F.count("*").alias("anomalies")).join(alerts, ["run_id", "anomaly_type"], "left")
    return found.withColumns({"alerts": F.coalesce("alerts", F.lit(0)), "ids_unique": F.lit(unique)})


@query(
    f"""WITH i AS (SELECT {RUN_OF_USER} AS run_id, event_id::VARCHAR AS id, event_id % 2 AS late,
            CASE WHEN event_id % 7 = 0 THEN 'critical' WHEN event_id % 7 < 3 THEN 'warning' ELSE 'info' END AS severity FROM events),
        f AS (SELECT DISTINCT {RUN_OF_USER} AS run_id FROM events WHERE user_id % 3 = 0 AND event_id % 2 = 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY late,
            CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, id) AS place FROM i)
        SELECT run_id, id, severity FROM r WHERE place <= 4 OR run_id IN (SELECT run_id FROM f)"""
)
def stream_insight_cap(spark, folder):
    """Insights in two drops: four a run while it runs, all of a run that has finished."""
    work = new_work_folder(spark, "outlet")
    events = tables.table(spark, folder, "events")

    def replay():
        for late in (0, 1):
            events.where(F.col("event_id") % 2 == late).write.mode("append").parquet(f"{work}/in")
            stream = spark.readStream.schema(events.schema).parquet(f"{work}/in")
            kind = F.when(F.col("event_id") % 7 == 0, "critical").when(F.col("event_id") % 7 < 3, "warning").otherwise("info")
            insights = stream.select(tables.run_of_user().alias("run_id"), F.col("event_id").alias("id"), kind.alias("severity"))
            ends = stream.where("user_id % 3 = 0 AND event_id % 2 = 1").select(tables.run_of_user().alias("run_id"))
            state.start_append(analysis.capped_insights(insights, ends, 4), f"{work}/out", f"{work}/state").awaitTermination()

    _with_state_store(spark, replay)
    return spark.read.parquet(f"{work}/out").select("run_id", "id", "severity")
