"""Stores, exports, messages and streams."""

from __future__ import annotations

import time

import json

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from metricloom import model, session
from metricloom.operators import audit as U
from metricloom.operators import runs as R
from metricloom.operators import telemetry as T
from metricloom.operators.ordered import GroupProfile
from metricloom.sources import driver_tables as tables
from metricloom.sources import messages as M
from metricloom.sources import store
from metricloom.streaming import analysis, ingest, rollup, state


@pytest.fixture(scope="module")
def metrics(spark, small):
    return tables.metrics(spark, small)


# -- store -------------------------------------------------------------------


@pytest.mark.parametrize("groups, bucketed", [(8, False), (50_000, True)])
def test_store_round_trip(spark, metrics, tmp_path, groups, bucketed):
    path = str(tmp_path / "metrics")
    store.write_metrics(metrics, path, GroupProfile(groups, 100))
    back = store.read_metrics(spark, path, bucketed=bucketed)
    assert rows_of(back.select("run_id", "name", "step", "value")) == rows_of(
        metrics.select("run_id", "name", "step", "value")
    )
    two = store.read_metrics(spark, path, ["1", "3"], bucketed)
    assert rows_of(two.select("run_id").distinct()) == [("1",), ("3",)]
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_unreadable_files_are_skipped(spark, metrics, tmp_path):
    path = tmp_path / "metrics"
    store.write_metrics(metrics, str(path), GroupProfile(8, 100))
    (path / "run_id=1" / "broken.parquet").write_bytes(b"not parquet")
    assert store.read_metrics(spark, str(path), skip_corrupt=True).count() == metrics.count()


def test_compaction(spark, metrics, tmp_path):
    source, target = str(tmp_path / "small"), str(tmp_path / "large")
    model.conform(metrics, model.METRICS).repartition(20).write.partitionBy("run_id").parquet(source)
    store.compact_metrics(spark, source, target)
    assert store.read_metrics(spark, target).count() == metrics.count()
    files = lambda p: store.file_listing(spark, p).count()
    assert files(target) < files(source)


def test_exports(spark, metrics, small, tmp_path):
    out = str(tmp_path / "run")
    parts = {
        "metrics": metrics,
        "runs": tables.runs(spark, small),
        "insights": tables.insights(spark, small),
        "artifacts": tables.artifacts(spark, small),
    }
    assert store.export_run(parts, "1", out, include_artifacts=True) == ["metadata", "metrics", "insights", "artifacts"]
    steps = [r["step"] for r in spark.read.parquet(f"{out}/metrics").collect()]
    assert sorted(steps) == sorted(r["step"] for r in metrics.where("run_id = '1'").collect())
    assert spark.read.json(f"{out}/metadata").first()["id"] == "1"
    assert not store.export_metrics(metrics, "no such run", str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    for fmt in ("csv", "json", "parquet"):
        store.write_result(metrics.limit(3), str(tmp_path / fmt), fmt)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    with pytest.raises(ValueError):
        store.write_result(metrics, "x", "xml")


def test_append_new(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    store.append_new(frame("a", "b", "a"), path)
    store.append_new(frame("b", "c"), path)
    assert rows_of(spark.read.parquet(path)) == [("a",), ("b",), ("c",)]
    listing = store.file_listing(spark, path)
    assert listing.select("length").count() >= 1


def test_views_and_sql(spark, metrics):
    model.register_views({"metrics": metrics})
    got = model.sql(spark, "SELECT count(*) AS c FROM metrics WHERE step >= :s", {"s": 0}).first()["c"]
    assert got == metrics.count()
    with pytest.raises(ValueError):
        model.register_views({"other": metrics})
    assert model.conform(metrics.drop("metadata"), model.METRICS).columns == model.METRICS.names
    assert model.empty(spark, model.RUNS).count() == 0


def test_session_helpers(spark, tmp_path):
    conf = session.sized_for(100 * 1024**4)
    assert conf["spark.sql.shuffle.partitions"] == str(session.MAX_SHUFFLE_PARTITIONS)
    assert int(conf["spark.sql.adaptive.advisoryPartitionSizeInBytes"]) > 2 * 1024**3
    assert session.sized_for(1024**4)["spark.sql.shuffle.partitions"] == str(1024**4 // (128 * 1024**2))
    assert session.shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_no_message_is_lost(spark):
    rows = [
        {"msg_type": "metric", "run_id": "r", "timestamp": 1.0, "value": 1.0, "step": 1},
        {"msg_type": "metric", "run_id": "r", "timestamp": 1.0, "name": "loss", "value": 1.0},
        {"msg_type": "metrics_batch", "run_id": "r", "timestamp": 1.0, "metrics": [{"name": "a", "value": 1.0, "step": 1}, {"value": 2.0, "step": 1}]},
    ]
    texts = [json.dumps(r) for r in rows]
    tensor = '{"msg_type": "tensor", "run_id": "r", "timestamp": 1.0, "name": "t", "step": 1, "data": "[[1.0, NaN], [-Infinity, null, 3e2]]"}'
    messages = M.decode(spark.createDataFrame([(t,) for t in [*texts, tensor]], "value string"))
    assert sorted(r["raw"] for r in M.quarantine(messages).collect()) == sorted(texts)
    assert [r["name"] for r in M.metric_rows(messages).collect()] == ["a"]
    values = {r["pos"]: r["value"] for r in M.tensor_elements(messages).collect()}
    assert values[0] == 1.0 and values[1] != values[1] and values[2] == float("-inf") and values[3] is None and values[4] == 300.0


# -- messages ----------------------------------------------------------------

MESSAGES = [
    {"msg_type": "metric", "run_id": "r", "timestamp": 1.5, "name": "loss", "value": 2, "step": 1, "metadata": {"a": 1}},
    {"run_id": "r", "timestamp": 1.5, "name": "untyped", "value": "text", "step": 2},
    {"msg_type": "metrics_batch", "run_id": "r", "timestamp": 2.0,
     "metrics": [{"name": "a", "value": 1.5, "step": 3, "metadata": {"k": 2}}, {"name": "b", "value": 2.5, "step": 3}]},
    {"msg_type": "telemetry", "run_id": "r", "timestamp": 3.0, "data": {"cpu": 50.5, "mem": 7}, "step": 9},
    {"msg_type": "telemetry", "run_id": "r", "timestamp": 3.0, "data": {"cpu": 1}},
    {"msg_type": "tensor", "run_id": "r", "timestamp": 4.0, "name": "w", "step": 4, "data": [[1, -2.5], [3e2, 4]]},
    {"msg_type": "control", "run_id": "r", "timestamp": 5.0, "command": "finish", "status": "failed", "duration": 3.5},
    {"msg_type": "control", "run_id": "q", "timestamp": 5.0, "command": "finish"},
    {"msg_type": "control", "run_id": "r", "timestamp": 5.0, "command": "flush"},
    {"msg_type": "mystery", "run_id": "r"},
    {"msg_type": "metric", "run_id": "r", "timestamp": 1.0, "name": "odd", "value": 1, "step": 1, "metric_type": "odd"},
    {"msg_type": "metrics_batch", "run_id": "r", "timestamp": 1.0,
     "metrics": [{"name": "odd", "value": 1, "step": 1, "metric_type": "odd"}]},
]


@pytest.fixture(scope="module")
def raw(spark):
    texts = [json.dumps(m) for m in MESSAGES] + ["{broken"]
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_decode(raw):
    messages = M.decode(raw)
    assert rows_of(M.metric_rows(messages).select("name", "value", "step", "metadata")) == sorted(
        [
            ("loss", 2.0, 1, '{"a":1}'), ("untyped", None, 2, None), ("a", 1.5, 3, '{"k":2}'), ("b", 2.5, 3, None),
            ("system/cpu", 50.5, 9, None), ("system/mem", 7.0, 9, None), ("system/cpu", 1.0, 0, None),
        ],
        key=lambda t: tuple(str(x) for x in t),
    )
    assert rows_of(M.status_events(messages).select("run_id", "status", "duration_seconds")) == [
        ("q", "completed", None), ("r", "failed", 3.5),
    ]
    assert [r["value"] for r in M.tensor_elements(messages).orderBy("pos").collect()] == [1.0, -2.5, 300.0, 4.0]
    bad = sorted(r["raw"] for r in M.quarantine(messages).collect())
    assert len(bad) == 4 and bad[-1] == "{broken"


def test_message_stream_restarts_cleanly(spark, raw, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "state"))
    raw.write.text(source)
    def run():
        ingest.start_message_ingest(spark.readStream.text(source), out, mark).awaitTermination()
    run()
    batch = rows_of(M.metric_rows(M.decode(raw)).select("name", "value", "step"))
    read = lambda: rows_of(ingest.read_ingested(spark, out, "metrics").select("name", "value", "step"))
    assert read() == batch
    run()
    assert read() == batch  # nothing new, nothing twice
    raw.write.mode("append").text(source)
    run()
    assert len(read()) == 2 * len(batch)
    runs = spark.createDataFrame([("r", "running")], "id string, status string").select(
        "*", *[F.lit(None).cast("timestamp").alias(c) for c in ("updated_at", "finished_at")],
        F.lit(None).cast("double").alias("duration_seconds"),
    )
    assert ingest.current_runs(runs, spark, out).first()["status"] == "failed"


# -- telemetry ---------------------------------------------------------------


def samples(spark, n, gpus=2):
    rows = []
    for i in range(n):
        cards = [(g, "x", 1.0, 2.0, 10.0 * g, float(i + g), 50.0, 5.0) for g in range(gpus)]
        rows.append(("r", i, float(i), 2.0 * i, 1.0, gpus, cards))
    df = spark.createDataFrame(
        rows,
        "run_id string, t int, cpu_percent double, memory_percent double, memory_used_gb double, gpu_count int,"
        "gpu_metrics " + model.TELEMETRY["gpu_metrics"].dataType.simpleString(),
    )
    return df.withColumn("timestamp", F.timestamp_seconds(F.col("t"))).drop("t")


def test_rollups(spark):
    df = samples(spark, 150)
    by_count = {(r["group"], r["key"]): r for r in T.rollup_by_count(df).collect()}
    by_time = T.rollup_by_time(df).collect()
    assert [by_count[(g, "cpu_percent")]["samples"] for g in range(3)] == [60, 60, 30]
    assert by_count[(0, "cpu_percent")]["avg"] == 29.5 and by_count[(2, "gpu1_util")]["max"] == 150.0
    assert len(by_time) == 3 * 9
    for r in by_time:  # one sample per second, so both groupings coincide
        twin = by_count[(r["window_start"].minute, r["key"])]
        assert (r["avg"], r["max"], r["samples"]) == (twin["avg"], twin["max"], twin["samples"])
    names = {r["name"] for r in T.system_metrics(T.rollup_by_count(df), "group").collect()}
    assert "system/gpu0_mem_max" in names and "system/memory_used_gb_avg" in names
    assert "system/memory_used_gb_max" not in names
    assert T.rollup_by_time(samples(spark, 3, gpus=0)).count() == 3


def test_streaming_rollup(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "state"))
    df = samples(spark, 1500)
    df.write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    rollup.start_rollup(stream, out, mark, lateness="1 minute").awaitTermination()
    closed = T.rollup_by_time(df).where("window_end <= timestamp_seconds(1499 - 60)")
    assert rows_of(spark.read.parquet(out)) == rows_of(closed)


# -- state -------------------------------------------------------------------


def test_trend_state(spark, series, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "state"))
    drops = [{"x": [1.0, 5.0]}, {"x": [3.0]}, {"x": [0.0]}, {"x": [3.0], "y": [1.0]}]
    steps = [{"x": [0, 1]}, {"x": [2]}, {"x": [1]}, {"x": [3], "y": [0]}]
    for values, at in zip(drops, steps):
        frame = series(values, steps=at)
        frame.write.mode("append").parquet(source)
        stream = spark.readStream.schema(frame.schema).parquet(source)
        state.start_append(state.live_trend(stream), out, mark).awaitTermination()
    got = rows_of(spark.read.parquet(out).select("name", "step", "value", "trend"))
    assert got == [("x", 1, 5.0, "flat"), ("x", 2, 3.0, "down"), ("x", 3, 3.0, "flat"), ("y", 0, 1.0, "flat")]


def test_chain_state_equals_batch(spark, small, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "state"))
    events = tables.audit_events(spark, small).withColumn("segment", F.lit(0).cast("long"))
    half = events.where("line_no < 500"), events.where("line_no >= 500")
    for part in half:
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        state.start_append(state.chain_stream(stream), out, mark).awaitTermination()
    links = ["log", "segment", "line_no", "previous_hash", "event_hash"]
    assert rows_of(spark.read.parquet(out).select(*links)) == rows_of(
        U.build_chain(events.drop("segment"), 10**6).select(*links)
    )


# -- analysis ----------------------------------------------------------------


def test_periodic_analysis(spark, series, tmp_path):
    values = {"loss": [1.0 if i % 50 else 100.0 for i in range(200)], "train_loss": [2.0 if i % 40 else 90.0 for i in range(200)]}
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "state"))
    runs = spark.createDataFrame([("r", "running"), ("done", "completed")], "id string, status string")
    seen = {}

    def run(run_id, interval, wait=None):
        frame = series(values, run_id)
        if run_id is not None:
            frame.write.mode("append").parquet(source)
        before, began = set(seen), time.monotonic()
        query = analysis.start_analysis(
            spark.readStream.schema(frame.schema).parquet(source),
            history=lambda: spark.read.parquet(source),
            runs=lambda: runs,
            path=out,
            checkpoint=mark,
            alert=lambda found, batch: seen.update({batch: found.where("severity = 'critical'").count()}),
            cap=1,
            interval=interval,
        )
        analysis.run_until(query, lambda: time.monotonic() - began > wait if wait else set(seen) > before, 60)
        return [seen[b] for b in sorted(set(seen) - before)]

    first = run("r", 20)
    assert len(first) == 1 and first[0] > 0
    insights, held = (lambda n=n: spark.read.parquet(f"{out}/{n}").count() for n in ("insights", "held"))
    assert insights() == 1  # the cap leaves no room for more
    beyond = held()
    assert run("r", 20, wait=5) == []  # analysed a moment ago
    assert run("done", 20) == [0]  # not running
    again = run(None, 20)  # no new data, but a timer
    assert len(again) == 1 and again[0] > 0
    assert {(r["run_id"], r["by"]) for r in spark.read.parquet(f"{out}/analysed").collect()} == {("r", "data"), ("done", "data"), ("r", "timer")}
    assert insights() == 1 and held() > beyond  # the cap is used up; what came later is held, under ids of its own
    ids = spark.read.parquet(f"{out}/held").union(spark.read.parquet(f"{out}/insights")).select("id")
    assert ids.count() == ids.distinct().count()


def test_change_notices_and_votes(spark, series, tmp_path):
    source = str(tmp_path / "in")
    frame = series({"a": [1, 2], "b": [1]})
    frame.write.parquet(source)
    stream = spark.readStream.schema(frame.schema).parquet(source)
    seen = []
    ingest.watch_changes(stream, lambda i, names: seen.append((i, rows_of(names))), str(tmp_path / "m1")).awaitTermination()
    assert seen == [(0, [("r", "a"), ("r", "b")])]
    counts = []
    analysis.vote_stream(stream, lambda df, i: counts.append(df.count()), str(tmp_path / "m2")).awaitTermination()
    assert counts == [3]
    alerts = analysis.alert_sink(str(tmp_path / "alerts"))
    alerts(spark.createDataFrame([("critical",), ("info",)], "severity string"), 3)
    assert spark.read.json(str(tmp_path / "alerts/batch=3")).count() == 1


def test_watermark_is_for_rollups_only(spark, series, tmp_path):
    source = str(tmp_path / "in")
    frame = series({"a": [1, 2]})
    frame.write.parquet(source)
    stream = ingest.with_event_time(spark.readStream.schema(frame.schema).parquet(source))
    assert stream.isStreaming
    assert R.within_retention(frame, 1, "2024-01-01 00:00:01", "timestamp").count() == 2


def test_no_message_vanishes(spark):
    """Each text gives rows, is a flush, or is put aside with a reason; whatever it lacks."""
    texts = {
        '{"msg_type":"tensor","name":"w","step":1}': "no elements",
        '{"msg_type":"tensor","name":"w","step":1,"data":[[],[]]}': "no elements",
        '{"msg_type":"tensor","data":[1]}': "no name or step",
        '{"msg_type":"telemetry"}': "no readings",
        '{"msg_type":"telemetry","data":"text"}': "no readings",
        '{"msg_type":"control","command":"reboot"}': "unknown command",
        '{"msg_type":"metrics_batch","metrics":[]}': "empty batch",
        '{"msg_type":"metrics_batch","metrics":[{"value":1}]}': "entry without name or step",
        "[1, 2": "not JSON",
        " ": "not JSON",
        '{"msg_type":"control","command":"flush"}': None,
        '{"msg_type":"control","command":"finish"}': None,
    }
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "value string")
    aside = {r["raw"]: r["reason"] for r in M.quarantine(M.decode(df)).collect()}
    assert aside == {**{t: r for t, r in texts.items() if r}, None: "not JSON"}
    assert M.message_accounts(M.decode(df)).groupBy().sum("messages").first()[0] == len(texts) + 1


def test_capped_insights_over_many_arrow_batches(spark, tmp_path):
    """The gravest of a micro-batch go first and none is lost, however many Arrow batches and chunks its rows fill."""
    rows = [(run, f"{i:04d}", "critical" if i >= 198 else "info", i == 0 and run == "b") for run in ("a", "b") for i in range(200)]
    shape = "run_id string, id string, severity string, ends boolean"

    def turn(rows):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(shape).parquet(f"{tmp_path}/in")
        out = analysis.capped_insights(stream, stream.where("ends").select("run_id"), 4)
        state.start_append(out, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        return rows_of(spark.read.parquet(f"{tmp_path}/out").select("run_id", "id", "severity", "rank"))

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10")
    try:
        whole = lambda run: [(run, i, s, 0 if s == "critical" else 2) for r, i, s, _ in rows if r == run]
        first = [(r, i, s, k) for r, i, s, k in whole("a") if i in ("0000", "0001", "0198", "0199")]
        assert turn(rows) == first + whole("b")
        assert turn([("a", "x", "critical", False)]) == first + whole("b")
        assert turn([("a", "y", "info", True)]) == sorted([*whole("a"), ("a", "x", "critical", 0), ("a", "y", "info", 2), *whole("b")])
    finally:
        spark.conf.set(key, before)
