"""Run catalogue, configuration comparison and artifacts."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from metricloom.operators import artifacts as A
from metricloom.operators import runs as R


@pytest.fixture(scope="module")
def runs(spark):
    rows = [
        ("a", "first", "p", "completed", '{"lr":"1","bs":"2","x":null}', 1),
        ("b", "second", "p", "running", '{"lr":"1","bs":"3","y":"4"}', 2),
        ("c", "third", "q", "failed", None, 3),
    ]
    df = spark.createDataFrame(rows, "id string, name string, project string, status string, config string, t int")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t"))
    return df.select(
        "id", "name", "project", "status", "config", F.lit(None).cast("string").alias("notes"),
        at.alias("created_at"), at.alias("updated_at"),
        F.lit(None).cast("timestamp").alias("finished_at"),
        F.lit(None).cast("double").alias("duration_seconds"),
    )


def test_listing(runs):
    assert [r["id"] for r in R.list_runs(runs).collect()] == ["c", "b", "a"]
    assert [r["id"] for r in R.list_runs(runs, project="p", limit=1, offset=1).collect()] == ["a"]
    assert R.default_run(runs).first()["id"] == "b"
    assert R.default_run(runs.where("status <> 'running'")).first()["id"] == "c"


def test_names(spark):
    df = spark.createDataFrame([(" a ",), ("  ",), (None,)], "name string")
    assert rows_of(R.validate_names(df)) == [("a",)]
    assert R.invalid_names(df).count() == 2


def test_tags(spark, runs):
    tags = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x")], "run_id string, tag string")
    assert R.dedupe_tags(tags).count() == 3
    assert R.dedupe_tags(tags, tags.where("tag = 'x'")).count() == 1
    assert rows_of(R.runs_with_tags(runs, tags, ["x", "y"]).select("id")) == [("a",)]
    detail = {r["id"]: r for r in R.run_detail(runs, tags).collect()}
    assert detail["a"]["tags"] == ["x", "y"] and detail["c"]["tags"] == []
    assert detail["c"]["config"] == {} and detail["b"]["config"]["bs"] == "3"


def test_config_diff_modes(spark, runs):
    pairs = spark.createDataFrame([("a", "b")], "run_a string, run_b string")
    rows = {r["key"]: r for r in R.config_diff(runs, pairs).collect()}
    assert {k for k, r in rows.items() if r["differs"]} == {"bs", "y"}  # x is null and absent: equal
    assert {k for k, r in rows.items() if r["only_in_a"]} == {"x"}
    assert {k for k, r in rows.items() if r["only_in_b"]} == {"y"}
    strict = {r["key"]: r for r in R.config_diff(runs, pairs, "exclusive").collect()}
    assert {k for k, r in strict.items() if r["differs"]} == {"bs"}
    sets = R.config_key_sets(runs, pairs).first()
    assert (sets["only_in_a"], sets["only_in_b"]) == (["x"], ["y"])
    with pytest.raises(ValueError):
        R.config_diff(runs, pairs, "loose")


def test_merge_config(spark, runs):
    updates = spark.createDataFrame([("a", {"lr": "9"})], "id string, entries map<string,string>")
    config = F.from_json("config", R.CONFIG_TYPE)
    plain = R.merge_config(runs, updates).where("id = 'a'").select(config).first()[0]
    assert plain["lr"] == "9" and plain["bs"] == "2"
    prefixed = R.merge_config(runs, updates, "trainer/").where("id = 'a'").select(config).first()[0]
    assert prefixed["trainer/lr"] == "9" and prefixed["lr"] == "1"
    assert R.merge_config(runs, updates).where("id = 'c'").first()["config"] is None


def test_status_events(spark, runs):
    events = spark.createDataFrame(
        [("b", "completed", 5.0, 10), ("b", "running", None, 20), ("c", "running", None, 30)],
        "run_id string, status string, duration_seconds double, t int",
    ).withColumn("timestamp", F.timestamp_seconds(F.col("t"))).drop("t")
    rows = {r["id"]: r for r in R.apply_status_events(runs, events).collect()}
    assert rows["b"]["status"] == "running" and rows["b"]["duration_seconds"] == 5.0
    assert rows["b"]["finished_at"].second == 10 and rows["b"]["updated_at"].second == 20
    assert rows["c"]["status"] == "running" and rows["c"]["finished_at"] is None
    assert rows["a"]["status"] == "completed"


def test_new_and_deleted_runs(spark, runs):
    configs = runs.select("id", "name", F.lit(None).cast("string").alias("project"), "config", "notes", "created_at")
    assert R.new_runs(configs, runs.where("id <> 'c'")).select("id", "status", "project").collect() == [
        ("c", "running", "default")
    ]
    gone = spark.createDataFrame([("a",)], "run_id string")
    tags = spark.createDataFrame([("a", "x"), ("b", "x")], "run_id string, tag string")
    kept = R.delete_runs({"runs": runs, "run_tags": tags}, gone)
    assert rows_of(kept["runs"].select("id")) == [("b",), ("c",)]
    assert rows_of(kept["run_tags"]) == [("b", "x")]


def test_retention(runs):
    now = "2023-11-15 22:13:22"
    assert rows_of(R.within_retention(runs, 1, now).select("id")) == [("b",), ("c",)]


def test_keep_last_n(spark):
    rows = [(f"i{s}", "r", "w", "tensor" if s % 2 else None, s) for s in range(8)]
    df = spark.createDataFrame(rows, "id string, run_id string, name string, artifact_type string, s int")
    df = df.withColumn("metadata", F.to_json(F.struct(F.col("s").alias("step"))))
    df = df.withColumn("created_at", F.timestamp_seconds(F.col("s")))
    assert rows_of(A.expired_artifacts(df, 5).select("s")) == [(0,), (1,), (2,)]
    assert A.expired_artifacts(df, 5, "tensor").count() == 3  # untyped records count as tensors
    assert A.expired_artifacts(df, 5, "checkpoint").count() == 0
    assert A.artifact_at_step(df, "w", 3).first()["id"] == "i3"
    assert [r["s"] for r in A.list_artifacts(df).collect()] == list(range(7, -1, -1))


def test_file_catalogue(spark, tmp_path):
    (tmp_path / "layer.0.w.bin").write_bytes(b"abc")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    row = A.catalogue_files(files).first()
    assert (row["name"], row["size_bytes"]) == ("layer_0_w", 3)
    assert row["checksum"] == hashlib.sha256(b"abc").hexdigest()[:16]
    size = A.store_size(files).first()
    assert (size["total_bytes"], size["total_size_mb"]) == (3, 0.0)


def test_index(spark):
    text = (
        '{"k1": {"name": "w", "path": "p", "shape": [2, 3], "dtype": "float32", "step": 7},'
        ' "k2": {"name": "c", "type": "checkpoint", "tensors": {"a": {"shape": [4], "dtype": "int8"}}, "step": 8}}'
    )
    index = A.explode_index(spark.createDataFrame([(text,)], "value string"))
    assert rows_of(index.select("id", "artifact_type", "step")) == [("k1", None, 7), ("k2", "checkpoint", 8)]
    assert A.checkpoint_tensors(index).first()["shape"] == [4]
