"""Hardware telemetry rollups, shared by batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.operators.ordered import HOT_ROWS, GroupProfile, OrderedGroups

WINDOW = "60 seconds"
WINDOW_SAMPLES = 60

# Sample fields, rollup names and which statistics are kept.
HOST_FIELDS = ["cpu_percent", "memory_percent", "memory_used_gb"]
GPU_FIELDS = {
    "util": "utilization_percent",
    "mem": "memory_percent",
    "temp": "temperature_celsius",
}
NO_MAX = ["memory_used_gb"]


def readings(telemetry: DataFrame, *keep: str) -> DataFrame:
    """One row per reading: host fields and ``gpu{i}_...`` fields, in long form.

    The long form lets a single aggregate serve any number of devices.
    """
    def entry(key: Column, value: Column) -> Column:
        return F.struct(key.alias("key"), value.cast("double").alias("value"))

    def of_gpus(name: str, field: str) -> Column:
        none = F.array().cast("array<struct<key:string,value:double>>")
        per_gpu = F.transform(
            "gpu_metrics",
            lambda g: entry(
                F.concat(F.lit("gpu"), g["index"].cast("string"), F.lit(f"_{name}")), g[field]
            ),
        )
        return F.coalesce(per_gpu, none)

    host = F.array(*[entry(F.lit(f), F.col(f)) for f in HOST_FIELDS])
    every = F.concat(host, *[of_gpus(name, field) for name, field in GPU_FIELDS.items()])
    return telemetry.select("run_id", *keep, F.explode(every).alias("_r")).select(
        "run_id", *keep, "_r.key", "_r.value"
    )


def _stats(grouped) -> DataFrame:
    return grouped.agg(
        F.avg("value").alias("avg"), F.max("value").alias("max"), F.count(F.lit(1)).alias("samples")
    )


def rollup_by_time(telemetry: DataFrame, width: str = WINDOW) -> DataFrame:
    """Average and maximum per run, tumbling time window and reading."""
    rows = readings(telemetry, "timestamp")
    out = _stats(rows.groupBy("run_id", F.window("timestamp", width).alias("_w"), "key"))
    return out.select(
        "run_id",
        F.col("_w.start").alias("window_start"),
        F.col("_w.end").alias("window_end"),
        "key",
        "avg",
        "max",
        "samples",
    )


def rollup_by_count(
    telemetry: DataFrame,
    order: str = "timestamp",
    size: int = WINDOW_SAMPLES,
    profile: GroupProfile | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The same over groups of ``size`` consecutive samples; the last may be short."""
    numbered = OrderedGroups(telemetry, ["run_id"], [order], profile, hot_rows).index().result()
    rows = readings(numbered.withColumn("group", F.floor(F.col("idx") / size).cast("long")), "group")
    return _stats(rows.groupBy("run_id", "group", "key"))


def system_metrics(rollup: DataFrame, *keep: str) -> DataFrame:
    """Rollup rows as ``system/...`` metric rows."""
    value = F.array(
        F.struct(F.lit("avg").alias("stat"), F.col("avg").alias("value")),
        F.struct(F.lit("max").alias("stat"), F.col("max").alias("value")),
    )
    rows = rollup.select("run_id", *keep, "key", F.explode(value).alias("_s")).where(
        ~(F.col("key").isin(*NO_MAX) & (F.col("_s.stat") == "max"))
    )
    return rows.select(
        "run_id",
        *keep,
        F.concat(F.lit("system/"), "key", F.lit("_"), F.col("_s.stat")).alias("name"),
        F.col("_s.value").alias("value"),
    )
