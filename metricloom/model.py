"""Table schemas, enumerations and SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Enumerations of the stored tables.
METRIC_TYPES = ("scalar", "image", "audio", "tensor", "histogram", "text")
ARTIFACT_TYPES = ("model", "checkpoint", "tensor", "image", "audio", "config", "other")
RUN_STATUSES = ("running", "completed", "failed", "interrupted")
TERMINAL_STATUSES = ("completed", "failed", "interrupted")
SEVERITIES = ("info", "warning", "critical")

METRICS = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("value", T.DoubleType(), True),
        T.StructField("step", T.LongType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("metric_type", T.StringType(), False),
        T.StructField("metadata", T.StringType(), True),
    ]
)

RUNS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("project", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("config", T.StringType(), True),
        T.StructField("notes", T.StringType(), True),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("updated_at", T.TimestampType(), False),
        T.StructField("finished_at", T.TimestampType(), True),
        T.StructField("duration_seconds", T.DoubleType(), True),
    ]
)

RUN_TAGS = T.StructType(
    [T.StructField("run_id", T.StringType(), False), T.StructField("tag", T.StringType(), False)]
)

ARTIFACTS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("run_id", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("artifact_type", T.StringType(), True),
        T.StructField("path", T.StringType(), False),
        T.StructField("size_bytes", T.LongType(), True),
        T.StructField("checksum", T.StringType(), True),
        T.StructField("metadata", T.StringType(), True),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)

INSIGHTS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("run_id", T.StringType(), False),
        T.StructField("insight_type", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("description", T.StringType(), False),
        T.StructField("severity", T.StringType(), False),
        T.StructField("related_metrics", T.StringType(), True),
        T.StructField("visualization_spec", T.StringType(), True),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("votes_up", T.LongType(), True),
        T.StructField("votes_down", T.LongType(), True),
    ]
)

VOTES = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("insight_id", T.StringType(), False),
        T.StructField("run_id", T.StringType(), False),
        T.StructField("vote", T.IntegerType(), False),
        T.StructField("feedback", T.StringType(), True),
        T.StructField("timestamp", T.TimestampType(), False),
    ]
)

AUDIT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("actor", T.StringType()),
        T.StructField("resource_type", T.StringType()),
        T.StructField("resource_id", T.StringType()),
        T.StructField("details", T.StringType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("organization_id", T.StringType()),
        T.StructField("team_id", T.StringType()),
        T.StructField("previous_hash", T.StringType()),
        T.StructField("event_hash", T.StringType()),
    ]
)

GPU_SAMPLE = T.StructType(
    [
        T.StructField("index", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("memory_used_mb", T.DoubleType()),
        T.StructField("memory_total_mb", T.DoubleType()),
        T.StructField("memory_percent", T.DoubleType()),
        T.StructField("utilization_percent", T.DoubleType()),
        T.StructField("temperature_celsius", T.DoubleType()),
        T.StructField("power_watts", T.DoubleType()),
    ]
)

TELEMETRY = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("cpu_percent", T.DoubleType()),
        T.StructField("memory_percent", T.DoubleType()),
        T.StructField("memory_used_gb", T.DoubleType()),
        T.StructField("gpu_count", T.IntegerType()),
        T.StructField("gpu_metrics", T.ArrayType(GPU_SAMPLE)),
    ]
)

# One row of the log stream. The kind decides which fields are filled.
_METRIC_IN_BATCH = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("step", T.LongType()),
        T.StructField("metric_type", T.StringType()),
        T.StructField("metadata", T.StringType()),
    ]
)
MESSAGE = T.StructType(
    [
        T.StructField("msg_type", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("name", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("step", T.LongType()),
        T.StructField("metric_type", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("metrics", T.ArrayType(_METRIC_IN_BATCH)),
        T.StructField("data", T.StringType()),
        T.StructField("command", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("_bad", T.StringType()),
    ]
)

VIEW_NAMES = ("metrics", "runs", "run_tags", "artifacts", "insights", "votes", "audit")


def register_views(tables: dict[str, DataFrame]) -> None:
    """Make the tables available to ``spark.sql`` under their own names."""
    unknown = set(tables) - set(VIEW_NAMES)
    if unknown:
        raise ValueError(f"not a table of the model: {sorted(unknown)}")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def sql(spark: SparkSession, query: str, args: dict | None = None) -> DataFrame:
    """Free SQL over the registered tables; values go in as named parameters."""
    return spark.sql(query, args=args or {})


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to a table's columns; columns the input lacks become null."""
    columns = []
    for field in schema:
        source = F.col(field.name) if field.name in df.columns else F.lit(None)
        columns.append(source.cast(field.dataType).alias(field.name))
    return df.select(*columns)
