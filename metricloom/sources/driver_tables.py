"""The analytics tables derived from a folder of order, event and text tables.

Each function reads Parquet and returns a lazy frame, so filters and column
choices of the caller still reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How event types stand for metric names.
METRIC_OF_EVENT = {
    "error": "train_loss",
    "signup": "val_loss",
    "click": "accuracy",
    "purchase": "gradient_norm",
    "view": "learning_rate",
}
STATUS_OF_ORDER = {"O": "running", "F": "completed", "P": "failed"}
N_RUNS = 8


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def mapped(column: str, mapping: dict[str, str]) -> Column:
    """The column with its values replaced; others stay."""
    out = None
    for key, value in mapping.items():
        out = (F.when if out is None else out.when)(F.col(column) == key, F.lit(value))
    return out.otherwise(F.col(column))


def run_of_user(column: str = "user_id") -> Column:
    return F.pmod(F.col(column), F.lit(N_RUNS)).cast("string")


def metrics_from_events(events: DataFrame) -> DataFrame:
    """One metric row per event; works on batch and streaming frames alike."""
    return events.select(
        run_of_user().alias("run_id"),
        mapped("event_type", METRIC_OF_EVENT).alias("name"),
        "value",
        F.col("event_id").alias("step"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.lit("scalar").alias("metric_type"),
        F.col("props").alias("metadata"),
    )


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    return metrics_from_events(table(spark, folder, "events"))


def runs(spark: SparkSession, folder: str) -> DataFrame:
    day = F.col("o_orderdate").cast("timestamp")
    status = mapped("o_orderstatus", STATUS_OF_ORDER)
    done = status != "running"
    config = F.to_json(
        F.struct(
            F.col("o_custkey").alias("custkey"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("totalprice"),
            F.col("o_orderpriority").alias("priority"),
        )
    )
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.concat(F.lit("order-"), F.col("o_orderkey")).alias("name"),
        F.col("o_orderpriority").alias("project"),
        status.alias("status"),
        config.alias("config"),
        F.lit(None).cast("string").alias("notes"),
        day.alias("created_at"),
        day.alias("updated_at"),
        F.when(done, day + F.expr("INTERVAL 1 DAY")).alias("finished_at"),
        F.when(done, F.lit(86400.0)).alias("duration_seconds"),
    )


def run_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Tags with repeats, as an ingest would deliver them."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("run_id"), F.col("l_returnflag").alias("tag")
    )


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    parts = table(spark, folder, "part").select("p_partkey", "p_brand")
    day = F.date_format("l_shipdate", "yyyyMMdd")
    ident = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", day)
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        ident.alias("id"),
        F.col("l_orderkey").cast("string").alias("run_id"),
        F.col("p_brand").alias("name"),
        F.when(F.col("l_linestatus") == "O", "checkpoint").otherwise("tensor").alias(
            "artifact_type"
        ),
        F.concat(F.lit("artifacts/"), ident).alias("path"),
        F.floor("l_extendedprice").cast("long").alias("size_bytes"),
        F.substring(F.sha2(ident, 256), 1, 16).alias("checksum"),
        F.to_json(
            F.struct(F.col("l_linenumber").alias("step"), F.lit("float32").alias("dtype"))
        ).alias("metadata"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
    )


def insights(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    severity = (
        F.when(F.col("toxic") == 1, "critical").when(F.col("quality") == 0, "warning").otherwise("info")
    )
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"),
        F.substring("source", 4, 20).alias("run_id"),
        F.col("lang").alias("insight_type"),
        F.concat(F.lit("Insight "), F.col("doc_id")).alias("title"),
        F.concat(F.lit("Document of "), F.col("n_chars"), F.lit(" characters")).alias("description"),
        severity.alias("severity"),
        F.lit('["loss","learning_rate"]').alias("related_metrics"),
        F.lit(None).cast("string").alias("visualization_spec"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 60).alias("timestamp"),
        F.lit(0).cast("long").alias("votes_up"),
        F.lit(0).cast("long").alias("votes_down"),
    )


def votes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").select(
        F.concat(F.lit("v"), F.col("doc_id")).alias("id"),
        F.col("doc_id").cast("string").alias("insight_id"),
        F.lit("").alias("run_id"),
        F.when(F.col("quality") == 1, 1).otherwise(-1).alias("vote"),
        F.lit(None).cast("string").alias("feedback"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 60).alias("timestamp"),
    )


def audit_events(spark: SparkSession, folder: str) -> DataFrame:
    return audit_from_events(table(spark, folder, "events"))


def audit_from_events(events: DataFrame) -> DataFrame:
    """Audit records before hashing; one log per day."""
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.date_format(ts, "yyyy-MM-dd").alias("log"),
        F.col("event_id").alias("line_no"),
        F.concat(F.lit("e"), F.col("event_id")).alias("id"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.col("event_type").alias("action"),
        F.when(F.col("event_type") == "error", "error").otherwise("info").alias("severity"),
        F.concat(F.lit("user"), F.col("user_id")).alias("actor"),
        F.lit("run").alias("resource_type"),
        run_of_user().alias("resource_id"),
        F.col("props").alias("details"),
    )


def gradients(spark: SparkSession, folder: str) -> DataFrame:
    """Exploded tensor elements: one parameter per label."""
    vecs = table(spark, folder, "embeddings")
    return vecs.select(
        F.concat(F.lit("layer"), F.col("label")).alias("param"),
        F.posexplode("embedding").alias("pos", "value"),
        "vec_id",
    ).select("param", "vec_id", "pos", F.col("value").cast("double").alias("value"))


def hidden_states(spark: SparkSession, folder: str) -> DataFrame:
    """One vector per position; the vector id orders positions within a layer."""
    return table(spark, folder, "embeddings").select(
        F.concat(F.lit("layer"), F.col("label")).alias("layer"),
        F.col("vec_id").alias("pos"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def attention_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Attention-like rows: absolute vector entries scaled to sum one."""
    vec = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.abs(x))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return (
        table(spark, folder, "embeddings")
        .select(F.col("label").alias("layer"), "vec_id", vec.alias("v"))
        .select("layer", "vec_id", F.transform("v", lambda x: x / total).alias("weights"))
    )


def telemetry(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry_from_events(table(spark, folder, "events"))


def telemetry_from_events(events: DataFrame) -> DataFrame:
    """Hardware samples; the device index follows the user."""
    v = F.col("value")
    gpu = F.struct(
        F.pmod(F.col("user_id"), F.lit(2)).cast("int").alias("index"),
        F.lit("gpu").alias("name"),
        v.alias("memory_used_mb"),
        F.lit(1000.0).alias("memory_total_mb"),
        (v / 10).alias("memory_percent"),
        v.alias("utilization_percent"),
        (v / 8 + 30).alias("temperature_celsius"),
        v.alias("power_watts"),
    )
    return events.select(
        run_of_user().alias("run_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        v.alias("cpu_percent"),
        (v / 2).alias("memory_percent"),
        (v / 4).alias("memory_used_gb"),
        F.lit(1).alias("gpu_count"),
        F.array(gpu).alias("gpu_metrics"),
    )
