"""Ingest: a stream of messages becomes metric rows, status events and a quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from metricloom.operators.runs import apply_status_events
from metricloom.sources import messages as M

METRIC_PARTITION = "run_id"


def start_metric_sink(
    metrics: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append metric rows to the store; the checkpoint makes restarts exact."""
    return (
        metrics.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .partitionBy(METRIC_PARTITION)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )


def start_message_ingest(
    raw: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Decode each micro-batch once and write its four outputs.

    Every output folder is named by the batch id and overwritten on a retry, so
    a batch that is run again adds nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        messages = M.decode(batch).persist()
        try:
            for name, rows in (
                ("metrics", M.metric_rows(messages)),
                ("tensors", M.tensor_elements(messages)),
                ("status_events", M.status_events(messages)),
                ("quarantine", M.quarantine(messages)),
            ):
                rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        finally:
            messages.unpersist()

    return (
        raw.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_ingested(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}").drop("batch")


def current_runs(runs: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Runs with the status events ingested so far."""
    return apply_status_events(runs, read_ingested(spark, path, "status_events"))


def watch_changes(files: DataFrame, notify, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Call ``notify(batch_id, names)`` with what changed; the trigger is the debounce.

    ``names`` is a frame of distinct (run_id, name) pairs, not collected here.
    """

    def tell(batch: DataFrame, batch_id: int) -> None:
        notify(batch_id, batch.select("run_id", "name").distinct())

    return (
        files.writeStream.foreachBatch(tell)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def with_event_time(metrics: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Watermark for rollups; ingest itself keeps every row however late."""
    return metrics.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark(
        "timestamp", delay
    )
