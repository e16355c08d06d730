"""Streaming telemetry rollup: the batch aggregate on a watermarked stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from metricloom.operators.telemetry import WINDOW, rollup_by_time

LATENESS = "10 minutes"


def start_rollup(
    telemetry: DataFrame,
    path: str,
    checkpoint: str,
    width: str = WINDOW,
    lateness: str = LATENESS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write each window once, when the watermark has passed it."""
    rolled = rollup_by_time(telemetry.withWatermark("timestamp", lateness), width)
    return (
        rolled.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )
