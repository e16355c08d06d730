"""Stateful streams: live trends and audit hash chains.

State is one small value per key in the state store, which Spark keeps in the
checkpoint folder; a lost executor's state is rebuilt from there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from metricloom.operators.audit import HASHED, SEPARATOR


class _Trend(StatefulProcessor):
    """Latest point of a series per trigger and its direction since the last one shown."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._shown = handle.getValueState("shown", "step long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        shown = self._shown.get() if self._shown.exists() else None
        newest = None
        for part in rows:  # one Arrow batch at a time; only the newest point is held
            top = part.sort_values(["step", "value"]).iloc[-1]
            point = (int(top["step"]), float(top["value"]))
            newest = point if newest is None else max(newest, point)
        if newest is None or (shown is not None and newest[0] < shown[0]):
            return  # nothing newer than what is on display
        trend = "flat"
        if shown is not None and newest[1] != shown[1]:
            trend = "up" if newest[1] > shown[1] else "down"
        self._shown.update(newest)
        yield pd.DataFrame(
            {
                "run_id": [key[0]],
                "name": [key[1]],
                "step": [newest[0]],
                "value": [newest[1]],
                "trend": [trend],
            }
        )

    def close(self) -> None:
        pass


def live_trend(metrics: DataFrame) -> DataFrame:
    """Streaming frame (run_id, name, step, value, trend). Needs the RocksDB state store."""
    return metrics.select("run_id", "name", "step", "value").groupBy("run_id", "name").transformWithStateInPandas(
        statefulProcessor=_Trend(),
        outputStructType="run_id string, name string, step long, value double, trend string",
        outputMode="append",
        timeMode="None",
    )


class _Chain(StatefulProcessor):
    """Links audit events of a segment in line order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._head = handle.getValueState("head", "hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        previous = self._head.get()[0] if self._head.exists() else ""
        # A segment is bounded, and so is its share of a micro-batch.
        part = pd.concat(list(rows)).sort_values("line_no")
        before, after = [], []
        for content in part["content"]:
            before.append(previous or None)
            previous = hashlib.sha256((content + previous).encode()).hexdigest()
            after.append(previous)
        self._head.update((previous,))
        yield pd.DataFrame(
            {
                "log": key[0],
                "segment": key[1],
                "line_no": part["line_no"].to_numpy(),
                "previous_hash": before,
                "event_hash": after,
            }
        )

    def close(self) -> None:
        pass


def chain_stream(events: DataFrame) -> DataFrame:
    """Streaming hash chain of events that carry log, segment and line_no.

    Events of a segment must arrive in line order across micro-batches, as an
    append-only log delivers them.
    """
    fields = [F.coalesce(F.col(c), F.lit("")) for c in HASHED]
    content = F.concat(F.concat_ws(SEPARATOR, *fields), F.lit(SEPARATOR))
    return (
        events.select("log", "segment", "line_no", content.alias("content"))
        .groupBy("log", "segment")
        .transformWithStateInPandas(
            statefulProcessor=_Chain(),
            outputStructType=(
                "log string, segment long, line_no long, previous_hash string, event_hash string"
            ),
            outputMode="append",
            timeMode="None",
        )
    )


def start_append(
    df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    return (
        df.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )
