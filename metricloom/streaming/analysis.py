"""Periodic analysis of the runs that received data, with caps and alerts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from metricloom.functions import expressions as X
from metricloom.operators.insights import (
    MAX_INSIGHTS_PER_RUN,
    analyse_runs,
    cap_per_run,
    insights_from_anomalies,
    to_insight_table,
)
from metricloom.operators.ordered import HOT_ROWS

INTERVAL_SECONDS = 30
HELD_ROWS = 10_000


#: A run without data for this long is forgotten; its next data makes it due at once.
FORGET_SECONDS = 7 * 24 * 3600


class _Due(StatefulProcessor):
    """When a run is to be analysed: at once if the last time is long enough ago, else when its timer fires."""

    def __init__(self, interval: int, forget: int):
        self._interval, self._forget = interval * 1000, forget * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "at long", ttlDurationMs=self._forget)
        self._waiting = handle.getValueState("waiting", "at long")

    def _now(self, key, at: int, by: str) -> Iterator[pd.DataFrame]:
        self._last.update((at,))
        yield pd.DataFrame({"run_id": [key[0]], "at": [pd.Timestamp(at, unit="ms")], "by": [by]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass
        at = timerValues.getCurrentProcessingTimeInMs()
        due = self._last.get()[0] + self._interval if self._last.exists() else at
        if due <= at:
            yield from self._now(key, at, "data")
        elif not self._waiting.exists():
            self._waiting.update((due,))
            self._handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._waiting.clear()
        yield from self._now(key, timerValues.getCurrentProcessingTimeInMs(), "timer")

    def close(self) -> None:
        pass


def due_runs(stream: DataFrame, interval: int = INTERVAL_SECONDS, forget: int = FORGET_SECONDS) -> DataFrame:
    """Streaming frame (run_id, at, by) of runs to analyse. Needs the RocksDB state store.

    A run with new data is due at once when its last analysis is ``interval`` seconds old; if not, a timer makes it due
    when it is, with or without further data. State is two numbers a run.
    """
    return stream.select("run_id").groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=_Due(interval, forget),
        outputStructType="run_id string, at timestamp, by string",
        outputMode="update",
        timeMode="ProcessingTime",
    )


def _stored(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """What earlier batches wrote; a batch that is run again does not see itself."""
    try:
        return spark.read.parquet(path).where(F.col("batch") < batch_id)
    except Exception as missing:
        if "PATH_NOT_FOUND" in str(missing) or "UNABLE_TO_INFER_SCHEMA" in str(missing):
            return None
        raise


def start_analysis(
    stream: DataFrame,
    history: Callable[[], DataFrame],
    runs: Callable[[], DataFrame],
    path: str,
    checkpoint: str,
    alert: Callable[[DataFrame, int], None] | None = None,
    sensitivity: float = 0.8,
    cap: int = MAX_INSIGHTS_PER_RUN,
    interval: int = INTERVAL_SECONDS,
    hot_rows: int = HOT_ROWS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Analyse running runs over their whole history, each at most once an interval.

    ``history`` and ``runs`` deliver the tables to read. Analysis times, anomalies, insights up to ``cap`` per run and those
    ``held`` beyond it are written under ``path`` by batch id; a batch with all its outputs is listed in ``done``. Ids of insights hold the batch, so a later
    analysis that finds the same gives a row of its own. ``alert`` receives the new anomalies of a batch. The query goes on until
    it is stopped, as timers need it (see :func:`run_until`).
    """

    def analyse(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        if rows.isEmpty():
            return
        rows.write.mode("overwrite").parquet(f"{path}/analysed/batch={batch_id}")
        rows.unpersist()
        due = spark.read.schema(batch.schema).parquet(f"{path}/analysed/batch={batch_id}").select("run_id")
        metrics = history().join(due, "run_id", "left_semi")
        anomalies, _ = analyse_runs(metrics, runs(), sensitivity, hot_rows=hot_rows)
        anomalies.write.mode("overwrite").parquet(f"{path}/anomalies/batch={batch_id}")
        found = spark.read.parquet(f"{path}/anomalies/batch={batch_id}")

        own = F.md5(F.concat_ws(":", F.col("id"), F.lit(batch_id)))
        fresh = insights_from_anomalies(found, hot_rows).withColumn("id", own).checkpoint()
        capped = cap_per_run(fresh, _stored(spark, f"{path}/insights", batch_id), cap)
        to_insight_table(capped).write.mode("overwrite").parquet(f"{path}/insights/batch={batch_id}")
        kept = spark.read.parquet(f"{path}/insights/batch={batch_id}")
        held = to_insight_table(fresh.join(kept.select("id"), "id", "left_anti"))
        held.write.mode("overwrite").parquet(f"{path}/held/batch={batch_id}")
        if alert is not None:
            alert(found, batch_id)
        due.write.mode("overwrite").parquet(f"{path}/done/batch={batch_id}")

    return (
        due_runs(stream, interval)
        .writeStream.foreachBatch(analyse)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )


def run_until(query: StreamingQuery, done: Callable[[], bool], seconds: float = 120) -> None:
    """Let a query run until ``done`` holds, then stop it. Timers keep a query going, so it does not end with its data."""
    until = time.monotonic() + seconds
    try:
        while not done():
            if query.exception() is not None:
                raise query.exception()
            if time.monotonic() > until:
                raise TimeoutError(f"not done within {seconds} seconds")
            time.sleep(0.5)
    finally:
        query.stop()


class _Outlet(StatefulProcessor):
    """Lets insights of a run through up to a cap, and holds the rest until the run has finished.

    What is held lies in numbered chunks, each a value of its own, so neither a call a row nor the whole of a run at once is needed.
    """

    def __init__(self, cap: int, schema: str):
        self._cap, self._schema = cap, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._counts = handle.getValueState("counts", "passed long, chunks long")
        arrays = ", ".join(f"{name} array<{kind}>" for name, kind in (c.split() for c in self._schema.split(", ")))
        self._held = handle.getMapState("held", "chunk long", arrays)

    def _hold(self, rows: pd.DataFrame, chunks: int) -> int:
        """Put rows into further chunks; the new number of chunks."""
        rows = rows.astype(object).where(rows.notna(), None)
        for lo in range(0, len(rows), HELD_ROWS):
            part = rows.iloc[lo : lo + HELD_ROWS]
            self._held.updateValue((chunks,), tuple(part[c].tolist() for c in part.columns))
            chunks += 1
        return chunks

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, chunks = self._counts.get() if self._counts.exists() else (0, 0)
        room, finished, first = max(0, self._cap - passed), False, None
        for part in rows:  # one Arrow batch at a time; the gravest of all of them are kept apart
            finished = finished or bool(part["finished"].any())
            part = part[~part["finished"].astype(bool)].drop(columns="finished")
            if room:
                part = (part if first is None else pd.concat([first, part])).sort_values(["rank", "id"])
                first, part = part.iloc[:room], part.iloc[room:]
            chunks = self._hold(part, chunks)
        if first is not None and len(first):
            passed += len(first)
            yield first
        if finished:
            for chunk in range(chunks):
                held = pd.DataFrame(dict(zip((c.split()[0] for c in self._schema.split(", ")), self._held.getValue((chunk,)))))
                self._held.removeKey((chunk,))
                passed += len(held)
                yield held
            chunks = 0
        self._counts.update((passed, chunks))

    def close(self) -> None:
        pass


def capped_insights(insights: DataFrame, finished: DataFrame, cap: int = MAX_INSIGHTS_PER_RUN) -> DataFrame:
    """Streaming frame of (run_id, id, severity, rank): at most ``cap`` insights of a running run, none lost.

    ``insights`` is a stream with run_id, id and severity, ``finished`` one of run_id. In a micro-batch the gravest go first. What is beyond the
    cap waits in a list of the run's state and comes out when the run has finished. Needs the RocksDB state store.
    """
    schema = "run_id string, id string, severity string, rank int"
    rank = X.severity_rank(F.col("severity")).cast("int").alias("rank")
    rows = insights.select("run_id", F.col("id").cast("string").alias("id"), "severity", rank, F.lit(False).alias("finished"))
    ends = finished.select("run_id", F.lit("").alias("id"), F.lit("").alias("severity"), F.lit(0).alias("rank"), F.lit(True).alias("finished"))
    return rows.unionByName(ends).groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=_Outlet(cap, schema), outputStructType=schema, outputMode="append", timeMode="None"
    )


def alert_sink(path: str, severity: str = "critical") -> Callable[[DataFrame, int], None]:
    """An alert that files anomalies of one severity as JSON."""

    def write(anomalies: DataFrame, batch_id: int) -> None:
        urgent = anomalies.where(F.col("severity") == severity)
        urgent.write.mode("overwrite").json(f"{path}/batch={batch_id}")

    return write


def vote_stream(votes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch of votes to ``apply``."""
    return (
        votes.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
