"""Decoding of log messages: one JSON document per row, five kinds.

The same functions serve batch frames and streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.model import MESSAGE, METRIC_TYPES

# Message kinds.
KINDS = ("metric", "metrics_batch", "tensor", "telemetry", "control")
# Commands of control messages.
COMMANDS = ("flush", "finish")


def decode(raw: DataFrame, column: str = "value") -> DataFrame:
    """Parsed envelopes with their ``kind``; the raw text stays in ``_raw``.

    The one-element explode keeps the optimiser from copying the parse into every
    filter and field that uses it.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parse = F.explode(F.array(F.from_json(column, MESSAGE, options)))
    parsed = raw.select(F.col(column).alias("_raw"), parse.alias("m"))
    return parsed.select("_raw", "m.*").withColumn("kind", F.coalesce("msg_type", F.lit("metric")))


def _unusable() -> Column:
    """Not JSON, of no known kind, or holding a metric of no known type."""
    return F.coalesce(_faults()[0].isNotNull(), F.lit(False))


def _faults() -> tuple[Column, Column]:
    """(why nothing of a message is taken, why not all of it is); null where there is no reason."""
    kind = F.col("kind")
    unknown = lambda t: F.coalesce(~t.isin(*METRIC_TYPES), F.lit(False))
    lacking = lambda m: m["name"].isNull() | m["step"].isNull()
    typed = unknown(F.col("metric_type")) | F.coalesce(F.exists("metrics", lambda m: unknown(m["metric_type"])), F.lit(False))
    nameless = F.col("name").isNull() | F.col("step").isNull()
    readings = F.coalesce(F.size(F.map_keys(F.from_json("data", "map<string,string>"))), F.lit(0)) <= 0
    nothing = (
        F.when(_not_json(), "not JSON")
        .when(~kind.isin(*KINDS), "unknown kind")
        .when(typed, "unknown metric type")
        .when(kind.isin("metric", "tensor") & nameless, "no name or step")
        .when((kind == "metrics_batch") & (F.coalesce(F.size("metrics"), F.lit(0)) <= 0), "empty batch")
        .when((kind == "tensor") & (F.size(_numbers()) <= 0), "no elements")
        .when((kind == "telemetry") & readings, "no readings")
        .when((kind == "control") & ~F.coalesce(F.col("command").isin(*COMMANDS), F.lit(False)), "unknown command")
    )
    return nothing, F.when((kind == "metrics_batch") & F.coalesce(F.exists("metrics", lacking), F.lit(False)), "entry without name or step")


def _not_json() -> Column:
    """Text that does not parse, or none at all (which parses as nothing)."""
    return F.col("_bad").isNotNull() | F.coalesce(F.trim("_raw") == "", F.lit(True))


def _numbers() -> Column:
    """The elements of a tensor's text, in order."""
    return F.coalesce(F.regexp_extract_all("data", F.lit(r"[^\[\],\s]+"), F.lit(0)), F.array().cast("array<string>"))


def quarantine(messages: DataFrame) -> DataFrame:
    """(raw, reason): the texts no other function below takes, or of which it does not take every entry.

    Every message is here, or gives rows, or is a command to flush, which is taken and has none.
    """
    nothing, partly = _faults()
    return messages.select(F.col("_raw").alias("raw"), F.coalesce(nothing, partly).alias("reason")).where("reason IS NOT NULL")


def message_accounts(messages: DataFrame) -> DataFrame:
    """(kind, outcome, messages): how many messages of each kind were taken, or for what reason they were not, or not wholly."""
    nothing, partly = _faults()
    outcome = F.coalesce(nothing, partly, F.lit("taken")).alias("outcome")
    kind = F.when(~_not_json() & F.col("kind").isin(*KINDS), F.col("kind")).otherwise("unknown").alias("kind")
    return messages.select(kind, outcome).groupBy("kind", "outcome").agg(F.count("*").alias("messages"))


def metric_rows(messages: DataFrame) -> DataFrame:
    """Metric rows of single, batched and telemetry messages.

    The three kinds become one array of entries per message, so a batch or
    stream is read once.
    """
    at = F.timestamp_micros((F.col("timestamp") * 1e6).cast("long"))
    number = lambda c: c.try_cast("double")

    def entry(name, value, step, kind, metadata):
        return F.struct(
            name.alias("name"),
            number(value).alias("value"),
            step.alias("step"),
            F.coalesce(kind, F.lit("scalar")).alias("metric_type"),
            metadata.alias("metadata"),
        )

    single = F.array(
        entry(*[F.col(c) for c in ("name", "value", "step", "metric_type", "metadata")])
    )
    batch = F.transform(
        "metrics",
        lambda m: entry(m["name"], m["value"], m["step"], m["metric_type"], m["metadata"]),
    )
    readings = F.transform(
        F.map_entries(F.from_json("data", "map<string,string>")),
        lambda e: entry(
            F.concat(F.lit("system/"), e["key"]),
            e["value"],
            F.coalesce(F.col("step"), F.lit(0).cast("long")),
            F.lit("scalar"),
            F.lit(None).cast("string"),
        ),
    )
    entries = (
        F.when(F.col("kind") == "metric", single)
        .when(F.col("kind") == "metrics_batch", batch)
        .when(F.col("kind") == "telemetry", readings)
    )
    good = messages.where(~_unusable())
    rows = good.select("run_id", at.alias("timestamp"), F.explode(entries).alias("_e"))
    return rows.select("run_id", "timestamp", "_e.*").where(
        F.col("name").isNotNull() & F.col("step").isNotNull()
    )


def tensor_elements(messages: DataFrame) -> DataFrame:
    """Tensor messages as (run_id, name, step, pos, value); nested lists are flattened in order.

    Every element keeps its place: NaN and infinities are values, anything else that is no number is null.
    """
    tensors = messages.where((F.col("kind") == "tensor") & ~_unusable())
    return tensors.select("run_id", "name", "step", F.posexplode(_numbers()).alias("pos", "_v")).select(
        "run_id", "name", "step", "pos", F.col("_v").try_cast("double").alias("value")
    )


def status_events(messages: DataFrame) -> DataFrame:
    """Finish commands as run status events."""
    done = (F.col("kind") == "control") & (F.col("command") == "finish")
    return messages.where(done).select(
        "run_id",
        F.coalesce("status", F.lit("completed")).alias("status"),
        F.col("duration").alias("duration_seconds"),
        F.timestamp_micros((F.col("timestamp") * 1e6).cast("long")).alias("timestamp"),
    )
