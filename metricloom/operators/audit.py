"""Hash-chained audit logs: building, checking, querying.

A log is cut into segments of a fixed number of lines, as log files are by
rotation. Each segment holds its own chain, starting from nothing, so segments
are built and checked independently; a second, small chain over the segment
heads ties a log's segments together.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.operators.ordered import HOT_ROWS, GroupProfile, OrderedGroups

#: Lines of one chain segment; bounds what a task holds.
SEGMENT_LINES = 10_000
SEPARATOR = "\x1f"
HASHED = ["id", "timestamp", "action", "actor", "resource_type", "resource_id", "details"]

# Event and severity names.
ACTIONS = [
    "run.create",
    "run.update",
    "run.delete",
    "run.finish",
    "metric.log",
    "artifact.upload",
    "artifact.download",
    "artifact.delete",
    "insight.generate",
    "insight.vote",
    "data.access",
    "data.export",
    "config.change",
    "auth.success",
    "auth.failure",
    "permission.denied",
    "system.start",
    "system.stop",
    "error",
]
SEVERITIES = ["debug", "info", "warning", "error", "critical"]


def event_hash(previous: Column) -> Column:
    """SHA-256 over the identifying fields and the previous hash ('' at the start)."""
    fields = [F.coalesce(F.col(c), F.lit("")) for c in HASHED]
    content = F.concat_ws(SEPARATOR, *fields, F.coalesce(previous, F.lit("")))
    return F.sha2(content, 256)


def _chain(lines: pd.DataFrame) -> pd.DataFrame:
    """Link one bounded segment in line order."""
    lines = lines.sort_values("line_no")
    previous, before, after = "", [], []
    for prefix in lines["_content"]:
        before.append(previous or None)
        previous = hashlib.sha256((prefix + previous).encode()).hexdigest()
        after.append(previous)
    return lines.assign(previous_hash=before, event_hash=after)[
        ["log", "segment", "line_no", "previous_hash", "event_hash"]
    ]


def build_chain(
    events: DataFrame,
    segment_lines: int = SEGMENT_LINES,
    profile: GroupProfile | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``segment``, ``previous_hash`` and ``event_hash``.

    ``events`` has log, line_no (unique and ordered within a log) and the event
    fields. Only the text to hash visits Python, one segment at a time.
    """
    numbered = OrderedGroups(events, ["log"], ["line_no"], profile, hot_rows).index().result()
    segment = F.floor(F.col("idx") / segment_lines).cast("long")
    rows = numbered.withColumn("segment", segment).drop("idx", "n")
    fields = [F.coalesce(F.col(c), F.lit("")) for c in HASHED]
    content = F.concat(F.concat_ws(SEPARATOR, *fields), F.lit(SEPARATOR))
    links = (
        rows.select("log", "segment", "line_no", content.alias("_content"))
        .groupBy("log", "segment")
        .applyInPandas(
            _chain,
            "log string, segment long, line_no long, previous_hash string, event_hash string",
        )
    )
    return rows.join(links, ["log", "segment", "line_no"])


def segment_heads(chain: DataFrame) -> DataFrame:
    """Last hash and line count of every segment."""
    return chain.groupBy("log", "segment").agg(
        F.max_by("event_hash", "line_no").alias("head"), F.count(F.lit(1)).alias("lines")
    )


def _heads(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("unit")
    link, links = "", []
    for head in group["head"]:
        link = hashlib.sha256((link + SEPARATOR + head).encode()).hexdigest()
        links.append(link)
    return group.assign(link=links)[["log", "level", "parent", "unit", "head", "link"]]


def link_segments(chain: DataFrame, fan_out: int = SEGMENT_LINES) -> DataFrame:
    """Chain the segment heads of each log, level by level.

    Heads are chained in runs of ``fan_out``; the last link of each run becomes a
    head one level up, until a single run is left. A run is bounded, and the
    number of levels is the logarithm of the segment count.
    """
    schema = "log string, level int, parent long, unit long, head string, link string"
    heads = segment_heads(chain).select("log", F.col("segment").alias("unit"), "head")
    level, out = 0, None
    top = heads.agg(F.max("unit")).first()[0] or 0
    while True:
        linked = (
            heads.withColumn("level", F.lit(level))
            .withColumn("parent", F.floor(F.col("unit") / fan_out).cast("long"))
            .groupBy("log", "parent")
            .applyInPandas(_heads, schema)
        )
        out = linked if out is None else out.unionByName(linked)
        top //= fan_out
        if top == 0:
            return out
        heads = linked.groupBy("log", F.col("parent").alias("unit")).agg(
            F.max_by("link", F.col("unit")).alias("head")
        )
        level += 1


def verify_chain(
    lines: DataFrame, profile: GroupProfile | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Errors of stored lines: (log, segment, line_no, error).

    ``lines`` has log, segment, line_no, the stored fields and, for lines that
    could not be parsed, ``parse_error``. Such a line does not advance the chain.
    Hashes are recomputed with the preceding good line's stored hash.
    """
    has_errors = "parse_error" in lines.columns
    good = lines.where(F.col("parse_error").isNull()) if has_errors else lines
    linked = OrderedGroups(good, ["log", "segment"], ["line_no"], profile, hot_rows).frames(
        1, 0, lambda w: {"_prior": F.lag("event_hash", 1).over(w)}
    )
    checked = linked.result().select(
        "log",
        "segment",
        "line_no",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(
                        ~F.col("previous_hash").eqNullSafe(F.col("_prior")), "Previous hash mismatch"
                    ),
                    F.when(
                        ~F.col("event_hash").eqNullSafe(event_hash(F.col("_prior"))),
                        "Event hash mismatch (tampering detected)",
                    ),
                )
            )
        ).alias("error"),
    )
    if not has_errors:
        return checked
    broken = lines.where(F.col("parse_error").isNotNull()).select(
        "log",
        "segment",
        "line_no",
        F.concat(F.lit("Parse error - "), F.col("parse_error")).alias("error"),
    )
    return checked.unionByName(broken)


def verify_summary(lines: DataFrame, errors: DataFrame) -> DataFrame:
    """Lines, errors and verdict per log."""
    total = lines.groupBy("log").agg(F.count(F.lit(1)).alias("lines"))
    wrong = errors.groupBy("log").agg(F.count(F.lit(1)).alias("errors"))
    return total.join(wrong, "log", "left").select(
        "log",
        "lines",
        F.coalesce("errors", F.lit(0)).alias("errors"),
        F.col("errors").isNull().alias("valid"),
    )


def query_events(
    events: DataFrame,
    action: str | None = None,
    actor: str | None = None,
    resource_type: str | None = None,
    start: str | None = None,
    end: str | None = None,
    limit: int | None = 100,
) -> DataFrame:
    """Matching events in log order; times are inclusive."""
    out = events
    for column, value in (("action", action), ("actor", actor), ("resource_type", resource_type)):
        if value is not None:
            out = out.where(F.col(column) == value)
    at = F.to_timestamp("timestamp") if dict(events.dtypes)["timestamp"] == "string" else F.col("timestamp")
    if start is not None:
        out = out.where(at >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.where(at <= F.lit(end).cast("timestamp"))
    out = out.orderBy("log", "line_no")
    return out if limit is None else out.limit(limit)


def audit_statistics(events: DataFrame) -> DataFrame:
    """Event counts in total, by action and by severity, in one pass.

    Counting (action, severity) pairs first leaves a table whose size is the
    number of distinct pairs; the grouping sets then run over that.
    """
    pairs = events.groupBy("action", "severity").agg(F.count(F.lit(1)).alias("_c"))
    sets = pairs.groupingSets(
        [[], [F.col("action")], [F.col("severity")]], F.col("action"), F.col("severity")
    )
    return sets.agg(
        F.sum("_c").alias("events"), F.grouping("action").alias("_a"), F.grouping("severity").alias("_s")
    ).select(
        F.when(F.col("_a") == 0, "action").when(F.col("_s") == 0, "severity").otherwise("total").alias(
            "dimension"
        ),
        F.coalesce("action", "severity", F.lit("")).alias("key"),
        "events",
    )
