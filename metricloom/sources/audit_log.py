"""Audit logs as JSON lines: one folder per log and segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.model import AUDIT

_FIELDS = AUDIT.names


def write_log(chain: DataFrame, path: str, max_lines: int = 1_000_000) -> None:
    """Append chained events as compressed JSON lines; the line number is kept with each."""
    present = [c for c in _FIELDS if c in chain.columns]
    (
        chain.select("log", "segment", "line_no", *present)
        .sortWithinPartitions("log", "segment", "line_no")
        .write.mode("append")
        .partitionBy("log", "segment")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", max_lines)
        .json(path)
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines with their log and segment."""
    return spark.read.schema("value string, log string, segment bigint").text(path)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Stored fields plus ``parse_error`` (null for good lines).

    Lines of :func:`metricloom.sources.line_source.read_numbered` keep their file, number and offset, and
    the error of a broken one names its line.
    """
    fields = AUDIT.simpleString()[len("struct<") : -1]
    schema = f"line_no bigint, {fields.replace(':', ' ')}, _bad string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = lines.select(
        *[c for c in lines.columns if c != "value"],
        F.explode(F.array(F.from_json("value", schema, options))).alias("_e"),  # parse once
    )
    keep = [c for c in lines.columns if c not in ("value", "line_no")]
    line_no = F.coalesce(F.col("_e.line_no"), F.col("line_no")) if "line_no" in lines.columns else F.col("_e.line_no")
    problem = F.lit("malformed JSON")
    if "file_line" in lines.columns:
        problem = F.concat(problem, F.lit(" in line "), F.col("file_line"))
    return parsed.select(
        *keep,
        line_no.alias("line_no"),
        *[F.col(f"_e.{c}").alias(c) for c in _FIELDS],
        F.when(F.col("_e._bad").isNotNull(), problem).alias("parse_error"),
    )


def good_events(parsed: DataFrame) -> DataFrame:
    """What queries see: bad lines are skipped."""
    return parsed.where(F.col("parse_error").isNull()).drop("parse_error")
