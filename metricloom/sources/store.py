"""The Parquet store: scans with fixed schemas, appends, exports and formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom import model
from metricloom.operators.ordered import GroupProfile, profile_groups

#: Above this many runs, metrics are partitioned by a hash bucket of the run id.
MAX_RUN_PARTITIONS = 10_000
RUN_BUCKETS = 1_024
#: Rows per metric file; a few hundred MB of snappy Parquet.
ROWS_PER_FILE = 20_000_000


def bucket_of(run_id: str = "run_id", buckets: int = RUN_BUCKETS):
    return F.pmod(F.hash(run_id), F.lit(buckets))


def write_metrics(
    metrics: DataFrame,
    path: str,
    profile: GroupProfile | None = None,
    mode: str = "append",
) -> None:
    """Append metrics, partitioned by run (or by run bucket when runs are many).

    Rows are range-partitioned by (run, name, step): a large run spreads over
    many files, small ones share, and row groups are narrow in name and step, so
    range queries skip most of them.
    """
    df = model.conform(metrics, model.METRICS)
    profile = profile or profile_groups(df, ["run_id"])
    if profile.groups > MAX_RUN_PARTITIONS:
        df, part = df.withColumn("run_bucket", bucket_of()), "run_bucket"
        order = ["run_bucket", "run_id", "name", "step"]
    else:
        part, order = "run_id", ["run_id", "name", "step"]
    (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode(mode)
        .option("compression", "snappy")
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .partitionBy(part)
        .parquet(path)
    )


def read_metrics(
    spark: SparkSession,
    path: str,
    run_ids: Sequence[str] | None = None,
    bucketed: bool = False,
    skip_corrupt: bool = False,
) -> DataFrame:
    """Metrics of all or some runs. The schema is fixed; an unreadable file stops the read unless ``skip_corrupt``.

    Only the partitions of the named runs are listed and read.
    """
    schema = model.METRICS
    if bucketed:
        schema = T.StructType([*schema.fields, T.StructField("run_bucket", T.IntegerType())])
    df = spark.read.schema(schema).option("ignoreCorruptFiles", skip_corrupt).parquet(path)
    if run_ids is not None:
        if bucketed:
            wanted = spark.range(1).select(
                F.array_distinct(F.transform(F.array(*[F.lit(r) for r in run_ids]),
                                             lambda r: F.pmod(F.hash(r), F.lit(RUN_BUCKETS)))).alias("b")
            ).first()["b"]
            df = df.where(F.col("run_bucket").isin(*wanted))
        df = df.where(F.col("run_id").isin(*run_ids))
    return df.select(*model.METRICS.names)


def compact_metrics(spark: SparkSession, source: str, target: str) -> None:
    """Rewrite the many small files a stream leaves as large, sorted ones elsewhere."""
    write_metrics(read_metrics(spark, source), target, mode="errorifexists")


def export_metrics(metrics: DataFrame, run_id: str, path: str) -> bool:
    """A run's metrics ordered by step; nothing is written for a run without any."""
    rows = metrics.where(F.col("run_id") == run_id)
    if rows.isEmpty():
        return False
    rows.orderBy("step").write.mode("overwrite").parquet(path)
    return True


def export_run(
    tables: dict[str, DataFrame], run_id: str, path: str, include_artifacts: bool = False
) -> list[str]:
    """Metadata, metrics and (if any) insights of a run below ``path``."""
    done = []
    tables["runs"].where(F.col("id") == run_id).write.mode("overwrite").json(f"{path}/metadata")
    done.append("metadata")
    if export_metrics(tables["metrics"], run_id, f"{path}/metrics"):
        done.append("metrics")
    extra = ["insights"] + (["artifacts"] if include_artifacts else [])
    for name in extra:
        rows = tables[name].where(F.col("run_id") == run_id)
        if not rows.isEmpty():
            rows.write.mode("overwrite").json(f"{path}/{name}")
            done.append(name)
    return done


def write_result(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Results as ``json``, ``csv`` (with header) or ``parquet``; ``table`` prints."""
    if fmt == "table":
        df.show(truncate=False)
    elif fmt == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif fmt in ("json", "parquet"):
        getattr(df.write.mode("overwrite"), fmt)(path)
    else:
        raise ValueError(fmt)


def append_new(df: DataFrame, path: str, key: str = "id") -> None:
    """Append rows whose key is not stored yet."""
    spark = df.sparkSession
    fresh = df.dropDuplicates([key])
    try:
        stored = spark.read.schema(df.schema).parquet(path)
        fresh = fresh.join(stored.select(key), key, "left_anti")
    except Exception as missing:  # first write
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    fresh.write.mode("append").parquet(path)


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and time of all files below a folder; contents only if selected."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
