"""Artifact catalogue, retention and tensors held as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions import expressions as X


def artifact_step() -> Column:
    return F.coalesce(F.get_json_object("metadata", "$.step").cast("long"), F.lit(0))


def artifact_kind() -> Column:
    """Records without a type are tensors."""
    return F.coalesce("artifact_type", F.lit("tensor"))


def catalogue_files(files: DataFrame) -> DataFrame:
    """Catalogue columns from a ``binaryFile`` read: name, path, size and checksum."""
    base = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    return files.select(
        "path",
        X.safe_file_name(stem).alias("name"),
        F.col("length").alias("size_bytes"),
        X.short_digest(F.col("content")).alias("checksum"),
        F.col("modificationTime").alias("created_at"),
    )


def explode_index(index: DataFrame, json: str = "value") -> DataFrame:
    """Rows of a JSON index file: artifact id -> record."""
    record = (
        "struct<name:string,type:string,path:string,shape:array<bigint>,dtype:string,"
        "tensors:map<string,struct<shape:array<bigint>,dtype:string>>,step:bigint,"
        "created_at:string,checksum:string>"
    )
    rows = index.select(F.explode(F.from_json(json, f"map<string,{record}>")).alias("id", "_r"))
    return rows.select("id", "_r.*").withColumnRenamed("type", "artifact_type")


def checkpoint_tensors(index: DataFrame) -> DataFrame:
    """One row per tensor of a multi-tensor checkpoint record."""
    rows = index.where(F.col("tensors").isNotNull())
    return rows.select("id", "name", "step", F.explode("tensors").alias("tensor", "_t")).select(
        "id", "name", "step", "tensor", "_t.shape", "_t.dtype"
    )


def list_artifacts(artifacts: DataFrame, kind: str | None = None) -> DataFrame:
    out = artifacts if kind is None else artifacts.where(artifact_kind() == kind)
    return out.orderBy(F.desc("created_at"), "id")


def artifact_at_step(artifacts: DataFrame, name: str, step: int) -> DataFrame:
    """The earliest recorded artifact of this name and step."""
    hit = artifacts.where((F.col("name") == name) & (artifact_step() == step))
    return hit.orderBy("created_at", "id").limit(1)


def expired_artifacts(
    artifacts: DataFrame, keep_last_n: int = 5, kind: str | None = None
) -> DataFrame:
    """Artifacts beyond the newest ``keep_last_n`` steps of each run and name.

    What to keep is found by a rank limit that Spark applies before the shuffle;
    the rest is what an anti-join leaves, so a name with very many artifacts is
    never gathered in one task.
    """
    out = artifacts if kind is None else artifacts.where(artifact_kind() == kind)
    return out.join(kept_artifacts(out, keep_last_n).select("id"), "id", "left_anti")


def kept_artifacts(artifacts: DataFrame, keep_last_n: int = 5) -> DataFrame:
    w = Window.partitionBy("run_id", "name").orderBy(F.desc(artifact_step()), F.desc("id"))
    ranked = artifacts.withColumn("_rank", F.row_number().over(w))
    return ranked.where(F.col("_rank") <= keep_last_n).drop("_rank")


def recent_tensors(runs: DataFrame, artifacts: DataFrame, recent: int = 20) -> DataFrame:
    """Tensors and checkpoints of the newest runs, with the run's name.

    The run side has ``recent`` rows, hence the broadcast.
    """
    newest = (
        runs.orderBy(F.desc("created_at"), F.desc("id"))
        .limit(recent)
        .select(F.col("id").alias("run_id"), F.col("name").alias("run_name"))
    )
    wanted = artifacts.where(F.col("artifact_type").isin("tensor", "checkpoint"))
    return wanted.join(F.broadcast(newest), "run_id")


def store_size(files: DataFrame) -> DataFrame:
    """Total bytes and megabytes of a ``binaryFile`` listing; contents are not read."""
    return files.agg(
        F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"),
        F.round(X.bytes_to_mb(F.coalesce(F.sum("length"), F.lit(0))), 2).alias("total_size_mb"),
    )


# -- tensors as tables -------------------------------------------------------


def tensor_slice(elements: DataFrame, **ranges: tuple[int, int]) -> DataFrame:
    """Elements whose index columns lie in half-open ranges."""
    out = elements
    for column, (start, stop) in ranges.items():
        out = out.where((F.col(column) >= start) & (F.col(column) < stop))
    return out


def tensor_info(elements: DataFrame, keys: list[str], dims: list[str], width: int = 4) -> DataFrame:
    """Shape, element count and bytes of exploded tensors."""
    shape = F.array(*[(F.max(d) + 1).cast("long") for d in dims])
    return elements.groupBy(*keys).agg(
        shape.alias("shape"),
        F.count(F.lit(1)).alias("elements"),
        (F.count(F.lit(1)) * width).alias("size_bytes"),
    )
