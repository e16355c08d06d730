"""Run catalogue: listing, detail, status, tags, configuration and removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.functions import expressions as X
from metricloom.model import TERMINAL_STATUSES

CONFIG_TYPE = "map<string,string>"


def newest_first(runs: DataFrame) -> list:
    return [F.desc("created_at"), F.desc("id")]


def new_runs(configs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Rows for freshly created runs; ids already in the catalogue are left out.

    ``configs`` has id, name, project, config, notes and created_at.
    """
    rows = validate_names(configs).select(
        "id",
        "name",
        F.coalesce("project", F.lit("default")).alias("project"),
        F.lit("running").alias("status"),
        "config",
        "notes",
        "created_at",
        F.col("created_at").alias("updated_at"),
        F.lit(None).cast("timestamp").alias("finished_at"),
        F.lit(None).cast("double").alias("duration_seconds"),
    )
    return rows if existing is None else rows.join(existing.select("id"), "id", "left_anti")


def validate_names(runs: DataFrame) -> DataFrame:
    """Trim names and keep the rows that have one."""
    return runs.withColumn("name", X.run_name_or_null(F.col("name"))).where(
        F.col("name").isNotNull()
    )


def invalid_names(runs: DataFrame) -> DataFrame:
    """The rows :func:`validate_names` turns away, for a quarantine table."""
    return runs.where(X.run_name_or_null(F.col("name")).isNull())


def list_runs(
    runs: DataFrame,
    project: str | None = None,
    status: str | None = None,
    limit: int | None = 100,
    offset: int = 0,
) -> DataFrame:
    """Newest runs first, optionally of one project or status."""
    out = runs
    if project is not None:
        out = out.where(F.col("project") == project)
    if status is not None:
        out = out.where(F.col("status") == status)
    out = out.orderBy(*newest_first(out))
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def runs_with_tags(runs: DataFrame, run_tags: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Runs that carry every one of the tags."""
    hits = (
        run_tags.where(F.col("tag").isin(*tags))
        .groupBy("run_id")
        .agg(F.count_distinct("tag").alias("hits"))
        .where(F.col("hits") == len(set(tags)))
    )
    return runs.join(hits.select(F.col("run_id").alias("id")), "id", "left_semi")


def dedupe_tags(run_tags: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Each (run, tag) once, without those already stored."""
    out = run_tags.dropDuplicates(["run_id", "tag"])
    return out if existing is None else out.join(existing, ["run_id", "tag"], "left_anti")


def run_detail(runs: DataFrame, run_tags: DataFrame) -> DataFrame:
    """Runs with the configuration as a map and the sorted tags as an array."""
    tags = run_tags.groupBy("run_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    config = F.coalesce(F.from_json("config", CONFIG_TYPE), F.create_map().cast(CONFIG_TYPE))
    return (
        runs.join(tags.withColumnRenamed("run_id", "id"), "id", "left")
        .withColumn("config", config)
        .withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    )


def short_listing(runs: DataFrame) -> DataFrame:
    """The columns of a run table on a terminal."""
    return runs.select(
        F.substring("id", 1, 8).alias("id"),
        "name",
        "project",
        "status",
        F.substring(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), 1, 19).alias(
            "created_at"
        ),
    )


def default_run(runs: DataFrame, recent: int = 50) -> DataFrame:
    """Among the newest runs the first running one, else the newest."""
    running = F.when(F.col("status") == "running", 0).otherwise(1)
    return (
        runs.orderBy(*newest_first(runs))
        .limit(recent)
        .orderBy(running, *newest_first(runs))
        .limit(1)
    )


def apply_status_events(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Runs with the newest status event applied.

    ``events`` has run_id, status, duration_seconds, timestamp. Statuses are kept
    as an append-only log; the current one is the latest per run. A terminal
    status also sets the finish time and duration; any other leaves them alone.
    """
    terminal = F.col("status").isin(*TERMINAL_STATUSES)
    stamp = F.struct("timestamp", "status", "duration_seconds")
    latest = events.groupBy(F.col("run_id").alias("id")).agg(
        F.max(stamp).alias("_last"), F.max(F.when(terminal, stamp)).alias("_end")
    )
    return runs.join(latest, "id", "left").select(
        *[
            {
                "status": F.coalesce("_last.status", "status").alias("status"),
                "updated_at": F.coalesce("_last.timestamp", "updated_at").alias("updated_at"),
                "finished_at": F.coalesce("_end.timestamp", "finished_at").alias("finished_at"),
                "duration_seconds": F.when(
                    F.col("_end").isNotNull(), F.col("_end.duration_seconds")
                )
                .otherwise(F.col("duration_seconds"))
                .alias("duration_seconds"),
            }.get(c, F.col(c))
            for c in runs.columns
        ]
    )


# -- configuration -----------------------------------------------------------


def _entries(runs: DataFrame, ids: DataFrame, side: str) -> DataFrame:
    picked = runs.join(ids, runs["id"] == ids[f"run_{side}"])
    return picked.select(
        "run_a", "run_b", F.explode(F.from_json("config", CONFIG_TYPE)).alias("key", side)
    )


def config_diff(runs: DataFrame, pairs: DataFrame, mode: str = "inclusive") -> DataFrame:
    """Key-wise comparison of configurations for every (run_a, run_b) of ``pairs``.

    ``inclusive`` marks each key whose values differ as a difference, a missing
    key counting as null; ``exclusive`` compares only keys present on both sides.
    Keys are matched by a join, so wide configurations spread over the cluster.
    """
    if mode not in ("inclusive", "exclusive"):
        raise ValueError(mode)
    join_keys = ["run_a", "run_b", "key"]
    a = _entries(runs, pairs, "a").withColumn("_in_a", F.lit(True))
    b = _entries(runs, pairs, "b").withColumn("_in_b", F.lit(True))
    both = a.join(b, join_keys, "full_outer")
    in_a = F.coalesce("_in_a", F.lit(False))
    in_b = F.coalesce("_in_b", F.lit(False))
    differs = ~F.col("a").eqNullSafe(F.col("b"))
    if mode == "exclusive":
        differs = differs & in_a & in_b
    out = both.select(
        *join_keys,
        "a",
        "b",
        differs.alias("differs"),
        (in_a & ~in_b).alias("only_in_a"),
        (in_b & ~in_a).alias("only_in_b"),
    )
    return out.where("differs OR only_in_a OR only_in_b")


def config_key_sets(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Keys of either side and the keys only one side has, as arrays."""
    keys = F.coalesce(F.map_keys(F.from_json("config", CONFIG_TYPE)), F.array().cast("array<string>"))
    side = runs.select("id", F.array_sort(keys).alias("keys"))
    a = side.select(F.col("id").alias("run_a"), F.col("keys").alias("ka"))
    b = side.select(F.col("id").alias("run_b"), F.col("keys").alias("kb"))
    return (
        pairs.join(a, "run_a")
        .join(b, "run_b")
        .select(
            "run_a",
            "run_b",
            F.array_sort(F.array_union("ka", "kb")).alias("all_keys"),
            F.array_sort(F.array_except("ka", "kb")).alias("only_in_a"),
            F.array_sort(F.array_except("kb", "ka")).alias("only_in_b"),
        )
    )


def merge_config(runs: DataFrame, updates: DataFrame, prefix: str = "") -> DataFrame:
    """Lay new key/values over stored configurations; later keys win.

    ``updates`` has id and ``entries`` (map). ``prefix`` groups them, as in
    ``trainer/`` or ``training/``.
    """
    prefixed = F.transform_keys("entries", lambda k, v: F.concat(F.lit(prefix), k))
    new = updates.select("id", prefixed.alias("_new"))
    stored = F.coalesce(F.from_json("config", CONFIG_TYPE), F.create_map().cast(CONFIG_TYPE))
    untouched = F.map_filter(stored, lambda k, v: ~F.map_contains_key("_new", k))
    merged = F.to_json(F.map_concat(untouched, F.col("_new")))
    return (
        runs.join(new, "id", "left")
        .withColumn("config", F.when(F.col("_new").isNull(), F.col("config")).otherwise(merged))
        .drop("_new")
    )


# -- retention and removal ---------------------------------------------------


def within_retention(df: DataFrame, days: int, now, column: str = "created_at") -> DataFrame:
    """Rows younger than ``days`` at the time ``now`` (a column or timestamp text)."""
    at = now if not isinstance(now, str) else F.lit(now).cast("timestamp")
    return df.where(F.col(column) >= at - F.make_dt_interval(days=F.lit(days)))


def delete_runs(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the runs in ``doomed`` (column ``run_id``)."""
    out = {}
    for name, df in tables.items():
        key = "id" if name == "runs" else "run_id"
        out[name] = df.join(doomed.select(F.col("run_id").alias(key)), key, "left_anti")
    return out


def active_only(df: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of runs that are still running."""
    active = runs.where(F.col("status") == "running").select(F.col("id").alias("run_id"))
    return df.join(active, "run_id", "left_semi")
