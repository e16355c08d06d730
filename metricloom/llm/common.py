"""Helpers shared by the operators: tables, stored intermediate results, files in the shared folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.session import configure, new_work_folder

# Fixed value: white space of the word rule (space, \t, \n, \v, \f, \r); a word is a run of anything else.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


class Registry(dict):
    """Query name -> :class:`Query`, filled by the decorator."""

    def query(self, sql: str | None = None):
        def add(function):
            def run(spark: SparkSession, folder: str) -> DataFrame:
                return function(configure(spark), folder)

            self[function.__name__] = Query(run, sql)
            return function

        return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage so that a lost executor costs a re-read, and gives the planner
    the real size: Spark broadcasts such a table only below its own threshold.
    """
    spark = df.sparkSession
    folder = new_work_folder(spark, label)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key's text falls in the fold; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def word_count(text: Column) -> Column:
    """Number of words, without Python; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def quoted(name: str) -> Column:
    """The column of that very name, dots included."""
    return F.col(f"`{name.replace('`', '``')}`")


def open_folder(uri: str):
    """(file system, path) of a shared folder, for tasks that write or read byte ranges of their own files."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
