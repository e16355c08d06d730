"""A data source for line files in which every line, also a broken one, has its number and byte offset.

``spark.read.format("numbered_lines").load(folder)`` after :func:`register`, or :func:`read_numbered`. One
task reads one file as a stream, so a file of any length costs the memory of a batch. Folder names such as
``log=a/segment=3`` become columns. Offsets count bytes of the text, after decompression of ``.gz`` files.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

NAME = "numbered_lines"
SCHEMA = "value string, log string, segment bigint, file string, file_line bigint, byte_offset bigint"
BATCH_LINES = 10_000
CHUNK = 1 << 20


def _open(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def numbered(stream) -> Iterator[tuple[bytes, int, int]]:
    """(line without its end, number from 1, offset) of a binary stream; a last line needs no end."""
    rest, number, offset = b"", 0, 0
    while True:
        chunk = stream.read(CHUNK)
        *lines, rest = (rest + chunk).split(b"\n") if chunk else (*([rest] if rest else []), b"")
        for line in lines:
            number += 1
            yield line, number, offset
            offset += len(line) + 1
        if not chunk:
            return


@dataclass
class _File(InputPartition):
    path: str
    log: str | None
    segment: int | None


class _Reader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self) -> list[_File]:
        from pyarrow import fs

        system, root = _open(self.uri)
        found = []
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            inside = info.path[len(root) :].strip("/").split("/")
            if info.type != fs.FileType.File or any(p[:1] in ("_", ".") for p in inside):
                continue
            keys = dict(p.split("=", 1) for p in inside[:-1] if "=" in p)
            log, segment = keys.get("log"), keys.get("segment")
            found.append(_File(info.path, log and unquote(log), segment and int(segment)))
        return found

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without files
            return
        system, _ = _open(self.uri)
        names = ["value", "log", "segment", "file", "file_line", "byte_offset"]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

        def batch(rows: list) -> pa.RecordBatch:
            text, number, offset = zip(*rows)
            n = len(rows)
            values = [t.decode("utf-8", "replace") for t in text]
            columns = [values, [partition.log] * n, [partition.segment] * n, [partition.path] * n, number, offset]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names)

        packed = "gzip" if partition.path.endswith(".gz") else None
        rows: list = []
        with system.open_input_stream(partition.path, compression=packed) as stream:
            for row in numbered(stream):
                rows.append(row)
                if len(rows) == BATCH_LINES:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)


class NumberedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(NumberedLines)
    return spark


def read_numbered(spark: SparkSession, folder: str) -> DataFrame:
    """value, log, segment, file, file_line and byte_offset of every line below ``folder``."""
    return register(spark).read.format(NAME).load(folder)
