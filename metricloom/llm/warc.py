"""WARC archives with a two-level capture index.

Tasks write gzip-per-record archives and report where each record lies. Captures are sorted by
reversed-host URL key; runs of them are compressed into index blocks, and a sparse directory keeps
the first and last key of each block. A lookup reads the slice of the directory that its keys fall
in, finds blocks by binary search, and then reads the byte ranges of the records.

Every file has a name of its own per attempt and becomes valid only by the table that names it, so a
lost or repeated task leaves at most files nobody refers to.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm.common import open_folder, quoted, stored
from metricloom.session import new_work_folder

MIN_REVISIT_BYTES = 100
BLOCK_LINES = 1000
FILE_BYTES = 256 * 1024**2
READ_AHEAD = 4 * 1024**2

_RECORD = "page_id long, key string, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """Sort key of a URL: ``com,example,www)/path?query``, host reversed, lower-cased, no port or fragment.

    A null or empty URL, and one without host, gets ``-)`` and its text; blanks and control characters are escaped.
    """
    url = (url or "").strip()
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").lower()
    except ValueError:
        parts, host = None, ""
    if not host:
        return "-)" + quote(url, safe="/:?&=%#")
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + ")" + quote(rest, safe="/:?&=%+,;@!$'()*~.-_")


def capture_key(url: str | None, page_id: int | None) -> str:
    """Unique place of a capture in the index: URL key and page, sorted by URL first."""
    return f"{url_key(url)} {'-' if page_id is None else page_id}"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _clean(url: str | None) -> str:
    return quote(url or "about:blank", safe="/:?&=%#+,;@!$'()*~.-_[]")


def record_bytes(page_id, url, payload: bytes, digest: str, first_id, first_url, stamp: str) -> bytes:
    """One WARC/1.1 record: a response with its HTTP block, or a revisit that points at the first capture."""
    revisit = first_id is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {stamp}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-X-Payload-Length: {len(payload)}",
        f"WARC-X-Page-ID: {'-' if page_id is None else page_id}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(first_id, digest)}",
            f"WARC-Refers-To-Target-URI: {_clean(first_url)}",
            f"WARC-X-Refers-To-Page-ID: {first_id}",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _zip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _unzip(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


def _warcinfo(stamp: str) -> bytes:
    body = b"software: metricloom\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {stamp}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


@dataclass(frozen=True)
class Archive:
    """Where an archive lies: WARC files, index blocks and the tables that name them."""

    folder: str
    captures: DataFrame
    directory: DataFrame


def write_archives(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    stamp: str = "2024-01-01T00:00:00Z",
    min_revisit: int = MIN_REVISIT_BYTES,
    folder: str | None = None,
) -> Archive:
    """Write a record per row, then the index.

    Of rows with equal payloads of at least ``min_revisit`` bytes the smallest page_id is the
    response, the others revisit it; shorter payloads are all responses. A null html is an empty
    payload. A null page_id never is the first unless all of its payload are, which makes them
    responses; a repeated page_id repeats its record type. Null URLs are kept under the key ``-)``.
    Payloads never move: only digests are grouped (combined before the shuffle), and the table of
    first captures holds repeated payloads only.
    """
    spark = pages.sparkSession
    folder = folder or new_work_folder(spark, "warc")
    payload = F.coalesce(quoted(html), F.lit("")).cast("binary")
    rows = pages.select(
        quoted(page_id).cast("long").alias("page_id"), quoted(url).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest")
    )
    long_ones = rows.where(F.octet_length("payload") >= min_revisit)
    first = long_ones.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"))
    first = stored(first.where("n > 1 AND first IS NOT NULL").select("digest", "first"), "first-captures")
    marked = rows.join(first, "digest", "left").select(
        F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("first.page_id")), F.col("first.page_id").cast("string")).alias("first_id"),
        F.col("first.url").alias("first_url"),
    )  # fmt: skip  # ids travel as text: pandas has no whole numbers with nulls
    captures = stored(marked.mapInPandas(_writer(folder, stamp), _RECORD), "captures")
    return Archive(folder, captures, write_index(captures, folder))


def _writer(folder: str, stamp: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = open_folder(folder)
        fs.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for rows in batches:
            places = []
            for page, url, body, digest, first, first_url in rows[["page_id", "url", "payload", "digest", "first_id", "first_url"]].itertuples(index=False, name=None):
                page, first = (None if x is None else int(x) for x in (page, first))
                if out is None or at > FILE_BYTES:
                    if out:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    at += out.write(_zip(_warcinfo(stamp)))
                data = _zip(record_bytes(page, url, bytes(body), digest, first, first_url, stamp))
                out.write(data)
                places.append((page, capture_key(url, page), name, at, len(data)))
                at += len(data)
            found = pd.DataFrame(places, columns=["page_id", "key", "file", "offset", "length"])
            yield found.assign(page_id=pd.array([p[0] for p in places], "Int64"))
        if out:
            out.close()

    return write


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort captures by key, write them as compressed blocks, and return the stored sparse directory.

    Range partitioning by key and place spreads a URL captured a great many times over tasks and blocks.
    """
    lines = captures.select("key", "file", "offset", "length").repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = open_folder(folder)
        fs.create_dir(root, recursive=True)
        out, name, at, waiting = None, f"{uuid.uuid4().hex}.idx.gz", 0, []

        def block(rows: list) -> tuple:
            nonlocal out, at
            out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
            data = _zip("".join(f"{k} {json.dumps([f, o, n])}\n" for k, f, o, n in rows).encode())
            out.write(data)
            at += len(data)
            return rows[0][0], rows[-1][0], name, at - len(data), len(data), len(rows)

        columns = ["first_key", "last_key", "file", "offset", "length", "n"]
        for rows in batches:
            waiting += list(rows.itertuples(index=False, name=None))
            full = len(waiting) // block_lines * block_lines
            yield pd.DataFrame([block(waiting[i : i + block_lines]) for i in range(0, full, block_lines)], columns=columns)
            waiting = waiting[full:]
        if waiting:
            yield pd.DataFrame([block(waiting)], columns=columns)
        if out:
            out.close()

    blocks = lines.mapInPandas(write, "first_key string, last_key string, file string, offset long, length long, n long")
    return stored(blocks, "directory")


class BlockDirectory:
    """Sorted directory entries of one task's key range."""

    def __init__(self, entries: list[tuple[str, str, str, int, int]]):
        self.entries = sorted(entries)
        self.last_keys = [e[1] for e in self.entries]

    def blocks_for(self, key: str) -> list[tuple[str, str, str, int, int]]:
        """Blocks whose key range holds the key, found by binary search; several if a key fills blocks."""
        i, found = bisect.bisect_left(self.last_keys, key), []
        while i < len(self.entries) and self.entries[i][0] <= key:
            found.append(self.entries[i])
            i += 1
        return found


def block_lines_of(data: bytes) -> tuple[list[str], list[list]]:
    """(keys, places) of an index block."""
    keys, places = [], []
    for line in _unzip(data).decode().split("\n")[:-1]:
        m = re.match(r"(.*) (\[[^\[\]]*\])$", line, re.S)
        keys.append(m[1])
        places.append(json.loads(m[2]))
    return keys, places


def lookup(archive: Archive, keys: DataFrame, must_exist: bool = False) -> DataFrame:
    """(key, file, offset, length) of the captures under the given ``key``s.

    A key without captures gives no row, or stops the job with ``must_exist``; a damaged directory file
    or block always stops it.

    Keys are range-partitioned and sorted, so a batch of them falls in few neighbouring blocks; it reads
    that slice of the stored directory (Parquet statistics skip the rest), never the whole of it.
    """
    spark = archive.captures.sparkSession
    directory_files = archive.directory.inputFiles()
    root = directory_files[0].rsplit("/", 1)[0] if directory_files else None
    folder = archive.folder

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.dataset as ds

        fs, at = open_folder(folder)
        dir_fs, dir_at = open_folder(root)
        table = ds.dataset(dir_at, filesystem=dir_fs, format="parquet")
        opened: dict[str, object] = {}
        cached: tuple = (None, [], [])
        for rows in batches:
            wanted = sorted(rows["key"])
            near = table.to_table(filter=(ds.field("last_key") >= wanted[0]) & (ds.field("first_key") <= wanted[-1]))
            entries = list(zip(*(near[c].to_pylist() for c in ("first_key", "last_key", "file", "offset", "length"))))
            directory, out = BlockDirectory(entries), []
            for key in wanted:
                before = len(out)
                for entry in directory.blocks_for(key):
                    if cached[0] != entry:
                        name, offset, length = entry[2:]
                        if name not in opened:
                            opened[name] = fs.open_input_file(f"{at}/{name}")
                        cached = (entry, *block_lines_of(opened[name].read_at(length, offset)))
                    i = bisect.bisect_left(cached[1], key)
                    while i < len(cached[1]) and cached[1][i] == key:
                        out.append((key, *cached[2][i]))
                        i += 1
                if must_exist and len(out) == before:
                    raise KeyError(f"no capture of {key}")
            yield pd.DataFrame(out, columns=["key", "file", "offset", "length"])
        for f in opened.values():
            f.close()

    schema = "key string, file string, offset long, length long"
    if root is None:
        return spark.createDataFrame([], schema)
    spread = keys.select("key").repartitionByRange("key").sortWithinPartitions("key")
    return spread.mapInPandas(find, schema)


def read_records(folder: str, places: DataFrame, fields: str, of_record) -> DataFrame:
    """Range-read the records at ``places`` (file, offset, length); ``of_record(headers, payload)`` gives a row of ``fields``.

    Places are dealt by file and stretch, so a task reads few files, forwards, in ranges joined up to a bounded read-ahead.
    """
    stretch = F.floor(F.col("offset") / (8 * READ_AHEAD))
    dealt = places.select("file", "offset", "length").repartition("file", stretch).sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = open_folder(folder)
        name, source, start, data = None, None, 0, b""
        for rows in batches:
            out = []
            ends = (rows["offset"] + rows["length"]).to_numpy()
            files = rows["file"].to_numpy()
            for i, (file, offset, length) in enumerate(rows.itertuples(index=False, name=None)):
                if file != name:
                    if source:
                        source.close()
                    name, source, data = file, fs.open_input_file(f"{root}/{file}"), b""
                if offset < start or offset + length > start + len(data):
                    j = i  # one read for the neighbours that follow
                    while j + 1 < len(rows) and files[j + 1] == file and ends[j + 1] - offset <= READ_AHEAD:
                        j += 1
                    start, data = offset, source.read_at(int(max(ends[i], ends[j]) - offset), offset)
                out.append(of_record(*parse_record(_unzip(data[offset - start : offset - start + length]))))
            yield pd.DataFrame({n: pd.array([r[i] for r in out], "Int64" if k == "long" else object) for i, (n, k) in enumerate(kinds)})
        if source:
            source.close()

    kinds = [f.strip().split(" ") for f in fields.split(",")]
    return dealt.mapInPandas(read, fields)


def page_row(headers: dict[str, str], payload: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record; a response's payload is checked."""
    digest, n = headers["WARC-Payload-Digest"].partition(":")[2], int(headers["WARC-X-Payload-Length"])
    kind, page, first = headers["WARC-Type"], headers["WARC-X-Page-ID"], headers.get("WARC-X-Refers-To-Page-ID")
    if kind == "response":
        if len(payload) != n or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"record of page {page} is damaged")
    return (None if page == "-" else int(page), n, digest, kind, None if first is None else int(first))


PAGE_FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def archive_round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Write ``pages`` as archives, look every page up in the capture index, and read its record back."""
    archive = write_archives(pages, **columns)
    page_id, url = columns.get("page_id", "page_id"), columns.get("url", "url")

    @F.pandas_udf("string")
    def key(urls: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([capture_key(u, None if i == "" else i) for u, i in zip(urls, ids)], dtype=object)

    named = key(quoted(url), F.coalesce(quoted(page_id).cast("long").cast("string"), F.lit("")))
    places = stored(lookup(archive, pages.select(named.alias("key")).distinct(), must_exist=True), "places")
    return read_records(archive.folder, places, PAGE_FIELDS, page_row)


def open_archive(spark: SparkSession, folder: str, captures: str, directory: str) -> Archive:
    """An archive written earlier, by its folder and the folders of its two tables."""
    return Archive(folder, spark.read.parquet(captures), spark.read.parquet(directory))
