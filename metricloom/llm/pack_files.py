"""Token ids packed into binary files: best-fit-decreasing per block of documents, no shuffle."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import open_folder, quoted, stored
from metricloom.llm.local_search import best_fit_decreasing
from metricloom.llm.tokens import CAPACITY, END_ID, VOCABULARY, cuts, token_ids
from metricloom.session import new_work_folder

BLOCK_TOKENS = 8 * 1024**2
PAD_ID = 0

_PIECE = "key string, piece long, start long, length long, block string, row long, offset long"


def write_block(fs, root: str, name: str, ids: list[np.ndarray], bin_of: np.ndarray, capacity: int, dtype: str) -> np.ndarray:
    """Write one block and return each piece's offset in its row.

    ``NAME.ids``: the id matrix, rows of ``capacity``, padded. ``NAME.segments``: uint32 cumulative
    segment lengths of all rows, each row from 0 to its fill. ``NAME.resets``: uint32 places, counted
    over the whole matrix, where positions start again from 0 (the start of every segment).
    ``NAME.json``: shape, type and where each row's segments begin.
    """
    rows = int(bin_of.max()) + 1
    matrix = np.full((rows, capacity), PAD_ID, dtype)
    fill = np.zeros(rows, np.int64)
    segments: list[list[int]] = [[0] for _ in range(rows)]
    offset = np.zeros(len(ids), np.int64)
    for i, r in enumerate(bin_of.tolist()):
        a, b = fill[r], fill[r] + len(ids[i])
        matrix[r, a:b], offset[i], fill[r] = ids[i], a, b
        segments[r].append(int(b))
    flat = np.array([x for s in segments for x in s], "<u4")
    begins = np.cumsum([0, *map(len, segments)]).tolist()
    resets = np.array([r * capacity + x for r, s in enumerate(segments) for x in s[:-1]], "<u8")
    about = {"rows": rows, "capacity": capacity, "dtype": dtype, "pad": PAD_ID, "segments": begins}
    for ending, data in (("ids", matrix.tobytes()), ("segments", flat.tobytes()), ("resets", resets.tobytes()), ("json", json.dumps(about).encode())):
        with fs.open_output_stream(f"{root}/{name}.{ending}", compression=None) as out:
            out.write(data)
    return offset


class PackedBlock:
    """A block read back: ``matrix``, and per row its cumulative segment lengths and position ids."""

    def __init__(self, fs, root: str, name: str):
        def read(ending: str) -> bytes:
            with fs.open_input_file(f"{root}/{name}.{ending}") as f:
                return f.read()

        about = json.loads(read("json"))
        self.capacity = about["capacity"]
        self.matrix = np.frombuffer(read("ids"), about["dtype"]).reshape(about["rows"], about["capacity"])
        self._segments, self._begins = np.frombuffer(read("segments"), "<u4"), about["segments"]
        self.resets = np.frombuffer(read("resets"), "<u8")

    def segments(self, row: int) -> np.ndarray:
        return self._segments[self._begins[row] : self._begins[row + 1]]

    def position_ids(self) -> np.ndarray:
        """Positions of the whole matrix: they count up from every reset, padding goes on from the last segment."""
        places = np.arange(self.matrix.size, dtype=np.int64)
        start = np.zeros(self.matrix.size, np.int64)
        start[self.resets.astype(np.int64)] = self.resets.astype(np.int64)
        return (places - np.maximum.accumulate(start)).reshape(self.matrix.shape)


def write_packed(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
    block_tokens: int = BLOCK_TOKENS,
    dtype: str = "<u2",
    folder: str | None = None,
) -> tuple[str, DataFrame]:
    """(folder, stored manifest of pieces): packed binary blocks of all documents.

    A task packs the documents of its input in blocks of about ``block_tokens`` tokens, so memory is
    bounded and texts and ids never move; a block leaves one or few rows that are not full. Overlong
    documents are cut without loss. Files are named afresh by every attempt and count only when the
    manifest names them. Null and empty texts are the end id alone; a null key stays null. ``dtype``
    must hold the vocabulary (two bytes do for 65,536 ids).
    """
    folder = folder or new_work_folder(docs.sparkSession, "packed")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = open_folder(folder)
        fs.create_dir(root, recursive=True)
        ids: list[np.ndarray] = []
        places: list[tuple] = []
        held = 0

        def flush() -> pd.DataFrame:
            nonlocal ids, places, held
            name = uuid.uuid4().hex
            bin_of = best_fit_decreasing([len(x) for x in ids], capacity)
            offset = write_block(fs, root, name, ids, bin_of, capacity, dtype)
            out = pd.DataFrame(places, columns=["key", "piece", "start", "length"]).assign(block=name, row=bin_of, offset=offset)
            ids, places, held = [], [], 0
            return out

        for rows in batches:
            for k, t in zip(rows["key"], rows["text"]):
                whole = token_ids(t, vocabulary, end_id)
                starts = cuts(len(whole), capacity)
                for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(whole)])):
                    ids.append(whole[a:b].astype(dtype))
                    places.append((k, i, a, b - a))
                held += len(whole)
                if held >= block_tokens:
                    yield flush()
        if ids:
            yield flush()

    named = docs.select(quoted(key).cast("string").alias("key"), quoted(text).alias("text"))
    return folder, stored(named.mapInPandas(write, _PIECE), "manifest")


def read_packed(folder: str, manifest: DataFrame) -> DataFrame:
    """``manifest`` with ``ids_crc32``, from the files: each piece's ids must be a segment that starts where positions reset.

    Only the block names move; the pieces of a block come from its own files.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = open_folder(folder)
        name, block, resets = None, None, set()
        for rows in batches:
            crc = []
            for b, r, a, n in rows[["block", "row", "offset", "length"]].itertuples(index=False, name=None):
                if b != name:
                    name, block = b, PackedBlock(fs, root, b)
                    resets = set(block.resets.tolist())
                cu = block.segments(r)
                at = int(np.searchsorted(cu, a))
                if cu[at] != a or cu[at + 1] != a + n or r * block.capacity + a not in resets:
                    raise ValueError(f"block {b}, row {r}: no segment at {a}")
                crc.append(zlib.crc32(block.matrix[r, a : a + n].astype("<u4").tobytes()))
            yield rows.assign(ids_crc32=crc)

    dealt = manifest.repartition("block").sortWithinPartitions("block", "row", "offset")
    return dealt.mapInPandas(read, _PIECE + ", ids_crc32 long")


def packed_round_trip(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) as read back from the packed files.

    ``sequence_id`` is the block's name and the row in it.
    """
    found = read_packed(*write_packed(docs, key, **options))
    kind = docs.schema[key].dataType.simpleString()
    return found.select(
        F.col("key").cast(kind).alias(key), "piece", "start", "length", "ids_crc32",
        F.concat_ws(":", "block", "row").alias("sequence_id"), "offset",
    )
