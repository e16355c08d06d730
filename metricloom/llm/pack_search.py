"""Packing by a swap-based local search, over groups of pieces of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import quoted, stored
from metricloom.llm import local_search
from metricloom.llm.tokens import CAPACITY, VOCABULARY, pieces

GROUP_PIECES = 16_000
SEQUENCES_OF_GROUP = 1 << 20


def pack_pieces(cut: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``cut`` (key, piece, start, length, ids_crc32) with ``sequence_id`` and ``offset``.

    Pieces are dealt by a hash into groups of about ``group_pieces``; each group is packed by local search from next fit in shuffled order, or
    best-fit-decreasing where that takes fewer sequences. A group ends with one or two sequences that are not full, so a larger group wastes less. Rows, also equal
    ones, are pieces of their own.
    """
    key_type = cut.schema[key].dataType.simpleString()
    columns = [key, "piece", "start", "length", "ids_crc32"]
    groups = max(1, -(-cut.count() // group_pieces))
    dealt = cut.select(*map(quoted, columns)).withColumn("_group", F.pmod(F.xxhash64(*map(quoted, columns), F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(groups)))
    dealt = dealt.withColumn("_key", quoted(key).cast("string"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "_key", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True])
        n = rows["length"].to_numpy()
        bin_of = local_search.pack(n, capacity)
        order = np.argsort(bin_of, kind="stable")
        ends = np.cumsum(n[order])
        first = np.flatnonzero(np.r_[True, bin_of[order][1:] != bin_of[order][:-1]])
        base = np.repeat(np.r_[0, ends[first[1:] - 1]], np.diff(np.r_[first, len(n)]))
        offset = np.empty(len(n), np.int64)
        offset[order] = ends - n[order] - base
        number = rows["_group"].to_numpy() * SEQUENCES_OF_GROUP + bin_of
        return rows[["_key", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=number, offset=offset)

    schema = "_key string, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = dealt.select("_group", "_key", "piece", "start", "length", "ids_crc32").groupBy("_group").applyInPandas(pack, schema)
    return packed.select(F.col("_key").cast(key_type).alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of all documents in as few sequences as found.

    Texts are read where they lie; only the small rows of pieces move. Null and empty texts are the end
    id alone; very long ones are cut into full pieces after a shorter first one. An empty table packs
    into nothing. Other columns are not read.
    """
    return pack_pieces(stored(pieces(docs, key, text, capacity, vocabulary), "pieces"), key, capacity)
