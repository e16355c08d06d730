"""Hard negatives: exact integer scores by residue products, positives first, then a window of scores below each.

Rows are packed into blocks of a few thousand, integers in bytes. Anchors (a stated share of the rows) go in
chunks to every portion of the blocks; a task holds one chunk of anchors and streams its portion through it,
keeping the best so far, so what it emits depends on its anchors only. A first pass finds the positives, a
second one the best rows of other labels inside each positive's window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.common import quoted, stored
from metricloom.llm.residues import exact_products

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
LOW_PERCENT, HIGH_PERCENT = 30, 90
BLOCK_ROWS = 4096
ANCHOR_BYTES = 16_000_000
PORTION_BYTES = 128_000_000
TILE_ANCHORS = 256
#: Components beyond this are counted as this large; their scores are at the 64-bit limits anyway.
LARGEST = 2.0**62


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, v) of the rows that take part, ``v`` as long integers, one row per id.

    Rows with a null id, label or vector, an empty vector or a null or non-finite component are left out; so are
    components whose multiple by ``SCALE`` is not finite. If an id comes with several labels or vectors, the smallest
    (label, vector) stands for it.
    """
    scaled = F.transform(quoted(embedding).cast("array<double>"), lambda x: x * SCALE)
    bad = F.exists("v", lambda x: x.isNull() | (F.abs(x) > 1.7976931348623157e308))
    rows = vectors.select(quoted(vec_id).cast("long").alias("vec_id"), quoted(label).cast("long").alias("label"), scaled.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(~bad & (F.size("v") > 0))
    held = F.transform("v", lambda x: F.floor(F.least(F.greatest(x, F.lit(-LARGEST)), F.lit(LARGEST))))
    one = rows.select("vec_id", "label", held.alias("v")).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("one"))
    return one.select("vec_id", "one.label", "one.v")


def _packed_type(v: np.ndarray) -> np.dtype:
    for kind in (np.int16, np.int32):
        if not v.size or np.abs(v).max() <= np.iinfo(kind).max:
            return np.dtype(kind)
    return np.dtype(np.int64)


BLOCK_SCHEMA = "dim int, number long, width int, ids binary, labels binary, vectors binary"


def packed(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (vec_id, label, v) in blocks of one vector length: ids and labels as int64, vectors in the smallest integers that hold them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, labels = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            lists = batch.column(2)
            flat, begin = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            dims = np.diff(begin)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for lo in range(0, len(at), block_rows):
                    part = at[lo : lo + block_rows]
                    v = flat[begin[part][:, None] + np.arange(dim)].astype(np.int64)
                    kind = _packed_type(v)
                    values = [[int(dim)], [number], [kind.itemsize], [ids[part].tobytes()], [labels[part].tobytes()], [v.astype(kind).tobytes()]]
                    types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                    names = ("dim", "number", "width", "ids", "labels", "vectors")
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(values, types)], names=list(names))
                    number += 1

    return rows.select("vec_id", "label", "v").mapInArrow(pack, BLOCK_SCHEMA)


@dataclass
class Block:
    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray

    @classmethod
    def read(cls, row: dict) -> Block:
        v = np.frombuffer(row["vectors"], f"i{row['width']}").reshape(-1, row["dim"]).astype(np.int64)
        return cls(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), v)

    @classmethod
    def joined(cls, parts: list[Block]) -> Block:
        return cls(*(np.concatenate([getattr(p, name) for p in parts]) for name in ("ids", "labels", "v")))


class Best:
    """The ``k`` best (score, smaller id first) of each row met so far, in order."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.scores = np.full((rows, k), np.iinfo(np.int64).min)
        self.ids = np.full((rows, k), -1, np.int64)
        self.many = np.zeros(rows, np.int64)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """Take in ``scores`` (row x candidate) of the rows ``at`` where ``fits``."""
        full = self.many[at] == self.k
        fits = fits & (~full[:, None] | (scores >= self.scores[at, -1][:, None]))
        if fits.shape[1] > self.k:  # no more than k candidates of a row and what ties with the last of them
            least = np.partition(np.where(fits, scores, np.iinfo(np.int64).min), -self.k, axis=1)[:, -self.k]
            fits &= scores >= least[:, None]
        row, column = np.nonzero(fits)
        touched = np.unique(row)
        held = np.arange(self.k) < self.many[at[touched]][:, None]
        old_row, old_place = np.nonzero(held)
        rows = np.concatenate([row, touched[old_row]])
        values = np.concatenate([scores[row, column], self.scores[at[touched]][old_row, old_place]])
        names = np.concatenate([ids[column], self.ids[at[touched]][old_row, old_place]])
        order = np.lexsort((names, -values, rows))
        rows, values, names = rows[order], values[order], names[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        good = rank < self.k
        rows, values, names, rank = rows[good], values[good], names[good], rank[good]
        self.scores[at[rows], rank], self.ids[at[rows], rank] = values, names
        self.many[at[touched]] = np.bincount(rows, minlength=len(at))[touched]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, score, id) of all that is held."""
        row, place = np.nonzero(np.arange(self.k) < self.many[:, None])
        return row, self.scores[row, place], self.ids[row, place]


class Positives:
    """Best rows of the anchor's own label."""

    schema = "anchor_id long, vec_id long, score long"

    def __init__(self, anchors: Block, extra: pd.DataFrame, k: int):
        self.anchors, self.best = anchors, Best(len(anchors.ids), k)

    def see(self, at: np.ndarray, scores: np.ndarray, block: Block) -> None:
        own = self.anchors
        self.best.add(at, scores, block.ids, (own.labels[at][:, None] == block.labels) & (own.ids[at][:, None] != block.ids))

    def found(self) -> pd.DataFrame:
        row, score, ids = self.best.rows()
        return pd.DataFrame({"anchor_id": self.anchors.ids[row], "vec_id": ids, "score": score})


class Windows:
    """Best rows of other labels inside the window below each positive."""

    schema = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"

    def __init__(self, anchors: Block, windows: pd.DataFrame, k: int):
        self.anchors, self.windows = anchors, windows
        order = np.argsort(anchors.ids)
        self.owner = order[np.searchsorted(anchors.ids, windows["anchor_id"].to_numpy(), sorter=order)] if len(windows) else np.empty(0, np.int64)
        p = windows["positive_score"].to_numpy().astype(np.int64)
        self.low, self.high = -((-LOW_PERCENT * p) // 100), HIGH_PERCENT * p // 100
        self.by_owner = np.argsort(self.owner, kind="stable")
        self.begin = np.searchsorted(self.owner[self.by_owner], np.arange(len(anchors.ids) + 1))
        self.best = Best(len(windows), k)

    def see(self, at: np.ndarray, scores: np.ndarray, block: Block) -> None:
        other = self.anchors.labels[at][:, None] != block.labels
        many = np.diff(self.begin)[at]
        for i in range(int(many.max(initial=0))):
            has = np.flatnonzero(many > i)
            window = self.by_owner[self.begin[at[has]] + i]
            s = scores[has]
            self.best.add(window, s, block.ids, other[has] & (s >= self.low[window][:, None]) & (s <= self.high[window][:, None]))

    def found(self) -> pd.DataFrame:
        row, score, ids = self.best.rows()
        w = self.windows
        columns = {c: w[c].to_numpy()[row] for c in ("anchor_id", "positive_id", "positive_score")}
        return pd.DataFrame({**columns, "vec_id": ids, "score": score})


def _streamed(blocks: DataFrame, anchors: DataFrame, extra: DataFrame | None, keeper: Callable, k: int) -> DataFrame:
    """Stream all blocks past all anchor chunks; ``keeper`` collects for one chunk.

    ``anchors`` is packed with a column ``chunk``; ``extra`` has (dim, chunk, content): what else the keeper
    of a chunk needs. A key (dim, chunk, portion) is one unit of work: its anchors come first, then
    its blocks, one at a time.
    """
    # A chunk of anchors goes to every portion, so portions are only as many as their size or the cores ask for.
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    number, size = blocks.agg(F.count("*"), F.coalesce(F.sum(F.length("vectors")), F.lit(0))).first()
    chunks = anchors.agg(F.count_distinct("dim", "chunk")).first()[0] or 1
    portions = max(1, -(-size // PORTION_BYTES), min(number, -(-2 * cores // chunks)))
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(portions - 1).cast("long")))
    payload = ["width", "ids", "labels", "vectors"]
    first = anchors.select("dim", "chunk", spread.alias("portion"), F.lit(0).alias("kind"), *payload)
    dealt = blocks.withColumn("portion", F.pmod(F.xxhash64("number"), F.lit(portions)))
    after = dealt.join(anchors.select("dim", "chunk").distinct(), "dim").select("dim", "chunk", "portion", F.lit(2).alias("kind"), *payload)
    every = first.unionByName(after)
    if extra is not None:
        held = extra.select("dim", "chunk", spread.alias("portion"), F.lit(1).alias("kind"), F.lit(0).alias("width"), F.col("content").alias("ids"), F.lit(None).cast("binary").alias("labels"), F.lit(None).cast("binary").alias("vectors"))
        every = every.unionByName(held)
    place = ["dim", "chunk", "portion"]
    every = every.repartition(chunks * portions, *place).sortWithinPartitions(*place, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, resident, content, collected = None, [], [], None

        def start():
            return keeper(Block.joined(resident), windows_of(content), k)

        def result():
            if resident:
                yield pa.RecordBatch.from_pandas((collected or start()).found(), preserve_index=False)

        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                if (now := (row["dim"], row["chunk"], row["portion"])) != key:
                    yield from result()
                    key, resident, content, collected = now, [], [], None
                if row["kind"] == 0:
                    resident.append(Block.read(row))
                elif row["kind"] == 1:
                    content.append(row["ids"])
                else:
                    collected = collected or start()
                    block, own = Block.read(row), collected.anchors
                    for lo in range(0, len(own.ids), TILE_ANCHORS):
                        at = np.arange(lo, min(lo + TILE_ANCHORS, len(own.ids)))
                        collected.see(at, exact_products(own.v[at], block.v), block)
        yield from result()

    return every.mapInArrow(run, keeper.schema)


def windows_of(contents: list[bytes]) -> pd.DataFrame:
    """(anchor_id, positive_id, positive_score) from their bytes."""
    flat = np.frombuffer(b"".join(contents), np.int64).reshape(-1, 3)
    return pd.DataFrame(flat, columns=["anchor_id", "positive_id", "positive_score"])


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    relabel: Column | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on ``vec_id``, ``relabel`` an expression of ``vec_id`` and ``label``
    that replaces the label. Components count as floor(256 x); scores are exact integer inner
    products, higher first, ties by smaller id. An anchor's positives are its ``positives`` best other
    rows of its label; each gets the ``negatives`` best rows of other labels whose score lies between 30 and 90
    per cent of its own. Vectors meet those of their own length only. See :func:`usable` for rows that
    take no part and for repeated ids. Scores beyond +-2**55 are held there. Anchors without positives, and positives with an
    empty window (all negative scores have one), give no rows.
    """
    rows = usable(vectors, vec_id, embedding, label)
    if relabel is not None:
        rows = rows.withColumn("label", relabel.cast("long")).where(F.col("label").isNotNull())
    rows = stored(rows, "negatives-rows")
    blocks = stored(packed(rows), "negatives-blocks")
    asking = stored(packed(rows.where(anchors)), "negatives-anchors")
    chunks = max(1, -(-(asking.agg(F.sum(F.length("vectors"))).first()[0] or 0) // ANCHOR_BYTES))
    asking = asking.withColumn("chunk", F.pmod(F.xxhash64("number"), F.lit(chunks)))

    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    near = _streamed(blocks, asking, None, Positives, positives)
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    near = near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))

    @F.pandas_udf("array<long>")
    def ids_of(held: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(b, np.int64) for b in held])

    @F.pandas_udf("binary")
    def bytes_of(held: pd.Series) -> pd.Series:
        return pd.Series([np.concatenate([np.asarray([r["a"], r["p"], r["s"]], np.int64) for r in rows]).tobytes() for rows in held], dtype=object)

    where = asking.select("dim", "chunk", "number", F.explode(ids_of("ids")).alias("anchor_id"))
    windows = where.join(near, "anchor_id").groupBy("dim", "chunk", "number")
    windows = windows.agg(F.collect_list(F.struct(F.col("anchor_id").alias("a"), F.col("positive_id").alias("p"), F.col("positive_score").alias("s"))).alias("held"))
    windows = stored(windows.select("dim", "chunk", bytes_of("held").alias("content")), "negatives-windows")

    last = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    found = _streamed(blocks, asking, windows, Windows, negatives)
    found = found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
