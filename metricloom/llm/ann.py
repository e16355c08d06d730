"""Approximate nearest neighbours by inner product: one robust-pruned graph per shard, beam search on each."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.common import quoted, stored
from metricloom.llm.graph import BEAM, DEGREE, beam_search, build, levelled

SHARD_ROWS = 8192
BLOCK_QUERIES = 8192
SEARCH_BEAM = 96


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v, dim) of the vectors that take part: not null, not zero, all components finite, with an id."""
    v = quoted(embedding).cast("array<double>")
    # NaN is the largest double to Spark, so one comparison finds it and infinity.
    bad = F.exists("v", lambda x: x.isNull() | (F.abs(x) > 1.7976931348623157e308))
    return (
        vectors.select(quoted(vec_id).cast("long").alias("vec_id"), v.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .where(~bad & F.exists("v", lambda x: x != 0))
        .withColumn("dim", F.size("v"))
    )


def build_index(points: DataFrame, keep_ids: int, shard_rows: int = SHARD_ROWS, degree: int = DEGREE, beam: int = BEAM) -> DataFrame:
    """The stored graph: one row per distinct vector with its shard, place, neighbours and ids.

    Equal vectors are one node. As ties go to the smaller id, a node needs its ``keep_ids``
    smallest ids only; no other can be among that many nearest. Shards are hashed and hold about
    ``shard_rows`` vectors, so a task builds a graph of bounded size. Vectors meet only vectors of
    their own length.
    """
    same = Window.partitionBy("v").orderBy("vec_id")
    ranked = points.distinct().withColumn("r", F.row_number().over(same)).where(F.col("r") <= keep_ids)
    nodes = stored(ranked.groupBy("v", "dim").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "ann-nodes")
    shards = max(1, -(-nodes.count() // shard_rows))
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)))

    def graph_of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.iloc[np.argsort([i[0] for i in rows["ids"]], kind="stable")]  # any order of arrival gives the same graph
        points = levelled(np.stack(rows["v"].to_numpy()))
        graph, starts = build(points, degree, beam)
        begins = np.isin(np.arange(len(rows)), starts)
        return rows.assign(place=np.arange(len(rows), dtype=np.int64), begins=begins, near=[g[g >= 0] for g in graph])[
            ["dim", "shard", "place", "begins", "ids", "v", "near"]
        ]

    schema = "dim int, shard long, place long, begins boolean, ids array<long>, v array<double>, near array<long>"
    # One partition per shard: the rows are few, the work is not, so they must not be merged by size.
    dealt = nodes.select("dim", "shard", "ids", "v").repartition(shards, "dim", "shard")
    return stored(dealt.groupBy("dim", "shard").applyInPandas(graph_of, schema), "ann-graph")


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM, block: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, vec_id, score) of the ``k`` nearest per shard, for ``queries`` (vec_id, v, dim).

    Queries go in hashed blocks to every shard of their length; a task holds one shard and one block.
    A query never finds its own id. Scores are inner products of the given vectors in double precision.
    """
    blocks = max(1, -(-queries.count() // block))
    shards = index.select("dim", "shard").distinct().groupBy("dim").agg(F.collect_list("shard").alias("shards"))
    asked = queries.join(shards, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    asked = asked.select("dim", F.explode("shards").alias("shard"), "block", F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    copies = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def nearest(nodes: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        if nodes.empty or asked.empty:
            return empty
        nodes = nodes.sort_values("place")
        exact = np.stack(nodes["v"].to_numpy())
        points = levelled(exact)
        graph = np.full((len(nodes), max(1, max(map(len, nodes["near"])))), -1, np.int64)
        for i, near in enumerate(nodes["near"]):
            graph[i, : len(near)] = near
        starts = np.flatnonzero(nodes["begins"].to_numpy())
        ids, many = nodes["ids"].to_numpy(), np.array([len(i) for i in nodes["ids"]])
        parts = []
        for lo in range(0, len(asked), 512):
            names = asked["query_id"].to_numpy()[lo : lo + 512]
            q = np.stack(asked["q"].to_numpy()[lo : lo + 512])
            length = np.sqrt((q**2).sum(1, keepdims=True))
            unit = np.column_stack([q / length, np.zeros(len(q))]).astype(np.float32)
            found, _ = beam_search(points, graph, starts, unit, max(beam, k + 1))
            row, col = np.nonzero(found >= 0)
            node = found[row, col]
            score = np.einsum("ij,ij->i", q[row], exact[node])
            repeat = many[node]
            out = pd.DataFrame({"query_id": np.repeat(names[row], repeat), "vec_id": np.concatenate([ids[x] for x in node]), "score": np.repeat(score, repeat)})
            out = out[out["query_id"] != out["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
            parts.append(out.groupby("query_id", sort=False).head(k))
        return pd.concat(parts, ignore_index=True) if parts else empty

    tasks, place = blocks * max(1, index.select("dim", "shard").distinct().count()), ["dim", "shard", "block"]
    return (
        copies.repartition(tasks, *place)
        .groupBy(*place)
        .cogroup(asked.repartition(tasks, *place).groupBy(*place))
        .applyInPandas(nearest, "query_id long, vec_id long, score double")
    )


def nearest_neighbours(
    vectors: DataFrame,
    asks: Column,
    k: int = 20,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    beam: int = SEARCH_BEAM,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for every row where ``asks`` holds.

    ``asks`` is a condition on ``vec_id``. Every usable row is indexed (see :func:`usable`: null, zero and
    non-finite vectors neither ask nor answer). A row that repeats id and vector counts once; an id with
    several vectors keeps all of them as candidates and asks with each, the better result counting. Equal
    scores rank by smaller id. Fewer candidates than ``k`` give all of them.
    """
    points = stored(usable(vectors, vec_id, embedding), "ann-points")
    index = build_index(points, k + 1, shard_rows)
    queries = points.where(asks).distinct()
    found = search(index, queries, k, beam).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
