"""Near-duplicate vectors by NN-descent: a neighbour graph refined through neighbours of neighbours.

Equal vectors are one node. Every node starts with the nearest of the nodes next to it in a few random-projection
orders. In each round a node brings the nodes it points to and those that point to it together, and pairs
closer than what they have enter their lists; only pairs with a new entry are looked at. Nodes that many point to
do this in blocks, so no task gets more than a few dozen nodes at a time and no node is left out.

Edges that reach the threshold in double precision link nodes into components. A node whose whole list links is
saturated: more may be hidden behind it. Its list is then enlarged by its whole component, of which it keeps the
membership instead of the pairs, and its places go to the nearest nodes outside; old neighbours stay as
guides. A bounded sample of nodes is compared with all nodes after each phase, and the search goes on, with longer
lists, until no component grows and the audited share of links inside components is high enough.

Links are counted last, inside each component: members within half the threshold angle of its centre link with each
other, the rest are compared with all members in tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import quoted, stored
from metricloom.llm.jaccard import components

THRESHOLD = 0.95
NEIGHBOURS = 12
TREES = 4
LEAF = 256
BITS = 32
ROUNDS = 8
PHASES = 4
REVERSE_BLOCK = 24
AUDIT_NODES = 1024
MIN_RECALL = 0.99
TILE = 4096
#: Error of float32 products allowed for before the test in double precision.
SLACK = 1e-5

ENTRY = "node long, near array<long>, sim array<float>"


def directions(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, unit): one row per id; ``unit`` is null where a vector is null, empty, zero or holds a null or non-finite component.

    If an id comes with several vectors, the smallest usable one stands for it. Vectors are divided by their
    largest component, so that no square overflows, and by their length.
    """
    v = quoted(embedding).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1.7976931348623157e308)) | ~F.exists(v, lambda x: x != 0)
    rows = vectors.select(quoted(vec_id).cast("long").alias("vec_id"), F.when(~bad, v).alias("v")).where("vec_id IS NOT NULL")

    @F.pandas_udf("array<double>")
    def unit(vectors: pd.Series) -> pd.Series:
        out = []
        for v in vectors:
            if v is not None:
                v = v / np.abs(v).max()
                v = v / np.sqrt(v @ v)
            out.append(v)
        return pd.Series(out, index=vectors.index, dtype=object)

    one = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    return one.select("vec_id", unit("v").alias("unit"))


def _floats(cells: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.float32).reshape(len(cells), -1)


def _lists(node: np.ndarray, near: np.ndarray, sim: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` best distinct neighbours of every node, one row each."""
    order = np.lexsort((near, -sim, node))
    node, near, sim = node[order], near[order], sim[order]
    again = np.zeros(len(node), bool)
    by_pair = np.lexsort((near, node))
    again[by_pair[1:]] = (node[by_pair[1:]] == node[by_pair[:-1]]) & (near[by_pair[1:]] == near[by_pair[:-1]])
    node, near, sim = node[~again], near[~again], sim[~again]
    keep = np.arange(len(node)) - np.searchsorted(node, node) < k
    node, near, sim = node[keep], near[keep], sim[keep]
    begin = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.empty(0, np.int64)
    lists = {c: pd.Series(np.split(v, begin[1:]) if len(node) else [], dtype=object) for c, v in (("near", near), ("sim", sim))}
    return pd.DataFrame({"node": node[begin], **lists})


def neighbours_in_order(graph: DataFrame, trees: int, k: int, seed: int) -> DataFrame:
    """(node, near, sim): nearest nodes of other components among those close by in random-projection orders.

    A code has one bit per random plane; nodes in order of their codes are taken ``LEAF`` at a time. The order is
    cut by ranges, so a code that many nodes share is spread over tasks.
    """

    @F.pandas_udf("array<long>")
    def codes(units: pd.Series, dims: pd.Series) -> pd.Series:
        out = np.empty((len(units), trees), np.int64)
        for dim in dims.unique():
            at = np.flatnonzero(dims == dim)
            x = _floats(units.iloc[at])
            for t in range(trees):
                planes = np.random.default_rng([seed, t, int(dim)]).normal(size=(BITS, int(dim))).astype(np.float32)
                out[at, t] = ((x @ planes.T) > 0) @ (np.int64(1) << np.arange(BITS, dtype=np.int64)[::-1])
        return pd.Series(list(out), dtype=object)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            place = batch[["tree", "dim"]].to_numpy()
            begin = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]).any(axis=1)]) if len(batch) else []
            for lo, hi in zip(begin, np.r_[begin[1:], len(batch)].astype(int)):
                for a in range(lo, hi, LEAF):
                    rows = batch.iloc[a : min(a + LEAF, hi)]
                    ids, part, x = rows["node"].to_numpy(), rows["part"].to_numpy(), _floats(rows["unit"])
                    s = np.where(part[:, None] != part, x @ x.T, np.float32(-2))
                    m = min(k, len(ids))
                    top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                    row, col = np.repeat(np.arange(len(ids)), m), top.ravel()
                    fit = s[row, col] > -2
                    yield _lists(ids[row[fit]], ids[col[fit]], s[row, col][fit], k)

    coded = graph.select("node", "dim", "part", "unit", F.posexplode(codes.asNondeterministic()("unit", "dim")).alias("tree", "code"))
    order = ["tree", "dim", "code", F.xxhash64("node", F.lit(seed)).alias("salt")]
    spread = coded.select("node", "part", "unit", *order).repartitionByRange("tree", "dim", "code", "salt").sortWithinPartitions("tree", "dim", "code", "salt")
    return spread.mapInPandas(best, ENTRY)


def _meetings(graph: DataFrame, seed: int) -> DataFrame:
    """(v, block, member, fresh): who meets at each node; a block holds all it points to and some that point to it."""
    ahead = graph.select(F.col("node").alias("v"), F.explode(F.arrays_zip("near", "fresh")).alias("e")).select("v", F.col("e.near").alias("member"), F.col("e.fresh").alias("fresh"))
    ahead = ahead.unionByName(graph.select(F.col("node").alias("v"), F.explode("guides").alias("member"), F.lit(False).alias("fresh")))
    back = ahead.select(F.col("member").alias("v"), F.col("v").alias("member"), "fresh")
    every = ahead.withColumn("ahead", F.lit(True)).unionByName(back.withColumn("ahead", F.lit(False)))
    blocks = F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("ahead"), 0).otherwise(1)) / REVERSE_BLOCK)).cast("long")
    size = every.groupBy("v").agg(blocks.alias("blocks"), F.max("fresh").alias("any")).where("any").drop("any")
    own = F.array(F.pmod(F.xxhash64("member", F.lit(seed)), "blocks"))
    at = F.when(F.col("ahead"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(own)
    return every.join(size, "v").select("v", F.explode(at).alias("block"), "member", "fresh")


def _introduced(ids: np.ndarray, part: np.ndarray, fresh: np.ndarray, least: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, near, sim) of the pairs at one meeting that are closer than what the first has."""
    s = x @ x.T
    row, col = np.nonzero((part[:, None] != part) & (fresh[:, None] | fresh) & (s > least[:, None]))
    return ids[row], ids[col], s[row, col]


def neighbours_of_neighbours(graph: DataFrame, k: int, seed: int) -> DataFrame:
    """(node, near, sim): better neighbours met at a common one."""
    known = graph.select(F.col("node").alias("member"), "dim", "part", "unit", F.when(F.size("sim") >= k, F.array_min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("least"))
    met = _meetings(graph, seed).join(known, "member").repartition("v", "block").sortWithinPartitions("v", "block", "member", F.desc("fresh"))

    def introduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = (batch["v"] == batch["v"].iloc[-1]) & (batch["block"] == batch["block"].iloc[-1])
            rest, whole = batch[last], batch[~last]
            if len(whole):
                yield pairs_of(whole)
        if rest is not None and len(rest):
            yield pairs_of(rest)

    def pairs_of(rows: pd.DataFrame) -> pd.DataFrame:
        key = rows[["v", "block", "member"]].to_numpy()
        rows = rows[np.r_[True, (key[1:] != key[:-1]).any(axis=1)]]
        key = rows[["v", "block"]].to_numpy()
        begin = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        ids, part, fresh, least = (rows[c].to_numpy() for c in ("member", "part", "fresh", "least"))
        dims = rows["dim"].to_numpy()
        found = []
        units = rows["unit"].to_numpy()
        for lo, hi in zip(begin, np.r_[begin[1:], len(rows)]):
            x = np.frombuffer(b"".join(units[lo:hi]), np.float32).reshape(hi - lo, dims[lo])
            found.append(_introduced(ids[lo:hi], part[lo:hi], fresh[lo:hi], least[lo:hi], x))
        return _lists(*(np.concatenate(c) for c in zip(*found)), k)

    return met.mapInPandas(introduce, ENTRY)


def merged(graph: DataFrame, found: DataFrame, k: int, label: str) -> DataFrame:
    """The graph with the ``k`` best of old and found neighbours; entries that were not there before are fresh."""
    new = found.groupBy("node").agg(F.collect_list(F.struct("near", "sim")).alias("found"))
    rows = graph.join(new, "node", "left")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near, sim, fresh = [], [], []
            for old, old_sim, lists in zip(batch["near"], batch["sim"], batch["found"]):
                if lists is None or not len(lists):
                    near.append(old), sim.append(old_sim), fresh.append(np.zeros(len(old), bool))
                    continue
                ids = np.concatenate([old, *(e["near"] for e in lists)]).astype(np.int64)
                s = np.concatenate([old_sim, *(e["sim"] for e in lists)]).astype(np.float32)
                ids, first = np.unique(ids, return_index=True)  # the first of equal ids: an old entry, if there is one
                best = np.lexsort((ids, -s[first]))[:k]
                near.append(ids[best]), sim.append(s[first][best]), fresh.append(first[best] >= len(old))
            lists = {c: pd.Series(v, index=batch.index, dtype=object) for c, v in (("near", near), ("sim", sim), ("fresh", fresh))}
            yield batch.drop(columns="found").assign(**lists)

    columns = ["node", "dim", "part", "unit", "guides", "near", "sim", "fresh"]
    schema = "node long, dim int, part long, unit binary, guides array<long>, near array<long>, sim array<float>, fresh array<boolean>"
    return stored(rows.select(*columns, "found").mapInPandas(merge, schema), label)


def _linking(graph: DataFrame, threshold: float) -> DataFrame:
    """(a, b): list entries that may reach the threshold, once each."""
    entries = graph.select("node", F.explode(F.arrays_zip("near", "sim")).alias("e")).where(F.col("e.sim") >= F.lit(threshold - SLACK))
    return entries.select(F.least("node", "e.near").alias("a"), F.greatest("node", "e.near").alias("b")).distinct()


def _cosine(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda a, p: a + p)


def _checked(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose cosine in double precision reaches the threshold."""
    left, right = (nodes.select(F.col("node").alias(c), F.col("direction").alias(f"d_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").where(_cosine("d_a", "d_b") >= threshold).select("a", "b")


def audit(nodes: DataFrame, parts: DataFrame, threshold: float, sample: int = AUDIT_NODES) -> tuple[int, int]:
    """(links, inside): links of a bounded sample of nodes, found by comparing it with all nodes, and those within one component."""
    rows = nodes.join(parts, "node").select("node", "dim", "part", "direction")
    asked = rows.orderBy(F.xxhash64("node", F.lit(1)), "node").limit(sample).collect()
    by_dim: dict[int, tuple] = {}
    for dim in {r["dim"] for r in asked}:
        own = [r for r in asked if r["dim"] == dim]
        by_dim[dim] = (np.array([r["node"] for r in own]), np.array([r["part"] for r in own]), np.array([r["direction"] for r in own]))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        links = inside = 0
        for batch in batches:
            for dim, (node, part, x) in by_dim.items():
                there = batch[batch["dim"] == dim]
                for lo in range(0, len(there), 4096):
                    some = there.iloc[lo : lo + 4096]
                    near = (x @ np.stack(some["direction"].to_numpy()).T >= threshold) & (node[:, None] != some["node"].to_numpy())
                    links += int(near.sum())
                    inside += int((near & (part[:, None] == some["part"].to_numpy())).sum())
        yield pd.DataFrame({"links": [links], "inside": [inside]})

    found = rows.mapInPandas(compare, "links long, inside long").agg(F.sum("links"), F.sum("inside")).first()
    return found[0] or 0, found[1] or 0


def linked_components(nodes: DataFrame, threshold: float = THRESHOLD, k: int = NEIGHBOURS, trees: int = TREES, min_recall: float = MIN_RECALL) -> tuple[DataFrame, float]:
    """(node, part) of all ``nodes`` (node, dim, direction), and the audited recall.

    Phases of descent go on until no node is saturated behind a component that still grows and the audit is content,
    ``PHASES`` at most; the recall says what was reached.
    """

    @F.pandas_udf("binary")
    def packed(vectors: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, np.float32).tobytes() for v in vectors], dtype=object)

    empty = {"guides": "array<long>", "near": "array<long>", "sim": "array<float>", "fresh": "array<boolean>"}
    graph = nodes.select("node", "dim", F.col("node").alias("part"), packed("direction").alias("unit"), *(F.array().cast(t).alias(c) for c, t in empty.items()))
    graph = stored(graph, "descent-nodes")
    links, parts, recall = None, graph.select("node", "part"), 1.0
    for phase in range(PHASES):
        graph = merged(graph, neighbours_in_order(graph, trees, k, phase), k, "descent-order")
        reached = -1
        for turn in range(ROUNDS):
            graph = merged(graph, neighbours_of_neighbours(graph, k, phase * ROUNDS + turn), k, "descent-round")
            now = graph.agg(F.sum(F.size(F.filter("sim", lambda x: x >= F.lit(threshold - SLACK))))).first()[0] or 0
            if now == reached:
                break
            reached = now
        new = stored(_checked(_linking(graph, threshold), nodes, threshold), "descent-links")
        grown = not new.isEmpty()
        if grown:
            links = new if links is None else links.unionByName(new)
            named = components(links)
            parts = graph.select("node").join(named, "node", "left").select("node", F.coalesce("component", "node").alias("part"))
            parts = stored(parts, "descent-parts")
        seen, inside = audit(nodes, parts, threshold)
        recall = inside / seen if seen else 1.0
        saturated = graph.where((F.size("near") >= k) & (F.array_min("sim") >= F.lit(threshold))).select("node")
        if recall >= min_recall and (not grown or saturated.isEmpty()):
            break
        graph = _outside(graph, parts)
        if recall < min_recall:
            k, trees = k * 3 // 2, trees * 2
    return parts, recall


def _outside(graph: DataFrame, parts: DataFrame) -> DataFrame:
    """The graph for the next phase: components as known now, entries within them become guides."""
    far = parts.select(F.col("node").alias("near"), F.col("part").alias("other"))
    rows = graph.drop("part").join(parts, "node")
    entries = rows.select("node", "part", F.explode(F.arrays_zip("near", "sim")).alias("e")).select("node", "part", "e.near", "e.sim").join(far, "near")
    inside, struct = F.col("part") == F.col("other"), F.struct((-F.col("sim")).alias("s"), "near")
    lists = entries.groupBy("node").agg(
        F.array_sort(F.collect_list(F.when(~inside, struct))).alias("out"), F.array_sort(F.collect_list(F.when(inside, F.col("near")))).alias("in")
    )
    joined = rows.select("node", "dim", "part", "unit").join(lists, "node", "left")
    none = F.array().cast("array<long>")
    near = F.coalesce(F.transform("out", lambda e: e["near"]), none)
    sim = F.coalesce(F.transform("out", lambda e: (-e["s"]).cast("float")), F.array().cast("array<float>"))
    guides = F.coalesce(F.col("in"), none)
    return stored(joined.select("node", "dim", "part", "unit", guides.alias("guides"), near.alias("near"), sim.alias("sim"), F.transform(near, lambda x: F.lit(False)).alias("fresh")), "descent-outside")


def count_links(nodes: DataFrame, parts: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(node, links): vectors linked with those of each node in its component, its own copies left out.

    ``nodes`` has (node, dim, direction, copies). Members within half the threshold angle of the component's centre link with each
    other, so their number is enough; the others meet all members in tiles of ``tile`` rows.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    sized = parts.groupBy("part").agg(F.count("*").alias("members")).where("members > 1")
    rows = nodes.join(parts.join(sized, "part"), "node")
    centres = rows.groupBy("part").agg(vector_to_array(Summarizer.mean(array_to_vector("direction"))).alias("centre"))
    length = F.sqrt(_cosine("centre", "centre"))
    half = float(np.cos(np.arccos(threshold) / 2)) + 1e-9
    near = F.coalesce(_cosine("direction", "centre") >= F.lit(half) * length, F.lit(False)) & (length > 1e-9)
    rows = stored(rows.join(centres, "part").select("part", "node", "dim", "copies", "direction", "members", near.alias("core")), "descent-members")
    core = rows.where("core").groupBy("part").agg(F.sum("copies").alias("all"))
    within = rows.where("core").join(core, "part").select("node", (F.col("all") - F.col("copies")).alias("links"))

    outer = rows.where("NOT core").groupBy("part").agg(F.count("*").alias("outer"))
    rows = rows.join(outer, "part").withColumns({"i_s": F.ceil(F.col("outer") / tile), "j_s": F.ceil(F.col("members") / tile)})
    payload = ["node", "core", "copies", "direction"]
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = rows.where("NOT core").select("part", F.pmod(F.xxhash64("node"), "i_s").alias("i"), spread("j_s").alias("j"), *payload)
    there = rows.select("part", spread("i_s").alias("i"), F.pmod(F.xxhash64("node"), "j_s").alias("j"), *payload)

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"node": np.empty(0, np.int64), "links": np.empty(0, np.int64)})
        x, y = (np.stack(r["direction"].to_numpy()) for r in (left, right))
        a, b = left["node"].to_numpy(), right["node"].to_numpy()
        there, inner = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        for lo in range(0, len(a), 512):
            linked = (x[lo : lo + 512] @ y.T >= threshold) & (a[lo : lo + 512, None] != b)
            there[lo : lo + 512] = linked @ right["copies"].to_numpy()
            inner += left["copies"].to_numpy()[lo : lo + 512] @ linked
        inner[~right["core"].to_numpy()] = 0  # these ask themselves
        out = pd.DataFrame({"node": np.r_[a, b], "links": np.r_[there, inner]})
        return out[out["links"] > 0]

    place = ["part", "i", "j"]
    there = there.select(*(F.col(c).alias(c) for c in there.columns))  # columns of its own, as both sides come from one table
    across = asked.groupBy(*place).cogroup(there.groupBy(*place)).applyInPandas(compare, "node long, links long")
    return within.unionByName(across).groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", k: int = NEIGHBOURS, min_recall: float = MIN_RECALL
) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audited_recall), one row per id.

    Vectors link when their cosine is ``threshold`` or more; ``component_id`` is the smallest id reachable by links,
    ``kept`` says that it is the row's own. Vectors meet those of their own length only. Null, empty and zero vectors
    and those with a null or non-finite component link with nothing. Repeated rows count once; see :func:`directions` for ids
    with several vectors. Rows without an id are left out. ``audited_recall`` is the share of the links of a sample
    that lie within components, the same in all rows.
    """
    one = stored(directions(vectors, vec_id, embedding), "descent-vectors")
    classes = one.where("unit IS NOT NULL").groupBy("unit").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    nodes = stored(classes.select("node", "copies", F.size("unit").alias("dim"), F.col("unit").alias("direction")), "descent-classes")
    parts, recall = linked_components(nodes, threshold, k, min_recall=min_recall)
    links = count_links(nodes, parts, threshold)
    told = nodes.join(parts, "node").join(links, "node", "left")
    told = told.select("direction", "part", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows = one.join(told, one["unit"] == told["direction"], "left")
    found = F.coalesce("part", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), found.alias("component_id"), (found == F.col("vec_id")).alias("kept"), F.lit(recall).alias("audited_recall"))
