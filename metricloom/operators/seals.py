"""Sealed audit logs: a hash tree over the segments of each log.

A chain shows edits inside a segment, but a segment that is gone, a tail that was cut off and segments
that changed places leave every chain whole. A seal is taken when segments are complete and kept away
from the log: each segment gives a leaf (head and line count), ``FAN_OUT`` neighbours a node one level up,
and the only node of the top level is the root. Who keeps the root alone can check the leaves,
and with the path of one segment that segment, without reading the rest.

Every level is a plain aggregate over at most ``FAN_OUT`` children. The depth is fixed, so the tree of a
log does not depend on how long other logs are, and nothing is counted on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.operators.audit import SEPARATOR, segment_heads

FAN_OUT = 64
#: 64 ** 5 is a billion segments of a log.
DEPTH = 5

# What a check reports.
MISSING = "Segment missing"
UNKNOWN = "Segment not sealed"
LINES = "Line count differs from seal"
HEAD = "Segment head differs from seal"
MOVED = "Segment moved"
ROOT = "Seal does not match root"


def leaf_hash(segment: Column, head: Column, lines: Column) -> Column:
    return F.sha2(F.concat_ws(SEPARATOR, F.lit("leaf"), segment, F.coalesce(head, F.lit("")), lines), 256)


def node_hash(level: int, unit: Column, children: Column) -> Column:
    """``children`` is ``array<struct<unit, hash>>`` in order of unit."""
    parts = F.array_join(F.transform(children, lambda c: F.concat(c["unit"], F.lit(":"), c["hash"])), SEPARATOR)
    return F.sha2(F.concat_ws(SEPARATOR, F.lit(f"node {level}"), unit, parts), 256)


def seal_leaves(chain: DataFrame) -> DataFrame:
    """(log, segment, head, lines, hash) of stored or freshly chained lines."""
    heads = segment_heads(chain)
    return heads.select(
        "log", "segment", "head", "lines", leaf_hash(F.col("segment"), F.col("head"), F.col("lines")).alias("hash")
    )


def seal_nodes(leaves: DataFrame, fan_out: int = FAN_OUT, depth: int = DEPTH) -> DataFrame:
    """All inner nodes: (log, level, unit, hash, children); level 1 stands on the leaves.

    The root of a log is its node of level ``depth``; a segment number of ``fan_out ** depth`` or more,
    or below 0, has no place in the tree and stops the job.
    """
    fits = (F.col("segment") >= 0) & (F.col("segment") < F.lit(fan_out**depth))
    unit = F.when(fits, F.col("segment")).otherwise(F.raise_error(F.lit("segment number outside the tree")))
    below = leaves.select("log", unit.cast("long").alias("unit"), "hash")
    levels = []
    for level in range(1, depth + 1):
        children = F.array_sort(F.collect_list(F.struct("unit", "hash")))
        grouped = below.groupBy("log", F.floor(F.col("unit") / fan_out).cast("long").alias("_up")).agg(
            children.alias("children")
        )
        nodes = grouped.select(
            "log",
            F.lit(level).alias("level"),
            F.col("_up").alias("unit"),
            node_hash(level, F.col("_up"), F.col("children")).alias("hash"),
            "children",
        )
        levels.append(nodes)
        below = nodes.select("log", "unit", "hash")
    return reduce(DataFrame.unionByName, levels)


def roots(leaves: DataFrame, fan_out: int = FAN_OUT, depth: int = DEPTH) -> DataFrame:
    """(log, segments, lines, root): what is kept away from the log."""
    sizes = leaves.groupBy("log").agg(F.count(F.lit(1)).alias("segments"), F.sum("lines").alias("lines"))
    top = seal_nodes(leaves, fan_out, depth).where(F.col("level") == depth)
    return sizes.join(top.select("log", F.col("hash").alias("root")), "log")


def verify_segments(
    lines: DataFrame,
    sealed: DataFrame,
    sealed_roots: DataFrame,
    fan_out: int = FAN_OUT,
    depth: int = DEPTH,
) -> DataFrame:
    """Errors of a stored log against its seal: (log, segment, error).

    ``lines`` are the stored lines (log, segment, line_no, event_hash), ``sealed`` the leaves and
    ``sealed_roots`` the roots taken when the log was sealed. Leaves that do not lead to the kept root
    give one row with a null segment; so does a log with leaves but no root, or the reverse. A moved
    segment is named with the place it was sealed at.
    """
    now = seal_leaves(lines).select(
        "log", "segment", F.col("head").alias("_head"), F.col("lines").alias("_lines"), F.lit(True).alias("_here")
    )
    # Where a head was sealed; equal heads of one log would be a collision of hashes.
    places = sealed.groupBy("log", F.col("head").alias("_head")).agg(F.min("segment").alias("_home"))
    met = (
        sealed.select("log", "segment", "head", "lines", F.lit(True).alias("_sealed"))
        .join(now, ["log", "segment"], "full")
        .join(places, ["log", "_head"], "left")
    )
    here, known = F.col("_here").isNotNull(), F.col("_sealed").isNotNull()
    moved = F.col("_home").isNotNull() & (F.col("_home") != F.col("segment"))
    wrong = F.array(
        F.when(~here, F.lit(MISSING)),
        F.when(here & ~known, F.lit(UNKNOWN)),
        F.when(here & known & ~F.col("lines").eqNullSafe(F.col("_lines")), F.lit(LINES)),
        F.when(here & known & ~moved & ~F.col("head").eqNullSafe(F.col("_head")), F.lit(HEAD)),
        F.when(here & moved, F.concat(F.lit(f"{MOVED} (sealed as "), F.col("_home"), F.lit(")"))),
    )
    errors = met.select("log", "segment", F.explode(F.array_compact(wrong)).alias("error"))

    rehashed = sealed.withColumn("hash", leaf_hash(F.col("segment"), F.col("head"), F.col("lines")))
    again = roots(rehashed, fan_out, depth)
    kept = sealed_roots.select("log", *[F.col(c).alias(f"_{c}") for c in ("segments", "lines", "root")])
    same = reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("segments", "lines", "root")]
    )
    broken = again.join(kept, "log", "full").where(~same)
    return errors.unionByName(
        broken.select("log", F.lit(None).cast("long").alias("segment"), F.lit(ROOT).alias("error"))
    )


def verify_members(
    claims: DataFrame, nodes: DataFrame, sealed_roots: DataFrame, fan_out: int = FAN_OUT, depth: int = DEPTH
) -> DataFrame:
    """Whether single segments belong to the sealed logs, by their paths: (log, segment, member).

    ``claims`` has log, segment, head and lines. Only the nodes above the claimed segments are used; each
    must hash to what its parent holds and the last to the kept root. Claims without a path are no members.
    """
    state = claims.select(
        "log",
        "segment",
        F.col("segment").cast("long").alias("_unit"),
        leaf_hash(F.col("segment"), F.col("head"), F.col("lines")).alias("_hash"),
        F.lit(True).alias("_ok"),
    )
    for level in range(1, depth + 1):
        step = nodes.where(F.col("level") == level).select("log", F.col("unit").alias("_up"), "children")
        state = state.withColumn("_up", F.floor(F.col("_unit") / fan_out).cast("long")).join(step, ["log", "_up"], "left")
        own = F.struct(F.col("_unit").alias("unit"), F.col("_hash").alias("hash"))
        held = F.coalesce(F.array_contains("children", own), F.lit(False))
        state = state.withColumn("_ok", F.col("_ok") & held).select(
            "log",
            "segment",
            F.col("_up").alias("_unit"),
            node_hash(level, F.col("_up"), F.col("children")).alias("_hash"),
            "_ok",
        )
    kept = sealed_roots.select("log", "root")
    return state.join(kept, "log", "left").select(
        "log", "segment", (F.col("_ok") & F.col("root").eqNullSafe(F.col("_hash")) & F.col("root").isNotNull()).alias("member")
    )
