"""Ordered work on groups of any size.

Metric series are ordered groups: ``(run_id, name)`` sorted by ``step``. A plain
``Window.partitionBy(keys).orderBy(order)`` is the best plan while every group
fits a task: one shuffle, one sort, any number of window functions. It stops
being one when a single group holds a large share of the table, because the
whole group then lands in one task.

:class:`OrderedGroups` offers the few ordered primitives the operators need
(row index, running totals, row frames, group aggregates) and picks the
physical form from a measured group profile:

* *whole* - every group is below ``hot_rows``: plain windows over one shuffle;
* *split* - some group is larger: rows are range-partitioned by (keys, order),
  so that a big group spreads over as many partitions as its size asks for;
  each partition is numbered locally and small per-partition totals carry the
  offsets over. Row frames are evaluated in fixed-length blocks of the index,
  with the few neighbour rows of a block copied into it.

Both forms give the same rows; the tests compare them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from metricloom.session import ensure_checkpoint_dir

#: A group up to this many rows is handled inside one task. Every window operator
#: buffers a whole group, and some operators stack several.
HOT_ROWS = 1_000_000
#: ``percentile`` keeps the values of a group in memory, and of many groups at a
#: time; groups beyond this many rows are ranked by (spilling) windows instead.
QUANTILE_ROWS = 200_000
#: Per-group tables up to this many rows are broadcast (a few tens of MB).
BROADCAST_GROUPS = 200_000
#: Rows of one index block when row frames run on a split group.
BLOCK_ROWS = 1_000_000

_OFFSET_BITS = 33  # layout of monotonically_increasing_id: partition << 33 | offset


@dataclass(frozen=True)
class GroupProfile:
    """How many groups there are and how long the longest is."""

    groups: int
    largest: int

    def is_hot(self, hot_rows: int = HOT_ROWS) -> bool:
        return self.largest > hot_rows


def profile_groups(df: DataFrame, keys: Sequence[str]) -> GroupProfile:
    """Measure the groups with one narrow scan; only two numbers reach the driver."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    row = sizes.agg(F.count(F.lit(1)).alias("groups"), F.max("rows").alias("largest")).first()
    return GroupProfile(groups=row["groups"], largest=row["largest"] or 0)


def attach_groups(
    df: DataFrame,
    per_group: DataFrame,
    keys: Sequence[str],
    groups: int | None = None,
    how: str = "inner",
) -> DataFrame:
    """Join a one-row-per-group table; broadcast only when its row count is known small.

    Otherwise the join is left to Catalyst: a sort-merge join whose skewed
    partitions AQE splits.
    """
    if groups is not None and groups <= BROADCAST_GROUPS:
        per_group = F.broadcast(per_group)
    return df.join(per_group, list(keys), how)


def settle(per_group: DataFrame) -> tuple[DataFrame, int]:
    """Compute a one-row-per-group table once and count it.

    The count decides how :func:`attach_groups` joins it; the checkpoint keeps
    the aggregate behind it from running again.
    """
    ensure_checkpoint_dir(per_group.sparkSession)
    stored = per_group.checkpoint()
    return stored, stored.count()


class OrderedGroups:
    """A frame whose rows are ordered within groups; see the module text."""

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        profile: GroupProfile | None = None,
        hot_rows: int = HOT_ROWS,
        block_rows: int = BLOCK_ROWS,
    ) -> None:
        self.keys = list(keys)
        self.order = list(order)
        self.profile = profile or profile_groups(df, keys)
        self.block_rows = block_rows
        self.split = self.profile.is_hot(hot_rows)
        self.df = self._spread(df) if self.split else df

    # -- construction -----------------------------------------------------

    def _spread(self, df: DataFrame) -> DataFrame:
        ensure_checkpoint_dir(df.sparkSession)
        by = [*self.keys, *self.order]
        placed = (
            df.repartitionByRange(*by)
            .sortWithinPartitions(*by)
            .withColumn("_pos", F.monotonically_increasing_id())
            # Row positions must not change if a task is run again.
            .checkpoint()
        )
        return placed.withColumn("_part", F.shiftright("_pos", _OFFSET_BITS))

    def _with(self, df: DataFrame) -> OrderedGroups:
        twin = object.__new__(OrderedGroups)
        twin.__dict__.update(self.__dict__)
        twin.df = df
        return twin

    # -- primitives -------------------------------------------------------

    def running(self, name: str, kind: str, value: Column) -> OrderedGroups:
        """Add ``sum`` or ``max`` of ``value`` over all earlier rows of the group (null if none)."""
        agg = {"sum": F.sum, "max": F.max}[kind]
        if not self.split:
            w = Window.partitionBy(*self.keys).orderBy(*self.order)
            before = w.rowsBetween(Window.unboundedPreceding, -1)
            return self._with(self.df.withColumn(name, agg(value).over(before)))

        df = self.df.withColumn("_v", value)
        local = Window.partitionBy(*self.keys, "_part").orderBy("_pos")
        totals = df.groupBy(*self.keys, "_part").agg(agg("_v").alias("_total"))
        earlier = Window.partitionBy(*self.keys).orderBy("_part").rowsBetween(
            Window.unboundedPreceding, -1
        )
        carry = totals.select(*self.keys, "_part", agg("_total").over(earlier).alias("_carry"))
        df = df.withColumn(
            "_here", agg("_v").over(local.rowsBetween(Window.unboundedPreceding, -1))
        ).join(carry, [*self.keys, "_part"])
        here, carried = F.col("_here"), F.col("_carry")
        both = here + carried if kind == "sum" else F.greatest(here, carried)
        df = df.withColumn(name, F.coalesce(both, here, carried)).drop("_v", "_here", "_carry")
        return self._with(df)

    def index(self) -> OrderedGroups:
        """Add ``idx`` (0-based position in the group) and ``n`` (rows in the group)."""
        if not self.split:
            w = Window.partitionBy(*self.keys)
            df = self.df.withColumn(
                "idx", (F.row_number().over(w.orderBy(*self.order)) - 1).cast("long")
            ).withColumn("n", F.count(F.lit(1)).over(w))
            return self._with(df)

        offset = F.col("_pos").bitwiseAND(F.lit((1 << _OFFSET_BITS) - 1))
        pieces = self.df.groupBy(*self.keys, "_part").agg(
            F.min(offset).alias("_first"), F.count(F.lit(1)).alias("_rows")
        )
        w = Window.partitionBy(*self.keys)
        earlier = w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        pieces = pieces.select(
            *self.keys,
            "_part",
            "_first",
            F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_skip"),
            F.sum("_rows").over(w).alias("n"),
        )
        # At most one row per group and one more per partition boundary.
        partitions = int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = attach_groups(
            self.df, pieces, [*self.keys, "_part"], self.profile.groups + partitions
        )
        df = df.withColumn("idx", F.col("_skip") + offset - F.col("_first"))
        return self._with(df.drop("_first", "_skip"))

    def frames(
        self, before: int, after: int, *builds: Callable[[WindowSpec], dict[str, Column]]
    ) -> OrderedGroups:
        """Add window columns that look at most ``before``/``after`` rows away.

        Each ``build`` receives the ordered window and returns columns; later ones
        may use the columns of earlier ones. Together they must not reach further
        (``rowsBetween``, ``lag``, ``lead``) than the two numbers say.
        """
        if not self.split:
            df, w = self.df, Window.partitionBy(*self.keys).orderBy(*self.order)
            for build in builds:
                df = df.withColumns(build(w))
            return self._with(df)

        if self.block_rows <= before + after:
            raise ValueError("block_rows must exceed the frame length")
        source = self if "idx" in self.df.columns else self.index()
        block = lambda i: F.floor(i / F.lit(self.block_rows)).cast("long")
        first = block(F.greatest(F.col("idx") - after, F.lit(0)))
        last = block(F.least(F.col("idx") + before, F.col("n") - 1))
        df = source.df.withColumn("_block", F.explode(F.sequence(first, last)))
        w = Window.partitionBy(*self.keys, "_block").orderBy("idx")
        for build in builds:
            df = df.withColumns(build(w))
        return self._with(df.where(F.col("_block") == block(F.col("idx"))).drop("_block"))

    def keep(self, condition: Column) -> OrderedGroups:
        """Only some rows. Those that are left keep their ``idx`` and ``n``."""
        return self._with(self.df.where(condition))

    def attach(self, **aggregates: Column) -> OrderedGroups:
        """Add group-level aggregates to every row."""
        if not self.split:
            w = Window.partitionBy(*self.keys)
            return self._with(
                self.df.withColumns({name: agg.over(w) for name, agg in aggregates.items()})
            )
        per_group = self.df.groupBy(*self.keys).agg(
            *[agg.alias(name) for name, agg in aggregates.items()]
        )
        return self._with(attach_groups(self.df, per_group, self.keys, self.profile.groups))

    def result(self) -> DataFrame:
        """The frame without helper columns."""
        return self.df.drop("_pos", "_part")


#: Accuracy of the sketch that brackets the quantiles of long groups, and how many
#: of its error bounds a bracket extends to either side.
SKETCH_ACCURACY = 10_000
SKETCH_MARGIN = 10


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    profile: GroupProfile | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Exact, linearly interpolated quantiles per group, one column per entry of ``probs``.

    Small groups use the built-in ``percentile``. For larger ones a sketch first
    brackets each quantile. A second pass counts the rows between the brackets
    and keeps, as (value, count) pairs, only what lies inside them; the pairs are
    ranked in order, spread over tasks if they are still many, and each quantile
    is read from the one or two pairs its rank falls into. Null values are ignored.
    """
    profile = profile or profile_groups(df, keys)
    if not profile.is_hot(min(hot_rows, QUANTILE_ROWS)):
        ps = F.array(*[F.lit(p) for p in probs.values()])
        out = df.groupBy(*keys).agg(F.percentile(value, ps).alias("_q"))
        return out.select(
            *keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)]
        )

    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    margin = SKETCH_MARGIN / SKETCH_ACCURACY
    ends = [e for p in probs.values() for e in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch, groups = settle(
        known.groupBy(*keys).agg(
            F.percentile_approx("_v", [float(e) for e in ends], SKETCH_ACCURACY).alias("_ends")
        )
    )
    v = F.col("_v")
    inside, cell = F.lit(False), F.lit(0)
    for i in range(0, len(ends), 2):
        low, high = F.col("_ends")[i], F.col("_ends")[i + 1]
        inside = inside | ((v >= low) & (v <= high))
        cell = cell + (v > low).cast("int") + (v > high).cast("int")
    pairs = (
        attach_groups(known, sketch, keys, groups)
        # Cells count the bracket ends below a value, so (cell, value) sorts like the
        # value; rows outside all brackets share one null-valued row per cell.
        .select(*keys, cell.alias("_cell"), F.when(inside, v).alias("_value"))
        .groupBy(*keys, "_cell", "_value")
        .agg(F.count(F.lit(1)).alias("_w"))
    )
    ranked = OrderedGroups(pairs, keys, ["_cell", "_value"], hot_rows=hot_rows)
    ranked = ranked.running("_skip", "sum", F.col("_w")).attach(_total=F.sum("_w"))
    skip = F.coalesce(F.col("_skip"), F.lit(0))
    found = F.when(
        F.col("_value").isNull(), F.raise_error(F.lit("quantile outside of its bracket"))
    ).otherwise(F.col("_value"))
    columns, wanted = [], F.lit(False)
    for name, p in probs.items():
        rank = F.lit(p) * (F.col("_total") - 1)
        low, high = F.floor(rank), F.ceil(rank)
        has = lambda r: (skip <= r) & (r < skip + F.col("_w"))
        wanted = wanted | has(low) | has(high)
        v_low = F.max(F.when(has(low), found))
        v_high = F.max(F.when(has(high), found))
        share = F.max(rank - low)
        # Equal ends need no arithmetic, which would turn two infinities into NaN.
        columns.append(F.when(v_low == v_high, v_low).otherwise(v_low + (v_high - v_low) * share).alias(name))
    return ranked.result().where(wanted).groupBy(*keys).agg(*columns)
