"""Statistics over tensors held as element rows or as one vector per row."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.functions import expressions as X
from metricloom.functions import vectors as V
from metricloom.operators.ordered import GroupProfile, attach_groups, profile_groups, settle


# -- histograms --------------------------------------------------------------


def histogram_bounds(values: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Range and moments per group; an empty range is widened by a half on both sides."""
    low, high = F.min(value), F.max(value)
    flat = low == high
    return values.groupBy(*keys).agg(
        F.when(flat, low - 0.5).otherwise(low).alias("low"),
        F.when(flat, high + 0.5).otherwise(high).alias("high"),
        low.alias("min"),
        high.alias("max"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.count(F.lit(1)).alias("count"),
    )


def histogram(
    values: DataFrame,
    keys: Sequence[str],
    value: str = "value",
    bins: int = 64,
    measured: tuple[DataFrame, int] | None = None,
) -> DataFrame:
    """Equal-width bin counts per group, the right-most bin closed; empty bins are kept out.

    Rows of the result: keys, bin, lower edge, upper edge, count. The ranges are
    settled first, so that with few groups the values are binned without a shuffle.
    """
    bounds, groups = measured or settle(histogram_bounds(values, keys, value))
    placed = attach_groups(values, bounds.select(*keys, "low", "high"), keys, groups)
    width = (F.col("high") - F.col("low")) / bins
    bin_no = F.least(
        F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * bins),
        F.lit(bins - 1),
    ).cast("int")
    return placed.groupBy(*keys, "low", "high", bin_no.alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    ).select(
        *keys,
        "bin",
        (F.col("low") + F.col("bin") * width).alias("lower"),
        (F.col("low") + (F.col("bin") + 1) * width).alias("upper"),
        "count",
    )


def histogram_metric(
    values: DataFrame,
    keys: Sequence[str],
    value: str = "value",
    bins: int = 64,
) -> DataFrame:
    """Histogram as a metric row: mean as value, counts and edges as JSON metadata.

    At most ``bins`` counts are gathered per group.
    """
    bounds, groups = settle(histogram_bounds(values, keys, value))
    counts = histogram(values, keys, value, bins, (bounds, groups))
    filled = counts.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("_m")
    )
    every = F.sequence(F.lit(0), F.lit(bins - 1))
    width = (F.col("high") - F.col("low")) / bins
    return bounds.join(filled, list(keys)).select(
        *keys,
        F.col("mean").alias("value"),
        F.lit("histogram").alias("metric_type"),
        F.to_json(
            F.struct(
                F.transform(every, lambda i: F.coalesce(F.col("_m")[i], F.lit(0))).alias("histogram"),
                F.transform(
                    F.sequence(F.lit(0), F.lit(bins)), lambda i: F.col("low") + i * width
                ).alias("bin_edges"),
                "min",
                "max",
                "std",
            )
        ).alias("metadata"),
    )


# -- element statistics ------------------------------------------------------


def tensor_statistics(elements: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Norm, moments (sample deviation), zero share and NaN/Inf flags in one aggregate."""
    v = F.col(value)
    return elements.groupBy(*keys).agg(
        F.sqrt(F.sum(v * v)).alias("norm"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.count_if(v == 0).alias("num_zeros"),
        F.count(F.lit(1)).alias("elements"),
        F.try_divide(F.count_if(v == 0), F.count(F.lit(1))).alias("sparsity"),
        F.bool_or(F.isnan(v)).alias("has_nan"),
        F.bool_or(F.abs(v) == float("inf")).alias("has_inf"),
    )


def _over(stats: DataFrame, by: Sequence[str], *aggs: Column) -> DataFrame:
    return stats.groupBy(*by).agg(*aggs) if by else stats.agg(*aggs)


def gradient_summary(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Norms over healthy layers and the count of broken ones."""
    norm = F.when(~(F.col("has_nan") | F.col("has_inf")), F.col("norm"))
    return _over(
        stats,
        by,
        F.coalesce(F.sqrt(F.sum(norm * norm)), F.lit(0.0)).alias("total_norm"),
        F.coalesce(F.max(norm), F.lit(0.0)).alias("max_norm"),
        F.coalesce(F.avg(norm), F.lit(0.0)).alias("mean_norm"),
        F.count(F.lit(1)).alias("num_layers"),
        F.count_if("has_nan").alias("num_nan"),
        F.count_if("has_inf").alias("num_inf"),
    )


def gradient_norms(elements: DataFrame, param: str, by: Sequence[str] = ()) -> DataFrame:
    """Total and largest parameter norm, and the number of parameters."""
    v = F.col("value")
    norms = elements.groupBy(*by, param).agg(F.sqrt(F.sum(v * v)).alias("norm"))
    return _over(
        norms,
        by,
        F.coalesce(F.sqrt(F.sum(F.col("norm") * F.col("norm"))), F.lit(0.0)).alias("total_norm"),
        F.coalesce(F.max("norm"), F.lit(0.0)).alias("max_norm"),
        F.count(F.lit(1)).alias("num_params"),
    )


def layer_rows(stats: DataFrame, param: str, by: Sequence[str] = (), first: int | None = 20) -> DataFrame:
    """Per-layer norm and mean as metric rows, for the first layers or for all."""
    rows = stats
    if first is not None and by:
        w = Window.partitionBy(*by).orderBy(param)
        rows = rows.withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= first)
    elif first is not None:
        rows = rows.orderBy(param).limit(first)
    entries = F.array(
        *[
            F.struct(
                F.concat(F.lit("gradients/"), F.col(param), F.lit(f"/{c}")).alias("name"),
                F.col(c).alias("value"),
            )
            for c in ("norm", "mean")
        ]
    )
    return rows.select(*by, F.explode(entries).alias("_m")).select(*by, "_m.*")


def parameter_summary(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _over(
        stats,
        by,
        F.sqrt(F.sum(F.col("norm") * F.col("norm"))).alias("total_norm"),
        F.max("norm").alias("max_norm"),
        F.avg("sparsity").alias("mean_sparsity"),
        F.count(F.lit(1)).alias("num_layers"),
    )


def tree_statistics(elements: DataFrame, leaf: str, by: Sequence[str] = ()) -> DataFrame:
    """Norms over the leaves of a parameter tree plus tensor and element counts."""
    v = F.col("value")
    leaves = elements.groupBy(*by, leaf).agg(
        F.sqrt(F.sum(v * v)).alias("norm"), F.count(F.lit(1)).alias("size")
    )
    return _over(
        leaves,
        by,
        F.sqrt(F.sum(F.col("norm") * F.col("norm"))).alias("total_norm"),
        F.max("norm").alias("max_norm"),
        F.avg("norm").alias("mean_norm"),
        F.count(F.lit(1)).alias("num_tensors"),
        F.sum("size").alias("total_elements"),
    )


def tree_structure(shapes: DataFrame, by: Sequence[str] = (), shape: str = "shape") -> DataFrame:
    """Parameter and tensor counts from the shapes alone."""
    return _over(
        shapes,
        by,
        F.sum(X.shape_product(F.col(shape))).alias("total_parameters"),
        F.count(F.lit(1)).alias("num_tensors"),
    )


def matrix_statistics(elements: DataFrame, keys: Sequence[str]) -> DataFrame:
    return elements.groupBy(*keys).agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean")
    )


def min_max_normalise(
    elements: DataFrame, keys: Sequence[str], eps: float = V.NORM_EPS
) -> DataFrame:
    """Elements scaled to 0..1 within their tensor."""
    bounds, groups = settle(
        elements.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    )
    out = attach_groups(elements, bounds, keys, groups)
    scaled = V.min_max(F.col("value"), F.col("_lo"), F.col("_hi"), eps)
    return out.withColumn("scaled", scaled).drop("_lo", "_hi")


def select_layers(
    df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), name: str = "param"
) -> DataFrame:
    """Layers without any excluded substring and, if given, with an included one."""
    column = F.col(name)
    out = df.where(~X.contains_any(column, list(exclude)))
    return out.where(X.contains_any(column, list(include))) if include else out


# -- attention ---------------------------------------------------------------


def check_rank(shapes: DataFrame, allowed: Sequence[int], shape: str = "shape") -> DataFrame:
    """Tensors whose number of dimensions is not allowed, for rejection."""
    return shapes.where(~F.size(shape).isin(*allowed))


ATTENTION_RANKS = (3, 4)
HIDDEN_STATE_RANKS = (2, 3)


def attention_summary(rows: DataFrame, keys: Sequence[str], weights: str = "weights") -> DataFrame:
    """Mean and max weight and the mean row entropy; ``rows`` holds one distribution per row."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    per_row = rows.select(
        *keys,
        total.alias("_sum"),
        F.size(weights).alias("_len"),
        F.array_max(weights).alias("_max"),
        V.entropy(F.col(weights)).alias("_entropy"),
    )
    return per_row.groupBy(*keys).agg(
        (F.sum("_sum") / F.sum("_len")).alias("mean"),
        F.max("_max").alias("max"),
        F.avg("_entropy").alias("entropy"),
        F.count(F.lit(1)).alias("rows"),
    )


# -- similarity --------------------------------------------------------------

METRICS = {"cosine": V.cosine, "euclidean": V.euclidean, "dot_product": V.dot}


def similarity_to(
    states: DataFrame,
    anchors: DataFrame,
    keys: Sequence[str],
    metric: str = "cosine",
    anchor_count: int | None = None,
) -> DataFrame:
    """Rows of the similarity matrix: every position against the given anchors.

    ``anchors`` holds keys, ``anchor_pos`` and ``anchor_vec``. The work is one
    pass over the states per anchor of their group, so the caller decides how
    much of the (quadratic) matrix is produced; passing all positions as anchors
    gives all of it.
    """
    joined = attach_groups(states, anchors, keys, anchor_count)
    return joined.select(
        *keys,
        "anchor_pos",
        "pos",
        METRICS[metric](F.col("anchor_vec"), F.col("vec")).alias("similarity"),
    )


def first_positions(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first position of each group as its anchor."""
    first = states.groupBy(*keys).agg(F.min_by(F.struct("pos", "vec"), "pos").alias("_a"))
    return first.select(
        *keys, F.col("_a.pos").alias("anchor_pos"), F.col("_a.vec").alias("anchor_vec")
    )


#: Groups up to this many positions are handled whole by one task.
WHOLE_POSITIONS = 5_000


def _moments(u: np.ndarray) -> tuple[float, float, float, float]:
    """Sums over all pairs of rows (similarity and its square) and over the diagonal."""
    total = u.sum(axis=0)
    gram = u @ u.T if len(u) <= u.shape[1] else u.T @ u
    sq = (u * u).sum(axis=1)
    return float(total @ total), float((gram * gram).sum()), float(sq.sum()), float((sq * sq).sum())


def similarity_summary(
    states: DataFrame,
    keys: Sequence[str],
    profile: GroupProfile | None = None,
    whole_positions: int = WHOLE_POSITIONS,
) -> DataFrame:
    """Mean and population deviation of the off-diagonal cosine similarities.

    No pair leaves a task. With unit-scaled vectors ``u``, the sum of all
    similarities of a group is ``|sum u|^2`` and the sum of their squares is the
    squared Frobenius norm of ``U U^T``, which equals that of ``U^T U``; the
    diagonal is taken off through ``sum |u|^2`` and ``sum |u|^4``. Groups of
    bounded length give these four numbers in one step. Beyond that,
    ``U^T U`` adds up across batches and partitions, so cost grows linearly with
    positions however long a group is.
    """
    keys = list(keys)
    units = states.select(F.struct(*keys).alias("g"), V.unit(F.col("vec")).alias("u"))
    profile = profile or profile_groups(states, keys)
    if profile.largest <= whole_positions:
        sums = _sums_of_groups(units)
    else:
        sums = _sums_of_batches(units)
    pairs = F.col("n") * (F.col("n") - 1)
    mean = F.try_divide(F.col("all1") - F.col("diag1"), pairs)
    square = F.try_divide(F.col("all2") - F.col("diag2"), pairs)
    return sums.select(
        *[F.col(f"g.{k}").alias(k) for k in keys],
        F.col("n").alias("positions"),
        mean.alias("similarity_mean"),
        F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("similarity_std"),
    )


def _sums_of_groups(units: DataFrame) -> DataFrame:
    """The four sums of groups that fit a task."""
    schema = T.StructType(
        [units.schema["g"], T.StructField("n", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("all1", "all2", "diag1", "diag2")]
    )

    def sums(part: pd.DataFrame) -> pd.DataFrame:
        u = np.stack(part["u"].to_numpy())
        a1, a2, d1, d2 = _moments(u)
        return pd.DataFrame(
            {"g": [part["g"].iloc[0]], "n": [len(u)], "all1": [a1], "all2": [a2], "diag1": [d1], "diag2": [d2]}
        )

    return units.groupBy("g").applyInPandas(sums, schema)


def _sums_of_batches(units: DataFrame) -> DataFrame:
    """The four sums of groups of any length, from per-batch partial sums."""
    schema = T.StructType(
        [
            units.schema["g"],
            T.StructField("i", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("s", T.DoubleType()),
            T.StructField("d2", T.DoubleType()),
            T.StructField("d4", T.DoubleType()),
            T.StructField("row", T.ArrayType(T.DoubleType())),
        ]
    )

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["g"].map(lambda g: tuple(g.values()) if isinstance(g, dict) else tuple(g))
            for _, part in batch.groupby(ids, sort=False):
                u = np.stack(part["u"].to_numpy())
                sq = (u * u).sum(axis=1)
                dims = u.shape[1]
                first = np.zeros(dims)
                first[0] = 1.0
                yield pd.DataFrame(
                    {
                        "g": [part["g"].iloc[0]] * dims,
                        "i": np.arange(dims, dtype="int32"),
                        "n": (first * len(u)).astype("int64"),
                        "s": u.sum(axis=0),
                        "d2": first * sq.sum(),
                        "d4": first * (sq * sq).sum(),
                        "row": list(u.T @ u),
                    }
                )

    flat = units.mapInPandas(partial, schema).select(
        "g", "i", "n", "s", "d2", "d4", F.posexplode("row").alias("j", "gij")
    )
    once = lambda c: F.sum(F.when(F.col("j") == 0, F.col(c)))
    cells = flat.groupBy("g", "i", "j").agg(
        F.sum("gij").alias("gij"), *[once(c).alias(c) for c in ("n", "s", "d2", "d4")]
    )
    return cells.groupBy("g").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("s") * F.col("s")).alias("all1"),
        F.sum(F.col("gij") * F.col("gij")).alias("all2"),
        F.sum("d2").alias("diag1"),
        F.sum("d4").alias("diag2"),
    )
