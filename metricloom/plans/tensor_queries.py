"""Tensor, histogram, gradient, attention and similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.operators import artifacts as A
from metricloom.operators import tensors as T
from metricloom.plans.common import Registry, r, rounded, tables, with_tables

REGISTRY = Registry()
query = REGISTRY.query

_BINS = """+ b AS (SELECT param, min(value) AS lo, max(value) AS hi FROM elements GROUP BY param)"""


@query(
    with_tables(
        "elements",
        body=_BINS
        + f""" SELECT param, CAST(least(floor((value - lo) / (hi - lo) * 64), 63) AS INT) AS bin,
            {r("any_value(lo) + least(floor((value - lo) / (hi - lo) * 64), 63) * ((any_value(hi) - any_value(lo)) / 64)")} AS lower,
            count(*) AS "count"
        FROM elements JOIN b USING (param) GROUP BY param, least(floor((value - lo) / (hi - lo) * 64), 63)""",
    )
)
def histogram(spark, folder):
    rows = T.histogram(tables.gradients(spark, folder), ["param"])
    return rows.select("param", "bin", rounded("lower").alias("lower"), "count")


@query(
    with_tables(
        "elements",
        body=f"""SELECT param, {r("avg(value)")} AS value, {r("stddev_pop(value)")} AS std,
        {r("min(value)")} AS lo, {r("max(value)")} AS hi, 65 AS edges, count(*) AS counted
        FROM elements GROUP BY param""",
    )
)
def histogram_metric(spark, folder):
    rows = T.histogram_metric(tables.gradients(spark, folder), ["param"])
    meta = F.from_json(
        "metadata",
        "histogram array<bigint>, bin_edges array<double>, min double, max double, std double",
    ).alias("m")
    return rows.select("param", "value", meta).select(
        "param",
        rounded("value").alias("value"),
        rounded("m.std").alias("std"),
        rounded("m.min").alias("lo"),
        rounded("m.max").alias("hi"),
        F.size("m.bin_edges").alias("edges"),
        F.aggregate("m.histogram", F.lit(0).cast("long"), lambda s, x: s + x).alias("counted"),
    )


@query(
    with_tables(
        "elements",
        body=f"""SELECT param, {r("sqrt(sum(value * value))")} AS norm, {r("avg(value)")} AS mean,
        {r("stddev_samp(value)")} AS std, {r("min(value)")} AS lo, {r("max(value)")} AS hi,
        CAST(count(*) FILTER (value = 0) AS BIGINT) AS num_zeros, bool_or(isnan(value)) AS has_nan,
        bool_or(isinf(value)) AS has_inf FROM elements GROUP BY param""",
    )
)
def gradient_stats(spark, folder):
    s = T.tensor_statistics(tables.gradients(spark, folder), ["param"])
    return s.select(
        "param",
        *[rounded(c).alias(c) for c in ("norm", "mean", "std")],
        rounded("min").alias("lo"),
        rounded("max").alias("hi"),
        "num_zeros",
        "has_nan",
        "has_inf",
    )


_NORMS = """+ n AS (SELECT param, sqrt(sum(value * value)) AS norm, count(*) AS size,
    count(*) FILTER (value = 0) / count(*) AS sparsity FROM elements GROUP BY param)"""


@query(
    with_tables(
        "elements",
        body=_NORMS
        + f""" SELECT {r("sqrt(sum(norm * norm))")} AS total_norm, {r("max(norm)")} AS max_norm,
        {r("avg(norm)")} AS mean_norm, count(*) AS num_layers, 0::BIGINT AS num_nan, 0::BIGINT AS num_inf FROM n""",
    )
)
def gradient_summary(spark, folder):
    s = T.gradient_summary(T.tensor_statistics(tables.gradients(spark, folder), ["param"]))
    return s.withColumns({c: rounded(c) for c in ("total_norm", "max_norm", "mean_norm")})


@query(
    with_tables(
        "elements",
        body=_NORMS
        + f""" SELECT {r("sqrt(sum(norm * norm))")} AS total_norm, {r("max(norm)")} AS max_norm,
        count(*) AS num_params FROM n""",
    )
)
def gradient_norms(spark, folder):
    s = T.gradient_norms(tables.gradients(spark, folder), "param")
    return s.withColumns({c: rounded(c) for c in ("total_norm", "max_norm")})


@query(
    with_tables(
        "elements",
        body=f"""+ s AS (SELECT param, sqrt(sum(value * value)) AS norm, avg(value) AS mean
            FROM elements GROUP BY param)
        SELECT 'gradients/' || param || '/norm' AS name, {r("norm")} AS value FROM s
        UNION ALL SELECT 'gradients/' || param || '/mean', {r("mean")} FROM s""",
    )
)
def gradient_layer_rows(spark, folder):
    stats = T.tensor_statistics(tables.gradients(spark, folder), ["param"])
    return T.layer_rows(stats, "param").withColumn("value", rounded("value"))


@query(
    with_tables(
        "elements",
        body=_NORMS
        + f""" SELECT {r("sqrt(sum(norm * norm))")} AS total_norm, {r("max(norm)")} AS max_norm,
        {r("avg(sparsity)")} AS mean_sparsity, count(*) AS num_layers FROM n""",
    )
)
def param_sparsity(spark, folder):
    s = T.parameter_summary(T.tensor_statistics(tables.gradients(spark, folder), ["param"]))
    return s.withColumns({c: rounded(c) for c in ("total_norm", "max_norm", "mean_sparsity")})


@query(
    with_tables(
        "elements",
        body=_NORMS
        + f""" SELECT {r("sqrt(sum(norm * norm))")} AS total_norm, {r("max(norm)")} AS max_norm,
        {r("avg(norm)")} AS mean_norm, count(*) AS num_tensors, CAST(sum(size) AS BIGINT) AS total_elements FROM n""",
    )
)
def param_tree(spark, folder):
    s = T.tree_statistics(tables.gradients(spark, folder), "param")
    return s.withColumns({c: rounded(c) for c in ("total_norm", "max_norm", "mean_norm")})


@query(
    """SELECT CAST(label AS VARCHAR) AS model, CAST(sum(len(embedding)) AS BIGINT) AS total_parameters,
        count(*) AS num_tensors FROM embeddings GROUP BY label"""
)
def param_tree_structure(spark, folder):
    shapes = tables.table(spark, folder, "embeddings").select(
        F.col("label").cast("string").alias("model"),
        F.array(F.size("embedding"), F.lit(1)).alias("shape"),
    )
    return T.tree_structure(shapes, ["model"])


@query(
    with_tables(
        "elements",
        body=f"""SELECT param, {r("avg(value)")} AS mean, {r("stddev_samp(value)")} AS std,
        {r("max(value)")} AS hi, {r("min(value)")} AS lo FROM elements
        WHERE param NOT LIKE '%9%' AND (param LIKE '%layer%') GROUP BY param""",
    )
)
def activation_stats(spark, folder):
    chosen = T.select_layers(tables.gradients(spark, folder), include=["layer"], exclude=["9"])
    s = T.tensor_statistics(chosen, ["param"])
    return s.select(
        "param",
        rounded("mean").alias("mean"),
        rounded("std").alias("std"),
        rounded("max").alias("hi"),
        rounded("min").alias("lo"),
    )


@query(
    with_tables(
        "elements",
        body=f"""SELECT vec_id, {r("min(value)")} AS lo, {r("max(value)")} AS hi,
        {r("avg(value)")} AS mean FROM elements GROUP BY vec_id""",
    )
)
def matrix_stats(spark, folder):
    s = T.matrix_statistics(tables.gradients(spark, folder), ["vec_id"])
    return s.select("vec_id", rounded("min").alias("lo"), rounded("max").alias("hi"), rounded("mean").alias("mean"))


@query(
    with_tables(
        "elements",
        body=f"""+ b AS (SELECT param, min(value) AS lo, max(value) AS hi FROM elements GROUP BY param)
        SELECT param, vec_id, pos, {r("(value - lo) / (hi - lo + 1e-8)")} AS scaled
        FROM elements JOIN b USING (param)""",
    )
)
def minmax_normalise(spark, folder):
    rows = T.min_max_normalise(tables.gradients(spark, folder), ["param"])
    return rows.select("param", "vec_id", F.col("pos").cast("long").alias("pos"), rounded("scaled").alias("scaled"))


@query(
    with_tables(
        "elements",
        body=f"SELECT vec_id, pos, {r('value')} AS value FROM elements WHERE pos >= 8 AND pos < 24",
    )
)
def tensor_slice(spark, folder):
    rows = A.tensor_slice(tables.gradients(spark, folder), pos=(8, 24))
    return rows.select("vec_id", F.col("pos").cast("long").alias("pos"), rounded("value").alias("value"))


@query(
    with_tables(
        "elements",
        body="""SELECT param, max(vec_id) + 1 AS dim0, max(pos) + 1 AS dim1, count(*) AS elements,
        count(*) * 4 AS size_bytes FROM elements GROUP BY param""",
    )
)
def tensor_info(spark, folder):
    info = A.tensor_info(tables.gradients(spark, folder), ["param"], ["vec_id", "pos"])
    return info.select(
        "param", F.col("shape")[0].alias("dim0"), F.col("shape")[1].alias("dim1"), "elements", "size_bytes"
    )


@query(
    with_tables(
        "elements",
        body=f"""+ t AS (SELECT param, vec_id, abs(value) / sum(abs(value)) OVER (PARTITION BY vec_id) AS p
            FROM elements),
        e AS (SELECT param, vec_id, -sum(p * ln(p + 1e-10)) AS entropy FROM t GROUP BY param, vec_id),
        m AS (SELECT param, avg(p) AS mean, max(p) AS hi FROM t GROUP BY param)
        SELECT param, {r("any_value(mean)")} AS mean, {r("any_value(hi)")} AS hi,
            {r("avg(entropy)")} AS entropy, count(*) AS rows FROM e JOIN m USING (param) GROUP BY param""",
    )
)
def attention_entropy(spark, folder):
    s = T.attention_summary(tables.attention_rows(spark, folder), ["layer"])
    return s.select(
        F.concat(F.lit("layer"), "layer").alias("param"),
        rounded("mean").alias("mean"),
        rounded("max").alias("hi"),
        rounded("entropy").alias("entropy"),
        "rows",
    )


_UNIT = """+ v AS (SELECT param, vec_id, pos, value, sqrt(sum(value * value) OVER (PARTITION BY vec_id)) AS norm
    FROM elements)"""


@query(
    with_tables(
        "elements",
        body=_UNIT
        + f""", a AS (SELECT * FROM v WHERE vec_id IN (SELECT min(vec_id) FROM elements GROUP BY param))
        SELECT a.param AS layer, a.vec_id AS anchor_pos, b.vec_id AS pos,
            {r("sum(a.value * b.value) / ((any_value(a.norm) + 1e-8) * (any_value(b.norm) + 1e-8))")} AS similarity
        FROM a JOIN v b ON a.param = b.param AND a.pos = b.pos GROUP BY a.param, a.vec_id, b.vec_id""",
    )
)
def cosine_similarity(spark, folder):
    states = tables.hidden_states(spark, folder)
    rows = T.similarity_to(states, T.first_positions(states, ["layer"]), ["layer"])
    return rows.withColumn("similarity", rounded("similarity"))


@query(
    with_tables(
        "elements",
        body=_UNIT
        + f""", a AS (SELECT * FROM v WHERE vec_id IN (SELECT min(vec_id) FROM elements GROUP BY param))
        SELECT a.param AS layer, b.vec_id AS pos,
            {r("sqrt(sum((a.value - b.value) * (a.value - b.value)))")} AS similarity
        FROM a JOIN v b ON a.param = b.param AND a.pos = b.pos GROUP BY a.param, a.vec_id, b.vec_id""",
    )
)
def euclidean_similarity(spark, folder):
    states = tables.hidden_states(spark, folder)
    rows = T.similarity_to(states, T.first_positions(states, ["layer"]), ["layer"], "euclidean")
    return rows.select("layer", "pos", rounded("similarity").alias("similarity"))


@query(
    with_tables(
        "elements",
        body=_UNIT
        + f""", u AS (SELECT param, vec_id, pos, value / (norm + 1e-8) AS x FROM v),
        c AS (SELECT a.param, a.vec_id AS i, b.vec_id AS j, sum(a.x * b.x) AS sim
            FROM u a JOIN u b ON a.param = b.param AND a.pos = b.pos AND a.vec_id < b.vec_id
            GROUP BY a.param, a.vec_id, b.vec_id)
        SELECT param AS layer, {r("avg(sim)")} AS similarity_mean,
            {r("stddev_pop(sim)")} AS similarity_std FROM c GROUP BY param""",
    )
)
def similarity_summary(spark, folder):
    s = T.similarity_summary(tables.hidden_states(spark, folder), ["layer"])
    return s.select(
        "layer",
        rounded("similarity_mean").alias("similarity_mean"),
        rounded("similarity_std").alias("similarity_std"),
    )
