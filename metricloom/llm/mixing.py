"""Mixing sources to target weights: iterative proportional fitting, then sampling by the fitted rates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.common import fresh, quoted, stored, word_count

SWEEPS = 12
TEMPERATURE = 0.7
MIN_SHARE = 0.002
OTHER = "(other)"
NULL = "(null)"
SEED = "mix-1"


def text_form(text: Column) -> Column:
    """Stand-in for a topic where a table has none: the form of a text by its word count."""
    n = word_count(text)
    return F.when(n < 100, "note").when(n < 400, "article").when(n < 1500, "essay").otherwise("book")


def _value(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(NULL))


def rake(cells: DataFrame, groups: list[str], temperature: float, targets: list[Mapping[str, float] | None], sweeps: int) -> DataFrame:
    """``cells`` (``groups``, ``tokens``) with ``weight``: shares that add up to the target of every margin.

    The table is small (see :func:`fit`), so it is held in one partition and no window shuffles.
    """
    whole = Window.partitionBy()
    cells = cells.coalesce(1)
    for g, wanted in zip(groups, targets):
        w = Window.partitionBy(g)
        if wanted is None:
            aim = F.pow(F.sum("tokens").over(w).cast("double"), F.lit(temperature))
        else:
            given = F.create_map(*[F.lit(x) for kv in {**{OTHER: 0.0}, **wanted}.items() for x in kv])
            aim = F.coalesce(F.element_at(given, F.col(g)).cast("double"), F.lit(0.0))
        cells = cells.withColumn(f"aim_{g}", aim).withColumn("_n", F.count("*").over(w))
        cells = cells.withColumn(f"aim_{g}", F.col(f"aim_{g}") / F.sum(F.col(f"aim_{g}") / F.col("_n")).over(whole)).drop("_n")
    cells = cells.withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(sweeps):
        for g in groups:
            cells = cells.withColumn("_sum", F.sum("weight").over(Window.partitionBy(g)))
            scaled = F.when(F.col("_sum") > 0, F.col("weight") * F.col(f"aim_{g}") / F.col("_sum")).otherwise(0.0)
            cells = cells.withColumn("weight", scaled).drop("_sum")
    return cells.drop(*[f"aim_{g}" for g in groups])


def fit(
    docs: DataFrame,
    tokens: Column,
    dims: Mapping[str, Column],
    targets: Mapping[str, Mapping[str, float]] | None = None,
    temperature: float = TEMPERATURE,
    min_share: float = MIN_SHARE,
    sweeps: int = SWEEPS,
) -> DataFrame:
    """Per combination of values (``v0``, ``v1``, ...) of ``dims``: ``tokens``, ``n_docs`` and the sampling ``rate``.

    One scan adds up tokens per combination. Values with less than ``min_share`` of all tokens
    fold into one, so a margin has at most 1 / ``min_share`` + 1 values whatever the input, and
    raking works on a table of bounded size. ``targets`` may name the wanted weight per value of a
    margin (values it leaves out fold together and get none); other margins aim at tokens **
    ``temperature``. Each of ``sweeps`` sweeps scales the weights to every margin in turn. The rate
    is weight / tokens, scaled so that the largest is 1: the largest sample whose expected shares
    are the fitted ones. Null is a value of its own. Combinations without tokens get rate 1; an
    empty table gives no rows.
    """
    names = list(dims)
    keys, groups = [f"v{i}" for i in range(len(names))], [f"g{i}" for i in range(len(names))]
    values = [_value(dims[n]).alias(k) for n, k in zip(names, keys)]
    raw = docs.select(*values, tokens.alias("t")).groupBy(*keys)
    raw = stored(raw.agg(F.sum("t").alias("tokens"), F.count("*").alias("n_docs")), "mix-cells")
    total = raw.agg(F.sum("tokens")).first()[0] or 0
    given = [(targets or {}).get(n) for n in names]
    for k, g, wanted in zip(keys, groups, given):
        margin = raw.groupBy(k).agg(F.sum("tokens").alias("m"))
        large = F.col(k).isin(list(wanted)) if wanted is not None else F.col("m") >= min_share * total
        raw = raw.join(margin.where(large).select(k, F.col(k).alias(g)), k, "left").withColumn(g, F.coalesce(g, F.lit(OTHER)))
    raw = stored(raw, "mix-groups")
    cells = raw.where(F.col("tokens") > 0).groupBy(*groups).agg(F.sum("tokens").alias("tokens"))
    fitted = rake(cells, groups, temperature, given, sweeps)
    rate = F.col("weight") / F.col("tokens")
    fitted = fitted.withColumn("rate", rate / F.max(rate).over(Window.partitionBy())).select(*groups, "rate")
    return stored(
        raw.join(fitted, groups, "left").select(
            *keys, "tokens", "n_docs", F.when(F.col("tokens") > 0, F.col("rate")).otherwise(1.0).alias("rate")
        ),
        "mix-rates",
    )


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the key alone, so a repeated job draws the same sample."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), key.cast("string")).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(16**13))


def mix(
    docs: DataFrame,
    dims: Mapping[str, Column],
    tokens: Column | None = None,
    key: str = "doc_id",
    text: str = "text",
    report: bool = False,
    **options,
) -> DataFrame:
    """The sampled rows of ``docs``: each is kept when its draw falls below the rate of its combination.

    Rows with the same key share their draw; a row without key draws by its text. Null and empty
    texts have no tokens and are kept when their combination is. ``report`` keeps all rows and adds
    ``mix_rate`` and ``mix_kept``. Rates are joined by the values of ``dims``; the table is written,
    so Spark broadcasts it only while it is small.
    """
    rates = fit(docs, word_count(quoted(text)) if tokens is None else tokens, dims, **options)
    keys = [f"v{i}" for i in range(len(dims))]
    own, rate = {k: fresh(docs, f"_mix_{k}") for k in keys}, fresh(docs, "_mix_rate")
    rates = rates.select(*[F.col(k).alias(own[k]) for k in keys], F.col("rate").alias(rate))
    same = [F.col(own[k]) == _value(c) for k, c in zip(keys, dims.values())]
    joined = docs.join(rates, same, "left")
    chosen = draw(F.coalesce(quoted(key).cast("string"), F.md5(quoted(text).cast("binary")), F.lit(""))) < F.col(rate)
    if report:
        return joined.select(*map(quoted, docs.columns), F.col(rate).alias("mix_rate"), chosen.alias("mix_kept"))
    return joined.where(chosen).select(*map(quoted, docs.columns))
