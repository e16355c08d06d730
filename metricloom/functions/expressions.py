"""Small column expressions used across operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(value: Column) -> Column:
    """Neither NaN nor infinite (null stays null)."""
    return ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def clamp_high(value: Column, high: float = 1.0) -> Column:
    return F.least(F.lit(high), value)


def clamp_low(value: Column, low: float = 0.5) -> Column:
    return F.greatest(F.lit(low), value)


def fixed(value: Column, digits: int = 4) -> Column:
    """A number as text with a fixed count of decimals."""
    return F.format_string(f"%.{digits}f", value)


def formatted(pattern: str, value: Column | str) -> Column:
    """A formatted value, null when the value is null."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value.isNotNull(), F.format_string(pattern, value))


def short_number(value: Column) -> Column:
    """Scientific form outside 0.001..10000, else four decimals.

    The exponent is written as in browsers: ``1.234e-5``, ``1.000e+4``.
    """
    sci = F.format_string("%.3e", value)
    sci = F.regexp_replace(sci, r"e([+-])0(\d)$", r"e$1$2")
    size = F.abs(value)
    return F.when((size < 0.001) | (size > 10000), sci).otherwise(fixed(value))


def is_loss(name: Column) -> Column:
    return F.lower(name).contains("loss")


def shape_product(shape: Column) -> Column:
    """Element count of a tensor shape."""
    return F.aggregate(shape.cast("array<bigint>"), F.lit(1).cast("bigint"), lambda a, d: a * d)


def valid_shape(shape: Column) -> Column:
    return F.forall(shape, lambda d: d > 0)


def safe_file_name(name: Column) -> Column:
    return F.translate(name, "/.", "__")


def short_digest(content: Column) -> Column:
    """First 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)


def run_name_or_null(name: Column) -> Column:
    """Trimmed name; empty names become null."""
    trimmed = F.trim(name)
    return F.when(F.length(trimmed) > 0, trimmed)


def contains_any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def severity_rank(severity: Column) -> Column:
    """0 for the worst, as anomaly lists are sorted."""
    return F.when(severity == "critical", 0).when(severity == "warning", 1).otherwise(2)


# Unit factors.
BYTES_PER_GB = 1024**3
BYTES_PER_MB = 1024**2


def bytes_to_gb(value: Column) -> Column:
    return value / F.lit(float(BYTES_PER_GB))


def bytes_to_mb(value: Column) -> Column:
    return value / F.lit(float(BYTES_PER_MB))


def milliwatts_to_watts(value: Column) -> Column:
    return value / F.lit(1000.0)


def device_prefix(kind: str, index: Column, count: Column) -> Column:
    """``gpu0/`` style prefix, empty when there is a single device."""
    return F.when(count > 1, F.concat(F.lit(kind), index.cast("string"), F.lit("/"))).otherwise("")
