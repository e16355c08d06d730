"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Guards against zero norms and log of zero.
NORM_EPS = 1e-8
ENTROPY_EPS = 1e-10


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def unit(a: Column) -> Column:
    """Vector over (norm + eps), as used for cosine similarity."""
    length = norm(a) + NORM_EPS
    return F.transform(a, lambda x: x / length)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + NORM_EPS) * (norm(b) + NORM_EPS))


def euclidean(a: Column, b: Column) -> Column:
    return norm(F.zip_with(a, b, lambda x, y: x - y))


def entropy(row: Column) -> Column:
    return -_sum(F.transform(row, lambda p: p * F.log(p + ENTROPY_EPS)))


def min_max(value: Column, low: Column, high: Column, eps: float = NORM_EPS) -> Column:
    return (value - low) / (high - low + eps)
