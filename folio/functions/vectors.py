"""Vector arithmetic in double precision, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def is_valid(v: Column, dims: int) -> Column:
    """The right length, finite, and not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce((F.size(v) == dims) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))


def l2_normalize(v: Column) -> Column:
    """v / |v|; null where |v| is zero."""
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n))


def l2_normalize_strict(v: Column, dims: int) -> Column:
    """v / |v|; a vector of another dimension or without a direction raises."""
    return F.when(is_valid(v, dims), l2_normalize(v)).otherwise(F.raise_error(F.lit("vector of wrong dimension or zero norm")).cast("array<double>"))
