"""Vector arithmetic on ``array<double>`` columns. A vector that has no direction is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions.arrays import let


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))


def scale(x: Column, factor: Column) -> Column:
    return F.transform(x, lambda v: v * factor)


def add(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def subtract(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a - b)


def normalise(x: Column) -> Column:
    """Unit vector; NULL for a zero vector."""
    return let(norm(x), lambda n: F.when(n > 0, F.transform(x, lambda v: v / n)))


def signed_cosine(x: Column, y: Column) -> Column:
    return F.try_divide(F.try_divide(dot(x, y), norm(x)), norm(y))


def absolute_cosine(x: Column, y: Column) -> Column:
    return F.abs(signed_cosine(x, y))


def usable(x: Column) -> Column:
    """Neither missing nor zero, and free of NaN."""
    return x.isNotNull() & ~F.exists(x, F.isnan) & F.exists(x, lambda v: v != 0.0)
