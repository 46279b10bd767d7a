"""Distances between array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


def minkowski(a: Column, b: Column, p: int) -> Column:
    total = _sum(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x.cast("double") - y.cast("double")), F.lit(float(p)))))
    return total if p == 1 else F.pow(total, F.lit(1.0 / p))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine similarity; null where a vector has length zero."""
    dot = _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda v: F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    return 1 - F.try_divide(dot, norm(a) * norm(b))
