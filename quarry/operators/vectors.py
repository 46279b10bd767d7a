"""Vectors in columns: which of them can be compared, and their distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and columns of a tile of distances, which stays in a core's cache.
TILE = (256, 1_024)
#: Share of the squared lengths under which a squared distance is taken from differences.
CLOSE = 1e-4


def has_values(v: str = "v") -> Column:
    """Whether a vector is there, is not empty, and holds finite numbers only."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce((F.size(v) > 0) & F.forall(v, fine), F.lit(False))


def dimension(points: DataFrame, v: str = "v") -> int:
    """The most frequent length of the vectors that have values (ties: the larger);
    0 where there is none."""
    found = points.where(has_values(v)).groupBy(F.size(v).alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    return found["d"] if found else 0


def can_compare(dim: int, metric=2, v: str = "v") -> Column:
    """Whether a vector is of length dim, with finite numbers only, and, for "cosine",
    not all zero."""
    good = has_values(v) & (F.size(v) == dim)
    if metric == "cosine":
        good = good & F.exists(v, lambda x: x.cast("double") != 0)
    return F.coalesce(good, F.lit(False))


def comparable(points: DataFrame, dim: int, metric=2, v: str = "v") -> DataFrame:
    """Points whose vectors can be compared, as doubles. All others are left out: they
    are near nothing."""
    return points.where(can_compare(dim, metric, v)).withColumn(v, F.col(v).cast("array<double>"))


def matrix(lists, dim: int | None = None) -> np.ndarray:
    """Rows of equal length from a sequence of lists."""
    out = np.array(list(lists), float)
    return out.reshape(len(out), -1 if dim is None and len(out) else dim or 0)


def distances(a: np.ndarray, b: np.ndarray, metric) -> np.ndarray:
    """Distances of every row of a to every row of b: "cosine", or the order p of
    a Minkowski distance. A cosine with a zero vector is nan."""
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):  # one column at a time keeps the block two-dimensional
        out += np.abs(a[:, k][:, None] - b[:, k][None, :]) ** metric
    return out if metric == 1 else out ** (1 / metric)


def unit(a: np.ndarray) -> np.ndarray:
    return a / np.linalg.norm(a, axis=1)[:, None]


def tiled_distances(a: np.ndarray, b: np.ndarray, metric) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """distances(a, b, metric) tile by tile, as (rows, columns, distances). Euclidean ones
    are a product of matrices about the middle of b; pairs so near each other that the
    product loses digits are taken from their differences. Equal distances of different
    pairs may differ in the last digits."""
    high, wide = TILE
    product = False
    if metric == 2:
        x, y = a - b.mean(0), b - b.mean(0)
        of_x, of_y = (x * x).sum(1), (y * y).sum(1)
        product = bool(np.isfinite(of_x.sum() + of_y.sum()))
    if product:
        left = np.column_stack([x, of_x, np.ones(len(x))])
        right = np.ascontiguousarray(np.column_stack([-2 * y, np.ones(len(y)), of_y]).T)
    for at in range(0, len(a), high):
        rows = slice(at, at + high)
        for begin in range(0, len(b), wide):
            columns = slice(begin, begin + wide)
            if not product:
                yield rows, columns, distances(a[rows], b[columns], metric)
                continue
            d = left[rows] @ right[:, columns]
            limit = CLOSE * (of_x[rows] + of_y[columns].max())
            if d.min() < limit.max():
                i, j = np.nonzero(d < limit[:, None])
                for k in range(0, len(i), 50_000):
                    some = slice(k, k + 50_000)
                    gap = a[rows][i[some]] - b[columns][j[some]]
                    d[i[some], j[some]] = (gap * gap).sum(1)
            yield rows, columns, np.sqrt(d, out=d)
