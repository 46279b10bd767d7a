"""Work on all pairs of two sets of vectors, block by block."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.pivots import build, nearest_blocks
from quarry.operators.pivots import nearest as pivot_nearest
from quarry.operators.vectors import comparable, dimension

ROWS = 2_000


def by_block_pairs(left: DataFrame, right: DataFrame, fn: Callable, schema: str, rows: int = ROWS) -> DataFrame:
    """Union of fn(left block, right block) over all pairs of blocks. Both sides
    are (id, v, tag); a task holds one block of about `rows` rows of each side."""
    nl, nr = (max(1, -(-side.count() // rows)) for side in (left, right))
    cut = lambda side, n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")  # noqa: E731, ARG005
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.select("id", "v", "tag", cut(left, nl).alias("i"), every(nr).alias("j"), F.lit(0).alias("side"))
    b = right.select("id", "v", "tag", every(nl).alias("i"), cut(right, nr).alias("j"), F.lit(1).alias("side"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return fn(part[part.side == 0], part[part.side == 1])

    return a.unionByName(b).groupBy("i", "j").applyInPandas(run, schema)


def nearest(queries: DataFrame, rows: DataFrame, k: int, metric, *, block_rows: int = ROWS, pivots: int | None = None) -> DataFrame:
    """(id, other, tag, distance, rank): the k nearest of rows to each query, ties
    to the smaller id; a row of the query's own id is none of them. Both sides are
    (id, v, tag); the tag is that of the other. Ids are unique on each side.

    Vectors that are null, empty, not finite, of another length than most of rows, or
    zero by the cosine, are near nothing: such a query has no row, and such a row is
    nobody's neighbour. Rows that fill more than one block are searched by pivots.
    """
    dim = dimension(rows)
    known = lambda side: comparable(side, dim, metric)
    queries, rows = known(queries), known(rows)
    n = rows.count()
    if n <= block_rows:
        found = by_block_pairs(queries, rows, nearest_blocks(k, metric), f"id long, other long, tag {dict(rows.dtypes)['tag']}, distance double", block_rows).where("id <> other")
    else:
        found = pivot_nearest(build(rows, metric, dim, n, block_rows, pivots), queries, k)
    order = Window.partitionBy("id").orderBy("distance", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vote(neighbours: DataFrame, k: int) -> DataFrame:
    """(id, prediction): the most frequent tag of the k nearest; ties go to the tag
    met first by distance."""
    votes = neighbours.where(F.col("rank") <= k).groupBy("id", "tag").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    return votes.groupBy("id").agg(F.max_by("tag", F.struct("n", -F.col("first"))).alias("prediction"))


def knn(queries: DataFrame, train: DataFrame, k: int = 3, metric=2) -> DataFrame:
    """k-nearest-neighbour classes of the queries; train's tag is its class."""
    return vote(nearest(queries, train, k, metric), k)
