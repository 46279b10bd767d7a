"""Near vectors without holding every block against every block.

Rows are dealt to cells by their nearest pivot and, within a cell, to rings by their
distance to it. The triangle inequality bounds from below how near a ring's rows can be
to a query, from a few distances to pivots; a query visits only the rings that may hold
what it looks for. The search is exact for the cosine and for Minkowski distances of
order 1 and above, which are metrics; for a lower order every ring is visited.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.vectors import distances, matrix, unit
from quarry.session import materialize

#: Rows of each side that one task holds against each other.
ROWS = 2_000
ROWS_PER_PIVOT = 500
MOST_PIVOTS = 512
MOST_RINGS = 64
#: Rows that are looked at for each pivot when pivots are chosen.
SAMPLE_PER_PIVOT = 20
SLACK = 1e-9


@dataclass
class PivotIndex:
    """rows (id, v, tag, block) in blocks; of each block its cell, the least and the
    largest distance to the cell's pivot, and how many rows it has."""

    rows: DataFrame
    metric: object
    pivots: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    size: np.ndarray
    block_rows: int

    def bounds(self, v: np.ndarray) -> np.ndarray:
        """For each vector and block a distance that none of the block's rows is under,
        in the space of _space."""
        away = _to_pivots(v, self.pivots, self.metric)
        if self.metric != "cosine" and self.metric < 1:
            return np.zeros((len(v), len(self.cell)))
        at = away[:, self.cell]
        # a row is nearer to its own pivot than to the query's
        bound = np.maximum(np.maximum(at - self.high, self.low - at), (at - away.min(1)[:, None]) / 2)
        error = SLACK * (np.abs(self.pivots).max(initial=0.0) * self.pivots.shape[1] + at)
        return np.maximum(bound - error, 0.0)

    def reach(self, distance: np.ndarray) -> np.ndarray:
        """A distance of the metric in the space of _space, rounded up."""
        if self.metric == "cosine":
            return np.sqrt(2 * (np.maximum(distance, 0) + 1e-12)) * (1 + SLACK)
        return np.asarray(distance, float) * (1 + SLACK)


def _space(v: np.ndarray, metric) -> np.ndarray:
    """Unit vectors for the cosine: their Euclidean distance is sqrt(2 * cosine distance)."""
    return unit(v) if metric == "cosine" else v


def _to_pivots(v: np.ndarray, pivots: np.ndarray, metric) -> np.ndarray:
    return distances(_space(v, metric), pivots, 2 if metric == "cosine" else metric)


def chosen_pivots(rows: DataFrame, n: int, metric, dim: int, most: int) -> np.ndarray:
    """Pivots far from each other, out of a bounded sample by a hash of the id."""
    share = min(1.0, SAMPLE_PER_PIVOT * most / max(1, n))
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy(F.xxhash64("id"), "id").limit(2 * SAMPLE_PER_PIVOT * most)
    v = _space(matrix([r["v"] for r in drawn.select("v").collect()], dim), metric)
    p = 2 if metric == "cosine" else metric
    if not len(v):
        return np.zeros((1, dim))
    picked, away = [0], distances(v, v[:1], p)[:, 0]
    while len(picked) < most and away.max() > 0:
        picked.append(int(away.argmax()))
        away = np.minimum(away, distances(v, v[picked[-1:]], p)[:, 0])
    return v[picked]


def build(rows: DataFrame, metric, dim: int, n: int, block_rows: int = ROWS, pivots: int | None = None) -> PivotIndex:
    """Index n comparable rows (id, v, tag)."""
    spark = rows.sparkSession
    most = pivots or max(1, min(MOST_PIVOTS, n // ROWS_PER_PIVOT))
    points = chosen_pivots(rows, n, metric, dim, most)
    shared = spark.sparkContext.broadcast(points)

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                away = _to_pivots(matrix(part.v), shared.value, metric)
                cell = away.argmin(1)
                yield part.assign(cell=cell.astype("int32"), away=away[np.arange(len(part)), cell])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.select("id", "v", "tag").dtypes)
    placed = materialize(rows.select("id", "v", "tag").mapInPandas(place, f"{kinds}, cell int, away double"), "placed")
    shares = [(i + 1) / MOST_RINGS for i in range(MOST_RINGS - 1)]
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("away", shares, 4 * MOST_RINGS).alias("cuts"))
    wanted = F.least(F.lit(MOST_RINGS), F.ceil(F.col("n") / block_rows))
    cells = cells.select("cell", "cuts", wanted.alias("rings"))
    # one row a pivot
    ringed = placed.join(F.broadcast(cells), "cell").withColumn("ring", F.expr(f"cast(size(filter(cuts, c -> c < away)) * rings / {MOST_RINGS} as int)"))
    blocks = ringed.groupBy("cell", "ring").agg(F.min("away").alias("low"), F.max("away").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("cell", "ring").collect()
    numbers = spark.createDataFrame([(r["cell"], r["ring"], i) for i, r in enumerate(blocks)], "cell int, ring int, block int")
    at = lambda c: np.array([r[c] for r in blocks])
    return PivotIndex(ringed.join(F.broadcast(numbers), ["cell", "ring"]).select("id", "v", "tag", "block"), metric, points, at("cell").astype(int), at("low"), at("high"), at("n"), block_rows)


def visits(index: PivotIndex, queries: DataFrame, within: str | None = None, least_rows: int = 0) -> DataFrame:
    """queries (id, v, ...) with blocks, the array of the blocks that each has to visit:
    those that may hold a row at a distance of at most its column `within`, or, without
    that column, the most promising ones with least_rows rows together."""
    shared = queries.sparkSession.sparkContext.broadcast((index.pivots, index.cell, index.low, index.high, index.size))
    metric, block_rows = index.metric, index.block_rows

    def pick(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = PivotIndex(None, metric, *shared.value, block_rows)
        for whole in parts:
            for at in range(0, len(whole), 500):
                part = whole.iloc[at : at + 500]
                bound = own.bounds(matrix(part.v))
                if within is None:
                    order = np.argsort(bound, axis=1, kind="stable")
                    enough = np.cumsum(own.size[order], 1) >= least_rows
                    count = np.where(enough.any(1), enough.argmax(1) + 1, bound.shape[1])
                    found = [o[:c] for o, c in zip(order, count)]
                else:
                    found = [np.flatnonzero(b) for b in bound <= own.reach(part[within].to_numpy(float))[:, None]]
                yield part.assign(blocks=[f.astype("int32") for f in found])

    kinds = ", ".join(f"`{c}` {t}" for c, t in queries.dtypes)
    return queries.mapInPandas(pick, f"{kinds}, blocks array<int>")


def meet(index: PivotIndex, visitors: DataFrame, fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Union of fn(visitors, rows) over all visited blocks. visitors are (id, v, tag,
    blocks), rows (id, v, tag). No task holds more than a bounded part of either side:
    crowded blocks and blocks with many visitors are dealt out by hashes of the ids."""
    came = visitors.select("id", "v", "tag", F.explode("blocks").alias("block"))
    many = came.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / index.block_rows).cast("int").alias("guests"))
    sizes = visitors.sparkSession.createDataFrame([(i, -(-int(n) // (2 * index.block_rows))) for i, n in enumerate(index.size)], "block int, parts int")
    deal = F.broadcast(many.join(sizes, "block"))  # one row a block, at most MOST_PIVOTS * MOST_RINGS
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = came.join(deal, "block").select("id", "v", "tag", "block", every("parts").alias("part"), part("guests").alias("guest"), F.lit(0).alias("side"))
    b = index.rows.join(deal, "block").select("id", "v", "tag", "block", part("parts").alias("part"), every("guests").alias("guest"), F.lit(1).alias("side"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return fn(rows[rows.side == 0], rows[rows.side == 1])

    return a.unionByName(b).groupBy("block", "part", "guest").applyInPandas(run, schema)


def nearest_blocks(k: int, metric) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """fn(queries, rows): (id, other, tag, distance) of the k nearest rows to each query."""

    def top(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = {"id": [], "other": [], "tag": [], "distance": []}
        if len(a) and len(b):
            b = b.sort_values("id")
            d = distances(matrix(a.v), matrix(b.v), metric)
            d[a.id.to_numpy()[:, None] == b.id.to_numpy()[None, :]] = np.nan  # sorts last
            at = np.argsort(d, axis=1, kind="stable")[:, :k]
            out = {"id": np.repeat(a.id.to_numpy(), at.shape[1]), "other": b.id.to_numpy()[at].ravel(), "tag": b.tag.to_numpy()[at].ravel(), "distance": np.take_along_axis(d, at, 1).ravel()}
        return pd.DataFrame(out)

    return top


def nearest(index: PivotIndex, queries: DataFrame, k: int) -> DataFrame:
    """(id, other, tag, distance): of each query (id, v) its k nearest rows are among
    these. A first round looks in the nearest blocks and so bounds the distance of the
    k-th; a second visits the other blocks that may hold a nearer row."""
    kind = dict(index.rows.dtypes)["tag"]
    schema = f"id long, other long, tag {kind}, distance double"
    asked = queries.select("id", "v", F.lit(None).cast(kind).alias("tag"))
    first = materialize(visits(index, asked, least_rows=k + 1), "visits")
    found = materialize(meet(index, first, nearest_blocks(k, index.metric), schema).where("id <> other"), "found")
    order = Window.partitionBy("id").orderBy("distance", "other")
    kth = found.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("id", F.col("distance").alias("kth"))
    bounded = first.withColumnRenamed("blocks", "seen").join(kth, "id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("inf"))))
    again = visits(index, bounded, within="kth").withColumn("blocks", F.array_except("blocks", "seen")).where("size(blocks) > 0")
    again = materialize(again.select("id", "v", "tag", "blocks"), "visits")
    return found.unionByName(meet(index, again, nearest_blocks(k, index.metric), schema).where("id <> other"))
