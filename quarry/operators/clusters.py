"""k-means and principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.evaluate import place
from quarry.operators.rank import order_stats
from quarry.operators.vectors import can_compare, comparable, dimension, distances
from quarry.session import materialize

#: Vectors of a packed block, and numbers of the sums up to which tasks send theirs as they are.
BLOCK_ROWS = 2_000
DIRECT_CELLS = 20_000


def random_centroids(points: DataFrame, k: int, seed: int = 1) -> list[list[float]]:
    """The k points (id, v) whose seeded hashes are smallest, of those whose vectors can
    be compared."""
    points = comparable(points, dimension(points))
    return [list(r["v"]) for r in points.select("id", "v", place("id", seed).alias("h")).orderBy("h", "id").limit(k).collect()]


def spread_centroids(points: DataFrame, k: int, metric, first: int | None = None) -> list[list[float]]:
    """A first point (the smallest id unless given) and points at falling rank
    fractions of the distance to it: ranks int(n / k * i) - 1 for i = k, k - 1, ...;
    k in all, the first one included. Ties of a distance go to the smallest id. Points
    whose vectors cannot be compared are passed over."""
    points = comparable(points, dimension(points), metric)
    first = points.agg(F.min("id")).first()[0] if first is None else first
    seed = list(points.where(F.col("id") == first).first()["v"])
    away = assigned(points, [seed], metric).select("id", "distance")
    away = materialize(away, "away")
    ranks_of = lambda n: [int(n / k * i) - 1 for i in range(k, 0, -1)][: k - 1]
    n, at = order_stats(away, {"distance": F.col("distance")}, ranks_of)["distance"]
    ranks = ranks_of(n)
    out = [seed]
    for r in ranks:
        pick = away.where(F.col("distance") == at[r]).agg(F.min("id")).first()[0]
        out.append(list(points.where(F.col("id") == pick).first()["v"]))
    return out


def assigned(points: DataFrame, centroids: list[list[float]], metric) -> DataFrame:
    """(id, v, cluster, distance): the nearest centroid, ties to the lowest index. A
    vector that is null, not finite, of another length than the centroids, or zero by
    the cosine, has no cluster and no distance."""
    dim = len(centroids[0]) if len(centroids) else 0
    good = comparable(points, dim, metric)
    shared = points.sparkSession.sparkContext.broadcast(np.array(centroids, float))

    def run(batches):
        for part in batches:
            if len(part):
                d = distances(np.array(part.v.tolist(), float), shared.value, metric)
                at = np.where(np.isnan(d), np.inf, d).argmin(1)
                yield pd.DataFrame({"id": part.id, "v": part.v, "cluster": at.astype("int32"), "distance": d[np.arange(len(d)), at]})

    kind = dict(good.dtypes)
    found = good.select("id", "v").mapInPandas(run, f"id {kind['id']}, v {kind['v']}, cluster int, distance double")
    bad = points.where(~can_compare(dim, metric)).select("id", F.col("v").cast(kind["v"]).alias("v"), F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("distance"))
    return found.union(bad)


def packed(points: DataFrame, dim: int) -> DataFrame:
    """Vectors (v) as rows of blocks: bytes of up to BLOCK_ROWS vectors, one coordinate
    after the other, as 32-bit numbers where those hold every value of a block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                v = batch.column("v").slice(at, BLOCK_ROWS)
                x = np.ascontiguousarray(v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), dim).T)
                with np.errstate(over="ignore"):
                    short = x.astype(np.float32)
                x = short if (short == x).all() else x
                yield pa.RecordBatch.from_pydict({"rows": pa.array([len(v)], pa.int32()), "x": pa.array([x.tobytes()], pa.binary())})

    return points.select("v").mapInArrow(pack, "rows int, x binary")


def _unpacked(rows: int, x: bytes, dim: int) -> np.ndarray:
    """dim rows of a packed block, one for each coordinate, as doubles."""
    kind = np.float32 if len(x) == 4 * rows * dim else np.float64
    return np.frombuffer(x, kind).reshape(dim, rows).astype(float)


def _nearest_centroid(x: np.ndarray, centroids: np.ndarray, metric) -> np.ndarray:
    """The nearest centroid of vectors that are the columns of x. The terms of a
    distance are added up in the order of distances()."""
    if metric == "cosine":
        d = distances(x.T, centroids, metric)
        return np.where(np.isnan(d), np.inf, d).argmin(1)
    best, at = np.full(x.shape[1], np.inf), np.zeros(x.shape[1], np.int64)
    for j, c in enumerate(centroids):
        total, gap = np.zeros(x.shape[1]), np.empty(x.shape[1])
        for k in range(len(x)):
            np.abs(np.subtract(x[k], c[k], out=gap), out=gap)
            total += gap if metric == 1 else gap**metric
        away = total if metric == 1 else total ** (1 / metric)
        nearer = away < best
        best[nearer], at[nearer] = away[nearer], j
    return at


def cluster_means(blocks: DataFrame, centroids: np.ndarray, metric) -> dict[int, np.ndarray]:
    """The means of the points of packed blocks nearest to each centroid. A task adds up
    its points; sums go to the driver, added up by a shuffle before if they are many."""
    k, dim = centroids.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dim))
        for batch in batches:
            for rows, block in zip(batch.column("rows").to_pylist(), batch.column("x")):
                x = _unpacked(rows, block.as_buffer(), dim)
                at = _nearest_centroid(x, centroids, metric)
                n += np.bincount(at, minlength=k)
                for j in np.unique(at):
                    sums[j] += x[:, at == j].sum(1)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(met, pa.int32()), "n": pa.array(n[met]), "s": pa.array(sums[met].tolist(), pa.list_(pa.float64()))})

    parts = blocks.mapInArrow(add_up, "cluster int, n long, s array<double>")
    if k * dim > DIRECT_CELLS:
        cells = parts.select("cluster", "n", F.posexplode("s").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        parts = cells.groupBy("cluster").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("s"))
    n, sums = np.zeros(k, np.int64), np.zeros((k, dim))
    for r in parts.collect():
        n[r["cluster"]] += r["n"]
        sums[r["cluster"]] += np.array(r["s"])
    return {int(j): sums[j] / n[j] for j in np.flatnonzero(n)}


def kmeans(points: DataFrame, centroids: list[list[float]], metric=2, max_iterations: int = 100, tolerance: float = 1e-4) -> list[list[float]]:
    """Centroids after the moves' total length falls under the tolerance, or after
    max_iterations. Centroids are means whatever the metric; one that loses all its
    points stays; points whose vectors cannot be compared with the centroids count
    nowhere. Points are written to the shared folder once, packed; each round is one
    job without a shuffle."""
    dim = len(centroids[0]) if len(centroids) else 0
    blocks = packed(comparable(points, dim, metric), dim).repartition(points.sparkSession.sparkContext.defaultParallelism)
    blocks = materialize(blocks, "blocks")
    now = np.array(centroids, float)
    for _ in range(max_iterations):
        moved = now.copy()
        for cluster, mean in cluster_means(blocks, now, metric).items():
            moved[cluster] = mean
        shift, now = float(np.linalg.norm(moved - now)), moved
        if shift < tolerance:
            break
    return now.tolist()


def principal_components(df: DataFrame, columns: list[str], k: int = 2) -> tuple[list[float], list[list[float]]]:
    """Means and the k main axes of the centred columns, from one pass of sums;
    the largest entry of an axis is positive."""
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    shift = [F.col(c) - F.lit(float(means[c])) for c in columns]
    sums = df.agg(*[F.sum(shift[i] * shift[j]).alias(f"s{i}_{j}") for i in range(len(columns)) for j in range(i, len(columns))]).first()
    cov = np.zeros((len(columns), len(columns)))
    for i in range(len(columns)):
        for j in range(i, len(columns)):
            cov[i, j] = cov[j, i] = sums[f"s{i}_{j}"]
    values, axes = np.linalg.eigh(cov)
    picked = axes[:, np.argsort(-values, kind="stable")[:k]].T
    picked = [a * (1 if a[np.abs(a).argmax()] > 0 else -1) for a in picked]
    return [float(means[c]) for c in columns], [a.tolist() for a in picked]


def project(df: DataFrame, columns: list[str], means: list[float], axes: list[list[float]]) -> DataFrame:
    """Add pc1, pc2, ... : the centred columns along the axes."""
    out = {}
    for n, axis in enumerate(axes, 1):
        terms = [F.lit(w) * (F.col(c) - F.lit(m)) for c, m, w in zip(columns, means, axis)]
        out[f"pc{n}"] = sum(terms[1:], terms[0])
    return df.withColumns(out)
