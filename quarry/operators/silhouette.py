"""Silhouettes without the distances of all pairs.

By the cosine, a point's distances to a cluster add up to its size less the product of
the point's direction with the cluster's summed directions. By the Manhattan distance
they add up coordinate by coordinate from how many of the cluster's values lie below
and what those sum to. Both are exact and move a fixed number of rows a point. Other
distances hold blocks against blocks, each pair once, or estimate from a sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.vectors import TILE, comparable, dimension, matrix, tiled_distances
from quarry.session import materialize

#: Numbers of the summed directions that are broadcast at a time.
BROADCAST_CELLS = 2_000_000
#: Values of a coordinate that one task sorts, and clusters whose sums it takes along.
BUCKET_VALUES = 50_000
MOST_BUCKETS = 4_096
CLUSTER_BLOCK = 32
#: Points of a block of all pairs, and blocks that there are if they can be of fewer.
MOST_ROWS = 20_000
LEAST_ROWS = 2_000
LEAST_BLOCKS = 16
_PARTS = pa.schema([("id", pa.int64()), ("own", pa.int32()), ("other", pa.int32()), ("s", pa.float64()), ("n", pa.int64()), ("b", pa.float64())])
_FOUND = "id long, own int, size long, a double, b double"


def _nearest_of(sums: np.ndarray, sizes: np.ndarray, tags: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """size, a and b of points from their summed distances to some clusters; nan where
    those hold no answer."""
    mine = own[:, None] == tags[None, :]
    here = mine.any(1)
    at = mine.argmax(1)
    rows = np.arange(len(own))
    size = np.where(here, sizes[at], 0)
    a = np.where(here, np.where(size > 1, sums[rows, at] / np.maximum(size - 1, 1), 0.0), np.nan)
    b = np.where(mine, np.inf, sums / sizes[None, :]).min(1)
    return size, a, np.where(np.isinf(b), np.nan, b)


def _merged(parts: DataFrame) -> DataFrame:
    """One row a point from what each block of clusters told of it."""
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    return parts.groupBy("id", "own").agg(F.max("size").alias("size"), F.max(known("a")).alias("a"), F.coalesce(F.min(known("b")), F.lit(0.0)).alias("b"))


def _cosine(points: DataFrame, dim: int) -> DataFrame:
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def flushed() -> pa.RecordBatch:
            rows = np.array(list(sums.values())).reshape(-1, dim + 1)
            found = pa.RecordBatch.from_pydict({"tag": pa.array(list(sums), pa.int32()), "s": pa.array(rows.tolist(), pa.list_(pa.float64()))})
            sums.clear()
            return found

        for batch in batches:
            x = _directions(batch, dim)
            tags = batch.column("tag").to_numpy()
            for t in np.unique(tags).tolist():
                sums[t] = sums.get(t, 0) + np.append(x[tags == t].sum(0), (tags == t).sum())
            if len(sums) * dim > BROADCAST_CELLS:
                yield flushed()
        yield flushed()

    parts = points.select("v", "tag").mapInArrow(add_up, "tag int, s array<double>")
    cells = parts.select("tag", F.posexplode("s").alias("i", "x")).groupBy("tag", "i").agg(F.sum("x").alias("x"))
    clusters = materialize(cells.groupBy("tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("s")), "directions")
    blocks = max(1, -(-clusters.count() * dim // BROADCAST_CELLS))
    out = None
    for k in range(blocks):
        rows = clusters.where(F.pmod(F.xxhash64("tag"), F.lit(blocks)) == k).orderBy("tag").collect()
        if not rows:
            continue
        table = np.array([r["s"] for r in rows])
        shared = points.sparkSession.sparkContext.broadcast((np.array([r["tag"] for r in rows]), table[:, :dim], table[:, dim]))

        def hold(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tags, sums, sizes = shared.value
            for batch in batches:
                if batch.num_rows:
                    own = batch.column("tag").to_numpy()
                    size, a, b = _nearest_of(sizes[None, :] - _directions(batch, dim) @ sums.T, sizes, tags, own)
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tag"), pa.array(size.astype(np.int64)), pa.array(a), pa.array(b)], names=["id", "own", "size", "a", "b"])

        found = points.select("id", "v", "tag").mapInArrow(hold, _FOUND)
        out = found if out is None else out.unionByName(found)
    return _merged(out)


def _directions(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _manhattan(points: DataFrame, dim: int) -> DataFrame:
    points = materialize(points.select("id", "v", "tag"), "points")
    sizes = points.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["tag"]: r["n"] for r in sizes.collect()}  # one row a cluster
    edges = _edges(points, dim, sum(sizes.values()))
    tags, out = sorted(sizes), None
    for at in range(0, len(tags), CLUSTER_BLOCK):
        some = tags[at : at + CLUSTER_BLOCK]
        summed = _summed_by_coordinate(points, dim, edges, some)
        block = (np.array(some), np.array([sizes[t] for t in some], float))

        def hold(parts: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            for part in parts:
                if len(part):
                    size, a, b = _nearest_of(matrix(part.s), block[1], block[0], part.own.to_numpy())
                    yield pd.DataFrame({"id": part.id, "own": part.own, "size": size.astype("int64"), "a": a, "b": b})

        found = summed.mapInPandas(hold, _FOUND)
        out = found if out is None else out.unionByName(found)
    return _merged(out)


def _edges(points: DataFrame, dim: int, n: int) -> list[np.ndarray]:
    """Values that cut each coordinate into stretches of about BUCKET_VALUES points. A
    value that is an edge is a bucket of its own, however often it comes."""
    cuts = min(MOST_BUCKETS, -(-n // BUCKET_VALUES)) - 1
    if cuts < 1:
        return [np.zeros(0)] * dim
    shares = [(i + 1) / (cuts + 1) for i in range(cuts)]
    row = points.agg(*[F.percentile_approx(F.col("v")[t], shares, 20 * (cuts + 1)).alias(f"t{t}") for t in range(dim)]).first()
    return [np.unique(row[t]) for t in range(dim)]


def _summed_by_coordinate(points: DataFrame, dim: int, edges: list[np.ndarray], tags: list[int]) -> DataFrame:
    """(id, own, s): for every point its summed distances to each of the clusters."""
    k = len(tags)
    shared = points.sparkSession.sparkContext.broadcast((edges, np.array(tags)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, some = shared.value
        for batch in batches:
            n = batch.num_rows
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
            own = batch.column("tag").to_numpy()
            number = np.searchsorted(some, own)
            number = np.where(some[np.minimum(number, k - 1)] == own, number, -1)
            for t in range(dim):
                at = np.searchsorted(cuts[t], x[:, t])
                on_edge = cuts[t][np.minimum(at, len(cuts[t]) - 1)] == x[:, t] if len(cuts[t]) else np.zeros(n, bool)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("tag"), pa.array(np.full(n, t, np.int32)), pa.array((2 * at + on_edge).astype(np.int32)), pa.array(x[:, t]), pa.array(number.astype(np.int32))],
                    names=["id", "own", "t", "bucket", "x", "c"],
                )

    cells = points.mapInArrow(spread, "id long, own int, t int, bucket int, x double, c int")
    of_cluster = cells.where("c >= 0").groupBy("t", "bucket", "c").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("x").alias("sum"))
    everywhere = cells.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rows") / BUCKET_VALUES)).cast("int")
    # a bucket between edges is sorted whole; one value's bucket needs no order and is dealt out
    everywhere = everywhere.select("t", "bucket", F.when(F.col("bucket") % 2 == 1, parts).otherwise(1).alias("parts"))
    table = F.array_sort(F.collect_list(F.struct("c", "n", "sum")))
    counted = materialize(everywhere.join(of_cluster.groupBy("t", "bucket").agg(table.alias("held")), ["t", "bucket"], "left"), "buckets")
    spine = counted.select("t", "bucket", "parts", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("c"), F.coalesce("held", F.array().cast("array<struct<c:int,n:double,sum:double>>")).alias("held"))
    mine = F.try_element_at(F.filter("held", lambda h: h["c"] == F.col("c")), F.lit(1))
    flat = spine.withColumn("mine", mine).select("t", "bucket", "parts", "c", F.coalesce("mine.n", F.lit(0.0)).alias("n"), F.coalesce("mine.sum", F.lit(0.0)).alias("sum"))
    before = Window.partitionBy("t", "c").orderBy("bucket")
    upto, whole = before.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("t", "c")
    placed = flat.select(
        "t", "bucket", "parts", "c", "n",
        F.coalesce(F.sum("n").over(upto), F.lit(0.0)).alias("n0"), F.coalesce(F.sum("sum").over(upto), F.lit(0.0)).alias("s0"),
        F.sum("n").over(whole).alias("n1"), F.sum("sum").over(whole).alias("s1"),
    )
    offsets = placed.groupBy("t", "bucket", "parts").agg(F.array_sort(F.collect_list(F.struct("c", "n", "n0", "s0", "n1", "s1"))).alias("o"))
    offsets = offsets.select("t", "bucket", "o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = cells.join(F.broadcast(counted.where("parts > 1").select("t", "bucket", "parts")), ["t", "bucket"], "left")  # crowded values: few
    dealt = dealt.withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")).drop("parts")

    def add_up(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"id": [], "own": [], "s": []})
        n, n0, s0, n1, s1 = np.array([[o[f] for f in ("n", "n0", "s0", "n1", "s1")] for o in known.o.iloc[0]]).T
        x, c = rows.x.to_numpy(), rows.c.to_numpy()
        if rows.bucket.iloc[0] % 2:  # equal values add nothing, on whichever side they are counted
            below, sums = np.broadcast_to(n0 + n, (len(x), k)), s0 + n * x[0]
            sums = np.broadcast_to(sums, (len(x), k))
        else:
            order = np.argsort(x, kind="stable")
            mine = np.zeros((len(x), k))
            inside = c[order] >= 0
            mine[np.flatnonzero(inside), c[order][inside]] = 1
            below, sums = np.empty((len(x), k)), np.empty((len(x), k))
            below[order] = n0 + np.cumsum(mine, 0)
            sums[order] = s0 + np.cumsum(mine * x[order][:, None], 0)
        s = x[:, None] * (2 * below - n1) + s1 - 2 * sums
        return pd.DataFrame({"id": rows.id, "own": rows.own, "s": list(s)})

    by = ["t", "bucket", "part"]
    parts = dealt.groupBy(*by).cogroup(offsets.groupBy(*by)).applyInPandas(add_up, "id long, own int, s array<double>")
    return parts.groupBy("id", "own").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(k)]).alias("s"))


def _by_blocks(points: DataFrame, metric, dim: int) -> DataFrame:
    """Every pair of points is held once, in the pair of their blocks. A large cluster
    fills blocks of its own, which return a sum a point; small ones share a block whole,
    which returns a point's sum to its own cluster and its least mean to the others."""
    points = materialize(points.select("id", "v", "tag"), "points")
    sizes = materialize(points.groupBy("tag").agg(F.count(F.lit(1)).alias("n")), "sizes")
    n = sizes.agg(F.sum("n")).first()[0] or 0
    rows = int(min(MOST_ROWS, max(LEAST_ROWS, n / LEAST_BLOCKS)))
    large = sizes.where(F.col("n") > rows / 2).orderBy("tag").collect()  # at most two a block
    table, blocks = [], 0
    for r in large:
        parts = -(-r["n"] // rows)
        table.append((r["tag"], blocks, parts))
        blocks += parts
    shared = -(-(n - sum(r["n"] for r in large)) // rows)
    first, blocks = blocks, blocks + shared
    known = points.join(F.broadcast(points.sparkSession.createDataFrame(table, "tag int, first int, parts int")), "tag", "left")
    alone = F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))
    block = F.when(F.col("first").isNotNull(), alone).otherwise(F.lit(first) + F.pmod(F.xxhash64("tag"), F.lit(max(1, shared)))).cast("int")
    dealt = known.select("id", "v", "tag", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(max(1, blocks) - 1))).alias("other"))
    dealt = dealt.select("id", "v", "tag", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def side(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, tags = rows.column("id").to_numpy(), rows.column("tag").to_numpy()
        v = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
        order = np.argsort(tags, kind="stable")
        return ids[order], tags[order], v[order]

    def sums(rows: pa.Table) -> pa.Table:
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        block = rows.column("block").to_numpy()
        a = side(rows.filter(pa.array(block == i)))
        b = a if i == j else side(rows.filter(pa.array(block == j)))
        out = []
        if not len(a[0]) or not len(b[0]):
            pass
        elif i == j:
            out.append(_to_tags(a, a, metric) if i >= first else _to_one(a, a, metric)[0])
        elif j < first:
            out += _to_one(a, b, metric)
        else:
            out += [_to_tags(a, b, metric), _to_tags(b, a, metric) if i >= first else _to_one(b, a, metric)[0]]
        return pa.concat_tables(out) if out else _PARTS.empty_table()

    found = dealt.groupBy("i", "j").applyInArrow(sums, "id long, own int, other int, s double, n long, b double")
    whole = found.groupBy("id", "own", "other").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.min("b").alias("b"))
    mine = F.col("own") == F.col("other")
    a = F.max(F.when(mine, F.coalesce(F.try_divide(F.col("s"), F.col("n") - 1), F.lit(0.0))))
    b = F.least(F.min(F.when(~mine, F.col("s") / F.col("n"))), F.min("b"))
    return whole.groupBy("id", "own").agg(F.max(F.when(mine, F.col("n"))).alias("size"), a.alias("a"), F.coalesce(b, F.lit(0.0)).alias("b"))


def _part(ids: np.ndarray, own: np.ndarray, other, s=None, n=None, b=None) -> pa.Table:
    of = lambda x, t: pa.nulls(len(ids), t) if x is None else pa.array(np.broadcast_to(x, len(ids)), t)
    return pa.Table.from_arrays([of(ids, pa.int64()), of(own, pa.int32()), of(other, pa.int32()), of(s, pa.float64()), of(n, pa.int64()), of(b, pa.float64())], schema=_PARTS)


def _to_one(a: tuple, b: tuple, metric) -> list[pa.Table]:
    """The summed distances of a's points to all of b, which is of one cluster, and of
    b's points to all of a."""
    to_b, to_a = np.zeros(len(a[0])), np.zeros(len(b[0]))
    for rows, columns, d in tiled_distances(a[2], b[2], metric):
        to_b[rows] += d.sum(1)
        to_a[columns] += d.sum(0)
    return [_part(a[0], a[1], b[1][0], to_b, len(b[0])), _part(b[0], b[1], a[1][0], to_a, len(a[0]))]


def _to_tags(a: tuple, b: tuple, metric) -> pa.Table:
    """Of a's points the sums to their own cluster, if it is in b, and the least mean
    distance to another; b's clusters are whole."""
    tags, starts, sizes = np.unique(b[1], return_index=True, return_counts=True)
    out = []
    for at in range(0, len(a[0]), TILE[0]):
        ids, own, v = (x[at : at + TILE[0]] for x in a)
        d = np.empty((len(ids), len(b[0])))
        for rows, columns, tile in tiled_distances(v, b[2], metric):
            d[rows, columns] = tile
        s = np.add.reduceat(d, starts, axis=1)
        place = np.minimum(np.searchsorted(tags, own), len(tags) - 1)
        here = tags[place] == own
        means = s / sizes[None, :]
        means[np.flatnonzero(here), place[here]] = np.inf
        out.append(_part(ids[here], own[here], own[here], s[np.flatnonzero(here), place[here]], sizes[place[here]]))
        least = means.min(1)
        other = np.isfinite(least)
        out.append(_part(ids[other], own[other], None, b=least[other]))
    return pa.concat_tables(out)


def cluster_distances(points: DataFrame, metric, closed_form: bool = True) -> DataFrame:
    """(id, own, size, a, b): of every point (id, v, tag) its cluster and that cluster's
    size, the mean distance to its cluster's others (0 if it has none) and the least
    mean distance to another cluster (0 where there is none).

    Ids are unique. Points without a cluster, and vectors that are null, of another
    length than most, not finite, or zero by the cosine, are left out. The metrics
    "cosine" and 1 take time in proportion to points times clusters; any other order of
    a Minkowski distance takes the square of the points.
    """
    dim = dimension(points)
    points = comparable(points, dim, metric).where("tag is not null").select(F.col("id").cast("long").alias("id"), "v", F.col("tag").cast("int").alias("tag"))
    if not closed_form or metric not in ("cosine", 1) or points.isEmpty():
        return _by_blocks(points, metric, dim)
    return _cosine(points, dim) if metric == "cosine" else _manhattan(points, dim)


def silhouette(points: DataFrame, metric, sample: float | None = None, seed: int = 1) -> DataFrame:
    """One row: silhouette (mean), sum_a and sum_b (points alone in their cluster add
    nothing to either), over the points that cluster_distances keeps; null where it
    keeps none. With a sample (a share of the points, by a seeded hash of the id) it is
    an estimate from the points drawn, each held against the others drawn; use it for
    Euclidean distances of many points."""
    if sample is not None:
        points = points.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(sample * (1 << 30)))
    per = cluster_distances(points, metric)
    alone = F.col("size") == 1
    s = F.when(alone, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return per.agg(F.avg(s).alias("silhouette"), F.sum(F.when(~alone, F.col("a")).otherwise(0.0)).alias("sum_a"), F.sum(F.when(~alone, F.col("b")).otherwise(0.0)).alias("sum_b"))
