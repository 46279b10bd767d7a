import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import pairwise, pivots
from quarry.operators.vectors import distances


def clustered(seed, n=400, dim=5, centres=12):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, dim)) * 40
    v = at[rng.integers(0, centres, n)] + rng.normal(size=(n, dim))
    v[: n // 4] = v[0]  # copies
    return v


def frame(spark, v):
    return spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)], "id long, v array<double>, tag int")


def plain(v, queries, k, metric):
    d = distances(v[queries], v, metric)
    out = []
    for q, row in zip(queries, d):
        row[q] = np.nan
        order = [i for i in np.lexsort((np.arange(len(v)), np.round(row, 9))) if i != q][:k]
        out += [(q, round(float(row[i]), 9), r) for r, i in enumerate(order, 1)]
    return sorted(out)


@pytest.mark.parametrize("metric", [2, 1, "cosine", 3, 0.5])
def test_nearest_against_all_pairs(spark, metric):
    v = clustered(3)
    rows = frame(spark, v)
    got = pairwise.nearest(rows.where("id % 7 = 0"), rows, 4, metric, block_rows=16, pivots=9).collect()
    mine = sorted((r.id, round(r.distance, 9), r["rank"]) for r in got)
    assert [x[::2] for x in mine] == [x[::2] for x in plain(v, list(range(0, len(v), 7)), 4, metric)]
    assert [x[1] for x in mine] == pytest.approx([x[1] for x in plain(v, list(range(0, len(v), 7)), 4, metric)], abs=1e-7)
    assert all(r.tag == r.other % 3 and r.id != r.other for r in got)


def test_ties_go_to_the_smaller_id(spark):
    v = np.repeat(np.arange(6.0), 20)[:, None]
    rows = frame(spark, v)
    got = pairwise.nearest(rows.where("id in (0, 50, 119)"), rows, 3, 2, block_rows=8, pivots=4).orderBy("id", "rank").collect()
    assert [(r.id, r.other) for r in got] == [(0, 1), (0, 2), (0, 3), (50, 40), (50, 41), (50, 42), (119, 100), (119, 101), (119, 102)]


def test_few_blocks_are_visited(spark):
    v = clustered(8, n=3000, dim=16, centres=40)
    rows = frame(spark, v).cache()
    index = pivots.build(rows, 2, 16, len(v), block_rows=50, pivots=40)
    first = pivots.visits(index, rows, least_rows=4)
    second = pivots.visits(index, rows.withColumn("kth", F.lit(8.0)), within="kth")
    every = len(v) * len(index.cell)
    seen = first.agg(F.sum(F.size("blocks"))).first()[0] + second.agg(F.sum(F.size("blocks"))).first()[0]
    assert seen < every / 5
    assert sum(index.size) == len(v) and index.rows.count() == len(v)


def test_bounds_never_exceed_a_distance(spark):
    for metric in (1, 2, "cosine"):
        v = clustered(5, n=300)
        index = pivots.build(frame(spark, v), metric, 5, len(v), block_rows=10, pivots=12)
        block = {r.id: r.block for r in index.rows.collect()}
        at = np.array([block[i] for i in range(len(v))])
        bound = index.bounds(v)
        d = index.reach(distances(v, v, metric))
        assert (bound[:, at] <= d).all()


ODD = [(900, None, 0), (901, [], 0), (902, [1.0] * 4, 0), (903, [1.0, None, 1.0, 1.0, 1.0], 0), (904, [float("nan")] * 5, 0), (905, [float("inf")] * 5, 0), (906, [0.0] * 5, 0)]


@pytest.mark.parametrize("block_rows", [16, 5000])
def test_odd_vectors_are_near_nothing(spark, block_rows):
    v = clustered(3, n=120)
    rows = frame(spark, v)
    odd = rows.union(spark.createDataFrame(ODD, rows.schema))
    ask = lambda side: pairwise.knn(side, side, 3, "cosine") if block_rows > 1000 else pairwise.vote(pairwise.nearest(side, side, 3, "cosine", block_rows=block_rows, pivots=4), 3)
    assert sorted(map(tuple, ask(odd).collect())) == sorted(map(tuple, ask(rows).collect()))
    nothing = spark.createDataFrame(ODD[:6], rows.schema)
    assert pairwise.knn(nothing, nothing, 3, 2).count() == 0 and pairwise.knn(rows.limit(0), rows, 3, 2).count() == 0
