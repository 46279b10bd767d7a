import numpy as np
import pytest

from quarry.operators import clusters, density, pivots
from quarry.operators.vectors import distances


def plain(ids, v, radius, min_points, p):
    """Clusters by growing each from its smallest core."""
    near = distances(v, v, p) <= radius
    np.fill_diagonal(near, True)
    core = near.sum(1) >= min_points
    cluster, n = {}, 0
    for i in range(len(ids)):
        if core[i] and i not in cluster:
            n += 1
            todo = [i]
            while todo:
                x = todo.pop()
                if cluster.get(x, n) != n or (x in cluster and not core[x]):
                    continue
                cluster[x] = n
                if core[x]:
                    todo += [y for y in np.flatnonzero(near[x]) if y not in cluster]
    return {int(ids[i]): cluster.get(i, -1) for i in range(len(ids))}


def some_points(seed, dim, n=300):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) * rng.choice([0.2, 1.0], (n, 1)) + rng.choice([0, 4, 9], (n, dim), p=[0.6, 0.3, 0.1])
    v[: n // 4] = v[0]  # copies
    v[n // 4 : n // 3] = np.round(v[n // 4 : n // 3])  # on the edges of cells
    return np.arange(n) * 3 + 1, v


def frame(spark, ids, v):
    return spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "id long, v array<double>")


@pytest.mark.parametrize("dim, p, radius, min_points", [(1, 2, 0.1, 4), (2, 2, 0.7, 6), (2, 1, 1.0, 5), (3, 2, 1.0, 8), (3, 3, 1.0, 3), (2, 2, 0.5, 1), (5, 2, 1.5, 6), (5, 1, 3.0, 6), (5, "cosine", 0.05, 9), (2, "cosine", 0.001, 4)])
def test_clusters_against_plain_growth(spark, monkeypatch, dim, p, radius, min_points):
    monkeypatch.setattr(density, "CELL_BLOCK", 7)  # crowded cells in blocks
    monkeypatch.setattr(density, "RIM_BLOCK", 5)
    monkeypatch.setattr(density, "RANKED_AT_ONCE", 3)
    monkeypatch.setattr(pivots, "ROWS_PER_PIVOT", 40)
    ids, v = some_points(dim, dim)
    got = {r.id: r.cluster for r in density.dbscan(frame(spark, ids, v), radius, min_points, p).collect()}
    assert got == plain(ids, v, radius, min_points, p) and len(set(got.values())) > 1


def test_cells_that_only_inner_points_link(spark, monkeypatch):
    """Two clouds whose outermost points are far from each other, but not their rims."""
    looked = []
    inner = density._looked_into
    monkeypatch.setattr(density, "_looked_into", lambda *a: looked.append(1) or inner(*a))
    rng = np.random.default_rng(1)
    # in each cell the points that reach out most, along the axes, are not the ones that meet
    a = np.concatenate([rng.uniform(0.0, 0.02, (40, 2)), [[0.65, 0.0], [0.0, 0.65], [0.6, 0.6]]])
    b = np.concatenate([1.4 - rng.uniform(0.0, 0.02, (40, 2)), [[1.4 - 0.65, 1.4], [1.4, 1.4 - 0.65], [1.4 - 0.6, 1.4 - 0.6]]])
    v = np.concatenate([a, b])
    for radius in (1.0, 0.35, 0.28, 0.2):
        ids = np.arange(len(v))
        got = {r.id: r.cluster for r in density.dbscan(frame(spark, ids, v), radius, 2).collect()}
        assert got == plain(ids, v, radius, 2, 2)
    assert looked


def test_a_crowd_needs_no_pairs(spark):
    """A cell of 100,000 points is cores without a distance; work is in proportion to it."""
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.uniform(0, 0.5, (100_000, 2)), [[5.0, 5.0], [0.9, 0.9], [1.2, 1.2]]])
    got = {r.id: r.cluster for r in density.dbscan(frame(spark, np.arange(len(v)), v), 1.0, 50).collect()}
    assert all(got[i] == 1 for i in range(100_000)) and got[100_000] == -1 and got[100_001] == 1 and got[100_002] in (1, -1)


@pytest.mark.parametrize("dim, p, radius", [(2, 2, 0.7), (3, 1, 1.0), (5, 2, 1.5), (4, "cosine", 0.1)])
def test_neighbours_against_all_pairs(spark, monkeypatch, dim, p, radius):
    monkeypatch.setattr(density, "CELL_BLOCK", 7)
    monkeypatch.setattr(pivots, "ROWS_PER_PIVOT", 40)
    ids, v = some_points(7, dim, 150)
    near = distances(v, v, p) <= radius
    np.fill_diagonal(near, True)
    got = sorted(map(tuple, density.neighbours_within(frame(spark, ids, v), radius, p).collect()))
    assert got == sorted((int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(near)))


ODD = [(900, None), (901, []), (902, [1.0]), (903, [1.0, None]), (904, [float("nan"), 1.0]), (905, [1.0, float("-inf")])]


def test_odd_vectors(spark):
    ids, v = some_points(3, 2, 60)
    good = frame(spark, ids, v)
    points = good.union(spark.createDataFrame(ODD, good.schema))
    clean = {r.id: r.cluster for r in density.dbscan(good, 0.7, 4).collect()}
    assert {r.id: r.cluster for r in density.dbscan(points, 0.7, 4).collect()} == clean | {i: -1 for i, _ in ODD}
    assert {r.a for r in density.neighbours_within(points, 0.7).where("a >= 900 and a = b").collect()} == {i for i, _ in ODD}
    for metric in (2, "cosine"):
        away = clusters.assigned(points, [[1.0, 0.0], [0.0, 1.0]], metric).collect()
        assert len(away) == points.count() and {r.id for r in away if r.cluster is None} == {i for i, _ in ODD}
        assert clusters.kmeans(points, [[1.0, 0.0], [5.0, 5.0]], metric) == clusters.kmeans(good, [[1.0, 0.0], [5.0, 5.0]], metric)
        assert clusters.spread_centroids(points, 3, metric) == clusters.spread_centroids(good, 3, metric)
    assert clusters.random_centroids(points, 3) == clusters.random_centroids(good, 3)
    nothing = spark.createDataFrame(ODD, good.schema)
    assert {r.cluster for r in density.dbscan(nothing.limit(1), 1.0, 2).collect()} == {-1} and density.dbscan(good.limit(0), 1.0, 2).count() == 0
    assert clusters.kmeans(nothing, [[1.0, 0.0]]) == [[1.0, 0.0]]
