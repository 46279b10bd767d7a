import numpy as np
import pytest

from quarry.operators import silhouette as S
from quarry.operators import vectors
from tests.test_silhouette import frame, plain, points_of


@pytest.mark.parametrize("rows", [7, 30, 60])
@pytest.mark.parametrize("metric", [2, 3])
def test_blocks_of_large_and_small_clusters(spark, monkeypatch, rows, metric):
    monkeypatch.setattr(S, "LEAST_ROWS", rows)  # clusters that fill several blocks, and some that share one
    monkeypatch.setattr(S, "MOST_ROWS", rows)
    monkeypatch.setattr(S, "TILE", (5, 11))
    monkeypatch.setattr(vectors, "TILE", (5, 11))
    ids, v, tags = points_of(6, n=120)
    tags[:70] = 0
    got = {r.id: (r.own, r.size, r.a, r.b) for r in S.cluster_distances(frame(spark, ids, v, tags), metric).collect()}
    expected = plain(ids, v, tags, metric)
    assert got.keys() == expected.keys()
    for i in ids.tolist():
        assert got[i][:2] == expected[i][:2] and got[i][2:] == pytest.approx(expected[i][2:], abs=1e-9), i


def test_each_pair_is_held_once(spark, monkeypatch):
    """Rows of the blocks: as many as blocks a point, not two for every pair of blocks."""
    monkeypatch.setattr(S, "LEAST_ROWS", 10)
    ids, v, tags = points_of(6, n=160)
    plan = S.cluster_distances(frame(spark, ids, v, tags * 0), 2)._jdf.queryExecution().toString()
    assert "Union" not in plan and "FlatMapGroupsInArrow" in plan


def test_near_points_far_from_the_origin():
    rng = np.random.default_rng(3)
    a = 1e6 + rng.normal(size=(300, 8))
    b = np.vstack([a[:50], a[50:90] + 1e-7, 1e6 + rng.normal(size=(1100, 8)), np.full((3, 8), -1e6)])
    for v, w in ((a, b), (a * 0, a * 0), (a * 1e200, b)):
        d = np.full((len(v), len(w)), np.nan)
        for rows, columns, tile in vectors.tiled_distances(v, w, 2):
            d[rows, columns] = tile
        with np.errstate(over="ignore"):
            assert np.allclose(d, vectors.distances(v, w, 2), rtol=1e-8, atol=0)
