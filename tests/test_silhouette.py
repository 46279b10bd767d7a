import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import silhouette as S
from quarry.operators.vectors import distances


def plain(ids, v, tags, metric):
    d = distances(v, v, metric)
    out = {}
    for i, own in enumerate(tags):
        mine = tags == own
        a = d[i, mine].sum() / (mine.sum() - 1) if mine.sum() > 1 else 0.0
        b = min((d[i, tags == t].mean() for t in set(tags.tolist()) - {own}), default=0.0)
        out[ids[i]] = (own, mine.sum(), a, b)
    return out


def points_of(seed, n=160, dim=3, clusters=5):
    rng = np.random.default_rng(seed)
    v = rng.integers(-3, 4, (n, dim)).astype(float) + np.where(rng.random((n, dim)) < 0.4, 0, rng.normal(size=(n, dim)))
    v[: n // 3] = [2.0, 0.5, -1.0]  # a third are copies
    v[~v.any(1)] = 1.0
    tags = rng.integers(0, clusters, n)
    tags[-1] = 77  # alone
    return np.arange(n), v, tags


def frame(spark, ids, v, tags):
    return spark.createDataFrame([(int(i), x.tolist(), int(t)) for i, x, t in zip(ids, v, tags)], "id long, v array<double>, tag int")


@pytest.mark.parametrize("metric", ["cosine", 1, 2])
@pytest.mark.parametrize("clusters", [1, 5])
def test_distances_against_all_pairs(spark, monkeypatch, metric, clusters):
    monkeypatch.setattr(S, "BUCKET_VALUES", 12)  # many buckets, and values that fill more than one
    monkeypatch.setattr(S, "CLUSTER_BLOCK", 2)
    monkeypatch.setattr(S, "BROADCAST_CELLS", 6)
    ids, v, tags = points_of(4, clusters=clusters)
    got = {r.id: (r.own, r.size, r.a, r.b) for r in S.cluster_distances(frame(spark, ids, v, tags), metric).collect()}
    expected = plain(ids, v, tags, metric)
    assert got.keys() == expected.keys()
    for i in ids.tolist():
        assert got[i][:2] == expected[i][:2] and got[i][2:] == pytest.approx(expected[i][2:], abs=1e-9), i


@pytest.mark.parametrize("metric", ["cosine", 1])
def test_one_cluster_and_one_bucket(spark, metric):
    ids, v, tags = points_of(9)
    for t in (tags, tags * 0):
        got = S.silhouette(frame(spark, ids, v, t), metric).first()
        rows = plain(ids, v, t, metric).values()
        s = [0.0 if n == 1 or max(a, b) == 0 else (b - a) / max(a, b) for _, n, a, b in rows]
        assert got.silhouette == pytest.approx(np.mean(s)) and got.sum_a == pytest.approx(sum(a for _, n, a, _ in rows if n > 1)) and got.sum_b == pytest.approx(sum(b for _, n, _, b in rows if n > 1))


ODD = [(100, None, 0), (101, [], 0), (102, [1.0, None, 2.0], 0), (103, [1.0, float("nan"), 2.0], 1), (104, [1.0, float("inf"), 2.0], 1), (105, [1.0], 1), (106, [1.0, 2.0, 3.0], None)]


@pytest.mark.parametrize("metric", ["cosine", 1, 2])
def test_odd_vectors_are_left_out(spark, metric):
    ids, v, tags = points_of(2, n=30)
    points = frame(spark, ids, v, tags)
    odd = points.union(spark.createDataFrame(ODD + ([(107, [0.0, 0.0, 0.0], 0)] if metric == "cosine" else []), points.schema))
    assert S.silhouette(odd, metric).first() == pytest.approx(S.silhouette(points, metric).first())
    assert S.silhouette(points.limit(0), metric).first().silhouette is None
    assert S.silhouette(spark.createDataFrame(ODD, points.schema), metric).first().silhouette is None


def test_work_is_linear(spark):
    """No plan holds the points against each other."""
    ids, v, tags = points_of(1)
    points = frame(spark, ids, v, tags).withColumn("v", F.col("v"))
    for metric in ("cosine", 1):
        plan = S.cluster_distances(points, metric)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
