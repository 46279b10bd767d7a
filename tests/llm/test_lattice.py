import itertools

import numpy as np
import pytest

from quarry.llm import lattice as L
from quarry.llm import registry
from tests.llm.compare import same


def test_decoder_finds_the_nearest_lattice_point():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(200, 8)) * 1.5
    got = L.nearest_e8(y)
    double = np.rint(got * 2)
    assert ((double % 2 == double[:, :1] % 2).all() and (got.sum(1) % 2 == 0).all())
    best = ((y - got) ** 2).sum(1)
    for r in L.ROOTS:
        assert (((y - got - r) ** 2).sum(1) >= best - 1e-9).all()


def brute(rows, cosine=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    up, n = {i: i for i, _ in rows}, {i: 0 for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, x), (j, y) in itertools.combinations(good, 2):
        if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
            n[i], n[j] = n[i] + 1, n[j] + 1
            a, b = sorted((root(i), root(j)))
            up[b] = a
    return {i: (n[i], root(i), root(i) == i) for i, _ in rows}


def groups(seed, sizes, noise, dim=64):
    rng = np.random.default_rng(seed)
    rows = []
    for size in sizes:
        x = rng.normal(size=dim)
        rows += [(x + rng.normal(size=dim) * noise).tolist() for _ in range(size)]
    ids = rng.permutation(1000)[: len(rows)]
    return [(int(i), v) for i, v in zip(ids, rows)]


@pytest.mark.parametrize("seed,given", [(1, {}), (2, {"block": 8}), (3, {"block": 16, "crowd": 2})])
def test_groups_against_brute_force(spark, seed, given):
    rows = groups(seed, [60, 20, 5, 2, 2, *[1] * 40], 0.18)
    rows += [(1000 + i, v) for i, (_, v) in enumerate(rows[:30])]
    out = L.lattice_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), **given)
    expected = brute([(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows])
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out.collect()} == expected


def test_no_link_below_the_cosine_and_recall_near_it(spark):
    rng = np.random.default_rng(5)
    rows, linked = [], 0
    for k in range(300):
        x, z = rng.normal(size=64), rng.normal(size=64)
        x /= np.linalg.norm(x)
        z -= z @ x * x
        z /= np.linalg.norm(z)
        c = [0.895, 0.905, 0.92][k % 3]
        linked += c > 0.9
        rows += [(2 * k, x.tolist()), (2 * k + 1, (c * x + np.sqrt(1 - c * c) * z).tolist())]
    got = {r.vec_id: r.n_links for r in L.lattice_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[2 * k] == 0 for k in range(0, 300, 3))
    assert sum(got[2 * k] for k in range(300)) >= 0.9 * linked


def placed_pairs(seed, n, cosines, dim=64, others=0):
    """Rows of random vectors: pairs 2k, 2k+1 at the cosines in turn, then others."""
    rng = np.random.default_rng(seed)
    x, z = rng.normal(size=(2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = np.resize(cosines, n)[:, None]
    return np.concatenate([np.stack([x, c * x + np.sqrt(1 - c * c) * z], axis=1).reshape(2 * n, dim), rng.normal(size=(others, dim))])


def test_recall_by_band_and_selectivity(spark):
    """20,000 random vectors hold 2,000 pairs in four bands of cosines; few of the
    other pairs are looked at, and their share falls as rows are added."""
    bands = [0.9005, 0.915, 0.94, 0.97]
    v = placed_pairs(8, 2000, bands, others=16_000)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in L.lattice_duplicates(rows).select("vec_id", "n_links").collect()}
    for b in range(4):
        assert np.mean([got[2 * k] for k in range(b, 2000, 4)]) >= 0.92, bands[b]
    shares = []
    for n in (6_000, 24_000):
        unit = np.random.default_rng(9).normal(size=(n, 64))
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        points, tables = L.plan(n, 0.9, L.PROBES, L.WIDTH)
        found = L.cells(unit, tables, points, L.PROBES, L.WIDTH, L.SEED)
        met = 0
        for t in range(tables):
            own, times = np.unique(found[:, t, 0], return_counts=True)
            met += int((times * (times - 1) // 2).sum())
            for p in range(1, 1 + L.PROBES):
                at = np.minimum(np.searchsorted(own, found[:, t, p]), len(own) - 1)
                met += int(times[at][own[at] == found[:, t, p]].sum())
        shares.append(met / (n * (n - 1) / 2))
    assert shares[1] < 0.001 and shares[1] <= 1.05 * shares[0]


def test_neighbours_are_lattice_points_and_hold_the_nearest():
    y = np.random.default_rng(4).normal(size=(500, 8))
    own = L.nearest_e8(y)
    gains, steps = L.neighbours(y - own)
    roots = {tuple((2 * r).astype(int)) for r in L.ROOTS}
    assert all(tuple(s) in roots for s in steps.reshape(-1, 8).tolist())
    assert np.allclose(gains.max(1), ((y - own) @ L.ROOTS.T).max(1)) and np.allclose((steps / 2 * (y - own)[:, None]).sum(2), gains)


def test_edge_rows(spark):
    inf, nan = float("inf"), float("nan")
    data = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [1e-300, 0.0])]
    rows = spark.createDataFrame([(*r, "clash") for r in data], "vec_id long, embedding array<double>, n_links string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in L.lattice_duplicates(rows).collect()), key=str)
    expected = [(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), *((i, 0, i, True) for i in range(3, 10)), (None, 4, None, None), (10, 4, 1, False)]
    assert got == sorted(expected, key=str)
    assert L.lattice_duplicates(rows.limit(0)).count() == 0


def test_query_against_sql(spark, sf_dir):
    assert same(registry.op2_lattice(spark, sf_dir), registry.OP2_SQL, sf_dir) > 0


def test_near_pairs_all_below_the_cosine(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(60):
        x, z = rng.normal(size=64), rng.normal(size=64)
        x /= np.linalg.norm(x)
        z -= z @ x * x
        z /= np.linalg.norm(z)
        rows += [(2 * k, x.tolist()), (2 * k + 1, (0.895 * x + np.sqrt(1 - 0.895**2) * z).tolist())]
    got = L.lattice_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all((r.n_links, r.component_id) == (0, r.vec_id) for r in got) and len(got) == 120
