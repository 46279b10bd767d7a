"""Order statistics, least squares, summaries and samples against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import cleaning, evaluate, mining, profile, rank


def column(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")


@pytest.mark.parametrize("seed", range(4))
def test_order_statistics(spark, monkeypatch, seed):
    monkeypatch.setattr(rank, "BRACKETS", 7)
    monkeypatch.setattr(rank, "ACCURACY", 20)
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=900), np.full(400, 0.5), rng.integers(-2, 3, 200), [np.nan] * 3, [np.inf, -np.inf]])
    rng.shuffle(x)
    df = column(spark, [*x, None, None]).withColumn("y", F.when(F.col("x") > 0, F.round("x", 1)))
    s = np.sort(x)
    picks = lambda n: [0, 1, n // 10, n // 4, n // 3, n // 2, n // 2 + 1, 3 * n // 4, n - 4, n - 1, n + 5, -1]
    got = rank.order_stats(df, {"x": F.col("x"), "y": F.col("y"), "none": F.lit(None).cast("double")}, picks)
    n, at = got["x"]
    assert n == len(x) and at.keys() == {r for r in picks(n) if 0 <= r < n}
    np.testing.assert_array_equal([at[r] for r in sorted(at)], [s[r] for r in sorted(at)])
    y = np.sort(np.array([r.y for r in df.where("y is not null").collect()]))
    n, at = got["y"]
    np.testing.assert_array_equal([at[r] for r in sorted(at)], [y[r] for r in sorted(at)])
    assert n == len(y) and got["none"] == (0, {})


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    monkeypatch.setattr(rank, "_brackets", lambda n, q, ranks: [(2.5, 2.6)])
    assert rank.order_stats(column(spark, range(10)), {"x": F.col("x")}, lambda n: [0, 4, 9])["x"] == (10, {0: 0.0, 4: 4.0, 9: 9.0})


def test_least_squares_of_nearly_dependent_columns(spark):
    rng = np.random.default_rng(1)
    n = 2000
    a, b = rng.normal(size=n) + 5, rng.normal(size=n) * 3
    x = np.column_stack([a, b, a + 1e-9 * rng.normal(size=n), rng.normal(size=n)])
    y = x @ [1.0, -2.0, 0.5, 3.0] + 7 + 1e-3 * rng.normal(size=n)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, d double, y double").repartition(7)
    centred = x - x.mean(0)
    assert np.linalg.cond(centred) > 1e8
    intercept, weights = cleaning.least_squares(df.union(df.limit(1).withColumn("a", F.lit(None).cast("double"))), ["a", "b", "c", "d"], "y")
    guess = intercept + x @ list(weights.values())
    beta = np.linalg.lstsq(centred, y - y.mean(), rcond=np.finfo(float).eps * n)[0]
    assert np.abs(guess - (y.mean() + centred @ beta)).max() < 1e-6
    assert np.abs(guess - y).std() < 1.1e-3
    same = df.withColumn("e", F.col("b"))  # wholly dependent: the shortest weights share the effect
    _, weights = cleaning.least_squares(same, ["b", "e", "d"], "y")
    assert weights["b"] == pytest.approx(weights["e"]) and cleaning.least_squares(df.limit(0), ["a"], "y") is None


def test_equal_depth_of_many_runs(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=1000), 2)
    s = np.sort(x)
    for size in (7, 100):
        got = cleaning.equal_depth(column(spark, [*x, None]).withColumn("k", F.monotonically_increasing_id()), "x", size=size).orderBy("k").collect()
        starts = s[::size]
        mean = [s[i : i + size].mean() for i in range(0, 1000, size)]
        assert [r.x for r in got[:-1]] == pytest.approx([mean[np.searchsorted(starts, v, side="right") - 1] for v in x]) and got[-1].x is None


def test_distinct_counts(spark):
    df = spark.createDataFrame([(1.0, "a", 1, None), (-0.0, "a", 2, None), (0.0, None, 3, None), (float("nan"), "b", 3, None), (float("nan"), "b", 3, None)], "d double, s string, i int, n double")
    assert {r["column"]: r.n_distinct for r in cleaning.value_counts(df, ["d", "s", "i", "n"]).collect()} == {"d": 3, "s": 2, "i": 3, "n": 0}
    assert "Expand" not in cleaning.value_counts(df, ["d", "s"])._jdf.queryExecution().toString()


def test_sketches_merge(spark):
    df = spark.range(60_000).select((F.col("id") % 20_000).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, F.lit(3.0)).alias("y"))
    whole = profile.sketched(df, ["x", "y"])
    parts = [profile.sketched(df.where(F.col("x") % 5 == k), ["x", "y"]) for k in range(5)]
    merged = profile.merged_sketches(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4]))
    for s in (whole, merged):
        got = {r["column"]: r for r in profile.read_sketches(s, [0.1, 0.5, 0.9]).collect()}
        x, y = got["x"], got["y"]
        assert (x.n, x.least, x.most, x["mean"]) == (60_000, 0.0, 19_999.0, pytest.approx(9_999.5)) and (y.n, y.n_distinct, y.quantiles) == (30_000, 1, [3.0] * 3)
        assert abs(x.n_distinct - 20_000) < 600 and x.quantiles == pytest.approx([2_000, 10_000, 18_000], abs=400)
    assert profile.sketched(df.limit(0), ["x"]).count() == 0


def test_pair_sample(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(3000, 2)))] + [(9000, None, 1.0), (9001, float("nan"), 1.0), (9002, 50.0, 50.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = profile.pair_sample(df, "a", "b", "id", grid=10, per_cell=4).collect()
    good = [r for r in rows if r[1] is not None and r[1] == r[1]]
    low = [min(r[k] for r in good) for k in (1, 2)]
    wide = [(max(r[k] for r in good) - low[k - 1]) / 10 for k in (1, 2)]
    cells = {}
    for r in good:
        cells.setdefault(tuple(min(9, int((r[k] - low[k - 1]) // wide[k - 1])) for k in (1, 2)), []).append(r[0])
    h = lambda i: (i * 2654435761 + 40503) % 2**32
    assert sorted((r.id, r.n) for r in got) == sorted((i, len(ids)) for ids in cells.values() for i in sorted(ids, key=lambda i: (h(i), i))[:4])
    assert 9002 in {r.id for r in got} and profile.pair_sample(df.limit(0), "a", "b", "id").count() == 0
    flat = spark.createDataFrame([(i, 1.0, 2.0) for i in range(20)], "id long, a double, b double")
    assert profile.pair_sample(flat, "a", "b", "id", per_cell=3).count() == 3


@pytest.mark.parametrize("n", [0, 1, 4, 1003])
def test_exact_split(spark, n):
    ids = [i * 2**31 for i in range(n)]  # many share a hash
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    train, test = (sorted(r.id for r in part.collect()) for part in evaluate.split_exact(df, "id"))
    order = sorted(ids, key=lambda i: ((i % 2**32 * 2654435761 + 42 * 40503) % 2**32, i))
    assert train == sorted(order[: int(0.8 * n)]) and test == sorted(order[int(0.8 * n) :])


def test_modes_are_refused_beyond_a_bound(spark, monkeypatch):
    monkeypatch.setattr(profile, "MOST_MODES", 3)
    df = column(spark, [1, 1, 2, 2, 3, 3, 5])
    assert profile.central_tendency(df, ["x"]).first().modes == [1.0, 2.0, 3.0]
    with pytest.raises(ValueError, match="mode_rows"):
        profile.central_tendency(column(spark, range(9)), ["x"])


def test_many_items_as_sparse_rows(spark):
    n = 100_000
    baskets = spark.range(n // 4).select(F.col("id").alias("tid"), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.concat(F.lit("item"), ((F.col("id") * 4 + k) % n).cast("string"))).alias("items"))
    baskets = baskets.union(spark.createDataFrame([(-1, []), (-2, None), (-3, ["item5", "item5", None])], "tid long, items array<string>"))
    codes = mining.item_codes(baskets).cache()
    row = codes.agg(F.count(F.lit(1)), F.countDistinct("code"), F.min("code"), F.max("code"), F.countDistinct("item")).first()
    assert tuple(row) == (n, n, 0, n - 1, n)
    known = {r.item: r.code for r in codes.where("item in ('item5', 'item8', 'item9', 'item10', 'item11', 'item12')").collect()}
    got = {r.tid: r.codes for r in mining.sparse_one_hot(baskets, codes).where("tid in (2, -1, -2, -3)").collect()}
    assert got == {2: sorted(known[f"item{i}"] for i in range(8, 13)), -1: [], -2: [], -3: [known["item5"]]}
