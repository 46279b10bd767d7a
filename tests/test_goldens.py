"""Small results worked out by hand, and brute-force versions."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import sources
from quarry.functions import dates
from quarry.functions.validity import valid_number, valid_text
from quarry.operators import cleaning, clusters, density, evaluate, mining, pairwise, profile, rank, rollup, silhouette, trees
from quarry.operators.rank import order_stats
from quarry.plans import pipelines


def column(spark, values, name="x"):
    return spark.createDataFrame([(i, float(v) if v is not None else None) for i, v in enumerate(values)], f"id long, {name} double")


def test_quartiles_percentiles_and_deviation(spark):
    df = column(spark, range(1, 9))
    assert profile.quartiles(df, "x") == [1, 2.5, 4.5, 6.5, 8]
    assert profile.percentiles(df, ["x"], [0.2, 0.25, 0.75, 0.8])["x"] == pytest.approx([2.4, 2.75, 6.25, 6.6])
    row = profile.central_tendency(df, ["x"]).first()
    assert row["deviation"] == pytest.approx(2.2912878) and len(row["modes"]) == 8
    assert profile.central_tendency(column(spark, [1, 1, 2, 2, 3]), ["x"]).first()["modes"] == [1, 2]
    assert profile.bin_count(295) == 10 and profile.bin_count(337) == 10
    df = column(spark, [5, 1, 1, 1, 9, 5, None]).withColumn("y", -F.col("x"))
    both = {"x": F.col("x"), "y": F.col("y"), "none": F.lit(None)}
    assert order_stats(df, both, lambda n: [0, 2, 3, n - 1]) == {"x": (6, {0: 1, 2: 1, 3: 5, 5: 9}), "y": (6, {0: -9, 2: -5, 3: -1, 5: -1}), "none": (0, {})}
    assert profile.approximate_percentiles(df, ["x"], [0.5]) == {"x": [1.0]}


def test_ranks_by_buckets(spark):
    rng = np.random.default_rng(4)
    values = {"x": rng.integers(0, 300, 2000).astype(float), "y": rng.normal(size=2000)}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*values.values())], "x double, y double")
    counts = rank.counted_values(df, {c: F.col(c) for c in values})
    ranked = rank.ranked_values(counts, {c: len(set(v)) for c, v in values.items()}, bucket_values=50)
    for c, v in values.items():
        got = {r.v: (r.n, r.first) for r in ranked.where(F.col("column") == c).collect()}
        order = sorted(v)
        assert got == {x: (order.count(x), order.index(x)) for x in set(order)}


def test_correlation_and_scaling(spark):
    df = spark.createDataFrame([(i, float(i), 2.0 * i) for i in range(1, 5)], "id long, x double, y double")
    assert profile.scaled_correlation(df, ["x", "y"]).first()["r"] == pytest.approx(4 / 3)
    assert [r["x"] for r in cleaning.z_score(df, ["x"]).orderBy("id").collect()] == pytest.approx([-1.2, -0.4, 0.4, 1.2])
    assert [r["x"] for r in cleaning.min_max(df, ["x"]).orderBy("id").collect()] == pytest.approx([0, 1 / 3, 2 / 3, 1])
    assert cleaning.correlated_columns(df.withColumn("label", F.lit(1.0) * F.col("id") % 2), ["x", "y"], "label") == ["x"]


def test_binning(spark):
    df = column(spark, [1, 2, 3, 4])
    assert [r.x for r in cleaning.equal_depth(df, "x", 2).orderBy("id").collect()] == [1.5, 1.5, 3.5, 3.5]
    assert [r.x for r in cleaning.equal_width(df, "x", 2).orderBy("id").collect()] == [1.5, 1.5, 3.5, 4]


@pytest.mark.parametrize("text,valid", [("1.5", True), ("2.", True), ("3", False), ("-1.0", False), ("nan", False), ("1e-05", False), (None, False)])
def test_validity_of_text(spark, text, valid):
    assert spark.createDataFrame([(text,)], "t string").select(valid_text(F.col("t"))).first()[0] is valid


@pytest.mark.parametrize("value,valid", [(0.0, True), (-0.0, False), (1e-4, True), (9e-5, False), (1e16, False), (9.9e15, True), (-2.0, False), (math.inf, False), (math.nan, False), (None, False)])
def test_validity_of_numbers(spark, value, valid):
    assert spark.createDataFrame([(value,)], "v double").select(valid_number(F.col("v"))).first()[0] is valid


def test_dates(spark):
    rows = [(61, "12-Jun", 2022), (18, "11-Jan", 2019), (1, "10/11/2020", None), (2, "3-Feb", None), (3, "x", 2020), (4, None, 2020)]
    df = spark.createDataFrame(rows, "p long, t string, y int")
    got = {r.p: str(r.d) for r in df.select("p", dates.mixed_date(F.col("t"), F.col("y")).alias("d")).collect()}
    assert got == {61: "2022-06-12", 18: "2019-01-11", 1: "2020-10-11", 2: "None", 3: "None", 4: "None"}
    df = spark.createDataFrame([(18, "22-Dec", "11-Jan"), (17, "1/1/2019", "1/20/2019"), (19, "12/30/2019", "1/12/2020")], "period long, a string, b string")
    rolled = rollup.repair_dates(df, "period", ["a", "b"], roll_over=True).where("period = 18").first()
    assert (str(rolled.a), str(rolled.b)) == ("2019-12-22", "2020-01-11")


def test_itemsets_and_rules(spark):
    baskets = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "c"]), (3, ["a", "b", "c"]), (4, ["b"])], "tid long, items array<string>")
    found = mining.apriori(baskets, 0.5)
    assert {"".join(r["items"]): r.support for r in found.collect()} == {"a": 0.75, "b": 0.75, "c": 0.5, "ab": 0.5, "ac": 0.5}
    expected = {"confidence": 2 / 3, "cosine": 2 / 3, "lift": 0.8889, "jaccard": 0.5, "kulczynski": 2 / 3}
    for name, value in expected.items():
        rule = mining.rules(found, name).where("antecedent = array('a') AND consequent = array('b')").first()
        assert rule.measure == pytest.approx(value, abs=1e-4)
    for k, n in ((2, 2), (3, 6), (4, 14)):
        whole = mining.apriori(spark.createDataFrame([(1, list("abcd")[:k])], "tid long, items array<string>"), 1.0)
        assert mining.rules(whole.where(F.col("k").isin(1, k)) if k == 2 else whole).where(F.size(F.concat("antecedent", "consequent")) == k).count() == n
    assert mining.apriori(baskets.limit(0), 0.5).count() == 0


def test_report(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "label int, prediction int")
    assert sorted(tuple(r) for r in evaluate.confusion(rows).collect()) == [(0, 0, 1), (0, 1, 1), (1, 0, 0), (1, 1, 2)]
    assert sorted(tuple(r) for r in evaluate.class_counts(evaluate.confusion(rows)).collect()) == [(0, 1, 1, 0, 2), (1, 2, 0, 1, 1)]
    got = {r["class"]: r for r in evaluate.report(rows).collect()}
    assert got["0"].recall == 0.5 and got["1"].precision == pytest.approx(2 / 3) and got["0"].f1 == pytest.approx(2 / 3)
    assert got["1"].f1 == pytest.approx(0.8) and got["Global"].accuracy == 0.75 and got["Global"].recall == 0.75


def gini(y):
    return 1 - sum((y.count(c) / len(y)) ** 2 for c in set(y))


def grown(rows, depth, most, least=2):
    """(prediction of) a tree by plain recursion over (features, label)."""
    y = [r[1] for r in rows]
    leaf = min(c for c in set(y) if y.count(c) == max(map(y.count, set(y))))
    best = None
    if len(rows) >= least and depth < most:
        for f in range(len(rows[0][0])):
            for t in sorted({r[0][f] for r in rows}):
                left, right = [r[1] for r in rows if r[0][f] <= t], [r[1] for r in rows if r[0][f] > t]
                if left and right:
                    gain = round(gini(y) - len(left) / len(y) * gini(left) - len(right) / len(y) * gini(right), 12)
                    if best is None or gain > best[0]:
                        best = (gain, f, t)
    if best is None or best[0] <= 0:
        return lambda x: leaf
    _, f, t = best
    a, b = (grown([r for r in rows if (r[0][f] <= t) == side], depth + 1, most, least) for side in (True, False))
    return lambda x: a(x) if x[f] <= t else b(x)


def test_tree_against_recursion(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 8, (120, 3)).astype(float)
    y = ((x[:, 0] > 3).astype(int) + (x[:, 1] > 5)) * (rng.random(120) > 0.1)
    rows = [(i, *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, label int")
    plain = grown([(tuple(r[1:4]), r[4]) for r in rows], 0, 3)
    for local in (0, 30, 1000):
        nodes = trees.grow(df, ["a", "b", "c"], "label", "id", max_depth=3, local_rows=local)
        got = {r.id: r.prediction for r in trees.predict(df, nodes, ["a", "b", "c"], "id").collect()}
        assert got == {r[0]: plain(r[1:4]) for r in rows}, local


def forest_by_hand(spark, df, rows, names, count, depth, k, seed=42, apply_to=None):
    """Predictions of a forest by plain recursion, with the bootstraps and the draws of
    features that the seed gives."""
    weights = {}
    for t in range(count):
        for r in df.select("id", trees._poisson(F.lit(t), "id", seed).alias("w")).collect():
            weights[t, r.id] = r.w
    judged = apply_to or rows
    votes = {r[0]: [] for r in judged}
    for t in range(count):
        held = [r for r in rows for _ in range(weights[t, r[0]])]

        def tree(part, node, d):
            y = [r[-1] for r in part]
            leaf = min(c for c in set(y) if y.count(c) == max(map(y.count, set(y))))
            best = None
            if len(part) >= 2 and d < depth:
                for f in trees._drawn(seed, t, node, len(names), k):
                    for cut in sorted({r[1 + f] for r in part}):
                        a, b = [r[-1] for r in part if r[1 + f] <= cut], [r[-1] for r in part if r[1 + f] > cut]
                        if a and b:
                            gain = round(gini(y) - len(a) / len(y) * gini(a) - len(b) / len(y) * gini(b), 12)
                            if best is None or gain > best[0]:
                                best = (gain, f, cut)
            if best is None or best[0] <= 0:
                return lambda r: leaf
            _, f, cut = best
            a, b = (tree([r for r in part if (r[1 + f] <= cut) == s], 2 * node + 1 - s, d + 1) for s in (True, False))
            return lambda r: a(r) if r[1 + f] <= cut else b(r)

        root = tree(held, 1, 0)
        for r in judged:
            votes[r[0]].append(root(r))
    return {i: min(c for c in set(v) if v.count(c) == max(map(v.count, set(v)))) for i, v in votes.items()}


@pytest.mark.parametrize("local", [0, 1000])
def test_forest_against_recursion(spark, local):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (90, 3)).astype(float)
    y = ((x[:, 0] > 2).astype(int) + (x[:, 1] > 3)) * (rng.random(90) > 0.15)
    rows = [(i, *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, label int")
    nodes = trees.grow(df, ["a", "b", "c"], "label", "id", trees=4, max_depth=3, features_per_node=2, local_rows=local)
    got = {r.id: r.prediction for r in trees.predict(df, nodes, ["a", "b", "c"], "id").collect()}
    assert got == forest_by_hand(spark, df, rows, "abc", 4, 3, 2)


def test_sweep_against_single_fits(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 5, (80, 2)).astype(float)
    y = ((x.sum(1) > 4).astype(int)) * (rng.random(80) > 0.2)
    df = spark.createDataFrame([(i, *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, y))], "id long, a double, b double, label int")
    train, test = df.where("id < 60"), df.where("id >= 60")
    truth = {r.id: r.label for r in test.collect()}
    for counts, k in ([1], None), ([2, 3], 1):
        found = {(r.max_depth, r.min_split, r.trees): r.accuracy for r in trees.sweep(train, test, ["a", "b"], "label", "id", depths=[2, None], min_splits=[2, 12], counts=counts, features_per_node=k).collect()}
        assert len(found) == 4 * len(counts)
        for (depth, least, n), accuracy in found.items():
            nodes = trees.grow(train, ["a", "b"], "label", "id", trees=max(counts), max_depth=depth, min_split=least, features_per_node=k)
            got = trees.predict(test, nodes.where(F.col("tree") < n), ["a", "b"], "id").collect()
            assert accuracy == pytest.approx(np.mean([truth[r.id] == r.prediction for r in got])), (depth, least, n)


def test_values_in_buckets_give_the_same_split(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(0, 1, 1, int(a + b > 1), float(a), float(b)) for a, b in rng.random((400, 2))], "tree int, node long, w int, label int, a double, b double")
    cuts = {0: [0.2, 0.4, 0.7], 1: [0.5]}
    assert trees.best_splits(df, ["a", "b"], [0, 1], cuts=cuts).collect() == trees.best_splits(df, ["a", "b"], [0, 1]).collect()
    assert set(trees.value_cuts(df, ["a", "b"], bucket_values=100)) == {0, 1}


def test_clusters(spark):
    points = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate([0, 1, 2, 10, 11, 12, 50])], "id long, v array<double>")
    got = [r.cluster for r in density.dbscan(points, 1.5, 2).orderBy("id").collect()]
    assert got == [1, 1, 1, 2, 2, 2, -1]
    four = spark.createDataFrame([(i, [float(v)], t) for i, (v, t) in enumerate([(0, 0), (1, 0), (10, 1), (11, 1)])], "id long, v array<double>, tag int")
    row = silhouette.silhouette(four, 1).first()
    assert (row.silhouette, row.sum_b, row.sum_a) == (pytest.approx(0.8997494), pytest.approx(40), pytest.approx(4))
    six = spark.createDataFrame([(i, [float(i * i)]) for i in range(6)], "id long, v array<double>")
    assert clusters.spread_centroids(six, 2, 2) == [[0.0], [25.0]]
    found = clusters.kmeans(points, [[0.0], [10.0], [50.0]])
    assert found == [[1.0], [11.0], [50.0]]


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(0, 4, (40, 3)).astype(float)
    df = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)], "id long, v array<double>, tag int")
    got = pairwise.nearest(df.where("id < 10"), df.where("id >= 10"), 4, 1).collect()
    for q in range(10):
        order = sorted(range(10, 40), key=lambda i: (np.abs(v[i] - v[q]).sum(), i))[:4]
        assert [r.other for r in sorted((r for r in got if r.id == q), key=lambda r: r["rank"])] == order
    votes = {r.id: r.prediction for r in pairwise.vote(spark.createDataFrame(got), 4).collect()}
    for q in range(10):
        tags = [r.tag for r in sorted((r for r in got if r.id == q), key=lambda r: r["rank"])]
        best = max(collections.Counter(tags).values())
        assert votes[q] == next(t for t in tags if tags.count(t) == best)


def test_regression_repair_and_learnt_cleaning(spark):
    rows = [(i, float(i % 10), 2.0 * (i % 10) + 1, i % 2) for i in range(100)]
    rows[7] = (7, 7.0, 500.0, 1)
    df = spark.createDataFrame(rows, "id long, a double, b double, label int")
    assert cleaning.regression_repair(df, ["b"], ["a"]).where("id = 7").first().b == pytest.approx(15.0)
    params = pipelines.fit_cleaning(df, ["a", "b"], "label")
    new = spark.createDataFrame([(1, None, 3.0, 0), (2, 99.0, -1.0, 1)], "id long, a double, b double, label int")
    for out in (pipelines.apply_cleaning(new, params, "label"), pipelines.apply_cleaning(new, params)):
        assert out.columns == ["id", "b", "label"]  # a tells what b tells, and goes
        assert all(0 <= r.b <= 1 for r in out.collect())
    axes = clusters.principal_components(df.where("id <> 7"), ["a", "b"])[1]
    assert axes[0] == pytest.approx([1 / math.sqrt(5), 2 / math.sqrt(5)])


def test_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text('Temp,Rain,Soil\n"1,5",257,clay\n"x","2,25",sandy\n')
    rows = sources.read_decimal_comma_csv(spark, str(tmp_path / "m.csv"), ["Temp", "Rain"], ["Soil"]).collect()
    assert [tuple(r) for r in rows] == [(1.5, 257.0, "clay"), (None, 2.25, "sandy")]
    (tmp_path / "n.csv").write_text("a,b\n1.5,bad\n,2\n")
    numeric = sources.read_numeric_csv(spark, str(tmp_path / "n.csv"), ["a", "b"])
    assert [tuple(r) for r in numeric.collect()] == [(1.5, None), (None, 2.0)]
    sources.write_table(numeric, str(tmp_path / "out"), "csv")
    assert sources.read_csv(spark, str(tmp_path / "out"), "a double, b double").count() == 2
