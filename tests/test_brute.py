"""Registered queries without SQL, on small tables, against plain NumPy or recursion."""

import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from quarry.operators import evaluate
from quarry.plans.tables import FEATURES, filled, observations
from tests.test_goldens import forest_by_hand, grown


@pytest.fixture(scope="module")
def tiny(spark, sf_dir, tmp_path_factory):
    out = tmp_path_factory.mktemp("tiny")
    pd.read_parquet(f"{sf_dir}/lineitem.parquet").head(1200).to_parquet(out / "lineitem.parquet")
    pd.read_parquet(f"{sf_dir}/embeddings.parquet").head(90).to_parquet(out / "embeddings.parquet")
    return str(out)


@pytest.fixture(scope="module")
def run(spark, tiny):
    queries = __spark_entry__.queries()
    return lambda name, sf=None: queries[name](spark, sf or tiny)


def frame(df):
    return pd.DataFrame([r.asDict() for r in df.collect()]).sort_values("id").reset_index(drop=True).astype({"id": int})


def repairs_by_hand(table, columns, others):
    """[(column, low, high, intercept and weights)], each seeing the ones before."""
    out, table = [], table.copy()
    for c in columns:
        xs = [x for x in [*columns, *others] if x != c]
        a, b = np.percentile(table[c], [25, 75])
        low, high = a - 1.5 * (b - a), b + 1.5 * (b - a)
        far = (table[c] < low) | (table[c] > high)
        design = np.column_stack([np.ones(len(table)), table[xs].astype(float)])
        beta = np.linalg.lstsq(design[~far], table[c][~far].astype(float), rcond=None)[0]
        table.loc[far, c] = design[far] @ beta
        out.append((c, xs, low, high, beta))
    return table, out


def repaired(table, repairs):
    table = table.copy()
    for c, xs, low, high, beta in repairs:
        far = (table[c] < low) | (table[c] > high)
        table.loc[far, c] = np.column_stack([np.ones(len(table)), table[xs].astype(float)])[far] @ beta
    return table


def valid(x):
    return x.where(x.notna() & ((x == 0) | ((x >= 1e-4) & (x < 1e16))))


def by_class(table, label="label"):
    out = table.copy()
    for c in FEATURES:
        good = valid(table[c])
        out[c] = good.fillna(good.groupby(table[label]).transform("mean"))
    return out


def correlated(table, columns, threshold):
    cols, gone, n = [*columns, "label"], [], len(table)
    for i, a in enumerate(columns):
        if any(abs(np.corrcoef(table[a], table[b])[0, 1] * n / (n - 1)) > threshold for b in cols[i + 1 :]):
            gone.append(a)
    return gone


def close(got, expected):
    pd.testing.assert_frame_equal(got[sorted(got.columns)], expected[sorted(expected.columns)].reset_index(drop=True), check_dtype=False, rtol=1e-6, atol=1e-8)


def test_regression_of_all_columns(spark, tiny, run):
    before = frame(filled(spark, tiny))
    after, _ = repairs_by_hand(before, FEATURES, ["label"])
    assert (after[FEATURES] != before[FEATURES]).any().all()
    close(frame(run("t6_regression_all")), after[["id", *FEATURES]])


def test_cleaned_observations(spark, tiny, run):
    table, _ = repairs_by_hand(by_class(frame(observations(spark, tiny))), FEATURES, ["label"])
    got = frame(run("t13_clean_observations"))
    table = table.groupby([*FEATURES, "label"], as_index=False).id.min().sort_values("id")
    left = [c for c in FEATURES if c not in correlated(table, FEATURES, 0.75)]
    table[left] = (table[left] - table[left].min()) / (table[left].max() - table[left].min())
    close(got, table[["id", "label", *left]])


def test_cleaning_learnt_and_applied(spark, tiny, run):
    train, test = (frame(x) for x in evaluate.split(observations(spark, tiny), "id"))
    table, repairs = repairs_by_hand(by_class(train), FEATURES, [])
    gone = correlated(table[[*FEATURES, "label"]].drop_duplicates(), FEATURES, 0.75)
    left = [c for c in FEATURES if c not in gone]
    means = {c: valid(train[c]).groupby(train.label).mean() for c in FEATURES}
    for c in FEATURES:
        test[c] = valid(test[c]).fillna(means[c].mean())  # new rows come without a class
    test = repaired(test, repairs)
    low, high = table[left].min(), table[left].max()
    test[left] = (test[left].clip(low, high, axis=1) - low) / (high - low)
    got = frame(run("t18_apply_cleaning"))
    assert (got[left] != frame(filled(spark, tiny)).set_index("id").loc[got.id, left].reset_index(drop=True)).any().all()
    close(got, test[["id", *left]])


def test_principal_components(spark, tiny, run):
    table = frame(filled(spark, tiny))
    x = table[FEATURES].to_numpy(float)
    x = (x - x.mean(0)) / x.std(0)
    values, axes = np.linalg.eigh(np.cov(x.T))
    axes = axes[:, np.argsort(-values)[:2]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), [0, 1]])
    close(frame(run("l10_principal_components")), pd.DataFrame({"id": table.id, "pc1": x @ axes[:, 0], "pc2": x @ axes[:, 1]}))


def lloyd(v, centroids, p):
    now = np.array(centroids, float)
    assign = lambda: ((np.abs(v[:, None] - now[None]) ** p).sum(2) ** (1 / p)).argmin(1)
    for _ in range(500):
        at = assign()
        moved = np.array([v[at == k].mean(0) if (at == k).any() else now[k] for k in range(len(now))])
        shift, now = np.linalg.norm(moved - now), moved
        if shift < 1e-4:
            break
    return assign()


@pytest.fixture(scope="module")
def vectors(tiny):
    table = pd.read_parquet(f"{tiny}/embeddings.parquet").sort_values("vec_id")
    return table.vec_id.to_numpy(), np.array(table.embedding.tolist(), float)


def test_kmeans_with_spread_centroids(run, vectors):
    ids, v = vectors
    away = np.abs(v - v[0]).sum(1)
    order = np.lexsort((ids, away))
    picks = [0, *(int(order[int(len(ids) / 3 * i) - 1]) for i in (3, 2))]
    got = frame(run("c1_kmeans"))
    assert got.cluster.tolist() == lloyd(v, v[picks], 1).tolist() and got.cluster.nunique() == 3


def test_kmeans_with_random_centroids(run, vectors):
    ids, v = vectors
    place = [((int(i) % 2**32) * 2654435761 + 40503) % 2**32 for i in ids]
    got = frame(run("c2_kmeans_random"))
    assert got.cluster.tolist() == lloyd(v, v[np.argsort(place, kind="stable")[:3]], 2).tolist()


def rows_of(df):
    return [(r.id, *(float(r[c]) for c in FEATURES), r.label) for r in df.orderBy("id").collect()]


def test_tree_query(spark, tiny, run):
    train, test = evaluate.split(filled(spark, tiny), "id")
    plain = grown([(r[1:5], r[5]) for r in rows_of(train)][:], 0, 5)
    assert {r.id: r.prediction for r in run("l5_decision_tree").collect()} == {r[0]: plain(r[1:5]) for r in rows_of(test)}


def test_forest_query(spark, tiny, run, tmp_path):
    pd.read_parquet(f"{tiny}/lineitem.parquet").head(90).to_parquet(tmp_path / "lineitem.parquet")
    train, test = evaluate.split(filled(spark, str(tmp_path)), "id")
    seen = rows_of(train)
    got = {r.id: r.prediction for r in run("l7_random_forest", str(tmp_path)).collect()}
    assert got == forest_by_hand(spark, train, seen, FEATURES, 30, 6, 2, apply_to=rows_of(test))
