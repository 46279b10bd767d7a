import numpy as np
import pytest

from quarry.llm import learning, linear, quality, registry, toxicity
from quarry.llm.features import indicators, stem_indicators
from quarry.llm.tables import table


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return {r.doc_id: (r.quality, r.toxic) for r in table(spark, sf_dir, "labels").collect()}


def test_quality_on_held_out_rows(spark, labels):
    sf = "/root/testdata/sf0.01"
    known = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    rows = registry.op5_quality(spark, sf).collect()
    assert len(rows) == table(spark, sf, "documents").count()
    held = [r for r in rows if r.held_out and known.get(r.doc_id) is not None]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == known[r.doc_id] for r in held]) > 0.95


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    known = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    rows = registry.op1_toxicity(spark, sf).collect()
    held = [r for r in rows if r.held_out and known.get(r.doc_id) is not None]
    assert np.mean([r.toxic for r in held if known[r.doc_id] == 1]) > 0.8
    assert np.mean([r.toxic for r in held if known[r.doc_id] == 0]) < 0.01


EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "the quick brown fox"), (4, "the quick brown fox"), (None, "x"), (5, "word " * 300_000)]


@pytest.mark.parametrize("with_labels", [True, False])
def test_edge_rows(spark, with_labels):
    docs = spark.createDataFrame([(*r, "clash") for r in EDGE], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (3, None, None), (4, 1, 0), (4, 0, 0), (5, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    if not with_labels:
        labels = labels.limit(0)
    model = quality.fit_quality(docs, labels)
    rows = quality.score_quality(docs, model).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
    kept = quality.keep_good(docs, model, threshold=0.0)
    assert kept.columns == docs.columns and kept.count() == len(EDGE)
    chain = toxicity.fit_toxicity(docs, labels, ["quality", "toxic"])
    out = toxicity.score_toxicity(docs, chain, ["quality", "toxic"]).collect()
    assert len(out) == len(EDGE) and all(0 <= r.p_toxic <= 1 for r in out)
    assert quality.score_quality(docs.limit(0), model).count() == 0


def test_dual_descent_reaches_the_hinge_optimum():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 12, 5)).astype(np.int32) for _ in range(60)]
    y = np.where(rng.random(60) < 0.5, 1, -1)
    scale, cost = rng.normal(size=12), 0.5
    w, bias = linear.fit_hinge(rows, scale, y, cost, epochs=3000)

    def loss(v, b):
        return (v @ v + b * b) / 2 + cost * sum(max(0, 1 - t * (v[r] @ scale[r] + b)) for r, t in zip(rows, y))

    v = w / scale
    best = loss(v, bias)
    for _ in range(300):
        assert loss(v + rng.normal(size=12) * 0.02, bias + rng.normal() * 0.02) >= best - 1e-3


def test_logistic_gradient_vanishes():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 30, 6)).astype(np.int32) for _ in range(200)]
    y = (rng.random(200) < 0.3).astype(float)
    x = linear.Sparse(rows, rng.normal(size=(200, 2)))
    w = linear.fit_logistic(x, y, 1e-2, steps=300)
    g = x.transposed((linear.sigmoid(x.dot(w)) - y) / 200)
    g[:-1] += 1e-2 * w[:-1]
    assert np.abs(g).max() < 2e-3


def test_later_models_train_on_out_of_fold_probabilities(monkeypatch):
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 50, 8)).astype(np.int32) for _ in range(80)]
    y = (rng.random((80, 2)) < 0.4).astype(float)
    seen = []
    fit = linear.fit_logistic
    monkeypatch.setattr(linear, "fit_logistic", lambda x, *a, **k: (seen.append(x.dense.copy()), fit(x, *a, **k))[1])
    toxicity.fit_chain_sample(rows, y)
    last = next(d for d in seen if d.shape == (80, 1))
    models = toxicity.fit_chain_sample(rows, y[:, :1])
    own = np.array([linear.sigmoid(models[0]["w"][r].sum() + models[0]["bias"]) for r in rows])
    assert np.abs(last[:, 0] - own).mean() > 0.05


def test_features_of_odd_texts():
    for text in (None, "", " ", "!!!", "a", "漢字 и слово", "x" * 100_000):
        for f in (indicators, stem_indicators):
            got = f(text)
            assert got.dtype == np.int32 and (np.diff(got) > 0).all() and (len(got) == 0 or (got[0] >= 0 and got[-1] < 1 << 20))
    assert learning.folds_of(10, 4).tolist().count(0) == 3


def test_repeats_of_one_id_train_once(spark, monkeypatch):
    """30,000 rows of one labelled id, with and without the same text, are one row of the sample."""
    from pyspark.sql import functions as F

    repeats = spark.range(30_000).select(F.lit(11).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, "one text that repeats").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    docs = repeats.union(spark.createDataFrame([(i, f"words of text {i}") for i in range(20, 40)], "doc_id long, text string")).repartition(6)
    labels = spark.createDataFrame([(11, 1.0), *((i, 0.0) for i in range(20, 40))], "doc_id long, y double")
    got = learning.fit_on_sample(docs, labels, F.lit(True), ["y"], lambda t: np.array([len(t)]), lambda x, y: (len(x), y.sum()), id_col="doc_id", text_col="text", most=8000)
    assert got == (21, 1.0)


def test_languages_learn_from_one_row_an_id(spark):
    from pyspark.sql import functions as F

    rows = [(1, "eins zwei drei", "de"), (2, "one two three", "en"), (None, "uno dos tres", "es")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    many = docs.withColumn("again", F.explode(F.sequence(F.lit(1), F.when(F.col("doc_id") == 2, 1).otherwise(5000)))).drop("again").repartition(5)
    from quarry.llm import langid

    one, other = (langid.fit_languages(d, usable=F.lit(True)) for d in (docs, many))
    assert one["langs"] == other["langs"] == ["de", "en", "es"] and (one["table"] == other["table"]).all()
