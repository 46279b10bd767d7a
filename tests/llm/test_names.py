"""Columns of any name pass through the operators that keep all columns."""

import pytest

from quarry.llm import decontaminate, langid, lattice, licenses, mixing, ngram_join, quality, sharding, toxicity
from quarry.session import materialize

NAMES = ["a.b", "two words", "back`tick", "__gone", "__row", "__again", "__score", "__doc", "__key", "__source", "col3", "n_words", "slot", "key", "1st"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s", *(f"{n}{i}" for n in NAMES)) for i, t in enumerate(["some words of a text that go on for a while", "other words entirely", None])]
    return spark.createDataFrame(rows, ["doc_id", "text", "source", *NAMES])


def test_stages_keep_columns_of_any_name(spark, docs):
    model = quality.fit_sample([], __import__("numpy").zeros(0, bool))
    items = spark.createDataFrame([("x", "other words entirely not")], "item_id string, text string")
    before = sorted(map(tuple, docs.collect()), key=str)
    for out in (quality.keep_good(docs, model), ngram_join.keep_one_of_each(docs), decontaminate.remove_contamination(docs, items)):
        assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=str) == before
    placed = sharding.shuffle_into_shards(docs.withColumn("bytes.of", sharding.record_size(docs.text)), 2, size_col="bytes.of", hash_cols=["a.b", "back`tick"])
    assert sorted(tuple(r[c] for c in docs.columns if c != "slot") for r in placed.collect()) == sorted(tuple(r[c] for c in docs.columns if c != "slot") for r in docs.collect())
    mixed = mixing.mix_sources(docs.withColumnRenamed("source", "of.source"), mixing.weights_by_size(docs, "source", 0.5), source_col="of.source")
    assert mixed.count() == 3


def test_key_columns_of_any_name(spark, docs):
    odd = materialize(docs.select("doc_id", "text", "source").withColumnsRenamed({"doc_id": "my.id", "text": "the `text`"}), "odd")
    names = {"id_col": "my.id", "text_col": "the `text`"}
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1)], "`my.id` long, quality int, toxic int")
    assert quality.score_quality(odd, quality.fit_quality(odd, labels, **names), **names).columns == ["my.id", "score", "predicted"]
    chain = toxicity.fit_toxicity(odd, labels, ["toxic"], **names)
    assert toxicity.score_toxicity(odd, chain, ["toxic"], **names).count() == 3
    assert langid.identify_languages(odd, langid.fit_languages(odd, lang_col="source", **names), **names).count() == 3
    assert ngram_join.ngram_components(odd, **names).count() == 3
    assert licenses.scan_licenses(odd, licenses.fit_sample(["plain words"], templates={"MIT": ["the mit license"]}), **names).count() == 3
    assert decontaminate.mark_contamination(odd, odd, item_col="my.id", item_text_col="the `text`", **names).count() == 3
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "`v.id` long, `e.b` array<float>")
    assert lattice.lattice_duplicates(vectors, id_col="v.id", vector_col="e.b").columns == ["v.id", "n_links", "component_id", "kept"]
