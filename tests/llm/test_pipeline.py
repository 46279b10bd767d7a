import corpus_pipeline as P
from quarry.llm import decontaminate
from quarry.llm.tables import table
from quarry.session import materialize
from tests.llm.test_ngram_join import brute


def test_stages_one_by_one(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    before = {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]

    out = materialize(P.quality_stage(spark, docs, sf_dir))
    assert out.columns == docs.columns
    good = {r.doc_id: r for r in out.collect()}
    judged = [i for i in before if labels.get(i) is not None]
    assert sum((i in good) == (labels[i] == 1) for i in judged) >= 0.9 * len(judged)
    assert all(r == before[i] for i, r in good.items())

    docs = out
    out = materialize(P.near_duplicate_stage(spark, docs, sf_dir))
    left = {r.doc_id: r for r in out.collect()}
    expected = brute(list(good), [r.text for r in good.values()])
    assert out.columns == docs.columns and set(left) == {i for i, (_, c) in expected.items() if i == c}

    docs = out
    out = materialize(P.decontamination_stage(spark, docs, sf_dir))
    clean = {r.doc_id: r for r in out.collect()}
    items = [decontaminate.words_of(r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    windows = {tuple(w[k : k + 10]) for w in items for k in range(len(w) - 9)}
    hit = lambda t: [k for w in [decontaminate.words_of(t)] for k in range(len(w) - 9) if tuple(w[k : k + 10]) in windows]
    assert out.columns == docs.columns
    for i, r in left.items():
        if not hit(r.text):
            assert clean[i] == r
        elif i in clean:
            assert not hit(clean[i].text) and clean[i].n_chars == len(clean[i].text)

    docs = out
    out = materialize(P.mixing_stage(spark, docs, sf_dir))
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(clean)

    docs = out
    rows = P.sharding_stage(spark, docs, sf_dir).collect()
    assert {r.doc_id: r.text for r in rows} == {i: r.text for i, r in clean.items()}
    slots = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(P.SHARDS)}
    assert all(x == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_run_and_edge_rows(spark, sf_dir):
    assert P.run(spark, sf_dir).count() > 100
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (None, "some words", "en", "s", 10, "x"), (3, "a fine text " * 50_000, "en", "s", 1, "x"), (3, "a fine text " * 50_000, "en", "s", 1, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, slot string"
    docs = spark.createDataFrame(rows, schema)
    for part in (docs, docs.limit(0)):
        n = part.count()
        for name, stage in P.STAGES:
            before = part.count()
            part = materialize(stage(spark, part, sf_dir), name)
            if name == "quality":  # its training rows are those of the given table only
                assert part.count() <= before
                part = docs.limit(n)
            elif name == "near_duplicates":
                n = min(n, 4)  # of the row that repeats one is left
            assert name == "quality" or part.count() == n, name


def test_mixing_realises_the_weights(spark, sf_dir):
    counts = {"a": 3000, "b": 1000, "c": 300, "d": 5}
    rows = [(k * 10_000 + j, f"text {s} {j}", "en", s, 9) for k, (s, n) in enumerate(counts.items()) for j in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    q = {r.source: r.q for r in P.mixing.weights_by_size(docs, "source", P.MIX_POWER).collect()}
    mixed = materialize(P.mixing_stage(spark, docs, sf_dir), "mixed")
    out = [r for r in P.sharding_stage(spark, mixed, sf_dir).collect()]
    assert {r.doc_id for r in out} == {r[0] for r in rows}
    had = {s: [r.doc_id for r in out if r.source == s] for s in counts}
    assert len(had["a"]) == counts["a"]
    for s, ids in had.items():
        assert -1 < counts["a"] * q[s] / q["a"] - len(ids) < P.mixing.BLOCK_ROWS
        times = [ids.count(i) for i in set(ids)]
        assert max(times) - min(times) <= 1
