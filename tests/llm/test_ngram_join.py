import random

import numpy as np
import pytest

from quarry.llm import ngram_join as J
from quarry.llm import registry
from quarry.llm.tables import table


def sets_of(texts, words=5):
    out = []
    for t in texts:
        w = t.encode().lower().split() if t else []
        out.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    return out


def brute(ids, texts, words=5, percent=75):
    sets, up, holders = sets_of(texts, words), {i: i for i in ids}, {}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(k)
    counts = {}
    for h in holders.values():
        for x in range(len(h)):
            for y in range(x):
                counts[h[y], h[x]] = counts.get((h[y], h[x]), 0) + 1
    for (x, y), c in counts.items():
        if 100 * c >= percent * (len(sets[x]) + len(sets[y]) - c):
            a, b = sorted((root(ids[x]), root(ids[y])))
            up[b] = a
    return {i: (len(s), root(i)) for i, s in zip(ids, sets)}


def corpus(seed, n=120):
    """Random texts, a shared passage, exact copies, and a chain of near copies."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(400)}"
    passage = [word() for _ in range(15)]
    texts = []
    for _ in range(n):
        kind = rnd.random()
        if kind < 0.3 or not texts:
            texts.append(" ".join(word() for _ in range(rnd.randrange(0, 60))))
        elif kind < 0.45:
            texts.append(" ".join([*passage, *(word() for _ in range(rnd.randrange(0, 8)))]))
        elif kind < 0.6:
            texts.append(rnd.choice(texts).upper())
        else:
            w = rnd.choice(texts).split()
            for _ in range(rnd.randrange(0, 3)):
                if w:
                    w[rnd.randrange(len(w))] = word()
            texts.append("\t".join(w))
    return texts


@pytest.mark.parametrize("seed,given", [(1, {}), (2, {"column": 2, "block": 4, "sample": 1}), (3, {"column": 3, "block": 3, "sample": 2}), (4, {"most_frequent": 0, "column": 4})])
def test_components_against_brute_force(spark, seed, given):
    texts = corpus(seed)
    ids = random.Random(seed).sample(range(1000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    rows = J.ngram_components(docs, **given).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(ids, texts)


def test_edge_rows(spark):
    long = "many words " * 20_000
    data = [(5, "a b c"), (3, "A\nB C"), (3, "A\nB C"), (7, None), (8, ""), (9, " \t"), (None, "a b c"), (11, long), (10, long + "x")]
    docs = spark.createDataFrame([(*r, "clash") for r in data], "doc_id long, text string, key string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.ngram_components(docs).collect()), key=str)
    expected = [(5, 1, 3), (3, 1, 3), (3, 1, 3), (7, 0, 7), (8, 0, 8), (9, 0, 9), (None, 1, None), (11, 2, 10), (10, 3, 10)]
    assert [g for g in got if g[0] not in (10, 11)] == sorted((e for e in expected if e[0] not in (10, 11)), key=str)
    assert J.ngram_components(docs.limit(0)).count() == 0
    kept = J.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["3", "7", "8", "9", "10"] + ["11"] * (kept.count() - 5))


def test_products():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(0, 3000))) for _ in range(12)]
    got = J.multiply(sets[:7], sets[7:])
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[7:]] for a in sets[:7]]).all()
    own = J.multiply(sets, None)
    off = ~np.eye(12, dtype=bool)
    assert (own[off] == np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])[off]).all()


def test_query_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").collect()
    rows = registry.op8_ngram_join(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute([r.doc_id for r in docs], [r.text for r in docs])


def test_a_task_full_of_copies(spark):
    docs = spark.createDataFrame([(i, "one text of more than five words") for i in range(4500)], "doc_id long, text string").coalesce(1)
    assert {(r.n_shingles, r.component_id) for r in J.ngram_components(docs).collect()} == {(3, 0)}


def test_a_task_whose_ids_belong_to_other_texts(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:39], "x"])), (1, "some other text of seven words here"), (2, "and one more text of eight words here")]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.ngram_components(docs).collect())
    assert got == [(1, 3, 1), (1, 36, 1), (2, 4, 2), (2, 36, 1)]


def test_repeats_of_one_row_and_a_bridge_with_a_null_id(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[a : a + 44]) for a in (0, 5, 10)]
    assert brute([1, 2, 3], texts)[3] == (40, 1) and brute([1, 3], [texts[0], texts[2]])[3] == (40, 3)
    data = [(1, texts[0])] * 10_000 + [(None, texts[1]), (3, texts[2])]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    sent, product = [], J._block_links
    J._block_links = lambda work, percent: (sent.append(work.groupBy("task", "key").count().where("count > 1").count()), product(work, percent))[1]
    try:
        rows = J.ngram_components(docs).groupBy("doc_id", "n_shingles", "component_id").count().collect()
    finally:
        J._block_links = product
    assert sorted((tuple(r) for r in rows), key=str) == [(1, 40, 1, 10_000), (3, 40, 1, 1), (None, 40, None, 1)]
    assert sent and not any(sent)


def test_one_row_of_each_group_stays_and_no_other_text_goes(spark):
    a, b, c = "a text that several rows of the table share", "quite another text with words of its own", "a third text that only rows without an id have"
    data = [(1, a), (5, a), (5, b), (1, a), (None, a), (None, c), (None, c), (5, None), (5, None), (2, b.upper() + " x")]
    docs = spark.createDataFrame([(*r, f"n{i % 2}") for i, r in enumerate(data)], "doc_id long, text string, note string")
    left = sorted(((r.doc_id, r.text) for r in J.keep_one_of_each(docs).collect()), key=str)
    # 4 of 5 shingles of the longer text are in b: both are one group
    assert left == sorted([(1, a), (2, b.upper() + " x"), (None, c), (5, None), (5, None)], key=str)
    assert J.keep_one_of_each(docs.limit(0)).count() == 0
