import random
import zlib

import numpy as np
import pytest

from quarry.llm import langid, registry
from quarry.llm.tables import table


def brute(scores, penalty):
    n, k = scores.shape
    best = {(s,): scores[0, s] for s in range(k)}
    for t in range(1, n):
        best = {(*p, s): v + scores[t, s] - penalty * (p[-1] != s) for p, v in best.items() for s in range(k)}
    return max(best.values())


@pytest.mark.parametrize("seed", range(30))
def test_best_path_against_all_paths(seed):
    rng = np.random.default_rng(seed)
    scores, penalty = rng.normal(size=(rng.integers(1, 8), rng.integers(1, 4))), rng.uniform(0, 3)
    path = langid.best_path(scores, penalty)
    value = scores[np.arange(len(path)), path].sum() - penalty * (np.diff(path) != 0).sum()
    assert value == pytest.approx(brute(scores, penalty))


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: (r.lang, r.text) for r in table(spark, sf, "documents").collect()}
    rows = registry.op3_language_id(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == docs[r.doc_id][0] for r in rows if r.held_out]) > 0.97


ROWS = [
    (1, "the cat and the dog were in the house with their friends", "en"),
    (2, "der hund und die katze waren in dem haus mit ihren freunden", "de"),
    (3, "кошка и собака были в доме со своими друзьями", "ru"),
]


def test_mixed_text_and_edge_rows(spark):
    train = spark.createDataFrame([(10 * k + i, t, x) for k in range(40) for i, t, x in ROWS] + [(7, None, "en"), (8, "x", None)], "doc_id long, text string, lang string")
    model = langid.fit_languages(train)
    assert model["langs"] == ["de", "en", "ru"]
    mixed = f"{ROWS[0][1]}. {ROWS[1][1]}! {ROWS[2][1]}"
    texts = [mixed, None, "", "123 !?", "кошка", "漢字", "dog", "dog"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "dog", "x")], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in langid.identify_languages(docs, model, penalty=6.0).collect()}
    assert [mixed[s.begin : s.end] for s in got[0].spans] == [r[1] for r in ROWS] and [s.lang for s in got[0].spans] == ["en", "de", "ru"]
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["und", "und", "und", "ru"] and got[5].lang_pred in model["langs"]
    assert langid.identify_languages(docs, model).count() == 9 and langid.identify_languages(docs.limit(0), model).count() == 0
    nothing = langid.fit_languages(train.limit(0))
    assert {r.lang_pred for r in langid.identify_languages(docs, nothing).collect()} == {"und"}


def test_long_text_is_read_whole():
    model = {"langs": ["a", "b"], "table": np.zeros((1 << 16, 2), np.float32), "allowed": np.ones((16, 2), bool)}
    rnd = random.Random(0)
    text = " ".join(rnd.choice(["foo", "bar"]) for _ in range(50_000))
    (lang, score, spans), = langid.label_texts([text], model)
    assert (lang, score, spans) == ("a", 1.0, [(0, len(text), "a")])
