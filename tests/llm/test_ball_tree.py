import math
import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import ball_tree as B
from quarry.llm.decontaminate import words_of


def brute(docs, items, k=10):
    """Every document scored for every item."""
    held = [(i, Counter(words_of(t))) for i, t in docs]
    total, n_docs = sum(sum(c.values()) for _, c in held), sum(bool(c) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in set(words_of(text)) if c[w])
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(20))
def test_bounds_hold_and_search_is_exact(seed):
    rng = np.random.default_rng(seed)
    n, width = int(rng.integers(1, 300)), int(rng.integers(1, 60))
    counts = rng.integers(0, min(width, 12) + 1, n)
    cols = np.concatenate([rng.choice(width, c, replace=False) for c in counts]).astype(np.int64)
    vals = rng.integers(1, 1_000_000, len(cols))
    dense = np.zeros((n, width), np.int64)
    dense[np.repeat(np.arange(n), counts), cols] = vals
    tree = B.BallTree(counts, cols, vals, leaf=4)
    assert sorted(tree.order.tolist()) == list(range(n))
    for _ in range(5):
        weights = np.where(rng.random(len(tree.terms)) < 0.3, rng.integers(0, 12_000, len(tree.terms)), 0)
        terms = np.flatnonzero(weights)
        score = dense[:, tree.terms] @ weights if len(tree.terms) else np.zeros(n, np.int64)
        if len(terms):
            bound = tree.bounds(terms, weights[terms])
            for low, high, b in zip(tree.low, tree.high, bound):
                assert score[tree.order[low:high]].max(initial=0) <= b
        found = tree.search(terms, weights[terms], list(range(n)), [], 5, 1) if len(terms) else []
        expected = sorted((-s, False, i) for i, s in enumerate(score.tolist()) if s > 0)[:5]
        assert found == expected


def test_far_nodes_are_not_opened(monkeypatch):
    """Documents of other words lie in other balls, which a query does not open."""
    rng = np.random.default_rng(3)
    n, topics = 4000, 20
    topic = rng.integers(0, topics, n)
    cols = np.concatenate([np.sort(rng.choice(10, 8, replace=False)) + 10 * t for t in topic])
    tree = B.BallTree(np.full(n, 8), cols, rng.integers(500_000, 600_000, len(cols)))
    opened = []
    kids = tree.kids

    class Watched(list):
        def __getitem__(self, i):
            opened.append(i)
            return kids[i]

    tree.kids = Watched(kids)
    best = tree.search(np.arange(10), np.full(10, 5000), list(range(n)), [], 10, 1)
    assert len(best) == 10 and all(topic[x[2]] == 0 for x in best)
    assert len(set(opened)) < 0.35 * len(kids)


ROWS = [(1, "red fish blue fish"), (2, None), (3, ""), (4, "red red wine"), (4, "red red wine"), (None, "blue cheese"), (None, "blue cheese"), (5, "Blue CHEESE!"), (6, "été, red"), (7, "word " * 3000 + "blue")]
ITEMS = [("a", "Red fish"), ("b", "blue-cheese"), ("c", None), ("d", "..."), ("e", "été"), ("e", "été"), (None, "wine"), ("f", "nothing here")]


@pytest.mark.parametrize("block_words", [200_000, 1])
def test_edge_rows(spark, block_words):
    docs = spark.createDataFrame([(i, t, "x") for i, t in ROWS], "doc_id long, text string, score string")
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    for k in (10, 2):
        got = B.rank_documents(docs, items, k=k, block_words=block_words)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS, ITEMS, k)
    assert B.rank_documents(docs.limit(0), items).count() == 0 and B.rank_documents(docs, items.limit(0)).count() == 0


def test_small_blocks_and_samples_change_nothing(spark, monkeypatch):
    rnd = random.Random(2)
    words = [f"w{int(rnd.paretovariate(0.7)) % 300}" for _ in range(20_000)]
    rows = [(i, " ".join(rnd.sample(words, rnd.randint(0, 60)))) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)]
    items = [(i, " ".join(rnd.sample(words, rnd.randint(1, 12)))) for i in range(25)] + [(99, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    given = spark.createDataFrame(items, "item_id int, text string")
    expected = brute(rows, items)
    for sample in (10_000, 50):
        assert sorted(map(tuple, B.rank_documents(docs, given, sample=sample).collect()), key=str) == expected
