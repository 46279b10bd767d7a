import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate as D


def brute(text, items, window):
    words = D.words_of(text)
    hit, found = [False] * len(words), set()
    for item, t in items:
        w = D.words_of(t)
        spans = [w[i : i + window] for i in range(len(w) - window + 1)] if len(w) >= window else [w] if w else []
        for s in spans:
            for i in range(len(words) - len(s) + 1):
                if words[i : i + len(s)] == s:
                    found.add(item)
                    for k in range(i, i + len(s)):
                        hit[k] = True
    return hit, found


@pytest.mark.parametrize("seed", range(40))
def test_automaton_against_brute_force(seed):
    rnd = random.Random(seed)
    window = rnd.choice([2, 3, 4])
    some = lambda n: " ".join(rnd.choice("abcd") for _ in range(n))
    items = [(str(i), some(rnd.randint(0, 7))) for i in range(rnd.randint(0, 6))]
    sam = D.Automaton([(i, D.words_of(t)) for i, t in items], window)
    texts = [some(rnd.randint(0, 25)) for _ in range(5)] + [None, "", "x y z"]
    for text, (spans, found) in zip(texts, D.scan([D.words_of(t) for t in texts], sam)):
        hit, expected = brute(text, items, window)
        marked = [any(a <= k < b for a, b in spans) for k in range(len(hit))]
        assert (marked, found) == (hit, expected)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short item"), (3, None), (4, "...")]
TEXTS = [
    (1, "start. One two, three four five six seven eight nine ten! end"),
    (2, None),
    (3, ""),
    (4, "clean words only in this text"),
    (4, "clean words only in this text"),
    (5, "a SHORT-item here"),
    (6, "one two three four five six seven eight nine"),
]


@pytest.mark.parametrize("block_words", [500_000, 8])
def test_marks_and_edge_rows(spark, block_words):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in TEXTS], "doc_id long, text string, n_words string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = D.mark_contamination(docs, items, block_words=block_words).collect()
    assert len(rows) == len(TEXTS)
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in rows}
    assert got == {1: (12, 10, ["1"]), 2: (0, 0, []), 3: (0, 0, []), 4: (6, 0, []), 5: (4, 2, ["2"]), 6: (9, 0, [])}
    empty = D.mark_contamination(docs.limit(0), items.limit(0))
    assert empty.count() == 0 and D.mark_contamination(docs, items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_removal_cuts_spans_and_keeps_clean_rows(spark):
    docs = spark.createDataFrame(
        [(1, "keep this and that and more and more words. One two, three four five six seven eight nine ten! end", 9), (2, None, 0), (3, "clean", 5), (4, ITEMS[0][1], 7)],
        "doc_id long, text string, n_chars long",
    )
    out = D.remove_contamination(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), min_span=10)
    assert out.columns == docs.columns
    rows = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    left = "keep this and that and more and more words. ! end"
    assert rows == {1: (left, len(left)), 2: (None, 0), 3: ("clean", 5)}


def test_query_against_brute_force(spark, sf_dir):
    from quarry.llm.registry import op9_decontaminate
    from quarry.llm.tables import table

    items = [(str(r.item_id), r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    windows = {}
    for i, t in items:
        w = D.words_of(t)
        for s in [tuple(w[k : k + 10]) for k in range(len(w) - 9)] or [tuple(w)]:
            windows.setdefault(s, set()).add(i)
    assert min(map(len, windows)) == 10
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = op9_decontaminate(spark, sf_dir).collect()
    assert len(rows) == len(texts) and any(r.contaminated for r in rows)
    for r in rows:
        w = D.words_of(texts[r.doc_id])
        hit, found = set(), set()
        for k in range(len(w) - 9):
            if (s := tuple(w[k : k + 10])) in windows:
                hit |= set(range(k, k + 10))
                found |= windows[s]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit))


def test_items_without_an_id_mark_words(spark):
    items = spark.createDataFrame([(None, "one two three four five six seven eight nine ten"), (None, "short item"), ("7", "six seven eight nine ten eleven twelve x y z"), ("7", "more more")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "One two three four five six seven eight nine ten. a short item"), (2, "clean")], "doc_id long, text string")
    for block_words in (500_000, 4):
        got = {r.doc_id: (r.n_hit, r["items"]) for r in D.mark_contamination(docs, items, block_words=block_words).collect()}
        assert got == {1: (12, []), 2: (0, [])}
    texts = {1: "One two three four five six seven eight nine ten. a short item", 2: "clean"}
    marked = {i: brute(t, [(r.item_id, r.text) for r in items.collect()], 10)[0] for i, t in texts.items()}
    assert {i: sum(m) for i, m in marked.items()} == {1: 12, 2: 0}


@pytest.mark.parametrize("block_words", [500_000, 3])
def test_a_cut_leaves_no_passage_behind(spark, block_words):
    """The words on both sides of a cut passage are another item's."""
    a, b, c = ([f"{x}{i}" for i in range(10)] for x in "abc")
    nested = c[:5] + b[:5] + a + b[5:] + c[5:]
    rest = [f"w{i}" for i in range(80)]
    docs = spark.createDataFrame([(1, " ".join(rest[:40] + nested + rest[40:])), (2, " ".join(rest))], "doc_id long, text string")
    items = spark.createDataFrame([(x[0][0], " ".join(x)) for x in (a, b, c)], "item_id string, text string")
    out = D.remove_contamination(docs, items, block_words=block_words)
    got = {r.doc_id: r.text.split() for r in out.collect()}
    assert got == {1: rest, 2: rest}
    assert {r.n_hit for r in D.mark_contamination(out, items, block_words=block_words).collect()} == {0}
