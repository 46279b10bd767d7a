from fractions import Fraction

import pytest

from quarry.llm import mixing, registry
from quarry.llm.tables import table
from tests.llm.compare import same


def test_query_against_sql(spark, sf_dir):
    assert same(registry.op10_mixing(spark, sf_dir), registry.OP10_SQL, sf_dir) > 0


@pytest.mark.parametrize("q", [[1], [3, 7], [1, 1, 998], [97, 3, 60, 40], [5] * 20])
def test_every_prefix_is_within_one_block(spark, q):
    weights = spark.createDataFrame([(f"s{i:02}", x) for i, x in enumerate(q)], "source string, q long")
    slots = sorted(mixing.pfair_period(weights).collect(), key=lambda r: r["at"])
    assert [r["at"] for r in slots] == list(range(sum(q)))
    had = dict.fromkeys((f"s{i:02}" for i in range(len(q))), 0)
    for t, r in enumerate(slots, 1):
        assert r.release <= r["at"] < r.deadline
        had[r.source] += 1
        assert all(abs(Fraction(t * x, sum(q)) - had[f"s{i:02}"]) < 1 for i, x in enumerate(q))


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "s", "b"), (2, "s", None), (3, "t", "c")], "doc_id long, source string, slot string")
    weights = mixing.weights_by_size(docs, "source", 1.0, period=10)
    rows = mixing.mix_sources(docs, weights, block_rows=1).collect()
    assert len(rows) == 5 and len({r.slot for r in rows}) == 5
    assert mixing.mix_sources(docs.limit(0), weights).count() == 0
    assert mixing.mix_sources(docs.limit(0), weights.limit(0)).count() == 0


def test_hot_source_ranks_are_gapless(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "if(doc_id % 3 = 0, 'hot', source) as source")
    rows = mixing.rank_within_source(docs, "source", "doc_id", 1, bucket_rows=10).collect()
    by = {}
    for r in rows:
        by.setdefault(r["__source"], []).append(r["__rank"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_more_sources_than_slots(spark):
    counts = [5000, *[1 + i % 3 for i in range(1499)]]
    data = [(k * 10_000 + j, f"s{k:04}") for k, n in enumerate(counts) for j in range(n)]
    docs = spark.createDataFrame(data, "doc_id long, source string").cache()
    weights = mixing.weights_by_size(docs, "source", 0.5)
    q = {r.source: r.q for r in weights.collect()}
    assert len(q) == 1500 and min(q.values()) >= 1 and sum(q.values()) == 1500 * mixing.SLOTS_EACH
    assert q["s0000"] == max(q.values())
    slots = sorted(mixing.pfair_period(weights).collect(), key=lambda r: r["at"])
    assert [r["at"] for r in slots] == list(range(sum(q.values()))) and all(r.release <= r["at"] < r.deadline for r in slots)
    rows = mixing.mix_sources(docs, weights, block_rows=1).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in data) and len({r.slot for r in rows}) == len(rows)


@pytest.mark.parametrize("q", [[1], [3, 7], [97, 3, 60, 40], [5] * 20])
def test_long_schedules_equal_short_ones(spark, q):
    weights = spark.createDataFrame([(f"s{i:02}", x) for i, x in enumerate(q)], "source string, q long")
    columns = ["source", "q", "period", "k", "at", "release", "deadline"]
    short, long = (sorted(map(tuple, f(weights).select(columns).collect())) for f in (mixing.pfair_period, mixing._long_period))
    assert short == long


def test_refill_gives_no_row_too_often(spark):
    docs = spark.createDataFrame([(i, "big") for i in range(5000)] + [(9999, "tiny")], "doc_id long, source string")
    weights = spark.createDataFrame([("big", 1), ("tiny", 1)], "source string, q long")
    for most in (3, 100):
        rows = mixing.mix_sources(docs, weights, block_rows=1, refill=True, most_repeats=most).collect()
        assert sum(r.source == "tiny" for r in rows) == most and sum(r.source == "big" for r in rows) == 5000
        assert len({r.slot for r in rows}) == len(rows)


def test_an_id_that_repeats_is_spread(spark, tmp_path):
    """A third of the rows has one id, others have none: no task ranks them all."""
    rows = [(1 if i % 3 == 0 else None if i % 3 == 1 else i, "s" if i % 2 else "t", i) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, source string, n int").repartition(5).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for given in (docs, docs.where("n >= 0").distinct()):
        ranked = mixing.rank_within_source(given, "source", "doc_id", 1, bucket_rows=40)
        got = ranked.collect()
        for s in "st":
            mine = sorted((r["__rank"], r.doc_id) for r in got if r["__source"] == s)
            assert [r for r, _ in mine] == list(range(1500))
            ids = [i for _, i in mine]
            for i in (1, None):  # rows of one id stay together in the order
                at = [k for k, x in enumerate(ids) if x == i]
                assert len(at) == 500 and at[-1] - at[0] == 499
        assert sorted(r.n for r in got) == list(range(3000))
    plain = mixing.rank_within_source(docs.where("n % 3 = 2"), "source", "doc_id", 1, bucket_rows=40)
    assert {(r.n, r["__rank"]) for r in plain.collect()} == {(r.n, r["__rank"]) for r in mixing.rank_within_source(docs.where("n % 3 = 2"), "source", "doc_id", 1).collect()}
