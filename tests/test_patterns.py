import random
from itertools import combinations

import pytest

from quarry.operators import mining, patterns


def some_baskets(seed, n=200, items=12, longest=8):
    rnd = random.Random(seed)
    return [[f"i{int(rnd.paretovariate(0.8)) % items}" for _ in range(rnd.randint(0, longest))] for _ in range(n)]


def frame(spark, baskets):
    return spark.createDataFrame(list(enumerate(baskets)), "tid long, items array<string>")


def rows(df):
    return sorted((tuple(r["items"]), r.k, r.freq, round(r.support, 9)) for r in df.collect())


@pytest.mark.parametrize("support, max_size, local_rows", [(0.05, None, 50_000), (0.05, None, 3), (0.1, 2, 3), (0.02, None, 0), (0.6, None, 5)])
def test_trees_find_what_levels_find(spark, support, max_size, local_rows):
    baskets = frame(spark, [*some_baskets(1), [], ["i1", None, "i1"]])
    assert rows(patterns.fp_growth(baskets, support, max_size, local_rows)) == rows(mining.apriori(baskets, support, max_size))


def test_the_threshold_is_inclusive(spark):
    baskets = frame(spark, [["a", "b"]] * 7 + [["c"]] * 93)
    assert [r[0] for r in rows(patterns.fp_growth(baskets, 0.07))] == [("a",), ("a", "b"), ("b",), ("c",)]
    assert rows(patterns.fp_growth(frame(spark, []), 0.1)) == []


def test_long_baskets(spark):
    """Baskets of 30 items, of which a pair is frequent and hardly anything longer."""
    rnd = random.Random(4)
    baskets = [sorted(rnd.sample([f"x{i:03}" for i in range(400)], 28)) + ["p", "q"][: 1 + i % 2] for i in range(1500)]
    got = rows(patterns.fp_growth(frame(spark, baskets), 0.02))
    counts = {}
    for b in baskets:
        for k in (1, 2):
            for c in combinations(sorted(b), k):
                counts[c] = counts.get(c, 0) + 1
    expected = {c: n for c, n in counts.items() if n / 1500 >= 0.02}
    assert {r[0]: r[2] for r in got if r[1] <= 2} == expected and len(got) > 100


def test_rules_within_baskets(spark):
    baskets = [*some_baskets(6), [], ["", "i1", " "], ["unheard"]]
    rnd = random.Random(2)
    names = [f"i{k}" for k in range(12)]
    rules = [(sorted(rnd.sample(names, rnd.randint(1, 4))), [f"then{j}"], j / 100) for j in range(80)] + [([], ["always"], 1.0), (["i1"], ["again"], 0.5)]
    expected = sorted((t, c[0], m) for t, b in enumerate(baskets) for a, c, m in rules if set(a) <= set(b))
    found = spark.createDataFrame(rules, "antecedent array<string>, consequent array<string>, measure double")
    got = mining.recommend(found, frame(spark, baskets), strict=False)
    assert sorted((r.tid, r.consequent[0], r.measure) for r in got.collect()) == expected
    clean = frame(spark, [sorted({i for i in b if i.strip()}) for b in baskets])
    dealt = patterns.contained(found, clean, broadcast_rules=0, walked_rows=7)
    assert sorted((r.tid, r.consequent[0], r.measure) for r in dealt.collect()) == expected
    assert patterns.contained(found.limit(0), clean).count() == 0 and patterns.contained(found, clean.limit(0)).count() == 0
