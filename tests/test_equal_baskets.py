from quarry.operators import patterns


def test_equal_baskets_are_walked_once(spark, monkeypatch):
    baskets = spark.createDataFrame([(i, [["a", "b"], ["b", "c"], [], None][i % 4]) for i in range(80)], "tid long, items array<string>")
    rules = [(["a"], ["x"], 0.5), (["a", "b"], ["y"], 0.25), (["c"], ["x", "z"], 1.0), ([], ["always"], 0.125), (["d"], ["never"], 1.0)]
    found = spark.createDataFrame(rules, "antecedent array<string>, consequent array<string>, measure double")
    walked, inner = [], patterns._walked
    monkeypatch.setattr(patterns, "_walked", lambda b, *a: walked.append(b.count()) or inner(b, *a))
    rows = lambda df: sorted((r.tid, tuple(r.consequent), r.measure) for r in df.collect())
    few = rows(patterns.contained(found, baskets))
    assert few == rows(patterns.contained(found, baskets, broadcast_kinds=0)) and walked == [3, 80]
    monkeypatch.setattr(patterns, "BROADCAST_HITS", 1)
    assert few == rows(patterns.contained(found, baskets)) and walked[2:] == [3, 80]
    assert len(few) == 20 * (3 + 2 + 1 + 1)
