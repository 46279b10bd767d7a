"""One-hot columns."""

from quarry.operators import mining


def test_columns_are_not_aggregated(spark):
    baskets = spark.createDataFrame([(1, ["a", None]), (1, ["b"]), (2, None), (3, []), (4, ["c", "c"])], "tid long, items array<string>")
    out = mining.one_hot(baskets, ["a", "b", "c"])
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, 1, 0), (2, 0, 0, 0), (3, 0, 0, 0), (4, 0, 0, 1)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "max(" not in plan and "collect_list(" in plan
