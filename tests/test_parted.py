import math

from pyspark.sql import functions as F

from quarry import session
from quarry.plans import pipelines
from quarry.plans.tables import FEATURES, observations, table


def test_a_task_groups_a_bounded_part(spark, sf_dir, monkeypatch):
    """The more rows, the more parts; and no task groups what it reads of a file."""
    monkeypatch.setattr(session, "PART_ROWS", 500)
    n = table(spark, sf_dir, "lineitem").count()
    obs = observations(spark, sf_dir)
    sizes = [r["count"] for r in obs.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert math.ceil(n / 500) >= len(sizes) > n / 1000 and max(sizes) < 1000
    plan = obs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_max" not in plan.split("Exchange")[1]


def test_distinct_rows_are_grouped_in_parts(spark, sf_dir, monkeypatch):
    seen, inner = [], pipelines.cleaning.correlated_columns
    monkeypatch.setattr(pipelines.cleaning, "correlated_columns", lambda df, *a: seen.append(df) or inner(df, *a))
    pipelines.fit_cleaning(observations(spark, sf_dir), FEATURES, "label")
    assert seen[0]._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert seen[0].count() == seen[0].distinct().count()
