"""How often cleaning reads its rows, and how it deals them out."""

from pyspark.sql import functions as F

from quarry.operators import cleaning


def test_no_task_gets_a_class(spark):
    df = spark.range(200).select("id", (F.col("id") % 2).alias("label"), F.when(F.col("id") % 7 > 0, F.col("id").cast("double")).alias("x"))
    given = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # Spark does not broadcast by itself
    try:
        out = cleaning.impute_class_mean(df, ["x"], "label")
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", given)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert out.where("x is null").count() == 0


def test_repairs_read_the_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(300).select("id", (F.col("id") % 10).cast("double").alias("a"), F.when(F.col("id") % 50 == 3, 900.0).otherwise(F.col("id") % 6).alias("b"))
    out = cleaning.regression_repair(rows.mapInArrow(count, rows.schema), ["a", "b"], [])
    assert out.where("b > 100").count() == 0 and seen.value == 300
