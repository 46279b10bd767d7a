"""The data-mining tables, derived from the given ones, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import parted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


FEATURES = ["f1", "f2", "f3", "f4"]
#: Outliers: of ids divisible by the first number the value times the second plus
#: the third.
SPIKES = {"f1": (211, 20.0, 1.0), "f2": (223, 30.0, 0.0), "f3": (227, 3.0, 2.0), "f4": (229, 5.0, 4.0)}
MEASURES = ["cases", "tests", "positives"]


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, f1 to f4 and label: order lines, one row for each order and line number.
    Some f1 are null and some f2 negative, that is invalid; by the rules of SPIKES a
    few values of each column lie far out."""
    lines = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    rows = parted(lines, lines.count(), "id").groupBy("id")
    spiked = lambda c: F.when(F.col("id") % SPIKES[c][0] == 0, F.col(c) * SPIKES[c][1] + SPIKES[c][2]).otherwise(F.col(c))
    picked = rows.agg(
        F.max("l_quantity").alias("f1"), F.max("l_extendedprice").alias("f2"), F.max("l_discount").alias("f3"),
        F.max(F.col("l_tax") + F.col("l_quantity") * 0.001).alias("f4"), F.max("l_returnflag").alias("flag"),
    )
    picked = picked.withColumns({c: spiked(c) for c in SPIKES})
    return picked.select(
        "id",
        F.when(F.col("id") % 13 != 0, F.col("f1")).alias("f1"),
        F.when(F.col("id") % 17 == 0, -F.col("f2")).otherwise(F.col("f2")).alias("f2"),
        "f3",
        "f4",
        F.expr("case flag when 'A' then 0 when 'N' then 1 else 2 end").alias("label"),
    )


_SPIKED = ", ".join(f"CASE WHEN id % {m} = 0 THEN {c} * {a}::DOUBLE + {b}::DOUBLE ELSE {c} END AS {c}" for c, (m, a, b) in SPIKES.items())
OBS = f"""obs AS (
  SELECT id, CASE WHEN id % 13 <> 0 THEN f1 END AS f1, CASE WHEN id % 17 = 0 THEN -f2 ELSE f2 END AS f2, f3, f4,
         CASE flag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label
  FROM (SELECT id, flag, {_SPIKED} FROM (SELECT l_orderkey * 10 + l_linenumber AS id, max(l_quantity) AS f1, max(l_extendedprice) AS f2, max(l_discount) AS f3,
               max(l_tax + l_quantity * 0.001::DOUBLE) AS f4, max(l_returnflag) AS flag FROM lineitem GROUP BY 1))
)"""
#: A valid number, as the Spark side decides it.
VALID = "({0} IS NOT NULL AND NOT isnan({0}) AND ({0} = 0 OR ({0} >= 1e-4::DOUBLE AND {0} < 1e16::DOUBLE)))"
CLEAN = "clean AS (SELECT id, label, " + ", ".join(f"CASE WHEN {VALID.format(c)} THEN {c} END AS {c}" for c in FEATURES) + " FROM obs)"


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with invalid f1 and f2 replaced by 25 and 30000."""
    obs = observations(spark, sf_dir)
    return obs.withColumns({"f1": F.coalesce("f1", F.lit(25.0)), "f2": F.when(F.col("f2") < 0, 30000.0).otherwise(F.col("f2"))})


FILLED = OBS + ", filled AS (SELECT id, coalesce(f1, 25.0::DOUBLE) AS f1, CASE WHEN f2 < 0 THEN 30000.0::DOUBLE ELSE f2 END AS f2, f3, f4, label FROM obs)"


def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """zone, period, population, start_text, end_text and three measures with gaps:
    orders by the nation of the customer (7 zones) in runs of 21 days. Even rows
    have full dates, odd ones day and month."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    sums = joined.groupBy((F.col("c_nationkey") % 7).cast("long").alias("zone"), F.expr("1").alias("__one"), (F.floor(day / 21) + 1).cast("long").alias("period")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("cases"), F.count(F.lit(1)).cast("double").alias("tests"), F.sum((F.col("o_orderstatus") == "F").cast("double")).alias("positives")
    )
    odd = (F.col("zone") + F.col("period")) % 2 == 1
    start = F.date_add(F.lit("1992-01-01").cast("date"), ((F.col("period") - 1) * 21).cast("int"))
    end = F.date_add(start, 20)
    text = lambda d: F.when(odd, F.date_format(d, "d-MMM")).otherwise(F.date_format(d, "M/d/yyyy"))
    gap = (F.col("zone") + F.col("period")) % 9 == 0
    return sums.select(
        "zone",
        "period",
        ((F.col("zone") + 1) * 1000).alias("population"),
        text(start).alias("start_text"),
        text(end).alias("end_text"),
        F.when(~gap, F.col("cases")).alias("cases"),
        F.when(F.col("period") % 10 != 0, F.col("tests")).alias("tests"),
        F.when(~gap, F.col("positives")).alias("positives"),
    )


PERIODS = """periods AS (
  SELECT zone, period, (zone + 1) * 1000 AS population,
         CASE WHEN (zone + period) % 2 = 1 THEN strftime(s, '%-d-%b') ELSE strftime(s, '%-m/%-d/%Y') END AS start_text,
         CASE WHEN (zone + period) % 2 = 1 THEN strftime(s + 20, '%-d-%b') ELSE strftime(s + 20, '%-m/%-d/%Y') END AS end_text,
         CASE WHEN (zone + period) % 9 <> 0 THEN cases END AS cases, CASE WHEN period % 10 <> 0 THEN tests END AS tests,
         CASE WHEN (zone + period) % 9 <> 0 THEN positives END AS positives
  FROM (SELECT zone, period, DATE '1992-01-01' + ((period - 1) * 21)::INTEGER AS s, cases, tests, positives
        FROM (SELECT (c_nationkey % 7)::BIGINT AS zone, floor(date_diff('day', DATE '1992-01-01', o_orderdate::DATE) / 21.0::DOUBLE)::BIGINT + 1 AS period,
                     round(sum(o_totalprice), 2) AS cases, count(*)::DOUBLE AS tests, sum(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS positives
              FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2))
)"""


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """zone, period, population, date, year, month and the measures."""
    start = F.date_add(F.lit("1992-01-01").cast("date"), ((F.col("period") - 1) * 21).cast("int"))
    rows = periods(spark, sf_dir).withColumn("date", start).withColumns({"year": F.year("date"), "month": F.month("date")})
    return rows.drop("start_text", "end_text")


DATED = PERIODS + """, dated AS (
  SELECT *, year(date)::INTEGER AS year, month(date)::INTEGER AS month
  FROM (SELECT zone, period, population, cases, tests, positives, DATE '1992-01-01' + ((period - 1) * 21)::INTEGER AS date FROM periods)
)"""


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tid and four sorted items: binned quantity, return flag, line status, part type."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    joined = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    picked = joined.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tid")).agg(
        F.max("l_quantity").alias("q"), F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"), F.max("p_type").alias("type")
    )
    return picked.select("tid", (F.floor(F.col("q") / 10) * 10).cast("double").alias("q"), "flag", "status", "type")


TRANSACTIONS = """raw AS (
  SELECT l_orderkey * 10 + l_linenumber AS tid, max(l_quantity) AS q, max(l_returnflag) AS flag, max(l_linestatus) AS status, max(p_type) AS type
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
), baskets AS (
  SELECT tid, list_sort(list_distinct([(floor(q / 10) * 10)::DOUBLE::VARCHAR, flag, status, type])) AS items FROM raw
)"""
