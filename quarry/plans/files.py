"""Queries: tables written to the shared folder as files of each notation, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import sources
from quarry.plans.tables import table
from quarry.session import checkpoint_dir

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _written(df: DataFrame, form: str) -> str:
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/files-{uuid.uuid4().hex}"
    sources.write_table(df, path, form)
    return path


@query("s1_read_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def s1_read_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers as CSV and back by a declared schema."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    return sources.read_csv(spark, _written(rows, "csv"), rows.schema)


@query("s2_read_numeric_csv", "SELECT l_orderkey::DOUBLE AS l_orderkey, CASE WHEN l_linenumber <> 3 THEN l_quantity::DOUBLE END AS l_quantity, l_discount::DOUBLE AS l_discount FROM lineitem")
def s2_read_numeric_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns as doubles; text that is no number is null."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.when(F.col("l_linenumber") == 3, F.lit("no number")).otherwise(F.col("l_quantity").cast("string")).alias("l_quantity"), "l_discount"
    )
    return sources.read_numeric_csv(spark, _written(rows, "csv"), rows.columns)


@query("s3_read_decimal_comma_csv", "SELECT p_partkey, p_retailprice::DOUBLE AS p_retailprice, p_size::DOUBLE AS p_size, p_type FROM part")
def s3_read_decimal_comma_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted numbers with a decimal comma, and whole ones without."""
    part = table(spark, sf_dir, "part")
    comma = F.translate(F.col("p_retailprice").cast("decimal(18, 2)").cast("string"), ".", ",")
    rows = part.select(comma.alias("p_retailprice"), F.col("p_size").cast("string").alias("p_size"), F.col("p_partkey").cast("string").alias("p_partkey"), "p_type")
    back = sources.read_decimal_comma_csv(spark, _written(rows, "csv"), ["p_retailprice", "p_size"], ["p_partkey", "p_type"])
    return back.withColumn("p_partkey", F.col("p_partkey").cast("long"))


@query("s4_write_tables", "SELECT 'csv' AS form, count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM supplier UNION ALL SELECT 'parquet', count(*), round(sum(s_acctbal), 2) FROM supplier")
def s4_write_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in both forms holds the same rows."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    csv = sources.read_csv(spark, _written(rows, "csv"), rows.schema)
    parquet = spark.read.parquet(_written(rows, "parquet"))
    both = csv.withColumn("form", F.lit("csv")).unionByName(parquet.withColumn("form", F.lit("parquet")))
    return both.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"))
