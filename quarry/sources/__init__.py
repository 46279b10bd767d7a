"""Readers and writers of tables in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV file with a header, under a declared schema."""
    return spark.read.schema(schema).csv(path, header=True)


def _as_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.schema(schema).csv(path, header=True, quote='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def read_numeric_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Every column as double; text that is no number becomes null."""
    return _as_text(spark, path, columns).select(*[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in columns])


def read_decimal_comma_csv(spark: SparkSession, path: str, numeric: list[str], text: list[str]) -> DataFrame:
    """Quoted numbers with a decimal comma, in the order numeric, then text."""
    raw = _as_text(spark, path, numeric + text)
    numbers = [F.expr(f"try_cast(replace(`{c}`, ',', '.') AS double)").alias(c) for c in numeric]
    return raw.select(*numbers, *text)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a result as Parquet, or as CSV with a header."""
    writer = df.write.mode(mode)
    writer.csv(path, header=True) if fmt == "csv" else writer.format(fmt).save(path)
