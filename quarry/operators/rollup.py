"""Calendar repair and rollups of a zone by period table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.dates import full_date, mixed_date


def year_intervals(df: DataFrame, period: str, text: str) -> DataFrame:
    """(year, low, high): first and last period of the fully dated rows of each year."""
    dated = df.select(F.year(full_date(F.col(text))).alias("year"), period).where("year is not null")
    return dated.groupBy("year").agg(F.min(period).alias("low"), F.max(period).alias("high"))


def year_of_period(df: DataFrame, period: str, intervals: DataFrame, name: str = "year") -> DataFrame:
    """Add the first year whose interval holds the period, null if none does. The
    intervals, one a year, are broadcast; distinct periods are looked up once."""
    known = F.broadcast(intervals)
    periods = df.select(F.col(period).alias("__p")).distinct()
    years = periods.join(known, F.col("__p").between(F.col("low"), F.col("high")), "left").groupBy("__p").agg(F.min("year").alias(name))
    return df.join(years, F.col(period).eqNullSafe(F.col("__p")), "left").drop("__p")


def repair_dates(df: DataFrame, period: str, columns: list[str], roll_over: bool = False) -> DataFrame:
    """Replace mixed-notation texts by dates; the first column tells the intervals.
    With roll_over, an end (last column) before its start moves on by a year."""
    placed = year_of_period(df, period, year_intervals(df, period, columns[0]), "__year")
    out = placed.withColumns({c: mixed_date(F.col(c), F.col("__year")) for c in columns}).drop("__year")
    if roll_over and len(columns) > 1:
        start, end = F.col(columns[0]), F.col(columns[-1])
        out = out.withColumn(columns[-1], F.when(end < start, F.add_months(end, 12)).otherwise(end))
    return out


def totals(df: DataFrame, by: list[str | Column], measures: dict[str, str]) -> DataFrame:
    """Sums by the given keys; nulls are skipped, and a group without values has 0."""
    return df.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(name) for name, c in measures.items()])


def shares(sums: DataFrame, column: str, name: str = "share") -> DataFrame:
    """Add each row's share of the total of a small grouped result."""
    return sums.withColumn(name, F.try_divide(F.col(column), F.sum(column).over(Window.partitionBy(F.lit(0)))))


def stack_offsets(sums: DataFrame, across: str, along: str, column: str, name: str = "offset") -> DataFrame:
    """Add the running sum of the rows before, along one key within another."""
    before = Window.partitionBy(across).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn(name, F.coalesce(F.sum(column).over(before), F.lit(0.0)))


def pivot_totals(df: DataFrame, row: str, column: str, values: list, measure: str) -> DataFrame:
    """One row a `row`, one column a value; missing cells are 0."""
    wide = df.groupBy(row).pivot(column, values).agg(F.sum(measure))
    return wide.fillna(0.0, subset=[str(v) for v in values])


def series(df: DataFrame, zone: str, which, date: str, year: int, month: int, measure: str) -> DataFrame:
    """Dates and values of one zone in one month of one year, by date."""
    keep = (F.col(zone) == which) & (F.year(date) == year) & (F.month(date) == month)
    return df.where(keep).select(date, measure).orderBy(date, measure)


def extreme(sums: DataFrame, column: str, key: str, n: int, ascending: bool = True) -> DataFrame:
    """The n groups with the smallest sums (or largest), ties by key."""
    order = F.col(column).asc() if ascending else F.col(column).desc()
    return sums.orderBy(order, key).limit(n)


def busiest(df: DataFrame, by: str, value: Column, name: str) -> DataFrame:
    """The most frequent value of each group; ties go to the smallest."""
    counts = df.groupBy(by, value.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(by).agg(F.min_by(name, F.struct(-F.col("n"), F.col(name))).alias(name), F.max("n").alias("n"))
