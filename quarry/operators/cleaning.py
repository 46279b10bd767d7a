"""Imputation, outliers, scaling, duplicates and correlated columns."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.validity import missing, valid_number, value
from quarry.operators.profile import approximate_percentiles, bin_count, five_numbers, interpolated, percentiles, quartile_ranks, scaled_correlation
from quarry.operators.rank import at_ranks, linear_ranks, order_stats, prepared
from quarry.session import materialize

#: Classes whose means are broadcast.
BROADCAST_ROWS = 100_000


def column_modes(df: DataFrame, columns: list[str], id_col: str) -> dict[str, float]:
    """Most frequent value of each column, invalid ones included but not null or
    NaN; ties go to the value whose smallest id is smallest."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v"), F.col(id_col).alias("id")) for c in columns])
    long = df.select(F.inline(pairs)).where(~missing(F.col("v")))
    counts = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    return {r["column"]: r["mode"] for r in counts.groupBy("column").agg(F.max_by("v", F.struct("n", -F.col("first"))).alias("mode")).collect()}


def impute_mode(df: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    modes = column_modes(df, columns, id_col)
    return df.withColumns({c: F.coalesce(value(c), F.lit(modes.get(c))) for c in columns})


def impute_class_mean(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Invalid values become the mean of the valid ones of the row's class. The
    means, one row a class, are broadcast up to BROADCAST_ROWS classes, so that no
    task gets all rows of a class."""
    means = df.groupBy(F.col(label).alias("__l")).agg(*[F.avg(value(c)).alias(f"__m_{c}") for c in columns])
    means = materialize(means, "means")
    means = F.broadcast(means) if means.count() <= BROADCAST_ROWS else means
    joined = df.join(means, F.col(label).eqNullSafe(F.col("__l")), "left")
    return joined.withColumns({c: F.coalesce(value(c), F.col(f"__m_{c}")) for c in columns}).drop("__l", *[f"__m_{c}" for c in columns])


def impute_by_period(df: DataFrame, columns: list[str], period: str, zone: str, method: str = "mean", id_col: str | None = None) -> DataFrame:
    """Missing values become the mean (or mode, ties by smallest id) of those seen
    in the same period, or else in the same zone, as they were before any fill."""
    out = df
    for key, tag in ((period, "p"), (zone, "z")):
        if method == "mean":
            stats = df.groupBy(F.col(key).alias(f"__{tag}")).agg(*[F.avg(F.when(~missing(F.col(c)), F.col(c))).alias(f"__{tag}_{c}") for c in columns])
        else:
            pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"), F.col(id_col).alias("id")) for c in columns])
            long = df.select(F.col(key).alias("k"), F.inline(pairs)).where(~missing(F.col("v")))
            counts = long.groupBy("k", "column", "v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
            modes = counts.groupBy("k", "column").agg(F.max_by("v", F.struct("n", -F.col("first"))).alias("m"))
            stats = modes.groupBy(F.col("k").alias(f"__{tag}")).pivot("column", columns).agg(F.first("m")).withColumnsRenamed({c: f"__{tag}_{c}" for c in columns})
        out = out.join(stats, F.col(key).eqNullSafe(F.col(f"__{tag}")), "left")
    filled = {c: F.coalesce(F.when(~missing(F.col(c)), F.col(c)), F.col(f"__p_{c}"), F.col(f"__z_{c}")) for c in columns}
    return out.withColumns(filled).select(*df.columns)


def fences(df: DataFrame, columns: list[str], reach: float = 1.5, accuracy: int | None = None) -> dict[str, tuple[float, float]]:
    """Bounds by linear percentiles of all columns together; with an accuracy, by
    approximate ones of one pass."""
    shares = [0.25, 0.75]
    q = approximate_percentiles(df, columns, shares, accuracy, False) if accuracy else percentiles(df, columns, shares, only_valid=False)
    return {c: (ab[0] - reach * (ab[1] - ab[0]), ab[1] + reach * (ab[1] - ab[0])) for c, ab in q.items() if ab}


def is_outlier(c: str, bounds: tuple[float, float]) -> Column:
    return F.coalesce((F.col(c) < bounds[0]) | (F.col(c) > bounds[1]), F.lit(False))


def flag_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add <column>_outlier for every column."""
    bounds = fences(df, columns)
    return df.withColumns({f"{c}_outlier": is_outlier(c, bounds[c]) if c in bounds else F.lit(False) for c in columns})


def winsorize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values beyond the quarter points by one and a half linear quartile distances
    become the 20th or 80th percentile (between them, the median); statistics are
    those before any change."""
    of = {f"all {c}": F.col(c) for c in columns} | {f"valid {c}": value(c) for c in columns}
    shares = [0.2, 0.25, 0.5, 0.75, 0.8]
    stats = order_stats(df, of, lambda n: [r for p in [*quartile_ranks(n), *(x[:2] for x in linear_ranks(n, shares))] for r in p])
    changed = {}
    for c in columns:
        five = five_numbers(*stats[f"valid {c}"])
        if not five:
            continue
        p20, p25, p50, p75, p80 = interpolated(*stats[f"all {c}"], shares)
        reach = 1.5 * (p75 - p25)
        x = F.col(c)
        out = (x > five[3] + reach) | (x < five[1] - reach)
        changed[c] = F.when(out, F.when(x < p20, p20).when(x > p80, p80).otherwise(p50)).otherwise(x)
    return df.withColumns(changed)


def chunk_stats(df: DataFrame, column: str, size: int, how: str) -> list[tuple[float, float]]:
    """(first value, median or mean) of each run of `size` values in ascending order."""
    ranked, rows = prepared(df, {column: F.col(column)})
    n = rows[column]
    starts = list(range(0, n, size))
    if how == "median":
        mid = {s: (s + (min(size, n - s) - 1) // 2, s + min(size, n - s) // 2) for s in starts}
        at = at_ranks(ranked, {column: [*starts, *(r for p in mid.values() for r in p)]})[column]
        return [(at[s], (at[mid[s][0]] + at[mid[s][1]]) / 2) for s in starts]
    chunks = F.sequence(F.expr(f"first div {size}"), F.expr(f"(first + n - 1) div {size}"))
    parts = ranked.select("v", "n", "first", F.explode(chunks).alias("k"))
    inside = F.least(F.expr("first + n"), (F.col("k") + 1) * size) - F.greatest("first", F.col("k") * size)
    sums = parts.groupBy("k").agg(F.min("v").alias("a"), (F.sum(F.col("v") * inside) / F.sum(inside)).alias("m")).orderBy("k")
    return [(r["a"], r["m"]) for r in sums.collect()]


def equal_depth(df: DataFrame, column: str, bins: int | None = None, how: str = "mean", size: int | None = None) -> DataFrame:
    """Every value becomes the mean (or median) of its run: the last run of
    ceil(n / bins) ascending values that starts at or below it."""
    size = size or math.ceil(df.count() / (bins or 1)) or 1
    stats = chunk_stats(df, column, size, how)
    if not stats:
        return df
    starts, means = np.array([a for a, _ in stats]), np.array([m for _, m in stats])

    @F.pandas_udf("double")
    def of_run(values: pd.Series) -> pd.Series:
        at = np.searchsorted(starts, values, side="right") - 1
        return pd.Series(np.where(values.isna() | (at < 0), np.nan, means[np.maximum(at, 0)])).where(values.notna())

    x = F.col(column).cast("double")
    return df.withColumn(column, F.when(x.isNotNull(), of_run(x)))


def smooth_by_depth(df: DataFrame, column: str, how: str = "median") -> DataFrame:
    """Equal-depth runs of ceil(n / (1 + 10/3 log10 n)) values, each to its median."""
    n = df.count()
    size = math.ceil(n / (1 + 10 / 3 * math.log10(n))) if n > 1 else 1
    return equal_depth(df, column, how=how, size=size)


def equal_width(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """Every value becomes the mean of its bin of width (max - min) / bins; the
    maximum keeps its value. bins defaults to bin_count of the rows."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).first()
    k = bins or bin_count(row["n"])
    if row["a"] is None or row["a"] == row["b"]:
        return df
    width = (row["b"] - row["a"]) / k
    at = F.least(F.floor((F.col(column) - row["a"]) / width), F.lit(k - 1))
    x = F.col(column)
    means = df.groupBy(at.alias("__k")).agg(F.avg(column).alias("__m"))
    joined = df.withColumn("__k", at).join(F.broadcast(means), "__k", "left")  # one row a bin
    return joined.withColumn(column, F.when(x == row["b"], x).otherwise(F.col("__m"))).select(*df.columns)


@dataclass
class Repair:
    """How outliers of a column are repaired: the bounds of its inliers, and a linear
    prediction from other columns."""

    column: str
    low: float
    high: float
    intercept: float
    weights: dict[str, float]

    def apply(self, df: DataFrame) -> DataFrame:
        guess = F.lit(self.intercept)
        for x, w in self.weights.items():
            guess = guess + F.lit(w) * F.col(x).cast("double")
        return df.withColumn(self.column, F.when(is_outlier(self.column, (self.low, self.high)), guess).otherwise(F.col(self.column)))


def triangular_factor(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray]:
    """How many rows have no null in the columns, and the R of a QR factorisation of
    those rows, as doubles, behind a column of ones.

    A task folds its batches into one R of its own; those are folded once more in about
    as many tasks as the square root of them, and last in the driver. No products of
    columns are formed, so nearly dependent columns lose no more digits than they have.
    """
    width = len(columns) + 1

    def folded(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.linalg.qr(np.vstack([r, rows]), mode="r") if len(rows) else r

    def packed(n: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "r": pa.array([r.ravel().tolist()], pa.list_(pa.float64()))})

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, r = 0, np.zeros((0, width))
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *(batch.column(i).to_numpy(zero_copy_only=False) for i in range(width - 1))])
            n, r = n + len(x), folded(r, x)
        yield packed(n, r)

    def of_factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, r = 0, np.zeros((0, width))
        for batch in batches:
            for m, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, r = n + m, folded(r, np.array(x).reshape(-1, width))
        yield packed(n, r)

    given = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna()
    parts = given.mapInArrow(of_rows, "n long, r array<double>")
    tasks = max(1, math.isqrt(df.sparkSession.sparkContext.defaultParallelism))
    n, r = 0, np.zeros((0, width))
    for row in parts.repartition(tasks).mapInArrow(of_factors, "n long, r array<double>").collect():
        n, r = n + row["n"], folded(r, np.array(row["r"]).reshape(-1, width))
    return n, r


def least_squares(df: DataFrame, xs: list[str], y: str) -> tuple[float, dict[str, float]] | None:
    """Intercept and weights of the regression of y on xs over the rows without a null;
    of all best weights the shortest. None without rows."""
    n, r = triangular_factor(df, [*xs, y])
    if not n:
        return None
    means = r[0, 1:] / r[0, 0]
    centred = r[1:, 1:]  # what is left of the rows without their means
    beta = np.linalg.lstsq(centred[:, :-1], centred[:, -1], rcond=np.finfo(float).eps * max(n, len(xs)))[0] if len(centred) else np.zeros(len(xs))
    return float(means[-1] - beta @ means[:-1]), dict(zip(xs, beta.tolist()))


def fit_repairs(df: DataFrame, columns: list[str], others: list[str]) -> list[Repair]:
    """A repair for each column in turn, fitted after the earlier ones are applied: a
    linear regression with intercept on all other columns and `others`, over the rows
    where the column is no outlier. No repair changes another column's values, so the
    bounds of all columns are found together; then it is one pass a column."""
    out, repairs, bounds = df, [], fences(df, columns)
    for c in columns:
        if c not in bounds:
            continue
        xs = [x for x in [*columns, *others] if x != c]
        fit = least_squares(out.where(~is_outlier(c, bounds[c])), xs, c)
        if fit:
            repairs.append(Repair(c, float(bounds[c][0]), float(bounds[c][1]), *fit))
            out = repairs[-1].apply(out)
    return repairs


def regression_repair(df: DataFrame, columns: list[str], others: list[str]) -> DataFrame:
    """Outliers of each column in turn become the predictions of fit_repairs. The rows
    are written down first, since bounds and every fit read them."""
    df = materialize(df, "rows")
    for repair in fit_repairs(df, columns, others):
        df = repair.apply(df)
    return df


def min_max(df: DataFrame, columns: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    row = df.agg(*[F.min(c).alias(f"a_{c}") for c in columns], *[F.max(c).alias(f"b_{c}") for c in columns]).first()
    scaled = {c: F.lit(low) + (high - low) * F.try_divide(F.col(c) - F.lit(row[f"a_{c}"]), F.lit(row[f"b_{c}"]) - F.lit(row[f"a_{c}"])) for c in columns}
    return df.withColumns(scaled)


def z_score(df: DataFrame, columns: list[str], by: str = "variance") -> DataFrame:
    """Distance from the mean, in population variances (or, by="std", deviations)."""
    spread = F.var_pop if by == "variance" else F.stddev_pop
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[spread(c).alias(f"s_{c}") for c in columns]).first()
    return df.withColumns({c: F.try_divide(F.col(c) - F.lit(row[f"m_{c}"]), F.lit(row[f"s_{c}"])) for c in columns})


def distinct_rows(df: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    """Distinct values of the columns, each with its smallest id; -0.0 is 0.0."""
    same = [(F.col(c) + 0.0 if t in ("double", "float") else F.col(c)).alias(c) for c, t in df.dtypes if c in columns]
    return df.select(*same, id_col).groupBy(*columns).agg(F.min(id_col).alias(id_col))


def correlated_columns(df: DataFrame, columns: list[str], label: str, threshold: float = 0.75) -> list[str]:
    """Columns whose scaled correlation with a later one, the label last, exceeds
    the threshold."""
    found = scaled_correlation(df, [*columns, label]).where(F.abs("r") > threshold).select("a").distinct().collect()
    names = {r["a"] for r in found}
    return [c for c in columns if c in names]


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    out = df
    for c in columns:
        out = out.where(valid_number(F.col(c)))
    return out


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_distinct) counts of non-null values; 0.0 and -0.0 are one value. Each
    distinct value is one row of one shuffle, whatever the number of columns."""
    kinds = dict(df.dtypes)
    text = lambda c: (F.col(c) + 0.0 if kinds[c] in ("double", "float") else F.col(c)).cast("string")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), text(c).alias("v")) for c in columns])
    seen = df.select(F.inline(pairs)).where("v is not null").distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    spine = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return spine.join(F.broadcast(seen), "column", "left").select("column", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))  # one row a column
