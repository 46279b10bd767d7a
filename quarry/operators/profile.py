"""Profiles of numeric columns."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.validity import all_valid, value
from quarry.operators.evaluate import place
from quarry.operators.rank import linear_ranks, order_stats, order_stats_with

MOST_MODES = 1_000_000
#: Size of a distinct-count summary (log2 of its registers: an error of about 0.8 %) and of
#: a quantile summary (ranks met to within about 0.7 %).
HLL_BITS = 14
KLL_SIZE = 400


def sketched(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, total, least, most, distinct, quantiles): one row a column with
    summaries of bounded size that can be merged, of the non-null values."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(F.inline(pairs)).where("v is not null")
    return long.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("most"),
        F.hll_sketch_agg(F.col("v").cast("string"), HLL_BITS).alias("distinct"), F.kll_sketch_agg_double("v", KLL_SIZE).alias("quantiles"),
    )


def merged_sketches(parts: DataFrame) -> DataFrame:
    """One row a column from the sketches of several parts of a table: those of old
    partitions are kept, so a profile of appended data reads only what is new."""
    return parts.groupBy("column").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"),
    )


def read_sketches(sketches: DataFrame, shares: list[float]) -> DataFrame:
    """(column, n, mean, least, most, n_distinct, quantiles): what sketches tell; the
    distinct count and the quantiles are estimates (see HLL_BITS and KLL_SIZE)."""
    at = F.array(*[F.kll_sketch_get_quantile_double("quantiles", F.lit(float(s))) for s in shares])
    return sketches.select("column", "n", (F.col("total") / F.col("n")).alias("mean"), "least", "most", F.hll_sketch_estimate("distinct").alias("n_distinct"), at.alias("quantiles"))


def pair_sample(df: DataFrame, a: str, b: str, id_col: str, grid: int = 64, per_cell: int = 8, seed: int = 1) -> DataFrame:
    """(id, a, b, n) for drawing two columns against each other: the plane of their
    values is cut into grid x grid cells, and of each cell the per_cell rows stay whose
    seeded hashes are least, with the number n of the cell's rows. Every occupied cell
    has a row, so thin regions stay visible, and no more than grid * grid * per_cell
    rows come back. Rows without both values are left out."""
    known = df.select(F.col(id_col).alias("id"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).where("a is not null and b is not null and not isnan(a) and not isnan(b)")
    edge = known.agg(*[f(c).alias(f"{n}{c}") for c in ("a", "b") for f, n in ((F.min, "low"), (F.max, "high"))]).first()

    def cell(c: str) -> Column:
        low, high = edge[f"low{c}"], edge[f"high{c}"]
        if low is None or low == high:
            return F.lit(0)
        return F.least(F.floor((F.col(c) - low) / ((high - low) / grid)), F.lit(grid - 1)).cast("int")

    placed = known.withColumns({"i": cell("a"), "j": cell("b"), "h": place("id", seed)})
    # the bottom of a crowded cell is taken in two steps, so that no task holds the cell
    part = Window.partitionBy("i", "j", F.pmod(F.col("h"), F.lit(256))).orderBy("h", "id")
    sizes = placed.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    some = placed.withColumn("r", F.row_number().over(part)).where(F.col("r") <= per_cell)
    whole = Window.partitionBy("i", "j").orderBy("h", "id")
    kept = some.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= per_cell)
    return kept.join(F.broadcast(sizes), ["i", "j"]).select("id", F.col("a").alias(a), F.col("b").alias(b), "n")  # one row a cell


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: count, mean, sample deviation, minimum, quartiles by
    linear interpolation, maximum, of non-null values; and the table's rows."""
    shares = [0.25, 0.5, 0.75]
    also = {"mean": F.avg("v"), "std": F.stddev_samp("v"), "least": F.min("v"), "most": F.max("v"), "rows": F.count(F.lit(1))}
    stats, others = order_stats_with(df, {c: F.col(c) for c in columns}, lambda n: [r for a, b, _ in linear_ranks(n, shares) for r in (a, b)], also)
    rows = []
    for c, (n, at) in stats.items():
        o = others[c]
        rows.append((c, n, o.get("mean"), o.get("std"), o.get("least"), *(interpolated(n, at, shares) or [None] * 3), o.get("most"), o.get("rows", 0)))
    return df.sparkSession.createDataFrame(rows, "column string, n long, mean double, std double, least double, q25 double, q50 double, q75 double, most double, rows long")


def central_tendency(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mean, median, modes, deviation) of the valid values; all modes, in
    order; the deviation divides by their number. Columns without valid values have
    no row; one with more than MOST_MODES modes is refused (see mode_rows)."""
    long = unpivoted(df, columns)
    counts = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("column").agg(F.max("n").alias("n"))
    most = counts.join(F.broadcast(top), ["column", "n"])
    crowd = most.groupBy("column").count().where(F.col("count") > MOST_MODES).first()
    if crowd:
        raise ValueError(f"{crowd['column']} has {crowd['count']} modes, more than one row should hold; use mode_rows")
    modes = most.groupBy("column").agg(F.array_sort(F.collect_list("v")).alias("modes"))
    stats = long.groupBy("column").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"))
    middle = percentiles(df, columns, [0.5])
    medians = df.sparkSession.createDataFrame([(c, m[0]) for c, m in middle.items() if m], "column string, median double")
    return stats.join(F.broadcast(medians), "column").join(modes, "column").select("column", "mean", "median", "modes", "deviation")


def mode_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mode, n): the modes of the valid values as rows, for columns with
    more of them than one row should hold."""
    counts = unpivoted(df, columns).groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("column").agg(F.max("n").alias("n"))
    return counts.join(F.broadcast(top), ["column", "n"]).select("column", F.col("v").alias("mode"), "n")  # one row a column


def unpivoted(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, v): the valid values of several columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("v")) for c in columns])
    return df.select(F.inline(pairs)).where("v is not null")


def percentiles(df: DataFrame, columns: list[str], shares: list[float], only_valid: bool = True) -> dict[str, list[float] | None]:
    """Percentiles by linear interpolation, of all columns together (None for a
    column without values)."""
    stats = order_stats(df, {c: value(c) if only_valid else F.col(c) for c in columns}, lambda n: [r for a, b, _ in linear_ranks(n, shares) for r in (a, b)])
    return {c: interpolated(n, at, shares) for c, (n, at) in stats.items()}


def interpolated(n: int, at: dict[int, float], shares: list[float]) -> list[float] | None:
    return [at[a] + (at[b] - at[a]) * w for a, b, w in linear_ranks(n, shares)] if n else None


def approximate_percentiles(df: DataFrame, columns: list[str], shares: list[float], accuracy: int = 10_000, only_valid: bool = True) -> dict[str, list[float] | None]:
    """Percentiles of all columns from one pass of bounded summaries: ranks are met to
    within one in `accuracy`."""
    of = [F.percentile_approx((value(c) if only_valid else F.col(c)).cast("double"), shares, accuracy).alias(f"q{i}") for i, c in enumerate(columns)]
    row = df.agg(*of).first()
    return {c: row[f"q{i}"] for i, c in enumerate(columns)}


def quartile_ranks(n: int, rule: str = "average") -> list[tuple[int, int]]:
    """Ranks whose means are the five numbers of n values. Rule "average": the quarter
    points are the means of the ranks n//4-1 and n//4, and 3n//4-1 and 3n//4. Rule
    "halves": for an odd number of values the ranks n//4 and 3n//4 themselves, for an
    even one the means of (n//2)//2 and 3(n//2)//2 with the rank before each."""
    q1, q3, half = n // 4, 3 * n // 4, n // 2
    if rule == "average":
        pairs = [(q1 - 1, q1), (q3 - 1, q3)]
    elif n % 2:
        pairs = [(q1, q1), (q3, q3)]
    else:
        pairs = [(half // 2 - 1, half // 2), (3 * half // 2 - 1, 3 * half // 2)]
    pairs = [(max(0, a), b) for a, b in pairs]
    return [(0, 0), pairs[0], ((n - 1) // 2, n // 2), pairs[1], (n - 1, n - 1)]


def five_numbers(n: int, at: dict[int, float], rule: str = "average") -> list[float]:
    return [(at[a] + at[b]) / 2 for a, b in quartile_ranks(n, rule)] if n else []


def all_quartiles(df: DataFrame, columns: list[str], rule: str = "average") -> dict[str, list[float]]:
    """Five numbers of the valid values of every column (none for a column without
    any), by the rules of quartile_ranks."""
    stats = order_stats(df, {c: value(c) for c in columns}, lambda n: [r for p in quartile_ranks(n, rule) for r in p])
    return {c: five_numbers(n, at, rule) for c, (n, at) in stats.items()}


def quartiles(df: DataFrame, column: str, rule: str = "average") -> list[float]:
    return all_quartiles(df, [column], rule)[column]


def bin_count(rows: int) -> int:
    return math.ceil(1 + 10 / 3 * math.log10(rows)) if rows > 0 else 1


def histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """(bin, low, high, n): equal widths over the valid values, the last bin closed;
    empty bins are there too. bins defaults to bin_count of all rows."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.min(value(column)).alias("a"), F.max(value(column)).alias("b")).first()
    k = bins or bin_count(row["rows"])
    low, high = row["a"] or 0.0, row["b"] or 0.0
    width = (high - low) / k or 1.0
    at = F.least(F.floor((value(column) - low) / width), F.lit(k - 1)).cast("int")
    counts = df.where(value(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.range(k).select(F.col("id").cast("int").alias("bin"))
    edge = lambda i: F.lit(low) + i * F.lit(width)
    return spine.join(counts, "bin", "left").select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def box_plot(df: DataFrame, column: str) -> tuple[list[float], DataFrame]:
    """The five numbers, and the valid values with a flag: outliers do not lie
    strictly within one and a half quartile distances of the quarter points."""
    five = quartiles(df, column)
    spread = 1.5 * (five[3] - five[1]) if five else 0.0
    low, high = (five[1] - spread, five[3] + spread) if five else (0.0, 0.0)
    flagged = df.select(value(column).alias("v")).where("v is not null")
    return five, flagged.withColumn("outlier", ~((F.col("v") > low) & (F.col("v") < high)))


def scaled_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for a before b: the covariance over n - 1, divided by the
    population deviations, that is Pearson's r times n / (n - 1); n counts the rows
    where both columns have a value."""
    pairs = list(combinations(columns, 2))
    n = lambda a, b: F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1))
    of = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.try_divide(F.corr(a, b) * n(a, b), n(a, b) - 1).alias("r")) for a, b in pairs]
    return df.agg(F.array(*of).alias("all")).select(F.inline("all"))


def correlation_matrix(df: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """(a, b, r), a before b: pairs of valid values; each deviation is that of the
    column's own valid values."""
    of = []
    for a, b in combinations(columns, 2):
        x, y = value(a), value(b)
        both = x.isNotNull() & y.isNotNull()
        top = F.avg(F.when(both, x * y)) - F.avg(F.when(both, x)) * F.avg(F.when(both, y))
        of.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.try_divide(top, F.stddev_pop(x) * F.stddev_pop(y)), digits).alias("r")))
    return df.agg(F.array(*of).alias("all")).select(F.inline("all"))


def complete_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r): Pearson's r over the rows where every column is valid."""
    of = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in combinations(columns, 2)]
    return df.where(all_valid(columns)).agg(F.array(*of).alias("all")).select(F.inline("all"))
