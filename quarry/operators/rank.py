"""Exact order statistics without a window over the whole table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import materialize

#: Distinct values of a column that one task ranks.
BUCKET_VALUES = 500_000
MOST_BUCKETS = 4_096
#: Approximate quantiles that bracket the wanted ranks of a column, and their accuracy.
BRACKETS = 500
ACCURACY = 10_000


def bucket_of(cuts: dict[str, list[float]], column: Column, v: Column) -> Column:
    """How many of its column's cuts lie below a value, by binary search (0 for a column
    without cuts)."""
    edges = {name: np.array(sorted(set(bounds)), float) for name, bounds in cuts.items()}

    @F.pandas_udf("int")
    def number(names: pd.Series, values: pd.Series) -> pd.Series:
        out = np.zeros(len(names), np.int32)
        for name in names.unique():
            if name in edges:
                at = (names == name).to_numpy()
                out[at] = np.searchsorted(edges[name], values[at], side="left")
        return pd.Series(out)

    return number(column, v)


def counted_values(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(column, v, n): how often every non-null value of each column occurs; all
    columns in one pass and one shuffle of partial counts."""
    pairs = F.array(*[F.struct(F.lit(name).alias("column"), c.cast("double").alias("v")) for name, c in columns.items()])
    return df.select(F.inline(pairs)).where("v is not null").groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))


def ranked_values(counts: DataFrame, distinct: dict[str, int], bucket_values: int = BUCKET_VALUES) -> DataFrame:
    """(column, v, n, first) of counted values: first is the 0-based rank of a value's
    first occurrence in ascending order. distinct: values of each column.

    Approximate quantiles cut columns of many values into buckets that are ranked one
    by one, and the sizes of the buckets before offset them.
    """
    buckets = {c: min(MOST_BUCKETS, -(-n // bucket_values)) for c, n in distinct.items()}
    bounds: dict[str, list[float]] = {}
    for k in sorted({k for k in buckets.values() if k > 1}):
        names = [c for c, m in buckets.items() if m == k]
        steps = [i / k for i in range(1, k)]
        cuts = counts.where(F.col("column").isin(names)).groupBy("column").agg(F.percentile_approx("v", steps, 20 * k).alias("cuts"))
        bounds |= {r["column"]: r["cuts"] for r in cuts.collect()}
    bucket = bucket_of(bounds, F.col("column"), F.col("v")) if bounds else F.lit(0)
    placed = counts.withColumn("bucket", bucket)
    within = Window.partitionBy("column", "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("local", F.coalesce(F.sum("n").over(within), F.lit(0)))
    if max(buckets.values(), default=1) <= 1:
        return local.select("column", "v", "n", F.col("local").alias("first"))
    before = Window.partitionBy("column").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("column", "bucket").agg(F.sum("n").alias("total"))
    offsets = sums.select("column", "bucket", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    joined = local.join(F.broadcast(offsets), ["column", "bucket"])  # MOST_BUCKETS rows a column at most
    return joined.select("column", "v", "n", (F.col("offset") + F.col("local")).alias("first"))


def prepared(df: DataFrame, columns: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """Ranked values of several columns, and how many non-null values each has."""
    counts = materialize(counted_values(df, columns), "counts")
    totals = {r["column"]: r for r in counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("rows")).collect()}
    ranked = ranked_values(counts, {c: r["distinct"] for c, r in totals.items()})
    return ranked, {c: totals[c]["rows"] if c in totals else 0 for c in columns}


def at_ranks(ranked: DataFrame, ranks: dict[str, list[int]]) -> dict[str, dict[int, float]]:
    """Values of each column at the given 0-based ranks, in one job."""
    found: dict[str, dict[int, float]] = {c: {} for c in ranks}
    wanted = {c: sorted({int(r) for r in rs if r >= 0}) for c, rs in ranks.items()}
    lists = F.array().cast("array<int>")
    for c, rs in wanted.items():
        if rs:
            lists = F.when(F.col("column") == c, F.array(*[F.lit(r).cast("long") for r in rs])).otherwise(lists)
    if not any(wanted.values()):
        return found
    inside = F.filter(lists, lambda r: (r >= F.col("first")) & (r < F.col("first") + F.col("n")))
    for row in ranked.select("column", F.explode(inside).alias("r"), "v").collect():
        found[row["column"]][row["r"]] = row["v"]
    return found


def order_stats(df: DataFrame, columns: dict[str, Column], ranks: Callable[[int], list[int]]) -> dict[str, tuple[int, dict[int, float]]]:
    """For each column its number of non-null values, n, and the values at ranks(n),
    0-based, in ascending order; NaN is the largest value. All columns share the passes
    (see order_stats_with)."""
    return order_stats_with(df, columns, ranks, {})[0]


def order_stats_with(
    df: DataFrame, columns: dict[str, Column], ranks: Callable[[int], list[int]], also: dict[str, Column]
) -> tuple[dict[str, tuple[int, dict[int, float]]], dict[str, dict]]:
    """order_stats, and for each column the aggregates `also` of its values v, nulls
    included, by name, from the same pass.

    One pass counts and takes approximate quantiles. Two of those bracket each wanted
    rank; a second pass counts what lies between brackets and keeps the values within,
    with how often they come. A bracket that missed its rank is widened to all values.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("c"), c.cast("double").alias("v")) for i, c in enumerate(columns.values())])
    shares = [i / BRACKETS for i in range(BRACKETS + 1)]
    every = df.select(F.inline(pairs))
    sums = every.groupBy("c").agg(F.count("v").alias("n"), F.percentile_approx("v", shares, ACCURACY).alias("q"), *[a.alias(n) for n, a in also.items()])
    known = {r["c"]: r.asDict() for r in sums.collect()}
    counted = {i: known[i]["n"] if i in known else 0 for i in range(len(columns))}
    wanted = {i: sorted({r for r in ranks(n) if 0 <= r < n}) if n else [] for i, n in counted.items()}
    found: dict[int, dict[int, float]] = {i: {} for i in wanted}
    brackets = {i: _brackets(counted[i], known[i]["q"], rs) for i, rs in wanted.items() if rs}
    while brackets:
        for i, at in _within_brackets(every.where("v is not null"), brackets, wanted).items():
            found[i] |= at
        brackets = {i: [(-np.inf, np.nan)] for i in brackets if len(found[i]) < len(wanted[i])}
    names = dict(enumerate(columns))
    return {c: (counted[i], found[i]) for i, c in names.items()}, {c: {n: known[i][n] for n in also} if i in known else {} for i, c in names.items()}


def _brackets(n: int, q: list[float], ranks: list[int]) -> list[tuple[float, float]]:
    """Ranges of values, apart from each other, that should hold the ranks."""
    out: list[tuple[float, float]] = []
    for r in ranks:
        at = (r + 1) / n * BRACKETS
        low, high = q[max(0, int(at - 0.5))], q[min(BRACKETS, int(at + 0.5) + 1)]
        low = -np.inf if at < 1 else low
        high = np.nan if at > BRACKETS - 1 else high  # up to the largest value, NaN included
        if out and not out[-1][1] < low:
            out[-1] = (out[-1][0], high if np.isnan(high) or not high < out[-1][1] else out[-1][1])
        else:
            out.append((low, high))
    return out


def _within_brackets(long: DataFrame, brackets: dict[int, list[tuple[float, float]]], wanted: dict[int, list[int]]) -> dict[int, dict[int, float]]:
    """The values at the wanted ranks of the columns, those that the brackets hold."""
    slot, inside = F.lit(0), F.lit(False)
    v = F.col("v")
    for i, ranges in brackets.items():
        place = F.lit(0)
        for k, (low, high) in enumerate(ranges):
            place = F.when((v >= low) & (v <= high), 2 * k + 1).when(v > high, 2 * k + 2).otherwise(place)
        slot = F.when(F.col("c") == i, place).otherwise(slot)
    inside = slot % 2 == 1
    counts = long.where(F.col("c").isin(list(brackets))).groupBy("c", slot.alias("slot"), F.when(inside, v).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "brackets")
    before: dict[tuple[int, int], int] = {}
    total: dict[int, int] = {}
    for r in counts.groupBy("c", "slot").agg(F.sum("n").alias("n")).orderBy("c", "slot").collect():
        before[r["c"], r["slot"]] = total.get(r["c"], 0)
        total[r["c"]] = before[r["c"], r["slot"]] + r["n"]
    offset, asked = F.lit(0), F.array().cast("array<bigint>")
    for (i, k), n in before.items():
        offset = F.when((F.col("c") == i) & (F.col("slot") == k), F.lit(n)).otherwise(offset)
    for i in brackets:
        asked = F.when(F.col("c") == i, F.array(*[F.lit(r).cast("bigint") for r in wanted[i]])).otherwise(asked)
    running = Window.partitionBy("c", "slot").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.where("slot % 2 = 1").withColumn("first", F.coalesce(F.sum("n").over(running), F.lit(0)) + offset)
    hit = F.filter(asked, lambda r: (r >= F.col("first")) & (r < F.col("first") + F.col("n")))
    out: dict[int, dict[int, float]] = {i: {} for i in brackets}
    for r in placed.select("c", "v", F.explode(hit).alias("r")).collect():  # as many as ranks were asked for
        out[r["c"]][r["r"]] = r["v"]
    return out


def linear_ranks(n: int, shares: list[float]) -> list[tuple[int, int, float]]:
    """The ranks around each share of n values, and the weight of the upper one."""
    out = []
    for s in shares:
        at = (n - 1) * s
        low = int(at)
        out.append((low, min(low + 1, n - 1), at - low))
    return out
