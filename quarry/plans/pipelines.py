"""Composed cleaning jobs, and cleaning learnt on one table and applied to another."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.validity import value
from quarry.operators import cleaning, rollup
from quarry.session import materialize, parted


def clean_observations(df: DataFrame, columns: list[str], label: str, id_col: str, threshold: float = 0.75) -> DataFrame:
    """Impute by class mean, repair outliers by regression, keep distinct rows, drop
    correlated columns, scale to [0, 1]."""
    out = cleaning.impute_class_mean(df, columns, label)
    out = materialize(cleaning.regression_repair(out, columns, [label]), "repaired")
    out = cleaning.distinct_rows(out, [*columns, label], id_col)
    dropped = cleaning.correlated_columns(out, columns, label, threshold)
    kept = [c for c in columns if c not in dropped]
    return cleaning.min_max(out.drop(*dropped), kept)


def clean_periods(df: DataFrame, measures: list[str], repair: str = "winsorize") -> DataFrame:
    """Repair both dates, fill gaps by period and zone, repair outliers of the
    measures (winsorize, or by depth)."""
    out = rollup.repair_dates(df, "period", ["start_text", "end_text"])
    out = materialize(cleaning.impute_by_period(out, measures, "period", "zone"), "filled")
    if repair == "winsorize":
        return cleaning.winsorize(out, measures)
    for c in measures:
        out = cleaning.smooth_by_depth(out, c)
    return out


def fit_cleaning(df: DataFrame, columns: list[str], label: str, threshold: float = 0.75) -> DataFrame:
    """What cleaning learns from a table, one row a column, in order: (place, column,
    class_means as JSON, repair as JSON, dropped, least, most). The steps are those
    of clean_observations, but for regressions that do not look at the label, which
    new rows may lack: class means of valid values; a repair of outliers from the
    other columns; which columns correlate; the bounds of what is left."""
    means = {str(r[label]): r for r in df.groupBy(label).agg(*[F.avg(value(c)).alias(c) for c in columns]).collect()}
    filled = materialize(cleaning.impute_class_mean(df, columns, label).select(label, *columns), "filled")
    repairs = cleaning.fit_repairs(filled, columns, [])
    for repair in repairs:
        filled = repair.apply(filled)
    filled = materialize(filled, "repaired").select(label, *columns)
    hashed = filled.withColumn("__h", F.xxhash64(label, *[F.col(c) + 0.0 for c in columns]))
    distinct = parted(hashed, filled.count(), "__h").dropDuplicates(["__h", label, *columns]).drop("__h")
    gone = cleaning.correlated_columns(distinct, columns, label, threshold)
    row = filled.agg(*[F.min(c).alias(f"a_{c}") for c in columns], *[F.max(c).alias(f"b_{c}") for c in columns]).first()
    known = {r.column: json.dumps(asdict(r)) for r in repairs}
    rows = [(i, c, json.dumps({k: r[c] for k, r in means.items()}), known.get(c), c in gone, row[f"a_{c}"], row[f"b_{c}"]) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "place int, column string, class_means string, repair string, dropped boolean, least double, most double")


def apply_cleaning(df: DataFrame, params: DataFrame, label: str | None = None) -> DataFrame:
    """Clean any rows with what fit_cleaning learnt: fill (by the class, or the mean of
    the class means where there is no label or an unknown one), repair outliers, drop
    correlated columns, scale by the learnt bounds; what lies beyond them is moved to
    them, so all values are within [0, 1]. Every row of df has its row."""
    learnt = params.orderBy("place").collect()
    fills = {}
    for p in learnt:
        means = {k: v for k, v in json.loads(p["class_means"]).items() if v is not None}
        overall = F.lit(sum(means.values()) / len(means) if means else 0.0)
        fill = overall
        if label and means:
            table = F.create_map(*[x for k, v in means.items() for x in (F.lit(k), F.lit(v))])
            fill = F.coalesce(F.try_element_at(table, F.col(label).cast("string")), overall)
        fills[p["column"]] = F.coalesce(value(p["column"]), fill)
    out = df.withColumns(fills)
    for p in learnt:
        if p["repair"]:
            out = cleaning.Repair(**json.loads(p["repair"])).apply(out)
    out = out.drop(*[p["column"] for p in learnt if p["dropped"]])
    scaled = {}
    for p in learnt:
        if not p["dropped"]:
            x = F.least(F.greatest(F.col(p["column"]), F.lit(p["least"])), F.lit(p["most"]))
            scaled[p["column"]] = F.try_divide(x - F.lit(p["least"]), F.lit(p["most"]) - F.lit(p["least"]))
    return out.withColumns(scaled)
