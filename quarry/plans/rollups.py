"""Queries: calendar repair, imputation and rollups of the zone by period table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import cleaning, rollup
from quarry.plans.pipelines import clean_periods
from quarry.plans.tables import DATED, MEASURES, PERIODS, dated, periods, table

QUERIES, SQL = {}, {}
ZONES = list(range(7))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _two(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 2) for c in columns})


@query("a13_zone_totals", f"WITH {DATED}, t AS (SELECT zone, coalesce(sum(cases), 0) AS cases FROM dated GROUP BY zone) SELECT zone, round(cases, 2) AS cases, round(cases / sum(cases) OVER (), 6) AS share FROM t")
def a13_zone_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals with their share of the whole."""
    sums = rollup.totals(dated(spark, sf_dir), ["zone"], {"cases": "cases"})
    return _two(rollup.shares(sums, "cases").withColumn("share", F.round("share", 6)), "cases")


_SUMS = ", ".join(f"round(coalesce(sum({c}), 0), 2) AS {c}" for c in MEASURES)


@query("a14_zone_measures", f"WITH {DATED} SELECT zone, {_SUMS} FROM dated GROUP BY zone")
def a14_zone_measures(spark, sf_dir):
    return _two(rollup.totals(dated(spark, sf_dir), ["zone"], {c: c for c in MEASURES}), *MEASURES)


@query("a15_monthly_totals", f"WITH {DATED} SELECT month, round(coalesce(sum(cases), 0), 2) AS cases FROM dated WHERE zone = 3 AND year = 1995 GROUP BY month")
def a15_monthly_totals(spark, sf_dir):
    rows = dated(spark, sf_dir).where("zone = 3 AND year = 1995")
    return _two(rollup.totals(rows, ["month"], {"cases": "cases"}), "cases")


@query("a16_annual_totals", f"WITH {DATED} SELECT year, round(coalesce(sum(cases), 0), 2) AS cases FROM dated WHERE zone = 3 GROUP BY year")
def a16_annual_totals(spark, sf_dir):
    return _two(rollup.totals(dated(spark, sf_dir).where("zone = 3"), ["year"], {"cases": "cases"}), "cases")


@query("a16_rollup_all", f"WITH {DATED} SELECT zone, year, month, round(coalesce(sum(cases), 0), 2) AS cases FROM dated GROUP BY ROLLUP (zone, year, month)")
def a16_rollup_all(spark, sf_dir):
    """R5, A15 and A16 for all zones at once."""
    return dated(spark, sf_dir).rollup("zone", "year", "month").agg(F.round(F.coalesce(F.sum("cases"), F.lit(0.0)), 2).alias("cases"))


@query("a17_year_by_zone", f"WITH {DATED} SELECT year, " + ", ".join(f"round(coalesce(sum(CASE WHEN zone = {z} THEN cases END), 0), 2) AS \"{z}\"" for z in ZONES) + " FROM dated GROUP BY year")
def a17_year_by_zone(spark, sf_dir):
    return _two(rollup.pivot_totals(dated(spark, sf_dir), "year", "zone", ZONES, "cases"), *map(str, ZONES))


@query("w2_stack_offsets", f"WITH {DATED}, t AS (SELECT year, zone, coalesce(sum(cases), 0) AS cases FROM dated GROUP BY year, zone) SELECT year, zone, round(cases, 2) AS cases, round(coalesce(sum(cases) OVER (PARTITION BY year ORDER BY zone ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS \"offset\" FROM t")
def w2_stack_offsets(spark, sf_dir):
    sums = rollup.totals(dated(spark, sf_dir), ["year", "zone"], {"cases": "cases"})
    return _two(rollup.stack_offsets(sums, "year", "zone", "cases"), "cases", "offset")


@query("a18_tests_by_population", f"WITH {DATED} SELECT population, round(coalesce(sum(tests), 0), 2) AS tests FROM dated GROUP BY population")
def a18_tests_by_population(spark, sf_dir):
    return _two(rollup.totals(dated(spark, sf_dir), ["population"], {"tests": "tests"}), "tests")


@query("a19_period_totals", f"WITH {DATED} SELECT zone, {_SUMS} FROM dated WHERE period = 67 GROUP BY zone")
def a19_period_totals(spark, sf_dir):
    return _two(rollup.totals(dated(spark, sf_dir).where("period = 67"), ["zone"], {c: c for c in MEASURES}), *MEASURES)


@query("a20_busiest_month", f"WITH {DATED} SELECT zone, month, n FROM (SELECT zone, month, count(*) AS n, row_number() OVER (PARTITION BY zone ORDER BY count(*) DESC, month) AS r FROM dated GROUP BY zone, month) WHERE r = 1")
def a20_busiest_month(spark, sf_dir):
    return rollup.busiest(dated(spark, sf_dir), "zone", F.col("month"), "month")


@query("k1_lowest_zones", f"WITH {DATED} SELECT zone, round(coalesce(sum(cases), 0), 2) AS cases FROM dated GROUP BY zone ORDER BY sum(cases), zone LIMIT 5")
def k1_lowest_zones(spark, sf_dir):
    """The feature is the limit: five zones with the smallest totals."""
    sums = rollup.totals(dated(spark, sf_dir), ["zone"], {"cases": "cases"})
    return _two(rollup.extreme(sums, "cases", "zone", 5), "cases")


@query("k1_highest_zones", f"WITH {DATED} SELECT zone, round(coalesce(sum(cases), 0), 2) AS cases FROM dated GROUP BY zone ORDER BY sum(cases) DESC, zone LIMIT 5")
def k1_highest_zones(spark, sf_dir):
    sums = rollup.totals(dated(spark, sf_dir), ["zone"], {"cases": "cases"})
    return _two(rollup.extreme(sums, "cases", "zone", 5, ascending=False), "cases")


@query("r5_month_series", f"WITH {DATED} SELECT date, cases FROM dated WHERE zone = 3 AND year = 1995 AND month = 8")
def r5_month_series(spark, sf_dir):
    return rollup.series(dated(spark, sf_dir), "zone", 3, "date", 1995, 8, "cases")


_INTERVALS = f"""{PERIODS}, full_dates AS (SELECT period, strptime(start_text, '%-m/%-d/%Y') AS d FROM periods WHERE start_text LIKE '%/%'),
years AS (SELECT year(d)::INTEGER AS year, min(period) AS low, max(period) AS high FROM full_dates GROUP BY 1)"""


@query("j1_year_of_period", f"WITH {_INTERVALS} SELECT zone, period, (SELECT min(year) FROM years WHERE period BETWEEN low AND high) AS year FROM periods")
def j1_year_of_period(spark, sf_dir):
    rows = periods(spark, sf_dir)
    return rollup.year_of_period(rows, "period", rollup.year_intervals(rows, "period", "start_text")).select("zone", "period", "year")


_DATE = "CASE WHEN {0} LIKE '%/%' THEN strptime({0}, '%-m/%-d/%Y')::DATE ELSE try_strptime({0} || '-' || year::VARCHAR, '%-d-%b-%Y')::DATE END AS {0}"


@query("t14_repair_dates", f"WITH {_INTERVALS}, placed AS (SELECT *, (SELECT min(year) FROM years WHERE period BETWEEN low AND high) AS year FROM periods) SELECT zone, period, {_DATE.format('start_text')}, {_DATE.format('end_text')} FROM placed")
def t14_repair_dates(spark, sf_dir):
    """F1, F2 and T14."""
    return rollup.repair_dates(periods(spark, sf_dir), "period", ["start_text", "end_text"]).select("zone", "period", "start_text", "end_text")


@query("f2_year_month", "SELECT o_orderkey, year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month FROM orders")
def f2_year_month(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))


@query("t15_impute_mean", f"WITH {PERIODS} SELECT zone, period, " + ", ".join(f"round(coalesce({c}, avg({c}) OVER (PARTITION BY period), avg({c}) OVER (PARTITION BY zone)), 4) AS {c}" for c in MEASURES) + " FROM periods")
def t15_impute_mean(spark, sf_dir):
    """T15 and T16 by means."""
    out = cleaning.impute_by_period(periods(spark, sf_dir), MEASURES, "period", "zone")
    return out.select("zone", "period", *[F.round(c, 4).alias(c) for c in MEASURES])


def _mode_sql(c: str, key: str) -> str:
    return f"(SELECT x.{c} FROM keyed x WHERE x.{key} = k.{key} AND x.{c} IS NOT NULL GROUP BY x.{c} ORDER BY count(*) DESC, min(x.id) LIMIT 1)"


@query("t15_impute_mode", f"WITH {PERIODS}, keyed AS (SELECT *, period * 10 + zone AS id FROM periods) SELECT zone, period, coalesce(tests, {_mode_sql('tests', 'period')}, {_mode_sql('tests', 'zone')}) AS tests FROM keyed k")
def t15_impute_mode(spark, sf_dir):
    rows = periods(spark, sf_dir).withColumn("id", F.col("period") * 10 + F.col("zone"))
    return cleaning.impute_by_period(rows, ["tests"], "period", "zone", "mode", "id").select("zone", "period", "tests")


_ROLLED = "CASE WHEN end_text < start_text THEN (end_text + INTERVAL 12 MONTH)::DATE ELSE end_text END AS end_text"


@query("t14_roll_over", f"WITH {_INTERVALS}, placed AS (SELECT *, (SELECT min(year) FROM years WHERE period BETWEEN low AND high) AS year FROM periods), repaired AS (SELECT zone, period, {_DATE.format('start_text')}, {_DATE.format('end_text')} FROM placed) SELECT zone, period, start_text, {_ROLLED} FROM repaired")
def t14_roll_over(spark, sf_dir):
    """T14 where ends that cross New Year roll over into the next year."""
    out = rollup.repair_dates(periods(spark, sf_dir), "period", ["start_text", "end_text"], roll_over=True)
    return out.select("zone", "period", "start_text", "end_text")


def _winsorized(c: str) -> str:
    mean = lambda a, b: f"(max(CASE WHEN r = {a} THEN {c} END) + max(CASE WHEN r = {b} THEN {c} END)) / 2"
    return f"""q_{c} AS (SELECT {mean('n // 4 - 1', 'n // 4')} AS q1, {mean('3 * n // 4 - 1', '3 * n // 4')} AS q3,
  (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM imputed) * 1.5::DOUBLE AS reach, (SELECT quantile_cont({c}, 0.2) FROM imputed) AS p20, (SELECT quantile_cont({c}, 0.5) FROM imputed) AS p50, (SELECT quantile_cont({c}, 0.8) FROM imputed) AS p80
  FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS r, count(*) OVER () AS n FROM imputed WHERE {c} IS NOT NULL AND ({c} = 0 OR {c} >= 1e-4::DOUBLE)))"""


def _moved(c: str) -> str:
    pick = lambda x: f"(SELECT {x} FROM q_{c})"
    return f"round(CASE WHEN {c} > {pick('q3')} + {pick('reach')} OR {c} < {pick('q1')} - {pick('reach')} THEN CASE WHEN {c} < {pick('p20')} THEN {pick('p20')} WHEN {c} > {pick('p80')} THEN {pick('p80')} ELSE {pick('p50')} END ELSE {c} END, 4) AS {c}"


@query("t17_clean_periods", f"WITH {_INTERVALS}, placed AS (SELECT *, (SELECT min(year) FROM years WHERE period BETWEEN low AND high) AS year FROM periods), repaired AS (SELECT zone, period, population, {_DATE.format('start_text')}, {_DATE.format('end_text')}, {', '.join(MEASURES)} FROM placed), imputed AS (SELECT zone, period, population, start_text, end_text, " + ", ".join(f"coalesce({c}, avg({c}) OVER (PARTITION BY period), avg({c}) OVER (PARTITION BY zone)) AS {c}" for c in MEASURES) + " FROM repaired), " + ", ".join(_winsorized(c) for c in MEASURES) + " SELECT zone, period, population, start_text, end_text, " + ", ".join(_moved(c) for c in MEASURES) + " FROM imputed")
def t17_clean_periods(spark, sf_dir):
    """Dates, then imputation, then winsorised measures."""
    out = clean_periods(periods(spark, sf_dir), MEASURES)
    return out.withColumns({c: F.round(c, 4) for c in MEASURES})
