"""Queries: profiles, cleaning and binning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import distance
from quarry.functions.validity import missing, null_if_nan, valid_number, valid_text
from quarry.operators import cleaning, clusters, evaluate, profile
from quarry.operators.rank import counted_values
from quarry.plans.pipelines import apply_cleaning, clean_observations, fit_cleaning
from quarry.plans.tables import CLEAN, FEATURES, FILLED, OBS, VALID, filled, observations, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _four(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("a1_describe", f"WITH {FILLED} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS least, quantile_cont({c}, 0.25) AS q25, "
    f"quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, max({c}) AS most, count(*) AS rows FROM filled" for c in ("f1", "f2", "f3")))  # fmt: skip
def a1_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _four(profile.describe(filled(spark, sf_dir), ["f1", "f2", "f3"]), ["mean", "std"], 4)


@query("r1_validity", f"WITH {OBS} SELECT label, " + ", ".join(f"sum(CASE WHEN {VALID.format(c)} THEN 0 ELSE 1 END)::BIGINT AS {c}" for c in FEATURES) + " FROM obs GROUP BY label")
def r1_validity(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return obs.groupBy("label").agg(*[F.sum((~valid_number(F.col(c))).cast("long")).alias(c) for c in FEATURES])


@query("r1_valid_text", "SELECT event_type, sum(CASE WHEN regexp_full_match(t, '\\d+\\.(:?\\d+)?') THEN 1 ELSE 0 END)::BIGINT AS n_valid, count(*) AS n FROM (SELECT event_type, CASE WHEN event_id % 3 = 0 THEN '-' || (event_id % 7)::VARCHAR || '.5' WHEN event_id % 3 = 1 THEN event_id::VARCHAR ELSE event_id::VARCHAR || '.' || (event_id % 10)::VARCHAR END AS t FROM events) GROUP BY event_type")
def r1_valid_text(spark, sf_dir):
    i = F.col("event_id")
    text = F.when(i % 3 == 0, F.concat(F.lit("-"), (i % 7).cast("string"), F.lit(".5"))).when(i % 3 == 1, i.cast("string")).otherwise(F.concat(i.cast("string"), F.lit("."), (i % 10).cast("string")))
    rows = table(spark, sf_dir, "events")
    return rows.groupBy("event_type").agg(F.sum(valid_text(text).cast("long")).alias("n_valid"), F.count(F.lit(1)).alias("n"))


@query("r4_complete_cases", f"WITH {OBS} SELECT label, count(*) AS n FROM obs WHERE " + " AND ".join(VALID.format(c) for c in FEATURES) + " GROUP BY label")
def r4_complete_cases(spark, sf_dir):
    return cleaning.complete_cases(observations(spark, sf_dir), FEATURES).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("r3_missing_kinds", "SELECT event_type, sum(CASE WHEN event_id % 5 < 2 THEN 1 ELSE 0 END)::BIGINT AS n_missing, count(*) AS n FROM events GROUP BY event_type")
def r3_missing_kinds(spark, sf_dir):
    """Nulls and NaN are one kind of missing."""
    x = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 1, F.lit(None)).otherwise(F.col("value"))
    rows = table(spark, sf_dir, "events").withColumn("x", x)
    both = missing(F.col("x")) & null_if_nan(F.col("x")).isNull()
    return rows.groupBy("event_type").agg(F.sum(both.cast("long")).alias("n_missing"), F.count(F.lit(1)).alias("n"))


@query("r6_pairs", f"WITH {OBS} SELECT id, f1, f3 FROM obs")
def r6_pairs(spark, sf_dir):
    return observations(spark, sf_dir).select("id", "f1", "f3")


_SAMPLE = f"""WITH {OBS}, known AS (SELECT id, f2, f4, ((id % 4294967296) * 2654435761::HUGEINT + 40503) % 4294967296 AS h FROM obs WHERE f2 IS NOT NULL AND f4 IS NOT NULL),
edge AS (SELECT min(f2) AS a0, max(f2) AS a1, min(f4) AS b0, max(f4) AS b1 FROM known),
cells AS (SELECT id, f2, f4, h, least(floor((f2 - a0) / ((a1 - a0) / 32)), 31) AS i, least(floor((f4 - b0) / ((b1 - b0) / 32)), 31) AS j FROM known, edge)
SELECT id, f2, f4, count(*) OVER (PARTITION BY i, j) AS n FROM cells QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY h, id) <= 5"""


@query("r6_pair_sample", _SAMPLE)
def r6_pair_sample(spark, sf_dir):
    """R6 for drawing: a few rows of every occupied cell of the plane."""
    return profile.pair_sample(observations(spark, sf_dir), "f2", "f4", "id", grid=32, per_cell=5)


@query("r7_sketched", f"WITH {OBS} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, min({c}) AS least, max({c}) AS most, TRUE AS distinct_close, TRUE AS quantiles_close FROM obs" for c in FEATURES))
def r7_sketched(spark, sf_dir):
    """R7 and A1 from summaries of parts of the table, merged; close: within 3 % of the
    exact distinct count, and within 2 % of the rows of the wanted ranks."""
    rows = observations(spark, sf_dir)
    parts = [profile.sketched(rows.where(F.col("id") % 3 == k), FEATURES) for k in range(3)]
    found = profile.read_sketches(profile.merged_sketches(parts[0].unionByName(parts[1]).unionByName(parts[2])), [0.25, 0.5, 0.75])
    exact = cleaning.value_counts(rows, FEATURES).withColumnRenamed("n_distinct", "exact")
    low, high = (profile.percentiles(rows, FEATURES, [max(0.0, s + d) for s in (0.25, 0.5, 0.75)], only_valid=False) for d in (-0.02, 0.02))
    bounds = spark.createDataFrame([(c, low[c], high[c]) for c in FEATURES], "column string, low array<double>, high array<double>")
    joined = found.join(F.broadcast(exact), "column").join(F.broadcast(bounds), "column")  # one row a column
    inside = F.forall(F.arrays_zip("quantiles", "low", "high"), lambda q: (q["quantiles"] >= q["low"]) & (q["quantiles"] <= q["high"]))
    return joined.select("column", "n", "least", "most", (F.abs(F.col("n_distinct") - F.col("exact")) <= 0.03 * F.col("exact") + 1).alias("distinct_close"), inside.alias("quantiles_close"))


@query("r7_distinct", f"WITH {OBS} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM obs" for c in [*FEATURES, "label"]))
def r7_distinct(spark, sf_dir):
    return cleaning.value_counts(observations(spark, sf_dir), [*FEATURES, "label"])


@query("a2_central_tendency", f"WITH {OBS}, {CLEAN} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(avg({c}), 4) AS mean, quantile_cont({c}, 0.5) AS median, round(stddev_pop({c}), 4) AS deviation, "
    f"(SELECT array_to_string(list_sort(list(v)), ';') FROM (SELECT round({c}, 2)::DECIMAL(18, 2)::VARCHAR AS v FROM clean WHERE {c} IS NOT NULL GROUP BY {c} QUALIFY count(*) = max(count(*)) OVER ())) AS modes FROM clean" for c in ("f1", "f3")))  # fmt: skip
def a2_central_tendency(spark, sf_dir):
    """A2 and A6."""
    out = profile.central_tendency(observations(spark, sf_dir), ["f1", "f3"])
    texts = F.array_sort(F.transform("modes", lambda v: F.round(v, 2).cast("decimal(18,2)").cast("string")))
    return _four(out, ["mean", "deviation"], 4).withColumn("modes", F.array_join(texts, ";"))


def _quartile_sql(c: str) -> str:
    mean = lambda a, b: f"(max(CASE WHEN r = {a} THEN v END) + max(CASE WHEN r = {b} THEN v END)) / 2"
    return (
        f"SELECT '{c}' AS \"column\", min(v) AS q0, {mean('n // 4 - 1', 'n // 4')} AS q1, {mean('(n - 1) // 2', 'n // 2')} AS q2, "
        f"{mean('3 * n // 4 - 1', '3 * n // 4')} AS q3, max(v) AS q4 FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS r, count(*) OVER () AS n FROM clean WHERE {c} IS NOT NULL)"
    )


@query("a3_quartiles", f"WITH {OBS}, {CLEAN} " + " UNION ALL ".join(_quartile_sql(c) for c in ("f1", "f2", "f3", "f4")))
def a3_quartiles(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return spark.createDataFrame([(c, *q) for c, q in profile.all_quartiles(obs, FEATURES).items()], "column string, q0 double, q1 double, q2 double, q3 double, q4 double")


@query("a5_quartiles_by_halves", f"""WITH {OBS}, {CLEAN}, v AS (SELECT f2 AS v, row_number() OVER (ORDER BY f2) - 1 AS r, count(*) OVER () AS n FROM clean WHERE f2 IS NOT NULL)
SELECT min(v) AS q0, CASE WHEN max(n) % 2 = 1 THEN max(CASE WHEN r = n // 4 THEN v END) ELSE (max(CASE WHEN r = (n // 2) // 2 - 1 THEN v END) + max(CASE WHEN r = (n // 2) // 2 THEN v END)) / 2 END AS q1,
CASE WHEN max(n) % 2 = 1 THEN max(CASE WHEN r = 3 * n // 4 THEN v END) ELSE (max(CASE WHEN r = 3 * (n // 2) // 2 - 1 THEN v END) + max(CASE WHEN r = 3 * (n // 2) // 2 THEN v END)) / 2 END AS q3 FROM v""")
def a5_quartiles_by_halves(spark, sf_dir):
    q = profile.quartiles(observations(spark, sf_dir), "f2", "halves")
    return spark.createDataFrame([(q[0], q[1], q[3])], "q0 double, q1 double, q3 double")


@query("a4_percentiles", f"WITH {OBS}, {CLEAN} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", " + ", ".join(f"round(quantile_cont({c}, {p / 100}), 6) AS p{p}" for p in (20, 25, 75, 80)) + " FROM clean" for c in FEATURES))
def a4_percentiles(spark, sf_dir):
    found = profile.percentiles(observations(spark, sf_dir), FEATURES, [0.2, 0.25, 0.75, 0.8])
    return _four(spark.createDataFrame([(c, *v) for c, v in found.items()], "column string, p20 double, p25 double, p75 double, p80 double"), ["p20", "p25", "p75", "p80"])


def _histogram_sql(source: str, bins: str) -> str:
    return f"""WITH {source}, b AS (SELECT min(f2) AS a, max(f2) AS z, {bins} AS k FROM clean), w AS (SELECT a, (z - a) / k AS w, k FROM b),
c AS (SELECT least(floor((f2 - a) / w), k - 1)::INTEGER AS bin, count(*) AS n FROM clean, w WHERE f2 IS NOT NULL GROUP BY 1)
SELECT i::INTEGER AS bin, round(a + i * w, 4) AS low, round(a + (i + 1) * w, 4) AS high, coalesce(n, 0) AS n FROM w, unnest(range(0, k)) t(i) LEFT JOIN c ON c.bin = i"""


@query("a7_histogram", _histogram_sql(f"{OBS}, {CLEAN}", "ceil(1 + 10 / 3.0::DOUBLE * log10(count(*)))::BIGINT"))
def a7_histogram(spark, sf_dir):
    return _four(profile.histogram(observations(spark, sf_dir), "f2"), ["low", "high"], 4)


@query("a8_histogram_bins", _histogram_sql(f"{OBS}, {CLEAN}", "12::BIGINT"))
def a8_histogram_bins(spark, sf_dir):
    return _four(profile.histogram(observations(spark, sf_dir), "f2", 12), ["low", "high"], 4)


@query("a9_box_plot", f"""WITH {OBS}, {CLEAN}, q AS ({_quartile_sql('f2')}), f AS (SELECT f2 AS v, NOT (f2 > q1 - 1.5::DOUBLE * (q3 - q1) AND f2 < q3 + 1.5::DOUBLE * (q3 - q1)) AS outlier FROM clean, q WHERE f2 IS NOT NULL)
SELECT outlier, count(*) AS n, min(v) AS least, max(v) AS most FROM f GROUP BY outlier""")
def a9_box_plot(spark, sf_dir):
    _, flagged = profile.box_plot(observations(spark, sf_dir), "f2")
    return flagged.groupBy("outlier").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))


_PAIRS = [(a, b) for i, a in enumerate([*FEATURES, "label"]) for b in [*FEATURES, "label"][i + 1 :]]


@query("a10_scaled_correlation", f"WITH {FILLED} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}) * count(*) / (count(*) - 1), 8) AS r FROM filled" for a, b in _PAIRS))
def a10_scaled_correlation(spark, sf_dir):
    return _four(profile.scaled_correlation(filled(spark, sf_dir), [*FEATURES, "label"]), ["r"], 8)


_F_PAIRS = [(a, b) for a, b in _PAIRS if b != "label"]


@query("a11_correlation_matrix", f"WITH {OBS}, {CLEAN} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round((avg(CASE WHEN {b} IS NOT NULL THEN {a} END * {b}) - avg(CASE WHEN {b} IS NOT NULL THEN {a} END) * avg(CASE WHEN {a} IS NOT NULL THEN {b} END)) / (stddev_pop({a}) * stddev_pop({b})), 3) AS r FROM clean" for a, b in _F_PAIRS))
def a11_correlation_matrix(spark, sf_dir):
    return profile.correlation_matrix(observations(spark, sf_dir), FEATURES)


@query("a12_complete_correlation", f"WITH {OBS}, {CLEAN}, full_rows AS (SELECT * FROM clean WHERE f1 IS NOT NULL AND f2 IS NOT NULL AND f3 IS NOT NULL AND f4 IS NOT NULL) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r FROM full_rows" for a, b in _F_PAIRS))
def a12_complete_correlation(spark, sf_dir):
    return _four(profile.complete_correlation(observations(spark, sf_dir), FEATURES), ["r"], 8)


@query("a21_value_frequency", f"WITH {OBS} SELECT f1 AS v, count(*) AS n FROM obs WHERE f1 IS NOT NULL GROUP BY f1")
def a21_value_frequency(spark, sf_dir):
    return counted_values(observations(spark, sf_dir), {"f1": F.col("f1")}).select("v", "n")


@query("t1_impute_mode", f"""WITH {OBS}, m AS (SELECT {', '.join(f"(SELECT {c} FROM obs WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, min(id) LIMIT 1) AS {c}" for c in ('f1', 'f2'))})
SELECT id, CASE WHEN {VALID.format('obs.f1')} THEN obs.f1 ELSE m.f1 END AS f1, CASE WHEN {VALID.format('obs.f2')} THEN obs.f2 ELSE m.f2 END AS f2 FROM obs, m""")
def t1_impute_mode(spark, sf_dir):
    return cleaning.impute_mode(observations(spark, sf_dir), ["f1", "f2"], "id").select("id", "f1", "f2")


@query("t3_impute_class_mean", f"WITH {OBS}, {CLEAN} SELECT id, label, " + ", ".join(f"round(coalesce({c}, avg({c}) OVER (PARTITION BY label)), 4) AS {c}" for c in FEATURES) + " FROM clean")
def t3_impute_class_mean(spark, sf_dir):
    """All columns in one pass."""
    return _four(cleaning.impute_class_mean(observations(spark, sf_dir), FEATURES, "label"), FEATURES, 4).select("id", "label", *FEATURES)


def _fence(c: str) -> str:
    return f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}"


def _out(c: str) -> str:
    return f"({c} < a_{c} - 1.5::DOUBLE * (b_{c} - a_{c}) OR {c} > b_{c} + 1.5::DOUBLE * (b_{c} - a_{c}))"


@query("t4_outliers", f"WITH {FILLED}, q AS (SELECT {', '.join(_fence(c) for c in FEATURES)} FROM filled) SELECT id, " + ", ".join(f"{_out(c)} AS {c}_outlier" for c in FEATURES) + " FROM filled, q")
def t4_outliers(spark, sf_dir):
    flagged = cleaning.flag_outliers(filled(spark, sf_dir), FEATURES)
    return flagged.select("id", *[f"{c}_outlier" for c in FEATURES])


@query("u3_without_outliers", f"WITH {FILLED}, q AS (SELECT {', '.join(_fence(c) for c in FEATURES)} FROM filled) SELECT id FROM filled, q WHERE NOT (" + " OR ".join(_out(c) for c in FEATURES) + ")")
def u3_without_outliers(spark, sf_dir):
    flagged = cleaning.flag_outliers(filled(spark, sf_dir), FEATURES)
    keep = ~(F.col("f1_outlier") | F.col("f2_outlier") | F.col("f3_outlier") | F.col("f4_outlier"))
    return flagged.where(keep).select("id")


def _chunk_sql(c: str, size: str, how: str) -> str:
    stat = "quantile_cont(v, 0.5)" if how == "median" else "avg(v)"
    return f"""o AS (SELECT {c} AS v, (row_number() OVER (ORDER BY {c}) - 1) // {size} AS k FROM filled, s),
chunks AS (SELECT k, min(v) AS a, {stat} AS m FROM o GROUP BY k),
places AS (SELECT DISTINCT v, (SELECT max(k) FROM chunks WHERE a <= v) AS k FROM o)
SELECT id, round(m, 4) AS {c} FROM filled JOIN places ON places.v = {c} JOIN chunks ON chunks.k = places.k"""


@query("t5_smooth_by_depth", f"WITH {FILLED}, s AS (SELECT ceil(count(*) / (1 + 10 / 3.0::DOUBLE * log10(count(*))))::BIGINT AS m FROM filled), " + _chunk_sql("f2", "m", "median"))
def t5_smooth_by_depth(spark, sf_dir):
    """T5 and W4."""
    return _four(cleaning.smooth_by_depth(filled(spark, sf_dir), "f2").select("id", "f2"), ["f2"], 4)


@query("b1_equal_depth", f"WITH {FILLED}, s AS (SELECT ceil(count(*) / 8.0::DOUBLE)::BIGINT AS m FROM filled), " + _chunk_sql("f2", "m", "mean"))
def b1_equal_depth(spark, sf_dir):
    return _four(cleaning.equal_depth(filled(spark, sf_dir), "f2", 8).select("id", "f2"), ["f2"], 4)


@query("b2_equal_width", f"""WITH {FILLED}, b AS (SELECT min(f2) AS a, max(f2) AS z, ceil(1 + 10 / 3.0::DOUBLE * log10(count(*)))::BIGINT AS k FROM filled),
p AS (SELECT id, f2, z, least(floor((f2 - a) / ((z - a) / k)), k - 1) AS g FROM filled, b), m AS (SELECT g, avg(f2) AS m FROM p GROUP BY g)
SELECT id, round(CASE WHEN f2 = z THEN f2 ELSE m END, 4) AS f2 FROM p LEFT JOIN m ON m.g = p.g""")
def b2_equal_width(spark, sf_dir):
    return _four(cleaning.equal_width(filled(spark, sf_dir), "f2").select("id", "f2"), ["f2"], 4)


@query("t6_regression_repair", f"""WITH {FILLED}, q AS (SELECT {_fence('f4')} FROM filled), rows AS (SELECT *, {_out('f4')} AS o FROM filled, q), fit AS (
SELECT regr_slope(f4, f1) AS b, regr_intercept(f4, f1) AS a FROM rows WHERE NOT o) SELECT id, round(CASE WHEN o THEN a + b * f1 ELSE f4 END, 6) AS f4 FROM rows, fit""")
def t6_regression_repair(spark, sf_dir):
    obs = filled(spark, sf_dir).select("id", "f1", "f4")
    return _four(cleaning.regression_repair(obs, ["f4"], ["f1"]).select("id", "f4"), ["f4"])


@query("t6_regression_all")
def t6_regression_all(spark, sf_dir):
    """Every column from all the others and the label, in order."""
    return cleaning.regression_repair(filled(spark, sf_dir), FEATURES, ["label"]).select("id", *FEATURES)


def _regressions(source: str, others: list[str], fitted: str = "true") -> str:
    """Every feature of a table in turn, as T6 repairs it: its outliers become what a
    regression on the other columns says, learnt from the rows that are fitted. The
    result is the table r4. A regression of standardised columns is solved by their
    correlations' inverse, which rounds of X = 2 X - X A X find."""
    m = len(FEATURES) - 1 + len(others)
    product = lambda x, y: f"list_transform(range({m * m}), lambda k: list_sum(list_transform(range({m}), lambda j: {x}[(k // {m}) * {m} + j + 1] * {y}[j * {m} + k % {m} + 1])))"
    parts, now = [], source
    for n, c in enumerate(FEATURES, 1):
        xs = [x for x in [*FEATURES, *others] if x != c]
        stats = ", ".join(f"avg({x}) AS m_{x}, stddev_pop({x}) AS s_{x}, covar_pop({x}, {c}) AS k_{x}" for x in xs)
        table = ", ".join("1.0::DOUBLE" if x == y else f"corr({x}, {y})" for x in xs for y in xs)
        beta = {x: "(" + " + ".join(f"inv[{m * i + j + 1}] * k_{y} / s_{y}" for j, y in enumerate(xs)) + f") / s_{x}" for i, x in enumerate(xs)}
        guess = f"m_{c} + " + " + ".join(f"{beta[x]} * (t.{x} - m_{x})" for x in xs)
        parts.append(f"""q{n} AS (SELECT {_fence(c)} FROM {now} WHERE {fitted}), t{n} AS MATERIALIZED (SELECT t.*, {_out(c)} AS o FROM {now} t, q{n}),
s{n} AS MATERIALIZED (SELECT avg({c}) AS m_{c}, {stats}, [{table}] AS a FROM t{n} WHERE NOT o AND {fitted}),
i{n} AS (SELECT 0 AS i, list_transform(range({m * m}), lambda k: CASE WHEN k % {m + 1} = 0 THEN 1 / {m}::DOUBLE ELSE 0 END) AS x UNION ALL
  SELECT i + 1, list_transform(list_zip(x, y), lambda p: 2 * p[1] - p[2]) FROM (SELECT i, x, {product('xa', 'x')} AS y FROM (SELECT i, x, {product('x', 'a')} AS xa FROM i{n}, s{n} WHERE i < 60))),
v{n} AS (SELECT x AS inv FROM i{n} ORDER BY i DESC LIMIT 1),
r{n} AS MATERIALIZED (SELECT id, label, {'' if fitted == 'true' else fitted + ', '}{', '.join(f"CASE WHEN o THEN {guess} ELSE t.{x} END AS {x}" if x == c else f"t.{x}" for x in FEATURES)} FROM t{n} t, s{n}, v{n})""")
        now = f"r{n}"
    return ", ".join(parts)


_ROUNDED = "round(f1, 5) AS f1, round(f2, 2) AS f2, round(f3, 6) AS f3, round(f4, 6) AS f4"


@query("t8_rounded_repairs", f"WITH RECURSIVE {FILLED}, {_regressions('filled', ['label'])} SELECT id, {_ROUNDED} FROM r4")
def t8_rounded_repairs(spark, sf_dir):
    """T8, for a comparison with SQL."""
    out = t6_regression_all(spark, sf_dir)
    return out.select("id", *[F.round(c, d).alias(c) for c, d in zip(FEATURES, (5, 2, 6, 6))])


_SCALED = ", ".join(f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}" for c in FEATURES)


@query("t13_rounded_observations", f"""WITH RECURSIVE {OBS}, {CLEAN}, imputed AS (SELECT id, label, {', '.join(f"coalesce({c}, avg({c}) OVER (PARTITION BY label)) AS {c}" for c in FEATURES)} FROM clean),
{_regressions('imputed', ['label'])}, d AS (SELECT min(id) AS id, label, f1, f2, f3, f4 FROM r4 GROUP BY label, f1, f2, f3, f4),
sc AS (SELECT id, label, {_SCALED} FROM d), n AS (SELECT count(*) / (count(*) - 1.0::DOUBLE) AS n, {', '.join(f"corr({a}, {b}) AS c_{a}_{b}" for i, a in enumerate(FEATURES) for b in [*FEATURES, 'label'][i + 1:])} FROM d)
SELECT id, label, {', '.join(f"CASE WHEN greatest({', '.join(f'abs(c_{c}_{b} * n)' for b in [*FEATURES, 'label'][i + 1:])}) <= 0.75::DOUBLE THEN {c} END AS {c}" for i, c in enumerate(FEATURES))} FROM sc, n""")
def t13_rounded_observations(spark, sf_dir):
    """T13, for a comparison with SQL: a dropped column is null."""
    out = clean_observations(observations(spark, sf_dir), FEATURES, "label", "id")
    return out.select("id", "label", *[(F.round(c, 6) if c in out.columns else F.lit(None).cast("double")).alias(c) for c in FEATURES])


_CORRELATED = {c: "greatest(" + ", ".join(f"abs(c_{c}_{b} * n)" for b in [*FEATURES, "label"][i + 1 :]) + ") > 0.75::DOUBLE" for i, c in enumerate(FEATURES)}
_MOVED = {c: f"least(greatest(r4.{c}, b.a_{c}), b.b_{c})" for c in FEATURES}


@query("t18_rounded_cleaning", f"""WITH RECURSIVE {OBS}, {CLEAN}, halves AS (SELECT *, ((id % 4294967296) * 2654435761::HUGEINT + 42 * 40503) % 4294967296 < 3435973836 AS train FROM clean),
means AS (SELECT label, {', '.join(f'avg({c}) AS {c}' for c in FEATURES)} FROM halves WHERE train GROUP BY label), every AS (SELECT {', '.join(f'avg({c}) AS {c}' for c in FEATURES)} FROM means),
imputed AS (SELECT h.id, h.label, train, {', '.join(f'coalesce(h.{c}, CASE WHEN train THEN m.{c} ELSE every.{c} END) AS {c}' for c in FEATURES)} FROM halves h JOIN means m USING (label), every),
{_regressions('imputed', [], 'train')}, d AS (SELECT DISTINCT label, f1, f2, f3, f4 FROM r4 WHERE train),
b AS (SELECT count(*) / (count(*) - 1.0::DOUBLE) AS n, {', '.join(f'min({c}) AS a_{c}, max({c}) AS b_{c}' for c in FEATURES)}, {', '.join(f"corr({x}, {y}) AS c_{x}_{y}" for i, x in enumerate(FEATURES) for y in [*FEATURES, 'label'][i + 1:])} FROM d)
SELECT r4.id, {', '.join(f"CASE WHEN NOT {_CORRELATED[c]} THEN round(({_MOVED[c]} - b.a_{c}) / (b.b_{c} - b.a_{c}), 6) END AS {c}" for c in FEATURES)} FROM r4, b WHERE NOT train""")
def t18_rounded_cleaning(spark, sf_dir):
    """T18, for a comparison with SQL: a dropped column is null."""
    train, test = evaluate.split(observations(spark, sf_dir), "id")
    out = apply_cleaning(test, fit_cleaning(train, FEATURES, "label"))
    return out.select("id", *[(F.round(c, 6) if c in out.columns else F.lit(None).cast("double")).alias(c) for c in FEATURES])


@query("t7_winsorize", f"""WITH {FILLED}, clean AS (SELECT * FROM filled), q AS ({_quartile_sql('f2')}), p AS (SELECT {', '.join(f'quantile_cont(f2, {x / 100}) AS p{x}' for x in (20, 25, 50, 75, 80))} FROM filled)
SELECT id, round(CASE WHEN f2 > q3 + 1.5::DOUBLE * (p75 - p25) OR f2 < q1 - 1.5::DOUBLE * (p75 - p25) THEN CASE WHEN f2 < p20 THEN p20 WHEN f2 > p80 THEN p80 ELSE p50 END ELSE f2 END, 6) AS f2 FROM filled, q, p""")
def t7_winsorize(spark, sf_dir):
    return _four(cleaning.winsorize(filled(spark, sf_dir), ["f2"]).select("id", "f2"), ["f2"])


@query("t11_min_max", f"WITH {FILLED} SELECT id, " + ", ".join(f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}" for c in FEATURES) + " FROM filled")
def t11_min_max(spark, sf_dir):
    """T9 and T11."""
    return _four(cleaning.min_max(filled(spark, sf_dir), FEATURES).select("id", *FEATURES), FEATURES)


@query("t10_z_score", f"WITH {FILLED}, s AS (SELECT {', '.join(f'avg({c}) AS m_{c}, var_pop({c}) AS s_{c}' for c in FEATURES)} FROM filled) SELECT id, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in FEATURES) + " FROM filled, s")
def t10_z_score(spark, sf_dir):
    return _four(cleaning.z_score(filled(spark, sf_dir), FEATURES).select("id", *FEATURES), FEATURES)


@query("u1_distinct_rows", "SELECT l_quantity, l_discount, l_tax, l_returnflag, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY 1, 2, 3, 4")
def u1_distinct_rows(spark, sf_dir):
    return cleaning.distinct_rows(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_returnflag"], "l_orderkey")


@query("u2_append", "SELECT s_nationkey AS zone, s_acctbal AS balance FROM supplier UNION ALL SELECT c_nationkey, c_acctbal FROM customer")
def u2_append(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS zone", "s_acctbal AS balance")
    return a.unionByName(table(spark, sf_dir, "customer").selectExpr("c_acctbal AS balance", "c_nationkey AS zone"))


_KEPT = "abs(corr({0}, {1}) * count(*) / (count(*) - 1)) > 0.4"
_DROPS = {a: " OR ".join(_KEPT.format(a, b) for x, b in _PAIRS if x == a) for a in FEATURES}


@query("t12_drop_correlated", f"WITH {FILLED}, r AS (SELECT {', '.join(f'({cond}) AS {c}' for c, cond in _DROPS.items())} FROM filled) SELECT id, " + ", ".join(f"CASE WHEN NOT r.{c} THEN filled.{c} END AS {c}" for c in FEATURES) + ", label, (SELECT list_sort(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{c}' END" for c in FEATURES) + "], lambda x: x IS NOT NULL)) FROM r)::VARCHAR AS dropped FROM filled, r")
def t12_drop_correlated(spark, sf_dir):
    """What goes is decided by the data; a column that went is null, and named."""
    obs = filled(spark, sf_dir)
    gone = cleaning.correlated_columns(obs, FEATURES, "label", 0.4)
    left = obs.drop(*gone)
    names = F.lit(f"[{', '.join(sorted(gone))}]")
    return left.select("id", *[F.col(c) if c in left.columns else F.lit(None).cast("double").alias(c) for c in FEATURES], "label", names.alias("dropped"))


def _axis(power: str, matrix: str, v: str) -> str:
    """The main axis v of a symmetric matrix of four rows: it is squared until only that
    axis is left; its largest entry is positive."""
    square = "list_transform(range(16), lambda k: list_sum(list_transform(range(4), lambda j: m[(k // 4) * 4 + j + 1] * m[j * 4 + k % 4 + 1])))"
    scaled = lambda x: f"list_transform({x}, lambda y: y / list_sum(list_transform({x}, lambda z: abs(z))))"
    return f"""{power} AS (SELECT 0 AS i, m FROM {matrix} UNION ALL SELECT i + 1, {scaled('s')} FROM (SELECT i, {square} AS s FROM {power} WHERE i < 45)),
{v} AS (SELECT list_transform(c, lambda x: x / n * CASE WHEN arg_max >= 0 THEN 1 ELSE -1 END) AS v FROM (SELECT c, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS n, list_reduce(c, lambda a, b: CASE WHEN abs(b) > abs(a) THEN b ELSE a END) AS arg_max
  FROM (SELECT list_transform(range(4), lambda r: m[r * 4 + k]) AS c FROM (SELECT m, list_position([m[1], m[6], m[11], m[16]], list_max([m[1], m[6], m[11], m[16]])) AS k FROM {power} ORDER BY i DESC LIMIT 1))))"""


_Z = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in FEATURES)
_COV = ", ".join(f"sum({a} * {b})" for a in FEATURES for b in FEATURES)
_LAMBDA = "list_sum(list_transform(range(4), lambda r: v[r + 1] * list_sum(list_transform(range(4), lambda j: m[r * 4 + j + 1] * v[j + 1]))))"
_PCA = f"""WITH RECURSIVE {FILLED}, z AS (SELECT id, {_Z} FROM filled), cov AS (SELECT [{_COV}] AS m FROM z), {_axis('p1', 'cov', 'a1')},
rest AS (SELECT list_transform(range(16), lambda k: m[k + 1] - l * v[k // 4 + 1] * v[k % 4 + 1]) AS m FROM (SELECT m, v, {_LAMBDA} AS l FROM cov, a1)), {_axis('p2', 'rest', 'a2')}
SELECT id, {', '.join("round(" + " + ".join(f"{c} * a{n}.v[{i}]" for i, c in enumerate(FEATURES, 1)) + f", 6) AS pc{n}" for n in (1, 2))} FROM z, a1, a2"""


@query("l10_principal_components")
def l10_principal_components(spark, sf_dir):
    obs = cleaning.z_score(filled(spark, sf_dir), FEATURES, "std")
    return clusters.project(obs, FEATURES, *clusters.principal_components(obs, FEATURES)).select("id", "pc1", "pc2")


@query("l10_rounded_components", _PCA)
def l10_rounded_components(spark, sf_dir):
    """L10, for a comparison with SQL."""
    return l10_principal_components(spark, sf_dir).select("id", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


_PLACE = "((id % 4294967296) * 2654435761::HUGEINT + 42 * 40503) % 4294967296 < 3435973836"


@query("l1_split", f"WITH {OBS} SELECT id, {_PLACE} AS train FROM obs")
def l1_split(spark, sf_dir):
    train, test = evaluate.split(observations(spark, sf_dir), "id")
    return train.select("id", F.lit(True).alias("train")).unionByName(test.select("id", F.lit(False).alias("train")))


@query("l1_split_exact", f"WITH {OBS} SELECT id, row_number() OVER (ORDER BY ((id % 4294967296) * 2654435761::HUGEINT + 42 * 40503) % 4294967296, id) <= floor(0.8::DOUBLE * (SELECT count(*) FROM obs)) AS train FROM obs")
def l1_split_exact(spark, sf_dir):
    """L1 with an exact number of training rows."""
    train, test = evaluate.split_exact(observations(spark, sf_dir), "id")
    return train.select("id", F.lit(True).alias("train")).unionByName(test.select("id", F.lit(False).alias("train")))


@query("f3_minkowski", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))), 6) AS manhattan, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS euclid, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def f3_minkowski(spark, sf_dir):
    """every vector with the next one."""
    rows = table(spark, sf_dir, "embeddings")
    a = rows.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    b = rows.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    x, y = F.col("x"), F.col("y")
    joined = a.join(b, F.col("b") == F.col("a") + 1)
    return joined.select("a", "b", F.round(distance.minkowski(x, y, 1), 6).alias("manhattan"), F.round(distance.minkowski(x, y, 2), 6).alias("euclid"), F.round(distance.cosine(x, y), 6).alias("cosine"))
