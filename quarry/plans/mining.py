"""Queries: transactions, itemsets, rules and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import mining, patterns
from quarry.plans.tables import TRANSACTIONS, table, transactions

QUERIES, SQL = {}, {}
SUPPORT = 0.02
ITEMS = ["q", "flag", "status", "type"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.build_transactions(transactions(spark, sf_dir), "tid", ITEMS)


def _text(c: str):
    return F.array_join(c, ",").alias(c)


_SETS = f"""{TRANSACTIONS}, subsets AS (SELECT tid, list_filter(items, lambda x, i: ((m >> (i - 1)::INTEGER) & 1) = 1) AS items
  FROM baskets, unnest(range(1, (1 << len(baskets.items)::INTEGER))) t(m)),
sets AS (SELECT items, len(items)::INTEGER AS k, count(*) AS freq, count(*) / (SELECT count(*) FROM baskets)::DOUBLE AS support
  FROM subsets GROUP BY items HAVING count(*) / (SELECT count(*) FROM baskets)::DOUBLE >= {SUPPORT}::DOUBLE)"""
_RULES = f"""{_SETS}, splits AS (SELECT items, support, list_filter(items, lambda x, i: ((m >> (i - 1)::INTEGER) & 1) = 1) AS a,
  list_filter(items, lambda x, i: ((m >> (i - 1)::INTEGER) & 1) = 0) AS c FROM sets, unnest(range(1, (1 << len(sets.items)::INTEGER) - 1)) t(m) WHERE k > 1),
rules AS (SELECT s.a, s.c, s.support AS s, x.support AS sa, y.support AS sc FROM splits s JOIN sets x ON x.items = s.a JOIN sets y ON y.items = s.c)"""
_FORMS = {"confidence": "s / sa", "cosine": "s / sqrt(sa * sc)", "lift": "s / (sa * sc)", "jaccard": "s / (sa + sc - s)", "kulczynski": "(s / sa + s / sc) / 2"}


@query("b3_transactions", f"WITH {TRANSACTIONS} SELECT tid, array_to_string(items, ',') AS items FROM baskets")
def b3_transactions(spark, sf_dir):
    """B3 and F9."""
    return _baskets(spark, sf_dir).select("tid", _text("items"))


@query("m4_itemsets", f"WITH {_SETS} SELECT array_to_string(items, ',') AS items, k, freq, round(support, 8) AS support FROM sets")
def m4_itemsets(spark, sf_dir):
    """M1 to M4, F10 and J7."""
    found = mining.apriori(_baskets(spark, sf_dir), SUPPORT)
    return found.select(_text("items"), "k", "freq", F.round("support", 8).alias("support"))


def _rules_query(name: str):
    def run(spark, sf_dir):
        found = mining.rules(mining.apriori(_baskets(spark, sf_dir), SUPPORT), name, 0.1)
        return found.select(_text("antecedent"), _text("consequent"), F.round("measure", 8).alias("measure"), F.round("support", 8).alias("support"))

    return run


for _name, _form in _FORMS.items():
    query(f"m6_rules_{_name}", f"WITH {_RULES} SELECT array_to_string(a, ',') AS antecedent, array_to_string(c, ',') AS consequent, round({_form}, 8) AS measure, round(s, 8) AS support FROM rules WHERE {_form} >= 0.1::DOUBLE")(_rules_query(_name))


@query("m7_itemsets_by_threshold", f"WITH {_SETS} SELECT i / 1000.0::DOUBLE AS threshold, (SELECT count(*) FROM sets WHERE support >= i / 1000.0::DOUBLE) AS n FROM unnest(range(20, 201, 20)) t(i)")
def m7_itemsets_by_threshold(spark, sf_dir):
    grid = spark.range(20, 201, 20).select((F.col("id") / 1000).alias("threshold"))
    return mining.itemsets_by_threshold(mining.apriori(_baskets(spark, sf_dir), SUPPORT), grid)


@query("m8_rules_by_threshold", f"WITH {_RULES} SELECT i / 100.0::DOUBLE AS min_support, j / 10.0::DOUBLE AS min_measure, (SELECT count(*) FROM rules WHERE s >= i / 100.0::DOUBLE AND s / sa >= j / 10.0::DOUBLE) AS n FROM unnest(range(2, 11, 2)) a(i), unnest(range(1, 10, 2)) b(j)")
def m8_rules_by_threshold(spark, sf_dir):
    found = mining.rules(mining.apriori(_baskets(spark, sf_dir), SUPPORT))
    grid = spark.range(2, 11, 2).select((F.col("id") / 100).alias("min_support")).crossJoin(spark.range(1, 10, 2).select((F.col("id") / 10).alias("min_measure")))
    return mining.rules_by_threshold(found, grid)


@query("m9_recommend_strict", f"WITH {_RULES} SELECT tid, array_to_string(c, ',') AS consequent, round(s / sa, 8) AS measure FROM (SELECT tid, list_sort(list_distinct([flag, status])) AS items FROM raw) p JOIN rules ON rules.a = p.items WHERE s / sa >= 0.2::DOUBLE")
def m9_recommend_strict(spark, sf_dir):
    """The flag and the status of every row, to be completed."""
    baskets = _baskets(spark, sf_dir)
    found = mining.rules(mining.apriori(baskets, SUPPORT), "confidence", 0.2)
    open_ones = mining.build_transactions(transactions(spark, sf_dir), "tid", ["flag", "status"])
    return mining.recommend(found, open_ones).select("tid", _text("consequent"), F.round("measure", 8).alias("measure"))


@query("m9_recommend_within", f"WITH {_RULES} SELECT tid, array_to_string(c, ',') AS consequent, round(s / sa, 8) AS measure FROM baskets JOIN rules ON list_has_all(baskets.items, rules.a) WHERE s / sa >= 0.2::DOUBLE")
def m9_recommend_within(spark, sf_dir):
    """Every basket."""
    baskets = _baskets(spark, sf_dir)
    found = mining.rules(mining.apriori(baskets, SUPPORT), "confidence", 0.2)
    found = found.select("antecedent", _text("consequent"), F.round("measure", 8).alias("measure"))
    return mining.recommend(found, baskets, strict=False).select("tid", "consequent", "measure")


@query("m10_one_hot", f"WITH {TRANSACTIONS}, names AS (SELECT DISTINCT unnest(items) AS item FROM baskets) SELECT tid, unnest(items) AS item, (SELECT count(*) FROM names) AS n_columns FROM baskets")
def m10_one_hot(spark, sf_dir):
    """All baskets with every item as a column; the ones are listed."""
    baskets = _baskets(spark, sf_dir)
    items = mining.all_items(baskets)
    cells = F.array(*[F.struct(F.lit(i).alias("item"), F.col(f"`{i}`").alias("held")) for i in items])
    ones = mining.one_hot(baskets, items).select("tid", F.inline(F.filter(cells, lambda c: c["held"] == 1)))
    return ones.select("tid", "item", F.lit(len(items)).cast("long").alias("n_columns"))


_BRANDS = """WITH RECURSIVE b AS (SELECT DISTINCT l_orderkey AS tid, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT count(DISTINCT tid) AS n FROM b),
frequent AS (SELECT item FROM b GROUP BY item HAVING count(*) / (SELECT n FROM n)::DOUBLE >= 0.002::DOUBLE), held AS (SELECT tid, item FROM b WHERE item IN (SELECT item FROM frequent)),
sets AS (SELECT tid, [item] AS items FROM held UNION ALL SELECT s.tid, list_append(s.items, h.item) FROM sets s JOIN held h ON h.tid = s.tid AND h.item > s.items[-1] WHERE len(s.items) < 7)
SELECT array_to_string(items, ',') AS items, len(items)::INTEGER AS k, count(*) AS freq FROM sets GROUP BY items HAVING count(*) / (SELECT n FROM n)::DOUBLE >= 0.002::DOUBLE"""


@query("m4_brand_baskets", _BRANDS)
def m4_brand_baskets(spark, sf_dir):
    """Longer baskets: brands bought together in an order (seven lines at most)."""
    return mining.apriori(_brand_baskets(spark, sf_dir), 0.002).select(_text("items"), "k", "freq")


def _brand_baskets(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("l_orderkey").alias("tid")).agg(F.array_sort(F.collect_set("p_brand")).alias("items"))


@query("m4_itemsets_by_trees", SQL["m4_itemsets"])
def m4_itemsets_by_trees(spark, sf_dir):
    """M4 by prefix trees."""
    found = patterns.fp_growth(_baskets(spark, sf_dir), SUPPORT)
    return found.select(_text("items"), "k", "freq", F.round("support", 8).alias("support"))


@query("m4_brand_baskets_by_trees", _BRANDS)
def m4_brand_baskets_by_trees(spark, sf_dir):
    return patterns.fp_growth(_brand_baskets(spark, sf_dir), 0.002).select(_text("items"), "k", "freq")


@query("m10_sparse_one_hot", f"WITH {TRANSACTIONS}, names AS (SELECT DISTINCT unnest(items) AS item FROM baskets) SELECT tid, array_to_string(items, ',') AS items, len(items)::INTEGER AS n_ones, (SELECT count(*) FROM names) AS n_columns, TRUE AS gapless FROM baskets")
def m10_sparse_one_hot(spark, sf_dir):
    """M10 as sparse rows: all baskets as codes, and back."""
    baskets = _baskets(spark, sf_dir)
    codes = mining.item_codes(baskets)
    rows = mining.sparse_one_hot(baskets, codes)
    size = codes.agg(F.count(F.lit(1)).alias("n_columns"), ((F.max("code") == F.count(F.lit(1)) - 1) & (F.countDistinct("code") == F.count(F.lit(1)))).alias("gapless"))
    back = rows.select("tid", F.explode("codes").alias("code")).join(codes, "code").groupBy("tid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    joined = rows.select("tid", F.size("codes").alias("n_ones")).join(back, "tid").crossJoin(F.broadcast(size))  # one row
    return joined.select("tid", _text("items"), "n_ones", "n_columns", "gapless")
