"""Transactions, frequent itemsets, association rules and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import materialize

#: Candidate sets of one level up to which they are broadcast.
BROADCAST_SETS = 200_000
MEASURES = ("confidence", "cosine", "lift", "jaccard", "kulczynski")


def build_transactions(df: DataFrame, tid: str, columns: list[str], prefix: bool = False) -> DataFrame:
    """(tid, items): the values of the columns as sorted distinct texts. With
    prefix, equal texts of different columns stay apart."""
    texts = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) if prefix else F.col(c).cast("string") for c in columns]
    items = F.array_sort(F.array_distinct(F.array_compact(F.array(*texts))))
    return df.select(F.col(tid).alias("tid"), items.alias("items"))


def encoded(baskets: DataFrame, min_support: float) -> tuple[int, DataFrame, DataFrame]:
    """How many baskets there are; the frequent items as (item, code, freq), numbered
    from 0 in order; and the distinct sets of codes, ascending, that baskets hold, with
    how many baskets hold each: (codes, w).

    Equal baskets are one row from the first shuffle on. There are at most as many
    frequent items as a basket has on average, divided by the support.
    """
    sets = baskets.select(F.array_sort(F.array_distinct(F.array_compact("items"))).alias("items"))
    sets = materialize(sets.groupBy("items").agg(F.count(F.lit(1)).alias("w")), "baskets")
    n = sets.agg(F.sum("w")).first()[0] or 0
    single = sets.select("items", "w", F.explode("items").alias("item"))
    counts = single.groupBy("item").agg(F.sum("w").alias("freq")).where(F.col("freq") / F.lit(max(1, n)) >= min_support)
    items = materialize(counts.select("item", (F.row_number().over(Window.orderBy("item")) - 1).alias("code"), "freq"), "items")
    held = single.join(items.select("item", "code"), "item").groupBy("items", "w").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    return n, items, held.groupBy("codes").agg(F.sum("w").alias("w"))


def apriori(baskets: DataFrame, min_support: float, max_size: int | None = None) -> DataFrame:
    """(items, k, freq, support) of every itemset whose share of the baskets is at
    least min_support, level by level.

    A level's candidates are joins of two frequent sets that differ in their last
    item, all of whose subsets are frequent. A basket carries the frequent sets it
    holds, each with the items that may still follow, so a level extends them where
    they lie: only candidates and partial counts are moved.
    """
    n, items, sets = encoded(baskets, min_support)
    support = (F.col("freq") / F.lit(max(1, n))).alias("support")
    level = items.select(F.array("code").alias("codes"), F.lit(1).alias("k"), "freq", support)
    found = sets.select(F.posexplode("codes").alias("at", "code"), "codes", "w")
    found = found.select(F.array("code").alias("codes"), F.expr("slice(codes, at + 2, size(codes))").alias("rest"), "w")
    result, k = level, 1
    while max_size is None or k < max_size:
        k += 1
        wanted = materialize(candidates(level, k), "candidates")
        many = wanted.count()
        if not many:
            break
        longer = found.select("codes", "w", "rest", F.posexplode("rest").alias("at", "code"))
        longer = longer.select(F.concat("codes", F.array("code")).alias("codes"), F.expr("slice(rest, at + 2, size(rest))").alias("rest"), "w")
        found = longer.join(F.broadcast(wanted) if many <= BROADCAST_SETS else wanted, "codes", "left_semi")
        found = materialize(found.groupBy("codes", "rest").agg(F.sum("w").alias("w")), "occurrences")
        counts = found.groupBy("codes").agg(F.sum("w").alias("freq"))
        level = materialize(counts.select("codes", F.lit(k).alias("k"), "freq", support).where(F.col("support") >= min_support), "itemsets")
        result = result.unionByName(level)
    names = items.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "item"))), lambda x: x["item"]).alias("names"))
    named = result.crossJoin(F.broadcast(names))  # one row: the frequent items
    return named.select(F.transform("codes", lambda c: F.element_at("names", c + 1)).alias("items"), "k", "freq", "support")


def candidates(level: DataFrame, k: int) -> DataFrame:
    """(codes): sets of k codes all of whose subsets of k - 1 are in level."""
    head = F.slice("codes", 1, k - 2) if k > 2 else F.array().cast("array<int>")
    a = level.select(head.alias("head"), "codes", F.element_at("codes", -1).alias("x"))
    b = level.select(head.alias("head"), F.element_at("codes", -1).alias("y"))
    joined = a.join(b, "head").where("x < y").select(F.concat("codes", F.array("y")).alias("codes"))
    if k == 2:
        return joined
    drop = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.filter("codes", lambda x, at: at != i - 1))
    subsets = joined.select("codes", F.explode(drop).alias("sub"))
    return subsets.join(level.select(F.col("codes").alias("sub")), "sub", "left_semi").groupBy("codes").count().where(F.col("count") == k).select("codes")


def measure(name: str, both: Column, a: Column, b: Column) -> Column:
    """A rule measure from the supports of the whole, antecedent and consequent."""
    return {
        "confidence": F.try_divide(both, a),
        "cosine": F.try_divide(both, F.sqrt(a * b)),
        "lift": F.try_divide(both, a * b),
        "jaccard": F.try_divide(both, a + b - both),
        "kulczynski": (F.try_divide(both, a) + F.try_divide(both, b)) / 2,
    }[name]


def rules(itemsets: DataFrame, by: str = "confidence", least: float = 0.0) -> DataFrame:
    """(antecedent, consequent, measure, support): every split of every itemset of
    two items or more in two, whose measure is at least `least`."""
    masks = F.expr("sequence(1, cast(pow(2, k) as int) - 2)")
    splits = itemsets.where("k > 1").select("items", "support", F.explode(masks).alias("mask"))
    side = lambda bit: F.filter("items", lambda x, i: F.getbit(F.col("mask"), i) == bit)
    splits = splits.select(side(1).alias("antecedent"), side(0).alias("consequent"), "support")
    of = lambda c: itemsets.select(F.col("items").alias(c), F.col("support").alias(f"s_{c}"))
    joined = splits.join(of("antecedent"), "antecedent").join(of("consequent"), "consequent")
    value = measure(by, F.col("support"), F.col("s_antecedent"), F.col("s_consequent"))
    return joined.select("antecedent", "consequent", value.alias("measure"), "support").where(F.col("measure") >= least)


def itemsets_by_threshold(itemsets: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(threshold, n): how many itemsets have at least that support. Mine once at
    the lowest threshold; thresholds is a short list."""
    sums = itemsets.groupBy("support").agg(F.count(F.lit(1)).alias("c"))
    met = F.broadcast(thresholds).join(sums, F.col("support") >= F.col("threshold"), "left")
    return met.groupBy("threshold").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))


def rules_by_threshold(found: DataFrame, grid: DataFrame) -> DataFrame:
    """(min_support, min_measure, n) for a short grid of thresholds."""
    met = F.broadcast(grid).join(found, (F.col("support") >= F.col("min_support")) & (F.col("measure") >= F.col("min_measure")), "left")
    return met.groupBy("min_support", "min_measure").agg(F.count("measure").alias("n"))


def recommend(found: DataFrame, baskets: DataFrame, strict: bool = True) -> DataFrame:
    """(tid, consequent, measure): consequents of rules whose antecedent equals the
    basket (strict) or lies within it. Blank and null items are ignored."""
    from quarry.operators.patterns import contained

    clean = baskets.select("tid", F.array_sort(F.array_distinct(F.filter("items", lambda x: F.trim(x) != ""))).alias("items"))
    if strict:
        return clean.join(found, F.col("items") == F.col("antecedent")).select("tid", "consequent", "measure")
    return contained(found, clean)


def all_items(baskets: DataFrame) -> list[str]:
    """The distinct items, in order: one column each of one_hot, so a table's worth of
    columns at most."""
    return [r[0] for r in baskets.select(F.explode("items").alias("item")).distinct().orderBy("item").collect()]


def one_hot(baskets: DataFrame, items: list[str]) -> DataFrame:
    """(tid, one 0/1 column for each listed item). Baskets of one tid are put together
    as items; columns are made row by row, so no aggregation holds them."""
    rows = baskets.groupBy("tid").agg(F.flatten(F.collect_list("items")).alias("__items"))
    return rows.select("tid", *[F.coalesce(F.array_contains("__items", i).cast("int"), F.lit(0)).alias(i) for i in items])


def item_codes(baskets: DataFrame, parts: int = 64) -> DataFrame:
    """(item, code): the distinct items numbered from 0 without a gap, in stretches by
    their hashes, so that no task sees all of them. Null items have no code."""
    names = materialize(baskets.select(F.explode("items").alias("item")).where("item is not null").distinct().withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int")), "item-names")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a stretch
    offsets = names.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    local = F.row_number().over(Window.partitionBy("part").orderBy("item")) - 1
    return names.withColumn("local", local).join(F.broadcast(offsets), "part").select("item", (F.col("local") + F.col("offset")).alias("code"))


def sparse_one_hot(baskets: DataFrame, codes: DataFrame) -> DataFrame:
    """(tid, codes): for each basket the codes of its items, ascending, once each; the
    places of the ones in a row as wide as there are items. Items without a code are
    left out, baskets without items have an empty list. Tids are unique."""
    held = baskets.select("tid", F.explode(F.array_distinct("items")).alias("item")).join(codes, "item")
    ones = held.groupBy("tid").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    return baskets.select("tid").join(ones, "tid", "left").select("tid", F.coalesce("codes", F.array().cast("array<bigint>")).alias("codes"))
