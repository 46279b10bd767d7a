"""Frequent itemsets by prefix trees, and rules found by one walk over a basket."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.mining import encoded
from quarry.session import materialize

#: Rows (distinct beginnings of baskets) of a conditional base that one task mines.
LOCAL_ROWS = 50_000
#: Antecedents up to which their trie is broadcast, and baskets that one task walks beyond.
BROADCAST_RULES = 200_000
WALKED_ROWS = 50_000
#: Different baskets up to which those are walked, and rows of what they hold that are broadcast.
BROADCAST_KINDS = 100_000
BROADCAST_HITS = 1_000_000


class PrefixTree:
    """A prefix tree of sorted lists of numbers with counts, and the places of each number."""

    def __init__(self):
        self.item, self.up, self.count, self.below, self.places = [-1], [-1], [0], [{}], {}

    def add(self, items: list[int], count: int) -> None:
        at = 0
        for i in items:
            to = self.below[at].get(i)
            if to is None:
                to = self.below[at][i] = len(self.item)
                self.item.append(i), self.up.append(at), self.count.append(0), self.below.append({})
                self.places.setdefault(i, []).append(to)
            self.count[to] += count
            at = to

    def paths_above(self, item: int) -> Iterator[tuple[list[int], int]]:
        """What comes before an item, from the root on, with the item's count there."""
        for at in self.places[item]:
            path, up = [], self.up[at]
            while up:
                path.append(self.item[up])
                up = self.up[up]
            yield path[::-1], self.count[at]


def mine(base: list[tuple[list[int], int]], enough, most: int | None = None) -> Iterator[tuple[list[int], int]]:
    """(items, count) of every set of items of the lists whose count is enough, by
    conditional prefix trees; sets of `most` items at most."""
    if most == 0:
        return
    totals: dict[int, int] = {}
    for items, n in base:
        for i in items:
            totals[i] = totals.get(i, 0) + n
    good = {i for i, n in totals.items() if enough(n)}
    tree = PrefixTree()
    for items, n in base:
        tree.add([i for i in items if i in good], n)
    for i in sorted(good):
        yield [i], totals[i]
        for found, n in mine(list(tree.paths_above(i)), enough, None if most is None else most - 1):
            yield [*found, i], n


def _shard(n: int, min_support: float, most: int | None):
    """Mines the base of one suffix: (codes, freq)."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        suffix = part.suffix.iloc[0].tolist()
        base = [(p.tolist(), w) for p, w in zip(part.prefix, part.w.tolist())]
        return pd.DataFrame([([*items, *suffix], c) for items, c in mine(base, lambda c: c / n >= min_support, most)], columns=["codes", "freq"])

    return run


def fp_growth(baskets: DataFrame, min_support: float, max_size: int | None = None, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(items, k, freq, support) of every itemset whose share of the baskets is at least
    min_support (inclusive, as in mining.apriori, with the same result).

    Items are numbered by falling frequency. A frequent item's conditional base is what
    comes before it in the baskets that hold it; equal beginnings are one row with a
    count. Bases of few rows are shards: a task turns one into a prefix tree and mines
    its conditional trees. Larger ones are parted once more by the item before, so no
    task holds an unbounded base. Null items are dropped; an empty table has no sets.
    """
    n, items, sets = encoded(baskets, min_support)
    n = max(1, n)
    order = Window.orderBy(F.desc("freq"), "code")  # the frequent items: at most basket length / support
    ranked = materialize(items.select("item", "code", "freq", (F.row_number().over(order) - 1).alias("rank")), "ranks")
    ranks = ranked.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "rank"))), lambda x: x["rank"]).alias("ranks"))
    as_ranks = sets.crossJoin(F.broadcast(ranks)).select(F.array_sort(F.transform("codes", lambda c: F.element_at("ranks", c + 1))).alias("prefix"), "w")  # one row
    frequent = F.col("freq") / F.lit(n) >= min_support
    rows = materialize(as_ranks.select(F.array().cast("array<int>").alias("suffix"), "prefix", "w"), "bases")
    size, out = 0, []
    while max_size is None or size < max_size:
        size += 1
        split = rows.select("suffix", "w", "prefix", F.posexplode("prefix").alias("at", "item"))
        split = split.select(F.concat(F.array("item"), "suffix").alias("suffix"), F.expr("slice(prefix, 1, at)").alias("prefix"), "w")
        bases = materialize(split.groupBy("suffix", "prefix").agg(F.sum("w").alias("w")), "bases")
        found = bases.groupBy("suffix").agg(F.sum("w").alias("freq"), F.sum((F.size("prefix") > 0).cast("long")).alias("rows")).where(frequent)
        found = materialize(found, "itemsets")
        out.append(found.select(F.col("suffix").alias("codes"), "freq"))
        rows = bases.join(found.select("suffix", "rows"), "suffix").where("size(prefix) > 0")
        shard = _shard(n, min_support, None if max_size is None else max_size - size)
        out.append(materialize(rows.where(F.col("rows") <= local_rows).groupBy("suffix").applyInPandas(shard, "codes array<int>, freq long"), "itemsets"))
        if found.where(F.col("rows") > local_rows).isEmpty():
            break
        rows = materialize(rows.where(F.col("rows") > local_rows).select("suffix", "prefix", "w"), "bases")
    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    names = ranked.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias("names"))
    named = every.crossJoin(F.broadcast(names))  # one row: the frequent items
    sorted_items = F.array_sort(F.transform("codes", lambda c: F.element_at("names", c + 1)))
    return named.select(sorted_items.alias("items"), F.size("codes").alias("k"), F.col("freq").cast("long").alias("freq"), (F.col("freq") / F.lit(n)).alias("support"))


def trie_of(antecedents: list[list[str]], order: dict[str, int]) -> dict:
    """Antecedents as a tree of items, the rarest first; the key None holds the place of
    an antecedent that ends there."""
    root: dict = {}
    for at, items in enumerate(antecedents):
        node = root
        for i in sorted(items, key=order.__getitem__):
            node = node.setdefault(i, {})
        node[None] = at
    return root


def walk(trie: dict, items: list[str]) -> Iterator[int]:
    """Places of the antecedents that lie within the items, which are in the trie's order."""
    todo = [(trie, 0)]
    while todo:
        node, start = todo.pop()
        if None in node:
            yield node[None]
        for at in range(start, len(items)):
            if (to := node.get(items[at])) is not None:
                todo.append((to, at + 1))


def contained(found: DataFrame, baskets: DataFrame, *, broadcast_rules: int = BROADCAST_RULES, walked_rows: int = WALKED_ROWS, broadcast_kinds: int = BROADCAST_KINDS) -> DataFrame:
    """(tid, consequent, measure): the consequents of all rules whose antecedent lies
    within the basket (tid, items), items without repeats.

    Antecedents stand in a trie, each from its rarest item to its most frequent one, so
    a basket is walked once and leaves a branch as soon as an item lacks. While there
    are few antecedents their trie is broadcast and no basket is shuffled. Beyond that,
    antecedents go by their rarest item and baskets to the items that are some
    antecedent's rarest; an item of many baskets is dealt out in parts of about
    walked_rows, each with the item's antecedents. A rule without an antecedent holds
    for every basket; a basket without items holds only such rules.

    Baskets that are equal have the same rules: where there are up to BROADCAST_KINDS
    different ones, those are walked, and what they hold is broadcast to the baskets if
    it is at most BROADCAST_HITS rows.
    """
    baskets = baskets.select("tid", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    kinds = materialize(baskets.select("items").distinct(), "kinds")
    if kinds.count() <= broadcast_kinds:
        hits = materialize(_contained(found, kinds.select(F.col("items").alias("tid"), "items"), broadcast_rules, walked_rows), "hits")
        if hits.count() <= BROADCAST_HITS:
            held = hits.groupBy(F.col("tid").alias("items")).agg(F.collect_list(F.struct("consequent", "measure")).alias("then"))
            return baskets.join(F.broadcast(held), "items").select("tid", F.inline("then"))
    return _contained(found, baskets, broadcast_rules, walked_rows)


def _contained(found: DataFrame, baskets: DataFrame, broadcast_rules: int, walked_rows: int) -> DataFrame:
    """contained, with a walk for every basket."""
    grouped = found.groupBy("antecedent").agg(F.collect_list(F.struct("consequent", "measure")).alias("then"))
    grouped = materialize(grouped, "antecedents")
    used = grouped.select(F.explode("antecedent").alias("item")).distinct()
    kind = baskets.schema["tid"].dataType
    schema = T.StructType([T.StructField("tid", kind), found.schema["consequent"], found.schema["measure"]])
    if grouped.count() <= broadcast_rules:
        few = _frequency(baskets, F.broadcast(used)).collect()  # at most the items of so many antecedents
        return _walked(baskets, grouped.collect(), {r["item"]: (r["n"], r["item"]) for r in few}, schema)
    counts = materialize(_frequency(baskets, used), "frequency")
    sized = grouped.select("antecedent", F.explode("antecedent").alias("item")).join(counts, "item")
    keys = sized.groupBy("antecedent").agg(F.min_by(F.struct("item", "n"), F.struct("n", "item")).alias("key"), F.array_sort(F.collect_list(F.struct("n", "item"))).alias("order"))
    rules = grouped.join(keys, "antecedent").select(F.col("key.item").alias("key"), F.transform("order", lambda x: x["item"]).alias("path"), "then", F.ceil(F.col("key.n") / walked_rows).cast("int").alias("parts"))
    rules = materialize(rules, "rules")
    parts = rules.groupBy("key").agg(F.max("parts").alias("parts"))
    ordered = baskets.select("tid", "items", F.explode("items").alias("key")).join(parts, "key")
    guests = ordered.select("key", F.pmod(F.xxhash64("tid"), F.col("parts")).cast("int").alias("part"), "tid", "items")
    hosts = rules.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "path", "then")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        root: dict = {}
        for at, path in enumerate(right.path):
            node = root
            for i in path:
                node = node.setdefault(i, {})
            node[None] = at
        then, out = right.then.tolist(), []
        for tid, items in zip(left.tid.tolist(), left["items"]):
            for at in _within(root, set(items)):
                out += [(tid, c["consequent"], c["measure"]) for c in then[at]]
        return pd.DataFrame(out, columns=["tid", "consequent", "measure"])

    met = guests.groupBy("key", "part").cogroup(hosts.groupBy("key", "part")).applyInPandas(meet, schema)
    always = grouped.where("size(antecedent) = 0").select(F.explode("then").alias("t"))
    return met.unionByName(baskets.select("tid").crossJoin(F.broadcast(always)).select("tid", "t.consequent", "t.measure"))  # one antecedent


def _within(trie: dict, items: set) -> Iterator[int]:
    """Places of the antecedents of a trie that lie within a set of items."""
    todo = [trie]
    while todo:
        node = todo.pop()
        if None in node:
            yield node[None]
        if len(node) < len(items):
            todo += [to for i, to in node.items() if i is not None and i in items]
        else:
            todo += [node[i] for i in items if i in node]


def _frequency(baskets: DataFrame, used: DataFrame) -> DataFrame:
    """(item, n): how many baskets hold each used item, 0 included."""
    held = baskets.select(F.explode("items").alias("item")).join(used, "item").groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return used.join(held, "item", "left").select("item", F.coalesce("n", F.lit(0)).alias("n"))


def _walked(baskets: DataFrame, rules: list, order: dict[str, tuple], schema: T.StructType) -> DataFrame:
    place = {i: at for at, i in enumerate(sorted(order, key=order.__getitem__))}
    trie = trie_of([r["antecedent"] for r in rules], place)
    text = isinstance(schema["consequent"].dataType, T.StringType)
    shared = baskets.sparkSession.sparkContext.broadcast((trie, place, [[(c["consequent"], c["measure"]) for c in r["then"]] for r in rules]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, place, then = shared.value
        for batch in batches:
            tids, who, consequent, measure = batch.column(0), [], [], []
            for row, items in enumerate(batch.column(1).to_pylist()):
                known = sorted((i for i in items or [] if i in place), key=place.__getitem__)
                for at in walk(trie, known):
                    for c, m in then[at]:
                        who.append(row), consequent.append(c), measure.append(m)
            yield pa.RecordBatch.from_arrays([tids.take(pa.array(who, pa.int64())), pa.array(consequent, pa.string() if text else pa.list_(pa.string())), pa.array(measure, pa.float64())], names=["tid", "consequent", "measure"])

    return baskets.select("tid", "items").mapInArrow(run, schema)
