"""Blocked products: all pairs of the members of clusters, dealt out as tasks.

A cluster is cut into blocks, and every two blocks that may hold a wanted pair
make one task, so no task holds more than two blocks whatever the cluster's size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEW_BLOCKS = 4


def forest(i: np.ndarray, j: np.ndarray, n: int) -> list[int]:
    """Places of links that make a spanning forest of the links (i, j)."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for at, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
            kept.append(at)
    return kept


#: Sizes of linked sets are in the same class or in neighbouring ones.
def _size_class(n: str, percent: int) -> str:
    return f"cast(floor(ln({n}) / ln(100 / {percent}D)) as int)"


def deal_blocks(nodes: DataFrame, block: int, percent: int = 75) -> DataFrame:
    """Deal nodes (key, cluster, n, kind) out to tasks: (key, task, unit, side).

    Kinds: "m" for members of a cluster that need not meet each other, "p" for its
    pivots, "l" for all others. Every "l" meets every "l" and every "m" or "p"
    whose size class allows a link, every "m" every "p". Groups of a cluster, class
    and kind are cut into blocks by a hash; the blocks of long sets have fewer
    members. A cluster that fits in one block is one product, and such clusters
    share tasks.
    """
    sums = nodes.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("all")).where(F.col("size") > 1)
    sized = nodes.join(sums, "cluster")
    small = (F.col("size") <= block) & (F.col("all") <= block * 1000)
    bins = F.pmod(F.xxhash64("cluster"), F.greatest(F.lit(1), (F.lit(_bins(sums, block)))))
    whole = sized.where(small).select("key", bins.alias("task"), F.col("cluster").alias("unit"), F.lit(2).alias("side"))
    large = sized.where(~small).withColumn("class", F.expr(_size_class("n", percent)))
    per = F.greatest(F.lit(16), F.least(F.lit(block), F.expr(f"cast({block * 1000} / pow(100 / {percent}D, class + 1) as int)")))
    groups = large.groupBy("cluster", "class", "kind").count().withColumn("blocks", F.ceil(F.col("count") / per)).drop("count")
    mates = groups.select("cluster", F.col("class").alias("class2"), F.col("kind").alias("kind2"), F.col("blocks").alias("blocks2"))
    near = groups.withColumn("class2", F.explode(F.expr("array(class - 1, class, class + 1)"))).join(mates, ["cluster", "class2"])
    near = near.where("kind = 'l' or kind2 = 'l' or (kind = 'm' and kind2 = 'p') or (kind = 'p' and kind2 = 'm') or (kind = 'p' and kind2 = 'p')")
    met = near.groupBy("cluster", "class", "kind", "blocks").agg(F.collect_list(F.struct("class2", "kind2", "blocks2")).alias("mates"))
    placed = large.join(met, ["cluster", "class", "kind"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    pairs = placed.select("key", "cluster", "class", "kind", "block", F.explode("mates").alias("mate")).select(
        "key", "cluster", F.struct("class", "kind", "block").alias("own"), "mate", F.explode(F.expr("sequence(0L, mate.blocks2 - 1)")).alias("block2")
    )
    other = F.struct(F.col("mate.class2").alias("class"), F.col("mate.kind2").alias("kind"), F.col("block2").alias("block"))
    pairs = pairs.withColumn("other", other)
    task = F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other"))
    side = F.expr("case when own = other then 2 when own < other then 0 else 1 end")
    return whole.union(pairs.select("key", task.alias("task"), task.alias("unit"), side.alias("side")))


def _bins(sums: DataFrame, block: int) -> int:
    """Tasks for small clusters, of about as many members as a block has."""
    members = sums.where((F.col("size") <= block)).agg(F.sum("size")).first()[0] or 0
    return max(1, -(-int(members) // block))


def by_unit(unit: np.ndarray) -> list[np.ndarray]:
    """Places of the rows of each unit of a task, of units with more than one row."""
    order = np.argsort(unit, kind="stable")
    return [at for at in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1) if len(at) > 1]
