"""Connected components as Spark joins, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import discard, materialize

MOST_ROUNDS = 60


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie the larger (or the smaller) neighbours of every node to the smallest."""
    ways = _both(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = ways.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    tied = ways.join(least, "a")
    if large:
        return tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    others = tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.where("a <> m").select("a", F.col("m").alias("b")))


def _settled(edges: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has one only, which has none itself."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select(F.col("b"), F.lit(0), F.lit(1)))
    ways = ends.groupBy("n").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return not ways.where("up > 1 or (up > 0 and down > 0)").limit(1).count()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge list; component is the smallest
    node that can be reached. Loops and repeated edges are allowed; edges with a
    null end are left out. Every round writes its edges to the shared folder, and
    no round holds more of them than there were at first.
    """
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    loops = now.select(F.col("a").alias("node")).union(now.select(F.col("b").alias("node")))
    now = materialize(now.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        if _settled(now):
            break
        old = now
        now = materialize(_star(_star(now, large=True).distinct(), large=False).distinct(), "edges")
        discard(old)
    else:
        raise RuntimeError(f"connected components not settled after {MOST_ROUNDS} rounds")
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return loops.distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
