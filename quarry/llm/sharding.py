"""Sharding by a two-pass external shuffle.

Pass one scatters the records into buckets that fit in memory, by a seeded hash
of the whole record, so that neither equal texts nor a large source fill a
bucket. Pass two gathers one bucket at a time, shuffles it with Fisher-Yates
(Spark's shuffle function) and deals it out: bucket offsets turn places within
buckets into places in one global permutation, which is cut into n_shards runs
whose lengths differ by one at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.tables import file_place, named
from quarry.session import checkpoint_dir

BUCKET_BYTES = 16 << 20
BROADCAST_BUCKETS = 200_000
SEED = 7


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (none if null) plus 16 for the record itself."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def shuffle_into_shards(
    docs: DataFrame,
    n_shards: int,
    *,
    seed: int = SEED,
    size_col: str,
    hash_cols: list[str],
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Place every row of docs in a seeded random order cut into shards.

    Adds shard (int, 0 to n_shards - 1) and slot (long, gapless from 0 within a
    shard) to all columns of docs; columns of these names in docs are replaced.
    The row counts of any two shards differ by one at most (law "rows").
    size_col holds the bytes of a record and sizes the buckets; hash_cols tell
    records apart. Rows that repeat in all of these are told apart by their place
    in the input, so many repeats fill no bucket. Nulls hash like any value. An
    empty table gives an empty result.
    """
    docs = docs.drop("shard", "slot")
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(named(size_col)).alias("bytes")).first()
    rows, buckets = total["n"], max(1, -(-(total["bytes"] or 0) // bucket_bytes))
    parts = min(buckets, 100_000)

    # pass one: scatter. A key holds the place in the input files, so it is the same
    # in both passes and in a task that runs again.
    docs, place = file_place(docs)
    mixed = F.xxhash64(F.lit(seed), *[named(c) for c in hash_cols], *place)
    packed = docs.select(mixed.alias("__key"), F.struct(*[named(c) for c in docs.columns]).alias("__row"))
    scattered = packed.withColumn("__bucket", F.pmod("__key", F.lit(buckets)))

    # pass two: gather a bucket, order it by its keys, shuffle it
    gathered = (
        scattered.repartition(parts, "__bucket")
        .groupBy("__bucket")
        .agg(F.sort_array(F.collect_list(F.struct("__key", "__row"))).alias("__rows"))
        .sortWithinPartitions("__bucket")
        .withColumn("__rows", F.shuffle(F.transform("__rows", lambda r: r["__row"]), F.lit(seed)))
    )
    counts = scattered.groupBy("__bucket").count()
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    if buckets <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    at = F.col("__offset") + F.col("__pos")
    # shard s takes the places p with floor(p * n_shards / rows) = s
    shard = F.expr(f"((__offset + __pos) * {n_shards}L) div {max(1, rows)}L")
    start = F.expr(f"(__shard * {max(1, rows)}L + {n_shards - 1}L) div {n_shards}L")
    return (
        gathered.join(offsets, "__bucket")
        .select("__offset", F.posexplode("__rows").alias("__pos", "__row"))
        .withColumn("__shard", shard)
        .select(
            *[F.col("__row").getField(c).alias(c) for c in docs.columns],
            F.col("__shard").cast("int").alias("shard"),
            (at - start).alias("slot"),
        )
    )


def write_shards(placed: DataFrame, path: str) -> None:
    """Write one folder for each shard, its rows in slot order. The permutation
    is dealt out in runs, so a task holds rows of few shards."""
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def written_shards(placed: DataFrame) -> DataFrame:
    """Write the shards in the shared folder and give the rows as they stand there."""
    spark = placed.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    write_shards(placed, path)
    return spark.read.schema(placed.schema).parquet(path).select(*[named(c) for c in placed.columns])
