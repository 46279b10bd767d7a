"""Mixing sources to target weights by Pfair scheduling.

Every source's rows are cut into blocks. Of a source with weight q out of Q, the
k-th block (from 0) is released at slot floor(k * Q / q) and due by slot
ceil((k + 1) * Q / q). At every slot the released block with the earliest
deadline goes out. The weights add up to Q, so on one line of slots this order
meets every deadline, and after any number t of slots a source has had less than
one block more or less than t * q / Q. The schedule repeats after Q slots, so one
period is worked out and every block finds its slot by arithmetic. A period has
PERIOD slots, or SLOTS_EACH for every source if there are more sources than that.

A source that has run out leaves its slots empty; the others keep theirs. With
`refill` its rows come round again instead.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.tables import file_place, named
from quarry.session import materialize

PERIOD = 1000
BLOCK_ROWS = 64
BUCKET_ROWS = 4_096
SLOTS_EACH = 8
#: With refill, times that a row is given at most.
MOST_REPEATS = 100
#: Steps (sources x slots) up to which a schedule is made in one row's arrays, and
#: slots up to which it is broadcast.
SHORT_SCHEDULE = 1_000_000
BROADCAST_SLOTS = 200_000
BATCH = 10_000
SEED = 11


def shuffle_key(id_col: str, seed: int) -> Column:
    """60 bits of md5 of seed and id: the order of rows within their source."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(named(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def weights_by_size(docs: DataFrame, source_col: str, power: float, period: int = PERIOD) -> DataFrame:
    """Integer weights (source, q) that add up to the period, or to SLOTS_EACH for
    every source if the period has fewer slots than there are sources: each source
    has one part and the rest goes in proportion to its rows to the given power,
    by largest remainder (ties: source order)."""
    counts = docs.groupBy(F.coalesce(named(source_col).cast("string"), F.lit("")).alias("source")).count()
    everything = Window.partitionBy(F.lit(0))
    share = F.pow("count", F.lit(power))
    sources = F.count(F.lit(1)).over(everything)
    slots = F.when(sources > period, sources * SLOTS_EACH).otherwise(F.lit(period))
    counts = counts.withColumn("slots", slots)
    exact = share / F.sum(share).over(everything) * (F.col("slots") - sources)
    floors = counts.withColumn("exact", exact).withColumn("low", F.floor("exact"))
    by_rest = Window.partitionBy(F.lit(0)).orderBy(F.round(F.col("exact") - F.col("low"), 9).desc(), "source")
    left = F.col("slots") - F.sum(F.col("low") + 1).over(everything)
    more = (F.row_number().over(by_rest) <= left).cast("long")
    return floors.withColumn("q", F.col("low") + 1 + more).select("source", "q")


def pfair_period(weights: DataFrame) -> DataFrame:
    """One period of the schedule: (source, q, period, k, at, release, deadline):
    block k of the source goes out at slot `at`.

    Earliest deadline first, ties to the source that sorts first. Only as many
    rows as the period has slots exist. A short schedule is made in one row's
    arrays; a long one slot by slot in one task, which holds a few numbers for
    every source and gives its slots in batches.
    """
    size = weights.agg(F.count(F.lit(1)).alias("sources"), F.sum("q").alias("slots")).first()
    if size["sources"] * (size["slots"] or 0) > SHORT_SCHEDULE:
        return _long_period(weights)
    listed = weights.groupBy().agg(F.sort_array(F.collect_list(F.struct("source", "q"))).alias("s")).where(F.size("s") > 0)
    listed = listed.withColumn("period", F.expr("aggregate(s, 0L, (a, x) -> a + x.q)"))
    pick = (
        "array_min(filter(transform(sequence(0, size(s) - 1), i -> if(a.n[i] * period div s[i].q <= t, "
        "named_struct('d', ((a.n[i] + 1) * period + s[i].q - 1) div s[i].q, 'i', i), null)), x -> x is not null)).i"
    )
    step = (
        f"transform(array({pick}), p -> named_struct('n', transform(a.n, (v, j) -> v + if(j = p, 1L, 0L)), "
        "'out', concat(a.out, array(p))))[0]"
    )
    start = "named_struct('n', transform(s, x -> 0L), 'out', cast(array() as array<int>))"
    order = listed.withColumn("out", F.expr(f"aggregate(sequence(0, cast(period as int) - 1), {start}, (a, t) -> {step}).out"))
    slots = order.select("s", "period", F.posexplode("out").alias("at", "i"))
    slots = slots.select("period", "at", F.expr("s[i].source").alias("source"), F.expr("s[i].q").alias("q"))
    k = F.row_number().over(Window.partitionBy("source").orderBy("at")) - 1
    return slots.withColumn("k", k.cast("long")).select(
        "source",
        "q",
        "period",
        "k",
        F.col("at").cast("long").alias("at"),
        F.expr("k * period div q").alias("release"),
        F.expr("((k + 1) * period + q - 1) div q").alias("deadline"),
    )


def _long_period(weights: DataFrame) -> DataFrame:
    """The schedule of pfair_period by two heaps: blocks to be released, and
    released ones by deadline."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = [], []
        for batch in batches:
            names += batch.column(0).to_pylist()
            q += batch.column(1).to_pylist()
        period, out = sum(q), []
        due = lambda i, k: -(-(k + 1) * period // q[i])
        ready = [(due(i, 0), i, 0) for i in range(len(q))]
        heapq.heapify(ready)
        later: list[tuple[int, int, int]] = []
        for t in range(period):
            while later and later[0][0] <= t:
                _, i, k = heapq.heappop(later)
                heapq.heappush(ready, (due(i, k), i, k))
            deadline, i, k = heapq.heappop(ready)
            out.append((names[i], q[i], period, k, t, k * period // q[i], deadline))
            if k + 1 < q[i]:
                heapq.heappush(later, ((k + 1) * period // q[i], i, k + 1))
            if len(out) == BATCH or t == period - 1:
                columns = [pa.array(x, pa.string() if n == 0 else pa.int64()) for n, x in enumerate(zip(*out))]
                yield pa.RecordBatch.from_arrays(columns, names=["source", "q", "period", "k", "at", "release", "deadline"])
                out = []

    listed = weights.select(F.col("source").cast("string"), F.col("q").cast("long")).repartition(1).sortWithinPartitions("source")
    return listed.mapInArrow(run, "source string, q long, period long, k long, at long, release long, deadline long")


def _refilled(ranked: DataFrame, weights: DataFrame, block_rows: int, small: bool, most_repeats: int) -> DataFrame:
    """Rows of rank_within_source, with rows of sources that run out early given
    again, by whole blocks, at the ranks that follow.

    The mixture ends where the last source runs out: there a source of weight q
    is due q rows for each of the most rows that any source has to a part of its
    weight. Every row is there once at least, and most_repeats times at most: a
    source too small for its weight gets less of the mixture.
    """
    counts = ranked.groupBy("__source").agg(F.count(F.lit(1)).alias("__rows"))
    known = counts.join(weights.select(F.col("source").alias("__source"), F.col("q").alias("__q")), "__source")
    most = known.agg(F.max(F.col("__rows") / F.col("__q")).alias("__most"))
    extra = F.floor((F.col("__most") * F.col("__q") - F.col("__rows")) / block_rows + F.lit(1e-9)) * block_rows
    wanted = known.crossJoin(F.broadcast(most)).select("__source", "__rows", F.least(F.col("__rows") + F.greatest(extra, F.lit(0)), F.col("__rows") * most_repeats).cast("long").alias("__all"))
    times = F.expr("sequence(0L, (__all - 1 - __rank) div __rows)")
    again = ranked.join(F.broadcast(wanted) if small else wanted, "__source").withColumn("__again", F.explode(times))
    return again.withColumn("__rank", F.col("__rank") + F.col("__again") * F.col("__rows")).drop("__again", "__rows", "__all")


def rank_within_source(docs: DataFrame, source_col: str, id_col: str, seed: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add __source (null: empty text) and __rank, the place of a row within its
    source in seeded order, from 0.

    A source is cut into buckets of its uniform key, ranked one by one and offset
    by the counts of the buckets before, so a source that holds a third of all
    rows is spread like the others. An id that comes more often than four buckets'
    rows has buckets of its own, by the place of its rows in the input files.
    """
    source, key = F.coalesce(named(source_col).cast("string"), F.lit("")), shuffle_key(id_col, seed)
    rows = docs.count()
    buckets = max(1, -(-rows // bucket_rows))
    bucket = F.floor(F.shiftright("__key", 30) * F.lit(buckets) / F.lit(1 << 30))

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns({"__source": source, "__key": key}).withColumn("__bucket", bucket)

    placed = keyed(docs).withColumns({"__run": F.lit(0), "__part": F.lit(0)})
    counts = placed.groupBy("__source", "__bucket").count()
    if rows > 4 * bucket_rows and (hot := _hot_keys(placed, counts, bucket_rows)) is not None:
        docs, place = file_place(docs)
        spread = F.xxhash64(F.lit(seed), *place)
        placed = keyed(docs.withColumn("__spread", spread)).join(hot, ["__source", "__bucket"], "left")
        before = F.coalesce(F.size(F.filter("__hot", lambda h: h["__key"] < F.col("__key"))), F.lit(0))
        own = F.try_element_at(F.filter("__hot", lambda h: h["__key"] == F.col("__key")), F.lit(1))
        placed = placed.withColumn("__own", own).withColumn("__run", 2 * before + F.col("__own").isNotNull().cast("int"))
        placed = placed.withColumn("__part", F.when(F.col("__own").isNull(), 0).otherwise(F.pmod("__spread", F.ceil(F.col("__own.count") / bucket_rows))).cast("int"))
        placed = placed.drop("__hot", "__own")
        counts = placed.groupBy("__source", "__bucket", "__run", "__part").count()
    parts = [c for c in ("__bucket", "__run", "__part") if c in counts.columns]
    before = Window.partitionBy("__source").orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    local = F.row_number().over(Window.partitionBy("__source", *parts).orderBy("__key", named(id_col))) - 1
    ranked = placed.withColumn("__local", local).join(offsets, ["__source", *parts])
    return ranked.withColumn("__rank", F.col("__offset") + F.col("__local")).drop("__local", "__offset", "__bucket", "__run", "__part", "__spread", "__key")


def _hot_keys(placed: DataFrame, counts: DataFrame, bucket_rows: int) -> DataFrame | None:
    """(__source, __bucket, __hot): of the buckets with far too many rows the keys that
    have them, with their counts; None where there are none."""
    crowded = materialize(counts.where(F.col("count") > 4 * bucket_rows).drop("count"), "crowded")
    if crowded.isEmpty():
        return None
    keys = placed.join(crowded, ["__source", "__bucket"], "left_semi").groupBy("__source", "__bucket", "__key").count().where(F.col("count") > bucket_rows)
    hot = materialize(keys.groupBy("__source", "__bucket").agg(F.array_sort(F.collect_list(F.struct("__key", "count"))).alias("__hot")), "hot")
    return F.broadcast(hot) if hot.count() <= BROADCAST_SLOTS else hot  # at most one of bucket_rows rows


def mix_sources(
    docs: DataFrame,
    weights: DataFrame,
    *,
    source_col: str = "source",
    id_col: str = "doc_id",
    block_rows: int = BLOCK_ROWS,
    seed: int = SEED,
    refill: bool = False,
    most_repeats: int = MOST_REPEATS,
) -> DataFrame:
    """Give every row its slot in the mixture.

    weights: (source, q), whole numbers over 0; a null source counts as the empty
    text. With refill, sources that run out before the last one give blocks of
    rows again, so that each has less than one block less than its weight's share
    of rows at the end, unless that would take a row more than most_repeats times;
    without it every row comes once. Adds to
    all columns of docs: block (of its source, from 0), place (of the row within
    the block), slot, release and deadline of the block. Sources without a
    weight, and rows of an empty table, give no rows. Ties of the seeded key go
    by id_col; rows that repeat stay apart. Columns of docs with these names are
    replaced. Order the result by slot and place to read the mixture.
    """
    docs = docs.drop("block", "place", "slot", "release", "deadline")
    schedule = pfair_period(weights).withColumnsRenamed({c: f"__{c}" for c in ("source", "q", "period", "k", "at", "release", "deadline")})
    packed = docs.select(named(source_col).alias("__of"), named(id_col).alias("__id"), F.struct(*[named(c) for c in docs.columns]).alias("__row"))
    ranked = rank_within_source(packed, "__of", "__id", seed)
    small = (weights.agg(F.sum("q")).first()[0] or 0) <= BROADCAST_SLOTS
    if refill:
        ranked = _refilled(ranked, weights, block_rows, small, most_repeats)
    quota = weights.select(F.col("source").alias("__source"), F.col("q").alias("__n"))
    blocks = (
        ranked.join(F.broadcast(quota) if small else quota, "__source")
        .withColumns({"__block": F.expr(f"__rank div {block_rows}"), "__place": F.col("__rank") % block_rows})
        .withColumns({"__round": F.expr("__block div __n"), "__k": F.col("__block") % F.col("__n")})
        .join(F.broadcast(schedule) if small else schedule, ["__source", "__k"])
    )
    later = F.col("__round") * F.col("__period")
    return blocks.select(
        *[F.col("__row").getField(c).alias(c) for c in docs.columns],
        F.col("__block").alias("block"),
        F.col("__place").alias("place"),
        (later + F.col("__at")).alias("slot"),
        (later + F.col("__release")).alias("release"),
        (later + F.col("__deadline")).alias("deadline"),
    )
