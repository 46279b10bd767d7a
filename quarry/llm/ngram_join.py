"""Near duplicates: a set-similarity join on word n-grams as a blocked sparse
matrix product.

A document's set holds the 64-bit hashes of its distinct n-grams of words;
documents with equal sets are one node. Sets that reach the threshold share a
node in the first part of their n-grams under any common order, so only that
part (a document's prefix) is dealt out by n-gram, as the columns of the
incidence matrix. The order puts n-grams last that a sample of the documents
shows to be frequent, which keeps the columns short; the sample touches speed
only, since the rule holds for every order.

Overlaps within prefixes are added up for pairs in short columns, and pairs
whose sizes and overlaps cannot reach the threshold are discarded. What is left,
and what meets in long columns, joins documents into clusters. A cluster is cut
into blocks by size, and each pair of blocks whose sizes allow a link is one
matrix product, in a task of its own, that yields the exact overlaps of all its
pairs. Of the links found a task returns a spanning forest, which keeps every
connection. Clusters of many blocks are first held against their first block, so
that the second product need only look at what has not met the main component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.graph import connected_components
from quarry.llm.blocks import FEW_BLOCKS, by_unit, deal_blocks, forest
from quarry.llm.tables import named, schema_of, slices
from quarry.session import materialize

WORDS = 5
PERCENT = 75
#: N-grams in about so many documents count as frequent. What the sample misses is
#: multiplied out in columns of up to LONG times as many keys.
SHORT_COLUMN = 48
LONG = 4
SAMPLE = 8
MOST_FREQUENT = 1_000_000
BLOCK = 384
BROADCAST_ROWS = 1_000_000
CHUNK = 4096
CACHE = 200_000

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """Numbers of words, leading to their hashes; bounded."""

    def __init__(self):
        self.table = np.zeros(CACHE, np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        self.table[n] = xxhash.xxh3_64_intdigest(word)
        self[word] = n
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) + len(words) > CACHE:
            self.clear()
            if len(words) > CACHE:
                half = len(words) // 2
                return np.concatenate([self.of(words[:half]), self.of(words[half:])])
        return self.table[np.fromiter(map(self.__getitem__, words), np.int64, len(words))]


_hashes = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of a text's set. A-Z are lower-cased; words are what stands
    between runs of space, tab, line and page ends. A text of fewer words is one
    shingle; one without words has the empty set."""
    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return np.zeros(0, np.uint64)
    h = _hashes.of(tokens)
    width = min(words, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = _mix(out * _STEP + h[i : i + n])
    return np.unique(out)


def set_key(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def least_overlap(a, b, percent: int = PERCENT):
    """The least size of an intersection that links sets of a and b elements."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n, percent: int = PERCENT):
    """So many elements of n hold the first one of any intersection that links."""
    return np.minimum(n, n - -(-percent * n // 100) + 1)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _frequent(docs: DataFrame, words: int, sample: int, column: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of n-grams that a sample of the documents, one in `sample` by a hash
    of the text, shows to be in more than about `column` of them all; at most
    `most`, those that come first by count. And the place of each by ascending
    count, so that among frequent n-grams too the rarer ones come first."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                found = [shingles(t, words) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate([np.zeros(0, np.uint64), *found])))], names=["g"])

    part = docs.where(F.pmod(F.xxhash64("__text", F.lit(1)), F.lit(sample)) == 0).select("__text")
    counts = part.mapInArrow(explode, "g long").groupBy("g").count()
    least = max(3, column // sample)
    top = counts.where(F.col("count") >= least).orderBy(F.desc("count"), "g").limit(most)
    rows = top.toArrow()
    found, times = (rows.column(c).to_numpy().astype(np.int64) for c in ("g", "count"))
    by_count = np.lexsort((found, times))
    place = np.empty(len(found), np.int64)
    place[by_count] = np.arange(len(found))
    by_hash = np.argsort(found)
    return found[by_hash], place[by_hash]


def _sets(docs: DataFrame, words: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """__id, n, key, row (a hash of id and text) and prefix (hashes, frequent ones last
    and by count; how many of them are frequent is n_freq) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place = shared.value
        for whole in batches:
            for batch in slices(whole, "__text"):
                sizes, keys, prefixes, freq = [], [], [], []
                for text in batch.column("__text").to_pylist():
                    grams = shingles(text, words)
                    n = len(grams)
                    sizes.append(n)
                    keys.append(set_key(grams) if n else None)
                    signed = _signed(grams)
                    at = np.searchsorted(last, signed) if len(last) else np.zeros(n, np.int64)
                    hot = (last[np.minimum(at, len(last) - 1)] == signed) if len(last) else np.zeros(n, bool)
                    size = int(prefix_length(np.int64(n), percent))
                    prefix = np.concatenate([signed[~hot], signed[hot][np.argsort(place[at[hot]])]])[:size]
                    prefixes.append(prefix.tobytes())
                    freq.append(max(0, size - int((~hot).sum())))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), batch.column("__row"), pa.array(freq, pa.int32()), pa.array(prefixes, pa.binary())],
                    names=["__id", "n", "key", "row", "n_freq", "prefix"],
                )

    rows = docs.withColumn("__row", _row())
    fields = {"n": T.LongType(), "key": T.LongType(), "row": T.LongType(), "n_freq": T.IntegerType(), "prefix": T.BinaryType()}
    return rows.mapInArrow(build, schema_of(docs, "__id", **fields))


def _row() -> Column:
    """Tells a row from others, null id or not; rows that repeat share it."""
    return F.xxhash64("__id", "__text")


def _columns(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The prefixes by column: (g, key, n), dealt by g and in order of g and key,
    for n-grams not known to be frequent; and (a, b) = (g, key) for those that are.

    Equal sets that one task meets are given once, so many copies fill no column.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                piece = batch.slice(start, 2000)
                keys = piece.column("key").to_pylist()
                fresh = []
                for at, key in enumerate(keys):
                    if key not in seen:
                        fresh.append(at)
                        if len(seen) < CACHE:
                            seen.add(key)
                prefixes = piece.column("prefix").take(pa.array(fresh, pa.int64())).to_pylist()
                prefixes = [np.frombuffer(x, np.int64) for x in prefixes]
                lengths = np.array([len(x) for x in prefixes], np.int64)
                rows = np.repeat(np.array(fresh, np.int64), lengths)
                pos = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                frequent = pos >= np.repeat(lengths, lengths) - piece.column("n_freq").to_numpy()[rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([*prefixes, np.zeros(0, np.int64)])),
                        pa.array(piece.column("key").to_numpy()[rows]),
                        pa.array(piece.column("n").to_numpy()[rows].astype(np.int32)),
                        pa.array(frequent),
                    ],
                    names=["g", "key", "n", "frequent"],
                )

    schema = "g long, key long, n int, frequent boolean"
    nodes = sets.where("n > 0").select("key", "n", "n_freq", "prefix")
    rare = nodes.mapInArrow(explode, schema).where("not frequent").drop("frequent")
    known = nodes.where("n_freq > 0").mapInArrow(explode, schema).where("frequent").select(F.col("g").alias("a"), F.col("key").alias("b"))
    return rare.repartition("g").sortWithinPartitions("g", "key"), known


def _meetings(columns: DataFrame, percent: int, column: int) -> DataFrame:
    """Pairs that meet in a column: (a, b, na, nb, hits) with a < b.

    From a column of at most `column` keys come all pairs that their sizes allow,
    hits = 1; from a longer one the pairs of its first key with every other,
    hits = 0, whatever their sizes. Rows stream through in column order; no more
    than one short column and one batch are held.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = np.zeros((0, 3), np.int64), None
        for batch in chain(batches, [None]):
            rows = held
            if batch is not None:
                rows = np.concatenate([held, np.column_stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])])
            if not len(rows):
                continue
            rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])]
            out = []
            if first is not None:  # the open long column goes on
                n = int(np.searchsorted(rows[:, 0], first[0], side="right"))
                out.append(_star(first, rows[:n]))
                rows = rows[n:]
                first = first if not len(rows) else None
            begins = np.flatnonzero(np.diff(rows[:, 0], prepend=rows[0, 0] - 1)) if len(rows) else np.zeros(0, np.int64)
            lengths = np.diff(begins, append=len(rows))
            held = rows[:0]
            if batch is not None and len(begins):  # the last column may go on
                if lengths[-1] <= column:
                    held = rows[begins[-1] :]
                    begins, lengths = begins[:-1], lengths[:-1]
                else:
                    first = rows[begins[-1]]
            for k in np.unique(lengths):
                at = begins[lengths == k]
                if 1 < k <= column:
                    out.append(_pairs(rows, at, int(k), percent))
                elif k > column:
                    out += [_star(rows[a], rows[a + 1 : a + k]) for a in at]
            if out:
                found = np.concatenate(out)
                ints = [pa.array(found[:, i].astype(np.int32)) for i in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), *ints], names=["a", "b", "na", "nb", "hits"])

    return columns.mapInArrow(meet, "a long, b long, na int, nb int, hits int")


def _pairs(rows: np.ndarray, at: np.ndarray, k: int, percent: int) -> np.ndarray:
    """All pairs within the columns of k rows that begin at `at`, if sizes allow them."""
    i, j = np.triu_indices(k, 1)
    a, b = rows[(at[:, None] + i).ravel()], rows[(at[:, None] + j).ravel()]
    ok = 100 * np.minimum(a[:, 2], b[:, 2]) >= percent * np.maximum(a[:, 2], b[:, 2])
    a, b = a[ok], b[ok]
    return np.column_stack([a[:, 1], b[:, 1], a[:, 2], b[:, 2], np.ones(len(a), np.int64)])


def _star(first: np.ndarray, rest: np.ndarray) -> np.ndarray:
    rest = rest[rest[:, 1] != first[1]]
    one = np.broadcast_to(first, rest.shape)
    return np.column_stack([one[:, 1], rest[:, 1], one[:, 2], rest[:, 2], np.zeros(len(rest), np.int64)])


def _candidates(met: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of pairs that may link, by what their prefixes share: all of an
    intersection is in both prefixes or beyond the end of one of them."""
    added = met.groupBy("a", "b", "na", "nb").agg(F.sum("hits").alias("h"), F.min("hits").alias("least"))
    bound = F.expr(f"h + ({percent} * greatest(na, nb) + 99) div 100 - 1")
    need = F.expr(f"({percent} * (na + nb) + {99 + percent}) div {100 + percent}")
    return added.where((F.col("least") == 0) | (bound >= need)).select("a", "b")


def multiply(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Exact sizes of all intersections of sets on the left with sets on the right
    (with themselves, if right is None), as a product of sparse 0-1 matrices that
    is added up over chunks of columns; columns with one row are left out."""
    sets = left + (right or [])
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    columns, at, df = np.unique(np.concatenate([*sets, np.zeros(0, np.int64)]), return_inverse=True, return_counts=True)
    keep = df[at] > 1
    rows, at = rows[keep], at[keep]
    used, at = np.unique(at, return_inverse=True)
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    n, m = len(left), len(right) if right is not None else len(left)
    out = np.zeros((n, m), np.float32)
    edges = np.searchsorted(at, np.arange(0, len(used) + CHUNK, CHUNK))
    for c, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        x = np.zeros((len(sets), CHUNK), np.float32)
        x[rows[a:b], at[a:b] - c * CHUNK] = 1
        mine = np.flatnonzero(x[:n].any(1))
        if right is None:
            out[np.ix_(mine, mine)] += x[mine] @ x[mine].T
        else:
            others = np.flatnonzero(x[n:].any(1))
            out[np.ix_(mine, others)] += x[mine] @ x[n + others].T
    return out


def _block_links(work: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of every task's products. work: task, unit (of a product within
    the task), side (0 or 1; 2 for a product of a block with itself), key, grams."""

    def product(keys: np.ndarray, sets: list[np.ndarray], side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lefts, rights = np.flatnonzero(side != 1), np.flatnonzero(side == 1)
        own = side[0] == 2
        if own and len(sets) == 2:
            inter = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
            found = 100 * inter >= percent * (len(sets[0]) + len(sets[1]) - inter)
            return (keys[:1], keys[1:]) if found else (keys[:0], keys[:0])
        if own:
            rights = lefts
        sizes = np.array([len(s) for s in sets], np.int64)
        shared = multiply([sets[x] for x in lefts], None if own else [sets[x] for x in rights])
        inter = np.rint(shared).astype(np.int64)
        i, j = np.nonzero(100 * inter >= percent * (sizes[lefts][:, None] + sizes[rights][None, :] - inter))
        i, j = lefts[i], rights[j]
        i, j = i[i != j], j[i != j]
        kept = forest(i, j, len(sets))
        return keys[i[kept]], keys[j[kept]]

    def run(group: pa.Table) -> pa.Table:
        unit, side, keys = (group.column(c).to_numpy() for c in ("unit", "side", "key"))
        grams = group.column("grams").to_pylist()
        found = [(keys[:0], keys[:0])]
        for at in by_unit(unit):
            found.append(product(keys[at], [np.frombuffer(grams[x], np.int64) for x in at], side[at]))
        return pa.table({"a": np.concatenate([x[0] for x in found]), "b": np.concatenate([x[1] for x in found])})

    return work.groupBy("task").applyInArrow(run, "a long, b long")


def _links(docs: DataFrame, nodes: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    """Links among nodes (key, row of a text with that set, cluster, n, kind). Rows
    that repeat give their set once."""
    tasks = deal_blocks(nodes.select("key", "cluster", "n", "kind"), block, percent)
    wanted = nodes.select(F.col("row").alias("__row"), F.col("key").alias("__key"))
    if nodes.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.withColumn("__row", _row()).join(wanted, "__row")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in slices(whole, "__text"):
                keys, at, grams = batch.column("__key").to_pylist(), [], []
                for i, text in enumerate(batch.column("__text").to_pylist()):
                    if keys[i] in seen:
                        continue
                    found = shingles(text, words)
                    if set_key(found) == keys[i]:  # row hashes may clash
                        at.append(i), grams.append(found.tobytes())
                        if len(seen) < CACHE:
                            seen.add(keys[i])
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in at], pa.int64()), pa.array(grams, pa.binary())], names=["key", "grams"])

    sets = texts.select("__key", "__text").mapInArrow(build, "key long, grams binary").dropDuplicates(["key"])
    return _block_links(sets.join(tasks, "key"), percent)


def _components(docs: DataFrame, words: int, percent: int, column: int, block: int, sample: int, most_frequent: int) -> DataFrame:
    """(__id, row, n, key, first) of every row of docs (__id, __text): first is the
    first row (no_id, __id, row) of its component, null for texts without words."""
    frequent = _frequent(docs, words, sample, column, most_frequent)
    sets = materialize(_sets(docs, words, percent, frequent), "sets")
    worded = sets.where("key is not null")
    first = F.struct(F.col("__id").isNull().alias("no_id"), "__id", "row")
    nodes_all = materialize(worded.groupBy("key", "n").agg(F.min(first).alias("first"), F.min("row").alias("row")), "keys")

    rare, known = _columns(sets)
    candidates = materialize(_candidates(_meetings(rare, percent, LONG * column), percent).union(known), "candidates")
    clusters = connected_components(candidates).withColumnsRenamed({"node": "key", "component": "cluster"})
    nodes = materialize(nodes_all.select("key", "n", "row").join(clusters, "key"), "nodes")

    # clusters of many blocks: first against pivots, one block's worth of a class
    sums = nodes.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    nodes = nodes.join(sums, "cluster").withColumn("large", F.col("size") > FEW_BLOCKS * block)
    pivot = F.pmod(F.xxhash64("key", F.lit(2)), F.col("size")) < block // 2
    kinds = nodes.withColumn("kind", F.when(~F.col("large"), "l").when(pivot, "p").otherwise("m"))
    links = materialize(_links(docs, kinds, words, percent, block), "links")
    large = nodes.where("large")
    if large.limit(1).count():
        parts = connected_components(links).withColumnsRenamed({"node": "key", "component": "part"})
        part = F.coalesce("part", "key")
        placed = materialize(large.join(parts, "key", "left").withColumn("part", part), "placed")
        counts = placed.groupBy("cluster", "part").count()
        main = counts.groupBy("cluster").agg(F.max_by("part", F.struct("count", "part")).alias("main"))
        again = placed.join(main, "cluster").withColumn("kind", F.when(F.col("part") == F.col("main"), "m").otherwise("l"))
        left = again.where("kind = 'l'").select("cluster").distinct()
        links = links.union(materialize(_links(docs, again.join(left, "cluster", "left_semi"), words, percent, block), "links"))

    found = connected_components(links).withColumnsRenamed({"node": "key", "component": "root"})
    rooted = nodes_all.select("key", "first").join(found, "key", "left").withColumn("root", F.coalesce("root", "key"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    ids = rooted.drop("first").join(firsts, "root").select("key", "first")
    worded = worded.select("__id", "row", "n", "key").join(ids, "key").select("__id", "row", "n", "key", "first")
    bare = sets.where("key is null").select("__id", "row", "n", "key")
    return worded.unionByName(bare, allowMissingColumns=True)


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(named(id_col).alias("__id"), named(text_col).cast("string").alias("__text"))


def ngram_components(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
    column: int = SHORT_COLUMN,
    block: int = BLOCK,
    sample: int = SAMPLE,
    most_frequent: int = MOST_FREQUENT,
) -> DataFrame:
    """id_col, n_shingles (size of the set) and component_id for every row.

    Two documents link when 100 * intersection >= percent * union of their sets of
    `words`-word shingles; component_id is the smallest id that links reach, the
    row's own included. Null, empty and blank texts have an empty set and link with
    nothing, not even each other. Rows with a null id have a null component_id and
    lend no id to others, though they do link them. Repeated rows each get a row;
    an empty table gives an empty result; no other column is read. column, block,
    sample and most_frequent touch speed only.
    """
    found = _components(_narrow(docs, id_col, text_col), words, percent, column, block, sample, most_frequent)
    own = F.when(F.col("key").isNull(), F.col("__id")).otherwise(F.col("first.__id"))
    return found.select(F.col("__id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("__id").isNotNull(), own).alias("component_id"))


def keep_one_of_each(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
    column: int = SHORT_COLUMN,
    block: int = BLOCK,
    sample: int = SAMPLE,
    most_frequent: int = MOST_FREQUENT,
) -> DataFrame:
    """The rows of docs, with all their columns, without near duplicates.

    Of each component the row with the smallest id stays (a null id is the largest;
    ties go by a hash of id and text), and one row only where that row repeats.
    Texts without words all stay. An id says nothing about a row with another text:
    rows are told apart by id and text.
    """
    found = _components(_narrow(docs, id_col, text_col), words, percent, column, block, sample, most_frequent)
    found = materialize(found.where("key is not null").select("row", F.col("first.row").alias("first")), "found")
    gone = found.where("row <> first").select(F.col("row").alias("__gone")).distinct()
    repeated = found.where("row = first").groupBy(F.col("row").alias("__again")).count().where("count > 1").select("__again")
    row = F.xxhash64(named(id_col), named(text_col).cast("string"))
    marks = _spare(docs, "__row", "__again", "__gone")
    gone, repeated = gone.withColumnRenamed("__gone", marks[2]), repeated.withColumnRenamed("__again", marks[1])
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    left = docs.withColumn(marks[0], row)
    left = left.join(gone, named(marks[0]) == named(marks[2]), "left_anti")
    if repeated.limit(1).count():  # copies of one row: partial aggregates leave one a task
        same = named(marks[0]) == named(marks[1])
        once = left.join(repeated, same, "left_semi").dropDuplicates([marks[0]])
        left = left.join(repeated, same, "left_anti").unionByName(once)
    return left.drop(marks[0])


def _spare(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until docs has no such column."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out
