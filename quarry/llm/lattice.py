"""Embedding near-duplicates by lattice hashing.

Each table projects a unit vector at random to several times eight dimensions and
decodes every eight of them to the nearest point of the E8 lattice; the points
together name the cell. A vector is entered in its own cell and looked up in the
cells where the nearest neighbouring lattice points stand in for its own. Vectors
that meet and whose sign sketches agree well enough are compared in double
precision. The number of points to a cell follows the number of vectors, so cells
do not fill up as the table grows, and the number of tables follows from both (see
`plan`).

Crowded cells, as many near copies of one vector make them, are multiplied out
block by block on eight-bit copies with a bounded error; of their links a spanning
forest is kept, which keeps every connection. The clusters that all links form are
multiplied out in double precision for the exact links within them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.graph import connected_components
from quarry.llm.blocks import FEW_BLOCKS, by_unit, deal_blocks, forest
from quarry.llm.tables import named, schema_of
from quarry.session import materialize

COSINE = 0.9
PROBES = 2
WIDTH = 1.8
#: The chance, at least, that a pair just at the cosine meets.
MEET = 0.94
#: Vectors to one more lattice point in a cell's name, as a factor.
GROWTH = 200
SAMPLE = 20_000
CROWD = 32
SEED = 13
BLOCK = 768


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: (+-1, +-1) in two places, and halves with
    an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for m in range(256):
        v = np.array([0.5 if m >> k & 1 else -0.5 for k in range(8)])
        if (v < 0).sum() % 2 == 0:
            out.append(v)
    return np.array(out)


ROOTS = _roots()


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest points of whole numbers with an even sum: round, and where the sum
    is odd round the worst coordinate the other way."""
    near = np.rint(y)
    odd = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(y[odd] - near[odd]).argmax(1)
    near[odd, worst] += np.where(y[odd, worst] >= near[odd, worst], 1, -1)
    return near


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """Nearest points of E8: of D8 or of D8 moved by one half, whichever is nearer."""
    a, b = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def neighbours(off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of eight, the way from a lattice point to what it stands for: (gain,
    step) of four of its neighbours, the nearest one among them. A step is in
    halves, as int8; the greater the gain, the nearer the neighbour."""
    n = np.arange(len(off))
    size, sign = np.abs(off), np.where(off < 0, -1, 1).astype(np.int8)
    order = np.argsort(size, axis=1)
    steps, gains = np.zeros((len(off), 4, 8), np.int8), np.zeros((len(off), 4))
    for k, (i, j) in enumerate(((7, 6), (7, 5))):  # two whole steps along the longest axes
        for x in (order[:, i], order[:, j]):
            steps[n, k, x] = 2 * sign[n, x]
            gains[:, k] += size[n, x]
    odd = (sign < 0).sum(1) % 2 == 1  # half steps along all, with an even number of minus signs
    for k, turned in ((2, np.where(odd, 0, -1)), (3, np.where(odd, 1, -2))):
        steps[:, k] = sign
        gains[:, k] = size.sum(1) / 2
        for which in (0, 1):
            at = np.flatnonzero((turned == which) | (turned == -2))
            x = order[at, which]
            steps[at, k, x] *= -1
            gains[at, k] -= size[at, x]
    return gains, steps


def name_cells(y: np.ndarray, points: int, probes: int, salt: int) -> np.ndarray:
    """(vectors, 1 + probes) from projections (vectors, 8 * points): a number for the
    own cell and for each cell looked up, where one point is a neighbour instead."""
    n = len(y)
    flat = y.reshape(n * points, 8)
    own = nearest_e8(flat)
    gains, steps = neighbours(flat - own)
    best = np.argpartition(-gains.reshape(n, 4 * points), probes - 1, axis=1)[:, :probes] if probes else np.zeros((n, 0), int)
    codes = np.repeat(np.rint(own * 2).astype(np.int8).reshape(n, 1, points, 8), 1 + probes, axis=1)
    rows, which = np.arange(n)[:, None], np.arange(probes)[None, :] + 1
    codes[rows, which, best // 4] += steps.reshape(n, points, 4, 8)[rows, best // 4, best % 4]
    codes = np.ascontiguousarray(codes).view(np.uint64)[..., 0]
    out = np.full(codes.shape[:2], salt, np.uint64)
    for k in range(points):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + codes[:, :, k])
    return out.view(np.int64)


def cells(unit: np.ndarray, tables: int, points: int, probes: int, width: float, seed: int) -> np.ndarray:
    """(vectors, tables, 1 + probes): the cells of every table, the own one first."""
    n, dim = unit.shape
    out = np.zeros((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        axes = np.random.default_rng([seed, dim, t]).normal(size=(dim, 8 * points))
        out[:, t] = name_cells(unit @ axes / width, points, probes, dim * 100_003 + t)
    return out


def plan(vectors: int, cosine: float, probes: int, width: float, meet: float = MEET) -> tuple[int, int]:
    """(points, tables): lattice points to a cell's name for so many vectors, and the
    tables that bring a pair just at the cosine together with chance `meet`.

    Projections of unit vectors depend on nothing but their cosine, so the chance
    that one table does so is that of normal variables, taken from a seeded sample.
    """
    points = max(1, round(math.log(max(vectors, 2)) / math.log(GROWTH)))
    rng = np.random.default_rng(0)
    x, z = rng.normal(size=(2, SAMPLE, 8 * points))
    a, b = (name_cells(v / width, points, probes, 0) for v in (x, cosine * x + math.sqrt(1 - cosine**2) * z))
    met = (a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)
    return points, max(1, math.ceil(math.log(1 - meet) / math.log1p(-min(met.mean(), 1 - 1e-9))))


def sketches(unit: np.ndarray, seed: int) -> np.ndarray:
    """The signs of 64 random projections of every vector, as the bits of a number."""
    axes = np.random.default_rng([seed, unit.shape[1], 1 << 30]).normal(size=(unit.shape[1], 64))
    return np.packbits(unit @ axes > 0, axis=1).view(np.int64)[:, 0]


def most_apart(cosine: float) -> int:
    """Bits in which the sketches of a pair at the cosine differ at most, up to 4.5
    deviations beyond the mean (about one pair in 20,000 differs in more)."""
    p = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return math.floor(64 * p + 4.5 * math.sqrt(64 * p * (1 - p)))


def _unit(raw: bytes, kind: str) -> np.ndarray:
    """A usable vector as doubles of length one."""
    x = np.frombuffer(raw, kind).astype(float)
    x = x / np.abs(x).max()
    return x / np.sqrt(x @ x)


def _units(raw: list[bytes], kind: str) -> np.ndarray:
    """Usable vectors of one dimension as rows of length one."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(float)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """(__id, key, v), and what v holds: usable vectors as bytes of floats or doubles,
    as they were given; vectors of one direction share a key. Rows that are null,
    empty, zero or hold null or non-finite components have a null key."""
    given = vectors.schema[vector_col].dataType
    kind, element = ("f4", "float") if isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType) else ("f8", "double")
    narrow = vectors.select(named(id_col).alias("__id"), named(vector_col).cast(f"array<{element}>").alias("__v"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raw = [], []
            for v in batch.column(1):
                x = np.zeros(0) if v.values is None or v.values.null_count else v.values.to_numpy(zero_copy_only=False)
                x = x.astype(kind).tobytes() if len(x) and np.isfinite(x).all() and x.any() else None
                keys.append(None if x is None else xxhash.xxh3_64_intdigest(_unit(x, kind).tobytes()) - (1 << 63))
                raw.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(raw, pa.binary())], names=["__id", "key", "v"])

    return narrow.mapInArrow(build, schema_of(narrow, "__id", key=T.LongType(), v=T.BinaryType())), kind


def _visits(nodes: DataFrame, kind: str, tables: int, points: int, probes: int, width: float, seed: int) -> DataFrame:
    """(cell, probe, key, sketch): the own cells (probe = 0) and the looked-up ones of
    each distinct vector."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raw = batch.column("key").to_numpy(), batch.column("v").to_pylist()
            sizes = np.array([len(r) for r in raw])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                for part in np.array_split(at, -(-len(at) // 2000)):
                    unit = _units([raw[i] for i in part], kind)
                    found = cells(unit, tables, points, probes, width, seed).reshape(len(part), -1)
                    m = found.shape[1]
                    probe = np.tile(np.arange(m) % (1 + probes) > 0, len(part))
                    columns = (found.ravel(), probe.astype(np.int8), np.repeat(keys[part], m), np.repeat(sketches(unit, seed), m))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "probe", "key", "sketch"])

    return nodes.select("key", "v").mapInArrow(visit, "cell long, probe tinyint, key long, sketch long")


def _met(visits: DataFrame, apart: int, crowd: int) -> DataFrame:
    """Pairs (a, b) of vectors that meet in a cell, at least one as its owner, and
    whose sketches differ in `apart` bits at most; of cells with more than `crowd`
    visits instead every visit, as (a, cell) with b null.

    Visits stream through in order of cells; no more than one small cell and one
    batch are held.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_cell = np.zeros((0, 4), np.int64), None
        for batch in chain(batches, [None]):
            rows = held
            if batch is not None:
                rows = np.concatenate([held, np.column_stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)])])
            if not len(rows):
                continue
            begins = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
            lengths = np.diff(begins, append=len(rows))
            crowded = lengths > crowd
            crowded[0] |= open_cell is not None and rows[0, 0] == open_cell
            held, open_cell = rows[:0], None
            if batch is not None:  # the last cell may go on
                if crowded[-1]:
                    open_cell = rows[-1, 0]
                else:
                    held = rows[begins[-1] :]
                    begins, lengths, crowded = begins[:-1], lengths[:-1], crowded[:-1]
            many = np.repeat(crowded, lengths)
            members = rows[: len(many)][many]
            pairs = [np.zeros((0, 2), np.int64)]
            for k in np.unique(lengths[~crowded]):
                i, j = np.triu_indices(int(k), 1)
                at = begins[~crowded & (lengths == k)][:, None]
                x, y = rows[(at + i).ravel()], rows[(at + j).ravel()]
                near = ((x[:, 1] == 0) | (y[:, 1] == 0)) & (x[:, 2] != y[:, 2])
                near &= np.bitwise_count((x[:, 3] ^ y[:, 3]).view(np.uint64)) <= apart
                pairs.append(np.sort(np.column_stack([x[near, 2], y[near, 2]]), axis=1))
            pairs = np.unique(np.concatenate(pairs), axis=0)
            if len(pairs) or len(members):
                no = [pa.nulls(n, pa.int64()) for n in (len(members), len(pairs))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([pairs[:, 0], members[:, 2]])),
                        pa.concat_arrays([pa.array(pairs[:, 1]), no[0]]),
                        pa.concat_arrays([no[1], pa.array(members[:, 0])]),
                    ],
                    names=["a", "b", "cell"],
                )

    ordered = visits.repartition("cell").sortWithinPartitions("cell", "probe")
    return ordered.mapInArrow(meet, "a long, b long, cell long")


def _short(nodes: DataFrame, kind: str) -> DataFrame:
    """(key, q, scale, error): eight-bit copies and the length of what they miss."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, scale, error = [], [], []
            for r in batch.column("v").to_pylist():
                v = _unit(r, kind)
                s = np.abs(v).max() / 127
                x = np.rint(v / s).astype(np.int8)
                q.append(x.tobytes()), scale.append(s), error.append(float(np.linalg.norm(v - x * s)) + 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(q, pa.binary()), pa.array(scale, pa.float32()), pa.array(error, pa.float32())], names=["key", "q", "scale", "error"])

    return nodes.select("key", "v").mapInArrow(cut, "key long, q binary, scale float, error float")


def _block_links(work: DataFrame, cosine: float) -> DataFrame:
    """(a, b, sure): links and pairs too near the bound to tell, of every unit."""

    def run(group: pa.Table) -> pa.Table:
        unit, side, keys, scale, error = (group.column(c).to_numpy() for c in ("unit", "side", "key", "scale", "error"))
        raw = group.column("q").to_pylist()
        a, b, sure = [], [], []
        for at in by_unit(unit):
            if len({len(raw[x]) for x in at}) > 1:
                continue  # the cells of different dimensions differ
            x = np.array([np.frombuffer(raw[i], np.int8) for i in at]).astype(np.float32) * scale[at][:, None]
            e, own = error[at].astype(float), side[at][0] == 2
            left = np.flatnonzero(side[at] != 1)
            right = left if own else np.flatnonzero(side[at] == 1)
            dots = (x[left] @ x[right].T).astype(float)
            # |xy - (x+e)(y+f)| <= |f| |x+e| + |e| |y+f| + |e| |f|, and x+e, y+f have length 1
            slack = e[left][:, None] + e[right][None, :] + e[left][:, None] * e[right][None, :] + 1e-5
            i, j = np.nonzero(dots + slack >= cosine)
            certain = dots[i, j] - slack[i, j] >= cosine
            i, j = left[i], right[j]
            order = i < j if own else i != j
            i, j, certain = i[order], j[order], certain[order]
            kept = forest(i[certain], j[certain], len(at))
            for u, v, s in ((i[certain][kept], j[certain][kept], True), (i[~certain], j[~certain], False)):
                a.append(keys[at][u]), b.append(keys[at][v]), sure.append(np.full(len(u), s))
        cat = lambda parts, kind: np.concatenate([*parts, np.zeros(0, kind)]).astype(kind)
        return pa.table({"a": cat(a, np.int64), "b": cat(b, np.int64), "sure": cat(sure, bool)})

    return work.groupBy("task").applyInArrow(run, "a long, b long, sure boolean")


def _verified(pairs: DataFrame, nodes: DataFrame, kind: str, cosine: float) -> DataFrame:
    """Those of the pairs (a, b) that reach the cosine in double precision."""
    va, vb = (nodes.select(F.col("key").alias(c), F.col("v").alias(f"v{c}")) for c in "ab")
    both = pairs.distinct().join(va, "a").join(vb, "b").select("a", "b", "va", "vb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(i).to_pylist() for i in (2, 3))
            ok = [len(r) == len(s) and float(_unit(r, kind) @ _unit(s, kind)) >= cosine for r, s in zip(x, y)]
            at = pa.array(np.flatnonzero(ok), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    return both.mapInArrow(check, "a long, b long")


def _counted(work: DataFrame, kind: str, cosine: float) -> DataFrame:
    """(key, links): links of each vector to the rows (copies counted) of others,
    by task; a pair is in one task only."""

    def run(group: pa.Table) -> pa.Table:
        unit, side, keys, copies = (group.column(c).to_numpy() for c in ("unit", "side", "key", "copies"))
        raw = group.column("v").to_pylist()
        out_keys, out = [keys[:0]], [copies[:0]]
        for at in by_unit(unit):
            sizes = np.array([len(raw[i]) for i in at])
            for size in np.unique(sizes):
                here = at[sizes == size]
                x = _units([raw[i] for i in here], kind)
                own = side[here][0] == 2
                left = np.flatnonzero(side[here] != 1)
                right = left if own else np.flatnonzero(side[here] == 1)
                hit = x[left] @ x[right].T >= cosine
                if own:
                    np.fill_diagonal(hit, False)
                n = copies[here]
                out_keys.append(keys[here][left]), out.append(hit @ n[right])
                if not own:
                    out_keys.append(keys[here][right]), out.append(n[left] @ hit)
        return pa.table({"key": np.concatenate(out_keys), "links": np.concatenate(out).astype(np.int64)})

    return work.groupBy("task").applyInArrow(run, "key long, links long")


def _crowd_links(visits: DataFrame, nodes: DataFrame, kind: str, cosine: float, block: int) -> DataFrame:
    """Links of crowded cells (key, cluster): a forest of all links of each."""
    short = _short(nodes, kind)
    visits = visits.withColumn("n", F.lit(1))
    sums = visits.groupBy("cluster").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    visits = visits.join(sums, "cluster").withColumn("large", F.col("members") > FEW_BLOCKS * block)
    pivot = F.pmod(F.xxhash64("key", F.lit(2)), F.col("members")) < block // 2
    kinds = visits.withColumn("kind", F.when(~F.col("large"), "l").when(pivot, "p").otherwise("m"))

    def links_of(kinds: DataFrame) -> DataFrame:
        work = deal_blocks(kinds.select("key", "cluster", "n", "kind"), block).join(short, "key")
        met = materialize(_block_links(work, cosine), "met")
        near = _verified(met.where("not sure").select("a", "b"), nodes, kind, cosine)
        return materialize(met.where("sure").select("a", "b").union(near), "links")

    links = links_of(kinds)
    large = visits.where("large")
    if large.limit(1).count():  # what has not met the main component of its cell meets all
        parts = connected_components(links).withColumnsRenamed({"node": "key", "component": "part"})
        placed = materialize(large.join(parts, "key", "left").withColumn("part", F.coalesce("part", "key")), "placed")
        main = placed.groupBy("cluster", "part").count().groupBy("cluster").agg(F.max_by("part", F.struct("count", "part")).alias("main"))
        again = placed.join(main, "cluster").withColumn("kind", F.when(F.col("part") == F.col("main"), "m").otherwise("l"))
        left = again.where("kind = 'l'").select("cluster").distinct()
        links = links.union(links_of(again.join(left, "cluster", "left_semi")))
    return links


def lattice_duplicates(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = COSINE,
    probes: int = PROBES,
    width: float = WIDTH,
    seed: int = SEED,
    block: int = BLOCK,
    crowd: int = CROWD,
) -> DataFrame:
    """id_col, n_links, component_id and kept (id = component_id) for every row.

    Rows link when the cosine of their vectors, in double precision, reaches
    `cosine`; n_links counts the other rows linked directly, component_id is the
    smallest id that links reach, the row's own included. No pair below the cosine
    links; pairs that no table brings together, directly or through others, are
    missed (see the README for recall). Equal vectors are one node and cost no
    pairs. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing; vectors of different lengths do not link. Rows
    with a null id have a null component_id and kept; repeated rows each count as
    a row. An empty table gives an empty result; no other column is read.
    """
    rows, kind = _usable_vectors(vectors, id_col, vector_col)
    rows = materialize(rows, "vectors")
    usable = rows.where("key is not null")
    nodes = usable.groupBy("key").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("__id").alias("least"))
    nodes = materialize(nodes, "nodes")

    points, tables = plan(nodes.count(), cosine, probes, width)
    met = materialize(_met(_visits(nodes, kind, tables, points, probes, width, seed), most_apart(cosine), crowd), "met")
    links = materialize(_verified(met.where("b is not null").select("a", "b"), nodes, kind, cosine), "links")
    crowds = met.where("b is null").select(F.col("a").alias("key"), F.col("cell").alias("cluster")).distinct()
    if crowds.limit(1).count():
        links = links.union(_crowd_links(materialize(crowds, "crowds"), nodes, kind, cosine, block))

    found = materialize(connected_components(links).withColumnsRenamed({"node": "key", "component": "cluster"}), "clusters")
    members = found.withColumns({"n": F.lit(1), "kind": F.lit("l")})
    work = deal_blocks(members, block).join(nodes.select("key", "v", "copies"), "key")
    counts = _counted(work, kind, cosine).groupBy("key").agg(F.sum("links").alias("links"))

    rooted = nodes.select("key", "copies", "least").join(found, "key", "left").withColumn("cluster", F.coalesce("cluster", "key"))
    roots = rooted.groupBy("cluster").agg(F.min("least").alias("component_id"))
    known = rooted.join(roots, "cluster").join(counts, "key", "left")
    known = known.select("key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    unusable = rows.where("key is null").select("__id", F.lit(0).cast("long").alias("n_links"), F.col("__id").alias("component_id"))
    out = usable.select("__id", "key").join(known, "key").select("__id", "n_links", "component_id").union(unusable)
    component = F.when(F.col("__id").isNotNull(), F.col("component_id"))
    out = out.select(F.col("__id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", named(id_col) == F.col("component_id"))
