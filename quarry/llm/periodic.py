"""Runs of repeated words in a text, by suffix trees.

A run is a stretch of words with smallest period q, at least twice q and at least
LEAST words long, that no neighbouring word extends. Every run holds a Lyndon root:
the longest Lyndon word that starts at some word, in one of two opposite orders of
the alphabet. So each such word is a candidate (place, period), and is extended to
the right and to the left as far as the period lasts. Both lengths are longest common
extensions: depths of lowest common ancestors in the suffix trees (Ukkonen) of the
words and of their reversal, answered as range minima of the trees' Euler tours.

Every word of a run lies in a stretch of GRAM words that comes twice in that run:
with a period of GRAM or more each stretch of the first period comes again in the
second, and a shorter period leaves stretches at both ends that cover the run. So
trees are built of the parts of a document whose words all lie in such stretches;
no run crosses the end of a part, and no run is lost.

Work and memory are linear in the longest part of a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.tables import named, schema_of, slices

LEAST = 12
GRAM = 6
_SEEDS = np.random.default_rng(17).integers(1, 1 << 62, GRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

Edit = Callable[[object, list[bytes]], list[bytes]]


class SuffixTree:
    """Ukkonen's suffix tree of a list of symbols >= 1, closed by the symbol 0.

    child: node * width + symbol -> node; begin, end: the symbols of the edge to each
    node; leaf: the leaf of each suffix.
    """

    def __init__(self, symbols: list[int]):
        s = self.symbols = [*symbols, 0]
        n, width = len(s), max(s) + 1
        self.width = width
        child: dict[int, int] = {}
        begin, end, link, leaf = [0], [0], [0], [0] * n
        node = edge = length = pending = 0
        for i, c in enumerate(s):
            made = 0
            pending += 1
            while pending:
                if not length:
                    edge = i
                key = node * width + s[edge]
                to = child.get(key)
                if to is None:
                    leaf[i - pending + 1] = child[key] = len(begin)
                    begin.append(i), end.append(n), link.append(0)
                    if made:
                        link[made], made = node, 0
                else:
                    size = end[to] - begin[to]
                    if length >= size:
                        node, edge, length = to, edge + size, length - size
                        continue
                    at = begin[to] + length
                    if s[at] == c:
                        length += 1
                        if made:
                            link[made] = node
                        break
                    split = child[key] = len(begin)
                    begin += (begin[to], i)
                    end += (at, n)
                    link += (0, 0)
                    begin[to] = at
                    child[split * width + s[at]] = to
                    leaf[i - pending + 1] = child[split * width + c] = split + 1
                    if made:
                        link[made] = split
                    made = split
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - pending + 1
        self.child, self.begin, self.end, self.leaf = child, begin, end, leaf
        kids: list[list[int]] = [[] for _ in begin]
        for key in sorted(child):
            kids[key // width].append(child[key])
        self.kids = kids

    def euler_tour(self) -> tuple[np.ndarray, np.ndarray]:
        """Depths, in symbols, along the tour, and the place in it of each suffix."""
        begin, end, kids = self.begin, self.end, self.kids
        depth, first = [0] * len(begin), [0] * len(begin)
        tour, stack = [], [0]
        while stack:
            v = stack.pop()
            if v < 0:
                tour.append(depth[~v])
                continue
            first[v] = len(tour)
            d = depth[v]
            tour.append(d)
            for u in reversed(kids[v]):
                depth[u] = d + end[u] - begin[u]
                stack += (~v, u)
        return np.array(tour, np.int32), np.array(first, np.int64)[self.leaf]

    def ranks(self, backwards: bool = False) -> list[int]:
        """The rank of each suffix among all; with backwards, larger symbols come
        first. A suffix comes before those that it begins, in either order."""
        s, begin, kids = self.symbols, self.begin, self.kids
        order, stack = [], [0]
        while stack:
            v = stack.pop()
            below = kids[v]
            if not below:
                order.append(v)
            elif backwards:
                ends = s[begin[below[0]]] == 0
                stack += below[ends:]
                if ends:
                    stack.append(below[0])
            else:
                stack += below[::-1]
        place = [0] * len(begin)
        for r, v in enumerate(order):
            place[v] = r
        return [place[v] for v in self.leaf]


def lyndon_ends(rank: list[int]) -> list[int]:
    """For each place the end of the longest Lyndon word there: the next smaller suffix."""
    ends, open_ = [0] * len(rank), []
    for i, r in enumerate(rank):
        while open_ and rank[open_[-1]] > r:
            ends[open_.pop()] = i
        open_.append(i)
    return ends


def least_between(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value between the places a and b, both included, for each query.

    One level of the sparse table is kept at a time, so memory is linear.
    """
    low, high = np.minimum(a, b), np.maximum(a, b)
    level = np.frexp((high - low + 1).astype(float))[1] - 1
    out = np.zeros(len(a), values.dtype)
    now = values
    for k in range(int(level.max()) + 1 if len(level) else 0):
        if k:
            half = 1 << (k - 1)
            now = np.minimum(now[:-half], now[half:])
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(now[low[at]], now[high[at] - (1 << k) + 1])
    return out


def runs_of(parts: list[list[int]], least: int = LEAST) -> list[np.ndarray]:
    """Runs (start, length, period), sorted, of each list of symbols >= 1."""
    tours: tuple[list, list] = ([], [])
    firsts: tuple[list, list] = ([], [])
    shift = [0, 0]
    part_of, start, end, base = [], [], [], 0
    bases = []
    for k, symbols in enumerate(parts):
        forward, n = SuffixTree(symbols), len(symbols)
        for side, tree in enumerate((forward, SuffixTree(symbols[::-1]))):
            tour, first = tree.euler_tour()
            tours[side].append(tour)
            firsts[side].append(first + shift[side])
            shift[side] += len(tour)
        found = [lyndon_ends(forward.ranks(backwards)) for backwards in (False, True)]
        own = np.unique(np.hstack([[np.arange(n), f[:n]] for f in found]), axis=1)
        part_of.append(np.full(own.shape[1], k)), start.append(own[0]), end.append(own[1])
        bases.append(base)
        base += n + 1
    if not parts:
        return []
    tour = [np.concatenate(t) for t in tours]
    first = [np.concatenate(f) for f in firsts]
    part, i, j = np.concatenate(part_of), np.concatenate(start), np.concatenate(end)
    at, size = np.array(bases)[part], np.array([len(p) for p in parts])[part]
    period = j - i
    right = least_between(tour[0], first[0][at + i], first[0][at + j])
    # the place x of the words is n - 1 - x in the reversal; before the first there is nothing
    inner = i > 0
    left = np.zeros(len(i), np.int64)
    left[inner] = least_between(tour[1], first[1][(at + size - i)[inner]], first[1][(at + size - j)[inner]])
    begin, length = i - left, left + period + right
    good = (length >= 2 * period) & (length >= least)
    rows = np.unique(np.stack([part, begin, length, period])[:, good], axis=1)
    cuts = np.searchsorted(rows[0], np.arange(1, len(parts)))
    found = [x[1:].T for x in np.split(rows, cuts, axis=1)]
    return [x[np.lexsort((x[:, 2], x[:, 0]))] for x in found]


def repetitive_parts(ids: np.ndarray, doc: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that may lie in a run, and the part that each is in.

    ids: random 64-bit names of the words; doc: ascending numbers of their documents.
    Words outside repeated stretches part a document, until nothing more goes.
    """
    place, part = np.arange(len(ids)), doc.astype(np.uint64)
    gram = min(GRAM, least // 2)
    while len(place):
        n = len(place) - gram + 1
        if n <= 0:
            return place[:0], part[:0]
        h = part[:n] * np.uint64(0x9E3779B97F4A7C15)
        for k in range(gram):
            h += ids[place[k : n + k]] * _SEEDS[k]
        whole = np.flatnonzero(part[:n] == part[gram - 1 :])
        h = h[whole]
        ordered = np.sort(h)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(twice):
            return place[:0], part[:0]
        at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
        again = whole[twice[at] == h]
        step = np.zeros(len(place) + 1, np.int64)
        step[again] += 1
        step[again + gram] -= 1
        covered = np.cumsum(step[:-1]) > 0
        new = np.ones(len(place), bool)
        new[1:] = (part[1:] != part[:-1]) | (covered[1:] != covered[:-1])
        number = np.cumsum(new) - 1
        keep = covered & (np.bincount(number)[number] >= least)
        if keep.all():
            return place, number
        place, part = place[keep], number[keep].astype(np.uint64)
    return place, part


def runs_of_documents(words: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """Runs (start, length, period) of each document's words, by start, then period."""
    codes: dict[bytes, int] = {}
    flat = np.array([codes.setdefault(w, len(codes)) for doc in words for w in doc], np.int64)
    counts = np.array([len(w) for w in words], np.int64)
    doc, starts = np.repeat(np.arange(len(words)), counts), np.cumsum(counts) - counts
    names = np.random.default_rng(23).integers(1, 1 << 63, len(codes) + 1, dtype=np.uint64)
    place, part = repetitive_parts(names[flat], doc, least)
    out = [[] for _ in words]
    if len(place):
        cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
        parts, at = [], np.split(place, cuts)
        for x in at:
            local: dict[int, int] = {}
            parts.append([local.setdefault(c, len(local) + 1) for c in flat[x].tolist()])
        for x, found in zip(at, runs_of(parts, least)):
            d = doc[x[0]]
            if len(found):
                out[d].append(found + np.array([x[0] - starts[d], 0, 0]))
    return [np.concatenate(x) if x else np.zeros((0, 3), np.int64) for x in out]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words no run holds after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(step[:-1]) == 0


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, edit: Edit | None = None) -> DataFrame:
    """Find the runs of every whole text and collapse them to their first period.

    Words are what ASCII white space separates. Returns id_col, n_words, runs
    (array<struct<start, length, period>>, in words from 0, by start, then period) and
    collapsed (the words that no run holds after its first period, joined by one
    space). edit(id, words) may change the words before. A run has at least `least`
    words, and twice its period.

    Null and empty texts have no words, no runs and an empty collapsed text. Repeated
    rows and rows without an id each get a row; other columns are not read. One pass,
    nothing is shuffled.
    """
    narrow = docs.select(named(id_col).alias("__id"), named(text_col).cast("string").alias("__text"))
    of_runs = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                words = [t.encode().split() if t else [] for t in batch.column("__text").to_pylist()]
                if edit:
                    words = [edit(i, w) for i, w in zip(batch.column("__id").to_pylist(), words)]
                found = runs_of_documents(words, least)
                flat = np.concatenate(found)
                ends = np.cumsum([0, *map(len, found)])
                runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, k], pa.int64()) for k in range(3)], fields=list(of_runs.value_type)))
                left = [b" ".join(w if not len(r) else [x for x, k in zip(w, kept_words(len(w), r).tolist()) if k]).decode() for w, r in zip(words, found)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in words], pa.int64()), runs, pa.array(left, pa.string())], names=["__id", "__n", "__runs", "__left"])

    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    out = narrow.mapInArrow(find, schema_of(narrow, "__id", __n=T.LongType(), __runs=T.ArrayType(run), __left=T.StringType()))
    return out.select(F.col("__id").alias(id_col), F.col("__n").alias("n_words"), F.col("__runs").alias("runs"), F.col("__left").alias("collapsed"))
