"""Ranked lexical search, exact, with trees of balls over sparse document vectors.

A document's vector holds, for each term of the queries, an integer that grows with
the term's occurrences and falls with the document's length; a query's holds the
integer weights of its terms; the score is their inner product. A task gathers its
documents in bounded blocks and splits each, by which of two far documents is
nearer, down to leaves. Every node
knows the centroid of its vectors and the radius of the ball around it that holds
them all, so no score below it can exceed

    query . centroid + |query| * radius.

That bound is taken in doubles and rounded up past any error they can have. Nodes are
opened best bound first until the bound falls under the least score that still ranks;
leaves are scored in 64-bit integers. Documents found so far, in the blocks before or
in a sample that is searched first, set that least score; they change the speed only.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.decontaminate import words_of
from quarry.llm.tables import named, schema_of, slices
from quarry.session import materialize

TOP = 10
LEAF = 32
#: A part with less than this share of its node's rows gives way to halves.
LOPSIDED = 16
BLOCK_DOCS = 8_192
BLOCK_CELLS = 1_000_000
BLOCK_WORDS = 200_000
SAMPLE_DOCS = 4_000
#: Relative error that doubles may have in sums of as many terms as a query holds.
SLACK = 1e-9


class BallTree:
    """Balls over the rows of a sparse matrix of non-negative integers.

    begins, cols, vals: the rows, in the order of the tree; order: their places in the
    given order. Nodes: low, high (their rows), kids (-1: leaf), radius; terms, nodes
    and means: the centroids, by term.
    """

    def __init__(self, counts: np.ndarray, cols: np.ndarray, vals: np.ndarray, leaf: int = LEAF):
        n = len(counts)
        self.terms, local = np.unique(cols, return_inverse=True)
        width = max(1, len(self.terms))
        begins = np.concatenate([[0], np.cumsum(counts)])
        real = vals.astype(float)
        square = _row_sums(real * real, begins, np.arange(n))
        self.low, self.high, self.kids, self.radius = [], [], [], []
        order = np.arange(n)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        work = [(0, n, -1)]
        while work:
            low, high, parent = work.pop()
            node = len(self.low)
            if parent >= 0:
                self.kids[parent].append(node)
            rows = order[low:high]
            at, lengths = _cells(begins, rows)
            c, v = local[at], real[at]
            ends = np.concatenate([[0], np.cumsum(lengths)])
            mean = np.bincount(c, v, width) / max(1, len(rows))
            used = np.flatnonzero(mean)
            held.append((used, mean[used]))
            norm = float(mean @ mean)
            away = square[rows] - 2 * _sums(v * mean[c], ends) + norm
            away = np.maximum(away, 0) + SLACK * (square[rows] + norm)  # never too small
            self.low.append(low), self.high.append(high), self.kids.append([])
            self.radius.append(math.sqrt(away.max(initial=0.0)) * (1 + SLACK))
            if len(rows) > leaf:
                a = self._gaps(rows[away.argmax()], begins, local, real, square, rows, c, v, ends, width)
                b = self._gaps(rows[a.argmax()], begins, local, real, square, rows, c, v, ends, width)
                nearer = np.argsort(a - b, kind="stable")
                order[low:high] = rows[nearer]
                middle = int((a < b).sum())
                if not len(rows) // LOPSIDED < middle < len(rows) - len(rows) // LOPSIDED:
                    middle = len(rows) // 2  # keeps the depth bounded
                work += [(low + middle, high, node), (low, low + middle, node)]
        self.order = order
        at, lengths = _cells(begins, order)
        self.begins, self.cols, self.vals = np.concatenate([[0], np.cumsum(lengths)]), local[at], vals[at]
        sizes = [len(t) for t, _ in held]
        term = np.concatenate([t for t, _ in held])
        by_term = np.argsort(term, kind="stable")
        self.nodes = np.repeat(np.arange(len(held)), sizes)[by_term]
        self.means = np.concatenate([m for _, m in held])[by_term]
        self.first = np.searchsorted(term[by_term], np.arange(width + 1))

    @staticmethod
    def _gaps(pivot, begins, local, real, square, rows, c, v, ends, width) -> np.ndarray:
        """Squared distances of the rows to one of them."""
        dense = np.zeros(width)
        own = slice(begins[pivot], begins[pivot + 1])
        dense[local[own]] = real[own]
        return square[rows] - 2 * _sums(v * dense[c], ends) + square[pivot]

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For every node a number that no score of its rows exceeds."""
        at, lengths = _cells(self.first, terms)
        dot = np.bincount(self.nodes[at], self.means[at] * np.repeat(weights.astype(float), lengths), len(self.low))
        norm = math.sqrt(float((weights.astype(float) ** 2).sum()))
        return np.ceil((dot + norm * np.array(self.radius)) * (1 + SLACK)) + 1

    def search(self, terms: np.ndarray, weights: np.ndarray, ids: list, best: list, k: int, least: int) -> list:
        """The k best (-score, id is null, id) of the rows and of best, of those with a
        score of at least least; terms are the tree's own numbers of the query's terms."""
        bound = self.bounds(terms, weights).tolist()
        of_term = np.zeros(max(1, len(self.terms)), np.int64)
        of_term[terms] = weights
        least = max(least, -best[-1][0] if len(best) == k else 1)
        open_ = [(-bound[0], 0)]
        while open_ and -open_[0][0] >= least:
            node = heapq.heappop(open_)[1]
            if self.kids[node]:
                for kid in self.kids[node]:
                    if bound[kid] >= least:
                        heapq.heappush(open_, (-bound[kid], kid))
                continue
            low, high = self.low[node], self.high[node]
            cells = slice(self.begins[low], self.begins[high])
            score = _sums(of_term[self.cols[cells]] * self.vals[cells], self.begins[low : high + 1] - self.begins[low])
            good = np.flatnonzero(score >= least)
            if len(good):
                got = [(-s, i is None, i if i is not None else 0) for s, i in zip(score[good].tolist(), (ids[x] for x in self.order[low + good].tolist()))]
                best = heapq.nsmallest(k, [*best, *got])
                if len(best) == k:
                    least = max(least, -best[-1][0])
        return best


def _cells(begins: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the cells of the rows, one row after the other, and their numbers."""
    lengths = begins[rows + 1] - begins[rows]
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[rows] - (ends - lengths), lengths), lengths


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the stretches between ends; an empty stretch sums to 0."""
    out = np.zeros(len(ends) - 1, values.dtype)
    filled = np.flatnonzero(ends[1:] > ends[:-1])
    if len(filled):
        out[filled] = np.add.reduceat(values, ends[:-1][filled])
    return out


def _row_sums(values: np.ndarray, begins: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return _sums(values, begins)[rows]


def weights_of(df: dict[int, int], n_docs: int) -> dict[int, int]:
    """Integer weights of terms that so many of n_docs documents hold."""
    return {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}


def _occurrences(docs: DataFrame, vocabulary) -> DataFrame:
    """(id, n, terms, tf): of every document its terms and how often each query term occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for whole in batches:
            for batch in slices(whole, "__text"):
                words = [words_of(t) for t in batch.column("__text").to_pylist()]
                n = np.array([len(w) for w in words], np.int64)
                term = np.fromiter((number.get(x, -1) for w in words for x in w), np.int64, int(n.sum()))
                key = (np.repeat(np.arange(len(words)), n) * max(1, len(number)) + term)[term >= 0]
                key, tf = np.unique(key, return_counts=True)
                doc, term = np.divmod(key, max(1, len(number)))
                ends = pa.array(np.searchsorted(doc, np.arange(len(words) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], names=["__id", "n", "terms", "tf"])

    ints = T.ArrayType(T.IntegerType())
    return docs.mapInArrow(count, schema_of(docs, "__id", n=T.LongType(), terms=ints, tf=ints))


def _searched(found: DataFrame, queries, k: int) -> DataFrame:
    """(item, __id, score): the k best documents of each task for each query.

    queries: (terms, weights) by item, number of documents, of terms, and the least
    score that may rank, by item.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        held, docs, cells = [], 0, 0
        for batch in batches:
            at = 0
            ends = batch.column("terms").offsets.to_numpy()
            while at < batch.num_rows:
                room = int(np.searchsorted(ends, ends[at] + BLOCK_CELLS - cells, side="right")) - 1
                to = max(at + (not held), min(batch.num_rows, at + BLOCK_DOCS - docs, room))
                held.append(batch.slice(at, to - at))
                docs, cells, at = docs + to - at, cells + int(ends[to] - ends[at]), to
                if at < batch.num_rows or docs >= BLOCK_DOCS:
                    yield held
                    held, docs, cells = [], 0, 0
        if held:
            yield held

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, n_docs, n_terms, least = queries.value
        best: list[list] = [[] for _ in items]
        kind = None
        for held in blocks(batches):
            kind = held[0].column("__id").type
            ids = [i for b in held for i in b.column("__id").to_pylist()]
            n = np.concatenate([b.column("n").to_numpy() for b in held])
            cols = np.concatenate([b.column("terms").flatten().to_numpy() for b in held])
            tf = np.concatenate([b.column("tf").flatten().to_numpy() for b in held]).astype(np.int64)
            counts = np.concatenate([b.column("terms").value_lengths().to_numpy() for b in held])
            m = 100 - 90 + (90 * n * n_docs) // max(1, n_terms)
            vals = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, counts))
            tree = BallTree(counts, cols, vals)
            for i, (terms, weights) in enumerate(items):
                at = np.minimum(np.searchsorted(tree.terms, terms), max(0, len(tree.terms) - 1))
                here = tree.terms[at] == terms if len(tree.terms) else np.zeros(len(terms), bool)
                if here.any():
                    best[i] = tree.search(at[here], weights[here], ids, best[i], k, least[i])
        rows = [(i, None if x[1] else x[2], -x[0]) for i, found in enumerate(best) for x in found]
        if rows:
            item, doc, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, kind), pa.array(score, pa.int64())], names=["item", "__id", "score"])

    schema = T.StructType([T.StructField("item", T.IntegerType()), found.schema["__id"], T.StructField("score", T.LongType())])
    return found.mapInArrow(search, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("__id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block_ranked(docs: DataFrame, given: list[tuple[object, str]], k: int, sample: int) -> DataFrame:
    """(item, rank, id, score) for one block of items."""
    spark = docs.sparkSession
    number: dict[bytes, int] = {}
    terms = [np.unique([number.setdefault(w, len(number)) for w in words_of(t)]).astype(np.int64) for _, t in given]
    vocabulary = spark.sparkContext.broadcast(number)
    found = materialize(_occurrences(docs, vocabulary), "occurrences")
    n_docs, n_terms = found.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r["t"]: r["d"] for r in found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("d")).collect()}
    weight = weights_of(df, n_docs)
    items = [(t, np.array([weight[x] for x in t.tolist()], np.int64)) for t in (np.array([x for x in t.tolist() if x in weight], np.int64) for t in terms)]
    with_terms = found.where("size(terms) > 0")

    def search(rows: DataFrame, least: list[int]) -> DataFrame:
        return _searched(rows, spark.sparkContext.broadcast((items, n_docs, n_terms, least)), k)

    least = [1] * len(items)
    share = sample / max(1, n_docs)
    if share < 1:
        part = with_terms.where(F.pmod(F.xxhash64("__id", "n", "terms"), F.lit(1 << 30)) < int(share * (1 << 30)))
        for r in _ranked(search(part, least), k).where(F.col("rank") == k).select("item", "score").collect():
            least[r["item"]] = r["score"]
    return _ranked(search(with_terms, least), k)


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    *,
    k: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = BLOCK_WORDS,
    sample: int = SAMPLE_DOCS,
) -> DataFrame:
    """The k documents with the highest scores above 0 for every item: item_col, rank
    (int, from 1), id_col, score (long). Equal scores go by ascending id, null last.

    Terms are runs of digits, letters a-z and non-ASCII characters of the whole text,
    A-Z lower-cased. With N documents that have a term and L terms in all, a term held
    by df of them weighs floor(1000 ln((2N + 2) / (2df + 1))); a document of n terms
    has m = 10 + 90nN div L; its score sums weight * (10^9 tf div (1000 tf + 8m)) over
    the item's terms, once each.

    Null and empty texts have no terms; items without terms, and empty tables, give no
    rows. Repeated rows of docs are documents of their own; repeated rows of items are
    ranked each. No other column is read. Items are taken in blocks of about
    block_words words, each with its own pass over the texts; the counts of one pass
    are written to the shared folder. `sample` documents are searched first: the least
    of their k best bounds what can rank, so results do not depend on them.
    """
    spark = docs.sparkSession
    narrow = docs.select(named(id_col).alias("__id"), named(text_col).cast("string").alias("__text"))
    given = items.select(named(item_col).alias("__item"), named(item_text_col).cast("string").alias("__text")).where("__text is not null")
    size = given.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // (6 * block_words)))
    of_block = T.StructType([T.StructField("item", T.IntegerType()), T.StructField(item_col, items.schema[item_col].dataType)])
    out = None
    for b in range(blocks):  # one block of items at a time is in the driver
        rows = [(r[0], r[1]) for r in given.where(F.pmod(F.xxhash64("__text"), F.lit(blocks)) == b).collect()]
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], of_block)
        ranked = _block_ranked(narrow, rows, k, sample)
        ranked = ranked.join(F.broadcast(names), "item").select(named(item_col), "rank", F.col("__id").alias(id_col), "score")
        if blocks > 1:
            ranked = materialize(ranked, "ranked")
        out = ranked if out is None else out.unionByName(ranked)
    return out
