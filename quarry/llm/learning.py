"""Bounded labelled samples for the trained operators."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.tables import named, schema_of, slices


def one_text_each(texts: DataFrame, chosen: DataFrame, key: str, *also: str) -> DataFrame:
    """Rows (key, __text, ...) whose key is among the chosen ones, whose number is
    bounded; of each key those with one text (and one value of the columns `also`),
    the one of the smallest hash."""
    hashed = texts.withColumn("__hash", F.xxhash64("__text", *also))
    least = hashed.join(F.broadcast(chosen.select(key)), key).groupBy(key).agg(F.min("__hash").alias("__hash"))
    return hashed.join(F.broadcast(chosen.join(least, key)), [key, "__hash"])


def first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with the first row only of each value of their first column."""
    seen = set()
    for batch in batches:
        keys = batch.column(0).to_pylist()
        first = [k not in seen and not seen.add(k) for k in keys]
        yield batch if all(first) else batch.filter(pa.array(first, pa.bool_()))


def fit_on_sample(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    label_cols: list[str],
    featurize: Callable[[str | None], np.ndarray],
    fit: Callable[[list[np.ndarray], np.ndarray], object],
    *,
    id_col: str,
    text_col: str,
    most: int,
    seed: int = 5,
):
    """fit(features, labels) in one task, over about `most` labelled documents at
    most, chosen by a seeded hash of the id and ordered by id. labels has a column
    for each of label_cols, nan where null.

    The chosen labels, bounded by `most`, are broadcast, so no text is shuffled;
    their features meet in one task of bounded size, and the model alone comes to
    the driver. An id with several label rows counts with the smallest of each, one
    with several documents with the text of the smallest hash, once.
    """
    ident = named(id_col)
    marks = [F.min(named(c)).cast("double").alias(f"__y{i}") for i, c in enumerate(label_cols)]
    known = labels.where(usable & ident.isNotNull()).groupBy(ident.alias("__id")).agg(*marks)
    total = known.count()
    share = min(1.0, most / max(1, total))
    part = F.pmod(F.xxhash64("__id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))
    chosen = known.where(part)
    texts = docs.select(ident.alias("__id"), named(text_col).cast("string").alias("__text"))
    names = [f"__y{i}" for i in range(len(label_cols))]
    rows = one_text_each(texts, chosen, "__id").select("__id", "__text", *names)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in first_of_each(batches):
            for batch in slices(whole, "__text"):
                found = [featurize(t).astype(np.int32).tobytes() for t in batch.column("__text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), *(batch.column(n) for n in names)], names=["__id", "x", *names])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for batch in first_of_each(batches) for r in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))]
        got.sort(key=lambda r: (r[0], r[1]))
        y = np.array([[np.nan if v is None else v for v in r[2:]] for r in got], float).reshape(len(got), len(names))
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(fit([np.frombuffer(r[1], np.int32) for r in got], y))]})

    schema = schema_of(rows, "__id", x=T.BinaryType(), **{n: T.DoubleType() for n in names})
    found = rows.mapInArrow(extract, schema).repartition(1).mapInArrow(train, "model binary").collect()
    return pickle.loads(found[0][0]) if found else fit([], np.zeros((0, len(names))))


def folds_of(n: int, folds: int, seed: int = 3) -> np.ndarray:
    """A fold for each of n rows, in a seeded order, of nearly equal sizes."""
    return np.random.default_rng(seed).permutation(np.arange(n) % folds)


def score_texts(
    docs: DataFrame,
    model,
    margins: Callable[[object, str | None], list[float]],
    names: list[str],
    *,
    id_col: str,
    text_col: str,
    keep: list[str] | None = None,
) -> DataFrame:
    """id_col, the columns in keep, and one double for each name, from a
    broadcast model of fixed size applied to every whole text where it lies."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [named(c) for c in keep or []]
    narrow = docs.select(named(id_col).alias("__id"), named(text_col).cast("string").alias("__text"), F.struct(*kept, F.lit(0).alias("__nothing")).alias("__row"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in slices(whole, "__text"):
                found = np.array([margins(m, t) for t in batch.column("__text").to_pylist()], float).reshape(-1, len(names))
                cols = [pa.array(found[:, i]) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *cols], names=["__id", "__row", *(f"__s{i}" for i in range(len(names)))])

    scored = narrow.mapInArrow(score, schema_of(narrow, "__id", "__row", **{f"__s{i}": T.DoubleType() for i in range(len(names))}))
    return scored.select(F.col("__id").alias(id_col), *[F.col("__row").getField(c).alias(c) for c in keep or []], *[F.col(f"__s{i}").alias(n) for i, n in enumerate(names)])
