"""Quality classifier: support vectors on naive Bayes features.

Indicators of word and shape n-grams are scaled by their class log-count ratios,
and a linear hinge-loss model is fitted to them by dual coordinate descent. A
sigmoid fitted to out-of-fold margins turns a margin into a probability.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import learning, linear
from quarry.llm.features import BITS, indicators
from quarry.llm.tables import is_held_out, named

MAX_TRAIN = 8_000
THRESHOLD = 0.3


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    usable: Column | None = None,
    max_train: int = MAX_TRAIN,
    cost: float = 0.01,
) -> dict:
    """Fit on about max_train labelled rows at most, those that are not held out.

    The model is an array of 2**BITS weights, a bias and the sigmoid. Without
    labels of both classes every text scores the share of label 1 (0.5 without
    any label). Rows with a null label or id are not used.
    """
    usable = ~is_held_out(id_col) if usable is None else usable
    return learning.fit_on_sample(
        docs, labels, usable & named(label_col).isNotNull(), [label_col], indicators, lambda rows, y: fit_sample(rows, y[:, 0] > 0, cost), id_col=id_col, text_col=text_col, most=max_train
    )


def fit_sample(rows: list[np.ndarray], good: np.ndarray, cost: float = 0.01, folds: int = 3) -> dict:
    size = 1 << BITS
    if good.all() or not good.any():
        share = float(good.mean()) if len(good) else 0.5
        return {"w": np.zeros(size, np.float32), "bias": 0.0, "slope": 0.0, "offset": float(np.log((share + 1e-3) / (1 - share + 1e-3)))}
    y = np.where(good, 1, -1)

    def fit(at: np.ndarray) -> tuple[np.ndarray, float]:
        part = [rows[i] for i in at]
        return linear.fit_hinge(part, linear.log_count_ratios(part, y[at], size), y[at], cost)

    fold, margins = learning.folds_of(len(rows), folds), np.zeros(len(rows))
    for k in range(folds):
        w, bias = fit(np.flatnonzero(fold != k))
        for i in np.flatnonzero(fold == k):
            margins[i] = w[rows[i]].sum() + bias
    slope, offset = linear.fit_platt(margins, good.astype(float))
    w, bias = fit(np.arange(len(rows)))
    return {"w": w.astype(np.float32), "bias": bias, "slope": max(slope, 0.0), "offset": offset}


def probability(model: dict, text: str | None) -> list[float]:
    margin = float(model["w"][indicators(text)].sum(dtype=np.float64)) + model["bias"]
    return [float(linear.sigmoid(model["slope"] * margin + model["offset"]))]


def score_quality(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id_col, score (0 to 1) and predicted (1 if score >= threshold, else 0) for
    every row. Null, empty and blank texts score by the bias alone; repeated rows
    each get a row; no other column is read."""
    scored = learning.score_texts(docs, model, probability, ["score"], id_col=id_col, text_col=text_col)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: dict, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score threshold or more."""
    spare = "__score"
    while spare in docs.columns:
        spare = f"_{spare}"
    scored = learning.score_texts(docs, model, probability, [spare], id_col=text_col, text_col=text_col, keep=[c for c in docs.columns if c != text_col])
    return scored.where(F.col(spare) >= threshold).select(*[named(c) for c in docs.columns])
