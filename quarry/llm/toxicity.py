"""Toxicity by a classifier chain.

The categories have an order. Each has a linear (logistic) model over word
features and the probabilities of the categories before it. While training,
those probabilities are out-of-fold predictions, so that a later model sees
earlier ones as wrong as they will be on new texts; while scoring, they come from
the earlier models fitted to the whole sample.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import learning, linear
from quarry.llm.features import BITS, stem_indicators
from quarry.llm.tables import is_held_out

MAX_TRAIN = 8_000
THRESHOLD = 0.3


def fit_chain_sample(rows: list[np.ndarray], y: np.ndarray, l2: float = 3e-3, folds: int = 3, least: int = 3) -> list[dict]:
    """Models of the chain, in order. y: a column for each category, nan where
    the label is missing. Features of fewer than `least` rows are left out. A
    category without both classes predicts its share."""
    n, count = y.shape
    df = np.bincount(np.concatenate([*rows, np.zeros(0, np.int32)]), minlength=1 << BITS)
    rows = [r[df[r] >= least] for r in rows]
    fold = learning.folds_of(n, folds)
    earlier = np.zeros((n, 0))
    x = linear.Sparse(rows)
    models = []

    def fit(at: np.ndarray, target: np.ndarray) -> np.ndarray:
        part = [rows[i] for i in at]
        scale = linear.log_count_ratios(part, np.where(target[at] > 0, 1, -1), 1 << BITS)[x.known]
        return linear.fit_logistic(x.take(at, earlier[at]), target[at], l2, 30, scale)

    for k in range(count):
        target = y[:, k]
        have = np.flatnonzero(~np.isnan(target))
        if not len(have) or target[have].min() == target[have].max():
            share = float(target[have].mean()) if len(have) else 0.0
            bias = float(np.log((share + 1e-4) / (1 - share + 1e-4)))
            models.append({"w": np.zeros(1 << BITS, np.float32), "earlier": np.zeros(k), "bias": bias})
            out = np.full(n, linear.sigmoid(bias))
        else:
            final = fit(have, target)
            out = linear.sigmoid(x.take(np.arange(n), earlier).dot(final))
            for f in range(folds):
                inside, rest = have[fold[have] == f], have[fold[have] != f]
                if len(inside) and len(rest) and target[rest].min() < target[rest].max():
                    out[inside] = linear.sigmoid(x.take(inside, earlier[inside]).dot(fit(rest, target)))
            w = np.zeros(1 << BITS, np.float32)
            w[x.known] = final[: len(x.known)]
            models.append({"w": w, "earlier": final[len(x.known) : -1], "bias": float(final[-1])})
        earlier = np.column_stack([earlier, out])
    return models


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    categories: list[str],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    usable: Column | None = None,
    max_train: int = MAX_TRAIN,
) -> list[dict]:
    """Fit the chain on about max_train labelled rows at most, those that are not
    held out. categories are columns of labels (0, 1 or null), in chain order."""
    usable = ~is_held_out(id_col) if usable is None else usable
    return learning.fit_on_sample(docs, labels, usable, categories, stem_indicators, fit_chain_sample, id_col=id_col, text_col=text_col, most=max_train)


def probabilities(models: list[dict], text: str | None) -> list[float]:
    x, out = stem_indicators(text), []
    for m in models:
        z = float(m["w"][x].sum(dtype=np.float64)) + float(m["earlier"] @ np.array(out)) + m["bias"]
        out.append(float(linear.sigmoid(z)))
    return out


def score_toxicity(docs: DataFrame, models: list[dict], categories: list[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and p_<category> (0 to 1) for every row and category. Null, empty
    and blank texts score by the biases alone; repeated rows each get a row; no
    other column is read."""
    return learning.score_texts(docs, models, probabilities, [f"p_{c}" for c in categories], id_col=id_col, text_col=text_col)
