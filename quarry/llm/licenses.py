"""Licence scan by a trained paragraph classifier.

Paragraphs are classified into licence families, or none, by a logistic regression
over word n-grams. It is trained on the templates below, on seeded variations of
them, alone and inside ordinary text, and for the unknown class on ordinary
paragraphs of the corpus, on licence words out of order and on notices that are
denied. Temperature scaling calibrates it on templates that the calibrated models
were not trained on. A family is confirmed when the paragraph also resembles one of
its templates, in what tells that template from other families' as well.

A paragraph is a line, or a run of short lines (SHORT_LINE words at most, with no
blank line between them), since notices are wrapped; the lines of a run are scored
alone too. A paragraph of more than WINDOW words is scored in windows of so many
words, each STEP words after the last, so that every run of STEP words is whole in
one of them. Every paragraph is scored.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import linear
from quarry.llm.tables import named, schema_of, slices

BITS = 16
UNKNOWN = "unknown"
MAX_BACKGROUND = 4_000
VARIATIONS = 30
MIN_PROBABILITY = 0.25
MIN_RESEMBLANCE = 0.5
#: Two-word sequences up to which a template must be there whole to confirm.
SHORT_TEMPLATE = 2
WINDOW = 40
STEP = 20
SHORT_LINE = 20
FOLDS = 2
CACHE = 200_000
SCORED = 1_000

#: Notices and first lines of texts by which licence families are
#: usually named. Every family's SPDX tags, below, are templates too.
TEMPLATES = {
    "AGPL": ["licensed under the gnu affero general public license version 3", "this work is licensed under the agpl", "gnu affero general public license version 3 19 november 2007", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license", "license agplv3", "gnu agpl v3"],
    "Apache-2.0": ["licensed under the apache license version 2.0", "released under the apache 2.0 license", "apache license version 2.0 january 2004", "apache license 2.0", "license apache 2.0"],
    "BSD": ["released under the bsd license", "redistribution and use in source and binary forms with or without modification are permitted", "licensed under the bsd 3 clause license", "bsd 3 clause license", "bsd 2 clause license"],
    "CC-BY": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "creative commons attribution 3.0 unported", "creative commons attribution 2.0 generic"],
    "CC-BY-NC": ["licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license", "creative commons attribution noncommercial 3.0 unported", "creative commons attribution noncommercial 2.0 generic"],
    "CC-BY-ND": ["licensed under cc by nd 4.0", "this work is licensed under a creative commons attribution noderivatives 4.0 international license", "creative commons attribution noderivatives 3.0 unported", "creative commons attribution noderivatives 2.0 generic"],
    "CC-BY-SA": ["licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license", "creative commons attribution sharealike 3.0 unported", "creative commons attribution sharealike 2.0 generic"],
    "CC0": ["licensed under cc0 1.0", "dedicated to the public domain under creative commons zero", "cc0 1.0 universal statement of purpose"],
    "GPL": ["this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it under the terms of the gnu general public license", "licensed under the gpl", "gnu general public license version 3 29 june 2007", "gnu general public license version 2 june 1991", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license", "gnu gpl v2", "gnu gpl v3", "license gplv2", "license gplv3", "license gpl"],
    "ISC": ["released under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "LGPL": ["licensed under the gnu lesser general public license version 2.1", "released under the lgpl", "gnu lesser general public license version 3 29 june 2007", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license", "gnu lgpl v2.1", "license lgplv3", "license lgplv2.1"],
    "MIT": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "the software is provided as is without warranty of any kind express or implied", "the mit license", "mit license", "license mit"],
    "MPL": ["this source code form is subject to the terms of the mozilla public license version 2.0", "licensed under the mpl 2.0", "mozilla public license version 2.0"],
    "Proprietary": ["all rights reserved", "confidential and proprietary do not distribute", "no part of this work may be reproduced without written permission"],
    "Unlicense": ["this is free and unencumbered software released into the public domain", "released under the unlicense"],
}
#: What follows "SPDX-License-Identifier:".
SPDX = {
    "AGPL": ["AGPL-3.0-only", "AGPL-3.0-or-later"],
    "Apache-2.0": ["Apache-2.0"],
    "BSD": ["BSD-2-Clause", "BSD-3-Clause"],
    "CC-BY": ["CC-BY-4.0"],
    "CC-BY-NC": ["CC-BY-NC-4.0"],
    "CC-BY-ND": ["CC-BY-ND-4.0"],
    "CC-BY-SA": ["CC-BY-SA-4.0"],
    "CC0": ["CC0-1.0"],
    "GPL": ["GPL-2.0-only", "GPL-3.0-or-later"],
    "ISC": ["ISC"],
    "LGPL": ["LGPL-2.1-only", "LGPL-3.0-or-later"],
    "MIT": ["MIT"],
    "MPL": ["MPL-2.0"],
    "Unlicense": ["Unlicense"],
}
#: Ways to deny a notice, by what stands before its verb or after it.
VERBS = "licensed released dedicated subject reserved granted permitted distributed available".split()
DENIALS = ["not", "never", "no longer", "neither", "cannot be", "should not be", "was never", "is not", "isn t"]
AFTERWORDS = ["does not apply", "is not used here", "was rejected", "is incompatible with this work"]
#: Words that variations of a notice put in at random.
FILLERS = "the a this work code text file content is are was made available distributed under terms of see for details please note copyright by and in".split()

_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


_U = np.uint64


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = xxhash.xxh3_64_intdigest(word)
        return n

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > CACHE:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_hashes = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def spans(n: int) -> list[tuple[int, int]]:
    """The windows of a paragraph of n words."""
    return [(0, n)] if n <= WINDOW else [(a, min(n, a + WINDOW)) for a in range(0, n - WINDOW + STEP, STEP)]


def window_grams(words: list[str], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, gram): distinct hashed n-grams of one to three words of every window,
    sorted."""
    h = _hashes.of(words)
    grams, out = h, [np.zeros(0, np.int64)]
    for k in (1, 2, 3):
        lengths = np.maximum(ends - starts - k + 1, 0)
        window = np.repeat(np.arange(len(starts)), lengths)
        at = np.arange(len(window)) - np.repeat(np.cumsum(lengths) - lengths - starts, lengths)
        out.append(window << BITS | (_mix(grams + _U(k)) >> _U(64 - BITS))[at].astype(np.int64))
        grams = _mix(grams[:-1]) * _U(0x9E3779B97F4A7C15) + h[k:]
    found = np.unique(np.concatenate(out))
    return found >> BITS, (found & (1 << BITS) - 1).astype(np.int32)


def ngrams(words: list[str]) -> np.ndarray:
    """Sorted distinct hashed n-grams of one to three words."""
    return window_grams(words, np.array([0]), np.array([len(words)]))[1]


def variations(template: list[str], n: int, rng: np.random.Generator, plain: list[list[str]]) -> list[list[str]]:
    """The template, and copies with words dropped or put in; every other one has
    ordinary words around it."""
    out = [template]
    for i in range(n - 1):
        words = [w for w in template if rng.random() > 0.06]
        for _ in range(rng.integers(0, 4)):
            words.insert(int(rng.integers(0, len(words) + 1)), FILLERS[rng.integers(len(FILLERS))])
        if i % 2 and plain:
            around = plain[rng.integers(len(plain))]
            around = around[rng.integers(len(around)) :][: max(0, rng.integers(WINDOW) + 1 - len(words))]
            cut = int(rng.integers(0, len(around) + 1))
            words = around[:cut] + words + around[cut:]
        out.append(words or template)
    return out


def _pairs(words: list[str]) -> set:
    return {*zip(words, words[1:])} if len(words) > 1 else {*words}


def prepared(templates: dict[str, list[str]]) -> dict[str, list[tuple[list[str], set, set]]]:
    """Of each template its words, its two-word sequences, and those of them that no
    other family's template has (all of them, if it has no such)."""
    words = {f: [words_of(t) for t in texts] for f, texts in templates.items()}
    out = {}
    for f in words:
        others = {p for g, texts in words.items() if g != f for t in texts for p in _pairs(t)}
        out[f] = [(t, _pairs(t), _pairs(t) - others or _pairs(t)) for t in words[f]]
    return out


def resemblance(words: list[str], templates: list[tuple[list[str], set, set]]) -> float:
    """How much of one of a family's templates is in the paragraph, at best: the
    share of its two-word sequences, or of those that are its family's own, if that
    is less. Half of a template of one or two of them is chance, and counts as none."""
    have = _pairs(words)
    return max(0.0 if len(p) <= SHORT_TEMPLATE and not p <= have else min(len(p & have) / len(p), len(own & have) / len(own)) for _, p, own in templates)


def denied(template: list[str], rng: np.random.Generator) -> list[str]:
    """A notice that says that the licence does not hold."""
    no = words_of(DENIALS[rng.integers(len(DENIALS))])
    at = [i for i, w in enumerate(template) if w in VERBS]
    if at and rng.random() < 0.75:
        return [*template[: at[0]], *no, *template[at[0] :]]
    return [*template, *words_of(AFTERWORDS[rng.integers(len(AFTERWORDS))])] if rng.random() < 0.5 else [*no, *template]


def background(docs: DataFrame, text_col: str, most: int = MAX_BACKGROUND, seed: int = 17) -> DataFrame:
    """(p): lines of about `most` texts at most, chosen by a seeded hash, for the
    unknown class: of each text the first, the middle and the last line, for notices
    stand at the ends and must be told from what else stands there."""
    texts = docs.where(named(text_col).isNotNull()).select(named(text_col).cast("string").alias("t"))
    share = min(1.0, most / max(1, texts.count()))
    part = texts.where(F.pmod(F.xxhash64("t", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    lines = part.select(F.split("t", "\n").alias("l")).select(F.array_distinct(F.array(F.col("l")[0], F.element_at("l", -1), F.col("l")[(F.size("l") / 2).cast("int")])).alias("l"))
    return lines.select(F.explode("l").alias("p")).where(F.length("p") < 2000).distinct()


def fit_licenses(paragraphs: DataFrame, *, templates: dict[str, list[str]] | None = None, seed: int = 0) -> dict:
    """The model of fit_sample on paragraphs (p) of ordinary text, whose number is
    bounded by background. They meet in one task, which trains; the model alone,
    whose size is fixed, comes to the driver."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = sorted({p for batch in batches for p in batch.column(0).to_pylist()})
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(fit_sample(lines, templates=templates, seed=seed))]})

    found = paragraphs.select("p").repartition(1).mapInArrow(train, "model binary").collect()
    return pickle.loads(found[0][0]) if found else fit_sample([], templates=templates, seed=seed)


def all_templates() -> dict[str, list[str]]:
    return {f: [*texts, *(f"SPDX-License-Identifier: {tag}" for tag in SPDX.get(f, []))] for f, texts in TEMPLATES.items()}


def fit_sample(paragraphs: list[str], *, templates: dict[str, list[str]] | None = None, seed: int = 0) -> dict:
    """Weights of one logistic model for each family against all others and the
    unknown class, and the temperature. paragraphs: ordinary text; those that
    resemble a template are left out of the unknown class."""
    split = prepared(templates or all_templates())
    rng = np.random.default_rng(seed)
    families = sorted(split)
    unknown = len(families)
    licence_words = sorted({w for f in families for t, _, _ in split[f] for w in t})
    plain = [w for w in map(words_of, paragraphs) if w and not any(resemblance(w, split[f]) >= MIN_RESEMBLANCE for f in families)]

    rows, labels, folds = [], [], []

    def add(words: list[str], label: int, fold: int) -> None:
        rows.append(ngrams(words)), labels.append(label), folds.append(fold)

    for k, f in enumerate(families):
        for i, (t, _, _) in enumerate(split[f]):
            for words in variations(t, VARIATIONS, rng, plain):
                add(words, k, i % FOLDS)
            for words in variations(t, VARIATIONS // 2, rng, plain):
                add(denied(t, rng) if rng.random() < 0.5 else denied(words, rng), unknown, i % FOLDS)
    for i, words in enumerate(plain):
        parts = spans(len(words))
        a, b = parts[rng.integers(len(parts))]
        add(words[a:b], unknown, i % FOLDS)
    for i in range(VARIATIONS * 4):  # licence words out of order are no notice
        add([licence_words[j] for j in rng.integers(0, len(licence_words), rng.integers(1, 5))], unknown, i % FOLDS)
    y, fold = np.array(labels), np.array(folds)
    x = linear.Sparse(rows)

    def fit(at: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        weights, bias = np.zeros((len(families) + 1, 1 << BITS), np.float32), np.zeros(len(families) + 1)
        part = x.take(at)
        for k in range(len(families) + 1):
            w = linear.fit_logistic(part, (y[at] == k).astype(float), 1e-4, steps)
            weights[k, x.known], bias[k] = w[:-1], w[-1]
        return weights, bias

    logits = np.zeros((len(y), len(families) + 1))
    for k in range(FOLDS):  # of families with several templates, others are held than trained on
        weights, bias = fit(np.flatnonzero(fold != k), 10)
        for i in np.flatnonzero(fold == k):
            logits[i] = weights[:, rows[i]].sum(1) + bias

    def loss(t: float) -> float:
        z = logits / t
        top = z.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(z - top).sum(1)) + top[:, 0] - z[np.arange(len(z)), y]))

    temperature = min(np.geomspace(0.2, 10, 40), key=loss)
    weights, bias = fit(np.arange(len(y)), 30)
    return {"families": families, "w": weights.T.copy(), "bias": bias, "t": float(temperature), "templates": split}


def _probabilities(words: list[str], starts: np.ndarray, ends: np.ndarray, model: dict) -> np.ndarray:
    out = []
    for at in range(0, len(starts), SCORED):
        first, last = starts[at], ends[min(at + SCORED, len(ends)) - 1]
        s, e = starts[at : at + SCORED] - first, ends[at : at + SCORED] - first
        window, grams = window_grams(words[first:last], s, e)
        z = np.add.reduceat(model["w"][grams], np.searchsorted(window, np.arange(len(s))), axis=0)
        z = (z + model["bias"]) / model["t"]
        p = np.exp(z - z.max(1, keepdims=True))
        out.append(p / p.sum(1, keepdims=True))
    return np.concatenate(out)


def _paragraphs(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(first and last line, words) of every line with words, and of every run of
    short ones."""
    run, start = [], 0
    for n, line in enumerate([*text.split("\n"), ""]):
        words = words_of(line)
        if words:
            yield n, n, words
        if words and len(words) <= SHORT_LINE:
            if not run:
                start = n
            run.append(words)
            continue
        if len(run) > 1:
            yield start, n - 1, [w for part in run for w in part]
        run = []


def scan_texts(texts: list[str | None], model: dict) -> list[list[tuple[int, str, float, float, bool]]]:
    """(first line, family, probability, resemblance, confirmed) of every paragraph of
    every text that is not unknown; once for each family that one of its windows
    belongs to. A run of short lines counts where none of its lines says the same as surely."""
    words, owner, starts, ends = [], [], [], []
    for i, text in enumerate(texts):
        for first, last, found in _paragraphs(text or ""):
            for a, b in spans(len(found)):
                owner.append((i, first, last)), starts.append(len(words) + a), ends.append(len(words) + b)
            words += found
    best: list[dict] = [{} for _ in texts]
    if not owner:
        return [[] for _ in texts]
    p = _probabilities(words, np.array(starts), np.array(ends), model)
    top = p.argmax(1)
    for x in np.flatnonzero((top < len(model["families"])) & (p.max(1) >= MIN_PROBABILITY)).tolist():
        (i, *n), family, part = owner[x], model["families"][top[x]], words[starts[x] : ends[x]]
        like = resemblance(part, model["templates"][family])
        new = (like >= MIN_RESEMBLANCE, float(p[x, top[x]]), like)
        best[i][(*n, family)] = max(new, best[i].get((*n, family), new))
    alone = [{(f, a): sure for (a, z, f), (sure, _, _) in b.items() if a == z} for b in best]
    return [
        [(a, f, prob, like, sure) for (a, z, f), (sure, prob, like) in sorted(b.items()) if a == z or not any(said.get((f, k), -1) >= sure for k in range(a, z + 1))]
        for b, said in zip(best, alone)
    ]


def classify(paragraph: str, model: dict) -> tuple[str, float, float, bool]:
    """Family or unknown, its probability, the best resemblance to a template of
    that family, and whether that confirms it; of several families the surest."""
    found = scan_texts([paragraph], model)[0]
    if found:
        return max((x[1:] for x in found), key=lambda x: (x[3], x[1]))
    words = words_of(paragraph)
    at = np.array(spans(len(words))) if words else np.zeros((0, 2), int)
    return UNKNOWN, float(_probabilities(words, at[:, 0], at[:, 1], model)[:, -1].min()) if words else 1.0, 0.0, False


def scan_licenses(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, license (confirmed families, sorted, joined by "+"; null if none),
    n_confirmed (paragraphs, for each of their families) and paragraphs (first line,
    family, probability, resemblance, confirmed of each that is not unknown) for
    every row, from its whole text. Null, empty and blank texts have none; repeated rows each get a
    row; no other column is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(named(id_col).alias("__id"), named(text_col).cast("string").alias("__text"))
    kind = pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("resemblance", pa.float64()), ("confirmed", pa.bool_())]))
    fields = ("line", "family", "probability", "resemblance", "confirmed")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in slices(whole, "__text"):
                rows = [[dict(zip(fields, x)) for x in found] for found in scan_texts(batch.column("__text").to_pylist(), m)]
                yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(rows, kind)], names=["__id", "paragraphs"])

    types = (T.IntegerType(), T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType())
    paragraph = T.StructType([T.StructField(n, t) for n, t in zip(fields, types)])
    found = narrow.mapInArrow(scan, schema_of(narrow, "__id", paragraphs=T.ArrayType(paragraph)))
    sure = F.filter("paragraphs", lambda p: p["confirmed"])
    names = F.array_sort(F.array_distinct(F.transform(sure, lambda p: p["family"])))
    return found.select(
        F.col("__id").alias(id_col),
        F.when(F.size(names) > 0, F.array_join(names, "+")).alias("license"),
        F.size(sure).cast("long").alias("n_confirmed"),
        "paragraphs",
    )
