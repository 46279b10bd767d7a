"""Language identification of whole, possibly mixed texts.

The script of a word narrows the languages it can be in to those seen in that
script while training. Each word gets a log-likelihood for each of them from
character trigrams, and the best path of languages over a text's words, with a
penalty for each switch, labels its spans (Viterbi).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.learning import first_of_each, one_text_each
from quarry.llm.tables import is_held_out, named, schema_of, slices

MAX_TRAIN = 8_000
PENALTY = 12.0
BITS = 16
UNKNOWN = "und"

#: The main blocks of the scripts (first and last code point).
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}

_tables: dict[str, np.ndarray] = {}


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: lower case if it is a letter, else 0; number of its script."""
    if not _tables:
        lower, script = np.zeros(0x110000, np.uint32), np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                lower[i] = ord(low) if len(low) == 1 else i
        for k, ranges in enumerate(SCRIPTS.values(), 1):
            for a, b in ranges:
                script[a : b + 1] = k
        _tables["lower"], _tables["script"] = lower, script
    return _tables["lower"], _tables["script"]


class Words:
    """The words (runs of letters) of several texts: of each its text, first and
    last offset, number of letters, script, and where its trigrams lie."""

    def __init__(self, texts: list[str | None]):
        lower, script = _code_tables()
        lengths = np.array([len(t) if t else 0 for t in texts], np.int64) + 1
        raw = np.frombuffer(("\n".join(t or "" for t in texts) + "\n").encode("utf-32-le"), np.uint32)
        code = lower[raw]
        letter = code != 0
        edges = np.flatnonzero(np.diff(letter, prepend=False, append=False))
        self.begin, self.end = edges[::2], edges[1::2]
        text_starts = np.concatenate([[0], np.cumsum(lengths)])
        self.text = np.searchsorted(text_starts, self.begin, side="right") - 1
        self.offset = text_starts[self.text]
        self.script = script[raw[self.begin]]
        before = np.concatenate([[0], code[:-1]])
        two = np.concatenate([[0, 0], code[:-2]])[: len(code)] * (before != 0)
        at = np.flatnonzero(letter | (before != 0))  # a word's letters and its end
        mixed = (two[at].astype(np.uint32) * np.uint32(0x9E3779B1)) ^ (before[at].astype(np.uint32) * np.uint32(0x85EBCA77))
        mixed = (mixed ^ code[at].astype(np.uint32) * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
        self.grams = (mixed >> np.uint32(32 - BITS)).astype(np.int32)
        # letters and end of word w take len(w) + 1 places
        self.first = np.concatenate([[0], np.cumsum(self.end - self.begin + 1)[:-1]]).astype(np.int64) if len(self.begin) else np.zeros(0, np.int64)


def best_path(scores: np.ndarray, penalty: float) -> np.ndarray:
    """States of the path with the highest sum of scores less penalty for each
    switch; ties go to staying, then to the lowest state."""
    total = scores.sum(0)
    top = int(total.argmax())
    others = np.delete(scores, top, axis=1)
    if not others.shape[1]:
        return np.zeros(len(scores), np.int64)
    run = np.concatenate([[0.0], np.cumsum(others.max(1) - scores[:, top])])
    if (run - np.minimum.accumulate(run)).max() <= penalty:
        return np.full(len(scores), top)  # no stretch gains what leaving it for once costs
    n, k = scores.shape
    back = np.zeros((n, k), np.int8 if k < 128 else np.int32)
    states = range(k)
    best = scores[0].tolist()
    for t, row in enumerate(scores.tolist()[1:], 1):
        lead = max(states, key=best.__getitem__)
        jump = best[lead] - penalty
        line = back[t]
        for s in states:
            if best[s] >= jump:
                line[s] = s
            else:
                line[s], best[s] = lead, jump
            best[s] += row[s]
    path = np.zeros(n, np.int64)
    path[-1] = max(states, key=best.__getitem__)
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def fit_languages(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    usable: Column | None = None,
    max_train: int = MAX_TRAIN,
    smooth: float = 0.3,
) -> dict:
    """Trigram log-likelihoods of each language, and the languages of each script,
    from about max_train labelled rows at most, chosen by a seeded hash of the id
    among those that are not held out. Rows with a null language are not used. Of the
    rows of one id, or of those without one that share a text, one counts: the one
    with the smallest hash of text and language."""
    usable = ~is_held_out(id_col) if usable is None else usable
    text, ident = named(text_col).cast("string"), named(id_col)
    key = F.xxhash64(F.when(ident.isNull(), F.xxhash64(text)), ident, F.lit(9))
    known = docs.where(usable & named(lang_col).isNotNull()).select(key.alias("__key"), text.alias("__text"), named(lang_col).cast("string").alias("lang"))
    keys = known.select("__key").distinct()
    share = min(1.0, max_train / max(1, keys.count()))
    chosen = keys.where(F.pmod("__key", F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = one_text_each(known, chosen, "__key", "lang").select("__key", "lang", "__text")
    sample = sample.mapInArrow(first_of_each, sample.schema).repartition(8, "__key").coalesce(8)  # each task sends a table of counts a language
    size, scripts = 1 << BITS, len(SCRIPTS) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for whole in first_of_each(batches):
            for batch in slices(whole, "__text"):
                langs, texts = np.array(batch.column("lang").to_pylist(), object), batch.column("__text").to_pylist()
                for lang in sorted(set(langs)):
                    words = Words([t for t, x in zip(texts, langs) if x == lang])
                    sums.setdefault(lang, np.zeros(size + scripts, np.int64))
                    sums[lang][:size] += np.bincount(words.grams, minlength=size)
                    sums[lang][size:] += np.bincount(words.script, minlength=scripts)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["lang", "counts"])

    sums: dict[str, np.ndarray] = {}
    for r in sample.mapInArrow(count, "lang string, counts binary").collect():
        sums[r.lang] = sums.get(r.lang, 0) + np.frombuffer(r.counts, np.int64)
    langs = sorted(sums)
    grams = np.array([sums[x][:size] for x in langs], float).reshape(len(langs), size)
    seen = np.array([sums[x][size:] for x in langs], float).reshape(len(langs), scripts)
    logs = np.log((grams + smooth) / (grams.sum(1, keepdims=True) + smooth * size))
    share = seen / np.maximum(1, seen.sum(1, keepdims=True))
    allowed = share >= 0.01
    allowed[:, ~allowed.any(0)] = True  # a script never learned narrows nothing
    return {"langs": langs, "table": np.ascontiguousarray(logs.T, np.float32), "allowed": allowed.T.copy()}


def label_texts(texts: list[str | None], model: dict, penalty: float = PENALTY) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """For each text: its main language, that language's share of the letters, and
    the spans (first and last offset, language)."""
    langs = model["langs"]
    out: list = [(UNKNOWN, 0.0, []) for _ in texts]
    words = Words(texts)
    if not len(words.begin):
        return out
    if not langs:
        return out
    letters = words.end - words.begin
    scores = np.add.reduceat(model["table"][words.grams], words.first, axis=0).astype(float)
    allowed = model["allowed"][words.script]
    scores = np.where(allowed, scores, scores.min(1, keepdims=True) - 50.0)
    cuts = np.flatnonzero(np.diff(words.text, prepend=-1, append=len(texts)))
    for a, b in zip(cuts[:-1], cuts[1:]):
        path = best_path(scores[a:b], penalty)
        weight = np.bincount(path, letters[a:b], len(langs))
        top = int(weight.argmax())
        turns = np.flatnonzero(np.diff(path, prepend=-1, append=-1))
        start, offset = words.begin[a:b], words.offset[a]
        stop = words.end[a:b]
        spans = [(int(start[i] - offset), int(stop[j - 1] - offset), langs[path[i]]) for i, j in zip(turns[:-1], turns[1:])]
        out[words.text[a]] = (langs[top], float(weight[top] / weight.sum()), spans)
    return out


def identify_languages(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """id_col, lang_pred, score (share of the letters in lang_pred's spans, 0 to 1)
    and spans (array of first offset, offset after the last letter, lang) for every
    row, from its whole text.

    A null text, or one without letters, is `und` with score 0 and no spans, and so
    is every text if nothing was learned. Ties go to the language that sorts
    first. Repeated rows each get a row; no other column is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(named(id_col).alias("__id"), named(text_col).cast("string").alias("__text"))
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text", 1_000_000):
                langs, scores, spans = zip(*label_texts(batch.column("__text").to_pylist(), shared.value, penalty))
                rows = [[{"begin": a, "end": b, "lang": x} for a, b, x in s] for s in spans]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(scores, pa.float64()), pa.array(rows, span)], names=["__id", "lang_pred", "score", "spans"])

    spans = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))
    schema = schema_of(narrow, "__id", lang_pred=T.StringType(), score=T.DoubleType(), spans=spans)
    found = narrow.mapInArrow(label, schema)
    return found.select(F.col("__id").alias(id_col), "lang_pred", "score", "spans")
