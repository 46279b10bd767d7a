"""Token counts by a two-tier map-side lookup.

Tier one is a broadcast table from the most frequent pre-tokens to their token
lengths; its size is a parameter, so it does not grow with the corpus. Tier two
is a bounded cache in each Python worker that encodes a pre-token when it is
first missed. Texts never leave their partition and no pre-token is shuffled; the
frequent ones are those of a bounded sample of texts.

A pre-token is a run of spaces with the text up to the next space. No piece of
the vocabulary holds a space after another character, so merges never cross
these borders and the lengths of the pre-tokens add up to the text's length.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.tables import named, schema_of, slices

TABLE_SIZE = 16_384
CACHE_SIZE = 400_000
LONG_PRETOKEN = 48
SAMPLE_TEXTS = 4_000
SAMPLE_SEED = 29

_RUNS = re.compile(r" *[^ ]+| +$")
_worker: dict = {}


def pretokens(text: str) -> list[str]:
    """Runs of spaces with what follows, each without its first space: the model
    puts one before whatever it encodes, the text's start included."""
    if not text:
        return []
    text = text.replace("\u2581", " ")  # the model's own sign for a space
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [run[1:] for run in _RUNS.findall(" " + text)]
    return text.split(" ")


def _processor(path: str):
    key = ("model", path)
    if key not in _worker:
        import sentencepiece

        _worker[key] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _worker[key]


class _Lengths(dict):
    """Lengths by pre-token; one that is missing is encoded and, unless it is
    long, kept. Beyond CACHE_SIZE entries only the frequent ones stay."""

    def __init__(self, path: str, frequent: dict[str, int]):
        super().__init__(frequent)
        self.frequent, self.encode = frequent, _processor(path).encode

    def __missing__(self, word: str) -> int:
        n = len(self.encode(word)) if word else 1  # "" stands for one space alone
        if len(word) <= LONG_PRETOKEN:
            if len(self) >= CACHE_SIZE:
                self.clear()
                self.update(self.frequent)
            self[word] = n
        return n


def _top(counts: Counter, size: int) -> Counter:
    return counts if len(counts) <= size else Counter(dict(counts.most_common(size)))


def frequent_pretokens(docs: DataFrame, text_col: str = "text", size: int = TABLE_SIZE, texts: int = SAMPLE_TEXTS) -> dict[str, int]:
    """The most frequent pre-tokens, at most `size`, of a sample of about `texts`
    texts, with their counts there. Which ones are found touches speed only, never a
    count of tokens. A task adds up its part of the sample; the parts, which the
    sample bounds, are added up in the driver."""
    given = docs.select(named(text_col).cast("string").alias("__text")).where("__text <> ''")
    share = min(1.0, texts / max(1, docs.count()))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for whole in batches:
            for batch in slices(whole, "__text"):
                for text in batch.column(0).to_pylist():
                    counts.update(w for w in pretokens(text) if len(w) <= LONG_PRETOKEN)
        if counts:
            yield pa.RecordBatch.from_pydict({"counts": [pickle.dumps(dict(counts))]})

    total: Counter = Counter()
    for row in given.sample(share, SAMPLE_SEED).mapInArrow(add_up, "counts binary").toLocalIterator():
        total.update(pickle.loads(row[0]))
    return dict(total.most_common(size))


def count_tokens(
    docs: DataFrame,
    model_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
    table_size: int = TABLE_SIZE,
) -> DataFrame:
    """Count the tokens of every whole text.

    Returns id_col, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).
    A null or empty text has 0 bytes and 0 tokens; repeated rows each get a row;
    an empty table gives an empty result; other columns of docs are not read, so
    clashing names do not matter. model_path is a sentencepiece model that every
    executor can read at that path.
    """
    words = frequent_pretokens(docs, text_col, table_size)
    fill = _Lengths(model_path, {})
    table = docs.sparkSession.sparkContext.broadcast({w: fill[w] for w in words})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ("lengths", model_path)
        known = _worker.get(key)
        if known is None or known.frequent is not table.value:
            known = _worker[key] = _Lengths(model_path, table.value)
        of = known.__getitem__
        for whole in batches:
            for batch in slices(whole, "__text"):
                tokens = [sum(map(of, pretokens(text))) if text else 0 for text in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens, pa.int64())], names=["__id", "n_bytes", "n_tokens"])

    text = named(text_col).cast("string").alias("__text")
    narrow = docs.select(named(id_col).alias("__id"), text, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    counted = narrow.mapInArrow(count, schema_of(narrow, "__id", "n_bytes", n_tokens=T.LongType()))
    return counted.select(F.col("__id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
