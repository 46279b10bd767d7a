"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items form one suffix automaton per block of
items. Training words stream through it; at each word it knows the longest
suffix of the text so far that occurs in some item. Where that length reaches
the window, the matched words are marked. Words outside the items' vocabulary
end every match, so only stretches of known words are walked.

Blocks of items are bounded by BLOCK_WORDS, and one block's automaton at a time
is broadcast; the marks of several blocks are united per document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.tables import named, schema_of, slices
from quarry.session import materialize

WINDOW = 10
BLOCK_WORDS = 500_000

#: Bytes that separate words become spaces, A-Z become a-z; all others stay.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 32 if b in SEPARATORS else b for b in range(256)
)
MARKS = ("__n_words", "__spans", "__items", "__cut")
_worker: dict = {}


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, runs of digits, a-z and non-ASCII."""
    return text.encode().translate(_FOLD).split() if text else []


class Automaton:
    """Generalised suffix automaton over word ids.

    ids: word -> id. length, link, step: the states. at_window: for each state
    the items that hold its suffix of window words (None if it is shorter).
    short: for each state the nearest state on its suffix path, itself included,
    that spells a whole item of fewer than window words, or -1.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.length, self.link, self.step = [0], [-1], [{}]
        held: list[set] = [set()]
        whole: dict[int, set] = {}
        self.least = window
        for item, words in items:
            if not words:
                continue
            state = 0
            for w in words:
                state = self._extend(state, self.ids.setdefault(w, len(self.ids) + 1), held)
                held[state].add(item)
            if len(words) < window:
                whole.setdefault(state, set()).add(item)
                self.least = min(self.least, len(words))
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        for state in reversed(order[1:]):
            held[self.link[state]] |= held[state]
        n = len(self.length)
        self.items_at: list[frozenset | None] = [None] * n
        self.short: list[int] = [-1] * n
        self.whole = whole
        for state in order[1:]:
            up = self.link[state]
            if self.length[state] >= window:
                self.items_at[state] = self.items_at[up] if self.length[up] >= window else frozenset(held[state])
            self.short[state] = state if state in whole else self.short[up]

    def _extend(self, last: int, c: int, held: list[set]) -> int:
        length, link, step = self.length, self.link, self.step
        if c in step[last]:
            q = step[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q, held)
        new = len(length)
        length.append(length[last] + 1), link.append(0), step.append({}), held.append(set())
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q, held)
        return new

    def _clone(self, p: int, c: int, q: int, held: list[set]) -> int:
        length, link, step = self.length, self.link, self.step
        copy = len(length)
        length.append(length[p] + 1), link.append(link[q]), step.append(dict(step[q])), held.append(set())
        link[q] = copy
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = copy
            p = link[p]
        return copy

    def walk(self, ids: list[int], offset: int, spans: list[tuple[int, int]], found: set) -> None:
        """Stream word ids; add matched spans (offset added) and the items."""
        length, link, step, window = self.length, self.link, self.step, self.window
        state = matched = 0
        for at, c in enumerate(ids, offset + 1):
            nxt = step[state].get(c)
            while nxt is None and state:
                state = link[state]
                matched = length[state]
                nxt = step[state].get(c)
            if nxt is None:
                continue
            state, matched = nxt, matched + 1
            if matched >= window:
                spans.append((at - matched, at))
                # the state's longest string may be longer than what was matched,
                # but its suffix of window words is the same
                found |= self.items_at[state]
            if self.short[state] >= 0:
                s = self.short[state] if matched >= length[self.short[state]] else self.short[link[state]]
                while s >= 0:
                    spans.append((at - length[s], at))
                    found |= self.whole[s]
                    s = self.short[link[s]]


def _united(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def scan(words_by_doc: list[list[bytes]], sam: Automaton) -> list[tuple[list[tuple[int, int]], set]]:
    """Spans of matched words and items found, for each document."""
    counts = [len(w) for w in words_by_doc]
    get = sam.ids.get
    total = sum(counts) + len(counts)
    ids = np.zeros(total, np.int64)
    at = 0
    starts = []
    for words, n in zip(words_by_doc, counts):
        starts.append(at)
        if n:
            ids[at : at + n] = [get(w, 0) for w in words]
        at += n + 1  # a zero ends every document
    known = np.concatenate([[False], ids != 0])
    edges = np.flatnonzero(known[1:] != known[:-1])
    if len(edges) % 2:
        edges = np.append(edges, total)
    begins, ends = edges[::2], edges[1::2]
    long = ends - begins >= sam.least
    out: list = [([], set()) for _ in counts]
    docs = np.searchsorted(np.asarray(starts), begins[long], side="right") - 1
    for doc, a, b in zip(docs.tolist(), begins[long].tolist(), ends[long].tolist()):
        sam.walk(ids[a:b].tolist(), a - starts[doc], *out[doc])
    return [(_united(spans), found) for spans, found in out]


def cut(text: str | None, spans: list[tuple[int, int]], least: int | None) -> str | None:
    """The text without its runs of at least `least` hit words, or None if it has none."""
    long = [x for x in spans if least and x[1] - x[0] >= least]
    if not text or not long:
        return None
    raw = text.encode()
    at = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_FOLD))]
    out, done = [], 0
    for a, b in long:
        out.append(raw[done : at[a][0]])
        done = at[b - 1][1]
    return b"".join([*out, raw[done:]]).decode()


def cut_until_clean(text: str | None, spans: list[tuple[int, int]], least: int | None, sam: Automaton) -> str | None:
    """cut, again and again: words that a cut brings together may make a new match."""
    left = cut(text, spans, least)
    while left and (again := cut(left, scan([words_of(left)], sam)[0][0], least)) is not None:
        left = again
    return left


def _blocks(benchmark: DataFrame, block_words: int) -> int:
    """Into how many blocks the items go, each of about block_words words at most."""
    bytes_all = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-int(bytes_all) // (4 * block_words)))


def _marks(docs: DataFrame, shared: Broadcast, first: bool, cut_from: int | None) -> DataFrame:
    """Add the marks of one block of items, (window, items), to those of the blocks before."""
    kept = [c for c in docs.columns if c not in MARKS]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _worker.get("of") is not shared.value:
            w, given = shared.value
            _worker["of"], _worker["sam"] = shared.value, Automaton([(i, words_of(t)) for i, t in given], w)
        sam = _worker["sam"]
        for whole in batches:
            for batch in slices(whole, "__text"):
                words = [words_of(t) for t in batch.column("__text").to_pylist()]
                spans, found = map(list, zip(*scan(words, sam)))
                if not first:
                    old = [batch.column(c).to_pylist() for c in ("__spans", "__items")]
                    spans = [_united([*new, *zip(x[::2], x[1::2])]) for new, x in zip(spans, old[0])]
                    found = [new | set(x) for new, x in zip(found, old[1])]
                texts = batch.column("__text").to_pylist() if cut_from else [None] * len(spans)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in kept),
                        pa.array([len(w) for w in words], pa.int64()),
                        pa.array([[x for span in doc for x in span] for doc in spans], pa.list_(pa.int32())),
                        pa.array([sorted(x - {None}) for x in found], pa.list_(pa.string())),
                        pa.array([cut_until_clean(t, x, cut_from, sam) for t, x in zip(texts, spans)], pa.string()),
                    ],
                    names=[*kept, *MARKS],
                )

    types = (T.LongType(), T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType()), T.StringType())
    return docs.mapInArrow(mark, schema_of(docs, *kept, **dict(zip(MARKS, types))))


def mark_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    cut_from: int | None = None,
) -> DataFrame:
    """Mark the words of every document that lie in an occurrence of a window.

    A window is `window` consecutive words of an item; an item of fewer words,
    but not none, is one window. Returns id_col, __text (the whole text),
    n_words, spans (array<int>: begin and end of each run of hit words, in
    words), n_hit, items (item ids as strings, sorted). Null or empty texts have
    no words and no hits. With cut_from, `cut` is the text without its runs of at
    least so many hit words (null where there are none), and without those that come
    together where it was cut, by the items of the last block. Null item texts and an
    empty benchmark match nothing; an item with a null id marks words like any
    other, but has no id to be listed among the items. Repeated document rows each
    get a row. No other column is read.
    """
    narrow = docs.select(named(id_col).alias("__id"), named(text_col).cast("string").alias("__text"))
    given = benchmark.select(named(item_col).cast("string").alias("item"), named(item_text_col).cast("string").alias("text"))
    given = given.where("text is not null")
    blocks, marked = _blocks(given, block_words), narrow
    for k in range(blocks):  # one pass for each block; the driver holds one at a time
        rows = given.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        items = sorted(((r["item"], r["text"]) for r in rows), key=lambda r: (r[0] is None, *map(str, r)))
        shared = docs.sparkSession.sparkContext.broadcast((window, items))
        marked = _marks(marked, shared, k == 0, cut_from if k == blocks - 1 else None)
        if k < blocks - 1:
            marked = materialize(marked, "marked")
            shared.destroy()
    pairs = F.expr("aggregate(sequence(0, cast(size(__spans) / 2 as int) - 1), 0L, (s, i) -> s + __spans[2 * i + 1] - __spans[2 * i])")
    return marked.select(
        F.col("__id").alias(id_col),
        "__text",
        F.col("__n_words").alias("n_words"),
        F.col("__spans").alias("spans"),
        F.when(F.size("__spans") > 0, pairs).otherwise(F.lit(0).cast("long")).alias("n_hit"),
        F.col("__items").alias("items"),
        *([F.col("__cut").alias("cut")] if cut_from else []),
    )


def remove_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_span: int = WINDOW,
    max_coverage: float = 0.5,
    chars_col: str | None = "n_chars",
    **given,
) -> DataFrame:
    """Cut hit spans out of the texts and drop what is mostly benchmark.

    A run of hit words of at least min_span words is cut from the text, from the
    first byte of its first word to the last of its last; shorter runs stay. Where a
    cut brings words together that make such a run, that is cut too; with several
    blocks of items, changed documents are looked through again until none changes.
    Documents of which more than max_coverage of the words are hit go. All
    columns of docs are returned; chars_col, if docs has it, is set to the new
    length. Documents without hits, null and empty texts included, come back
    unchanged.
    """
    others = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*[named(c) for c in others], F.lit(0).alias("__nothing")).alias("__doc"), named(text_col).cast("string").alias("__body"))
    marked = mark_contamination(packed, benchmark, id_col="__doc", text_col="__body", cut_from=min_span, **given)
    left = marked.where((F.col("n_hit") == 0) | (F.col("n_hit") <= max_coverage * F.col("n_words")))
    changed = F.col("cut").isNotNull()
    out = []
    for c in docs.columns:
        old = F.col("__text") if c == text_col else F.col("__doc").getField(c)
        if c == text_col:
            old = F.coalesce("cut", "__text")
        elif c == chars_col:
            old = F.when(changed, F.length("cut").cast(docs.schema[c].dataType)).otherwise(old)
        out.append(old.alias(c))
    given_items = benchmark.select(named(given.get("item_text_col", "text")).cast("string").alias("text"))
    if _blocks(given_items, given.get("block_words", BLOCK_WORDS)) == 1:
        return left.select(*out)
    done = materialize(left.select(F.struct(*out).alias("__doc"), changed.alias("__changed")), "cut")
    rows = lambda some: done.where(some).select(*[F.col("__doc").getField(c).alias(c) for c in docs.columns])
    if done.where("__changed").isEmpty():
        return rows(F.lit(True))
    again = remove_contamination(rows(F.col("__changed")), benchmark, id_col=id_col, text_col=text_col, min_span=min_span, max_coverage=max_coverage, chars_col=chars_col, **given)
    return rows(~F.col("__changed")).unionByName(again)
