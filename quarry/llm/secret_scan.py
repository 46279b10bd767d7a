"""Secret scans: patterns, and the least number of guesses a credential value takes.

Base patterns find assigned credentials, access ids and long hexadecimal strings. Other
values that stand where credentials stand (after `pwd:`, `passphrase is`, `Bearer`, in
`//user:value@host`) are weighed: over all ways to cut a value into dictionary words,
dates, repeats, keyboard walks and characters tried one by one, dynamic programming
finds the one with the fewest bits of guessing. A value that takes SECRET_BITS or more
is a secret; words, names, placeholders and patterns take fewer.

The dictionary is made of the corpus: words of all texts, ranked by how often they come.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import comb, log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.tables import named, schema_of, slices
from quarry.session import materialize

SECRET_BITS = 40.0
#: A cut of a value costs its guesser as much as one of two choices.
CUT_BITS = 1.0
DICTIONARY_WORDS = 20_000
LEAST_WORD, LONGEST_WORD = 3, 32
LONGEST_BLOCK = 8
LEAST_WALK = 4
FLUSH_WORDS = 200_000
#: Classes of word counts to each doubling.
STEPS = 64

#: Kinds of spans, in the order in which they are listed.
KINDS = ("assign", "access", "hex", "guess")
#: The base patterns; the first is held against lower-cased text.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ASSIGN_VALUE, ASSIGN_HINTS = 6, (b"passw", b"secret", b"token", b"api_key", b"apikey")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
#: Where other credentials stand.
CONTEXTS = (
    re.compile(rb"""(?:pass(?:word|wd|wort|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|(?:api|access|private|secret|encryption)[ _-]?key)["']?\x20*(?::=|=>|[:=]|\x20is\x20)\x20*["']?(?:bearer\x20|basic\x20)?([^\s"'<>]+)"""),
    re.compile(rb"\bbearer\x20([^\s\"'<>]+)"),
    re.compile(rb"://[^\s:/@]+:([^\s/@]+)@"),
)
CONTEXT_HINTS = (b"pass", b"pwd", b"secret", b"token", b"cred", b"auth", b"key", b"bearer", b"://")
#: Beginnings of references to a value that is kept elsewhere, and addresses.
REFERENCES = ("$", "{", "%", "http://", "https://", "os.", "env.", "process.")
#: Passwords and placeholders that are guessed first.
COMMON = (
    "password 123456 qwerty admin letmein welcome changeme secret test user root guest master dragon monkey login abc123 iloveyou sunshine "
    "princess football baseball shadow superman trustno1 default example sample dummy placeholder your here insert todo none null hidden redacted"
).split()
#: The keys of a keyboard by rows, plain and with shift, and how far each row is set in.
ROWS = (("`1234567890-=", "~!@#$%^&*()_+", 0.0), ("qwertyuiop[]\\", "QWERTYUIOP{}|", 1.5), ("asdfghjkl;'", 'ASDFGHJKL:"', 1.75), ("zxcvbnm,./", "ZXCVBNM<>?", 2.25))
#: Characters that stand for letters.
LEET = str.maketrans("013457@$!", "oleastasi")
_PLACES = {c: (r, i + shift) for r, (plain, shifted, shift) in enumerate(ROWS) for keys in (plain, shifted) for i, c in enumerate(keys)}
_FIRST_YEAR, _LAST_YEAR = 1900, 2049
_DATE_SHAPES = [re.compile(f"(?=({s}))") for sep in ("", "-", r"\.", "/", "_") for s in (f"(?P<y>[0-9]{{4}}){sep}(?P<a>[0-9]{{2}}){sep}(?P<b>[0-9]{{2}})", f"(?P<a>[0-9]{{2}}){sep}(?P<b>[0-9]{{2}}){sep}(?P<y>[0-9]{{4}}|[0-9]{{2}})")]
_YEAR = re.compile("(?=(19[0-9]{2}|20[0-4][0-9]))")


def _char_bits(c: str) -> float:
    if c.isascii():
        return log2(10 if c.isdigit() else 26 if c.isalpha() else 33)
    return log2(1000)


def _case_bits(piece: str) -> float:
    """Bits to tell which letters are capitals."""
    upper, lower = sum(c.isupper() for c in piece), sum(c.islower() for c in piece)
    if not upper:
        return 0.0
    if not lower or (upper == 1 and piece[0].isupper()):
        return 1.0
    return log2(sum(comb(upper + lower, k) for k in range(1, min(upper, lower) + 1)) + 1)


def _words(value: str, ranks: dict[str, int]) -> Iterator[tuple[int, int, float]]:
    low = value.lower()
    if len(low) != len(value):  # a letter whose small form is longer
        low = value
    plain = low.translate(LEET)
    for i in range(len(value)):
        for j in range(i + LEAST_WORD, min(len(value), i + LONGEST_WORD) + 1):
            for form in (low[i:j], plain[i:j]) if low[i:j] != plain[i:j] else (low[i:j],):
                rank = ranks.get(form)
                if rank:
                    swapped = sum(a != b for a, b in zip(low[i:j], form))
                    yield i, j, log2(rank + 1) + _case_bits(value[i:j]) + (log2(comb(j - i, swapped)) + swapped if swapped else 0.0)


def _dates(value: str) -> Iterator[tuple[int, int, float]]:
    years = _LAST_YEAR - _FIRST_YEAR + 1
    for shape in _DATE_SHAPES:
        for m in shape.finditer(value):
            year, a, b = int(m["y"]), int(m["a"]), int(m["b"])
            if (len(m["y"]) == 2 or _FIRST_YEAR <= year <= _LAST_YEAR) and 1 <= min(a, b) <= 12 and 1 <= max(a, b) <= 31:
                yield m.start(1), m.end(1), log2(years * 365) + 2.0  # 2 for the separator
    for m in _YEAR.finditer(value):
        yield m.start(1), m.end(1), log2(years)


def _adjacent(a: str, b: str) -> bool:
    p, q = _PLACES.get(a), _PLACES.get(b)
    on_keys = p and q and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1.0
    return bool(on_keys) or (a.isascii() and b.isascii() and a.isalpha() and b.isalpha() and abs(ord(a) - ord(b)) == 1)


def _walks(value: str) -> Iterator[tuple[int, int, float]]:
    """Longest walks from key to neighbouring key, or along the alphabet."""
    start = 0
    for i in range(1, len(value) + 1):
        if i < len(value) and _adjacent(value[i - 1], value[i]):
            continue
        if i - start >= LEAST_WALK:
            steps = [(ord(b) - ord(a)) if a.isalpha() == b.isalpha() else 0 for a, b in zip(value[start:i], value[start + 1 : i])]
            keys = [tuple(x - y for x, y in zip(_PLACES.get(b, (0, 0)), _PLACES.get(a, (0, 0)))) for a, b in zip(value[start:i], value[start + 1 : i])]
            turns = min(sum(x != y for x, y in zip(s, s[1:])) for s in (steps, keys))
            yield start, i, log2(len(_PLACES)) + log2(i - start) + turns * log2(6)
        start = i


def _repeats(value: str, ranks: dict[str, int]) -> Iterator[tuple[int, int, float]]:
    """Longest stretches of one block, two times or more (one character: three)."""
    n = len(value)
    for b in range(1, min(LONGEST_BLOCK, n // 2) + 1):
        i = 0
        while i + b < n:
            j = i
            while j + b < n and value[j] == value[j + b]:
                j += 1
            times = (j - i) // b + 1
            if times >= (3 if b == 1 else 2):
                yield i, i + times * b, _cheapest(value[i : i + b], list(_pieces(value[i : i + b], ranks))) + log2(times)
            i = j + 1


def _pieces(value: str, ranks: dict[str, int]) -> Iterator[tuple[int, int, float]]:
    yield from _words(value, ranks)
    yield from _dates(value)
    yield from _walks(value)


def _cheapest(value: str, pieces: list[tuple[int, int, float]]) -> float:
    """Fewest bits of all cuts of a value into pieces (begin, end, bits) and stretches
    of characters tried one by one."""
    ending: dict[int, list[tuple[int, float]]] = {}
    for i, j, bits in pieces:
        ending.setdefault(j, []).append((i, bits))
    best, brute = [0.0], float("inf")
    for j, c in enumerate(value, 1):
        brute = min(brute, best[j - 1] + CUT_BITS) + _char_bits(c)
        best.append(min([brute, *(best[i] + CUT_BITS + bits for i, bits in ending.get(j, ()))]))
    return max(0.0, best[-1] - CUT_BITS)


def guess_bits(value: str, ranks: dict[str, int]) -> float:
    """Bits of the fewest guesses that find the value; ranks: word -> rank from 1."""
    return _cheapest(value, [*_pieces(value, ranks), *_repeats(value, ranks)])


def base_spans(raw: bytes, low: bytes) -> list[tuple[int, int, int, int]]:
    """(kind, begin, end, begin of the value) of the base patterns, in bytes: leftmost,
    not overlapping within a kind; a match that is too short is dropped."""
    out = []
    if any(h in low for h in ASSIGN_HINTS):
        out += [(0, *m.span(), m.start(2)) for m in ASSIGN.finditer(low) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    if b"AKIA" in raw:
        out += [(1, *m.span(), m.start()) for m in ACCESS.finditer(raw)]
    return out + [(2, *m.span(), m.start()) for m in HEX.finditer(raw)]


def context_values(low: bytes) -> list[tuple[int, int]]:
    """Begin and end, in bytes, of the values where credentials stand, without marks that
    end a sentence or close a bracket."""
    out = set()
    if any(h in low for h in CONTEXT_HINTS):
        for context in CONTEXTS:
            for m in context.finditer(low):
                end = m.end(1) - (len(m[1]) - len(m[1].rstrip(b".,;:!?)]}`*|")))
                if end > m.start(1):
                    out.add((m.start(1), end))
    return sorted(out)


def spans_of(text: str | None, ranks: dict[str, int], least_bits: float = SECRET_BITS) -> list[tuple[int, int, int, float | None]]:
    """(kind, begin, end, bits) in code points, by begin, then kind, then end."""
    if not text:
        return []
    raw = text.encode()
    low = raw.lower()
    found = [(k, a, b, guess_bits(raw[v:b].decode(), ranks) if k == 0 else None) for k, a, b, v in base_spans(raw, low)]
    taken = [(a, b) for _, a, b, _ in found]
    last = -1
    for a, b in context_values(low):
        value = raw[a:b].decode()
        if a < last or "(" in value or value.lower().startswith(REFERENCES) or any(x < b and a < y for x, y in taken):
            continue
        bits = guess_bits(value, ranks)
        if bits >= least_bits:
            found.append((3, a, b, bits))
            last = b
    found.sort(key=lambda s: (s[1], s[0], s[2]))
    if text.isascii():
        return found
    ends = sorted({x for s in found for x in s[1:3]})
    place, done, at = {}, 0, 0
    for x in ends:
        at += len(raw[done:x].decode())
        place[x], done = at, x
    return [(k, place[a], place[b], bits) for k, a, b, bits in found]


_SEPARATED = bytes(32 if chr(b) in ".,;:!?()[]{}\"'|*#<>" else b for b in range(256))


def _word_counts(text: str) -> Counter:
    """How often each word of letters only comes in a text, lower-cased; values where
    credentials stand do not count, however often a document was copied."""
    low = text.lower().encode()
    at, parts = 0, []
    for a, b in context_values(low):
        if a >= at:
            parts.append(low[at:a])
            at = b
    return Counter(b" ".join([*parts, low[at:]]).translate(_SEPARATED).split())


def word_ranks(docs: DataFrame, *, text_col: str = "text", most: int = DICTIONARY_WORDS) -> dict[str, int]:
    """Ranks, from 1, of the most frequent words (letters only, LEAST_WORD to
    LONGEST_WORD of them, lower-cased) of all whole texts, ties by the word, behind the
    few passwords that are guessed first.

    Counts are added up in the tasks before the shuffle. Words are taken by classes of
    counts (STEPS to each doubling), the highest first, as long as there are no more
    than `most`; only they, and the sizes of the classes, reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            words = [(w, n) for b, n in seen.items() if LEAST_WORD <= len(b) <= 4 * LONGEST_WORD and LEAST_WORD <= len(w := b.decode()) <= LONGEST_WORD and w.isalpha()]
            seen.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in words], pa.string()), "n": pa.array([n for _, n in words], pa.int64())})

        for whole in batches:
            for batch in slices(whole, "__text"):
                for text in batch.column("__text").to_pylist():
                    if text:
                        seen.update(_word_counts(text))
                if len(seen) > FLUSH_WORDS:
                    yield flushed()
        yield flushed()

    texts = docs.select(named(text_col).cast("string").alias("__text"))
    counted = texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = materialize(counted.withColumn("class", F.floor(F.log2("n") * STEPS).cast("int")), "words")
    taken, least = 0, None
    for r in counted.groupBy("class").count().orderBy(F.col("class").desc()).collect():
        taken += r["count"]
        if taken > most:
            break
        least = r["class"]
    best = counted.where(F.col("class") >= least).collect() if least is not None else []
    words = [r["word"] for r in sorted(best, key=lambda r: (-r["n"], r["word"]))]
    ranks: dict[str, int] = {}
    for w in [*COMMON, *words]:
        ranks.setdefault(w, len(ranks) + 1)
    return ranks


def scan_secrets(docs: DataFrame, ranks: dict[str, int], *, id_col: str = "doc_id", text_col: str = "text", least_bits: float = SECRET_BITS) -> DataFrame:
    """(id_col, spans) of every whole text: array<struct<kind, start, end, bits>>, in code
    points, end exclusive, by start, then kind (assign, access, hex, guess), then end.

    assign, access and hex are the base patterns (the whole match is the span). guess is
    a value where a credential stands that no base span overlaps, which takes least_bits
    or more to guess. bits is null for access and hex.

    Null and empty texts have no spans. Repeated rows and rows without an id each get a
    row; no other column is read. One pass; the dictionary is broadcast, its size is a
    parameter of word_ranks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    narrow = docs.select(named(id_col).alias("__id"), named(text_col).cast("string").alias("__text"))
    span = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for batch in slices(whole, "__text"):
                found = [[{"kind": KINDS[k], "start": a, "end": b, "bits": bits} for k, a, b, bits in spans_of(t, known, least_bits)] for t in batch.column("__text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.struct(span)))], names=["__id", "spans"])

    kinds = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("bits", T.DoubleType())])
    out = narrow.mapInArrow(scan, schema_of(narrow, "__id", spans=T.ArrayType(kinds)))
    return out.select(F.col("__id").alias(id_col), "spans")
