"""Hashed n-gram indicators of whole texts, in NumPy inside a task.

Tokens are runs of word characters and runs of other signs. Beside the words'
own n-grams there are n-grams over coarse shapes (lower case, capitalised, upper
case, digits, the sign itself, repeated from one or two tokens before), which
carry over to words never seen before.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

BITS = 20
CACHE = 150_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_U = np.uint64
_MUL = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(29))) * _MUL[1]
    return x ^ (x >> _U(32))


def _shape(token: str) -> str:
    if not (token[0].isalnum() or token[0] == "_"):
        return token[:3]
    if token.isdigit():
        return "0"
    if token.islower():
        return "a"
    if token.isupper():
        return "A" if len(token) > 1 else "X"
    return "Aa" if token[0].isupper() and token[1:].islower() else "aA"


class _Ids(dict):
    """Numbers of tokens; a number leads to a row of hashes that depend on the
    token alone. Bounded: when full, all are forgotten."""

    def __init__(self, hashes, width: int, kind):
        self.hashes, self.table = hashes, np.zeros((CACHE, width), kind)

    def __missing__(self, token: str) -> int:
        n = len(self)
        self.table[n] = self.hashes(token)
        self[token] = n
        return n

    def of(self, tokens: list[str]) -> np.ndarray:
        if len(self) + len(tokens) > CACHE:
            self.clear()
            if len(tokens) > CACHE // 2:
                return np.concatenate([self.of(tokens[i : i + CACHE // 2]) for i in range(0, len(tokens), CACHE // 2)])
        return self.table[np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))]


_hash = xxhash.xxh3_64_intdigest
_ids = _Ids(lambda t: (_hash(t.lower()), _hash(_shape(t), 1)), 2, np.uint64)


def indicators(text: str | None, bits: int = BITS) -> np.ndarray:
    """Sorted distinct hashed features of one whole text; empty for no tokens."""
    tokens = _TOKEN.findall(text) if text else []
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int32)
    words, shapes = _ids.of(tokens).T
    again = np.zeros(n, np.uint64)
    again[2:][words[2:] == words[:-2]] = 2
    again[1:][words[1:] == words[:-1]] = 1
    shapes = shapes + again * _MUL[0]
    two = shapes[:-1] * _MUL[0] + _mix(shapes[1:])
    three = two[:-1] * _MUL[2] + _mix(shapes[2:] * _MUL[2])
    shaped = np.unique(np.concatenate([shapes, two, three]))
    pairs = words[:-1] * _MUL[0] + _mix(words[1:])
    found = np.concatenate([words, pairs, shaped])
    return np.unique((_mix(found) >> _U(64 - bits)).astype(np.int32))


PREFIXES = (4, 5, 6, 7)
LEVELS = (2, 3, 5)
_WORD = re.compile(r"\w+")


def _stems(word: str) -> list[int]:
    """The word and its beginnings as feature numbers; -1 where it is too short."""
    return [_hash(word) >> (64 - BITS), *(_hash(word[:k], k) >> (64 - BITS) if len(word) > k else -1 for k in PREFIXES)]


_stem_ids = _Ids(_stems, 1 + len(PREFIXES), np.int32)


def stem_indicators(text: str | None) -> np.ndarray:
    """Sorted distinct features of one whole text: lower-cased words and their
    beginnings, and each again for every level of LEVELS that its count reaches."""
    words = _WORD.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.int32)
    base, counts = np.unique(_stem_ids.of(words).ravel(), return_counts=True)
    if base[0] < 0:
        base, counts = base[1:], counts[1:]
    mask = (1 << BITS) - 1
    found = [base, *((base[counts >= n] * np.int64(2 * n + 1) + 77_003 * n) & mask for n in LEVELS)]
    return np.unique(np.concatenate(found).astype(np.int32))
