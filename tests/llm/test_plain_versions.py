"""The trained queries against versions in plain Python, document by document."""

import math
import re
import zlib

import numpy as np
import pytest
import xxhash

from quarry.llm import langid, quality, registry, toxicity
from quarry.llm.features import BITS, LEVELS, PREFIXES
from quarry.llm.tables import table

M64, M32 = (1 << 64) - 1, (1 << 32) - 1
MUL = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.lang) for r in table(spark, sf_dir, "documents").collect()]
    labels = {r.doc_id: (r.quality, r.toxic) for r in table(spark, sf_dir, "labels").collect()}
    return sorted(docs), labels


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def mix(x):
    x = ((x ^ (x >> 29)) * MUL[1]) & M64
    return x ^ (x >> 32)


def shape(t):
    if not (t[0].isalnum() or t[0] == "_"):
        return t[:3]
    if t.isdigit():
        return "0"
    if t.islower():
        return "a"
    if t.isupper():
        return "A" if len(t) > 1 else "X"
    return "Aa" if t[0].isupper() and t[1:].islower() else "aA"


def word_and_shape_features(text):
    tokens = re.findall(r"\w+|[^\w\s]+", text or "")
    words = [xxhash.xxh3_64_intdigest(t.lower()) for t in tokens]
    shapes = []
    for i, t in enumerate(tokens):
        again = 1 if i and words[i] == words[i - 1] else 2 if i > 1 and words[i] == words[i - 2] else 0
        shapes.append((xxhash.xxh3_64_intdigest(shape(t), 1) + again * MUL[0]) & M64)
    found = set(words) | set(shapes)
    twos = [(a * MUL[0] + mix(b)) & M64 for a, b in zip(shapes, shapes[1:])]
    found |= set(twos) | {(a * MUL[2] + mix((b * MUL[2]) & M64)) & M64 for a, b in zip(twos, shapes[2:])}
    found |= {(a * MUL[0] + mix(b)) & M64 for a, b in zip(words, words[1:])}
    return np.array(sorted({mix(x) >> (64 - BITS) for x in found}), np.int32)


def stem_features(text):
    counts = {}
    for w in re.findall(r"\w+", (text or "").lower()):
        own = [xxhash.xxh3_64_intdigest(w) >> (64 - BITS)] + [xxhash.xxh3_64_intdigest(w[:k], k) >> (64 - BITS) for k in PREFIXES if len(w) > k]
        for x in own:
            counts[x] = counts.get(x, 0) + 1
    found = set(counts)
    for n in LEVELS:
        found |= {(x * (2 * n + 1) + 77_003 * n) & ((1 << BITS) - 1) for x, c in counts.items() if c >= n}
    return np.array(sorted(found), np.int32)


def sigmoid(z):
    return 1 / (1 + math.exp(-max(-40, min(40, z))))


def test_quality(spark, sf_dir, rows):
    docs, labels = rows
    train = sorted(((i, word_and_shape_features(t)) for i, t, _ in docs if labels.get(i, (None,))[0] is not None and not held(i)), key=lambda r: (r[0], r[1].tobytes()))
    model = quality.fit_sample([x for _, x in train], np.array([labels[i][0] > 0 for i, _ in train]))
    got = {r.doc_id: r for r in registry.op5_quality(spark, sf_dir).collect()}
    assert sorted(got) == [i for i, _, _ in docs]
    for i, text, _ in docs:
        score = sigmoid(model["slope"] * (sum(float(model["w"][f]) for f in word_and_shape_features(text)) + model["bias"]) + model["offset"])
        assert got[i].score == pytest.approx(score, abs=1e-6) and got[i].held_out == held(i) and got[i].predicted == int(got[i].score >= 0.3)


def test_toxicity(spark, sf_dir, rows):
    docs, labels = rows
    train = sorted(((i, stem_features(t)) for i, t, _ in docs if i in labels and not held(i)), key=lambda r: (r[0], r[1].tobytes()))
    y = np.array([[math.nan if labels[i][0] is None else 1 - labels[i][0], math.nan if labels[i][1] is None else labels[i][1]] for i, _ in train], float)
    models = toxicity.fit_chain_sample([x for _, x in train], y)
    got = {r.doc_id: r for r in registry.op1_toxicity(spark, sf_dir).collect()}
    assert sorted(got) == [i for i, _, _ in docs]
    for i, text, _ in docs:
        chain = []
        for m in models:
            z = sum(float(m["w"][f]) for f in stem_features(text)) + sum(a * b for a, b in zip(m["earlier"], chain)) + m["bias"]
            chain.append(sigmoid(z))
        assert (got[i].p_low_quality, got[i].p_toxic) == pytest.approx(chain, abs=1e-6)
        assert got[i].toxic == (got[i].p_toxic >= toxicity.THRESHOLD) and got[i].held_out == held(i)


def words_of(text):
    """(script, trigram hashes, letters) of every run of letters."""
    out, run = [], []
    for c in [*(text or ""), " "]:
        if c.isalpha():
            run.append(c)
        elif run:
            low = [ord(x.lower()) if len(x.lower()) == 1 else ord(x) for x in run]
            script = next((k for k, r in enumerate(langid.SCRIPTS.values(), 1) for a, b in r if a <= ord(run[0]) <= b), 0)
            code, grams = [0, 0, *low, 0], []
            for a, b, c2 in zip(code, code[1:], code[2:]):
                h = ((a * 0x9E3779B1) & M32) ^ ((b * 0x85EBCA77) & M32)
                h = ((h ^ ((c2 * 0xC2B2AE3D) & M32)) * 0x27D4EB2F) & M32
                grams.append(h >> (32 - langid.BITS))
            out.append((script, grams, len(run)))
            run = []
    return out


def test_language(spark, sf_dir, rows):
    docs, _ = rows
    langs = sorted({x for i, _, x in docs if x is not None and not held(i)})
    counts = {x: {} for x in langs}
    scripts = {x: [0] * (len(langid.SCRIPTS) + 1) for x in langs}
    for i, text, lang in docs:
        if lang is not None and not held(i):
            for script, grams, _ in words_of(text):
                scripts[lang][script] += 1
                for g in grams:
                    counts[lang][g] = counts[lang].get(g, 0) + 1
    size = 1 << langid.BITS
    totals = {x: sum(c.values()) for x, c in counts.items()}
    log = lambda x, g: math.log((counts[x].get(g, 0) + 0.3) / (totals[x] + 0.3 * size))
    allowed = [[scripts[x][s] / max(1, sum(scripts[x])) >= 0.01 for x in langs] for s in range(len(langid.SCRIPTS) + 1)]
    allowed = [a if any(a) else [True] * len(langs) for a in allowed]
    got = {r.doc_id: r for r in registry.op3_language_id(spark, sf_dir).collect()}
    assert sorted(got) == [i for i, _, _ in docs]
    for i, text, _ in docs:
        best, shares = [], []
        for script, grams, n in words_of(text):
            own = [sum(log(x, g) for g in grams) for x in langs]
            own = [s if ok else min(own) - 50 for s, ok in zip(own, allowed[script])]
            if not shares:
                best = [(s, [k]) for k, s in enumerate(own)]
            else:
                lead = max(range(len(langs)), key=lambda k: best[k][0])
                best = [(best[k][0] + own[k], [*best[k][1], k]) if best[k][0] >= best[lead][0] - langid.PENALTY else (best[lead][0] - langid.PENALTY + own[k], [*best[lead][1], k]) for k in range(len(langs))]
            shares.append(n)
        assert got[i].held_out == held(i)
        if not shares:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        path = max(best, key=lambda b: b[0])[1]
        weight = [sum(n for n, k in zip(shares, path) if k == x) for x in range(len(langs))]
        top = weight.index(max(weight))
        assert got[i].lang_pred == langs[top] and got[i].score == pytest.approx(weight[top] / sum(weight), abs=1e-6)
