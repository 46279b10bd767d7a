import hashlib
import random
import zlib

import pytest

from quarry.llm import periodic as P
from quarry.llm import registry


def brute(words, least=P.LEAST):
    """Runs by comparing all words with those each possible period away."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            stretch = words[i : i + length]
            if length >= max(least, 2 * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(60))
def test_runs_against_brute_force(seed):
    rnd = random.Random(seed)
    least = rnd.choice([2, 5, 12, 12])
    docs = []
    for _ in range(6):
        words = [rnd.choice([b"a", b"b", b"cc", b"d"][: rnd.randint(1, 4)]) for _ in range(rnd.randint(0, 70))]
        if words and rnd.random() < 0.6:
            a, p = rnd.randrange(len(words)), rnd.randint(1, 12)
            words = words[:a] + (words[a : a + p] * 70)[: len(words) - a]
        docs.append(words)
    expected = [brute(w, least) for w in docs]
    assert [[tuple(r) for r in x.tolist()] for x in P.runs_of_documents(docs, least)] == expected
    codes = {b"a": 1, b"b": 2, b"cc": 3, b"d": 4}
    bare = P.runs_of([[codes[w] for w in d] for d in docs], least)  # whole documents, no part left out
    assert [[tuple(r) for r in x.tolist()] for x in bare] == expected


def test_words_outside_parts_lie_in_no_run():
    rnd = random.Random(5)
    words = [b"%d" % rnd.randrange(400) for _ in range(3000)]
    words[500:600] = words[500:510] * 10
    words[2000:2040] = words[2000:2020] * 2
    runs = P.runs_of_documents([words])[0]
    assert [tuple(r) for r in runs.tolist()] == brute(words) and len(runs) >= 2


def test_long_text_of_one_word():
    assert P.runs_of_documents([[b"x"] * 20_000])[0].tolist() == [[0, 20_000, 1]]


def test_edge_rows(spark):
    again = "one two three " * 5
    rows = [(1, None, "n"), (2, "", "n"), (3, " \t\n", "n"), (None, again, "n"), (4, again, "n"), (4, again, "n"), (5, "plain words\u00a0here", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = P.periodic_runs(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got}
    assert by == {1: (0, [], ""), 2: (0, [], ""), 3: (0, [], ""), None: (15, [(0, 15, 3)], "one two three"), 4: (15, [(0, 15, 3)], "one two three"), 5: (2, [], "plain words\u00a0here")}
    assert P.periodic_runs(docs.limit(0)).count() == 0
    assert P.periodic_runs(docs.where("doc_id = 5"), edit=lambda i, w: w[:1] * 12).collect()[0].collapsed == "plain"


def test_query_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = registry.op11_periodic_runs(spark, sf_dir).collect()
    assert len(rows) == len(texts) and sum(r.n_runs for r in rows) > 20
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    checked = 0
    for r in rows:
        words = (texts[r.doc_id] or "").encode().split()
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 1500:  # the plain version takes the square of a text's words
            continue
        checked += 1
        runs = brute(words)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        left = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
        assert tuple(r)[:6] == (r.doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None)
        assert (r.runs_sha256, r.collapsed_sha256) == (sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(left))
    assert checked > 0.9 * len(rows)
