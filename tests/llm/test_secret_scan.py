import hashlib
import random
import re
from collections import Counter

import pytest

from quarry.llm import registry
from quarry.llm import secret_scan as S

RANKS = {w: i for i, w in enumerate(["password", "secret", "horse", "battery", "the", "correct", "staple", "rse"], 1)}


def all_cuts(value, pieces):
    """The fewest bits over all cuts, each written out."""
    if not value:
        return 0.0
    best = float("inf")

    def go(at, bits, brute):
        nonlocal best
        if at == len(value):
            best = min(best, bits)
            return
        go(at + 1, bits + S._char_bits(value[at]) + (0 if brute else S.CUT_BITS), True)
        for i, j, b in pieces:
            if i == at:
                go(j, bits + b + S.CUT_BITS, False)

    go(0, 0.0, False)
    return best - S.CUT_BITS


@pytest.mark.parametrize("seed", range(40))
def test_cheapest_cut_against_all_cuts(seed):
    rnd = random.Random(seed)
    parts = ["password", "P@ss", "h0rse", "the", "aaaa", "ababab", "qwert", "1999", "19991231", "x", "9", "#", "Q", "é", "12-31-2020"]
    value = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 4)))[:14]
    pieces = [*S._pieces(value, RANKS), *S._repeats(value, RANKS)]
    assert all(0 <= i < j <= len(value) and b >= 0 for i, j, b in pieces)
    assert S.guess_bits(value, RANKS) == pytest.approx(all_cuts(value, pieces))


def test_order_of_guesses():
    bits = lambda v: S.guess_bits(v, RANKS)
    assert bits("password") < bits("Password") < bits("P@ssw0rd") < bits("passw9qd") < bits("xq#9Lm2v!R")
    assert bits("aaaaaaaaaaaa") < 12 and bits("abcabcabcabc") < 20 and bits("qwertyuiop") < 12 and bits("1999-12-31") < 20 and bits("abcdefgh") < 12
    assert bits("correcthorsebatterystaple") < S.SECRET_BITS < bits("04dbebab91ab85687d33") and bits("") == 0
    assert bits("a" * 5000) < 20  # one repeat, whatever its length


FIXED = [
    ("password: hunter22", "assign:0:18"),
    ("PassWD='abcdef' x", "assign:0:14"),
    ("token = abcde", ""),  # five characters
    ("api_key:abcdefg apikey=abcdefg", "assign:0:15,assign:16:30"),
    ("secret=token=abcdef", "assign:0:19"),
    ("secret=token: abcdefgh", ""),  # the first match takes `token` and is dropped; what is left of `:` has no name
    ("ſecret=abcdef toKen=abcdef", ""),  # letters that only Unicode folds to s and k
    ("é AKIA" + "A1" * 8, "access:2:22"),
    ("AKIA" + "A" * 15, ""),
    ("ñ " + "0f" * 12 + "g", "hex:2:26"),
    ("0f" * 11, ""),
    ("token=" + "ab" * 12, "assign:0:30,hex:6:30"),
    ("my pwd: xK9#mQ2$vL7!xZ.", "guess:8:22"),
    ("é passphrase is Zx81-kkQ-77vB-plm3, ok", "guess:16:34"),
    ("postgres://bob:Zq81kdXw92hV@host/db", "guess:15:27"),
    ("the password is horsebatterystaple", ""),
    ("pass: ${SECRET_FROM_ENV_VAR_9912}, pwd: getPassword(user91, 'x')", ""),
]


@pytest.mark.parametrize("text, expected", FIXED)
def test_fixed_texts(text, expected):
    assert ",".join(f"{S.KINDS[k]}:{a}:{b}" for k, a, b, _ in S.spans_of(text, RANKS)) == expected


def base(text):
    """The base patterns as they are given, on characters."""
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], S.KINDS.index(s[0])))


@pytest.mark.parametrize("seed", range(30))
def test_base_spans_against_the_given_patterns(seed):
    rnd = random.Random(seed)
    parts = ["password", "Token", "SECRET", "api", "_", "Key", "passwd", " ", "  ", ":", "=", '"', "'", "abc", "é", "ZZ9", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "deadbeef", "\n", ".", "-", "K"]
    text = "".join(rnd.choice(parts) for _ in range(300))
    assert [(S.KINDS[k], a, b) for k, a, b, _ in S.spans_of(text, {}) if k < 3] == base(text)


def test_ranks_come_from_all_texts(spark):
    rows = [("Word word. WORD",), ("other, word",), (None,), ("",), ("ab été été x1y 77",), ("password: zzzz " * 50,)]
    ranks = S.word_ranks(spark.createDataFrame(rows, "text string"), most=4)  # password comes 50 times
    assert "ab" not in ranks and "other" in ranks
    start = len(S.COMMON)
    assert ranks["word"] == start + 1 and ranks["été"] == start + 2 and ranks["other"] == start + 3 and "zzzz" not in ranks and len(ranks) == start + 3
    assert S.word_ranks(spark.createDataFrame([], "text string")) == {w: i for i, w in enumerate(S.COMMON, 1)}


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "token=abcdefgh", "x"), (3, "token=abcdefgh", "x"), (3, "token=abcdefgh", "x"), (4, "word " * 50_000 + "é token=abcdefgh", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = [(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans]) for r in S.scan_secrets(docs, {}).collect()]
    one = [("assign", 0, 14)]
    assert sorted(got, key=str) == sorted([(1, []), (2, []), (None, one), (3, one), (3, one), (4, [("assign", 250_002, 250_016)])], key=str)
    assert S.scan_secrets(docs.limit(0), {}).count() == 0


def test_query_against_the_given_patterns(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = registry.op13_secret_scan(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = base(texts[r.doc_id])
        n = Counter(k for k, _, _ in spans)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (n["assign"], n["access"], n["hex"], hashlib.sha256(joined.encode()).hexdigest())
        assert [s for s in r.spans.split(",") if not s.startswith("guess")] == joined.split(",")
