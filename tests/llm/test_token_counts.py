import random
import sys

import pytest
import sentencepiece

from quarry.llm import registry
from quarry.llm import token_counts as C
from quarry.llm.tables import table

sys.path.insert(0, "/opt/tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def odd(n):
    rnd = random.Random(n)
    signs = ["a", "b", "The", " ", "  ", "\t", "\n", "\r\n", "▁", " ", "　", "é", "é", "ﬁ", "漢字", "я", "😀", "👩‍👧", "</s>", "<s>", "<unk>", "1", "23", ".", "…", "\x00", "​", "ＡＢ"]
    return ["".join(rnd.choice(signs) for _ in range(rnd.randrange(1, 12))) for _ in range(n)]


def test_lengths_of_odd_strings_add_up(library):
    known = C._Lengths(PATH, {})
    for text in odd(20_000):
        assert sum(map(known.__getitem__, C.pretokens(text))) == len(library.encode(text)), repr(text)


def test_query_against_the_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}
    rows = registry.op4_token_counts(spark, sf_dir).collect()
    expected = {i: (len(t.encode()), len(library.encode(t)), len(library.encode(t)) > 4096) for i, t in texts.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == expected and len(rows) == len(texts)


@pytest.mark.parametrize("table_size", [0, 3, C.TABLE_SIZE])
def test_edge_rows(spark, library, monkeypatch, table_size):
    long = "many words of a long text " * 40_000
    data = [(1, None), (2, ""), (3, " "), (4, long), (5, "x" * 100_000), (6, "same row"), (6, "same row"), (None, "no id")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in data], "`doc.id` long, text string, n_tokens string, n_bytes int")
    rows = C.count_tokens(docs, PATH, id_col="doc.id", table_size=table_size).collect()
    expected = sorted(((i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t in data), key=str)
    assert sorted((tuple(r) for r in rows), key=str) == expected
    assert C.count_tokens(docs.limit(0), PATH, id_col="doc.id").count() == 0


def test_full_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(C, "CACHE_SIZE", 5)
    known = C._Lengths(PATH, {"the": len(library.encode("the"))})
    for text in odd(500):
        assert sum(map(known.__getitem__, C.pretokens(text))) == len(library.encode(text))
        assert len(known) <= 6 and "the" in known


def test_the_frequent_ones_come_from_a_bounded_sample(spark):
    docs = spark.createDataFrame([(i, "often often rare%d" % i) for i in range(2000)], "doc_id long, text string")
    found = C.frequent_pretokens(docs, size=10, texts=200)
    assert len(found) == 10 and max(found, key=found.get) == "often" and 250 < found["often"] < 600
