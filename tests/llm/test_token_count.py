import random

import public_tokenizers
import pytest
import sentencepiece

from prefixloom.llm import token_count

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "\n", " \n ", "a", "a ", "a  b", " a", "  a\n  b\n", "▁x ▁ y", "漢字 🙂🙂 x\ty\r\nz", "<s> </s> <unk> <0x0A>",
    "\n\na", "é" * 50, "x" * 5000, "\x00a", "a b", "ＡＢＣ ①", "  \n\n  a   ", "word " * 3000,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_counts_match_the_library(spark, library):
    rng = random.Random(0)
    texts = TEXTS + ["".join(rng.choice(["a", "b", " ", "  ", "the", "\n", "é", "▁", "漢", "ing", "\t", "!"]) for _ in range(rng.randint(1, 14))) for _ in range(500)]
    docs = spark.createDataFrame([(i, t, "other") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.counted(docs, PATH, limit=1000).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or ""))
        assert got[i] == (len((t or "").encode()), n, n > 1000), t


def test_cache_is_bounded(monkeypatch, library):
    monkeypatch.setattr(token_count, "CACHED", 3)
    t = token_count.Tokens(open(PATH, "rb").read())
    text = "some words that are many and some that are not"
    assert t.count(text) == len(library.encode(text))
    assert len(t.marked) <= 3


def test_empty_table(spark):
    assert token_count.counted(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
