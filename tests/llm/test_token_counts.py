from __future__ import annotations

import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from larkspur.llm import token_counts as T
from larkspur.llm.byte_bpe import _encoding
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helpers import prose

PIECES, RANKS, WORDS, BYTES = (P.path(f) for f in ("piece_bpe_32k.model", "byte_bpe_50k.tiktoken", "word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["", " ", "   ", "\n\n a  b\t\r\n;\r x", "<s></s><unk> <|endoftext|>x", "日本語 テスト", "é é ﬁ ①", "▁a ▁▁ b", "\0 a\0b", "𝒳𝒴 z", "<0x0A> x", "x y \x01 \x01a", " don't  WON'T 12 345", "a" * 3000, "日" * 3000, " " * 1000, "hello world " * 300, "x\n" * 500]


def library(path):
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    if path.endswith(".json"):
        model = Tokenizer.from_file(path)
        return lambda text: len(model.encode(text, add_special_tokens=False).ids)
    model = _encoding(path, P.PATTERN)
    assert isinstance(model, tiktoken.Encoding)
    return lambda text: len(model.encode_ordinary(text))


@pytest.mark.parametrize("path", [PIECES, RANKS, WORDS, BYTES])
def test_sums_over_pre_tokens(path):
    """Pieces of pre-tokens add up to what the library gives for the whole text."""
    cut, whole = T.counter(path, P.PATTERN), library(path)
    for text in [*ODD, *(prose(random.Random(i), 200) for i in range(5))]:
        tokens = [t for some in cut.pre_tokens(text) for t in some]
        assert sum(cut.count(tokens)) == whole(text), text[:40]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,;'ab1é▁日<s>"), st.characters(exclude_categories=["Cs"])), max_size=60), st.sampled_from([1, 3, 1 << 18]))
def test_cuts_never_change_pieces(text, chunk):
    cut, before = T.counter(PIECES), T.CHUNK
    T.CHUNK = chunk
    try:
        tokens = [t for some in cut.pre_tokens(text) for t in some]
    finally:
        T.CHUNK = before
    assert "".join(tokens) == ("▁" + text.replace(" ", "▁") if text else "")
    assert sum(cut.count(tokens)) == library(PIECES)(text)


@pytest.mark.parametrize(("path", "common", "chars"), [(PIECES, 1_000_000, 64), (PIECES, 20, 64), (PIECES, 1_000_000, 3), (PIECES, 1, 0), (RANKS, 30, 5), (WORDS, 30, 64)])
def test_documents(spark, monkeypatch, path, common, chars):
    """Common and rare pre-tokens, in any share, give the library's counts; rows repeat, null counts as empty."""
    monkeypatch.setattr(T, "COMMON", common)
    monkeypatch.setattr(T, "COMMON_CHARS", chars)
    monkeypatch.setattr(T, "HELD", 50)
    monkeypatch.setattr(T, "ROWS", 4)
    texts = [None, *ODD, *(prose(random.Random(i), 120) for i in range(12)), prose(random.Random(3), 5000)]
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(3, texts[20], "x", 1), (3, texts[20], "x", 1), (None, texts[21], "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, token string, place int").repartition(3)
    whole = library(path)
    n = [whole(t or "") for _, t, _, _ in rows]
    expected = Counter((r[0], len((r[1] or "").encode()), k, k > 50) for r, k in zip(rows, n, strict=True))
    assert Counter(map(tuple, T.count_tokens(df, path, P.PATTERN, limit=50).collect())) == expected


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.count_tokens(df, PIECES).collect() == []
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for name in ("row", "place", "known", "rare", "at", "more", "token", "a.b"):
        df = df.withColumn(name, F.struct(F.lit(1).alias("x.y")))
    got = T.count_tokens(df, PIECES, keep=("doc_id", "row", "place", "at", "more", "a.b"))
    assert got.columns == ["doc_id", "row", "place", "at", "more", "a.b", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got.collect()) == [(1, 3, 2), (2, 0, 0)]


def test_each_distinct_pre_token_is_counted_once(spark, tmp_path):
    text = prose(random.Random(1), 300)
    df = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string").repartition(4)
    load = lambda: T.counter(PIECES)
    got = df.select("text").mapInArrow(T._frequencies(load), "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    expected = Counter(t for some in load().pre_tokens(text) for t in some)
    assert {r["token"]: r["n"] for r in got} == {t: 40 * n for t, n in expected.items()}


def test_other_normalisers_are_refused(tmp_path, monkeypatch):
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "normalize", lambda self, text: text)
    T.counter.cache_clear()
    with pytest.raises(ValueError, match="normaliser"):
        T.counter(PIECES)
    T.counter.cache_clear()
