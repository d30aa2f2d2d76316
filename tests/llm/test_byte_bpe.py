from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import regex
import tiktoken
from helpers import prose
from hypothesis import given, settings
from hypothesis import strategies as st
from larkspur.llm import byte_bpe as B

PATH, PATTERN = str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1 \n\t'é.日\xa0 ", max_size=120), st.integers(1, 30))
def test_cuts_keep_the_matches(text, size):
    parts = list(B.pieces(text, size))
    assert "".join(parts) == text
    assert [m for p in parts for m in regex.findall(PATTERN, p)] == regex.findall(PATTERN, text)


def test_documents(spark):
    rng = random.Random(1)
    texts = ["", None, "Hello world", "a" * 250_000, " " * 150_000 + "x", prose(rng, 60_000), "日本語 é́ 🎉🎉 <|endoftext|>", "it's we'll\r\n\tx  y", "Hello world"]
    df = spark.createDataFrame([(i % 8, t, 1, "z") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, ids_sha256 string")
    enc = reference()
    got = B.encode_documents(df, PATH, PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]
    expected = []
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        expected.append((i % 8, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    back = B.decode_documents(got, PATH, PATTERN).select("ids_sha256", "decoded_bytes").collect()
    assert {r.ids_sha256: bytes(r.decoded_bytes) for r in back} == {e[2]: (t or "").encode() for e, t in zip(expected, texts, strict=True)}
    assert B.encode_documents(df.where("false"), PATH, PATTERN).count() == 0


def test_decoding_cuts_inside_characters():
    ids = B.encode("é", PATH, PATTERN) + B.encode("日", PATH, PATTERN)
    assert b"".join(B.decode([i], PATH, PATTERN) for i in ids) == "é日".encode()


def test_other_patterns():
    """A pattern whose matches reach over the usual cuts is never cut."""
    wide = r"\p{L}+ \p{L}+|\s+|\S"
    assert B.cuts_are_safe(PATTERN) and not B.cuts_are_safe(wide) and not B.cuts_are_safe(r"\S+\s?|\s+")
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("y", pat_str=wide, mergeable_ranks=ranks, special_tokens={})
    text = "uno dos tres " * 40
    assert B.encode(text, PATH, wide, size=20) == enc.encode_ordinary(text)
