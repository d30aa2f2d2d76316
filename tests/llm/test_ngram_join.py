from __future__ import annotations

import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from helpers import edited, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from larkspur.llm import ngram_join as N
from larkspur.llm import wordhash as H
from larkspur.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(pairs):
    return [(i, t, "en", "src0", 0) for i, t in pairs]


def shingle_set(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def brute(pairs, t=Fraction(3, 4)):
    """(doc_id, n, component) of rows; equal ids are different rows of one name."""
    sets = [shingle_set(t) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if pairs[i][0] is not None and pairs[j][0] is not None and common and common >= t * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(pairs):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, len(s), None if k is None else least[find(i)]) for i, ((k, _), s) in enumerate(zip(pairs, sets, strict=True)) if k is not None), sum(k is None for k, _ in pairs)


def corpus(seed, groups=6, size=14):
    rng = random.Random(seed)
    common = prose(rng, 60)
    out = []
    for _ in range(groups):
        base = prose(rng, rng.randint(30, 160))
        out += [edited(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.06])) for _ in range(size)]
    out += [prose(rng, 20) + " " + common + " " + prose(rng, rng.randint(1, 60)) for _ in range(25)]
    out += [common + " " + prose(rng, rng.randint(1, 6)) for _ in range(8)]
    out += ["", "  \n", None, "one", "one", "One", "one two", "one two three four five", "one two three four five", "ONE two three four five six"]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(N, "TILE", 4)
    monkeypatch.setattr(N, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(N, "FEW_TOKENS", 4_000_000 if seed == 1 else 0)
    pairs = corpus(seed)
    got = N.near_duplicate_classes(spark.createDataFrame(rows(pairs), DOCS)).collect()
    assert sorted(map(tuple, got)) == brute(pairs)[0]


@pytest.mark.parametrize("t", [Fraction(1, 5), Fraction(1, 3), Fraction(9, 10)])
def test_other_thresholds(spark, t, monkeypatch):
    """Sets of very different sizes link at low thresholds; pivots alone don't find all of them."""
    monkeypatch.setattr(N, "TILE", 4)
    monkeypatch.setattr(N, "FEW", 2)
    monkeypatch.setattr(N, "SPLIT", 8)
    rng = random.Random(9)
    out = []
    for _ in range(12):
        base = prose(rng, 200).split(" ")
        for _ in range(20):
            at, n = rng.randint(0, 120), rng.choice([20, 40, 60, 80])
            out.append(edited(rng, " ".join(base[at : at + n]), 0.02))
    pairs = list(enumerate(out))
    got = N.near_duplicate_classes(spark.createDataFrame(rows(pairs), DOCS), t).collect()
    assert sorted(map(tuple, got)) == brute(pairs, t)[0]


@pytest.mark.parametrize("cheap", [0, 10**9])
def test_frequent_tokens_in_several_groups(spark, monkeypatch, cheap):
    """With and without further pivots, and with tokens dealt to many groups."""
    monkeypatch.setattr(N, "SPLIT", 4)
    monkeypatch.setattr(N, "SALTS", 3)
    monkeypatch.setattr(N, "CHEAP", cheap)
    monkeypatch.setattr(N, "WORTH", 0.0)
    pairs = corpus(3, groups=2, size=60)
    got = N.near_duplicate_classes(spark.createDataFrame(rows(pairs), DOCS).repartition(5)).collect()
    assert sorted(map(tuple, got)) == brute(pairs)[0]


def test_hard_cases(spark):
    rng = random.Random(5)
    base = prose(rng, 80)
    pairs = [(3, base), (3, base), (7, edited(rng, base, 0.01)), (7, "else " * 9), (None, base), (None, None), (5, "x" * 3_000_000), (6, ("word " * 300_000)), (2, base)]
    df = spark.createDataFrame([(i, t, 1, "c", b"m") for i, t in pairs], "doc_id long, text string, node int, root string, sig binary")
    got = N.near_duplicate_classes(df).collect()
    expected, nulls = brute(pairs)
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == expected
    assert [r.component_id for r in got if r.doc_id is None] == [None] * nulls
    assert sorted((r.doc_id or -1) for r in N.drop_near_duplicates(df).collect()) == sorted((k or -1) for k in [None, None, 2, 5, 6] + [k for k, _, c in expected if k == c and k not in (2, 5, 6)])


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert N.near_duplicate_classes(df).collect() == []
    assert N.drop_near_duplicates(df).columns == df.columns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 30), max_size=20), max_size=12), st.lists(st.frozensets(st.integers(0, 30), min_size=1, max_size=20), max_size=5), st.sampled_from([(3, 7), (1, 6), (9, 19)]))
def test_prefix_tree(sets, probes, need):
    array = lambda s: np.array(sorted(s), dtype=np.uint64)
    tree = N.PrefixTree.build([(i, array(s)) for i, s in enumerate(sets)])
    num, den = need
    got = sorted(tree.join([array(p) for p in probes], num, den))
    assert got == [(j, i, len(s & p)) for j, p in enumerate(probes) for i, s in enumerate(sets) if den * len(s & p) >= num * (len(s) + len(p))]


@settings(max_examples=60, deadline=None)
@given(st.frozensets(st.integers(0, 2**64 - 1), min_size=1, max_size=80), st.frozensets(st.integers(0, 2**64 - 1), min_size=1, max_size=80))
def test_signatures_bound_the_difference(a, b):
    both = a & b | frozenset(list(a)[: len(a) // 2])
    b = b | both
    x, y = (np.frombuffer(N.signature(np.array(sorted(s), dtype=np.uint64)), dtype=np.uint64) for s in (a, b))
    size = min(len(x), len(y))
    assert np.bitwise_count(N.fold(x, size) ^ N.fold(y, size)).sum() <= len(a ^ b)


def test_limits_are_exact():
    t = Fraction(3, 4)
    for a in range(1, 40):
        for b in range(1, 40):
            need = min((o for o in range(min(a, b) + 1) if 4 * o >= 3 * (a + b - o)), default=None)
            if need is not None:
                assert N.allowed(a, b, t) >= a + b - 2 * need
                assert N.allowed(a, b, t) < a + b - 2 * (need - 1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\té.\x0b\xa0", max_size=40), max_size=6), st.integers(3, 9))
def test_words(texts, chunk):
    old, H.CHUNK = H.CHUNK, chunk
    try:
        words, at, first, end = H.words_with_spans(pa.array(texts, pa.string()))
    finally:
        H.CHUNK = old
    raw = "".join(texts).encode()
    split = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    assert [raw[a:b].decode() for a, b in zip(first, end, strict=True)] == [w for s in split for w in s]
    assert list(np.diff(at)) == [len(s) for s in split]
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for s in split for w in s]
    for i in range(len(lower)):
        for j in range(i):
            assert (words[i] == words[j]) == (lower[i] == lower[j])


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for u, v in edges:
        if u is not None and u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in root}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []
