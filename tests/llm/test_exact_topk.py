from __future__ import annotations

import math

import numpy as np
import pytest
from larkspur.llm import exact_topk as X
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<float>, score int, rank string"


def brute(rows, k=10):
    usable = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, [math.floor(1024 * float(np.float32(x))) for x in v]))
    out = []
    for q, v in {i: (i, v) for i, v in usable if i % 100 == 0}.values():
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in usable if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("tile", [(3, 5), (512, 4096)])
def test_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(X, "QUERY_TILE", tile[0])
    monkeypatch.setattr(X, "TILE", tile[1])
    monkeypatch.setattr(X, "BLOCK", 2 if tile[0] == 3 else 512)
    monkeypatch.setattr(X, "FAN", 2 if tile[0] == 3 else 16)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(700)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 6), (2002, [float("nan")] * 8), (2100, [float("inf")] * 8), (None, [1.0] * 8), (2200, [1.0, 2.0]), (2201, [3.0, 1.0]), (2300, []), (2400, [1e9] * 8), (2401, [3e15] * 8), (2600, [5e15, -5e15, 1.0] + [0.0] * 5), (2601, [3e38, 1.0] + [0.0] * 6), (500, rows[500][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], VECTORS)
    got = sorted(map(tuple, X.exact_topk(df, F.col("vec_id") % 100 == 0).collect()))
    expected = brute([r for n, r in enumerate(rows) if n != len(rows) - 1])
    both = {(q, r): s for q, r, _, s in expected}
    # the repeated row of 500 is a candidate of the others twice
    assert {q for q, _, _, _ in got} == {q for q, _ in both}
    twice = {q for q, _, i, _ in expected if i == 500}
    assert [x for x in got if x[0] not in twice] == [x for x in expected if x[0] not in twice]


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0], 1, ""), (1, [2.0], 1, "")], VECTORS)
    assert sorted(map(tuple, X.exact_topk(df, F.col("vec_id") % 100 == 0).collect())) == [(0, 1, 1, 1024 * 2048)]
    assert X.exact_topk(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_products_beyond_doubles():
    q = np.array([[1 << 40, 1]], dtype=np.int64)
    c = np.array([[1 << 14, 1], [1 << 14, 0]], dtype=np.int64)
    assert X._products(q, c).tolist() == [[(1 << 54) + 1, 1 << 54]]


def test_rows_that_share_an_id(spark):
    """The query of a repeated id is the vector with the fewest components, then the least by their bytes, whatever the order of rows."""
    rows = [(0, [3.0, 1.0]), (0, [1.0, 1.0]), (0, [9.0]), (1, [2.0, 0.0]), (2, [5.0]), (3, [4.0])]
    expected = [(0, 1, 2, 45 << 20), (0, 2, 3, 36 << 20)]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        df = spark.createDataFrame([(i, v, 1, "x") for i, v in order], VECTORS).repartition(3)
        assert sorted(map(tuple, X.exact_topk(df, F.col("vec_id") % 100 == 0).collect())) == expected


def test_components_of_any_size():
    x = np.array([[2.0**70, 1.0], [1.0, -1.0]])
    assert X._products(x, x).tolist() == [[2**63 - 1, 2**63 - 1], [2**63 - 1, 2]]
    assert X._products(x[1:], np.array([[2.0**60, 2.0**60 + 256]])).tolist() == [[-256]]
