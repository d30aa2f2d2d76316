from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from larkspur.llm import whitening as W

VECTORS = "vec_id long, embedding array<float>, label int, component string, n int, whitened string"
LIMIT = 1 << 63


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, "y") for i, v in rows], VECTORS).repartition(3)


def brute(rows, scale=64, offset=1_000_000):
    """id -> deviation, the exact covariance, n and the rows that take part."""
    used = [(i, [max(-(1 << 62), min(1 << 62, math.floor(scale * float(np.float32(c))))) + offset for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, dim = len(used), len(used[0][1])
    sums = [sum(x[j] for _, x in used) for j in range(dim)]
    deviation = sorted((i, min(LIMIT - 1, sum((n * x[j] - sums[j]) ** 2 for j in range(dim)))) for i, x in used)
    centred = [[Fraction(n * x[j] - sums[j], n) for j in range(dim)] for _, x in used]
    covariance = np.array([[float(sum(r[a] * r[b] for r in centred) / n) for b in range(dim)] for a in range(dim)])
    return deviation, covariance, n, np.array([[float(c) for c in r] for r in centred]), [i for i, _ in used]


def held(spark, rows, count=32):
    got = W.whiten(table(spark, rows), count).collect()
    deviation, covariance, n, centred, ids = brute(rows)
    dim = len(covariance)
    k = min(count, dim)
    assert len(got) == n * k and {r["n"] for r in got} == {n}
    assert sorted((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == deviation
    values = np.linalg.eigvalsh(covariance)[::-1][:k]
    for r in got:
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(covariance), rel=1e-4, abs=1e-12)
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and errors.pop() <= 1e-4
    return got, covariance, centred, ids


def test_against_exact_sums(spark):
    rng = np.random.default_rng(2)
    spread = np.linspace(0.1, 3, 9)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(rng.normal(size=(150, 9)) @ np.diag(spread))]
    rows += [(500, None), (501, [1.0, None] + [0.0] * 7), (502, [float("nan")] * 9), (503, [float("-inf")] * 9), (504, [])]
    rows += [(None, rows[4][1]), (3, rows[3][1]), (3, rows[7][1])]  # null and repeated ids stay
    got, covariance, centred, ids = held(spark, [r for r in rows if r[0] is not None] + [(-1, rows[4][1])])
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    for component in range(1, 10):
        mine = {}
        for r in got:
            if r["component"] == component:
                mine.setdefault(r["vec_id"], []).append(r["whitened"])
        expected = {}
        for i, w in zip(ids, centred @ axes[:, component - 1] / math.sqrt(values[component - 1]), strict=True):
            expected.setdefault(i, []).append(w)
        sign = 1 if mine[10][0] * expected[10][0] > 0 else -1
        for i, some in expected.items():
            assert sorted(sign * w for w in mine[i]) == pytest.approx(sorted(some), abs=1e-9)
    assert sum(r["vec_id"] is None for r in W.whiten(table(spark, rows)).collect()) == 9


def test_fewer_components_and_other_dimensions(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(rng.normal(size=(40, 6)))]
    got, *_ = held(spark, rows, count=2)
    assert {r["component"] for r in got} == {1, 2}
    more = [(1000 + i, [1.0, float(i)]) for i in range(39)]
    assert sorted(map(tuple, W.whiten(table(spark, rows + more), 2).select("vec_id", "deviation").collect())) == sorted((r["vec_id"], r["deviation"]) for r in got)


def test_without_variance(spark):
    """Constant columns and fewer rows than dimensions: such components explain nothing and whiten to null."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(a), 5.0, float(a) * 2, float(b)]) for i, (a, b) in enumerate(rng.integers(-9, 9, size=(30, 2)))]
    got, *_ = held(spark, rows)
    assert {(r["component"], r["whitened"] is None, r["explained"] == 0) for r in got} == {(1, False, False), (2, False, False), (3, True, True), (4, True, True)}
    one = W.whiten(table(spark, [(7, [1.0, 2.0])])).collect()
    assert sorted(map(tuple, one)) == [(7, c, 1, 0, None, 0.0, 0.0) for c in (1, 2)]


def test_empty(spark):
    for rows in ([], [(1, None), (2, [float("nan")])]):
        out = W.whiten(table(spark, rows))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


def test_large_components(spark):
    rows = [(i, v) for i, v in enumerate([[1e9, 1.0], [-2e9, 3.0], [5e8, -7.0], [3e38, 0.5], [1e10, 2.0]])]
    got = W.whiten(table(spark, rows)).collect()
    deviation, *_ = brute(rows)
    assert sorted((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == deviation


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(-(1 << 62), 1 << 62), min_size=3, max_size=3), min_size=1, max_size=40))
def test_residues_give_exact_scatter(rows):
    x = np.array(rows, dtype=np.int64)
    size = max(abs(v) for row in rows for v in row)
    moduli = W.primes(2 * len(rows) * max(size, 1) ** 2 + 1)
    found = W.reconstruct({p: W.residue_products(x, p) for p in moduli})
    exact = x.astype(object)
    assert (found == exact.T @ exact).all()


def test_partial_products_stay_exact(monkeypatch):
    x = np.full((3 * W.ROWS + 5, 2), (1 << 20) // 2 - 3, dtype=np.int64)
    p = W.primes(1)[0]
    assert (W.residue_products(x, p) == (len(x) * int(x[0, 0]) ** 2) % p).all()


def test_wide_vectors_and_many_tasks(spark):
    """More sums than one row of a partial scatter holds; the number of tasks changes nothing."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(rng.normal(size=(90, 70)))]
    df = table(spark, rows)
    scatter = [W.exact_scatter(df.repartition(p).select("embedding"), 70, 90, 2_000_000, 64, 1_000_000) for p in (1, 7)]
    exact = W.whole(np.array([[np.float32(c) for c in v] for _, v in rows], dtype=np.float64), 64, 1_000_000).astype(object)
    for found, sums in scatter:
        assert (found == exact.T @ exact).all() and (sums == exact.sum(axis=0)).all()
