from __future__ import annotations

import math

import numpy as np
import pytest
from larkspur.llm import hard_negatives as H
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<float>, label int, rank int, score string, v string"
LIMIT = 1 << 63


def brute(rows, label, scale=256):
    usable = []
    for i, v, lab in rows:
        if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, [math.floor(scale * float(np.float32(x))) for x in v], label(i, lab)))
    out = []
    for q, v, lab in {u[0]: u for u in sorted(usable, key=lambda u: (-len(u[1]), u[0]))}.values():
        if q % 100:
            continue
        scored = sorted((-max(-LIMIT, min(LIMIT - 1, sum(a * b for a, b in zip(v, w, strict=True)))), i, other) for i, w, other in usable if i != q and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == lab][:5]:
            far = [(i, -t) for t, i, other in scored if other != lab and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(q, p, n, i, -s, t) for n, (i, t) in enumerate(far, 1)]
    return sorted(out)


def shifted(i, lab):
    return (lab + 1) % 10 if i % 7 == 0 else lab


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, v, lab, 1, "x", "y") for i, v, lab in rows], VECTORS).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, H.mine_hard_negatives(df, F.col("vec_id") % 100 == 0, label, **more).collect()))


def unit(rng, dim, n, around=None):
    x = rng.normal(size=(n, dim)) if around is None else around + 0.5 * rng.normal(size=(n, dim))
    return [[float(v) for v in row / np.linalg.norm(row)] for row in x]


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in {"ANCHOR_TILE": 3, "BLOCK": 2, "TILE": 7, "FAN": 2, "PAIRS": 5, "SPARSE": 0.5}.items():
            monkeypatch.setattr(H, name, value)
    rng = np.random.default_rng(7)
    n = 260 if small else 1300
    centres = rng.normal(size=(3, 12))
    rows = [(i, v, int(rng.integers(0, 4))) for i, v in enumerate(unit(rng, 12, n, centres[rng.integers(0, 3, n)]))]
    rows += [(5000 + i, rows[i % 5][1], i % 3) for i in range(30)]  # ties in and across labels
    rows += [(8000, None, 1), (8001, [1.0, None] + [0.0] * 10, 1), (8100, [float("nan")] * 12, 1), (8200, [float("inf")] * 12, 2), (None, rows[1][1], 1), (8300, rows[2][1], None), (8400, [], 1)]
    rows += [(8500, [1.0, 2.0], 1), (8501, [2.0, 1.0], 1), (8502, [0.9, 0.9], 2), (8503, [1.0, 0.7], 1)]  # another dimension
    rows += [(7, rows[7][1], rows[7][2])]  # a repeated row
    expected = brute(rows, shifted)
    assert len(expected) > 100
    assert mined(spark, rows) == expected


def test_large_components(spark):
    big = [(0, [1e9, 1.0, 0.0], 1), (1, [1e9, 2.0, 0.0], 1), (2, [6e8, -5.0, 0.0], 2), (3, [3e38, 1.0, 1.0], 1), (4, [5e8, 3.0, 0.0], 3), (5, [0.5, 0.25, 0.0], 2), (6, [-1e9, 1.0, 3.0], 2), (100, [0.5, 0.5, 0.5], 2), (101, [0.25, 0.75, 0.0], 2), (102, [0.25, 0.5, 0.0], 1)]
    expected = brute(big, shifted)
    assert expected and mined(spark, big) == expected


def test_few_none_and_negative_positives(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0, 0.0], 1)]) == []
    rows = [(100, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [-0.5, 0.0], 2), (3, [0.0, 1.0], 1), (4, [0.0, -1.0], 2)]
    assert mined(spark, rows) == brute(rows, shifted) == [(100, 3, 1, 4, 0, 0)]


def test_intervals_drop_pairs_early():
    """Few pairs are alive at the last plane: the rest was dropped by intervals, and none that belongs to the result."""
    rng = np.random.default_rng(3)
    q, c = (rng.integers(-256, 256, size=(n, 32)) for n in (20, 3000))
    truth = q @ c.T
    low = np.full((20, 1), -LIMIT, dtype=np.float64)
    a, r, s = H.sliced(q.astype(np.float64), c, np.ones(truth.shape, dtype=bool), low, -low, 10)
    assert (truth[a, r] == s).all()
    kept = set(zip(a.tolist(), r.tolist(), strict=True))
    for i in range(20):
        assert {(i, j) for j in np.flatnonzero(truth[i] >= np.sort(truth[i])[-10])} <= kept
    assert len(kept) < truth.size * 0.02


def test_exact_and_double_sums_agree():
    rng = np.random.default_rng(5)
    q, c = (rng.integers(-300, 300, size=(n, 9)) for n in (6, 80))
    high = np.full((6, 1), LIMIT - 1)
    runs = [H.sliced(H._python_ints(q), H._python_ints(c), np.ones((6, 80), dtype=bool), (-high).astype(object), high.astype(object), 3)]
    runs.append(H.sliced(q.astype(np.float64), c, np.ones((6, 80), dtype=bool), (-high).astype(np.float64), high.astype(np.float64), 80))
    assert [sorted(zip(*map(list, run), strict=True)) for run in runs][0] == sorted((i, j, int((q @ c.T)[i, j])) for i in range(6) for j in range(80))
    assert sorted(zip(*map(list, runs[0]), strict=True)) == sorted(zip(*map(list, runs[1]), strict=True))
