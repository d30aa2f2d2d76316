"""Hard-negative mining: bit-sliced integer products whose score intervals tighten plane by plane."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import lean, materialize
from .vectors import usable

#: Anchors that go to a shard together; each tile of them sends all rows once more.
ANCHOR_TILE = 16_384
#: Anchors and rows whose scores are held at once.
BLOCK, TILE = 256, 4096
#: Below this share of pairs that may still qualify, pairs are gone on with one by one.
SPARSE = 0.1
#: Pairs whose components are held at once.
PAIRS = 32_768
#: Shards whose lists are merged at once.
FAN = 16
_LIMIT = 1 << 63


def _quantise(scale: int):
    """Rows of usable vectors with a label: the whole components as bytes, two a component where they fit, else those of a double."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.finfo(np.float64).max
        for batch in batches:
            ids, labels, anchors = (batch.column(c) for c in ("vec_id", "label", "is_anchor"))
            known = (ids.is_valid().to_numpy(zero_copy_only=False)) & (labels.is_valid().to_numpy(zero_copy_only=False))
            for at, x in usable(batch.column("embedding")):
                x, at = x[known[at]], at[known[at]]
                with np.errstate(over="ignore"):
                    x = np.clip(np.floor(x * scale), -most, most) + 0.0
                small = np.abs(x).max(axis=1, initial=0) < 1 << 15
                v = [(row.astype(np.int16) if fits else row).tobytes() for row, fits in zip(x, small, strict=True)]
                places = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(places), labels.take(places), anchors.take(places), pa.array(np.full(len(at), x.shape[1]), pa.int32()), pa.array(v, pa.binary())],
                    names=["vec_id", "label", "is_anchor", "dim", "v"],
                )

    return lean(run)


def _matrix(v: pd.Series, dim: int) -> np.ndarray:
    """Rows of whole doubles from their bytes."""
    out = np.empty((len(v), dim))
    short = v.map(len).to_numpy() == 2 * dim
    for rows, kind in ((short, np.int16), (~short, np.float64)):
        if rows.any():
            out[rows] = np.frombuffer(b"".join(v[rows]), dtype=kind).reshape(-1, dim)
    return out


def _python_ints(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)


def _floors(lower: np.ndarray, upper: np.ndarray, alive: np.ndarray, floor: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Floors raised to the k-th greatest lower end of the intervals that lie within a window as a whole."""
    floor = floor.copy()
    if lower.shape[1] >= k:
        for w in range(floor.shape[1]):
            sure = np.where(alive & (lower >= floor[:, w, None]) & (upper <= high[:, w, None]), lower, -np.inf)
            floor[:, w] = np.maximum(floor[:, w], np.partition(sure, sure.shape[1] - k, axis=1)[:, -k])
    return floor


def sliced(q: np.ndarray, c: np.ndarray, alive: np.ndarray, floor: np.ndarray, high: np.ndarray, k: int, rise: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of every pair that can be among the k best of a window [floor, high] of its anchor.

    The bits of c's components are gone through from the sign on.  Behind a plane of weight 2^t the
    components lack between 0 and 2^t - 1, so a score lies between what is summed and that many times
    the negative and the positive components of the anchor.  Pairs whose interval misses all
    windows go; once few are left they are gone on with one by one.  rise: raise the floors by
    the intervals themselves, as long as no list of rows seen before does that.
    """
    exact = q.dtype == object
    down, up = np.minimum(q, 0).sum(axis=1), np.maximum(q, 0).sum(axis=1)
    bits = max((int(v).bit_length() for v in (c.min(), c.max())), default=0) + 1 if c.size else 1
    plane = lambda t: ((c >> t) & 1) if exact else ((c >> t) & 1).astype(np.float64)
    weight = lambda t: -(1 << t) if t == bits - 1 else 1 << t
    score = np.zeros((len(q), len(c)), dtype=q.dtype)
    rows, t = np.arange(len(c)), bits
    while t and alive.any() and (t == bits or alive.mean() > SPARSE):
        t -= 1
        score = score + weight(t) * (q @ plane(t).T)
        lower, upper = score + ((1 << t) - 1) * down[:, None], score + ((1 << t) - 1) * up[:, None]
        if rise and not exact:
            floor = _floors(lower, upper, alive, floor, high, k)
        alive = alive & (upper >= floor.min(axis=1)[:, None]).astype(bool) & (lower <= high.max(axis=1)[:, None]).astype(bool)
        some = alive.any(axis=0)
        if some.mean() < 0.5:
            rows, c, score, alive = rows[some], c[some], score[:, some], alive[:, some]
    a, r = np.nonzero(alive)
    s = score[a, r]
    while t and len(a):
        t -= 1
        bit = plane(t)
        for lo in range(0, len(a), PAIRS):
            x, y = q[a[lo : lo + PAIRS]], bit[r[lo : lo + PAIRS]]
            s[lo : lo + PAIRS] += weight(t) * ((x * y).sum(axis=1) if exact else np.einsum("ij,ij->i", x, y))
        lower, upper = s + ((1 << t) - 1) * down[a], s + ((1 << t) - 1) * up[a]
        may = np.zeros(len(a), dtype=bool)
        for w in range(floor.shape[1]):
            may |= (upper >= floor[a, w]).astype(bool) & (lower <= high[a, w]).astype(bool)
        a, r, s = a[may], r[may], s[may]
    return a, rows[r], np.array([max(-_LIMIT, min(_LIMIT - 1, int(v))) for v in s], dtype=np.int64) if exact else s.astype(np.int64)


class Best:
    """The k best rows of each window of each anchor."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.key, self.score, self.id = (np.empty(0, dtype=np.int64) for _ in range(3))

    def floor(self) -> np.ndarray:
        """The least score that can still enter each window's list."""
        out = self.low.ravel().copy()
        if len(self.key):
            n = np.bincount(self.key, minlength=len(out))
            last = np.cumsum(n) - 1
            full = n >= self.k
            out[full] = np.maximum(out[full], self.score[last[full]])
        return out.reshape(self.low.shape)

    def add(self, a: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        for w in range(self.low.shape[1]):
            inside = (s >= self.low[a, w]) & (s <= self.high[a, w])
            self.key = np.concatenate([self.key, a[inside] * self.low.shape[1] + w])
            self.score, self.id = np.concatenate([self.score, s[inside]]), np.concatenate([self.id, ids[inside]])
        order = np.lexsort((self.id, ~self.score, self.key))
        key = self.key[order]
        first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.empty(0, dtype=bool)
        place = np.arange(len(key)) - np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        order = order[place < self.k]
        self.key, self.score, self.id = self.key[order], self.score[order], self.id[order]


def best_of(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, ids: np.ndarray, allowed, low: np.ndarray, high: np.ndarray, k: int) -> Best:
    """The k best rows for each window [low, high] of each anchor, of those that allowed(anchors, rows) says; ties to the lesser id, none is its own.

    Pairs whose sums stay below 2^53 are counted in doubles, others in Python integers.
    """
    best = Best(low, high, k)
    small_q, small_c = (np.abs(x).max(axis=1, initial=0) * max(1, x.shape[1]) < 1 << 25 for x in (q, c))
    for lo in range(0, len(c), TILE):
        tile = np.arange(lo, min(lo + TILE, len(c)))
        small = tile[small_c[tile]]
        for qs, cs, exact in ((small_q, small, False), (~small_q, tile, True), (small_q, tile[~small_c[tile]], True)):
            qs = np.flatnonzero(qs)
            for first in range(0, len(qs) if len(cs) else 0, BLOCK):
                at = qs[first : first + BLOCK]
                alive = allowed(at, cs) & (q_ids[at][:, None] != ids[cs][None, :])
                rows = (_python_ints(q[at]), _python_ints(c[cs])) if exact else (q[at], c[cs].astype(np.int64))
                a, r, s = sliced(*rows, alive, best.floor()[at].astype(object if exact else np.float64), high[at].astype(object if exact else np.float64), k, lo == 0)
                best.add(at[a], ids[cs][r], s)
    return best


def _positives(k: int):
    def run(key: tuple, anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for label, some in anchors.groupby("label"):
            near = rows[rows["label"] == label]
            q, c, q_ids = _matrix(some["v"], key[2]), _matrix(near["v"], key[2]), some["anchor_id"].to_numpy()
            bound = np.full((len(q), 1), _LIMIT - 1, dtype=np.int64)
            best = best_of(q, q_ids, c, near["vec_id"].to_numpy(), lambda a, r: np.ones((len(a), len(r)), dtype=bool), ~bound, bound, k)
            found.append(pd.DataFrame({"anchor_id": q_ids[best.key], "shard": np.int32(key[1]), "vec_id": best.id, "score": best.score}))
        return pd.concat(found) if found else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("anchor_id", "shard", "vec_id", "score")})

    return run


def _negatives(k: int, percent: tuple[int, int]):
    def run(key: tuple, anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        names = ["anchor_id", "place", "positive_id", "positive_score", "shard", "vec_id", "score"]
        if anchors.empty or rows.empty:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in names})
        width = max(map(len, anchors["scores"]))
        low, high = np.full((len(anchors), width), _LIMIT - 1, dtype=np.int64), np.full((len(anchors), width), -_LIMIT, dtype=np.int64)
        positive, positive_score = low.copy(), low.copy()
        for i, (ids, scores) in enumerate(zip(anchors["ids"], anchors["scores"], strict=True)):
            for w, (p, s) in enumerate(zip(ids, scores, strict=True)):
                positive[i, w], positive_score[i, w] = p, s
                low[i, w], high[i, w] = -(-percent[0] * int(s) // 100), percent[1] * int(s) // 100
        labels, others = anchors["label"].to_numpy(), rows["label"].to_numpy()
        q_ids = anchors["anchor_id"].to_numpy()
        best = best_of(_matrix(anchors["v"], key[2]), q_ids, _matrix(rows["v"], key[2]), rows["vec_id"].to_numpy(), lambda a, r: labels[a][:, None] != others[r][None, :], low, high, k)
        a, w = np.divmod(best.key, width)
        return pd.DataFrame(dict(zip(names, (q_ids[a], w, positive[a, w], positive_score[a, w], np.full(len(a), key[1]), best.id, best.score), strict=True)))

    return run


def _merge(lists: DataFrame, by: tuple[str, ...], shards: int, k: int) -> DataFrame:
    """The k best of each `by`, with rank, from lists of shards, FAN lists at a time, level by level."""
    best = lambda *more: F.row_number().over(Window.partitionBy(*by, *more).orderBy(F.desc("score"), "vec_id"))
    while shards > FAN:
        shards = -(-shards // FAN)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int"))
        lists = lists.withColumn("rank", best("shard")).where(F.col("rank") <= k).drop("rank")
    return lists.withColumn("rank", best()).where(F.col("rank") <= k).drop("shard")


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, percent: tuple[int, int] = (30, 90), scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, embedding.  A component x counts as floor(scale * x), a score is the inner product
    with the anchor, ties go to the lesser vec_id.  An anchor's positives are its best `positives` other rows of its label.
    For each of them the best `negatives` rows of other labels come whose score lies between percent[0]
    and percent[1] hundredths of the positive's.

    Rows with a null vec_id, label or vector, an empty one, or a null or non-finite component take no
    part.  Only vectors of the anchor's dimension are compared.  Rows that repeat a vec_id are one anchor (the least by
    dimension, label and bytes) and each of them a candidate of the others.  Scores beyond 64 bits are held at the
    limit.  An empty table gives no rows.  Other columns of vectors are dropped.

    Tiles of anchors meet shards of rows, whose number follows the rows, so that a task holds a bounded
    part of each; a label that holds most rows is dealt to all shards.  The shards' lists are merged as a tree.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = materialize(rows.mapInArrow(_quantise(scale), "vec_id long, label long, is_anchor boolean, dim int, v binary"), "whole_vectors", n=F.count(F.lit(1)), anchors=F.count(F.when(F.col("is_anchor"), 1)))
    total, asked = rows.stats["n"] or 0, rows.stats["anchors"] or 0
    shards = max(1, -(-total // (4 * TILE)), min(spark.sparkContext.defaultParallelism, -(-total // 512)))
    tiles = max(1, -(-asked // ANCHOR_TILE))
    anchors = rows.where("is_anchor").groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("dim", "label", "v")).alias("x")).select("anchor_id", "x.*")
    anchors = anchors.withColumn("tile", F.pmod(F.xxhash64("anchor_id", F.lit(1)), F.lit(tiles)).cast("int"))
    candidates = rows.select("vec_id", "label", "dim", "v", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))
    to_shards = lambda df: df.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).groupBy("tile", "shard", "dim")
    near = to_shards(anchors).cogroup(candidates.groupBy("tile", "shard", "dim")).applyInPandas(_positives(positives), "anchor_id long, shard int, vec_id long, score long")
    near = _merge(near, ("anchor_id",), shards, positives)
    held = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p"))  # `positives` at most
    asking = anchors.join(held.select("anchor_id", F.col("p.vec_id").alias("ids"), F.col("p.score").alias("scores")), "anchor_id")
    schema = "anchor_id long, place int, positive_id long, positive_score long, shard int, vec_id long, score long"
    far = to_shards(asking).cogroup(candidates.groupBy("tile", "shard", "dim")).applyInPandas(_negatives(negatives, percent), schema)
    far = _merge(far, ("anchor_id", "place", "positive_id", "positive_score"), shards, negatives)
    return far.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
