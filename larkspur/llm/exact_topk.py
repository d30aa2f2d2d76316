"""Exact top-k search: tiled matrix products, partial selection per tile, merged per query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that go to a shard together; each tile of them sends all rows once more.
QUERY_TILE = 16_384
#: Queries and rows of one matrix product.
BLOCK, TILE = 512, 4096
#: Shards whose lists are merged at once.
FAN = 16
_EXACT = 1 << 53


def _quantise(scale: int):
    """Rows of usable vectors: id, dim and the whole components, as the bytes of doubles.

    A component times scale is taken as a double and floored, so that any size is held exactly (what
    goes beyond the doubles is held at their limit); a vector with a null or non-finite component takes no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.finfo(np.float64).max
        for batch in batches:
            ids, out, dims = [], [], []
            for vec_id, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
                if vec_id is None or not vector.is_valid or vector.values.null_count:
                    continue
                x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                with np.errstate(over="ignore"):
                    x = np.clip(np.floor(x * scale), -most, most) + 0.0
                ids.append(vec_id)
                out.append(x.tobytes())
                dims.append(len(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "dim", "v"])

    return run


def _whole(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products, held at the limits of 64 bits: in doubles for rows whose partial sums stay below 2^53, in Python integers for others."""
    out = np.zeros((len(q), len(c)), dtype=np.int64)
    least = int((_EXACT / max(1, q.shape[1])) ** 0.5) - 1
    small_q, small_c = (np.abs(x).max(axis=1, initial=0) <= least for x in (q, c))
    out[np.ix_(small_q, small_c)] = (q[small_q].astype(np.float64) @ c[small_c].T.astype(np.float64)).astype(np.int64)
    for some, others in ((~small_q, np.ones(len(c), dtype=bool)), (small_q, ~small_c)):
        if some.any() and others.any():
            out[np.ix_(some, others)] = np.clip(_whole(q[some]) @ _whole(c[others]).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)
    return out


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, best first."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], ~scores[places]))][:k]  # ~ turns the order of whole numbers round and has no overflow


def _tile_topk(k: int):
    def run(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "shard": pd.Series(dtype="int32"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        if queries.empty or rows.empty:
            return none
        dim = int(key[2])
        ids = rows["vec_id"].to_numpy()
        matrix = np.frombuffer(b"".join(rows["v"]), dtype=np.float64).reshape(len(rows), dim)
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        q_ids = queries["vec_id"].to_numpy()
        q_matrix = np.frombuffer(b"".join(queries["v"]), dtype=np.float64).reshape(len(queries), dim)
        for lo in range(0, len(rows), TILE):
            part = ids[lo : lo + TILE]
            for first in range(0, len(q_ids), BLOCK):
                block = _products(q_matrix[first : first + BLOCK], matrix[lo : lo + TILE])
                for i, scores in enumerate(block, first):
                    own = part != q_ids[i]
                    s, d = scores[own], part[own]
                    if i in best:
                        s, d = np.concatenate([best[i][0], s]), np.concatenate([best[i][1], d])
                    at = select(s, d, k)
                    best[i] = (s[at], d[at])
        n = [len(best[i][0]) for i in range(len(q_ids))]
        found = {"query_id": np.repeat(q_ids, n), "vec_id": np.concatenate([best[i][1] for i in range(len(q_ids))]), "score": np.concatenate([best[i][0] for i in range(len(q_ids))])}
        return pd.DataFrame(found).assign(shard=np.int32(key[1]))[["query_id", "shard", "vec_id", "score"]]

    return run


def merge(lists: DataFrame, shards: int, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best from lists (query_id, shard, vec_id, score), FAN lists at a time, level by level."""
    best = lambda *by: F.row_number().over(Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "vec_id"))
    while shards > FAN:
        shards = -(-shards // FAN)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int"))
        lists = lists.withColumn("rank", best("shard")).where(F.col("rank") <= k).drop("rank")
    return lists.select("query_id", best().alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def exact_topk(vectors: DataFrame, is_query: F.Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows among all others.

    vectors: vec_id, embedding.  Tiles of about QUERY_TILE queries meet shards of
    the rows of their dimension; the number of shards grows with the rows, so
    that a task holds a bounded tile of each.  What is shuffled is the rows once
    for each query tile and the queries once for each shard; the lists of the shards are merged as a
    tree.  Vectors of another dimension are no
    candidates.  A query is never its own candidate; rows that repeat a vec_id
    are one query, and each of them a candidate of the others.  Where such rows differ the query is the vector
    of the fewest components, then the least by their bytes.  Scores beyond 64
    bits are held at the limit.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    usable = rows.select("vec_id", "embedding").mapInArrow(_quantise(scale), "vec_id long, dim int, v binary")
    asked = rows.where("is_query").select("vec_id", "embedding").mapInArrow(_quantise(scale), "vec_id long, dim int, v binary")
    asked = asked.groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("x")).select("vec_id", "x.dim", "x.v")
    total = vectors.count()
    shards = max(1, -(-total // (4 * TILE)), min(spark.sparkContext.defaultParallelism, -(-total // 512)))
    queries = max(1, -(-vectors.where(is_query).count() // QUERY_TILE))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    tile = F.pmod(F.xxhash64(F.col("vec_id"), F.lit(1)), F.lit(queries)).cast("int")
    left = asked.select("vec_id", "dim", "v", tile.alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    right = usable.select("vec_id", "dim", "v", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(queries - 1))).alias("tile"))
    partial = left.groupBy("tile", "shard", "dim").cogroup(right.groupBy("tile", "shard", "dim")).applyInPandas(_tile_topk(k), "query_id long, shard int, vec_id long, score long")
    return merge(partial, shards, k)
