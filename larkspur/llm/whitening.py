"""Embedding whitening: an exact scatter from residues modulo several primes, then eigh in doubles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean
from .vectors import usable

#: Primes lie below 2^20, so that residues around zero have at most 2^19 in size.
PRIME_BITS = 20
#: Rows of one product: their residues' products sum up to 2^51 at most, which doubles hold exactly.
ROWS = 8192
#: Sums that one row of a partial scatter holds.
WIDTH = 64
#: Whole components beyond this are held at it.
MOST = 1 << 62
OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def primes(product: int) -> list[int]:
    """The greatest primes below 2^20, as many as it takes for their product to exceed `product`."""
    sieve = np.ones(1 << PRIME_BITS, dtype=bool)
    sieve[:2] = False
    for i in range(2, 1 << PRIME_BITS // 2):
        if sieve[i]:
            sieve[i * i :: i] = False
    found, reached = [], 1
    for p in np.flatnonzero(sieve)[::-1].tolist():
        if reached > product:
            break
        found.append(p)
        reached *= p
    return found


def whole(x: np.ndarray, scale: int, offset: int) -> np.ndarray:
    """floor(scale * x) + offset, held at MOST."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * scale), -MOST, MOST).astype(np.int64) + offset


def _sizes(scale: int, offset: int):
    """dim, n and the least and greatest whole component of a task's usable vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[int]] = {}
        for batch in batches:
            for _, x in usable(batch.column("embedding")):
                w = whole(x, scale, offset)
                n, least, most = seen.get(w.shape[1], (0, MOST, -MOST))
                seen[w.shape[1]] = [n + len(w), min(least, int(w.min())), max(most, int(w.max()))]
        rows = [(dim, *x) for dim, x in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4, names=["dim", "n", "least", "most"])

    return run


def _chosen(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and rows of the usable vectors of one dimension."""
    for at, x in usable(batch.column("embedding")):
        if x.shape[1] == dim:
            return at, x
    return np.empty(0, dtype=np.int64), np.empty((0, dim))


def residue_products(x: np.ndarray, p: int) -> np.ndarray:
    """x' x modulo p, by products of doubles that are exact."""
    total = np.zeros((x.shape[1], x.shape[1]), dtype=np.int64)
    for lo in range(0, len(x), ROWS):
        r = x[lo : lo + ROWS] % p
        r = (r - p * (r > p // 2)).astype(np.float64)
        total = (total + (r.T @ r).astype(np.int64)) % p
    return total


def _scatter(dim: int, moduli: list[int], scale: int, offset: int):
    """A task's scatter of the vectors, with a last component of 1, modulo each prime: (prime, row, block, sums)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {p: np.zeros((dim + 1, dim + 1), dtype=np.int64) for p in moduli}
        seen = False
        for batch in batches:
            _, x = _chosen(batch, dim)
            if len(x):
                seen = True
                w = np.hstack([whole(x, scale, offset), np.ones((len(x), 1), dtype=np.int64)])
                for p in moduli:
                    totals[p] = (totals[p] + residue_products(w, p)) % p
        for p in moduli if seen else ():
            rows, blocks = dim + 1, -(-(dim + 1) // WIDTH)
            padded = np.zeros((rows, blocks * WIDTH), dtype=np.int64)
            padded[:, :rows] = totals[p]
            sums = pa.FixedSizeListArray.from_arrays(pa.array(padded.ravel()), WIDTH).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(rows * blocks, p), pa.int32()), pa.array(np.repeat(np.arange(rows), blocks), pa.int32()), pa.array(np.tile(np.arange(blocks), rows), pa.int32()), sums],
                names=["prime", "i", "block", "sums"],
            )

    return run


def _summed(partial: DataFrame) -> list:
    """prime, i, block and WIDTH sums: a row for each prime and stretch of a row of the matrix, whatever the number of tasks."""
    return partial.groupBy("prime", "i", "block").agg(*[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(WIDTH)]).collect()


def reconstruct(residues: dict[int, np.ndarray]) -> np.ndarray:
    """Whole numbers of either sign from their residues by primes, digit by digit (Garner), as Python integers."""
    value, product = None, 1
    for p, r in residues.items():
        r = r.astype(object)
        if value is None:
            value = r % p
        else:
            value = value + product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return np.where(value > product // 2, value - product, value)


def exact_scatter(vectors: DataFrame, dim: int, n: int, size: int, scale: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """X'X and the sums of the n whole vectors, exactly; size: a bound of their components."""
    moduli = primes(2 * n * max(size, 1) ** 2 + 1)
    rows = _summed(vectors.mapInArrow(lean(_scatter(dim, moduli, scale, offset)), "prime int, i int, block int, sums array<long>"))
    blocks = -(-(dim + 1) // WIDTH)
    residues = {p: np.zeros((dim + 1, blocks * WIDTH), dtype=np.int64) for p in moduli}
    for row in rows:
        residues[row["prime"]][row["i"], row["block"] * WIDTH : (row["block"] + 1) * WIDTH] = row[3:]
    full = reconstruct({p: r[:, : dim + 1] % p for p, r in residues.items()})
    return full[:dim, :dim], full[dim, :dim]


def components(scatter: np.ndarray, sums: np.ndarray, n: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues by falling size, eigenvectors as columns, and each value's share of the trace.

    The covariance is a quotient of whole numbers, rounded once to doubles.
    """
    centred = n * scatter - np.outer(sums, sums)
    covariance = np.array([[v / (n * n) for v in row] for row in centred], dtype=np.float64)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    trace = float(np.trace(covariance))
    # below this a value is nothing but the rounding of others
    good = values > len(values) * np.finfo(np.float64).eps * max(values[0], 0)
    return np.where(good, values, 0.0)[:count], axes[:, :count], np.where(good, values, 0.0)[:count] / (trace or 1.0)


def _centred(w: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """n * w - sums, in 64 bits where they hold it, in Python integers elsewhere."""
    bound = n * max(abs(int(w.min())), abs(int(w.max()))) + max(map(abs, sums))
    return n * w - np.array(sums, dtype=np.int64) if bound < 1 << 63 else n * w.astype(object) - np.array(sums, dtype=object)


def _project(d: np.ndarray, n: int, axes: np.ndarray) -> np.ndarray:
    return (d / n).astype(np.float64) @ axes


def _deviation(d: np.ndarray) -> np.ndarray:
    """Sums of squares, held at the limit of 64 bits."""
    most = int(np.abs(d).max()) if d.size else 0
    if most * most * d.shape[1] < 1 << 63:
        return (d.astype(np.int64) ** 2).sum(axis=1)
    d = d.astype(object)
    return np.array([min(int(v), (1 << 63) - 1) for v in (d * d).sum(axis=1)], dtype=np.int64)


def _second_moments(dim: int, n: int, sums: list[int], axes: np.ndarray, scale: int, offset: int):
    """A task's sums of products of the whitened components, (i, sums)."""
    k = axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            _, x = _chosen(batch, dim)
            if len(x):
                w = _project(_centred(whole(x, scale, offset), sums, n), n, axes)
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "sums"])

    return run


def _whiten(dim: int, n: int, sums: list[int], axes: np.ndarray, scale: int, offset: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _chosen(batch, dim)
            if not len(x):
                continue
            d = _centred(whole(x, scale, offset), sums, n)
            w = _project(d, n, axes)
            values = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), axes.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), pa.array(_deviation(d)), values], names=["vec_id", "deviation", "values"])

    return run


def whiten(vectors: DataFrame, count: int = 32, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row and each of the first `count` components.

    vectors: vec_id, embedding.  A component c counts as x = floor(scale * c) + offset, without its offset held at
    2^62 in size.  The scatter and the sums of all rows are found exactly: each task multiplies residues modulo primes, as many as
    the number of rows and the greatest component ask for; Spark adds the tasks' matrices up; Chinese
    remaindering gives the whole numbers.  Only matrices of dim * dim numbers for each prime reach the driver.  Covariances have the divisor n.
    deviation is the exact sum of (n * x - S)^2, held at the limit of 64 bits.  identity_error is measured
    on the whitened rows.

    Null and empty vectors and those with a null or non-finite component drop out; so do those of another
    dimension than the most frequent one (of equally frequent ones the greatest).  Rows repeat as they come, null ids are kept; other columns are
    dropped.  A component without variance (fewer rows than dimensions, constant columns) explains 0, its whitened value is null
    and it takes no part in identity_error.  A table without usable vectors gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    only = rows.select("embedding")
    sizes = only.mapInArrow(lean(_sizes(scale, offset)), "dim long, n long, least long, most long").groupBy("dim").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    found = sizes.orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not found:
        return spark.createDataFrame([], f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, {OUT}")
    dim, n, size = found[0]["dim"], found[0]["n"], max(abs(found[0]["least"]), abs(found[0]["most"]))
    scatter, sums = exact_scatter(only, dim, n, size, scale, offset)
    sums = sums.tolist()
    values, axes, explained = components(scatter, np.array(sums, dtype=object), n, count)
    good = values > 0
    axes = axes / np.sqrt(np.where(good, values, 1.0))
    moments = only.mapInArrow(lean(_second_moments(dim, n, sums, axes, scale, offset)), "i int, sums array<double>").groupBy("i").agg(*[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(len(values))]).collect()
    covariance = np.array([row[1:] for row in sorted(moments, key=lambda row: row["i"])]) / n
    error = float(np.abs(covariance - np.eye(len(values)))[np.ix_(good, good)].max(initial=0.0))
    whitened = rows.mapInArrow(lean(_whiten(dim, n, sums, axes, scale, offset)), f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation long, values array<double>")
    shares = F.array(*[F.lit(float(x)) for x in explained])
    each = whitened.select("vec_id", "deviation", F.posexplode("values").alias("at", "value"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(F.array(*[F.lit(bool(x)) for x in good])[F.col("at")], F.col("value")).alias("whitened"),
        shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"),
    )
