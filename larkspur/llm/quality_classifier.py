"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from the bytes and words of whole texts, a column at a time.
Trees are grown level by level on binned statistics and kept as complete
binary trees in flat arrays, which numpy walks for all texts of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_fold, labelled_sample, lean, with_results
from .wordhash import _MULT, mix, slices, string_buffers, words_with_spans

#: Labelled documents that the trees are fitted on, at most.
SAMPLE = 20_000
FOLDS, HELD_OUT = 3, 1
#: Bytes of text whose statistics are worked out at once; the arrays take some fifty times as much.
PART = 1 << 20
_CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "quote", "symbol", "high")
FEATURES = ("log_words", "log_bytes", "word_mean", "word_spread", "long_words", "distinct", "top_word", "repeat_1", "repeat_3", "words_per_line", "words_per_stop", *_CLASSES)


def _byte_classes() -> np.ndarray:
    table = np.full(256, _CLASSES.index("symbol"), dtype=np.int64)
    for name, members in {
        "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
        "space": b" \t\r\x0b\x0c", "line": b"\n", "stop": b".,;:!?", "quote": b"\"'()-",
    }.items():
        table[list(members)] = _CLASSES.index(name)
    table[128:] = _CLASSES.index("high")
    return table


_BYTES = _byte_classes()


def _repeats(values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: distinct values, the count of the commonest, and how many values occur again."""
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    first = np.ones(len(v), dtype=bool)
    first[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    starts = np.flatnonzero(first)
    counts = np.diff(np.append(starts, len(v)))
    distinct = np.bincount(r[starts], minlength=n)
    top = np.zeros(n, dtype=np.int64)
    np.maximum.at(top, r[starts], counts)
    again = np.bincount(r[starts], weights=np.where(counts > 1, counts, 0), minlength=n)
    return distinct, top, again


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text; all zero for an empty or null one."""
    n = len(texts)
    offsets, data = string_buffers(texts)
    size = np.diff(offsets)
    out = np.zeros((n, len(FEATURES)))
    if not size.sum():
        return out
    raw = data[offsets[0] : offsets[-1]]
    classes = np.bincount(np.repeat(np.arange(n), size) * len(_CLASSES) + _BYTES[raw], minlength=n * len(_CLASSES)).reshape(n, -1)
    out[:, -len(_CLASSES) :] = classes / np.maximum(size, 1)[:, None]
    words, at, first, end = words_with_spans(texts)
    count = np.diff(at)
    some = np.maximum(count, 1)
    rows = np.repeat(np.arange(n), count)
    length = (end - first).astype(float)
    mean = np.bincount(rows, weights=length, minlength=n) / some
    spread = np.sqrt(np.maximum(np.bincount(rows, weights=length**2, minlength=n) / some - mean**2, 0))
    distinct, top, again = _repeats(words, rows, n)
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = np.log1p(count), np.log1p(size), mean, spread
    out[:, 4] = np.bincount(rows, weights=length > 12, minlength=n) / some
    out[:, 5], out[:, 6], out[:, 7] = distinct / some, top / some, again / some
    if len(words) > 2:
        three = mix(mix(words[:-2] * _MULT[0] + words[1:-1] * _MULT[1]) + words[2:] * _MULT[2])
        inside = rows[:-2] == rows[2:]
        out[:, 8] = _repeats(three[inside], rows[:-2][inside], n)[2] / some
    out[:, 9] = count / (1 + classes[:, _CLASSES.index("line")])
    out[:, 10] = count / (1 + classes[:, _CLASSES.index("stop")])
    return out


class Trees:
    """Boosted complete binary trees: arrays feature, threshold (inner nodes) and value (leaves), one row per tree."""

    def __init__(self, base: float, depth: int) -> None:
        self.base, self.depth = base, depth
        self.feature = np.zeros((0, (1 << depth) - 1), dtype=np.int32)
        self.threshold = np.zeros((0, (1 << depth) - 1))
        self.value = np.zeros((0, 1 << depth))

    def add(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray) -> None:
        self.feature, self.threshold, self.value = (np.vstack([a, b[None]]) for a, b in ((self.feature, feature), (self.threshold, threshold), (self.value, value)))

    def raw(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - len(feature)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Second-order boosting of the logistic loss on histograms of gradients."""
    share = min(0.999, max(0.001, float(y.mean()) if len(y) else 0.5))
    model = Trees(float(np.log(share / (1 - share))), depth)
    if len(np.unique(y)) < 2:
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    raw = np.full(len(y), model.base)
    inner = (1 << depth) - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, dtype=np.int32), np.full(inner, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            lo, width = (1 << level) - 1, 1 << level
            best = np.full(width, 1e-6)
            split = np.full(width, bins, dtype=np.int64)
            for j in range(x.shape[1]):
                key = (node - lo) * bins + binned[:, j]
                gs = np.bincount(key, weights=g, minlength=width * bins).reshape(width, bins).cumsum(axis=1)
                hs = np.bincount(key, weights=h, minlength=width * bins).reshape(width, bins).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least) | (ht - hs < least)] = -1
                gain[:, len(cuts[j]) :] = -1
                at = gain.argmax(axis=1)
                better = gain[np.arange(width), at] > best
                best[better] = gain[np.arange(width), at][better]
                split[better] = at[better]
                feature[lo : lo + width][better] = j
                threshold[lo : lo + width][better] = [cuts[j][k] for k in at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, weights=g, minlength=inner + 1), np.bincount(leaf, weights=h, minlength=inner + 1)
        value = -rate * gs / (hs + ridge)
        model.add(feature, threshold, value)
        raw += value[leaf]
    return model


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, size=PART):
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(list(statistics(part.column("text"))), pa.list_(pa.float64()))], names=["label", "x"])


def fit_quality(documents: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, sample: int = SAMPLE) -> Trees:
    """Fit on at most `sample` labelled documents outside the held-out fold; only texts and labels go in.

    Without labels of both kinds the score is their share (a half without any).
    """
    chosen = labelled_sample(labels, "quality", folds, held_out, sample)
    found = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "label").mapInArrow(lean(_training_rows), "label int, x array<double>").collect()
    found.sort(key=lambda r: (r["label"], r["x"]))
    return fit_trees(np.array([r["x"] for r in found]).reshape(len(found), len(FEATURES)), np.array([r["label"] for r in found], dtype=float))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=PART):
                score = np.round(model.value.score(statistics(part.column("text"))), 6)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["row", "score", "predicted"])

    return run


def score_quality(documents: DataFrame, model: Trees) -> DataFrame:
    """documents with score (0 to 1, higher: better) and predicted (1 from 0.5 on) behind its columns.

    A null text is scored as an empty one.  Columns score and predicted of the input are replaced.
    """
    keep = [c for c in documents.columns if c not in ("score", "predicted")]
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return with_results(documents, keep, {"text": F.col("text").cast("string")}, _score(shared), "score double, predicted int")


def with_fold(scored: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    return scored.withColumn("held_out", F.coalesce(crc_fold("doc_id", folds) == held_out, F.lit(False)))
