"""Vectorised word and shingle hashing over Arrow string buffers.

A word is a maximal run of bytes outside space and 0x09-0x0D; A-Z count as a-z.
Both are ASCII properties, so they hold on the UTF-8 bytes as they are and no
Python string is ever made.  Memory per call is a few times CHUNK besides one
integer per word, however long a text is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_MULT = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + 1)
        _POWERS[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(len(column) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return offsets, data


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the place of its first word (and the total at the end)."""
    return words_with_spans(column)[:2]


def words_with_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """word_hashes, and each word's first byte and end in the column's buffer."""
    offsets, data = string_buffers(column)
    parts, at, ends, lo, end = [], [], [], int(offsets[0]), int(offsets[-1])
    while lo < end:
        hi = min(lo + CHUNK, end)
        if hi < end:  # cut behind the last space or before the last text that starts here
            spaces = np.flatnonzero(_SPACE[data[lo:hi]])
            after = lo + int(spaces[-1]) + 1 if len(spaces) else lo
            start = int(offsets[np.searchsorted(offsets, hi, side="right") - 1])
            hi = max(after, start)
            if hi <= lo:  # one word is longer than a chunk
                rest, step = lo + CHUNK, 0
                following = int(offsets[np.searchsorted(offsets, lo, side="right")])
                while rest < following:
                    step = min(rest + CHUNK, following)
                    found = np.flatnonzero(_SPACE[data[rest:step]])
                    if len(found):
                        rest = rest + int(found[0])
                        break
                    rest = step
                hi = min(rest, following)
        b = data[lo:hi]
        solid = ~_SPACE[b]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        edges = offsets[np.searchsorted(offsets, lo, side="right") : np.searchsorted(offsets, hi, side="left")] - lo
        if len(edges):
            first[edges] |= solid[edges]
            last[edges - 1] |= solid[edges - 1]
        first, last = np.flatnonzero(first), np.flatnonzero(last)
        power, inverse = _powers(len(b))
        total = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[b] * power[: len(b)], out=total[1:])
        parts.append(mix((total[last + 1] - total[first]) * inverse[first]))
        at.append(first + lo)
        ends.append(last + 1 + lo)
        lo = hi
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), np.zeros(len(offsets), dtype=np.int64), none, none
    first = np.concatenate(at)
    return np.concatenate(parts), np.searchsorted(first, offsets, side="left"), first, np.concatenate(ends)


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence if it is shorter."""
    n = len(words)
    if not n:
        return words[:0]
    width = min(k, n)
    h = np.full(n - width + 1, width, dtype=np.uint64)
    for i in range(width):
        h = mix(h + words[i : n - width + 1 + i] * _MULT[i % len(_MULT)] + np.uint64(i // len(_MULT)))
    return np.unique(h)


def set_digest(tokens: np.ndarray) -> int:
    """A signed 64-bit digest of a set of hashes; its size goes in, too."""
    with np.errstate(over="ignore"):
        h = np.uint64(len(tokens)) * _MULT[0] + np.sum(mix(tokens ^ _MULT[1]), dtype=np.uint64) + np.sum(mix(tokens + _MULT[2]) * _MULT[3], dtype=np.uint64)
    return int(mix(np.array([h], dtype=np.uint64)).view(np.int64)[0])


def slices(batch: pa.RecordBatch, column: str = "text", size: int = 4 << 20) -> list[pa.RecordBatch]:
    """The batch in parts whose texts have about `size` bytes, a single longer text by itself."""
    offsets, _ = string_buffers(batch.column(column))
    parts, lo = [], 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        parts.append(batch.slice(lo, hi - lo))
        lo = hi
    return parts


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word of one text."""
    solid = ~_SPACE[data]
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def sequence_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run words[start:end], the same wherever the run stands."""
    power, inverse = _powers(len(words))
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * power[: len(words)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[np.minimum(starts, max(0, len(words) - 1))] + (ends - starts).astype(np.uint64) * _MULT[4])
