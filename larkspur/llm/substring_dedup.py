"""Removal of passages that repeat across a corpus, by hashes of text units.

Units are lines, paragraphs or stretches of words.  They are normalised (A-Z as a-z, white space as
one space) and grouped by digest over the whole corpus; the occurrence with the
least (doc_id, text hash, place) is kept, and runs of later ones that are long enough go.

Stretches are cut where the words themselves say so: before each
word whose value (a hash of it and its two neighbours) is the least within REACH
words on either side.  Inside a passage the cuts are the same wherever it
stands, at the start of a line or in the middle of one; lines and paragraphs as units miss
what was pasted into a line.  Repeated stretches only say where to look: windows of words that begin with one of them or
reach beyond the ends of a run of them (all windows, where the run
isn't long enough by itself) are grouped by digest in the same way, and the words of a window that repeats go (the first occurrence stays whole where a later one overlaps it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import extended, lean, materialize, named, part_of, release
from .wordhash import _MULT, mix, sequence_hashes, slices, string_buffers, word_hashes, word_spans, words_with_spans

REACH = 4
#: Words beyond either end of a run of repeated stretches among which the end of the passage is looked for.
BEYOND = 32
#: A stretch without a cut is cut every so many words, so that words which repeat without end have units, too.
MOST = 32
#: Units of a task that are sorted together.
LOCAL = 1 << 21
UNITS = ("stretch", "line", "paragraph")
_TOP = np.uint64((1 << 64) - 1)


def unit_starts(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the words that begin a unit; at: place of each text's first word, and the total."""
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.int64)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    before, after = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    before[1:], after[:-1] = words[:-1], words[1:]
    firsts = at[:-1][np.diff(at) > 0]
    before[firsts] = 0
    after[at[1:][np.diff(at) > 0] - 1] = 0
    value = mix(before * _MULT[0] + words * _MULT[1] + after * _MULT[2]) & ~np.uint64(1)
    place = np.arange(n) + text * REACH + REACH
    wide = np.full(int(place[-1]) + REACH + 1, _TOP, dtype=np.uint64)
    wide[place] = value
    cut = np.ones(n, dtype=bool)
    for step in range(1, REACH + 1):
        cut &= (value < wide[place - step]) & (value < wide[place + step])
    cut[firsts] = True
    starts = np.flatnonzero(cut)
    wide = np.flatnonzero(np.diff(np.append(starts, n)) > MOST)
    if len(wide):
        ends = np.append(starts, n)
        more = [np.arange(starts[i] + MOST, ends[i + 1], MOST) for i in wide]
        starts = np.sort(np.concatenate([starts, *more]))
    return starts


def broken_starts(column: pa.Array, at: np.ndarray, first: np.ndarray, breaks: int) -> np.ndarray:
    """Places of the words that begin a line (breaks = 1) or paragraph (2): with so many line ends since the word before."""
    offsets, data = string_buffers(column)
    ends = int(offsets[0]) + np.flatnonzero(data[offsets[0] : offsets[-1]] == 10)
    cut = np.diff(np.searchsorted(ends, first), prepend=0) >= breaks
    cut[at[:-1][np.diff(at) > 0]] = True
    return np.flatnonzero(cut)


def segmented(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the place of each text's first word (and the total), and the places of the words that begin a unit."""
    if kind == "stretch":
        words, at = word_hashes(column)
        return words, at, unit_starts(words, at)
    words, at, first, _ = words_with_spans(column)
    return words, at, broken_starts(column, at, first, UNITS.index(kind))


def _units(batch: pa.RecordBatch, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digest, row, place within its text and number of words of every unit."""
    words, at, starts = segmented(batch.column("text"), kind)
    row = np.searchsorted(at, starts, side="right") - 1
    ends = np.append(starts[1:], len(words))
    first = np.searchsorted(starts, at[:-1], side="left")
    return sequence_hashes(words, starts, ends), row, np.arange(len(starts)) - first[row], ends - starts


_UNIT = "digest long, doc_id long, hash long, unit long, first boolean"


def beyond(own: np.ndarray, lead: np.ndarray, same: np.ndarray, length: int) -> np.ndarray:
    """Places of later windows, with how many of their first words belong to the first occurrence, which stays: place * length + words.

    own, lead: places of each window and of the first of its digest; same: whether that one stands in the same text.
    """
    return own.astype(np.int64) * length + np.where(same, np.clip(lead.astype(np.int64) + length - own, 0, length - 1), 0)


def _firsts(cols: list[list[np.ndarray]], length: int = 0) -> Iterator[pa.RecordBatch]:
    """Batches of _UNIT from digests, ids, text hashes and places: of each digest the first occurrence (may be kept), and all others (will not).

    length: that of windows; the places of others are then those of beyond().
    """
    if not cols[0]:
        return
    digest, doc, text, unit = (np.concatenate(c) for c in cols)
    order = np.lexsort((unit, text, doc, digest))
    digest, doc, text, unit = digest[order], doc[order], text[order], unit[order]
    again = np.zeros(len(digest), dtype=bool)
    again[1:] = (digest[1:] == digest[:-1]) & (doc[1:] == doc[:-1]) & (text[1:] == text[:-1]) & (unit[1:] == unit[:-1])
    digest, doc, text, unit = digest[~again], doc[~again], text[~again], unit[~again]
    first = np.ones(len(digest), dtype=bool)
    first[1:] = digest[1:] != digest[:-1]
    unit = unit.astype(np.int64)
    if length:
        lead = np.maximum.accumulate(np.where(first, np.arange(len(digest)), 0))
        unit = np.where(first, unit, beyond(unit, unit[lead], (doc == doc[lead]) & (text == text[lead]), length))
    for lo in range(0, len(digest), 50_000):
        s = slice(lo, lo + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(x[s]) for x in (digest, doc, text, unit, first)], names=["digest", "doc_id", "hash", "unit", "first"])


def _local(kind: str):
    """Units of a task, firsts and others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[], [], [], []]
        held = 0
        for batch in batches:
            for part in slices(batch):
                digest, row, unit, _ = _units(part, kind)
                doc, text = part.column("doc_id").to_numpy(zero_copy_only=False), part.column("hash").to_numpy(zero_copy_only=False)
                for col, x in zip(cols, (digest.view(np.int64), doc[row], text[row], unit.astype(np.int32)), strict=True):
                    col.append(x)
                held += len(digest)
                if held > LOCAL:
                    yield from _firsts(cols)
                    cols, held = [[], [], [], []], 0
        yield from _firsts(cols)

    return run


def runs(units: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive units, (first, end)."""
    return [(int(run[0]), int(run[-1]) + 1) for run in np.split(units, np.flatnonzero(np.diff(units) != 1) + 1)] if len(units) else []


def doubtful(units: np.ndarray, starts: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs of at most `least` words that a passage of more words may hold.

    A passage ends within the unit next to the run, or, where the earlier text has no cut
    that this one has near the edge, up to REACH words before or REACH + 1 behind that unit.
    """
    out = []
    for lo, hi in runs(units):
        n = starts[hi] - starts[lo]
        most = n + (starts[lo] - starts[lo - 1] + REACH if lo else 0) + (starts[hi + 1] - starts[hi] + REACH + 1 if hi < len(starts) - 1 else 0)
        if n <= least < most:
            out.append((lo, hi))
    return out


def _bounds(starts: np.ndarray, at: np.ndarray, i: int) -> np.ndarray:
    """First word of each unit of text i, counted from its own first word, and its number of words."""
    return np.append(starts[np.searchsorted(starts, at[i]) : np.searchsorted(starts, at[i + 1])], at[i + 1]) - at[i]


#: What of a unit's neighbourhood is looked at: all windows that hold it, those that reach to or beyond its start or its end, or the one that begins with it.
ALL, BEFORE, BEHIND, START = range(4)


def _doubts(least: int):
    """(digest, what) of the units in doubtful runs and in long ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                digest, _, _, _ = _units(part, "stretch")
                _, at, starts = segmented(part.column("text"), "stretch")
                found: set[tuple[int, int]] = set()
                for i, units in enumerate(part.column("units")):
                    begin = int(np.searchsorted(starts, at[i]))
                    own, places = _bounds(starts, at, i), np.unique(units.values.to_numpy(zero_copy_only=False))
                    for lo, hi in doubtful(places, own, least):
                        found.update((int(x), ALL) for x in digest[begin + lo : begin + hi].view(np.int64))
                    for lo, hi in runs(places):
                        if own[hi] - own[lo] > least:
                            found.update((int(x), START) for x in digest[begin + lo : begin + hi].view(np.int64))
                            found.update([(int(digest.view(np.int64)[begin + lo]), BEFORE), (int(digest.view(np.int64)[begin + hi - 1]), BEHIND)])
                pairs = sorted(found)
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int32())], names=["digest", "what"])

    return run


def _windows(least: int):
    """Windows of least + 1 words round the given units (place * 4 + what); their place is that of the first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[], [], [], []]
        held = 0
        for batch in batches:
            for part in slices(batch):
                words, at, starts = segmented(part.column("text"), "stretch")
                for i, units in enumerate(part.column("units")):
                    own = _bounds(starts, at, i)
                    inside = np.zeros(max(0, own[-1] - least) + 1, dtype=np.int64)
                    for code in units.values.to_numpy(zero_copy_only=False):
                        u, what = int(code) >> 2, int(code) & 3
                        lo, hi = max(0, own[u + 1] - least - 1), min(own[u] + 1, len(inside) - 1)
                        if what == BEFORE:
                            lo = max(lo, own[u] - BEYOND)
                        elif what == BEHIND:
                            hi = min(hi, own[u + 1] - least + BEYOND)
                        elif what == START:
                            lo = own[u]
                        if lo < hi:
                            inside[lo] += 1
                            inside[hi] -= 1
                    place = np.flatnonzero(np.cumsum(inside) > 0)
                    if len(place):
                        text = words[at[i] : at[i + 1]]
                        same = np.ones(len(place), dtype=np.int64)
                        new = (sequence_hashes(text, place, place + least + 1).view(np.int64), same * part.column("doc_id")[i].as_py(), same * part.column("hash")[i].as_py(), place.astype(np.int32))
                        for col, x in zip(cols, new, strict=True):
                            col.append(x)
                        held += len(place)
                if held > LOCAL:
                    yield from _firsts(cols, least + 1)
                    cols, held = [[], [], [], []], 0
        yield from _firsts(cols, least + 1)

    return run


def _later(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by digest and rank: all that aren't the first of their digest."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if held is not None:
                cols = [np.concatenate([[h], c]) for h, c in zip(held, cols, strict=True)]
            digest, doc, text, unit = cols
            n = len(digest)
            first = np.ones(n, dtype=bool)
            first[1:] = digest[1:] != digest[:-1]
            lead = np.maximum.accumulate(np.where(first, np.arange(n), 0))
            same = (doc == doc[lead]) & (text == text[lead])
            out = ~first & ~(same & (unit == unit[lead]))
            if out.any():
                place = beyond(unit, unit[lead], same, length) if length else unit
                yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (doc, text, place)], names=["doc_id", "hash", "unit"])
            held = [c[lead[-1]] for c in cols]

    return run


def _cut(least: int, kind: str):
    """found: the windows of least + 1 words that repeat, as beyond() gives them, or the lines or paragraphs that do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out: list[list] = [[], [], []]
                texts = part.column("text")
                offsets, data = string_buffers(texts)
                if kind != "stretch":
                    _, at, starts = segmented(texts, kind)
                for i, found in enumerate(part.column("found")):
                    text = texts[i].as_py()
                    spans, n = [], 0
                    if text and found.is_valid:
                        places = np.unique(found.values.to_numpy(zero_copy_only=False))
                        raw = data[offsets[i] : offsets[i + 1]]
                        if kind == "stretch":
                            at_word, stay = np.divmod(places, least + 1)
                            gone = sorted(zip((at_word + stay).tolist(), (at_word + least + 1).tolist(), strict=True))
                        else:
                            own = _bounds(starts, at, i)
                            gone = [(int(own[lo]), int(own[hi])) for lo, hi in runs(places) if own[hi] - own[lo] > least]
                        spans, n = passages(gone, raw)
                        if spans:
                            raw = raw.tobytes()
                            kept, chars, at_byte, at_char = [], [], 0, 0
                            for lo, hi in spans:
                                kept.append(raw[at_byte:lo])
                                start = at_char + len(kept[-1].decode())
                                at_char = start + len(raw[lo:hi].decode())
                                chars.append({"start": start, "end": at_char})
                                at_byte = hi
                            text, spans = (b"".join(kept) + raw[at_byte:]).decode(), chars
                    out[0].append(text)
                    out[1].append(spans)
                    out[2].append(n)
                cols = [part.column("row"), pa.array(out[0], pa.string()), pa.array(out[1], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(out[2], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "text", "removed", "removed_words"])

    return run


def passages(gone: list[tuple[int, int]], raw: np.ndarray) -> tuple[list[tuple[int, int]], int]:
    """Byte spans of a text and the number of their words, from runs of words (first, end) in order that may overlap; white space behind a run goes with it."""
    first, _ = word_spans(raw)
    spans: list[tuple[int, int]] = []
    for lo, hi in gone:
        if spans and lo <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(hi, spans[-1][1]))
        else:
            spans.append((lo, hi))
    return [(int(first[a]), int(first[b]) if b < len(first) else len(raw)) for a, b in spans], sum(b - a for a, b in spans)


def _repeats(local: DataFrame, length: int = 0) -> DataFrame:
    """doc_id, hash and the places of all that isn't the first occurrence of its digest (of windows of so many words as beyond() gives them)."""
    unit = "doc_id long, hash long, unit long"
    later = local.where("first").select("digest", "doc_id", "hash", "unit").repartition(F.col("digest")).sortWithinPartitions("digest", "doc_id", "hash", "unit").mapInArrow(lean(_later(length)), unit)
    gone = later.unionByName(local.where("NOT first").select("doc_id", "hash", "unit"))
    return gone.groupBy("doc_id", "hash").agg(F.collect_set("unit").alias("units"))


def dedup_passages(documents: DataFrame, least_words: int = 50, unit: str = "stretch") -> DataFrame:
    """documents with repeated passages removed from text, and columns removed and removed_words.

    unit: stretch (passages of over least_words words go, wherever they begin and end), line or paragraph (runs of whole
    lines, or of paragraphs between blank lines, of over least_words words in all go; 0 takes every repeated one).
    removed: spans (start, end) in characters of the original text, with the white space behind
    them; removed_words: their words.  A unit that repeats is kept where its
    (doc_id, text hash, place) is least, nulls of doc_id last; of a window that overlaps its own first occurrence only the words beyond that one go.  Rows with the same doc_id and
    text are one occurrence and come out alike.  Null texts stay null, empty
    ones empty; a text that is all repeated becomes empty, its row stays.
    Other columns stay as they are (removed and removed_words of the input are replaced).
    """
    if unit not in UNITS:
        raise ValueError(f"unit is none of {UNITS}: {unit}")
    keep = [c for c in documents.columns if c not in ("removed", "removed_words")]
    rest = [c for c in keep if c != "text"]
    docs = documents.select(
        F.struct(*named(rest)).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)).alias("hash"), F.col("text").cast("string").alias("text")
    )
    local = materialize(docs.select("doc_id", "hash", "text").mapInArrow(lean(_local(unit)), _UNIT), "units")
    key = ["doc_id", "hash"]
    repeated = materialize(_repeats(local), "repeats")
    joined = docs.join(repeated, key, "left").select("row", *key, "text", "units")
    if unit == "stretch":
        joined = materialize(joined, "repeated")
        doubts = materialize(joined.where("units IS NOT NULL").select("text", "units").mapInArrow(lean(_doubts(least_words)), "digest long, what int").distinct(), "doubts")
        holders = materialize(local.join(doubts, "digest").groupBy(*key).agg(F.collect_set(F.expr("unit * 4 + what")).alias("units")), "holders")
        release(local, doubts, repeated)
        windows = materialize(joined.select(*key, "text").join(holders, key).mapInArrow(lean(_windows(least_words)), _UNIT), "windows")
        release(holders)
        seen = materialize(_repeats(windows, least_words + 1).withColumnRenamed("units", "found"), "seen")
        release(windows)
        judged = joined.drop("units").join(seen, key, "left").select("row", "text", "found")
    else:
        judged = joined.select("row", "text", F.col("units").alias("found"))
    done = judged.mapInArrow(lean(_cut(least_words, unit)), extended(judged.schema, "removed array<struct<start: bigint, end: bigint>>, removed_words long", without=("found",)))
    return done.select(*[F.col("text") if c == "text" else part_of("row", c) for c in keep], "removed", "removed_words")
