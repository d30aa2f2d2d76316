"""Splitting of long texts into parts of a bounded number of tokens, with overlap.

A text is counted once: where its tokens start is one array, pieces and parts are ranges in it, and where a part
ends is found by binary search.  Only a tokenizer that can't say where its tokens start is asked piece by piece.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from functools import cache
from typing import Protocol

import numpy as np

SEPARATORS = ("\n\n", "\n", " ", "")


@cache
def _kinds() -> np.ndarray:
    """Of each character: 0 for white space, 1 for a letter, digit or underscore, 2 for another sign."""
    return np.fromiter((0 if c.isspace() else 1 if c.isalnum() or c == "_" else 2 for c in map(chr, range(0x110000))), dtype=np.uint8, count=0x110000)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class Tokenizer(Protocol):
    """starts (optional): where the tokens of a text start, for a tokenizer none of whose tokens holds or depends on white space."""

    #: Special tokens that go round a text.
    specials: int
    #: Tokens that the model takes at most, special ones included; None for any number.
    limit: int | None

    def count(self, text: str) -> int:
        """Tokens without special ones."""


class WordTokenizer:
    """An offline stand-in: words and single signs, long words in pieces of six letters."""

    specials = 2
    limit = None
    _token = re.compile(r"\w{1,6}|[^\w\s]")

    def starts(self, text: str) -> np.ndarray:
        kind = _kinds()[codes(text)]
        word, place = kind == 1, np.arange(len(kind), dtype=np.int32)
        first = word.copy()
        first[1:] &= ~word[:-1]
        begun = np.maximum.accumulate(np.where(first, place, 0)) if len(kind) else place
        return np.flatnonzero((kind == 2) | (word & ((place - begun) % 6 == 0)))

    def count(self, text: str) -> int:
        return len(self._token.findall(text))


class Splitter:
    def __init__(self, size: int, overlap: int, length: Callable[[str], int], separators: tuple[str, ...] = SEPARATORS, starts: Callable[[str], np.ndarray] | None = None) -> None:
        if overlap > size:
            raise ValueError("the overlap is larger than a part")
        self.size, self.overlap, self.length, self.separators, self.starts = size, overlap, length, separators, starts

    def split(self, text: str) -> list[str]:
        return [content for content, _ in self.parts(text)]

    def parts(self, text: str, starts: np.ndarray | None = None) -> list[tuple[str, int]]:
        """Contents without white space at their ends and their tokens; starts: those of the text, where they are known."""
        known = starts if starts is not None or self.starts is None else self.starts(text)
        within = lambda at: 0 < at < len(text) and not text[at - 1].isspace() and not text[at].isspace()  # noqa: E731  cut inside a word
        found = []
        for lo, hi, whole in self._ranges((text, codes(text)), 0, len(text), self.separators, known):
            part = text[lo:hi] if whole else text[lo:hi].strip()
            if part:
                found.append((part, self.length(part) if known is None or within(lo) or within(hi) else int(np.searchsorted(known, hi) - np.searchsorted(known, lo))))
        return found

    def _pieces(self, text: tuple[str, np.ndarray], lo: int, hi: int, separator: str) -> np.ndarray:
        """Where the pieces of a range begin, and its end: a separator stays at the start of what follows it."""
        if not separator:
            return np.arange(lo, hi + 1)
        if len(separator) == 1:
            places = lo + np.flatnonzero(text[1][lo:hi] == ord(separator))
        else:
            places = np.array([m.start() for m in re.compile(re.escape(separator)).finditer(text[0], lo, hi)], dtype=np.int64)
        return np.concatenate([[lo], places[places > lo], [hi]])

    def _ranges(self, text: tuple[str, np.ndarray], lo: int, hi: int, separators: tuple[str, ...], starts: np.ndarray | None) -> list[tuple[int, int, bool]]:
        """(start, end, whether it is a piece that no separator cuts further, which stays as it is); text: with its codes."""
        at = next((i for i, s in enumerate(separators) if not s or text[0].find(s, lo, hi) >= 0), len(separators) - 1)
        separator, finer = separators[at], separators[at + 1 :]
        bounds = self._pieces(text, lo, hi, separator)
        if starts is not None and separator:
            sizes = np.diff(np.searchsorted(starts, bounds))
        else:
            sizes = np.array([self.length(text[0][a:b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)], dtype=np.int64)
        found: list[tuple[int, int, bool]] = []
        first = 0
        for i in np.flatnonzero(sizes >= self.size).tolist():
            found += self._merged(bounds[first : i + 1], sizes[first:i])
            a, b = int(bounds[i]), int(bounds[i + 1])
            found += self._ranges(text, a, b, finer, starts) if finer else [(a, b, True)]
            first = i + 1
        return found + self._merged(bounds[first:], sizes[first:])

    def _merged(self, bounds: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, bool]]:
        """Runs of pieces within the size; each begins with what the one before ended with, up to the overlap and so that the next piece fits."""
        if not len(sizes):
            return []
        bounds, upto = bounds.tolist(), [0, *np.cumsum(sizes).tolist()]
        found, begin = [], 0
        while True:
            end = bisect_right(upto, upto[begin] + self.size, begin + 1) - 1  # most pieces that fit
            end = max(end, begin + 1)
            if end >= len(sizes):
                return [*found, (bounds[begin], bounds[-1], False)]
            found.append((bounds[begin], bounds[end], False))
            begin = min(end, bisect_left(upto, max(upto[end] - self.overlap, upto[end + 1] - self.size), begin))
