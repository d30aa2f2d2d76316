"""External models behind small interfaces, with deterministic offline stand-ins."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import ClassVar, Protocol

import numpy as np


@dataclass(frozen=True)
class GenerationConfig:
    """Null settings fall back to the defaults."""

    temperature: float | None = None
    max_tokens: int | None = None

    def filled(self, temperature: float = 0.2, max_tokens: int = 800) -> GenerationConfig:
        return GenerationConfig(temperature if self.temperature is None else self.temperature, max_tokens if self.max_tokens is None else self.max_tokens)


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class QueryModel(Protocol):
    def predict_batch(self, turns: list[str]) -> list[tuple[str, str] | None]:
        """(SI or NO, condensed query) per rendered user turn; None for a reply that can't be read."""


class Generator(Protocol):
    def generate_batch(self, prompts: list[str], settings: GenerationConfig) -> Iterable[Iterable[str]]:
        """Fragments of each answer, as they come."""


class Judge(Protocol):
    #: Name that goes into the records.
    name: str

    def score(self, instruction: str, payload: str) -> tuple[int, str]:
        """A whole score from 0 on and its reason, for one rubric."""


class Lazy:
    """A model that each Python worker builds once, at its first use; what travels to the workers is the factory."""

    _built: ClassVar[dict[str, object]] = {}

    def __init__(self, factory: Callable[[], object]) -> None:
        self.factory, self.key = factory, uuid.uuid4().hex

    def __getstate__(self) -> dict:
        return {"factory": self.factory, "key": self.key}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    def __getattr__(self, name: str) -> object:
        if name.startswith("__") or name in ("factory", "key"):
            raise AttributeError(name)
        if self.key not in Lazy._built:
            Lazy._built[self.key] = self.factory()
        return getattr(Lazy._built[self.key], name)


class HashingEmbedder:
    """Signed hashed term frequencies at length one."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"\w+", (text or "").lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                row[h % self.dim] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(row)
            if n:
                row /= n
        return out


class KeywordQueryModel:
    """Off topic if a query has none of the keywords; condenses white space."""

    def __init__(self, keywords: tuple[str, ...] = ()) -> None:
        self.keywords = tuple(k.lower() for k in keywords)

    def predict_batch(self, turns: list[str]) -> list[tuple[str, str] | None]:
        return [None if t is None else ("SI" if not self.keywords or any(k in t.lower() for k in self.keywords) else "NO", " ".join(t.split())) for t in turns]


class ExtractiveGenerator:
    """Answers with the first block of the context."""

    def generate_batch(self, prompts: list[str], settings: GenerationConfig) -> list[list[str]]:
        first = ((p or "").split("Contexto:\n", 1)[-1].split("\n\n")[0] for p in prompts)
        return [[x for x in re.split(r"(?<=\s)", block) if x][: settings.max_tokens] for block in first]


class OverlapJudge:
    """Scores 0 to 3 by the share of the words of one part of the payload in another: the reference's in the answer, or the answer's in the context."""

    name = "word-overlap"

    def score(self, instruction: str, payload: str) -> tuple[int, str]:
        parts = {k: set(re.findall(r"\w+", v.lower())) for k, v in re.findall(r"(?ms)^<(\w+)>\n(.*?)\n</\1>$", payload)}
        x, y = (parts["referencia"], parts["respuesta"]) if "referencia" in parts else (parts["respuesta"], parts["contexto"])
        return (round(3 * len(x & y) / len(x)) if x else 0), "word overlap"
