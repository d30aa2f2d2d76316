"""Settings, as frozen records that are passed to the operators."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

EXAMS = ("A1", "A2", "C1", "C2")
TEMAS = ("TODOS", "I", "II", "III", "IV", "V")
QUESTION_TYPES = ("with_ref", "standard", "with_options", "off_topic")
STATUSES = ("OK", "OFF_TOPIC", "NO_CONTEXT", "RETRIEVAL_ERROR", "GENERATION_ERROR")
VERDICTS = ("RELEVANT", "OFF_TOPIC", "UNKNOWN")
SECTION_TYPES = ("preambulo", "articulo", "disposicion", "titulo", "capitulo", "anexo", "none")


@dataclass(frozen=True)
class ChunkSpec:
    """Size limits in tokens; forced: ids whose headings aren't trusted.

    reject_leadins, exempt_ordinals: two further citation rules, off by default.
    """

    max_tokens: int = 1024
    overlap: int = 100
    forced: frozenset[str] = frozenset({"doc198"})
    reject_leadins: bool = False
    exempt_ordinals: bool = False

    def clamped(self, limit: int | None) -> ChunkSpec:
        """With no more tokens than the model takes."""
        return self if limit is None else replace(self, max_tokens=min(self.max_tokens, limit))


@dataclass(frozen=True)
class Bm25Spec:
    """Saturated term frequency with a fixed average length; idf, stop words and light stems (by language) on request."""

    k1: float = 1.2
    b: float = 0.75
    avg_len: float = 256.0
    idf: bool = False
    stop_words: tuple[str, ...] = ()
    language: str | None = None
    pattern: str = r"[^\p{L}]+"


@dataclass(frozen=True)
class FusionSpec:
    """Reciprocal ranks: sum of 1 / (k0 + rank), ranks from rank_base on."""

    k0: int = 2
    rank_base: int = 0


@dataclass(frozen=True)
class RetrievalSpec:
    top_k: int = 5
    k_grid: tuple[int, ...] = (1, 2, 3, 4, 5, 10, 20)
    bm25: Bm25Spec = field(default_factory=Bm25Spec)
    fusion: FusionSpec = field(default_factory=FusionSpec)


@dataclass(frozen=True)
class ContextSpec:
    budget: int = 3000
    chars_per_token: int = 3
    history: int = 6


@dataclass(frozen=True)
class IndexSpec:
    """Names shared by writer and reader of an index: the columns of its vectors, and how it lies on disk."""

    path: str
    dense: str = "dense"
    sparse: str = "sparse"
    buckets: int = 16
    blocks: str | None = None  # the folder of the stored block indexes (build_blocks), which searches then go by

    @staticmethod
    def from_environment(environ: Mapping[str, str]) -> IndexSpec:
        """LARKSPUR_INDEX and LARKSPUR_BUCKETS; without the first the folder `index` here."""
        return IndexSpec(environ.get("LARKSPUR_INDEX", "index"), buckets=int(environ.get("LARKSPUR_BUCKETS", "16")))


@dataclass(frozen=True)
class EvalSpec:
    k_grid: tuple[int, ...] = (1, 2, 3, 4, 5, 10, 20)
    max_score: int = 3
    off_topic: str = "off_topic"
    stages: tuple[str, ...] = ("retrieve", "generate", "total")
