"""Ingestion: documents and metadata to chunk records, their review, and the index."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Bm25Spec, ChunkSpec, IndexSpec
from ..functions.text import pipe_split
from ..operators.patterns import LEGAL, PatternSet
from ..operators.retrieve import sparse_vector
from ..operators.segment import chunk_review, segment, split_long
from ..operators.splitter import Tokenizer
from ..schemas import METADATA_COLUMNS
from ..sources.files import check_columns
from ..sources.index_store import to_points, write_index
from .models import Embedder


@dataclass(frozen=True)
class Ingested:
    """Chunks and review share one cached table of parts; release() gives it back."""

    chunks: DataFrame
    review: DataFrame
    skipped: DataFrame
    parts: DataFrame

    def release(self) -> None:
        self.parts.unpersist()


def with_metadata(docs: DataFrame, metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with a metadata row, and the ids of those without one."""
    check_columns(metadata, METADATA_COLUMNS)
    meta = metadata.select(*METADATA_COLUMNS)
    return docs.join(meta, "doc_id"), docs.join(meta.select("doc_id"), "doc_id", "left_anti").select("doc_id")


def ingest(docs: DataFrame, metadata: DataFrame, spec: ChunkSpec | None = None, tokenizer: Tokenizer | None = None, patterns: PatternSet = LEGAL) -> Ingested:
    """Chunk records of all documents with metadata, their review, and the ids without metadata."""
    known, skipped = with_metadata(docs.select("doc_id", "text"), metadata)
    parts = split_long(segment(known.select("doc_id", "text"), spec, tokenizer, patterns), spec, tokenizer).persist()
    meta = metadata.select("doc_id", "doc_name", "doc_date", "source_url", pipe_split(F.col("exams_id")).alias("exams_id"), pipe_split(F.col("tema")).alias("tema"))
    chunks = parts.join(meta, "doc_id").select("doc_id", "doc_name", "doc_date", "source_url", "exams_id", "tema", "tipo_seccion", "seccion", "n_tokens", "content", "section_seq", "part_seq")
    return Ingested(chunks, chunk_review(parts), skipped, parts)


def embed_column(embedder: Embedder):
    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in embedder.embed(texts.fillna("").tolist())])

    return embed


def build_index(chunks: DataFrame, embedder: Embedder, spec: IndexSpec, doc_ids: list[str] | None = None, bm25: Bm25Spec | None = None) -> None:
    """Both vectors of each chunk are stored: a search counts no text again."""
    points = to_points(chunks).withColumn(spec.dense, embed_column(embedder)("content")).withColumn(spec.sparse, sparse_vector(F.col("content"), bm25))
    write_index(points, spec, doc_ids)
