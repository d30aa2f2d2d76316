"""Questions to answers: verdict, retrieval, context and generation, for a batch of questions.

Each gate is a status, and what a gate stops doesn't reach the next stage.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..config import ContextSpec, IndexSpec, RetrievalSpec
from ..functions.text import or_else
from ..operators.block_search import build_dense, build_sparse, hybrid_stored
from ..operators.context import mark_kept, render, within_budget
from ..operators.history import tail_array, user_turn
from ..operators.retrieve import dense_topk, effective_temas, fuse, inverted_index, k_sweep, postings, query_terms, sparse_topk, to_result, top
from .ingest import embed_column
from .models import Embedder, ExtractiveGenerator, GenerationConfig, Generator, HashingEmbedder, KeywordQueryModel, QueryModel

#: What the user is told where there is no answer; own wording.
MESSAGES = {
    "OK": "",
    "OFF_TOPIC": "La pregunta queda fuera del temario.",
    "NO_CONTEXT": "No se han encontrado fragmentos para esta pregunta.",
    "RETRIEVAL_ERROR": "La búsqueda ha fallado. Inténtalo de nuevo.",
    "GENERATION_ERROR": "La respuesta no se ha podido completar.",
}
SYSTEM_PROMPT = "Responde solo con los fragmentos numerados y cita su número entre corchetes. Si no bastan, dilo."
CONTEXT_MARK = "Contexto:\n"
CONDENSE_PROMPT = "Di si la consulta trata de las normas del temario (SI o NO) y reescríbela para que se entienda sin la conversación."


@dataclass(frozen=True)
class Components:
    embedder: Embedder = field(default_factory=HashingEmbedder)
    query_model: QueryModel = field(default_factory=KeywordQueryModel)
    generator: Generator = field(default_factory=ExtractiveGenerator)
    generation: GenerationConfig = field(default_factory=GenerationConfig)


def verdict(label: F.Column) -> F.Column:
    """SI is relevant, NO off topic, all else (a reply that can't be read, too) unknown."""
    return F.when(label == "SI", "RELEVANT").when(label == "NO", "OFF_TOPIC").otherwise("UNKNOWN")


def as_text(rows: DataFrame, column: str = "history") -> F.Column:
    """A history as a transcript: turns (role, content) as labelled lines, a text as it is."""
    if rows.schema[column].dataType.typeName() != "array":
        return F.col(column)
    line = lambda t: F.concat(F.when(t["role"] == "user", "Usuario: ").otherwise("Asistente: "), F.coalesce(t["content"], F.lit("")))
    return F.array_join(F.transform(column, line), "\n")


def process_queries(queries: DataFrame, model: QueryModel) -> DataFrame:
    """queries (query_id, query, history) with relevance, condensed_query and duration_ms; a failure is UNKNOWN and the raw query.

    The model runs once per batch, in a map over partitions: a filter on its result doesn't run it again.
    """
    rows = queries.withColumn("__turn", user_turn(F.col("query"), as_text(queries)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            start = time.perf_counter()
            try:
                replies = model.predict_batch(batch["__turn"].tolist())
            except Exception:  # fails open, as the contract of this stage says
                replies = [None] * len(batch)
            batch["__label"] = [r[0] if r else None for r in replies]
            batch["__condensed"] = [r[1] if r else None for r in replies]
            batch["duration_ms"] = (time.perf_counter() - start) * 1000 / max(1, len(batch))
            yield batch

    rows = rows.drop("duration_ms")
    done = rows.mapInPandas(run, StructType([*rows.schema.fields, *_parse_datatype_string("__label string, __condensed string, duration_ms double").fields]))
    return done.withColumn("relevance", verdict(F.col("__label"))).withColumn("condensed_query", or_else(F.col("__condensed"), F.col("query"))).drop("__turn", "__label", "__condensed")


def branches(queries: DataFrame, points: DataFrame, embedder: Embedder, k: int, spec: RetrievalSpec, index: IndexSpec) -> tuple[DataFrame, DataFrame]:
    """The k best of the dense and of the sparse search, each within the filter of its query.

    By the stored block indexes where the index has them; else stored sparse vectors are taken where there are any.
    """
    asked = queries.select("query_id", F.col("condensed_query").alias("text"), "exam", effective_temas(F.col("exam"), F.col("temas")).alias("temas"), embed_column(embedder)("condensed_query").alias("dense"))
    if index.blocks:
        return hybrid_stored(asked, f"{index.blocks}/sparse", f"{index.blocks}/dense", k, spec.bm25)
    payload = points.select("point_id", F.col(index.dense).alias("dense"), F.col("metadata.exams_id").alias("exams_id"), F.col("metadata.tema").alias("tema"))
    dense = dense_topk(asked, payload, k)
    wanted = query_terms(asked, spec.bm25)
    stored = index.sparse in points.columns and not spec.bm25.idf
    found = postings(points, wanted, index.sparse) if stored else inverted_index(points, spec.bm25, wanted=wanted)
    sparse = sparse_topk(asked, payload, found, k, spec.bm25)
    return dense, sparse


def build_blocks(points: DataFrame, index: IndexSpec, spec: RetrievalSpec | None = None) -> None:
    """Write the block indexes of points (point_id, content, metadata and the dense vectors) into the index's folder for them."""
    payload = [F.col("metadata.exams_id").alias("exams_id"), F.col("metadata.tema").alias("tema")]
    build_sparse(points.select("point_id", "content", *payload), f"{index.blocks}/sparse", (spec or RetrievalSpec()).bm25)
    build_dense(points.select("point_id", F.col(index.dense).alias("dense"), *payload), f"{index.blocks}/dense")


def retrieve(queries: DataFrame, points: DataFrame, embedder: Embedder, k: int, spec: RetrievalSpec | None = None, index: IndexSpec | None = None) -> DataFrame:
    """queries: query_id, condensed_query, exam, temas.  Filtered hybrid search; the filter comes before any ranking."""
    spec = spec or RetrievalSpec()
    found = branches(queries, points, embedder, k, spec, index or IndexSpec(""))
    return to_result(top(fuse(list(found), spec.fusion), k), points)


def retrieve_sweep(queries: DataFrame, points: DataFrame, embedder: Embedder, spec: RetrievalSpec | None = None, index: IndexSpec | None = None) -> DataFrame:
    """The results of retrieve at each depth of the grid (k, query_id, point_id, score, rank) from one search."""
    spec = spec or RetrievalSpec()
    dense, sparse = branches(queries, points, embedder, max(spec.k_grid), spec, index or IndexSpec(""))
    return k_sweep(dense.select("query_id", "point_id", "score"), sparse.select("query_id", "point_id", "score"), spec)


def prompt(context: F.Column, query: F.Column, history: F.Column | None = None) -> F.Column:
    """The rules, the transcript of the last turns if there is one, the context and the question."""
    parts = [F.lit(SYSTEM_PROMPT)] if history is None else [F.lit(SYSTEM_PROMPT), F.nullif(F.coalesce(history, F.lit("")), F.lit(""))]
    return F.concat_ws("\n\n", *parts, F.concat(F.lit(CONTEXT_MARK), context), F.concat(F.lit("Pregunta: "), query))


def generate(rows: DataFrame, generator: Generator, settings: GenerationConfig | None = None) -> DataFrame:
    """rows with prompt; adds answer, error and generate_ms.  What came before a failure is kept; empty fragments are skipped."""
    settings = (settings or GenerationConfig()).filled()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for text in batch["prompt"]:
                start, parts, error = time.perf_counter(), [], None
                for part, failure in _fragments(generator, text, settings):
                    parts.append(part)
                    error = failure
                done.append(("".join(parts), error, (time.perf_counter() - start) * 1000))
            for i, c in enumerate(("answer", "error", "generate_ms")):
                batch[c] = [r[i] for r in done]
            yield batch

    return rows.mapInPandas(run, StructType([*rows.schema.fields, *_parse_datatype_string("answer string, error string, generate_ms double").fields]))


def _fragments(generator: Generator, text: str, settings: GenerationConfig) -> Iterator[tuple[str, str | None]]:
    """The fragments of one answer as they come, empty ones left out; a failure is the last, with its text."""
    try:
        for part in next(iter(generator.generate_batch([text], settings))):
            if part:
                yield part, None
    except Exception as x:  # recorded in the trace
        yield "", f"{type(x).__name__}: {x}"


def stream_fragments(rows: DataFrame, generator: Generator, settings: GenerationConfig | None = None) -> DataFrame:
    """rows: query_id, prompt; a table or a stream.  query_id, seq, fragment, error: each fragment as a row of its own, in the order they come."""
    settings = (settings or GenerationConfig()).filled()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for query_id, text in zip(batch["query_id"], batch["prompt"], strict=True):
                for seq, (part, error) in enumerate(_fragments(generator, text, settings)):
                    yield pd.DataFrame({"query_id": [query_id], "seq": [seq], "fragment": [part], "error": [error]})

    kind = rows.schema["query_id"].dataType.simpleString()
    return rows.select("query_id", "prompt").mapInPandas(run, f"query_id {kind}, seq int, fragment string, error string")


def messages() -> F.Column:
    return F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])


def status(relevance: F.Column, blocks: F.Column, error: F.Column, failed: bool = False) -> F.Column:
    """The gates in order: off topic, a search that failed, no context, an answer that failed; OK behind all of them."""
    empty = F.coalesce(blocks, F.lit("")) == ""
    return F.when(relevance == "OFF_TOPIC", "OFF_TOPIC").when(F.lit(failed), "RETRIEVAL_ERROR").when(empty, "NO_CONTEXT").when(error.isNotNull(), "GENERATION_ERROR").otherwise("OK")


#: What a trace says of each chunk that was found.
RETRIEVED = "array<struct<rank: int, point_id: string, doc_id: string, seccion: string, retrieval_score: double, content: string, kept: boolean>>"
SOURCES = "array<struct<index: int, doc_name: string, seccion: string, source_url: string, doc_id: string, point_id: string>>"


def retrieved(found: DataFrame, kept: DataFrame) -> DataFrame:
    """query_id and retrieved: the chunks found in order, with scores and whether they went into the context."""
    item = F.struct(F.col("rank").cast("int").alias("rank"), "point_id", F.col("metadata.doc_id").alias("doc_id"), F.col("metadata.seccion").alias("seccion"), "retrieval_score", "content", "kept")
    return mark_kept(found, kept).groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("retrieved"))


def answer(
    queries: DataFrame, points: DataFrame, components: Components | None = None, k: int | None = None, spec: RetrievalSpec | None = None, context: ContextSpec | None = None,
    processed: DataFrame | None = None, session_id: str | None = None, timestamp_utc: str | None = None, models: dict[str, str] | None = None, index: IndexSpec | None = None,
) -> DataFrame:
    """One trace per question, whatever fails: query_id, exam, temas, query, condensed_query, relevance, status, message, answer, blocks, retrieved, final_chunks, sources, error, session_id, timestamp_utc, models, durations_ms.

    queries: query_id, query, history (turns or a transcript), exam, temas.  processed: results of process_queries, if they exist already.
    The query model sees the whole history, the generator its last turns.
    A failure of the search as a whole is a status of all its questions.  Durations are those of a question (of its
    share in a batch).  The traces are cached, and nothing else is: unpersist them when done.
    """
    components, spec, context = components or Components(), spec or RetrievalSpec(), context or ContextSpec()
    k = k or spec.top_k
    held: list[DataFrame] = []

    def keep(df: DataFrame) -> tuple[DataFrame, int]:
        held.append(df.persist())
        return held[-1], held[-1].count()

    asked, _ = keep(process_queries(queries, components.query_model) if processed is None else processed)
    open_ = asked.where("relevance <> 'OFF_TOPIC'")
    failure = search_ms = None
    try:
        start = time.perf_counter()
        found, _ = keep(retrieve(open_, points, components.embedder, k, spec, index))
        search_ms = (time.perf_counter() - start) * 1000 / max(1, open_.count())
        kept = within_budget(found, context)
        blocks = render(kept, open_).join(retrieved(found, kept), "query_id", "left")
        turns = tail_array(F.col("history"), context.history) if asked.schema["history"].dataType.typeName() == "array" else F.col("history")
        last = open_.select("query_id", "condensed_query", turns.alias("history"))
        some = blocks.where("blocks <> ''").join(last, "query_id")
        some = some.withColumn("prompt", prompt(F.col("blocks"), F.col("condensed_query"), as_text(some)))
        said, _ = keep(generate(some, components.generator, components.generation).select("query_id", "blocks", "sources", "retrieved", "answer", "error", "generate_ms"))
    except Exception as x:  # the contract of this stage: a status, not an exception
        failure = f"{type(x).__name__}: {str(x)[:500]}"
        said = asked.select("query_id", F.lit("").alias("blocks"), F.array().cast(SOURCES).alias("sources"), F.array().cast(RETRIEVED).alias("retrieved"), F.lit("").alias("answer"), F.lit(failure).alias("error"), F.lit(None).cast("double").alias("generate_ms"))
    rows = asked.join(said, "query_id", "left")
    ms = {"relevance": F.col("duration_ms") if processed is None else F.lit(None), "retrieve": F.when((F.col("relevance") != "OFF_TOPIC") & F.lit(failure is None), F.lit(search_ms)), "generate": F.col("generate_ms")}
    durations = F.map_filter(F.create_map(*[x for name, c in ms.items() for x in (F.lit(name), c.cast("double"))]), lambda _, v: v.isNotNull())
    total = F.aggregate(F.map_values(durations), F.lit(0.0), lambda s, x: s + x)
    named = F.create_map(*[F.lit(x) for pair in (models or {}).items() for x in pair]).cast("map<string,string>")
    state = status(F.col("relevance"), F.col("blocks"), F.col("error"), failure is not None)
    chunks = F.coalesce("retrieved", F.array().cast(RETRIEVED))
    rows = (
        rows.withColumn("status", state)
        .withColumn("message", messages()[F.col("status")])
        .withColumn("answer", F.coalesce("answer", F.lit("")))
        .withColumn("retrieved", chunks)
        .withColumn("final_chunks", F.filter("retrieved", lambda c: c["kept"]))
        .withColumn("session_id", F.lit(session_id or uuid.uuid4().hex))
        .withColumn("timestamp_utc", F.lit(timestamp_utc or datetime.now(UTC).isoformat()))
        .withColumn("models", named)
        .withColumn("durations_ms", F.map_concat(durations, F.create_map(F.lit("total"), total)))
        .drop("duration_ms", "generate_ms")
        .persist()
    )
    rows.count()
    for df in held:
        df.unpersist()
    return rows


def next_history(history: F.Column, query: F.Column, said: F.Column) -> F.Column:
    """The turns of question and answer go behind the history if there was any answer (a partial one, too)."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.when(F.coalesce(said, F.lit("")) != "", F.concat(history, F.array(turn("user", query), turn("assistant", said)))).otherwise(history)
