"""Evaluation: query processing, the retrieval sweep, judged generation and the report, as phases that leave artifacts."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..config import EvalSpec, RetrievalSpec
from ..functions.text import normalize_ref, or_else
from ..operators.metrics import graded, ground_truth_failures, ground_truth_ranks, rank_records, ranks_of, require_all
from ..schemas import GENERATION_RECORD, QUERY_RECORD, RANK_RECORD
from ..sources.jsonl import append, load_completed, reset
from .answer import Components, answer, process_queries, retrieve_sweep
from .models import Judge
from .report import build_report


def as_queries(rows: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    return rows.select(F.col("row_id").alias("query_id"), F.col("question").alias("query"), F.lit(None).cast("string").alias("history"), "exam", empty.alias("temas"))


def evaluate_queries(rows: DataFrame, components: Components, spec: EvalSpec | None = None) -> DataFrame:
    """A record per row, off-topic ones included, with the milliseconds of each."""
    spec = spec or EvalSpec()
    done = process_queries(as_queries(rows), components.query_model).select(F.col("query_id").alias("row_id"), "condensed_query", F.col("relevance").alias("verdict"), "duration_ms")
    return rows.select("row_id", "exam", "question_type", "question").join(done, "row_id").withColumn("actual_off_topic", F.col("question_type") == spec.off_topic).withColumn("edited", ~F.col("question").eqNullSafe(F.col("condensed_query")))


def evaluate_retrieval(rows: DataFrame, processed: DataFrame, points: DataFrame, components: Components, spec: RetrievalSpec | None = None) -> DataFrame:
    """row_id, question_type, k, rank: graded rows searched once, without temas, and judged at each depth of the grid.

    Raises if ground truth is missing from the index, with all failing rows counted.
    """
    spec = spec or RetrievalSpec()
    asked = require_all(graded(rows), processed.select("row_id", "condensed_query"))
    chunks = points.select("metadata.doc_id", "metadata.seccion", "metadata.tipo_seccion")
    failures = ground_truth_failures(rows, chunks)
    n = failures.count()
    if n:
        raise ValueError(f"{n} rows without ground truth, e.g. {[r.row_id for r in failures.orderBy('row_id').limit(5).collect()]}")
    queries = as_queries(asked).join(asked.select(F.col("row_id").alias("query_id"), "condensed_query"), "query_id")
    found = retrieve_sweep(queries, points, components.embedder, spec)
    names = points.select("point_id", F.col("metadata.doc_id").alias("doc_id"), normalize_ref(or_else(F.col("metadata.seccion"), F.col("metadata.tipo_seccion"))).alias("ref"))
    results = found.join(names, "point_id").select(F.col("query_id").alias("row_id"), "k", "rank", "doc_id", "ref")
    grid = F.explode(F.array(*[F.lit(k) for k in spec.k_grid])).alias("k")
    expected = asked.select("row_id", "question_type", grid, F.col("ground_truth_doc_id").alias("doc_id"), normalize_ref(F.col("ground_truth_ref")).alias("ref"))
    return ground_truth_ranks(expected, results)


#: What the judge is asked, for each score by itself; own wording.
RUBRICS = {
    "correctness": "Puntúa de 0 a 3 si la respuesta dice lo mismo que la de referencia: 3 todo lo esencial, 2 casi todo, 1 algo, 0 nada o lo contrario. Da una frase de motivo.",
    "faithfulness": "Puntúa de 0 a 3 si todo lo que dice la respuesta está en el contexto: 3 todo, 2 casi todo, 1 poco, 0 nada. Da una frase de motivo.",
}


def payload(rubric: str, row: dict) -> str:
    parts = {"pregunta": row.get("question"), "referencia": row.get("ground_truth_answer"), "respuesta": row.get("answer")} if rubric == "correctness" else {"contexto": row.get("context"), "respuesta": row.get("answer")}
    return "\n".join(f"<{k}>\n{v or ''}\n</{k}>" for k, v in parts.items())


def judge_rows(rows: DataFrame, judge: Judge) -> DataFrame:
    """rows: status, question, ground_truth_answer, answer, context, maybe harness_error.  Two scores, each asked for by itself, and judge_model.

    Zero with a reason where there is no answer to be judged (harness_error=, status=) and where the judge fails (judge_error=).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                scores, reason, model = ((0, ""), (0, "")), None, ""
                if row.get("harness_error"):
                    reason = f"harness_error={row['harness_error']}"
                elif row["status"] != "OK":
                    reason, model = f"status={row['status']}", judge.name
                else:
                    model = judge.name
                    try:
                        scores = tuple(judge.score(text, payload(rubric, row)) for rubric, text in RUBRICS.items())
                    except Exception as x:  # the row stays, with zeros
                        reason = f"judge_error={type(x).__name__}: {x}"
                out.append((*scores[0], *scores[1], reason, model))
            for i, c in enumerate(("correctness", "correctness_reason", "faithfulness", "faithfulness_reason", "zeroed_reason", "judge_model")):
                batch[c] = [r[i] for r in out]
            yield batch

    more = _parse_datatype_string("correctness int, correctness_reason string, faithfulness int, faithfulness_reason string, zeroed_reason string, judge_model string")
    return rows.mapInPandas(run, StructType([*rows.schema.fields, *more.fields]))


def evaluate_generation(rows: DataFrame, processed: DataFrame, points: DataFrame, components: Components, judge: Judge, k: int = 5) -> DataFrame:
    """Graded rows answered from the recorded query processing and judged; a run that fails as a whole is a row's harness_error, not an end."""
    asked = require_all(graded(rows), processed.select("row_id", "condensed_query", "verdict"))
    ready = as_queries(asked).join(asked.select(F.col("row_id").alias("query_id"), "condensed_query", F.col("verdict").alias("relevance")), "query_id")
    keep = ["status", "relevance", "answer", "context", "session_id", "timestamp_utc", "durations_ms", "harness_error"]
    try:
        traces = answer(ready, points, components, k, processed=ready)
        context = F.array_join(F.transform("final_chunks", lambda c: c["content"]), "\n")
        traces = traces.select(F.col("query_id").alias("row_id"), "status", "relevance", "answer", context.alias("context"), F.concat(F.lit("eval-"), "query_id").alias("session_id"), "timestamp_utc", "durations_ms", F.lit(None).cast("string").alias("harness_error"))
    except Exception as x:  # one bad run must not end an evaluation
        failed = {"status": F.lit("HARNESS_ERROR"), "answer": F.lit(""), "context": F.lit(""), "timestamp_utc": F.lit(""), "durations_ms": F.create_map().cast("map<string,double>"), "harness_error": F.lit(f"{type(x).__name__}: {str(x)[:300]}")}
        traces = ready.select(F.col("query_id").alias("row_id"), "relevance", F.concat(F.lit("eval-"), "query_id").alias("session_id"), *[c.alias(n) for n, c in failed.items()])
    joined = asked.join(traces, "row_id").select("row_id", "exam", "question_type", "question", "ground_truth_answer", *keep)
    return judge_rows(joined, judge).drop("context", "harness_error")


@dataclass(frozen=True)
class Artifacts:
    """Where the phases leave their records, as folders of JSON lines, and the report."""

    folder: str

    def path(self, phase: str) -> str:
        return f"{self.folder.rstrip('/')}/{phase}"


@dataclass(frozen=True)
class Batches:
    """How the questions of a phase are recorded: in so many batches, each once it is done; resume: without those that are recorded."""

    count: int = 1
    resume: bool = False

    def pending(self, rows: DataFrame, path: str, schema: str) -> Iterator[DataFrame]:
        """The batches to be done.  Without resume the records of the phase are removed first."""
        spark = rows.sparkSession
        if not self.resume:
            reset(spark, path)
        for part in range(self.count):
            some = rows if self.count == 1 else rows.where(F.pmod(F.xxhash64("row_id"), F.lit(self.count)) == part)
            if self.resume:
                some = some.join(load_completed(spark, path, schema).select("row_id"), "row_id", "left_anti")
                if some.isEmpty():
                    continue
            yield some


def run_query_processing(rows: DataFrame, components: Components, out: Artifacts, batches: Batches | None = None) -> None:
    """Every question, on and off topic."""
    path = out.path("query_processing")
    for some in (batches or Batches()).pending(rows, path, QUERY_RECORD):
        append(evaluate_queries(some, components).select(*_names(QUERY_RECORD)), path)


def run_retrieval(rows: DataFrame, points: DataFrame, components: Components, out: Artifacts, spec: RetrievalSpec | None = None, batches: Batches | None = None) -> None:
    """Ranks of the expected sections at each depth, from the recorded condensed queries."""
    processed = load_completed(rows.sparkSession, out.path("query_processing"), QUERY_RECORD)
    for some in (batches or Batches()).pending(graded(rows), out.path("retriever"), RANK_RECORD):
        start = time.perf_counter()
        ranks = evaluate_retrieval(some, processed, points, components, spec).persist()
        searched = max(1, ranks.select("row_id").distinct().count())
        ms = (time.perf_counter() - start) * 1000 / searched
        found = rank_records(ranks.withColumn("ms", F.lit(ms)))
        asked = require_all(graded(some), processed.select("row_id", "condensed_query"))
        append(asked.join(found, "row_id").select(*_names(RANK_RECORD)), out.path("retriever"))
        ranks.unpersist()


def run_generation(rows: DataFrame, points: DataFrame, components: Components, judge: Judge, out: Artifacts, k: int = 5, batches: Batches | None = None) -> None:
    """Answers and their scores, from the recorded query processing."""
    processed = load_completed(rows.sparkSession, out.path("query_processing"), QUERY_RECORD)
    for some in (batches or Batches()).pending(graded(rows), out.path("generation"), GENERATION_RECORD):
        append(evaluate_generation(some, processed, points, components, judge, k).select(*_names(GENERATION_RECORD)), out.path("generation"))


def run_report(rows: DataFrame, out: Artifacts, spec: EvalSpec | None = None) -> str:
    """The report of all artifacts that there are."""
    load = lambda phase, schema: load_completed(rows.sparkSession, out.path(phase), schema)
    return build_report(rows, load("query_processing", QUERY_RECORD), ranks_of(load("retriever", RANK_RECORD)), load("generation", GENERATION_RECORD), spec)


def run_all(rows: DataFrame, points: DataFrame, components: Components, judge: Judge, out: Artifacts, phases: tuple[str, ...] = ("query_processing", "retrieval", "generation", "report"), batches: Batches | None = None) -> str | None:
    """The phases asked for, in order; each reads what the ones before have left, so any of them can be run again by itself.

    A run that was stopped goes on with Batches(n, resume=True): questions that are recorded aren't asked again.
    """
    if "query_processing" in phases:
        run_query_processing(rows, components, out, batches)
    if "retrieval" in phases:
        run_retrieval(rows, points, components, out, batches=batches)
    if "generation" in phases:
        run_generation(rows, points, components, judge, out, batches=batches)
    return run_report(rows, out) if "report" in phases else None


def _names(schema: str) -> list[str]:
    return _parse_datatype_string(schema).fieldNames()
