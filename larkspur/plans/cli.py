"""python -m larkspur.plans.cli ingest FOLDER METADATA | ask QUESTION: the index, and one question against it.

The index is the folder in LARKSPUR_INDEX, or --index.  ask ends with 0 if there is an answer.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import Row, SparkSession

from ..config import EXAMS, TEMAS, IndexSpec
from ..sources.files import read_corpus, read_metadata, write_review
from ..sources.index_store import read_index
from .answer import answer
from .ingest import build_index, ingest
from .models import HashingEmbedder


def show_trace(row: Row) -> str:
    lines = [f"{row.status} ({row.relevance})", f"query: {row.condensed_query}"]
    lines += [f"{c.doc_id:<12} {(c.seccion or '')[:30]:<30} {c.retrieval_score:.4f} {'kept' if c.kept else 'left out'}" for c in row.retrieved or []]
    lines += [f"[{s["index"]}] {s.doc_name or s.doc_id} {s.seccion or ''} {s.source_url or ''}".rstrip() for s in row.sources or []]
    lines += [f"{stage}: {ms:.0f} ms" for stage, ms in row.durations_ms.items()]
    return "\n".join([*lines, row.answer or row.message or ""])


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--index", default=None)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("ingest")
    one.add_argument("folder")
    one.add_argument("metadata")
    one.add_argument("--review")
    one.add_argument("--doc-id", action="append", default=[])
    two = commands.add_parser("ask")
    two.add_argument("question")
    two.add_argument("--exam", choices=EXAMS, default="A1")
    two.add_argument("--tema", choices=TEMAS, action="append", default=[], help="may be repeated; for exam A1 only")
    two.add_argument("-k", type=int, default=5)
    given = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    index = IndexSpec(given.index) if given.index else IndexSpec.from_environment(os.environ)
    if given.command == "ingest":
        done = ingest(read_corpus(spark, given.folder), read_metadata(spark, given.metadata))
        if given.review:
            write_review(done.review, given.review)
        build_index(done.chunks, HashingEmbedder(), index, given.doc_id)
        done.release()
        return 0
    temas = [] if "TODOS" in given.tema else given.tema
    asked = spark.createDataFrame([("1", given.question, [], given.exam, temas)], "query_id string, query string, history array<struct<role: string, content: string>>, exam string, temas array<string>")
    traces = answer(asked, read_index(spark, index, (given.exam,)), k=given.k, index=index)
    row = traces.first()
    traces.unpersist()
    print(show_trace(row))
    return 0 if row.status == "OK" else 1


if __name__ == "__main__":
    raise SystemExit(main())
