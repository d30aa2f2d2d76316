"""Numbered appends, evaluations that go on where they were stopped, answers by stored block indexes."""

from __future__ import annotations

import pytest
from larkspur.config import IndexSpec
from larkspur.plans import evaluate as E
from larkspur.plans.answer import Components, build_blocks, retrieve
from larkspur.plans.models import HashingEmbedder, KeywordQueryModel, OverlapJudge
from larkspur.schemas import GENERATION_RECORD, QUERY_RECORD, RANK_RECORD
from larkspur.sources import jsonl
from pyspark.sql import functions as F
from test_plans import index  # noqa: F401  (a fixture)

ROW = "row_id string, exam string, question_type string, question string, ground_truth_doc_id string, ground_truth_ref string, ground_truth_answer string"


def test_appends_are_ordered_by_their_numbers(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    for i, rows in enumerate(([("1", "a"), ("2", "a")], [("1", "b")], [("1", "c"), ("3", "c")]), 1):
        assert jsonl.append(spark.createDataFrame(rows, "row_id string, v string"), path) == i
    for f in sorted(tmp_path.rglob("*.json"), reverse=True):  # clocks that say the opposite
        f.touch()
    assert sorted(map(tuple, jsonl.load_completed(spark, path, "row_id string, v string").collect())) == [("1", "c"), ("2", "a"), ("3", "c")]


def test_an_append_that_fails_leaves_nothing_to_be_read(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    jsonl.append(spark.createDataFrame([("1", "a")], "row_id string, v string"), path)
    bad = spark.range(100).select(F.col("id").cast("string").alias("row_id"), F.when(F.col("id") == 99, F.raise_error(F.lit("x"))).otherwise("b").cast("string").alias("v"))
    with pytest.raises(Exception, match="x"):
        jsonl.append(bad, path)
    assert [tuple(r) for r in jsonl.load_completed(spark, path, "row_id string, v string").collect()] == [("1", "a")] and jsonl.appends(spark, path) == 1


def test_a_stopped_run_goes_on(spark, index, tmp_path, monkeypatch):  # noqa: F811
    rows = spark.createDataFrame([(f"r{i}", "A1", "off_topic" if i % 4 == 3 else "standard", "receta de paella" if i % 4 == 3 else "plazos de recurso" if i % 2 else "tasas", "ley1", f"Artículo {1 if i % 2 else 2}.", "un mes") for i in range(10)], ROW)
    parts = Components(query_model=KeywordQueryModel(("plazos", "tasas")))
    whole, stopped = E.Artifacts(f"file://{tmp_path}/whole"), E.Artifacts(f"file://{tmp_path}/stopped")
    report = E.run_all(rows, index, parts, OverlapJudge(), whole)
    real, done = jsonl.append, []

    def killed(records, path):
        if len(done) == 2:
            raise KeyboardInterrupt
        done.append(real(records, path))

    with monkeypatch.context() as m:
        m.setattr(E, "append", killed)
        with pytest.raises(KeyboardInterrupt):
            E.run_all(rows, index, parts, OverlapJudge(), stopped, batches=E.Batches(4))
    recorded = {r.row_id for r in jsonl.load_completed(spark, stopped.path("query_processing"), QUERY_RECORD).collect()}
    assert 0 < len(recorded) < 10
    asked = []
    real_queries = E.evaluate_queries
    monkeypatch.setattr(E, "evaluate_queries", lambda some, *more: asked.extend(r.row_id for r in some.collect()) or real_queries(some, *more))
    resumed = E.run_all(rows, index, parts, OverlapJudge(), stopped, batches=E.Batches(4, resume=True))
    assert sorted(asked) == sorted({f"r{i}" for i in range(10)} - recorded)
    for phase, schema in (("query_processing", QUERY_RECORD), ("retriever", RANK_RECORD), ("generation", GENERATION_RECORD)):
        lines = [spark.read.option("recursiveFileLookup", "true").text(a.path(phase)).count() for a in (whole, stopped)]
        assert lines[0] == lines[1]  # each question once
        timed = ("duration_ms", "durations_ms", "timestamp_utc")
        a, b = ([{k: v for k, v in r.asDict(True).items() if k not in timed and "ms" not in k} for r in jsonl.load_completed(spark, x.path(phase), schema).orderBy("row_id").collect()] for x in (whole, stopped))
        assert a == b
    untimed = lambda text: [x for x in text.split("\n") if "|" not in x]
    assert untimed(resumed) == untimed(report)


def test_answers_by_stored_blocks(spark, index, tmp_path):  # noqa: F811
    spec = IndexSpec("", blocks=f"file://{tmp_path}/blocks")
    build_blocks(index, spec)
    asked = spark.createDataFrame([("1", "plazos de recurso", "A1", ["I"]), ("2", "jornada", "C1", []), ("3", "tasas", "A1", ["V"]), ("4", "plazos", "C2", [])], "query_id string, condensed_query string, exam string, temas array<string>")
    plain = retrieve(asked, index, HashingEmbedder(), 5)
    stored = retrieve(asked, index, HashingEmbedder(), 5, index=spec)
    assert sorted(map(str, stored.collect())) == sorted(map(str, plain.collect())) and plain.count() >= 3
