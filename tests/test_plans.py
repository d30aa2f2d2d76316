from __future__ import annotations

import pytest
from larkspur.config import IndexSpec
from larkspur.functions import accounts
from larkspur.plans.answer import Components, answer, next_history, process_queries, prompt, stream_fragments
from larkspur.plans.cli import main
from larkspur.plans.evaluate import Artifacts, evaluate_generation, evaluate_queries, evaluate_retrieval, judge_rows, run_all
from larkspur.plans.ingest import build_index, ingest, with_metadata
from larkspur.plans.models import ExtractiveGenerator, GenerationConfig, HashingEmbedder, KeywordQueryModel, Lazy, OverlapJudge
from larkspur.plans.report import condensation_table
from larkspur.sources.index_store import read_index
from larkspur.streaming.sessions import artifact_sink, session_turns, windowed_counts
from pyspark.sql import functions as F

DOCS = [("ley1", "Artículo 1. Los plazos de recurso son de un mes.\nArtículo 2. Las tasas se pagan por adelantado."), ("ley2", "Artículo 1. La jornada es de siete horas.\nDisposición final única. Entrada en vigor mañana."), ("sin", "Artículo 1. x")]
META = [("ley1", "Ley uno", "2001", "http://a", "A1|A2", "I"), ("ley2", "Ley dos", "", "", "C1", "II|III"), ("otra", "n", "", "", "", "")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    meta = spark.createDataFrame(META, "doc_id string, doc_name string, doc_date string, source_url string, exams_id string, tema string")
    done = ingest(docs, meta)
    assert [r.doc_id for r in done.skipped.collect()] == ["sin"]
    assert {r.doc_id: r.final_n_chunks for r in done.review.collect()} == {"ley1": 2, "ley2": 2}
    assert {tuple(r.tema) for r in done.chunks.where("doc_id = 'ley2'").collect()} == {("II", "III")}
    spec = IndexSpec(f"file://{tmp_path_factory.mktemp('i')}/index")
    build_index(done.chunks, HashingEmbedder(), spec)
    return read_index(spark, spec)


def ask(spark, rows):
    return spark.createDataFrame(rows, "query_id string, query string, history string, exam string, temas array<string>")


class Fails:
    def predict_batch(self, turns):
        raise RuntimeError("no reply")

    def generate_batch(self, prompts, settings):
        def parts():
            yield "a medias"
            yield ""
            raise RuntimeError("corte")

        return [parts() for _ in prompts]


def test_metadata(spark):
    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    with pytest.raises(ValueError, match="doc_name"):
        with_metadata(docs, docs)


def test_answers(spark, index):
    model = KeywordQueryModel(("plazos", "jornada", "tasas"))
    queries = ask(spark, [("1", "¿Qué plazos de recurso hay?", None, "A1", ["I"]), ("2", "receta de paella", None, "A1", []), ("3", "plazos", None, "C2", []), ("4", "plazos de recurso", None, "A1", ["V"])])
    rows = {r.query_id: r for r in answer(queries, index, Components(query_model=model)).collect()}
    assert {k: r.status for k, r in rows.items()} == {"1": "OK", "2": "OFF_TOPIC", "3": "NO_CONTEXT", "4": "NO_CONTEXT"}
    assert rows["1"].durations_ms["total"] >= rows["1"].durations_ms["retrieve"] > 0 and len({r.session_id for r in rows.values()}) == 1
    assert "plazos de recurso" in rows["1"].answer and rows["1"].sources[0].doc_id == "ley1" and rows["2"].message


def test_failures(spark, index):
    queries = ask(spark, [("1", "plazos", "h", "A1", [])])
    row = process_queries(queries, Fails()).first()
    assert (row.relevance, row.condensed_query) == ("UNKNOWN", "plazos")
    row = answer(queries, index, Components(generator=Fails())).first()
    assert (row.status, row.answer) == ("GENERATION_ERROR", "a medias")
    class NoVectors(HashingEmbedder):
        def embed(self, texts):
            raise RuntimeError("sin modelo")

    row = answer(queries, index, Components(embedder=NoVectors())).first()
    assert row.status == "RETRIEVAL_ERROR" and row.error and row.message
    turns = spark.createDataFrame([("q", "a"), ("q", "")], "q string, a string").select(F.size(next_history(F.array().cast("array<struct<role: string, content: string>>"), F.col("q"), F.col("a"))))
    assert [r[0] for r in turns.collect()] == [2, 0]


def test_evaluation(spark, index):
    rows = spark.createDataFrame([("1", "A1", "standard", "plazos de recurso", "un mes", "Artículo 1.", "ley1"), ("2", "C1", "with_ref", "jornada de horas", "siete horas", "Artículo 1.", "ley2"), ("3", "OT", "off_topic", "paella", "", "", "")],
                                 "row_id string, exam string, question_type string, question string, ground_truth_answer string, ground_truth_ref string, ground_truth_doc_id string")
    parts = Components(query_model=KeywordQueryModel(("plazos", "jornada")))
    processed = evaluate_queries(rows, parts)
    assert {r.row_id: (r.actual_off_topic, r.verdict, r.edited) for r in processed.collect()}["3"] == (True, "OFF_TOPIC", False)
    ranks = evaluate_retrieval(rows, processed, index, parts).collect()
    assert len(ranks) == 14 and all(r["rank"] == 1 for r in ranks)
    done = {r.row_id: r for r in evaluate_generation(rows, processed, index, parts, OverlapJudge()).collect()}
    assert set(done) == {"1", "2"} and done["1"].correctness == 3 and done["1"].zeroed_reason is None
    with pytest.raises(ValueError, match="without ground truth"):
        evaluate_retrieval(rows.withColumn("ground_truth_ref", F.lit("zz")), processed, index, parts)


def test_judge_errors(spark):
    class Breaks:
        name = "j"

        def score(self, instruction, payload):
            raise RuntimeError("429")

    rows = spark.createDataFrame([("OK", "a", "b", "c", None), ("NO_CONTEXT", "a", "", "", None), ("HARNESS_ERROR", "a", "", "", "x")], "status string, ground_truth_answer string, answer string, context string, harness_error string")
    assert [r.zeroed_reason for r in judge_rows(rows, Breaks()).collect()] == ["judge_error=RuntimeError: 429", "status=NO_CONTEXT", "harness_error=x"]
    assert [r.judge_model for r in judge_rows(rows, OverlapJudge()).collect()] == ["word-overlap", "word-overlap", ""]


def test_scores_are_independent(spark):
    rows = spark.createDataFrame([("OK", "uno dos", "uno tres", "uno tres cuatro")], "status string, ground_truth_answer string, answer string, context string")
    row = judge_rows(rows, OverlapJudge()).first()
    assert (row.correctness, row.faithfulness) == (2, 3)


def test_evaluation_program(spark, index, tmp_path):
    rows = spark.createDataFrame([("1", "A1", "standard", "plazos de recurso", "un mes", "Artículo 1.", "ley1"), ("2", "C1", "with_ref", "jornada de horas", "siete horas", "Artículo 1.", "ley2"), ("3", "OT", "off_topic", "paella", "", "", "")],
                                 "row_id string, exam string, question_type string, question string, ground_truth_answer string, ground_truth_ref string, ground_truth_doc_id string")
    parts, out = Components(query_model=Lazy(lambda: KeywordQueryModel(("plazos", "jornada")))), Artifacts(f"file://{tmp_path}/run")
    with pytest.raises(ValueError, match="without a result"):
        run_all(rows, index, parts, OverlapJudge(), out, ("retrieval",))
    report = run_all(rows, index, parts, OverlapJudge(), out)
    assert "| all | 1 | 1.000000 | 2 |" in report and "query processing" in report and "| generate |" in report and "word" not in report
    records = spark.read.json(out.path("generation")).collect()
    assert {r.row_id: (r.session_id, r.judge_model, r.status) for r in records} == {i: (f"eval-{i}", "word-overlap", "OK") for i in "12"}
    assert run_all(rows, index, parts, OverlapJudge(), out, ("report",)) == report  # from the artifacts alone
    ranks = spark.read.json(out.path("retriever")).first()
    assert ranks.ranks["20"] == 1 and ranks.retrieve_ms > 0
    broken = Components(query_model=parts.query_model, embedder=None, generator=None)
    assert run_all(rows, index.drop("content"), broken, OverlapJudge(), out, ("generation",)) is None
    assert {r.zeroed_reason.split("=")[0] for r in spark.read.json(out.path("generation")).collect()} <= {"harness_error", "status"}


def test_trace(spark, index):
    """What was found, with scores and marks, and the last six turns for the generator."""
    turns = [("user" if i % 2 == 0 else "assistant", f"turno{i}") for i in range(10)]

    class Shows(ExtractiveGenerator):
        def generate_batch(self, prompts, settings):
            return [[f"{settings.temperature}|", p] for p in prompts]

    class Last(KeywordQueryModel):
        def predict_batch(self, turns):
            assert all("turno0" in t for t in turns)  # the query model sees the whole history
            return [("SI", t.split("Consulta actual: ")[-1]) for t in turns]

    queries = spark.createDataFrame([("1", "plazos de recurso", turns, "A1", [])], "query_id string, query string, history array<struct<role: string, content: string>>, exam string, temas array<string>")
    traces = answer(queries, index, Components(query_model=Last(), generator=Shows()))
    row = traces.first()
    assert row.answer.startswith("0.2|") and "turno4" in row.answer and "turno3" not in row.answer and "Usuario: turno8" in row.answer
    assert [c["rank"] for c in row.retrieved] == [1, 2] and all(c.kept and c.retrieval_score > 0 for c in row.retrieved)
    assert [c.point_id for c in row.final_chunks] == [s.point_id for s in row.sources]
    assert traces.is_cached and row.relevance == "RELEVANT"
    traces.unpersist()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    for _ in range(2):
        answer(queries, index, Components()).unpersist()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before


def test_fragments(spark):
    rows = spark.createDataFrame([("1", "Contexto:\nuno dos tres"), ("2", "Contexto:\n")], "query_id string, prompt string")
    found = stream_fragments(rows, ExtractiveGenerator(), GenerationConfig(max_tokens=2)).orderBy("query_id", "seq").collect()
    assert [(r.query_id, r.seq, r.fragment) for r in found] == [("1", 0, "uno "), ("1", 1, "dos ")]
    found = stream_fragments(rows.limit(1), Fails()).collect()
    assert [(r.seq, r.fragment, r.error) for r in found] == [(0, "a medias", None), (1, "", "RuntimeError: corte")]
    text = rows.select(prompt(F.lit("c"), F.lit("q"), F.lit("")).alias("p")).first().p
    assert text.endswith("Contexto:\nc\n\nPregunta: q")


def test_condensation(spark):
    rows = spark.createDataFrame([("b", "q", "q", "RELEVANT"), ("a", "q", "x", "UNKNOWN")], "row_id string, question string, condensed_query string, verdict string")
    assert list(condensation_table(rows))[2:] == ["| a | q | x | yes | UNKNOWN |", "| b | q | q | no | RELEVANT |"]


def test_config():
    assert GenerationConfig(None, 5).filled() == GenerationConfig(0.2, 5)


def test_streams(spark, tmp_path):
    schema = "session_id string, seq long, exam string, query string, answer string"
    rows = [("s", 1, "A1", "q", "a"), ("s", 2, "A1", "q", ""), ("s", 3, "A1", "q", "a"), ("s", 4, "C1", "q", "a"), ("t", 1, "A1", "q", "a")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
    q = session_turns(stream).writeStream.format("memory").queryName("turns").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.session_id, r.seq, r.history_len) for r in spark.table("turns").collect()) == [("s", 1, 0), ("s", 2, 2), ("s", 3, 2), ("s", 4, 0), ("t", 1, 0)]
    q = artifact_sink(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.json(f"file://{tmp_path}/out").count() == 5
    events = spark.createDataFrame([("2020-01-01 00:10:00", "v", 1.0), ("2020-01-01 00:20:00", "v", 2.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert [(r.n, r.value) for r in windowed_counts(events).collect()] == [(2, 3.0)]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/ley1.txt").write_text(DOCS[0][1], encoding="utf-8")
    (tmp_path / "meta.csv").write_text("doc_id,doc_name,doc_date,source_url,exams_id,tema\nley1,Ley uno,,,A1,I\n", encoding="utf-8")
    index = ["--index", f"file://{tmp_path}/index"]
    assert main([*index, "ingest", f"file://{tmp_path}/docs", f"file://{tmp_path}/meta.csv", "--review", f"file://{tmp_path}/review"]) == 0
    assert spark.read.json(f"file://{tmp_path}/review").first().final_n_chunks == 2
    assert main([*index, "ask", "plazos de recurso", "--tema", "I"]) == 0
    out = capsys.readouterr().out
    assert "[1] Ley uno Artículo 1." in out and "kept" in out
    assert main([*index, "ask", "plazos de recurso", "--tema", "IV", "--tema", "I"]) == 0
    assert main([*index, "ask", "plazos de recurso", "--tema", "IV", "--tema", "V"]) == 1
    assert main([*index, "ask", "plazos de recurso", "--exam", "C2"]) == 1


def test_accounts():
    line = "|".join([accounts.record("ana", "clave", b"\x01" * 16), "", accounts.record("leo", "otra")])
    known = accounts.parse(line)
    assert accounts.admits(known, "ana", "clave") and not accounts.admits(known, "ana", "otra") and not accounts.admits(known, "eva", "clave")


def test_environment():
    assert IndexSpec.from_environment({"LARKSPUR_INDEX": "x", "LARKSPUR_BUCKETS": "3"}) == IndexSpec("x", buckets=3)
    assert IndexSpec.from_environment({}).path == "index"
