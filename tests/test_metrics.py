from __future__ import annotations

import pytest
from larkspur.config import EvalSpec
from larkspur.operators import metrics as M
from larkspur.plans.report import build_report, condensation_table

# published figures: the histograms and hit counts from which the tables must come out again
HITS = {"standard": (26, [15, 22, 24, 24, 25, 25, 25]), "with_options": (26, [14, 23, 24, 24, 24, 25, 25]), "with_ref": (24, [17, 20, 20, 21, 21, 21, 22])}
GRID = (1, 2, 3, 4, 5, 10, 20)
CORRECT = {"standard": (1, 1, 1, 23), "with_options": (5, 0, 0, 21), "with_ref": (4, 1, 1, 18)}
FAITHFUL = {"standard": (1, 0, 0, 25), "with_options": (2, 0, 0, 24), "with_ref": (1, 0, 0, 23)}


@pytest.fixture(scope="module")
def ranks(spark):
    rows = [(f"{t}{i}", t, k, 1 if i < hits[j] else None) for t, (n, hits) in HITS.items() for j, k in enumerate(GRID) for i in range(n)]
    return spark.createDataFrame(rows, "row_id string, question_type string, k int, rank int")


@pytest.fixture(scope="module")
def records(spark):
    rows = []
    for t in CORRECT:
        c = [s for s, n in enumerate(CORRECT[t]) for _ in range(n)]
        f = [s for s, n in enumerate(FAITHFUL[t]) for _ in range(n)]
        rows += [(f"{t}{i}", t, a, b, "judge_error=429" if i == 0 else None, "OK", {"retrieve": 880.0, "generate": 2120.0} if i else {"retrieve": 880.0}) for i, (a, b) in enumerate(zip(c, f, strict=True))]
    return spark.createDataFrame(rows, "row_id string, question_type string, correctness int, faithfulness int, zeroed_reason string, status string, durations_ms map<string,double>")


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = [(True, "OFF_TOPIC")] * 4 + [(True, "RELEVANT")] * 6 + [(False, "RELEVANT")] * 76
    return spark.createDataFrame(rows, "actual_off_topic boolean, verdict string")


def test_hit_rates(ranks):
    got = {(r.question_type, r.k): r.hit_rate for r in M.hit_rate_sets(ranks).collect()}
    assert [round(got["all", k], 6) for k in GRID] == [0.605263, 0.855263, 0.894737, 0.907895, 0.921053, 0.934211, 0.947368]
    assert [round(got["with_ref", k], 6) for k in GRID] == [0.708333, 0.833333, 0.833333, 0.875, 0.875, 0.875, 0.916667]
    assert {r.k: round(r.hit_rate, 6) for r in M.hit_rates(ranks).collect()}[5] == 0.921053


def test_scores(records):
    s = M.score_summary(records).first()
    assert (s.n, s.n_zeroed, round(s.correctness, 2), round(s.correctness_share, 3), round(s.faithfulness, 2), round(s.faithfulness_share, 3)) == (76, 3, 2.53, 0.842, 2.84, 0.947)
    rows = {r.label: r for r in M.score_breakdown(records, "correctness").collect()}
    assert [rows["total"][f"score_{i}"] for i in range(4)] == [10, 2, 2, 62]
    assert [round(rows[f"question_type={t}"]["mean"], 2) for t in CORRECT] == [2.77, 2.42, 2.38]


def test_confusion(verdicts, spark):
    r = M.confusion(verdicts).first()
    assert (r.tp, r.fn, r.fp, r.tn) == (4, 6, 0, 76)
    assert (r.precision, round(r.accuracy, 3), round(r.recall, 3), round(r.f1, 3)) == (1.0, 0.930, 0.4, 0.571)
    r = M.confusion(spark.createDataFrame([(True, "UNKNOWN")], "actual_off_topic boolean, verdict string")).first()
    assert (r.fn, r.n_unknown, r.precision, r.f1) == (1, 1, 0.0, 0.0)


def test_latencies(records):
    rows = M.stage_latencies(records).orderBy("stage_order").collect()
    assert [(r.stage, r.n, round(r.avg_s, 2)) for r in rows] == [("retrieve", 76, 0.88), ("generate", 73, 2.12)]


def test_empty(spark, records):
    none = records.where("false")
    s = M.score_summary(none).first()
    assert (s.n, s.correctness, s.faithfulness_share) == (0, 0.0, 0.0)
    assert M.stage_latencies(none).count() == 0


def test_ground_truth(spark):
    chunks = spark.createDataFrame([("d", "Artículo  1.", "articulo"), ("d", None, "preambulo"), ("e", "Art. 2", "articulo")], "doc_id string, seccion string, tipo_seccion string")
    rows = [("1", "x", "d", " Artículo 1. "), ("2", "x", "d", "preambulo"), ("3", "x", "d", "Art. 2"), ("4", "x", "", "a"), ("5", "off_topic", "", "")]
    asked = spark.createDataFrame(rows, "row_id string, question_type string, ground_truth_doc_id string, ground_truth_ref string")
    assert {r.row_id: r.reason for r in M.ground_truth_failures(asked, chunks).collect()} == {"3": "not indexed", "4": "empty"}


def test_require_all(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "row_id string")
    with pytest.raises(ValueError, match="1 rows"):
        M.require_all(rows, rows.where("row_id = 'a'"))
    assert M.require_all(rows, rows).count() == 2


def test_ranks(spark):
    rows = spark.createDataFrame([("a", 3, "d", "r"), ("b", 3, "d", "z")], "row_id string, k int, doc_id string, ref string")
    found = spark.createDataFrame([("a", 3, 2, "d", "r"), ("a", 3, 3, "d", "r"), ("b", 3, 1, "e", "z")], "row_id string, k int, rank int, doc_id string, ref string")
    assert {r.row_id: r["rank"] for r in M.ground_truth_ranks(rows, found).collect()} == {"a": 2, "b": None}


def test_report(spark, ranks, records, verdicts):
    dataset = spark.createDataFrame([("A2", "standard"), ("C1", "with_ref"), ("C1", "standard")], "exam string, question_type string")
    processed = verdicts.selectExpr("*", "750.0D AS duration_ms")
    text = build_report(dataset, processed, ranks, records, EvalSpec())
    for part in ("| C1 | 1 | 1 |", "| all | 5 | 0.921053 | 76 |", "0.842", "| judge_error=429 | 3 |", "| 4 | 0 | 6 | 76 | 0 | 1.000 | 0.400 | 0.571 | 0.930 |", "| query processing | 86 | 0.75 | 0.75 |"):
        assert part in text
    assert build_report(dataset.where("false")) == ""
    one = spark.createDataFrame([("1", "a", "b", "RELEVANT")], "row_id string, question string, condensed_query string, verdict string")
    assert "| 1 | a | b | yes | RELEVANT |" in condensation_table(one)


def test_display_round():
    assert M.display_round(2.675) == 2.67
