from __future__ import annotations

import numpy as np
from larkspur.config import Bm25Spec, ContextSpec, FusionSpec, RetrievalSpec
from larkspur.functions.vectors import cosine
from larkspur.operators import retrieve as R
from larkspur.operators.context import mark_kept, render, render_sources, within_budget
from larkspur.operators.history import session_segments, tail, tail_array, to_contents, transcript, user_turn
from pyspark.sql import functions as F


def vectors(n=30, dim=8, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


def dense_scores(queries, points):
    """Cosines of every pair, in expressions."""
    pairs = queries.select("query_id", F.col("dense").alias("q")).crossJoin(points.select("point_id", F.col("dense").alias("d")))
    return pairs.select("query_id", "point_id", F.round(cosine(F.col("q"), F.col("d")), 6).alias("score"))


def test_dense_against_expressions(spark):
    points = spark.createDataFrame([*vectors(), (30, None), (31, [0.0] * 8), (32, [1.0, 2.0])], "point_id int, dense array<double>")
    asked = spark.createDataFrame(vectors(5, seed=2), "query_id int, dense array<double>")
    usable = points.where("size(dense) = 8 AND point_id <> 31")
    expected = R.top(dense_scores(asked, usable), 4).select("query_id", "point_id", "score", "rank").collect()
    assert sorted(R.dense_topk(asked, points, 4).select("query_id", "point_id", "score", "rank").collect()) == sorted(expected)


def test_dense_blocks(spark, monkeypatch):
    points = spark.createDataFrame(vectors(), "point_id int, dense array<double>")
    asked = spark.createDataFrame(vectors(9, seed=3), "query_id int, dense array<double>")
    whole = sorted(R.dense_topk(asked, points, 3).collect())
    monkeypatch.setattr(R, "QUERY_TILE", 2)
    monkeypatch.setattr(R, "POINT_TILE", 4)
    assert sorted(R.dense_topk(asked, points, 3).collect()) == whole


def test_filters(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0], ["A1"], ["I", None]), (2, [1.0, 0.1], ["A1", "C1"], ["II"]), (3, [0.9, 0.1], ["C1"], None)], "point_id int, dense array<double>, exams_id array<string>, tema array<string>")
    asked = spark.createDataFrame([(1, [1.0, 0.0], "A1", ["II"]), (2, [1.0, 0.0], "A1", []), (3, [1.0, 0.0], "C1", ["I"])], "query_id int, dense array<double>, exam string, temas array<string>")
    asked = asked.withColumn("temas", R.effective_temas(F.col("exam"), F.col("temas")))
    got = {}
    for r in R.dense_topk(asked, points, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.point_id))
    assert {k: [p for _, p in sorted(v)] for k, v in got.items()} == {1: [2], 2: [1, 2], 3: [2, 3]}
    pairs = asked.crossJoin(points.drop("dense")).where(R.matches(F.col("exams_id"), F.col("tema"), F.col("exam"), F.col("temas")))
    assert {(r.query_id, r.point_id) for r in pairs.collect()} == {(q, p) for q, v in got.items() for _, p in v}


def test_settings(spark):
    df = spark.createDataFrame([("A1", "II"), ("A1", "TODOS"), ("C1", "II"), ("A1", None)], "exam string, tema string")
    assert [r[0] for r in df.select(R.settings_temas(F.col("exam"), F.col("tema"))).collect()] == [["II"], [], [], []]


def test_fusion_and_sweep(spark):
    ranked = lambda rows: spark.createDataFrame(rows, "query_id int, point_id int, score double")
    dense = ranked([(1, p, 10.0 - p) for p in range(8)])
    sparse = ranked([(1, p, float(p)) for p in range(8)])
    spec = RetrievalSpec(k_grid=(1, 3, 5), fusion=FusionSpec(60, 1))
    sweep = R.k_sweep(dense, sparse, spec).collect()
    for k in spec.k_grid:
        one = R.hybrid_topk(dense, sparse, k, spec).collect()
        assert sorted((r.point_id, r["rank"], r.score) for r in sweep if r.k == k) == sorted((r.point_id, r["rank"], r.score) for r in one)
    best = R.hybrid_topk(dense, sparse, 1, spec).first()
    assert (best.point_id, round(best.score, 6)) == (0, round(1 / 61, 6))


def test_sparse(spark):
    points = spark.createDataFrame([(1, "casa casa perro"), (2, "casa"), (3, ""), (4, None)], "point_id int, content string")
    index = R.inverted_index(points)
    weights = {(r.term, r.point_id): r.weight for r in index.collect()}
    assert abs(weights["casa", 1] - 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 256))) < 1e-12
    asked = spark.createDataFrame([(1, "Casa, casa!"), (2, "gato")], "query_id int, text string")
    assert [(r.query_id, r.point_id, r["rank"]) for r in R.top(R.sparse_scores(asked, index), 5).orderBy("rank").collect()] == [(1, 1, 1), (1, 2, 2)]


def test_sparse_of_wanted_terms_and_stored(spark):
    """Pruning by the queries' terms and stored vectors give the scores of the whole index."""
    texts = ["casa casa perro", "Casa gato; gato gato", "perro, el perro", "", None, "el la de"]
    points = spark.createDataFrame(list(enumerate(texts)), "point_id int, content string")
    asked = spark.createDataFrame([(1, "casa perro"), (2, "el gato"), (3, "nada"), (4, None)], "query_id int, text string")
    for spec in (Bm25Spec(), Bm25Spec(stop_words=("el", "la", "de")), Bm25Spec(k1=2.0, b=0.1, language="spanish")):
        whole = sorted(R.sparse_scores(asked, R.inverted_index(points, spec), spec).collect())
        wanted = R.query_terms(asked, spec)
        assert sorted(R.sparse_scores(asked, R.inverted_index(points, spec, wanted=wanted), spec).collect()) == whole
        stored = points.select("point_id", R.sparse_vector(F.col("content"), spec).alias("sparse"))
        assert sorted(R.sparse_scores(asked, R.postings(stored, wanted), spec).collect()) == whole
    assert {r.term for r in R.query_terms(asked, Bm25Spec(stop_words=("el",))).collect()} == {"casa", "perro", "gato", "nada"}


def test_stems(spark):
    df = spark.createDataFrame([(["casas", "casa", "leyes", "contratación", "contrataciones", "rápidamente", "sol", "los"],)], "w array<string>")
    got = df.select(R.stems(F.col("w"), "spanish")).first()[0]
    assert got == ["casa", "casa", "ley", "contrat", "contrat", "rapid", "sol", "los"]


def results(spark, lengths):
    meta = "struct<doc_id: string, doc_name: string, doc_date: string, source_url: string, seccion: string>"
    rows = [("q", i, f"p{i}", "x" * n, (f"d{i}", f"Ley {i}" if i else "", "2020" if i == 1 else None, "http://x" if i else "", "Art. 1" if i < 2 else None)) for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, f"query_id string, rank int, point_id string, content string, metadata {meta}")


def test_budget(spark):
    for lengths, kept in (([10, 1], 1), ([3, 3, 3], 3), ([3, 9, 1], 1), ([], 0)):
        assert within_budget(results(spark, lengths), ContextSpec(budget=3)).count() == kept


def test_render(spark):
    queries = spark.createDataFrame([("q",), ("none",)], "query_id string")
    found = results(spark, [1, 2, 3])
    kept = within_budget(found)
    rows = {r.query_id: r for r in render(kept, queries).withColumn("s", render_sources(F.col("sources"))).collect()}
    assert rows["q"].blocks == "[1] Art. 1\nx\n\n[2] Ley 1 — Art. 1 (fecha: 2020)\nxx\n\n[3] Ley 2\nxxx"
    assert rows["q"].s == "[1] Art. 1\n[2] [Ley 1 — Art. 1](http://x)\n[3] [Ley 2](http://x)"
    assert (rows["none"].blocks, rows["none"].sources, rows["none"].n_tokens_estimate) == ("", [], 0)
    assert mark_kept(found, kept.where("rank < 2")).where("kept").count() == 2


def test_history(spark):
    rows = [(c, t, ["system", "user", "assistant"][t % 3], f"m{t}") for c, n in ((1, 3), (2, 10)) for t in range(n)]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    assert {r.conv_id: r["count"] for r in tail(turns, 6).groupBy("conv_id").count().collect()} == {1: 3, 2: 6}
    assert tail(turns, 0).count() == 0
    texts = {r.conv_id: r.transcript for r in transcript(turns).collect()}
    assert texts[1] == "Asistente: m0\nUsuario: m1\nAsistente: m2"
    contents = {r.conv_id: r for r in to_contents(turns).collect()}
    assert contents[2].instruction == "m9" and [x.role for x in contents[1].contents] == ["user", "model"]
    arrays = spark.createDataFrame([([],), ([1, 2],), (list(range(9)),)], "a array<int>")
    assert [r[0] for r in arrays.select(tail_array(F.col("a"), 3)).collect()] == [[], [1, 2], [6, 7, 8]]
    assert [r[0] for r in arrays.select(tail_array(F.col("a"), 0)).collect()] == [[], [], []]
    asked = spark.createDataFrame([("q", None), ("q", "h")], "q string, h string").select(user_turn(F.col("q"), F.col("h"))).collect()
    assert asked[0][0] == "q" and "h" in asked[1][0] and asked[1][0].endswith("q")


def test_sessions(spark):
    rows = [("s", 1, "A1"), ("s", 2, "A1"), ("s", 3, "C1"), ("t", 1, "C1")]
    found = session_segments(spark.createDataFrame(rows, "s string, n int, exam string"), "s", ["n"], "exam")
    assert [(r.s, r.segment) for r in found.orderBy("s", "n").collect()] == [("s", 0), ("s", 0), ("s", 1), ("t", 0)]


def test_sparse_tiles_hold_the_best_of_all(spark, monkeypatch):
    """Whatever tiles meet, the k best are those of all scores; no task gets more points than a tile."""
    monkeypatch.setattr(R, "TEXT_TILE", 7)
    monkeypatch.setattr(R, "QUERY_TILE", 2)
    rows = [(i, " ".join(f"w{'abcdefghij'[(i * j) % 10]}" for j in range(1 + i % 6)), [["A1"], ["C1"], None][i % 3], [f"t{i % 2}", None]) for i in range(60)] + [(60, None, ["A1"], None), (61, "", ["A1"], ["t0"])]
    points = spark.createDataFrame(rows, "point_id long, content string, exams_id array<string>, tema array<string>")
    asked = spark.createDataFrame([(1, "wa wb wb wj", "A1", []), (2, "wc none", "A1", ["t0"]), (3, "wa wd", "C1", ["t1", None]), (4, None, "A1", []), (5, "wa", "B1", []), (6, "wa", "A1", [None])], "query_id long, text string, exam string, temas array<string>")
    for spec in (None, R.Bm25Spec(idf=True)):
        index = R.inverted_index(points, spec, wanted=R.query_terms(asked, spec))
        scores = R.sparse_scores(asked, index, spec)
        plain = {(r.query_id, r["rank"]): (r.point_id, r.score) for r in R.top(scores, 5).collect()}
        assert plain and {(r.query_id, r["rank"]): (r.point_id, r.score) for r in R.sparse_topk(asked.select("query_id", "text"), points, index, 5, spec).collect()} == plain
        open_ = scores.join(asked.select("query_id", "exam", "temas"), "query_id").join(points.drop("content"), "point_id").where(R.matches(F.col("exams_id"), F.col("tema"), F.col("exam"), F.col("temas")))
        within = {(r.query_id, r["rank"]): (r.point_id, r.score) for r in R.top(open_, 5).collect()}
        assert within and {(r.query_id, r["rank"]): (r.point_id, r.score) for r in R.sparse_topk(asked, points, index, 5, spec).collect()} == within
