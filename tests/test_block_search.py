"""Stored indexes: the same lists as the plain searches, with fewer blocks read."""

from __future__ import annotations

import random
import shutil

import numpy as np
import pytest
from larkspur.config import Bm25Spec
from larkspur.operators import block_search as B
from larkspur.operators import retrieve as R
from pyspark.sql import functions as F

WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]


def texts(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.choice([3, 30, 200, 900]))), rng.choice([["A1"], ["A1", "A2"], ["C1", None], None]), rng.choice([["I"], ["II", None], [], None])) for i in range(n)]
    rows += [(n, None, ["A1"], ["I"]), (n + 1, "", ["A1"], ["I"]), (n + 2, rows[3][1], ["A2"], []), (n + 3, rows[3][1], ["A1"], ["I"])]
    return spark.createDataFrame(rows, "point_id long, content string, exams_id array<string>, tema array<string>")


def asked(spark, seed=2):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 12))), rng.choice(["A1", "A2", "C1", "X"]), rng.choice([[], ["I"], ["I", "II"], [None, "II"]])) for i in range(30)]
    return spark.createDataFrame([*rows, (98, "", "A1", []), (99, None, "A1", [])], "query_id long, text string, exam string, temas array<string>")


def same(a, b):
    columns = ["query_id", "point_id", "score", "rank"]
    return sorted(map(tuple, a.select(*columns).collect())) == sorted(map(tuple, b.select(*columns).collect()))


@pytest.mark.parametrize(("idf", "block"), [(False, 16), (True, 16), (False, 1024)])
def test_sparse_lists_are_those_of_the_plain_search(spark, tmp_path, idf, block):
    spec, points, queries = Bm25Spec(idf=idf), texts(spark), asked(spark)
    path = f"file://{tmp_path}/index"
    B.build_sparse(points, path, spec, block_points=block)
    plain = R.top(R.sparse_scores(queries, R.inverted_index(points, spec), spec), 5)
    assert same(B.SparseSearch(queries.select("query_id", "text"), path, 5, spec).result(), plain)


def test_sparse_filters_come_first(spark, tmp_path):
    points, queries = texts(spark), asked(spark)
    path = f"file://{tmp_path}/index"
    B.build_sparse(points, path, block_points=16)
    scores = R.sparse_scores(queries, R.inverted_index(points))
    kept = scores.join(queries.select("query_id", "exam", "temas"), "query_id").join(points.drop("content"), "point_id").where(R.matches(F.col("exams_id"), F.col("tema"), F.col("exam"), F.col("temas")))
    expected = R.top(kept.select("query_id", "point_id", "score"), 5)
    assert expected.count() > 20 and same(B.SparseSearch(queries, path, 5).result(), expected)


def test_blocks_that_cannot_reach_the_list_are_left_out(spark, tmp_path):
    """Points that hold a query's words often lie in blocks of their own length; the others are never scored."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(WORDS, k=400))) for i in range(600)] + [(1000 + i, "meta " * 5 + "fina " * (1 + i % 3)) for i in range(40)]
    rows += [(2000 + i, "meta fina " + " ".join(rng.choices(WORDS, k=900))) for i in range(300)]
    points = spark.createDataFrame(rows, "point_id long, content string")
    path = f"file://{tmp_path}/index"
    B.build_sparse(points, path, block_points=32)
    search = B.SparseSearch(spark.createDataFrame([(1, "meta fina")], "query_id long, text string"), path, 5)
    holding, read = search.pairs.count(), search.first.count() + search.rest.count()
    assert holding >= 8 and read <= holding / 3
    assert same(search.result(), R.top(R.sparse_scores(search_queries(spark), R.inverted_index(points)), 5))


def search_queries(spark):
    return spark.createDataFrame([(1, "meta fina")], "query_id long, text string")


def test_a_term_of_every_point_is_a_row_for_each_block(spark, tmp_path):
    points = spark.createDataFrame([(i, "todos " + WORDS[i % 200]) for i in range(500)], "point_id long, content string")
    B.build_sparse(points, f"file://{tmp_path}/index", block_points=50)
    found = spark.read.parquet(f"file://{tmp_path}/index/postings").where("term = 'todos'").select("n").collect()
    assert sum(r.n for r in found) == 500 and len(found) == 10 and max(r.n for r in found) < 100


def vectors(spark, n=500, groups=12, seed=4, size=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size))
    x = centres[rng.integers(0, groups, n)] + 0.25 * rng.normal(size=(n, size))
    exams = [["A1"], ["A2"], ["A1", "A2"], None]
    temas = [["I"], ["II"], [], None]
    rows = [(i, [float(v) for v in row], exams[i % 4], temas[i % 3]) for i, row in enumerate(x)]
    rows += [(n, None, ["A1"], ["I"]), (n + 1, [0.0] * size, ["A1"], ["I"]), (n + 2, [1.0], ["A1"], ["I"]), (n + 3, [None] + [1.0] * (size - 1), ["A1"], ["I"]), (n + 4, rows[5][1], ["A1"], ["I"])]
    return spark.createDataFrame(rows, "point_id long, dense array<double>, exams_id array<string>, tema array<string>")


def test_dense_lists_are_exact_with_fewer_cells(spark, tmp_path):
    points = vectors(spark)
    path = f"file://{tmp_path}/index"
    B.build_dense(points, path, block_points=32)
    queries = points.where("point_id % 10 = 0").select(F.col("point_id").alias("query_id"), "dense")
    queries = spark.createDataFrame(queries.collect(), queries.schema)
    search = B.DenseSearch(queries, path, 5, exclude_self=True)
    assert same(search.result(), R.dense_topk(queries, points.select("point_id", "dense"), 5, exclude_self=True))
    assert search.first.count() + search.rest.count() < 0.7 * search.pairs.count()


def test_dense_filters(spark, tmp_path):
    points = vectors(spark)
    path = f"file://{tmp_path}/index"
    B.build_dense(points, path, block_points=32)
    rows = [(r.point_id, r.dense, ["A1", "A2", "X"][r.point_id % 3], [[], ["I"], ["I", "II"], [None]][r.point_id % 4]) for r in points.where("point_id % 20 = 0 AND point_id < 500").collect()]
    queries = spark.createDataFrame(rows, "query_id long, dense array<double>, exam string, temas array<string>")
    expected = R.dense_topk(queries, points, 5)
    assert expected.count() > 40 and same(B.DenseSearch(queries, path, 5).result(), expected)


def test_probes_reach_the_asked_recall(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    B.build_dense(vectors(spark, n=900, groups=40), path)
    probes, recall = B.measured_probes(spark, path, 5, 0.9, sample=60)
    assert recall >= 0.9 and probes <= spark.read.parquet(f"{path}/cells").count() / 2


def test_recall_on_the_given_vectors(spark, tmp_path):
    points = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("dense"))
    path = f"file://{tmp_path}/index"
    B.build_dense(points, path)
    probes, recall = B.measured_probes(spark, path, 5, 0.9, sample=40)
    assert recall >= 0.9 and probes >= 1


def test_empty_indexes(spark, tmp_path):
    B.build_sparse(texts(spark).where("false"), f"file://{tmp_path}/s")
    B.build_dense(vectors(spark).where("false"), f"file://{tmp_path}/d")
    assert B.SparseSearch(asked(spark), f"file://{tmp_path}/s", 5).result().count() == 0
    queries = vectors(spark, 10).select(F.col("point_id").alias("query_id"), "dense")
    assert B.DenseSearch(queries, f"file://{tmp_path}/d", 5).result().count() == 0


def test_sparse_scores_stay_in_their_tile(spark, tmp_path, monkeypatch):
    """Scores of all pairs of query and point are in no shuffle, and tiles of queries find what all find."""
    points = texts(spark)
    B.build_sparse(points, f"file://{tmp_path}/index", block_points=16)
    queries = asked(spark)
    plain = R.top(R.sparse_scores(queries, R.inverted_index(points)), 5)
    monkeypatch.setattr(B, "QUERY_TILE", 1)
    search = B.SparseSearch(queries.select("query_id", "text"), f"file://{tmp_path}/index", 5)
    plan = search.result()._jdf.queryExecution().toString()
    assert search.tiles == queries.count() > 1 and "FlatMapCoGroupsInArrow" in plan
    assert same(search.result(), plain)


def test_texts_are_cut_once_and_long_ones_lie_in_small_blocks(spark, tmp_path, monkeypatch):
    """Cutting a text into terms is the dearest step of the build; a block is bounded by its characters, too."""
    points, queries, calls, cut = texts(spark), asked(spark), [], B.terms
    monkeypatch.setattr(B, "BLOCK_CHARS", 20_000)
    monkeypatch.setattr(B, "terms", lambda *a: calls.append(a) or cut(*a))
    B.build_sparse(points, f"file://{tmp_path}/index")
    sizes = spark.read.parquet(f"file://{tmp_path}/index/places").join(points, "point_id").groupBy("block").agg(F.sum(F.length("content")).alias("chars")).where("chars > 40000")
    assert len(calls) == 1 and sizes.count() == 0
    plain = R.top(R.sparse_scores(queries, R.inverted_index(points)), 5)
    assert same(B.SparseSearch(queries.select("query_id", "text"), f"file://{tmp_path}/index", 5).result(), plain)


@pytest.mark.parametrize("sent", [200_000, 0])
def test_a_search_reads_the_index_once(spark, tmp_path, monkeypatch, sent):
    """Lists, bounds and the first scores are worked out once, so postings and bitmaps may go before the result is read."""
    points, queries = texts(spark), asked(spark)
    monkeypatch.setattr(B, "SENT_TERMS", sent)
    B.build_sparse(points, f"file://{tmp_path}/index", block_points=16)
    expected = B.SparseSearch(queries, f"file://{tmp_path}/index", 5).result().collect()
    search = B.SparseSearch(queries, f"file://{tmp_path}/index", 5)
    for name in ("postings", "bitmaps"):
        shutil.rmtree(tmp_path / "index" / name)
    assert len(expected) > 20 and sorted(search.result().collect()) == sorted(expected)
