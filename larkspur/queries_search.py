"""Registered queries on stored indexes, each with its SQL."""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import IndexSpec
from .operators import retrieve as R
from .operators.block_search import DenseSearch, SparseSearch, build_dense, build_sparse, hybrid_stored
from .plans.answer import MESSAGES, Components, answer
from .plans.ingest import embed_column
from .plans.models import KeywordQueryModel
from .queries import DENSE_CTE, ORACLE, SPARSE_CTE, SPEC, _exam, _points, _vector_queries, query, read
from .sources.index_store import read_index, to_points, vacuum, write_index
from .sources.scratch import scratch_dir, written


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("point_id"), F.col("text").alias("content"), F.array(_exam(F.col("lang"))).alias("exams_id"), F.array("source").alias("tema"))


@query(ORACLE["sparse_bm25_topk"])
def sparse_stored_topk(spark, sf_dir):
    """The sparse search over a stored index of blocks, which leaves out blocks that can't reach the fifth score."""
    path = f"{scratch_dir(spark, 'sparse')}/index"
    build_sparse(_texts(spark, sf_dir), path, SPEC.bm25)
    return SparseSearch(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), path, 5, SPEC.bm25).result()


@query(ORACLE["dense_topk"])
def dense_indexed_topk(spark, sf_dir):
    """The dense search over a stored index of cells, exact by the angle of each cell."""
    path = f"{scratch_dir(spark, 'dense')}/index"
    build_dense(_points(spark, sf_dir).select("point_id", "dense"), path)
    return DenseSearch(_vector_queries(spark, sf_dir).select("query_id", "dense"), path, 5, exclude_self=True).result()


@query(f"""
WITH meta AS (
  SELECT doc_id, CASE lang WHEN 'en' THEN 'A1' WHEN 'de' THEN 'A2' WHEN 'fr' THEN 'C1' ELSE 'C2' END AS exam, source FROM documents
), {SPARSE_CTE}, asked AS (
  SELECT b.item_id AS query_id, m.exam, m.source, v.embedding FROM benchmark b JOIN meta m ON m.doc_id = b.item_id JOIN embeddings v ON v.vec_id = b.item_id
), open AS (
  SELECT q.query_id, q.embedding, d.doc_id AS point_id FROM asked q JOIN meta d ON d.exam = q.exam AND (q.exam <> 'A1' OR list_has_any([d.source], [q.source, 'src0']))
), dense AS (
  SELECT o.query_id, o.point_id, row_number() OVER (PARTITION BY o.query_id ORDER BY round(list_cosine_similarity(CAST(o.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) DESC, o.point_id) AS rank FROM open o JOIN embeddings d ON d.vec_id = o.point_id
), sparse AS (
  SELECT s.query_id, s.point_id, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.point_id) AS rank FROM sparse_scores s JOIN open o ON o.query_id = s.query_id AND o.point_id = s.point_id
), fused AS (
  SELECT query_id, point_id, round(sum(CAST(1 AS DOUBLE) / (2 + rank - 1)), 9) AS score FROM (SELECT * FROM dense WHERE rank <= 5 UNION ALL SELECT * FROM sparse WHERE rank <= 5) GROUP BY query_id, point_id
)
SELECT query_id, point_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM fused) WHERE rank <= 5
""")
def filtered_hybrid(spark, sf_dir):
    """Hybrid search within an exam and, for A1, two temas: bitmaps combined before anything is scored, in both branches."""
    texts, folder = _texts(spark, sf_dir), scratch_dir(spark, "hybrid")
    vectors = _points(spark, sf_dir).select("point_id", "dense")
    build_sparse(texts, f"{folder}/sparse", SPEC.bm25)
    build_dense(written(vectors.join(texts.drop("content"), "point_id"), f"{folder}/points"), f"{folder}/dense")
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), _exam(F.col("lang")).alias("exam"), "source")
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(docs, "query_id").join(vectors.withColumnRenamed("point_id", "query_id"), "query_id")
    asked = written(asked.select("query_id", "text", "dense", "exam", R.effective_temas(F.col("exam"), F.array("source", F.lit("src0"))).alias("temas")), f"{folder}/asked")
    dense, sparse = hybrid_stored(asked, f"{folder}/sparse", f"{folder}/dense", 5, SPEC.bm25)
    return R.hybrid_topk(dense.drop("rank"), sparse.drop("rank"), 5, SPEC)


@query("""
WITH first AS (SELECT doc_id, md5(text) AS content FROM documents), second AS (
  SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'dos' ELSE content END AS content FROM first WHERE doc_id % 30 <> 0
), third AS (SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN 'tres' ELSE content END AS content FROM second)
SELECT 1 AS version, CAST(doc_id AS VARCHAR) AS doc_id, content FROM first UNION ALL SELECT 2, CAST(doc_id AS VARCHAR), content FROM second UNION ALL SELECT 3, CAST(doc_id AS VARCHAR), content FROM third
""")
def index_snapshots(spark, sf_dir):
    """Three versions of an index, each read as it was committed: whole, some documents replaced or dropped, others replaced."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("n"), F.col("doc_id").cast("string").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("content"), F.array("lang").alias("exams_id"))
    fixed = {c: F.lit("") for c in ("doc_name", "doc_date", "source_url", "tipo_seccion", "seccion")} | {"tema": F.array().cast("array<string>"), "section_seq": F.lit(0), "part_seq": F.lit(0)}
    points = lambda rows: to_points(rows.withColumns(fixed))
    spec = IndexSpec(f"{scratch_dir(spark, 'snapshots')}/index", buckets=8)
    write_index(points(docs), spec)
    write_index(points(docs.where("n % 30 <> 0").withColumn("content", F.lit("dos"))), spec, docs.where("n % 10 = 0").select("doc_id"))
    write_index(points(docs.where("n % 30 <> 0").withColumn("content", F.lit("tres"))), spec, docs.where("n % 7 = 1 AND n % 30 <> 0").select("doc_id"))
    vacuum(spark, spec, keep=3)
    found = [read_index(spark, spec, version=v).select(F.lit(v).alias("version"), "doc_id", "content") for v in (1, 2, 3)]
    return found[0].unionByName(found[1]).unionByName(found[2])


class LetterEmbedder:
    """Frequencies of the letters a to z at length one: a stand-in that SQL can follow."""

    dim = 26

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.array([[(t or "").lower().count(c) for c in string.ascii_lowercase] for t in texts], dtype=np.float64).reshape(len(texts), self.dim)
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)


_LETTERS = ", ".join(f"CAST(length(t) - length(replace(t, '{c}', '')) AS DOUBLE)" for c in string.ascii_lowercase)


@query(f"""
WITH meta AS (
  SELECT doc_id, text, lower(text) AS t, CASE lang WHEN 'en' THEN 'A1' WHEN 'de' THEN 'A2' WHEN 'fr' THEN 'C1' ELSE 'C2' END AS exam, source FROM documents
), vectors AS (SELECT *, [{_LETTERS}] AS v FROM meta), asked AS (
  SELECT item_id AS query_id, text, lower(text) AS t, ['A1', 'A2', 'C1', 'C2'][1 + item_id % 4] AS exam, contains(lower(text), 'the') OR contains(lower(text), 'der') AS relevant FROM benchmark
), asked_vectors AS (SELECT *, [{_LETTERS}] AS v FROM asked), {SPARSE_CTE}, open AS (
  SELECT q.query_id, q.v AS qv, d.doc_id AS point_id, d.v FROM asked_vectors q JOIN vectors d ON d.exam = q.exam AND (q.exam <> 'A1' OR list_has_any([d.source], ['src0', 'src1'])) WHERE q.relevant
), dense AS (
  SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(qv, v), 6) DESC, point_id) AS rank FROM open WHERE list_sum(v) > 0 AND list_sum(qv) > 0
), sparse AS (
  SELECT s.query_id, s.point_id, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.point_id) AS rank FROM sparse_scores s JOIN open o ON o.query_id = s.query_id AND o.point_id = s.point_id
), fused AS (
  SELECT query_id, point_id, round(sum(CAST(1 AS DOUBLE) / (2 + rank - 1)), 9) AS score FROM (SELECT * FROM dense WHERE rank <= 5 UNION ALL SELECT * FROM sparse WHERE rank <= 5) GROUP BY query_id, point_id
), found AS (
  SELECT query_id, point_id, rank, sum(n) OVER (PARTITION BY query_id ORDER BY rank) AS upto, '[' || rank || '] Doc ' || point_id || ' — Art. ' || (point_id % 7) || chr(10) || text AS block
  FROM (SELECT f.*, d.text, CAST(ceil(length(d.text) / 3) AS BIGINT) AS n, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM fused f JOIN meta d ON d.doc_id = f.point_id) WHERE rank <= 5
), contexts AS (
  SELECT query_id, string_agg(CAST(point_id AS VARCHAR), ',' ORDER BY rank) AS found_ids, string_agg(CAST(point_id AS VARCHAR), ',' ORDER BY rank) FILTER (rank = 1 OR upto <= 3000) AS final_ids,
         string_agg(block, chr(10) || chr(10) ORDER BY rank) FILTER (rank = 1 OR upto <= 3000) AS blocks, min(block) FILTER (rank = 1) AS first FROM found GROUP BY query_id
), said AS (
  SELECT *, array_to_string(list_slice(regexp_extract_all(first, '[^\\s]*\\s|[^\\s]+$'), 1, 800), '') AS answer FROM contexts
), traces AS (
  SELECT q.query_id, CASE WHEN q.relevant THEN 'RELEVANT' ELSE 'OFF_TOPIC' END AS relevance, CASE WHEN NOT q.relevant THEN 'OFF_TOPIC' WHEN s.blocks IS NULL THEN 'NO_CONTEXT' ELSE 'OK' END AS status, q.text, s.* EXCLUDE (query_id) FROM asked q LEFT JOIN said s USING (query_id)
)
SELECT query_id, relevance, status, CASE status WHEN 'OFF_TOPIC' THEN '{MESSAGES["OFF_TOPIC"]}' WHEN 'NO_CONTEXT' THEN '{MESSAGES["NO_CONTEXT"]}' ELSE '' END AS message, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS condensed_md5,
       coalesce(found_ids, '') AS found_ids, coalesce(final_ids, '') AS final_ids, md5(coalesce(blocks, '')) AS blocks_md5, md5(coalesce(answer, '')) AS answer_md5 FROM traces
""")
def answer_traces(spark, sf_dir):
    """Every benchmark passage asked as a question through the whole plan: verdict, filtered hybrid search, budgeted context, answer, trace."""
    embedder = LetterEmbedder()
    texts = _texts(spark, sf_dir)
    own = F.col("point_id").cast("string")
    meta = {"doc_id": own, "doc_name": F.concat(F.lit("Doc "), own), "doc_date": F.lit(""), "source_url": F.lit(""), "exams_id": F.col("exams_id"), "tema": F.col("tema"), "tipo_seccion": F.lit("articulo"), "seccion": F.concat(F.lit("Art. "), (F.col("point_id") % 7).cast("string"))}
    points = texts.select("point_id", "content", embed_column(embedder)("content").alias("dense"), F.struct(*[c.alias(n) for n, c in meta.items()]).alias("metadata"))
    exam = F.element_at(F.array(*[F.lit(e) for e in ("A1", "A2", "C1", "C2")]), (F.col("item_id") % 4 + 1).cast("int"))
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit(None).cast("string").alias("history"), exam.alias("exam"), F.array(F.lit("src0"), F.lit("src1")).alias("temas"))
    traces = answer(asked, points, Components(embedder=embedder, query_model=KeywordQueryModel(("the", "der"))), k=5, spec=SPEC, session_id="s", timestamp_utc="t")
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["point_id"]), ",")
    md5 = lambda c: F.md5(F.coalesce(c, F.lit("")).cast("binary"))
    return traces.select("query_id", "relevance", "status", "message", md5(F.col("condensed_query")).alias("condensed_md5"), ids("retrieved").alias("found_ids"), ids("final_chunks").alias("final_ids"), md5(F.col("blocks")).alias("blocks_md5"), md5(F.col("answer")).alias("answer_md5"))
