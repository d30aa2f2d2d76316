"""Registered queries on the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Bm25Spec, ChunkSpec, ContextSpec, EvalSpec, FusionSpec, RetrievalSpec
from .functions.text import normalize_ref, pipe_split
from .operators import metrics as M
from .operators import retrieve as R
from .operators.context import render, within_budget
from .operators.history import session_segments, tail, to_contents, transcript
from .operators.segment import chunk_review, numeric_sequence, resolve_headings, segment, slice_texts, split_long
from .plans.answer import MESSAGES, messages, status, verdict
from .plans.ingest import with_metadata
from .sources.files import last_write_wins
from .streaming.sessions import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Searches take every row whose id is divisible by this as a query, against all rows.
EVERY = 50
SPEC = RetrievalSpec(bm25=Bm25Spec(), fusion=FusionSpec(k0=2, rank_base=0))


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("dense"), "label")


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).where(f"point_id % {EVERY} = 0").select(F.col("point_id").alias("query_id"), "dense", "label")


DENSE_CTE = f"""
dense_scores AS (
  SELECT q.vec_id AS query_id, d.vec_id AS point_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % {EVERY} = 0
)"""


@query(f"""
WITH {DENSE_CTE}
SELECT query_id, point_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM dense_scores
) WHERE rank <= 5
""")
def dense_topk(spark, sf_dir):
    """The five nearest vectors of each query vector by cosine."""
    return R.dense_topk(_vector_queries(spark, sf_dir), _points(spark, sf_dir), 5, exclude_self=True)


SPARSE_CTE = """
doc_words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}]+'), lambda x: x <> '') AS w FROM documents
), tf AS (
  SELECT doc_id, any_value(len(w)) AS len, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM doc_words) GROUP BY doc_id, term
), postings AS (
  SELECT term, doc_id AS point_id, tf * (CAST(1.2 AS DOUBLE) + 1) / (tf + CAST(1.2 AS DOUBLE) * (1 - CAST(0.75 AS DOUBLE) + CAST(0.75 AS DOUBLE) * len / CAST(256 AS DOUBLE))) AS weight FROM tf
), query_terms AS (
  SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}]+'), lambda x: x <> '')) AS term FROM benchmark)
), sparse_scores AS (
  SELECT query_id, point_id, round(sum(weight), 6) AS score FROM query_terms JOIN postings USING (term) GROUP BY query_id, point_id
)"""


def _sparse(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    points = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("point_id"), F.col("text").alias("content"))
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.sparse_topk(asked, points, R.inverted_index(points, SPEC.bm25, wanted=R.query_terms(asked, SPEC.bm25)), k, SPEC.bm25)


def _dense_of_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark items with the vector of their number, and the vectors of documents."""
    vectors = _points(spark, sf_dir)
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")).join(vectors.select(F.col("point_id").alias("query_id"), "dense"), "query_id")
    points = vectors.join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("point_id")), "point_id", "left_semi")
    return asked, points


@query(f"""
WITH {SPARSE_CTE}
SELECT query_id, point_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM sparse_scores
) WHERE rank <= 5
""")
def sparse_bm25_topk(spark, sf_dir):
    """The five best documents of each benchmark passage by saturated term frequency."""
    return _sparse(spark, sf_dir, 5)


ITEM_DENSE_CTE = """
item_dense AS (
  SELECT b.item_id AS query_id, d.vec_id AS point_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS score
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id CROSS JOIN embeddings d WHERE d.vec_id IN (SELECT doc_id FROM documents)
), dense_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM item_dense
), sparse_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM sparse_scores
)"""


@query(f"""
WITH {SPARSE_CTE}, {ITEM_DENSE_CTE}, both_ranked AS (
  SELECT query_id, point_id, rank FROM dense_ranked WHERE rank <= 5 UNION ALL SELECT query_id, point_id, rank FROM sparse_ranked WHERE rank <= 5
), fused AS (
  SELECT query_id, point_id, round(sum(CAST(1 AS DOUBLE) / (2 + rank - 1)), 9) AS score FROM both_ranked GROUP BY query_id, point_id
)
SELECT query_id, point_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM fused
) WHERE rank <= 5
""")
def hybrid_rrf(spark, sf_dir):
    """Dense and sparse branches of five, fused by reciprocal ranks."""
    asked, points = _dense_of_items(spark, sf_dir)
    dense = R.dense_topk(asked, points, 5).select("query_id", "point_id", "score")
    return R.hybrid_topk(dense, _sparse(spark, sf_dir, 5).drop("rank"), 5, SPEC)


@query(f"""
WITH {SPARSE_CTE}, {ITEM_DENSE_CTE}, grid AS (
  SELECT unnest([1, 2, 3, 4, 5, 10, 20]) AS k
), both_ranked AS (
  SELECT k, query_id, point_id, rank FROM dense_ranked JOIN grid ON rank <= k UNION ALL SELECT k, query_id, point_id, rank FROM sparse_ranked JOIN grid ON rank <= k
), fused AS (
  SELECT k, query_id, point_id, round(sum(CAST(1 AS DOUBLE) / (2 + rank - 1)), 9) AS score FROM both_ranked GROUP BY k, query_id, point_id
)
SELECT CAST(k AS INTEGER) AS k, query_id, point_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY k, query_id ORDER BY score DESC, point_id) AS rank FROM fused
) WHERE rank <= k
""")
def retrieval_k_sweep(spark, sf_dir):
    """The hybrid search at every depth of the grid."""
    asked, points = _dense_of_items(spark, sf_dir)
    dense = R.dense_topk(asked, points, max(SPEC.k_grid)).select("query_id", "point_id", "score")
    return R.k_sweep(dense, _sparse(spark, sf_dir, max(SPEC.k_grid)).drop("rank"), SPEC)


def _exam(lang: F.Column) -> F.Column:
    return F.when(lang == "en", "A1").when(lang == "de", "A2").when(lang == "fr", "C1").otherwise("C2")


@query(f"""
WITH meta AS (
  SELECT doc_id, CASE lang WHEN 'en' THEN 'A1' WHEN 'de' THEN 'A2' WHEN 'fr' THEN 'C1' ELSE 'C2' END AS exam, source FROM documents
), {DENSE_CTE}, kept AS (
  SELECT s.* FROM dense_scores s JOIN meta q ON q.doc_id = s.query_id JOIN meta d ON d.doc_id = s.point_id
  WHERE list_contains([d.exam], q.exam) AND (q.exam <> 'A1' OR list_has_any([d.source], [q.source, 'src0']))
)
SELECT query_id, point_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM kept
) WHERE rank <= 5
""")
def filtered_topk(spark, sf_dir):
    """Dense search within an exam and, for A1, any of two temas; the filter comes before the ranking."""
    docs = read(spark, sf_dir, "documents").select("doc_id", _exam(F.col("lang")).alias("exam"), "source")
    vectors = _points(spark, sf_dir).select("point_id", "dense")
    points = vectors.join(docs, F.col("point_id") == F.col("doc_id")).select("point_id", "dense", F.array("exam").alias("exams_id"), F.array("source").alias("tema"))
    asked = _vector_queries(spark, sf_dir).join(docs, F.col("query_id") == F.col("doc_id")).select("query_id", "dense", "exam", R.effective_temas(F.col("exam"), F.array("source", F.lit("src0"))).alias("temas"))
    return R.dense_topk(asked, points, 5, exclude_self=True)


RANK_CTE = f"""
{DENSE_CTE}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM dense_scores
), grid AS (
  SELECT unnest([1, 2, 3, 4, 5, 10, 20]) AS k
), expected AS (
  SELECT vec_id AS row_id, label, 'type' || CAST(label % 3 AS VARCHAR) AS question_type, k FROM embeddings CROSS JOIN grid WHERE vec_id % {EVERY} = 0
), ranks AS (
  SELECT e.row_id, e.k, any_value(e.question_type) AS question_type, min(CASE WHEN d.label = e.label THEN r.rank END) AS rank
  FROM expected e LEFT JOIN ranked r ON r.query_id = e.row_id AND r.rank <= e.k LEFT JOIN embeddings d ON d.vec_id = r.point_id
  GROUP BY e.row_id, e.k
)"""


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = F.explode(F.array(*[F.lit(k) for k in SPEC.k_grid])).alias("k")
    asked = _vector_queries(spark, sf_dir)
    found = R.dense_topk(asked, _points(spark, sf_dir), max(SPEC.k_grid), exclude_self=True)
    labels = _points(spark, sf_dir).select("point_id", "label")
    results = found.join(labels, "point_id").select(F.col("query_id").alias("row_id"), "rank", F.lit("").alias("doc_id"), F.col("label").cast("string").alias("ref"), grid).where("rank <= k")
    rows = asked.select(F.col("query_id").alias("row_id"), F.concat(F.lit("type"), (F.col("label") % 3).cast("string")).alias("question_type"), F.lit("").alias("doc_id"), F.col("label").cast("string").alias("ref"), grid)
    return M.ground_truth_ranks(rows, results)


@query(f"WITH {RANK_CTE} SELECT row_id, CAST(k AS INTEGER) AS k, question_type, CAST(rank AS INTEGER) AS rank FROM ranks")
def ground_truth_rank(spark, sf_dir):
    """First rank of a vector with the query's label at every depth, or null."""
    return _ranks(spark, sf_dir)


@query(f"""
WITH {RANK_CTE}
SELECT CAST(k AS INTEGER) AS k, CASE WHEN grouping(question_type) = 1 THEN 'all' ELSE question_type END AS question_type,
       round(avg(CASE WHEN rank <= k THEN CAST(1 AS DOUBLE) ELSE 0 END), 9) AS hit_rate, count(*) AS n
FROM ranks GROUP BY GROUPING SETS ((k), (question_type, k))
""")
def hit_rate_grouping_sets(spark, sf_dir):
    """Hit rates by depth, in all and by question type, in one aggregate."""
    return M.hit_rate_sets(_ranks(spark, sf_dir)).withColumn("hit_rate", F.round("hit_rate", 9))


@query("""
WITH expected AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'en' ELSE 'de' END AS ref FROM labels)
SELECT e.doc_id AS row_id, 'not indexed' AS reason FROM expected e WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = e.doc_id AND d.lang = e.ref)
""")
def ground_truth_missing(spark, sf_dir):
    """Expected (document, section) keys that no indexed row has: the language stands for the section."""
    rows = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), F.lit("standard").alias("question_type"), F.col("doc_id").cast("string").alias("ground_truth_doc_id"), F.when(F.col("quality") == 1, "en").otherwise("de").alias("ground_truth_ref"))
    chunks = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").alias("seccion"), F.lit("none").alias("tipo_seccion"))
    return M.ground_truth_failures(rows, chunks)


@query("SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def metadata_join(spark, sf_dir):
    """Documents that have metadata, with it."""
    known, _ = with_metadata(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), _label_metadata(spark, sf_dir))
    return known.select("doc_id", "lang", "source", F.col("exams_id").cast("int").alias("quality"), F.col("tema").cast("int").alias("toxic"))


def _label_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in the columns of the metadata."""
    fixed = [F.lit("").alias(c) for c in ("doc_name", "doc_date", "source_url")]
    return read(spark, sf_dir, "labels").select("doc_id", *fixed, F.col("quality").cast("string").alias("exams_id"), F.col("toxic").cast("string").alias("tema"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def docs_without_metadata(spark, sf_dir):
    return with_metadata(read(spark, sf_dir, "documents").select("doc_id", "text"), _label_metadata(spark, sf_dir))[1]


BUDGET_CTE = """
counted AS (
  SELECT source AS query_id, doc_id, text, CAST(ceil(length(text) / CAST(3 AS DOUBLE)) AS BIGINT) AS n_tokens_estimate, lang FROM documents
), summed AS (
  SELECT *, CAST(sum(n_tokens_estimate) OVER (PARTITION BY query_id ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_tokens,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS INTEGER) AS citation FROM counted
), kept AS (SELECT * FROM summed WHERE citation = 1 OR cum_tokens <= 3000)"""


def _budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = read(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), "doc_id", "lang", F.col("text").alias("content"))
    return within_budget(results, ContextSpec(), order="doc_id")


@query(f"WITH {BUDGET_CTE} SELECT query_id, doc_id, citation, n_tokens_estimate, cum_tokens FROM kept")
def context_budget(spark, sf_dir):
    """Documents of each source, in order, within the context budget."""
    return _budgeted(spark, sf_dir).select("query_id", "doc_id", "citation", "n_tokens_estimate", "cum_tokens")


@query(f"""
WITH {BUDGET_CTE}
SELECT query_id, string_agg('[' || CAST(citation AS VARCHAR) || '] ' || query_id || ' — ' || lang || chr(10) || text, chr(10) || chr(10) ORDER BY citation) AS blocks, CAST(sum(n_tokens_estimate) AS BIGINT) AS n_tokens_estimate
FROM kept GROUP BY query_id
""")
def context_render(spark, sf_dir):
    """The numbered blocks of each source."""
    meta = F.struct(F.col("doc_id").cast("string").alias("doc_id"), F.col("query_id").alias("doc_name"), F.lit("").alias("doc_date"), F.lit("").alias("source_url"), F.col("lang").alias("seccion"))
    kept = _budgeted(spark, sf_dir).select("query_id", "citation", "n_tokens_estimate", "content", F.col("doc_id").cast("string").alias("point_id"), meta.alias("metadata"))
    asked = read(spark, sf_dir, "documents").select(F.col("source").alias("query_id")).distinct()
    return render(kept, asked).select("query_id", "blocks", "n_tokens_estimate")


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6")
def history_tail(spark, sf_dir):
    return tail(read(spark, sf_dir, "conversations"), 6)


@query("SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'Usuario: ' ELSE 'Asistente: ' END || coalesce(text, ''), chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def history_transcript(spark, sf_dir):
    return transcript(read(spark, sf_dir, "conversations"))


@query("""
SELECT conv_id, max_by(text, turn) FILTER (role = 'system') AS instruction,
       coalesce(string_agg(CASE WHEN role = 'assistant' THEN 'model' ELSE 'user' END || '=' || text, chr(31) ORDER BY turn) FILTER (role <> 'system'), '') AS contents
FROM conversations GROUP BY conv_id
""")
def model_contents(spark, sf_dir):
    found = to_contents(read(spark, sf_dir, "conversations"))
    return found.select("conv_id", "instruction", F.array_join(F.transform("contents", lambda x: F.concat_ws("=", x["role"], x["text"])), "\x1f").alias("contents"))


@query("""
WITH marked AS (
  SELECT *, CASE WHEN event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS c FROM events
)
SELECT event_id, user_id, event_type, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM marked
""")
def session_reset(spark, sf_dir):
    """Segments of a user's events between changes of type."""
    return session_segments(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type", "segment")


CONFUSION = """
WITH c AS (
  SELECT count(*) FILTER (quality = 0 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 0) AS fp, count(*) FILTER (quality <> 0 AND toxic = 1) AS fn,
         count(*) FILTER (quality <> 0 AND toxic = 0) AS tn, CAST(0 AS BIGINT) AS n_unknown FROM labels
), p AS (
  SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS "precision", coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall FROM c
)
SELECT tp, fp, fn, tn, n_unknown, round("precision", 9) AS "precision", round(recall, 9) AS recall, round(coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0), 9) AS f1,
       round(coalesce(CAST(tp + tn AS DOUBLE) / nullif(tp + fp + fn + tn, 0), 0), 9) AS accuracy FROM p
"""


@query(CONFUSION)
def confusion_metrics(spark, sf_dir):
    """Low quality taken as the verdict, toxic as the truth."""
    rows = read(spark, sf_dir, "labels").select((F.col("toxic") == 1).alias("actual_off_topic"), F.when(F.col("quality") == 0, "OFF_TOPIC").otherwise("RELEVANT").alias("verdict"))
    found = M.confusion(rows)
    return found.select("tp", "fp", "fn", "tn", "n_unknown", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = read(spark, sf_dir, "labels").join(docs, "doc_id")
    return rows.select(F.col("lang").alias("question_type"), (F.col("quality") + 2 * F.col("toxic")).alias("correctness"), (3 - F.col("quality")).alias("faithfulness"), F.when(F.col("toxic") == 1, "status=OFF_TOPIC").alias("zeroed_reason"))


@query("""
WITH r AS (SELECT d.lang AS question_type, l.quality + 2 * l.toxic AS s, l.toxic FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
SELECT CASE WHEN grouping(question_type) = 1 THEN 'total' ELSE 'question_type=' || question_type END AS label, count(*) AS n, count(*) FILTER (toxic = 1) AS n_zeroed, round(avg(s), 9) AS mean,
       count(*) FILTER (s = 0) AS score_0, count(*) FILTER (s = 1) AS score_1, count(*) FILTER (s = 2) AS score_2, count(*) FILTER (s = 3) AS score_3, CAST(grouping(question_type) AS INTEGER) AS row_order
FROM r GROUP BY ROLLUP (question_type)
""")
def score_breakdown_rollup(spark, sf_dir):
    return M.score_breakdown(_records(spark, sf_dir), "correctness").withColumn("mean", F.round("mean", 9))


@query("""
WITH r AS (SELECT l.quality + 2 * l.toxic AS c, 3 - l.quality AS f, l.toxic FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
SELECT count(*) AS n, count(*) FILTER (toxic = 1) AS n_zeroed, round(avg(c), 9) AS correctness, round(avg(f), 9) AS faithfulness, round(avg(c) / 3, 9) AS correctness_share, round(avg(f) / 3, 9) AS faithfulness_share FROM r
""")
def score_summary(spark, sf_dir):
    found = M.score_summary(_records(spark, sf_dir))
    return found.select("n", "n_zeroed", *[F.round(c, 9).alias(c) for c in ("correctness", "faithfulness", "correctness_share", "faithfulness_share")])


def _durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.create_map("event_type", "value").alias("durations_ms"))


@query("""
SELECT event_type AS stage, count(*) AS n, round(avg(value) / 1000, 9) AS avg_s, round(max(value) / 1000, 9) AS max_s, CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS INTEGER) AS stage_order
FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY event_type
""")
def stage_latency(spark, sf_dir):
    """Event types as stages, in a fixed order."""
    found = M.stage_latencies(_durations(spark, sf_dir), EvalSpec(stages=("view", "click", "purchase")))
    return found.select("stage", "n", F.round("avg_s", 9).alias("avg_s"), F.round("max_s", 9).alias("max_s"), "stage_order")


@query("SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY source")
def dataset_pivot(spark, sf_dir):
    return M.pivot_counts(read(spark, sf_dir, "documents"), "source", "lang", ["en", "de", "fr", "es"])


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY event_type")
def status_counts(spark, sf_dir):
    return M.value_counts(read(spark, sf_dir, "events").withColumnRenamed("event_type", "status"), "status")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def last_write(spark, sf_dir):
    """The last event of each user."""
    return last_write_wins(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("""
WITH joined AS (SELECT doc_id, source || '|' || CASE WHEN lang = 'en' THEN '' ELSE lang END || '||' || CASE WHEN doc_id % 3 = 0 THEN 'x|' ELSE '' END AS v FROM documents)
SELECT doc_id, list_filter(string_split(v, '|'), lambda x: x <> '')::VARCHAR[] AS parts FROM joined
""")
def pipe_split_values(spark, sf_dir):
    v = F.concat(F.col("source"), F.lit("|"), F.when(F.col("lang") == "en", "").otherwise(F.col("lang")), F.lit("||"), F.when(F.col("doc_id") % 3 == 0, "x|").otherwise(""))
    return read(spark, sf_dir, "documents").select("doc_id", pipe_split(v).alias("parts"))


@query("""
WITH marks AS (
  SELECT l_orderkey, list(l_linenumber ORDER BY l_partkey, l_linenumber) AS m FROM lineitem GROUP BY l_orderkey
), run AS (
  SELECT l_orderkey, len(m) AS n_marks, list_reduce(list_prepend(0, m), lambda a, x: CASE WHEN x = a + 1 THEN a + 1 ELSE a END) AS run FROM marks
)
SELECT l_orderkey, CAST(n_marks AS INTEGER) AS n_marks, CAST(CASE WHEN run >= 3 AND run * 10 >= n_marks * 8 THEN run ELSE 0 END AS INTEGER) AS n_kept FROM run
""")
def numeric_sequences(spark, sf_dir):
    """Line numbers of each order, by part, as the marks of an enumeration."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", F.col("l_linenumber").alias("number")))).alias("m"))
    return lines.select("l_orderkey", F.size("m").alias("n_marks"), F.size(numeric_sequence(F.col("m"))).alias("n_kept"))


@query("""
WITH tags AS (
  SELECT user_id, event_id AS start, CASE event_type WHEN 'view' THEN 'ordinal' WHEN 'click' THEN 'heading' ELSE 'category' END AS kind, CASE WHEN event_id % 4 = 0 THEN 'Disposición ' ELSE 'Artículo ' END || CAST(event_id AS VARCHAR) AS heading FROM events
), n AS (
  SELECT *, lead(kind) OVER w AS nxt, last_value(CASE WHEN kind <> 'ordinal' THEN kind END IGNORE NULLS) OVER b AS pk, last_value(CASE WHEN kind <> 'ordinal' THEN heading END IGNORE NULLS) OVER b AS ph
  FROM tags WINDOW w AS (PARTITION BY user_id ORDER BY start), b AS (PARTITION BY user_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT user_id, start, CASE WHEN kind = 'heading' AND lower(heading) LIKE 'disposici%' THEN 'disposicion' WHEN kind = 'heading' THEN 'articulo'
    WHEN kind = 'category' AND coalesce(nxt, '') <> 'ordinal' THEN 'disposicion' WHEN kind = 'ordinal' AND pk IS NULL THEN 'articulo' WHEN kind = 'ordinal' AND pk = 'category' THEN 'disposicion' END AS tipo_seccion,
    CASE WHEN kind = 'ordinal' AND pk = 'category' THEN ph || ' ' || heading ELSE heading END AS seccion FROM n
)
SELECT user_id, start, tipo_seccion, seccion FROM t WHERE tipo_seccion IS NOT NULL
""")
def heading_state_machine(spark, sf_dir):
    """A user's events as headings, categories and ordinals."""
    kind = F.when(F.col("event_type") == "view", "ordinal").when(F.col("event_type") == "click", "heading").otherwise("category")
    name = F.concat(F.when(F.col("event_id") % 4 == 0, "Disposición ").otherwise("Artículo "), F.col("event_id").cast("string"))
    tags = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("start"), kind.alias("kind"), name.alias("heading"))
    return resolve_headings(tags, ("user_id",)).select("user_id", "start", "tipo_seccion", "seccion")


def _legalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document as an article with its number."""
    line = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("Artículo "), (i + 1).cast("string"), F.lit(". "), x))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.array_join(line, "\n").alias("text"))


LINES_CTE = """
lines AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents
)"""


@query(f"""
WITH {LINES_CTE}
SELECT doc_id, CAST(i - 1 AS INTEGER) AS section_seq, 'articulo' AS tipo_seccion, 'Artículo ' || CAST(i AS VARCHAR) || '.' AS seccion, md5(trim('Artículo ' || CAST(i AS VARCHAR) || '. ' || line)) AS content_md5, 'articulo_disposicion' AS level FROM lines
""")
def segment_legalised(spark, sf_dir):
    """The segmentation of the legalised documents gives back their lines."""
    found = segment(_legalised(spark, sf_dir))
    return found.select("doc_id", "section_seq", "tipo_seccion", "seccion", F.md5(F.col("content").cast("binary")).alias("content_md5"), "level")


@query("""
WITH pos AS (
  SELECT doc_id, text, i FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1)) AS i FROM documents) WHERE substr(text, CAST(i + 1 AS INTEGER), 1) = chr(10)
), starts AS (
  SELECT doc_id, text, i, row_number() OVER w AS section_seq, lead(i, 1, length(text)) OVER w AS stop FROM pos WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), s AS (
  SELECT doc_id, section_seq, 'none' AS tipo_seccion, trim(substr(text, CAST(i + 1 AS INTEGER), CAST(stop - i AS INTEGER)), ' ' || chr(10) || chr(9)) AS content FROM starts
  UNION ALL SELECT doc_id, 0, 'preambulo', trim(substr(text, 1, CAST(i AS INTEGER)), ' ' || chr(10) || chr(9)) FROM starts WHERE section_seq = 1 AND i > 0
)
SELECT doc_id, CAST(section_seq AS INTEGER) AS section_seq, tipo_seccion, md5(content) AS content_md5 FROM s WHERE section_seq > 0 OR content <> ''
""")
def section_slices(spark, sf_dir):
    """Slices of each document from line end to line end."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    w = F.transform(F.split("text", "\n"), lambda x: F.length(x) + 1)
    ends = F.aggregate(w, F.array().cast("array<int>"), lambda a, n: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(-1)) + n)))
    starts = F.transform(F.slice(ends, F.lit(1), F.size(ends) - 1), lambda i: F.struct(i.alias("start"), F.lit("none").alias("tipo_seccion"), F.lit("").alias("seccion")))
    return slice_texts(docs.withColumn("starts", starts)).select("doc_id", "section_seq", "tipo_seccion", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("SELECT doc_id, md5(trim(regexp_replace(nfc_normalize(text), '[ \\t\\n\\r]+', ' ', 'g'))) AS ref_md5 FROM documents")
def normalized_refs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(normalize_ref(F.col("text")).cast("binary")).alias("ref_md5"))


@query(f"""
WITH {LINES_CTE}
SELECT doc_id, 'articulo_disposicion' AS segmentation_level, count(*) AS n_different_sections, CAST(0 AS BIGINT) AS n_split_chunks, count(*) AS final_n_chunks, CAST(0 AS BIGINT) AS preamble_length_tokens FROM lines GROUP BY doc_id
""")
def chunk_reviews(spark, sf_dir):
    """The review of the legalised documents, with a limit that no line reaches."""
    sections = segment(_legalised(spark, sf_dir), ChunkSpec(max_tokens=1_000_000))
    found = chunk_review(split_long(sections, ChunkSpec(max_tokens=1_000_000)))
    return found.select("doc_id", "segmentation_level", "n_different_sections", "n_split_chunks", "final_n_chunks", "preamble_length_tokens")


#: Limits of split_long_chunks: tokens of a part without the two special ones, and of the overlap.
SPLIT_SIZE, SPLIT_OVERLAP = 254, 32


@query(rf"""
WITH RECURSIVE lines AS (
  SELECT doc_id, i, CASE WHEN i = 1 THEN p ELSE chr(10) || p END AS piece FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
), counted AS (
  SELECT doc_id, i, piece, len(regexp_extract_all(piece, '[\p{{L}}\p{{N}}_]{{1,6}}|[^\p{{L}}\p{{N}}_\s]')) AS n FROM lines WHERE piece <> ''
), marked AS (
  SELECT *, sum(CASE WHEN n >= {SPLIT_SIZE} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM counted
), words AS (
  SELECT doc_id, i, 2 * k - 1 AS run, j, CASE WHEN j = 1 THEN w ELSE ' ' || w END AS piece FROM (SELECT doc_id, i, k, unnest(string_split(piece, ' ')) AS w, generate_subscripts(string_split(piece, ' '), 1) AS j FROM marked WHERE n >= {SPLIT_SIZE})
), pieces AS (
  SELECT doc_id, i, 2 * k AS run, 1 AS j, piece, n FROM marked WHERE n < {SPLIT_SIZE}
  UNION ALL SELECT doc_id, i, run, j, piece, len(regexp_extract_all(piece, '[\p{{L}}\p{{N}}_]{{1,6}}|[^\p{{L}}\p{{N}}_\s]')) FROM words WHERE piece <> ''
), summed AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id, run ORDER BY i, j) AS upto FROM pieces
), runs AS (
  SELECT doc_id, run, list(piece ORDER BY i, j) AS p, list_prepend(CAST(0 AS HUGEINT), list(upto ORDER BY i, j)) AS c FROM summed GROUP BY doc_id, run
), parts AS (
  SELECT doc_id, run, p, c, 0 AS part, CAST(0 AS BIGINT) AS b, greatest(1, len(list_filter(c, lambda x: x <= {SPLIT_SIZE})) - 1) AS e FROM runs
  UNION ALL
  SELECT doc_id, run, p, c, part + 1, b, greatest(b + 1, len(list_filter(c, lambda x: x <= c[b + 1] + {SPLIT_SIZE})) - 1) FROM (
    SELECT doc_id, run, p, c, part, least(e, greatest(b, len(list_filter(c, lambda x: x < greatest(c[e + 1] - {SPLIT_OVERLAP}, c[e + 2] - {SPLIT_SIZE}))))) AS b FROM parts WHERE e < len(p)
  )
), texts AS (
  SELECT doc_id, run, part, regexp_replace(array_to_string(p[b + 1 : e], ''), '^\s+|\s+$', '', 'g') AS content, c[e + 1] - c[b + 1] + 2 AS n_tokens FROM parts
)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run, part) - 1 AS INTEGER) AS section_seq, 0 AS part_seq, 'none' AS tipo_seccion, CAST(n_tokens AS INTEGER) AS n_tokens, content FROM texts WHERE content <> ''
""")
def split_long_chunks(spark, sf_dir):
    """Raw documents by length, in parts of at most 256 tokens, two of them special, with overlap."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    spec = ChunkSpec(max_tokens=SPLIT_SIZE + 2, overlap=SPLIT_OVERLAP)
    return split_long(segment(docs, spec), spec).select("doc_id", "section_seq", "part_seq", "tipo_seccion", "n_tokens", "content")


@query(f"""
WITH hits AS (
  SELECT b.item_id, count(d.doc_id) AS n FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id
), s AS (
  SELECT b.item_id AS query_id, CASE WHEN b.item_id % 7 = 0 THEN 'OFF_TOPIC' WHEN b.item_id % 11 = 0 THEN 'UNKNOWN' ELSE 'RELEVANT' END AS relevance, h.n, CASE WHEN b.item_id % 2 = 0 THEN b.text ELSE '' END AS c, b.text FROM benchmark b JOIN hits h ON h.item_id = b.item_id
), t AS (
  SELECT *, CASE WHEN relevance = 'OFF_TOPIC' THEN 'OFF_TOPIC' WHEN n = 0 THEN 'NO_CONTEXT' ELSE 'OK' END AS status FROM s
)
SELECT query_id, relevance, status, md5(CASE WHEN c = '' THEN text ELSE c END) AS condensed_md5, CASE status WHEN 'OFF_TOPIC' THEN '{MESSAGES["OFF_TOPIC"]}' WHEN 'NO_CONTEXT' THEN '{MESSAGES["NO_CONTEXT"]}' ELSE '' END AS message FROM t
""")
def pipeline_status(spark, sf_dir):
    """Verdicts, gates and messages; a passage's documents are those that contain it."""
    items = read(spark, sf_dir, "benchmark")
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    label = F.when(F.col("item_id") % 7 == 0, "NO").when(F.col("item_id") % 11 == 0, F.lit(None)).otherwise("SI")
    rows = items.select(F.col("item_id").alias("query_id"), verdict(label).alias("relevance"), F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise("").alias("c"), "text")
    hits = _containing(items, docs)
    joined = rows.join(hits, "query_id", "left")
    blocks = F.when(F.coalesce("n", F.lit(0)) > 0, "[1]")
    return joined.withColumn("status", status(F.col("relevance"), blocks, F.lit(None))).select("query_id", "relevance", "status", F.md5(F.when(F.col("c") == "", F.col("text")).otherwise(F.col("c")).cast("binary")).alias("condensed_md5"), messages()[F.col("status")].alias("message"))


def _containing(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, n): documents that contain each passage, by an inner word window and an exact check.

    Windows are hashes, and only those of the passages stay.  Passages too short for a window between their first and last
    word, which may be parts of words, are held against every document.
    """
    width = 4
    words = F.split("text", r"\s+")
    window = lambda w, i: F.xxhash64(*[F.get(w, i + j) for j in range(width)])
    keys = items.select(F.col("item_id").alias("query_id"), "text", F.when(F.size(words) >= width + 2, window(words, F.lit(1))).alias("key"))
    windows = docs.select("doc_id", F.split("body", r"\s+").alias("w"))
    windows = windows.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0))), lambda i: window(F.col("w"), i))).alias("key"))
    # only ids meet by window; the few that do get their texts for the exact check
    met = windows.join(keys.where("key IS NOT NULL"), "key").select("query_id", "doc_id", "text").distinct()
    found = met.join(docs, "doc_id").where(F.contains("body", "text")).select("query_id", "doc_id").distinct()
    short = keys.where("key IS NULL").select("query_id", "text").join(docs, F.contains("body", "text")).select("query_id", "doc_id").distinct()
    return found.unionByName(short).groupBy("query_id").agg(F.count("*").alias("n"))


@query("SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """Hourly counts, the batch form of the streaming windows."""
    rows = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = windowed_counts(rows).withColumn("value", F.round("value", 4))
    return found.select(F.floor(F.unix_timestamp("window.start") / 3600).alias("hour"), "event_type", "n", "value")
