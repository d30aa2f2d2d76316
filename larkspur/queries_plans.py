"""Further registered queries: texts, sources, plans and records, each through the library and with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ChunkSpec, ContextSpec, EvalSpec, IndexSpec
from .operators import metrics as M
from .operators import retrieve as R
from .operators.context import mark_kept, render, render_sources, source_label, within_budget
from .operators.history import tail_array
from .operators.segment import drop_citations, segment, split_long
from .plans.answer import CONTEXT_MARK, SYSTEM_PROMPT, next_history, prompt, stream_fragments
from .plans.evaluate import evaluate_queries, judge_rows
from .plans.ingest import ingest
from .plans.models import ExtractiveGenerator, GenerationConfig, KeywordQueryModel, OverlapJudge
from . import queries_search  # noqa: F401  (registers its queries)
from .queries import LINES_CTE, query, read
from .sources import files, jsonl
from .sources.index_store import read_index, scroll_sections, to_points, write_index
from .sources.scratch import scratch_dir
from .streaming.sessions import OUT, artifact_sink, session_turns

WIDE = ChunkSpec(max_tokens=1_000_000)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.split("text", "\n").alias("lines"), F.col("doc_id").alias("n"))


def _each(form) -> F.Column:
    return F.array_join(F.transform("lines", lambda x, i: form(x, (i + 1).cast("string"), i + 1)), "\n")


def _digest(sections: DataFrame) -> DataFrame:
    return sections.select("doc_id", "section_seq", "tipo_seccion", "seccion", F.md5(F.col("content").cast("binary")).alias("content_md5"), "level")


@query(f"""
WITH {LINES_CTE}, s AS (
  SELECT doc_id, i, 'Artículo ' || CAST(i AS VARCHAR) || '.' AS h, line, CASE WHEN i % 3 = 0 THEN ' dice «' || chr(10) || 'Artículo 99. cita' || chr(10) || 'fin»' ELSE '' END AS q FROM lines
)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS section_seq, 'articulo' AS tipo_seccion, h AS seccion, md5(trim(h || ' ' || line || q)) AS content_md5, 'articulo_disposicion' AS level FROM s
""")
def segment_citations(spark, sf_dir):
    """Headings inside open quotations stay text of the article that quotes them."""
    article = lambda x, i, n: F.concat(F.lit("Artículo "), i, F.lit(". "), x, F.when(n % 3 == 0, " dice «\nArtículo 99. cita\nfin»").otherwise(""))
    return _digest(segment(_docs(spark, sf_dir).select("doc_id", _each(article).alias("text")), WIDE))


@query(f"""
WITH {LINES_CTE}, n AS (
  SELECT *, CAST(doc_id AS BIGINT) % 3 AS v, count(*) OVER (PARTITION BY doc_id) AS k FROM lines
), s AS (
  SELECT doc_id, i, line, CASE WHEN v = 0 AND k BETWEEN 3 AND 999 THEN 'n' WHEN v = 1 THEN 't' ELSE 'c' END AS v FROM n
)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS section_seq, CASE v WHEN 'n' THEN 'articulo' WHEN 't' THEN 'titulo' ELSE 'capitulo' END AS tipo_seccion,
       CASE v WHEN 'n' THEN CAST(i AS VARCHAR) || '.' WHEN 't' THEN 'TÍTULO ' || CAST(i AS VARCHAR) ELSE 'CAPÍTULO ' || CAST(i AS VARCHAR) END AS seccion,
       md5(trim(CASE v WHEN 'n' THEN CAST(i AS VARCHAR) || '. ' WHEN 't' THEN 'TÍTULO ' || CAST(i AS VARCHAR) || chr(10) ELSE 'CAPÍTULO ' || CAST(i AS VARCHAR) || chr(10) END || line)) AS content_md5,
       CASE v WHEN 'n' THEN 'articulo_disposicion' WHEN 't' THEN 'titulo' ELSE 'capitulo' END AS level
FROM s
""")
def segment_outlines(spark, sf_dir):
    """Numbered texts, texts of titles and texts of chapters, by the id."""
    docs = _docs(spark, sf_dir)
    numbered = (F.col("n") % 3 == 0) & F.size("lines").between(3, 999)
    text = F.when(numbered, _each(lambda x, i, _: F.concat(i, F.lit(". "), x))).when(F.col("n") % 3 == 1, _each(lambda x, i, _: F.concat(F.lit("TÍTULO "), i, F.lit("\n"), x))).otherwise(_each(lambda x, i, _: F.concat(F.lit("CAPÍTULO "), i, F.lit("\n"), x)))
    return _digest(segment(docs.select("doc_id", text.alias("text")), WIDE))


@query(f"""
WITH {LINES_CTE}, n AS (
  SELECT *, CAST(doc_id AS BIGINT) % 2 AS v, max(i) OVER (PARTITION BY doc_id) AS k, first_value(line) OVER (PARTITION BY doc_id ORDER BY i) AS first FROM lines
), s AS (
  SELECT doc_id, i AS seq, 'articulo' AS tipo, 'Artículo ' || CAST(i AS VARCHAR) || '.' AS h, 'Artículo ' || CAST(i AS VARCHAR) || '. ' || line AS c FROM n
  UNION ALL SELECT doc_id, 0, 'preambulo', NULL, CASE WHEN v = 1 THEN 'Preámbulo.' ELSE 'fuera ' || doc_id END FROM n WHERE i = 1
  UNION ALL SELECT doc_id, k + 1, 'anexo', 'ANEXO I', 'ANEXO I' || chr(10) || first FROM n WHERE i = 1 AND v = 1
  UNION ALL SELECT doc_id, k + 2, 'anexo', 'ANEXO II', 'ANEXO II' || chr(10) || 'fin' FROM n WHERE i = 1 AND v = 1
)
SELECT doc_id, CAST(seq AS INTEGER) AS section_seq, tipo AS tipo_seccion, h AS seccion, md5(trim(c)) AS content_md5, 'articulo_disposicion' AS level FROM s
""")
def segment_annexes(spark, sf_dir):
    """Preambles and annexes, and documents within others behind a title, by the id."""
    body = _each(lambda x, i, _: F.concat(F.lit("Artículo "), i, F.lit(". "), x))
    annexes = F.concat(F.lit("Preámbulo.\n"), body, F.lit("\nANEXO I\n"), F.element_at("lines", 1), F.lit("\nANEXO II\nfin"))
    embedded = F.concat(F.lit("fuera "), F.col("doc_id"), F.lit("\nPLAN GENERAL DE CONTABILIDAD\n«"), body)
    return _digest(segment(_docs(spark, sf_dir).select("doc_id", F.when(F.col("n") % 2 == 1, annexes).otherwise(embedded).alias("text")), WIDE))


@query("""
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 4 = 3 AND doc_id NOT IN (3, 7, 11) THEN 4 ELSE doc_id % 4 END AS v FROM documents)
SELECT doc_id, CAST(s.i AS INTEGER) AS section_seq, s.t AS tipo_seccion, s.h AS seccion, md5(s.c) AS content_md5, CASE WHEN v = 3 THEN 'documento completo' ELSE 'articulo_disposicion' END AS level
FROM (SELECT doc_id, v, unnest(CASE v
  WHEN 0 THEN [{'i': 0, 't': 'preambulo', 'h': NULL, 'c': 'DISPOSICIONES FINALES'}, {'i': 1, 't': 'disposicion', 'h': 'DISPOSICIONES FINALES Primera.', 'c': 'Primera. uno ' || doc_id}, {'i': 2, 't': 'disposicion', 'h': 'DISPOSICIONES FINALES Segunda.', 'c': 'Segunda. dos'}]
  WHEN 1 THEN [{'i': 0, 't': 'articulo', 'h': '1.', 'c': '1. a ' || doc_id}, {'i': 1, 't': 'articulo', 'h': '2.', 'c': '2. b'}, {'i': 2, 't': 'articulo', 'h': '3.', 'c': '3. c'}, {'i': 3, 't': 'disposicion', 'h': 'Disposición final única.', 'c': 'Disposición final única. d'}]
  WHEN 2 THEN [{'i': 0, 't': 'articulo', 'h': 'Primero.', 'c': 'Primero. x ' || doc_id}, {'i': 1, 't': 'articulo', 'h': 'Artículo ciento treinta y dos.', 'c': 'Artículo ciento treinta y dos. y' || chr(10) || 'Segundo. z'}]
  WHEN 3 THEN [{'i': 0, 't': 'none', 'h': NULL, 'c': 'Artículo 1. forzado ' || doc_id}]
  ELSE [{'i': 0, 't': 'articulo', 'h': 'Artículo 1.', 'c': 'Artículo 1. forzado ' || doc_id}] END) AS s FROM d)
""")
def segment_dispositions(spark, sf_dir):
    """Dispositions under a category, numbers before the first heading, ordinals, and documents whose headings aren't trusted."""
    docs = _docs(spark, sf_dir)
    own, v = F.col("doc_id"), F.col("n") % 4
    text = (
        F.when(v == 0, F.concat(F.lit("DISPOSICIONES FINALES\nPrimera. uno "), own, F.lit("\nSegunda. dos")))
        .when(v == 1, F.concat(F.lit("1. a "), own, F.lit("\n2. b\n3. c\nDisposición final única. d")))
        .when(v == 2, F.concat(F.lit("Primero. x "), own, F.lit("\nArtículo ciento treinta y dos. y\nSegundo. z")))
        .otherwise(F.concat(F.lit("Artículo 1. forzado "), own))
    )
    return _digest(segment(docs.select("doc_id", text.alias("text")), ChunkSpec(max_tokens=1_000_000, forced=frozenset({"3", "7", "11"}))))


TOKENS = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]{{1,6}}|[^\p{{L}}\p{{N}}_\s]'))"


@query(f"""
WITH {LINES_CTE}, s AS (
  SELECT doc_id, 'Artículo ' || CAST(i AS VARCHAR) || '. ' || line AS c FROM lines
), t AS (
  SELECT doc_id, {TOKENS.format('trim(c)')} + 2 AS n FROM s
), g AS (
  SELECT doc_id, count(*) + 1 AS k, count(*) FILTER (n > 64) AS long FROM t GROUP BY doc_id
)
SELECT doc_id, k AS n_different_sections, long AS n_split_chunks, CASE WHEN long = 0 THEN k END AS n_chunks, CAST({TOKENS.format("'Preámbulo de la norma ' || doc_id || '.'")} + 2 AS BIGINT) AS preamble_length_tokens,
       'preambulo' AS first_section FROM g
""")
def chunk_review_splits(spark, sf_dir):
    """The review, written and read again, with a limit that many lines go over: sections, split ones, and the tokens of the preamble."""
    from .operators.segment import chunk_review

    body = _each(lambda x, i, _: F.concat(F.lit("Artículo "), i, F.lit(". "), x))
    docs = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("Preámbulo de la norma "), F.col("doc_id"), F.lit(".\n"), body).alias("text"))
    spec = ChunkSpec(max_tokens=64, overlap=8)
    folder = scratch_dir(spark, "review")
    files.write_review(chunk_review(split_long(segment(docs, spec), spec)), folder)
    kinds = "doc_id string, n_different_sections long, n_split_chunks long, final_n_chunks long, preamble_length_tokens long, sections array<string>"
    found = spark.read.schema(kinds).json(folder)
    return found.select("doc_id", "n_different_sections", "n_split_chunks", F.when(F.col("n_split_chunks") == 0, F.col("final_n_chunks")).alias("n_chunks"), "preamble_length_tokens", F.element_at("sections", 1).alias("first_section"))


@query(f"""
WITH {LINES_CTE}, l AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, quality, toxic FROM labels
)
SELECT x.doc_id, 'Doc ' || x.doc_id AS doc_name, CAST(x.i - 1 AS INTEGER) AS section_seq, CAST(0 AS INTEGER) AS part_seq, 'articulo' AS tipo_seccion, 'Artículo ' || CAST(x.i AS VARCHAR) || '.' AS seccion,
       CAST({TOKENS.format("trim('Artículo ' || CAST(x.i AS VARCHAR) || '. ' || x.line)")} + 2 AS INTEGER) AS n_tokens, CASE WHEN l.quality = 1 THEN 'A1,A2' ELSE '' END AS exams, CASE WHEN l.toxic = 1 THEN 'I' ELSE 'II,V' END AS temas
FROM lines x JOIN l ON l.doc_id = x.doc_id
""")
def ingest_chunks(spark, sf_dir):
    """Chunk records of the documents that have metadata, with their multi-values and tokens."""
    body = _each(lambda x, i, _: F.concat(F.lit("Artículo "), i, F.lit(". "), x))
    docs = _docs(spark, sf_dir).select("doc_id", body.alias("text"))
    chunks = ingest(docs, _metadata(spark, sf_dir), WIDE).chunks
    return chunks.select("doc_id", "doc_name", "section_seq", "part_seq", "tipo_seccion", "seccion", "n_tokens", F.array_join("exams_id", ",").alias("exams"), F.array_join("tema", ",").alias("temas"))


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("doc_id").cast("string")
    return read(spark, sf_dir, "labels").select(own.alias("doc_id"), F.concat(F.lit("Doc "), own).alias("doc_name"), F.lit("").alias("doc_date"), F.lit(None).cast("string").alias("source_url"), F.when(F.col("quality") == 1, "A1|A2").otherwise("").alias("exams_id"), F.when(F.col("toxic") == 1, "I").otherwise("II||V|").alias("tema"))


@query("""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'Doc ' || CAST(doc_id AS VARCHAR) AS doc_name, '' AS doc_date, '' AS source_url, CASE WHEN quality = 1 THEN 'A1|A2' ELSE '' END AS exams_id, CASE WHEN toxic = 1 THEN 'I' ELSE 'II||V|' END AS tema FROM labels
""")
def metadata_csv(spark, sf_dir):
    """Metadata written as CSV and read again: blanks are empty, not null."""
    folder = scratch_dir(spark, "metadata")
    _metadata(spark, sf_dir).withColumn("extra", F.lit(1)).write.option("header", True).option("escape", '"').csv(folder)
    return files.read_metadata(spark, folder)


@query("""
SELECT CAST(item_id AS VARCHAR) AS row_id, 'A' || CAST(1 + item_id % 2 AS VARCHAR) AS exam, CASE WHEN item_id % 5 = 0 THEN 'off_topic' ELSE 'standard' END AS question_type, trim(text, chr(10) || ' ') AS question, 'dijo "sí"' AS ground_truth_answer, '' AS ground_truth_ref, '' AS ground_truth_doc_id FROM benchmark
""")
def dataset_csv(spark, sf_dir):
    """Questions written as CSV (line ends, quotation marks, spaces round values) and read again."""
    folder = scratch_dir(spark, "dataset")
    n = F.col("item_id")
    rows = read(spark, sf_dir, "benchmark").select(
        F.concat(F.lit(" "), n.cast("string")).alias("id"), F.concat(F.lit("A"), (1 + n % 2).cast("string")).alias("exam"), F.when(n % 5 == 0, "off_topic").otherwise(" standard ").alias("question_type"), F.concat(F.lit("\n"), "text", F.lit("  ")).alias("question"),
        F.lit('dijo "sí"').alias("ground_truth_answer"), F.lit("").alias("ground_truth_ref"), F.lit(None).cast("string").alias("ground_truth_doc_id"),
    )
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return files.read_dataset(spark, folder)


@query("SELECT CAST(event_id AS VARCHAR) AS row_id, event_type AS status, CASE WHEN event_id % 3 = 0 THEN -value ELSE value END AS score FROM events WHERE event_id % 7 <> 0")
def artifact_records(spark, sf_dir):
    """Records appended twice and read again: the last one of a key counts; a reset artifact is empty."""
    folder, gone = scratch_dir(spark, "artifact"), scratch_dir(spark, "gone")
    rows = read(spark, sf_dir, "events").where("event_id % 7 <> 0").select(F.col("event_id").cast("string").alias("row_id"), F.col("event_type").alias("status"), F.col("value").alias("score"))
    schema = "row_id string, status string, score double"
    jsonl.append(rows, folder)
    jsonl.append(rows.where("cast(row_id as long) % 3 = 0").withColumn("score", -F.col("score")), folder)
    jsonl.append(rows, gone)
    jsonl.reset(spark, gone)
    return jsonl.load_completed(spark, folder, schema).unionByName(jsonl.load_completed(spark, gone, schema))


@query("""
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id AS n, lang, source, text FROM documents), v AS (
  SELECT doc_id, lang, source, unnest(CASE WHEN n % 10 = 0 THEN ['nuevo'] ELSE [md5(text), lang] END) AS content, unnest(CASE WHEN n % 10 = 0 THEN [0] ELSE [0, 1] END) AS section_seq FROM d
)
SELECT sha256(doc_id || '|' || CAST(section_seq AS VARCHAR) || '|0') AS point_id, doc_id, content, 'Art. ' || CAST(section_seq AS VARCHAR) AS seccion, lang AS exam FROM v WHERE lang IN ('en', 'fr')
""")
def index_upsert(spark, sf_dir):
    """An index written whole, some of its documents replaced, and the points of two exams read from their folders."""
    docs = read(spark, sf_dir, "documents")
    own = F.col("doc_id").cast("string").alias("doc_id")

    def chunks(content: F.Column, rows: DataFrame) -> DataFrame:
        found = rows.select(own, F.posexplode(content).alias("section_seq", "content"), F.array("lang").alias("exams_id"))
        fixed = {"part_seq": F.lit(0), "doc_name": F.lit("d"), "doc_date": F.lit(""), "source_url": F.lit(""), "tema": F.array().cast("array<string>"), "tipo_seccion": F.lit("articulo"), "n_tokens": F.lit(1)}
        return found.withColumns(fixed).withColumn("seccion", F.concat(F.lit("Art. "), F.col("section_seq").cast("string")))

    spec = IndexSpec(scratch_dir(spark, "index"), buckets=4)
    write_index(to_points(chunks(F.array(F.md5(F.col("text").cast("binary")), "lang"), docs)), spec)
    some = docs.where("doc_id % 10 = 0")
    write_index(to_points(chunks(F.array(F.lit("nuevo")), some)), spec, some.select(own))
    found = read_index(spark, spec, ("en", "fr"))
    return found.select("point_id", "doc_id", "content", "metadata.seccion", F.element_at("metadata.exams_id", 1).alias("exam"))


@query("SELECT 'Art. ' || CAST(i AS VARCHAR) AS seccion, 'articulo' AS tipo_seccion FROM (SELECT unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents WHERE doc_id = 5)")
def index_scroll(spark, sf_dir):
    """The sections of one document of an index."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode("lines").alias("i", "content"))
    fixed = {c: F.lit("") for c in ("doc_name", "doc_date", "source_url")} | {c: F.array().cast("array<string>") for c in ("exams_id", "tema")}
    chunks = lines.withColumns(fixed).select("*", F.col("i").alias("section_seq"), F.lit(0).alias("part_seq"), F.lit("articulo").alias("tipo_seccion"), F.concat(F.lit("Art. "), (F.col("i") + 1).cast("string")).alias("seccion"))
    spec = IndexSpec(scratch_dir(spark, "index"), buckets=8)
    write_index(to_points(chunks), spec)
    return scroll_sections(read_index(spark, spec), "5")


@query("""
SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN 'x TEXTO CONSOLIDADO y' || chr(10) || text WHEN doc_id % 3 = 1 THEN 'TEXTO CONSOLIDADO' || chr(10) || text || chr(10) || 'TEXTO CONSOLIDADO' ELSE text END) AS text_md5 FROM documents
""")
def consolidated_texts(spark, sf_dir):
    """What stands before the line of the consolidated text goes if there is one such line."""
    mark, n = F.lit("TEXTO CONSOLIDADO"), F.col("doc_id") % 3
    text = F.when(n == 0, F.concat(F.lit("antes\nx "), mark, F.lit(" y\n"), "text")).when(n == 1, F.concat(mark, F.lit("\n"), "text", F.lit("\n"), mark)).otherwise(F.col("text"))
    return read(spark, sf_dir, "documents").withColumn("text", text).select("doc_id", F.md5(files.consolidated(F.col("text")).cast("binary")).alias("text_md5"))


@query("""
WITH e AS (SELECT *, CASE event_type WHEN 'view' THEN 'heading' WHEN 'click' THEN 'quote' ELSE 'ordinal' END AS kind, CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 2 = 0 THEN '«' ELSE '»' END ELSE CAST(event_id AS VARCHAR) END AS heading FROM events),
w AS (SELECT *, last_value(CASE WHEN kind = 'quote' THEN heading END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM e)
SELECT user_id, event_id AS start, kind, heading FROM w WHERE kind <> 'quote' AND NOT (kind = 'heading' AND coalesce(q, '') = '«')
""")
def open_quotes(spark, sf_dir):
    """A user's events as marks: headings behind an opening quotation mark are dropped."""
    kind = F.when(F.col("event_type") == "view", "heading").when(F.col("event_type") == "click", "quote").otherwise("ordinal")
    name = F.when(F.col("event_type") == "click", F.when(F.col("event_id") % 2 == 0, "«").otherwise("»")).otherwise(F.col("event_id").cast("string"))
    return drop_citations(read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("start"), kind.alias("kind"), name.alias("heading")), ("user_id",))


@query("""
SELECT event_id, CASE WHEN exam = 'A1' AND tema IS NOT NULL AND tema <> 'TODOS' THEN tema ELSE '' END AS temas
FROM (SELECT event_id, CASE WHEN event_type = 'view' THEN 'A1' ELSE 'C1' END AS exam, CASE event_id % 4 WHEN 0 THEN 'TODOS' WHEN 1 THEN 'II' WHEN 2 THEN NULL ELSE 'V' END AS tema FROM events)
""")
def settings_filters(spark, sf_dir):
    """What a choice of exam and tema in the settings means for the filter."""
    n = F.col("event_id") % 4
    rows = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", "A1").otherwise("C1").alias("exam"), F.when(n == 0, "TODOS").when(n == 1, "II").when(n == 3, "V").alias("tema"))
    return rows.select("event_id", F.array_join(R.settings_temas(F.col("exam"), F.col("tema")), ",").alias("temas"))


@query("""
SELECT l.doc_id AS query_id, CAST(1 AS INTEGER) AS rank, CAST(d.doc_id AS VARCHAR) AS point_id, d.lang AS content, CASE WHEN l.quality = 1 THEN d.source ELSE '' END AS temas, '' AS exams, CASE WHEN l.toxic = 1 THEN 'articulo' ELSE 'none' END AS tipo_seccion, CAST(l.quality AS DOUBLE) AS retrieval_score
FROM labels l JOIN documents d ON d.doc_id = l.doc_id
""")
def result_mapping(spark, sf_dir):
    """Results with their payload: missing lists are empty, a missing type of section is none."""
    labels = read(spark, sf_dir, "labels")
    docs = read(spark, sf_dir, "documents").join(labels, "doc_id")
    none = F.lit(None).cast("string")
    meta = F.struct(
        F.col("doc_id").cast("string").alias("doc_id"), none.alias("doc_name"), none.alias("doc_date"), none.alias("source_url"), F.lit(None).cast("array<string>").alias("exams_id"), F.when(F.col("quality") == 1, F.array("source")).alias("tema"),
        F.when(F.col("toxic") == 1, "articulo").alias("tipo_seccion"), none.alias("seccion"),
    )
    points = docs.select(F.col("doc_id").alias("point_id"), F.col("lang").alias("content"), meta.alias("metadata"))
    ranked = labels.select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("point_id"), F.lit(1).alias("rank"), F.col("quality").cast("double").alias("score"))
    found = R.to_result(ranked, points)
    return found.select("query_id", "rank", "point_id", "content", F.array_join("metadata.tema", ",").alias("temas"), F.array_join("metadata.exams_id", ",").alias("exams"), "metadata.tipo_seccion", "retrieval_score")


@query("SELECT l.doc_id AS row_id, l.quality, d.lang FROM labels l JOIN documents d ON d.doc_id = l.doc_id")
def required_results(spark, sf_dir):
    """Labels with the result that each of them must have."""
    rows = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), "quality")
    return M.require_all(rows, read(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "lang"))


RESULTS_CTE = """
r AS (SELECT source AS query_id, doc_id, lang, text, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS rank FROM documents),
c AS (SELECT *, CAST(ceil(length(text) / CAST(3 AS DOUBLE)) AS BIGINT) AS n FROM r),
s AS (SELECT *, sum(n) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS upto FROM c),
k AS (SELECT *, rank = 1 OR upto <= 3000 AS kept FROM s)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each source as results in the order of ids."""
    from pyspark.sql import Window

    own = F.col("doc_id").cast("string")
    meta = F.struct(own.alias("doc_id"), F.col("source").alias("doc_name"), F.lit("").alias("doc_date"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("http://x/"), own)).otherwise("").alias("source_url"), F.col("lang").alias("seccion"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return read(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), rank.alias("rank"), own.alias("point_id"), F.col("text").alias("content"), meta.alias("metadata"))


@query(f"WITH {RESULTS_CTE} SELECT query_id, rank, CAST(doc_id AS VARCHAR) AS point_id, kept FROM k")
def kept_marks(spark, sf_dir):
    """All results, with whether they went into the context."""
    found = _results(spark, sf_dir)
    return mark_kept(found, within_budget(found, ContextSpec())).select("query_id", "rank", "point_id", "kept")


@query(f"""
WITH {RESULTS_CTE}, a AS (
  SELECT query_id, md5(string_agg('[' || CAST(rank AS VARCHAR) || '] ' || query_id || ' — ' || lang || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS blocks_md5, CAST(sum(n) AS BIGINT) AS n_tokens_estimate,
         string_agg('[' || CAST(rank AS VARCHAR) || '] ' || CASE WHEN doc_id % 2 = 0 THEN '[' || query_id || ' — ' || lang || '](http://x/' || CAST(doc_id AS VARCHAR) || ')' ELSE query_id || ' — ' || lang END, chr(10) ORDER BY rank) AS sources
  FROM k WHERE kept GROUP BY query_id
)
SELECT * FROM a UNION ALL SELECT 'none', md5(''), CAST(0 AS BIGINT), ''
""")
def context_sources(spark, sf_dir):
    """Rendered contexts and their lists of sources, and an empty context for a question without results."""
    found = _results(spark, sf_dir)
    asked = found.select("query_id").distinct().unionByName(spark.createDataFrame([("none",)], "query_id string"))
    done = render(within_budget(found, ContextSpec()), asked)
    return done.select("query_id", F.md5(F.col("blocks").cast("binary")).alias("blocks_md5"), "n_tokens_estimate", render_sources(F.col("sources")).alias("sources"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '[' || l || '](http://' || lang || ')' ELSE l END AS label
FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 5 = 0 THEN source ELSE source || ' — ' || lang END ELSE CASE WHEN doc_id % 5 = 0 THEN CAST(doc_id AS VARCHAR) ELSE lang END END AS l FROM documents)
""")
def source_labels(spark, sf_dir):
    """Names of sources: heading, or the id where there is none; a link where there is a URL."""
    n = F.col("doc_id")
    label = source_label(F.when(n % 2 == 0, F.col("source")), F.when(n % 5 == 0, "").otherwise(F.col("lang")), n.cast("string"), F.when(n % 3 == 0, F.concat(F.lit("http://"), "lang")))
    return read(spark, sf_dir, "documents").select("doc_id", label.alias("label"))


@query("""
SELECT event_type, count(*) AS n, round(avg(value) / 1000, 9) AS avg_s, round(max(value) / 1000, 9) AS max_s FROM events WHERE event_id % 10 <> 0 AND event_type = 'view' GROUP BY event_type
""")
def latency_summary(spark, sf_dir):
    """Mean and greatest seconds of the rows that have a duration."""
    rows = read(spark, sf_dir, "events").where("event_type = 'view'").withColumn("duration_ms", F.when(F.col("event_id") % 10 != 0, F.col("value")))
    return M.latency(rows).select(F.lit("view").alias("event_type"), "n", F.round("avg_s", 9).alias("avg_s"), F.round("max_s", 9).alias("max_s"))


@query("SELECT DISTINCT event_type FROM events")
def distinct_types(spark, sf_dir):
    return M.distinct_sorted(read(spark, sf_dir, "events"), "event_type")


@query("""
WITH g AS (SELECT event_id, event_type, unnest([1, 2, 3, 4, 5, 10, 20]) AS k, event_id % 23 + 1 AS p, value FROM events), r AS (SELECT *, CASE WHEN p <= k THEN p END AS rank FROM g)
SELECT CAST(event_id AS VARCHAR) AS row_id, event_type AS question_type, CAST(k AS INTEGER) AS k, CAST(rank AS INTEGER) AS rank, round(avg(value * k) OVER (PARTITION BY event_id), 6) AS retrieve_ms FROM r
""")
def rank_artifacts(spark, sf_dir):
    """Ranks at all depths as records of one row each, with the mean time of its searches, and back."""
    grid = F.explode(F.array(*[F.lit(k) for k in EvalSpec().k_grid])).alias("k")
    rows = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("row_id"), "event_type", (F.col("event_id") % 23 + 1).alias("p"), "value", grid)
    ranks = rows.select("row_id", "k", F.when(F.col("p") <= F.col("k"), F.col("p")).alias("rank"), (F.col("value") * F.col("k")).alias("ms"))
    records = M.rank_records(ranks).join(rows.select("row_id", F.col("event_type").alias("question_type")).distinct(), "row_id")
    return M.ranks_of(records).join(records.select("row_id", F.round("retrieve_ms", 6).alias("retrieve_ms")), "row_id")


@query("""
SELECT CAST(item_id AS VARCHAR) AS row_id, CASE WHEN contains(lower(text), 'the') OR contains(lower(text), 'der') THEN 'RELEVANT' ELSE 'OFF_TOPIC' END AS verdict, item_id % 5 = 0 AS actual_off_topic,
       md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS condensed_md5, text <> trim(regexp_replace(text, '\\s+', ' ', 'g')) AS edited FROM benchmark
""")
def query_records(spark, sf_dir):
    """Records of the query processing: verdict, condensed question, and whether it was edited."""
    rows = read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("row_id"), F.lit("A1").alias("exam"), F.when(F.col("item_id") % 5 == 0, "off_topic").otherwise("standard").alias("question_type"), F.col("text").alias("question"))
    from .plans.answer import Components

    found = evaluate_queries(rows, Components(query_model=KeywordQueryModel(("the", "der"))))
    return found.select("row_id", "verdict", "actual_off_topic", F.md5(F.col("condensed_query").cast("binary")).alias("condensed_md5"), "edited")


@query(f"""
SELECT item_id, md5('{SYSTEM_PROMPT}' || chr(10) || chr(10) || CASE WHEN item_id % 2 = 0 THEN 'Usuario: hola' || chr(10) || chr(10) ELSE '' END || '{CONTEXT_MARK.strip()}' || chr(10) || '[1] x' || chr(10) || chr(10) || 'Pregunta: ' || text) AS prompt_md5 FROM benchmark
""")
def prompts(spark, sf_dir):
    """What the generator is asked: rules, the last turns if there are any, context and question."""
    history = F.when(F.col("item_id") % 2 == 0, "Usuario: hola").otherwise("")
    return read(spark, sf_dir, "benchmark").select("item_id", F.md5(prompt(F.lit("[1] x"), F.col("text"), history).cast("binary")).alias("prompt_md5"))


@query(r"""
WITH f AS (SELECT item_id AS query_id, regexp_extract_all(text, '[^\s]*\s|[^\s]+$') AS f FROM benchmark)
SELECT query_id, CAST(i - 1 AS INTEGER) AS seq, list_extract(f, i) AS fragment FROM (SELECT query_id, f, unnest(generate_series(1, least(len(f), 12))) AS i FROM f)
""")
def answer_fragments(spark, sf_dir):
    """The first fragments of each answer, a row each, as they come."""
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("Contexto:\n"), "text").alias("prompt"))
    return stream_fragments(asked, ExtractiveGenerator(), GenerationConfig(max_tokens=12)).select("query_id", "seq", "fragment")


@query(r"""
WITH w AS (
  SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS a, list_distinct(regexp_extract_all(lower(left(text, 60)), '[\p{L}\p{N}_]+')) AS r FROM benchmark
), s AS (
  SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'NO_CONTEXT' ELSE 'OK' END AS status, CASE WHEN len(a) = 0 THEN 0 ELSE CAST(round_even(3.0 * len(list_intersect(a, r)) / len(a), 0) AS INTEGER) END AS c, CASE WHEN len(r) = 0 THEN 0 ELSE CAST(round_even(3.0 * len(list_intersect(a, r)) / len(r), 0) AS INTEGER) END AS f FROM w
)
SELECT item_id, status, CAST(CASE WHEN status = 'OK' THEN c ELSE 0 END AS INTEGER) AS correctness, CAST(CASE WHEN status = 'OK' THEN f ELSE 0 END AS INTEGER) AS faithfulness, CASE WHEN status <> 'OK' THEN 'status=' || status END AS zeroed_reason FROM s
""")
def judged_answers(spark, sf_dir):
    """Answers (the beginnings of passages) scored against passages, each score by itself; rows without an answer are zero with a reason."""
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 4 == 0, "NO_CONTEXT").otherwise("OK").alias("status"), F.lit("q").alias("question"), F.col("text").alias("ground_truth_answer"), F.substring("text", 1, 60).alias("answer"), F.col("text").alias("context"))
    return judge_rows(rows, OverlapJudge()).select("item_id", "status", "correctness", "faithfulness", "zeroed_reason")


@query("""
WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n, count(*) OVER (PARTITION BY conv_id) AS k FROM conversations)
SELECT conv_id, string_agg(role || ':' || text, chr(10) ORDER BY turn) FILTER (n <= 4) || CASE WHEN conv_id % 2 = 0 THEN chr(10) || 'user:q' || chr(10) || 'assistant:a' ELSE '' END AS history, CAST(least(any_value(k), 4) + CASE WHEN conv_id % 2 = 0 THEN 2 ELSE 0 END AS INTEGER) AS n FROM t GROUP BY conv_id
""")
def next_histories(spark, sf_dir):
    """The last turns of a chat, and question and answer behind them if there was an answer."""
    turn = F.struct("turn", "role", F.col("text").alias("content"))
    chats = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("h"))
    history = F.transform("h", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    done = chats.select("conv_id", next_history(tail_array(history, 4), F.lit("q"), F.when(F.col("conv_id") % 2 == 0, "a").otherwise("")).alias("h"))
    return done.select("conv_id", F.array_join(F.transform("h", lambda t: F.concat_ws(":", t["role"], t["content"])), "\n").alias("history"), F.size("h").alias("n"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a stream of messages with answers."""
    # a pattern as the path: the table may be one file or a folder of parts, and a stream takes no path of a single file
    stream = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(f"{sf_dir}/conversations.parque[t]")
    answered = F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text"))
    return stream.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), F.when(F.col("turn") < 4, "A1").otherwise("C1").alias("exam"), F.col("text").alias("query"), answered.alias("answer"))


@query("""
WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, CASE WHEN turn < 4 THEN 'A1' ELSE 'C1' END AS exam, CASE WHEN turn % 3 = 0 THEN '' ELSE text END AS answer FROM conversations)
SELECT session_id, seq, exam, CAST(least(6, 2 * count(*) FILTER (answer <> '') OVER (PARTITION BY session_id, exam ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS INTEGER) AS history_len FROM t
""")
def session_stream(spark, sf_dir):
    """A stream of chat messages with state: the length of the history that each message is asked with."""
    out = scratch_dir(spark, "sessions")
    run = session_turns(_turns(spark, sf_dir)).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", scratch_dir(spark, "checkpoint")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(OUT).parquet(out).select("session_id", "seq", "exam", "history_len")


@query("""
WITH t AS (
  SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, CASE WHEN turn < 4 THEN 'A1' ELSE 'C1' END AS exam, CASE WHEN turn % 3 = 0 THEN '' ELSE text END AS answer, turn * 10 + (turn // 3) * 60 AS minute FROM conversations
), marked AS (
  SELECT *, CASE WHEN lag(exam) OVER w <> exam OR minute - lag(minute) OVER w >= 60 THEN 1 ELSE 0 END AS fresh FROM t WINDOW w AS (PARTITION BY session_id ORDER BY seq)
), s AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY seq) AS part FROM marked)
SELECT session_id, seq, exam, CAST(least(6, 2 * count(*) FILTER (answer <> '') OVER (PARTITION BY session_id, part ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS INTEGER) AS history_len FROM s
""")
def session_expiry(spark, sf_dir):
    """The same stream with times: a message that comes an hour or more after the one before finds no history."""
    out = scratch_dir(spark, "expiry")
    minute = F.col("seq") * 10 + F.floor(F.col("seq") / 3) * 60
    timed = _turns(spark, sf_dir).withColumn("ts", F.timestamp_seconds(1_704_067_200 + minute * 60))
    run = session_turns(timed, time="ts", idle_ms=3_600_000).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", scratch_dir(spark, "checkpoint")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(OUT).parquet(out).select("session_id", "seq", "exam", "history_len")


@query("SELECT CAST(conv_id AS VARCHAR) AS row_id, turn AS seq, md5(text) AS text_md5 FROM conversations")
def streamed_artifacts(spark, sf_dir):
    """Records that a stream appends to an artifact, each of them once."""
    out = scratch_dir(spark, "records")
    rows = _turns(spark, sf_dir).select(F.col("session_id").alias("row_id"), "seq", F.md5(F.col("query").cast("binary")).alias("text_md5"))
    artifact_sink(rows, out, scratch_dir(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("row_id string, seq long, text_md5 string").json(out)
