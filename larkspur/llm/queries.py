"""The thin queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import encode_documents

    return encode_documents(read(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, ids=False)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicate_classes

    return near_duplicate_classes(read(spark, sf_dir, "documents"), Fraction(3, 4), 5)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup_passages

    return dedup_passages(read(spark, sf_dir, "documents").select("doc_id", "text"), 50)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import fit_quality, score_quality, with_fold

    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(documents, fit_quality(documents, read(spark, sf_dir, "labels")))
    return with_fold(scored).select("doc_id", "held_out", "score", "predicted")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_pages

    return extract_pages(read(spark, sf_dir, "pages"))


#: Weights of nodes (all others 1) and the share of the tokens that op6_source_mixing gives out.
OP6_WEIGHTS = {("d0",): 4, ("d1",): 3, ("d3",): 2, ("d0", "en"): 3, ("d0", "de"): 2, ("d1", "fr"): 5, ("d2", "es"): 2, ("d0", "en", "src0"): 2, ("d1", "en", "src1"): 3, ("d3", "de", "src7"): 4}
OP6_SHARE = (3, 4)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three quarters of the tokens by weights at all three levels; what a small source lacks goes to its siblings first."""
    from .mixing import Mix, mix_sources

    return mix_sources(read(spark, sf_dir, "documents"), Mix(weights=OP6_WEIGHTS, share=OP6_SHARE)).select("doc_id", "domain", "lang", "source", "epoch", "n_tokens")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(read(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_topk import exact_topk

    return exact_topk(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, score_toxicity, with_fold

    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(documents, fit_toxicity(documents, read(spark, sf_dir, "labels")))
    return with_fold(scored).select("doc_id", "held_out", "score", "predicted")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine_hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(read(spark, sf_dir, "embeddings"), count=32, scale=64, offset=1_000_000)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens

    return count_tokens(read(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")))


QUERIES: dict[str, Query] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_html_extraction": op5_html_extraction,
    "op6_source_mixing": op6_source_mixing,
    "op7_quality_rules": op7_quality_rules,
    "op8_exact_topk": op8_exact_topk,
    "op9_toxicity": op9_toxicity,
    "op10_license_scan": op10_license_scan,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_whitening": op12_whitening,
    "op13_token_counts": op13_token_counts,
}

OP8_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP11_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable a JOIN usable c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v)
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM scored WHERE same) WHERE place <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
         s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""


def _level(n: int, parent: str, parent_keys: list[str], key: str) -> str:
    """SQL of one level of budgets: nodes{n}, level{n}, first{n} and given{n}."""
    keys = [*parent_keys, key]
    cols, part = ", ".join(keys), f"PARTITION BY {', '.join(parent_keys)}" if parent_keys else ""
    grant = f"JOIN {parent} p USING ({', '.join(parent_keys)})" if parent_keys else f"CROSS JOIN {parent} p"
    match = " AND ".join(f"l.{k} = f.{k}" for k in parent_keys) or "TRUE"
    groups = f"GROUP BY {', '.join(parent_keys)}" if parent_keys else ""
    weights = "".join(f" WHEN {' AND '.join(f"{k} = '{v}'" for k, v in zip(keys, path, strict=True))} THEN {w}" for path, w in OP6_WEIGHTS.items() if len(path) == n)
    weight = f"CAST(CASE{weights} ELSE 1 END AS DOUBLE)" if weights else "CAST(1 AS DOUBLE)"
    return f"""
nodes{n} AS (
  SELECT {cols}, cap, {weight} AS w, CAST(p.given AS DOUBLE) AS granted FROM (SELECT {cols}, CAST(sum(cap) AS BIGINT) AS cap FROM leaves GROUP BY {cols}) {grant}
), level{n} AS (
  SELECT *, row_number() OVER ({part} ORDER BY cap / w, {key}) AS place,
    (granted - coalesce(sum(cap) OVER ({part} ORDER BY cap / w, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER ({part} ORDER BY cap / w, {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM nodes{n}
), first{n} AS (
  SELECT {', '.join([*parent_keys, 'arg_min(level, place) AS level'])} FROM level{n} WHERE cap / w > level {groups}
), given{n} AS (
  SELECT {', '.join('l.' + k for k in keys)}, CAST(CASE WHEN f.level IS NULL OR l.cap / l.w <= f.level THEN l.cap ELSE floor(l.w * f.level) END AS BIGINT) AS given FROM level{n} l LEFT JOIN first{n} f ON {match}
)"""


OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce('d' || CAST(CAST(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS BIGINT) % 4 AS VARCHAR), 'other') AS domain, coalesce(lang, '?') AS l, coalesce(source, '?') AS s,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n
  FROM documents
), leaves AS (
  SELECT domain, l, s, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(n) * 2 AS BIGINT) AS cap FROM d GROUP BY domain, l, s
), total AS (
  SELECT CAST(sum(tokens) * {OP6_SHARE[0]} // {OP6_SHARE[1]} AS BIGINT) AS given FROM leaves
), {_level(1, "total", [], "domain")}, {_level(2, "given1", ["domain"], "l")}, {_level(3, "given2", ["domain", "l"], "s")}, shares AS (
  SELECT domain, l, s, CAST(CASE WHEN tokens > 0 THEN floor(CAST(given AS DOUBLE) / tokens) ELSE 1 END AS BIGINT) AS whole, given, tokens FROM leaves JOIN given3 USING (domain, l, s)
), ordered AS (
  SELECT d.*, whole, CASE WHEN tokens > 0 THEN given - whole * tokens ELSE 0 END AS rest, md5('mix:' || CAST(whole AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM d JOIN shares USING (domain, l, s)
), running AS (
  SELECT *, sum(n) OVER (PARTITION BY domain, l, s ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM ordered
), chosen AS (
  SELECT *, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS epochs FROM running
)
SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, n AS n_tokens FROM (SELECT *, unnest(generate_series(0, epochs - 1)) AS epoch FROM chosen WHERE epochs > 0)
"""



def _rules_sql() -> str:
    from .quality_rules import COMMON, Rules

    rules = Rules()
    vocabulary = ", ".join(f"'{w}'" for w in sorted({w for words in COMMON.values() for w in words.split()}))
    langs = ", ".join(f"'{x}'" for x in COMMON)
    term = "CASE WHEN p > 0 THEN 0.5 * p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(2 * q / (p + q)) ELSE 0 END"
    drop = lambda signs: f"regexp_replace(t, '[{signs}]', '', 'g')"
    counts = {"lower": "a-z", "space": r"\x20\x09-\x0D", "upper": "A-Z", "digit": "0-9", "stop": r".,;:!?()\-\"\x27", "symbol": "#*$%&|<>"}
    classes = ", ".join(f"length(t) - length({drop(x)}) AS {name}" for name, x in counts.items())
    cells = "SELECT r, lang, unnest(['" + "', '".join([*counts, "other"]) + "']) AS c, unnest([" + ", ".join([*counts, "other"]) + "]) AS n FROM (SELECT *, total - " + " - ".join(counts) + " AS other FROM counted)"
    return rf"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, lang, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, lang, list_filter(string_split_regex(t, '[ 	-
]+'), lambda x: x <> '') AS w FROM d
), words AS (
  SELECT r, lang, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM w
), sizes AS (
  SELECT r, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars FROM words GROUP BY r
), windows AS (
  SELECT r, i, word AS a, lead(word, 1) OVER (PARTITION BY r ORDER BY i) AS b, lead(word, 2) OVER (PARTITION BY r ORDER BY i) AS c FROM words
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS k FROM windows WHERE c IS NOT NULL) WHERE k > 1
), covered AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r
), lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ 	-
]') GROUP BY r
), counted AS (
  SELECT r, lang, length(t) AS total, {classes} FROM d
), cells AS (
  {cells}
), char_ref AS (
  SELECT lang AS g, c, CAST(sum(n) AS DOUBLE) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM cells WHERE lang IN ({langs}) GROUP BY lang, c
), char_terms AS (
  SELECT x.r, f.g, f.q, CAST(x.n AS DOUBLE) / nullif(t.total, 0) AS p FROM cells x JOIN counted t ON t.r = x.r JOIN char_ref f ON f.c = x.c
), char_distance AS (
  SELECT r, min(v) AS char_distance FROM (SELECT r, g, sqrt(greatest(sum({term}), 0)) AS v FROM char_terms WHERE p IS NOT NULL GROUP BY r, g) GROUP BY r
), runs AS (
  SELECT r, lang, unnest(list_filter(string_split_regex(lower(t), '[^\p{{L}}]+'), lambda x: x <> '')) AS word FROM d
), common AS (
  SELECT r, lang, CASE WHEN word IN ({vocabulary}) THEN word ELSE '' END AS word, count(*) AS n FROM runs GROUP BY 1, 2, 3
), common_sizes AS (
  SELECT r, CAST(sum(n) AS BIGINT) AS n_common FROM common GROUP BY r
), word_ref AS (
  SELECT lang AS g, word, CAST(sum(n) AS DOUBLE) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM common WHERE lang IN ({langs}) GROUP BY lang, word
), word_terms AS (
  SELECT x.r, g.g, coalesce(f.q, 0) AS q, CAST(x.n AS DOUBLE) / s.n_common AS p
  FROM common x JOIN common_sizes s ON s.r = x.r CROSS JOIN (SELECT DISTINCT g FROM word_ref) g LEFT JOIN word_ref f ON f.g = g.g AND f.word = x.word
), word_distance AS (
  SELECT r, min(v) AS word_distance FROM (SELECT r, g, sqrt(greatest(0.5 + sum({term} - 0.5 * q), 0)) AS v FROM word_terms GROUP BY r, g) GROUP BY r
), base AS (
  SELECT d.r, d.doc_id, coalesce(s.n_words, 0) AS n_words, coalesce(s.word_chars, 0) AS word_chars, CAST(c.symbol AS BIGINT) AS n_symbols, coalesce(l.n_dup_lines, 0) AS n_dup_lines, coalesce(v.n_repeat_words, 0) AS n_repeat_words,
         coalesce(k.char_distance, 0) AS char_distance, coalesce(x.word_distance, 1) AS word_distance
  FROM d JOIN counted c USING (r) LEFT JOIN sizes s USING (r) LEFT JOIN lines l USING (r) LEFT JOIN covered v USING (r) LEFT JOIN char_distance k USING (r) LEFT JOIN word_distance x USING (r)
), judged AS (
  SELECT *, n_words < {rules.least_words} OR 100 * n_repeat_words > {rules.repeat_percent} * n_words AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (n_words < {rules.char_words} OR char_distance <= {rules.char_distance}) AND (n_words < {rules.word_words} OR word_distance <= {rules.word_distance}) AS kept
FROM judged
"""


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS shingle FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c >= 75 * (s.n + t.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id FROM d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON r.x = d.doc_id
"""

ORACLE: dict[str, str] = {"op2_ngram_jaccard_join": OP2_SQL, "op7_quality_rules": _rules_sql(), "op6_source_mixing": OP6_SQL, "op8_exact_topk": OP8_SQL, "op11_hard_negatives": OP11_SQL}
