"""Evaluation: ground truth, ranks, hit rates, confusion, scores and latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EvalSpec
from ..functions.text import normalize_ref, or_else


def graded(rows: DataFrame, spec: EvalSpec | None = None) -> DataFrame:
    return rows.where(F.col("question_type") != (spec or EvalSpec()).off_topic)


def with_reference(chunks: DataFrame) -> DataFrame:
    """ref: the normalised section, or the section type where there is none."""
    return chunks.withColumn("ref", normalize_ref(or_else(F.col("seccion"), F.col("tipo_seccion"))))


def require_all(rows: DataFrame, results: DataFrame, key: str = "row_id") -> DataFrame:
    """Inner join on key; rows without a result raise, with their number and the first five."""
    missing = rows.join(results, key, "left_anti").select(key)
    first = [r[0] for r in missing.orderBy(key).limit(5).collect()]
    if first:
        raise ValueError(f"{missing.count()} rows without a result, e.g. {first}")
    return rows.join(results, key)


def ground_truth_failures(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Graded rows whose expected section is empty or not in the index: row_id and reason."""
    known = with_reference(chunks).select(F.col("doc_id").alias("ground_truth_doc_id"), "ref").distinct()
    asked = graded(rows).withColumn("ref", normalize_ref(F.col("ground_truth_ref")))
    empty = F.coalesce((F.col("ground_truth_doc_id") == "") | (F.col("ref") == ""), F.lit(True))
    nothing = asked.where(empty).select("row_id", F.lit("empty").alias("reason"))
    absent = asked.where(~empty).join(known, ["ground_truth_doc_id", "ref"], "left_anti").select("row_id", F.lit("not indexed").alias("reason"))
    return nothing.unionByName(absent)


def ground_truth_ranks(rows: DataFrame, results: DataFrame) -> DataFrame:
    """rows: row_id, k, doc_id, ref expected.  results: row_id, k, rank, doc_id, ref.  The first matching rank per (row, k), or null."""
    hits = results.join(rows.select("row_id", "k", "doc_id", "ref"), ["row_id", "k", "doc_id", "ref"]).groupBy("row_id", "k").agg(F.min("rank").alias("rank"))
    return rows.select("row_id", "k", *[c for c in ("question_type",) if c in rows.columns]).join(hits, ["row_id", "k"], "left")


def hit_rates(ranks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of rows with a rank within k; a null rank is a miss."""
    return ranks.groupBy("k", *by).agg(F.avg(F.coalesce((F.col("rank") <= F.col("k")).cast("double"), F.lit(0.0))).alias("hit_rate"), F.count("*").alias("n"))


def hit_rate_sets(ranks: DataFrame) -> DataFrame:
    """Hit rates by k, and by question type and k, in one pass; question_type is "all" for the first."""
    rate = F.avg(F.coalesce((F.col("rank") <= F.col("k")).cast("double"), F.lit(0.0)))
    sets = ranks.groupingSets([["k"], ["question_type", "k"]], "k", "question_type").agg(rate.alias("hit_rate"), F.count("*").alias("n"), F.grouping("question_type").alias("g"))
    return sets.select("k", F.when(F.col("g") == 1, "all").otherwise(F.col("question_type")).alias("question_type"), "hit_rate", "n")


def confusion(rows: DataFrame, actual: str = "actual_off_topic", verdict: str = "verdict") -> DataFrame:
    """One row: tp, fp, fn, tn, n_unknown and precision, recall, f1, accuracy; off-topic is positive, an unknown verdict isn't."""
    said, is_so = F.coalesce(F.col(verdict) == "OFF_TOPIC", F.lit(False)), F.coalesce(F.col(actual), F.lit(False))
    counts = rows.agg(
        F.count_if(said & is_so).alias("tp"), F.count_if(said & ~is_so).alias("fp"), F.count_if(~said & is_so).alias("fn"), F.count_if(~said & ~is_so).alias("tn"), F.count_if(F.col(verdict) == "UNKNOWN").alias("n_unknown")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    scored = counts.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    return scored.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("accuracy", ratio(tp + tn, tp + fp + fn + tn))


def score_summary(records: DataFrame, spec: EvalSpec | None = None) -> DataFrame:
    """n, n_zeroed, means of both scores and their shares of the greatest score; rows put to zero stay in."""
    most = float((spec or EvalSpec()).max_score)
    zeroed = F.coalesce("zeroed_reason", F.lit("")) != ""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return records.agg(F.count("*").alias("n"), F.count_if(zeroed).alias("n_zeroed"), mean("correctness").alias("correctness"), mean("faithfulness").alias("faithfulness")).withColumn("correctness_share", F.col("correctness") / most).withColumn("faithfulness_share", F.col("faithfulness") / most)


def score_breakdown(records: DataFrame, score: str, spec: EvalSpec | None = None) -> DataFrame:
    """Per question type and in all: n, n_zeroed, mean and the histogram from 0 to the greatest score; row_order puts the total last."""
    most = (spec or EvalSpec()).max_score
    zeroed = F.coalesce("zeroed_reason", F.lit("")) != ""
    bins = [F.count_if(F.col(score) == i).alias(f"score_{i}") for i in range(most + 1)]
    rolled = records.rollup("question_type").agg(F.count("*").alias("n"), F.count_if(zeroed).alias("n_zeroed"), F.avg(score).alias("mean"), *bins, F.grouping("question_type").alias("g"))
    label = F.when(F.col("g") == 1, "total").otherwise(F.concat(F.lit("question_type="), F.coalesce("question_type", F.lit(""))))
    return rolled.select(label.alias("label"), "n", "n_zeroed", "mean", *[f"score_{i}" for i in range(most + 1)], F.col("g").cast("int").alias("row_order"))


def latency(rows: DataFrame, ms: str = "duration_ms") -> DataFrame:
    """n, mean and greatest seconds."""
    return rows.where(F.col(ms).isNotNull()).agg(F.count("*").alias("n"), (F.avg(ms) / 1000).alias("avg_s"), (F.max(ms) / 1000).alias("max_s"))


def stage_latencies(records: DataFrame, spec: EvalSpec | None = None) -> DataFrame:
    """Per stage, over the rows that have it, in the fixed order of the stages."""
    stages = (spec or EvalSpec()).stages
    rows = records.select(F.explode("durations_ms").alias("stage", "ms")).where(F.col("stage").isin(*stages) & F.col("ms").isNotNull())
    order = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("stage"))
    return rows.groupBy("stage").agg(F.count("*").alias("n"), (F.avg("ms") / 1000).alias("avg_s"), (F.max("ms") / 1000).alias("max_s")).withColumn("stage_order", order.cast("int"))


def pivot_counts(rows: DataFrame, index: str, columns: str, values: list[str]) -> DataFrame:
    """Counts by index and value, zero where there is none; values are given, so that no extra job looks for them."""
    return rows.groupBy(index).pivot(columns, sorted(values)).count().na.fill(0)


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def distinct_sorted(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).distinct().orderBy(column)


def display_round(x: float, digits: int = 2) -> float:
    """Rounding for show, half to even on the exact binary value; values are compared unrounded."""
    return round(x, digits)


def rank_records(ranks: DataFrame) -> DataFrame:
    """ranks: row_id, k, rank (null for a miss), ms of each search.  row_id, ranks (map by k as text) and the mean retrieve_ms."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("k").cast("string").alias("k"), F.col("rank").cast("int").alias("rank")))))
    return ranks.groupBy("row_id").agg(pairs.alias("ranks"), F.avg("ms").alias("retrieve_ms"))


def ranks_of(records: DataFrame) -> DataFrame:
    """The rows of rank_records again: row_id, question_type, k, rank."""
    return records.select("row_id", "question_type", F.explode("ranks").alias("k", "rank")).withColumn("k", F.col("k").cast("int"))
