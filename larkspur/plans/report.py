"""The evaluation report: small aggregate tables as Markdown.  Own wording."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EvalSpec
from ..operators import metrics as M


def table(head: list[str], rows: list[list]) -> str:
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return "\n".join(lines + ["| " + " | ".join("" if x is None else str(x) for x in row) + " |" for row in rows])


def show(x: float | None, digits: int = 2) -> str:
    return "" if x is None else f"{M.display_round(x, digits):.{digits}f}"


def dataset_section(rows: DataFrame) -> str:
    kinds = [r[0] for r in M.distinct_sorted(rows, "question_type").collect()]
    if not kinds:
        return ""
    found = M.pivot_counts(rows, "exam", "question_type", kinds).orderBy("exam").collect()
    return "## Dataset\n\n" + table(["exam", *kinds], [[r["exam"], *[r[k] for k in kinds]] for r in found])


def retrieval_section(ranks: DataFrame) -> str:
    found = M.hit_rate_sets(ranks).orderBy(F.col("question_type") != "all", "question_type", "k").collect()
    return "" if not found else "## Retrieval\n\n" + table(["question_type", "k", "hit rate", "n"], [[r["question_type"], r["k"], f"{r['hit_rate']:.6f}", r["n"]] for r in found])


def off_topic_section(records: DataFrame) -> str:
    r = M.confusion(records).first()
    if not r["tp"] + r["fp"] + r["fn"] + r["tn"]:
        return ""
    names = ("tp", "fp", "fn", "tn", "n_unknown")
    rates = ("precision", "recall", "f1", "accuracy")
    return "## Off-topic filter\n\n" + table([*names, *rates], [[*[r[c] for c in names], *[show(r[c], 3) for c in rates]]])


def generation_section(records: DataFrame, spec: EvalSpec) -> str:
    s = M.score_summary(records, spec).first()
    if not s["n"]:
        return ""
    parts = [f"## Answers\n\n{s['n']} rows, {s['n_zeroed']} of them put to zero."]
    for score in ("correctness", "faithfulness"):
        found = M.score_breakdown(records, score, spec).orderBy("row_order", "label").collect()
        parts.append(f"### {score}: {show(s[score])} ({show(s[score + '_share'], 3)})\n\n" + table(["", "n", "zeroed", "mean", *map(str, range(spec.max_score + 1))], [[r["label"], r["n"], r["n_zeroed"], show(r["mean"]), *[r[f"score_{i}"] for i in range(spec.max_score + 1)]] for r in found]))
    for column in ("zeroed_reason", "status"):
        found = M.value_counts(records.where(F.coalesce(column, F.lit("")) != ""), column).orderBy(F.desc("n"), column).collect()
        if found:
            parts.append(table([column, "n"], [[r[column], r["n"]] for r in found]))
    return "\n\n".join(parts)


def latency_section(processed: DataFrame | None, records: DataFrame | None, spec: EvalSpec) -> str:
    rows = []
    if processed is not None and "duration_ms" in processed.columns:
        r = M.latency(processed).first()
        rows += [["query processing", r["n"], show(r["avg_s"]), show(r["max_s"])]] if r["n"] else []
    if records is not None and "durations_ms" in records.columns:
        rows += [[r["stage"], r["n"], show(r["avg_s"]), show(r["max_s"])] for r in M.stage_latencies(records, spec).orderBy("stage_order").collect()]
    return "" if not rows else "## Latency\n\n" + table(["stage", "n", "mean s", "max s"], rows)


def build_report(rows: DataFrame, processed: DataFrame | None = None, ranks: DataFrame | None = None, records: DataFrame | None = None, spec: EvalSpec | None = None) -> str:
    """All sections that have something to say, blank lines between them."""
    spec = spec or EvalSpec()
    sections = [
        dataset_section(rows), retrieval_section(ranks) if ranks is not None else "", generation_section(records, spec) if records is not None else "",
        off_topic_section(processed) if processed is not None else "", latency_section(processed, records, spec),
    ]
    return "\n\n".join(s for s in sections if s)


def condensation_table(processed: DataFrame) -> Iterator[str]:
    """Lines of a table of the questions and their condensed form, with whether it was edited; the driver holds one partition at a time."""
    rows = processed.withColumn("edited", ~F.col("question").eqNullSafe(F.col("condensed_query"))).orderBy("row_id").select("row_id", "question", "condensed_query", "edited", "verdict")
    yield from table(["row", "question", "condensed", "edited", "verdict"], []).split("\n")
    for r in rows.toLocalIterator():
        yield "| " + " | ".join([r["row_id"], r["question"], r["condensed_query"], "yes" if r["edited"] else "no", r["verdict"]]) + " |"
