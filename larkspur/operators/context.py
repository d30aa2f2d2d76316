"""Context of an answer: a budgeted prefix of the results, numbered blocks and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ContextSpec
from ..functions.text import estimate_tokens, heading, or_else


def within_budget(results: DataFrame, spec: ContextSpec | None = None, query: str = "query_id", order: str = "rank", content: str = "content") -> DataFrame:
    """The first result of each query and all further ones up to the first that goes over the budget.

    results: at most one row for each query and place in the order.  Only places and lengths are sorted; the contents of the few
    results that are kept are joined to them.
    """
    spec = spec or ContextSpec()
    w = Window.partitionBy(query).orderBy(order)
    sizes = results.select(query, order, estimate_tokens(F.col(content), spec.chars_per_token).alias("n_tokens_estimate"))
    running = F.sum("n_tokens_estimate").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = sizes.withColumn("cum_tokens", running).withColumn("citation", F.row_number().over(w)).where((F.col("citation") == 1) | (F.col("cum_tokens") <= spec.budget))
    return results.join(kept, [query, order]).select(*results.columns, "n_tokens_estimate", "cum_tokens", "citation")


def block(citation: F.Column, doc_name: F.Column, seccion: F.Column, doc_date: F.Column, content: F.Column) -> F.Column:
    """[i] name — section (fecha: date), then the content on the next line."""
    date = F.when(F.coalesce(doc_date, F.lit("")) != "", F.concat(F.lit(" (fecha: "), doc_date, F.lit(")"))).otherwise(F.lit(""))
    return F.concat(F.lit("["), citation.cast("string"), F.lit("] "), heading(doc_name, seccion), date, F.lit("\n"), F.coalesce(content, F.lit("")))


def render(kept: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, blocks, sources (index, doc_name, seccion, source_url, doc_id, point_id), n_tokens_estimate; empty for queries without results."""
    meta = F.col("metadata")
    source = F.struct(F.col("citation").alias("index"), meta["doc_name"].alias("doc_name"), meta["seccion"].alias("seccion"), meta["source_url"].alias("source_url"), meta["doc_id"].alias("doc_id"), F.col("point_id"))
    rows = kept.select("query_id", "citation", block(F.col("citation"), meta["doc_name"], meta["seccion"], meta["doc_date"], F.col("content")).alias("b"), source.alias("s"), "n_tokens_estimate")
    done = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("citation", "b", "s"))).alias("x"), F.sum("n_tokens_estimate").alias("n"))
    done = done.select("query_id", F.array_join(F.transform("x", lambda r: r["b"]), "\n\n").alias("blocks"), F.transform("x", lambda r: r["s"]).alias("sources"), "n")
    empty = F.filter("sources", lambda x: F.lit(False))
    return queries.select("query_id").join(done, "query_id", "left").select("query_id", F.coalesce("blocks", F.lit("")).alias("blocks"), F.coalesce("sources", empty, F.array().cast(done.schema["sources"].dataType)).alias("sources"), F.coalesce("n", F.lit(0)).alias("n_tokens_estimate"))


def source_label(doc_name: F.Column, seccion: F.Column, doc_id: F.Column, url: F.Column) -> F.Column:
    """The heading, or the id where there is none; a link where there is a URL."""
    label = or_else(heading(doc_name, seccion), doc_id)
    return F.when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit("["), label, F.lit("]("), url, F.lit(")"))).otherwise(label)


def render_sources(sources: F.Column) -> F.Column:
    return F.array_join(F.transform(sources, lambda s: F.concat(F.lit("["), s["index"].cast("string"), F.lit("] "), source_label(s["doc_name"], s["seccion"], s["doc_id"], s["source_url"]))), "\n")


def mark_kept(retrieved: DataFrame, kept: DataFrame) -> DataFrame:
    """retrieved with a column kept: whether the point went into the context."""
    flags = kept.select("query_id", "point_id", F.lit(True).alias("kept")).distinct()
    return retrieved.join(flags, ["query_id", "point_id"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
