"""Filtered dense, sparse and hybrid retrieval of the best points per query."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Bm25Spec, FusionSpec, RetrievalSpec
from ..functions.text import words

#: Queries and points that meet in one task of a dense search.
QUERY_TILE, POINT_TILE = 4096, 50_000
#: Points that are counted, and meet queries, in one task of a sparse search.
TEXT_TILE = 8192


def effective_temas(exam: Column, temas: Column) -> Column:
    """Temas count for exam A1 only."""
    return F.when(exam == "A1", F.coalesce(temas, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def settings_temas(exam: Column, tema: Column) -> Column:
    """What a choice in the settings means: one tema for A1 unless all are chosen."""
    return F.when((exam == "A1") & tema.isNotNull() & (tema != "TODOS"), F.array(tema)).otherwise(F.array().cast("array<string>"))


def matches(exams_id: Column, tema: Column, exam: Column, temas: Column) -> Column:
    """The filter of a search: the exam is among the point's, and any of the temas if there are some."""
    clean = F.filter(F.coalesce(tema, F.array().cast("array<string>")), lambda x: x.isNotNull())
    any_tema = (F.size(temas) == 0) | F.arrays_overlap(clean, F.filter(temas, lambda x: x.isNotNull()))
    return F.coalesce(F.array_contains(exams_id, exam) & any_tema, F.lit(False))


def top(scored: DataFrame, k: int | Column, query: str = "query_id", point: str = "point_id", score: str = "score") -> DataFrame:
    """Ranks from 1 on by score, ties by point; rank <= k."""
    best = Window.partitionBy(query).orderBy(F.desc(score), point)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def dense_topk(queries: DataFrame, points: DataFrame, k: int, exclude_self: bool = False, digits: int = 6) -> DataFrame:
    """query_id, point_id, score, rank of the k nearest points by cosine.

    Tiles of about QUERY_TILE queries meet tiles of about POINT_TILE points; a task multiplies one of
    each and keeps k rows per query, so nothing passes the driver and what a task holds doesn't grow with the tables.
    Scores are rounded before they are ranked.  Vectors of length zero, null vectors, those with a null and those of
    another size are left out.  queries and points: query_id/point_id and dense;
    with filters also exam, temas and exams_id, tema.
    """
    filtered = "exam" in queries.columns
    spark = queries.sparkSession
    asked = queries.select("query_id", "dense", *(["exam", "temas"] if filtered else []))
    rows = points.select(*[F.col(c).alias(c) for c in ("point_id", "dense", *(("exams_id", "tema") if filtered else ()))])  # new columns: both sides may come from one table
    n_points = points.count()
    tiles = max(1, -(-queries.count() // QUERY_TILE))
    shards = max(1, -(-n_points // POINT_TILE), min(spark.sparkContext.defaultParallelism, -(-n_points // 512)))
    tile, shard = F.pmod(F.xxhash64("query_id"), F.lit(tiles)).cast("int"), F.pmod(F.xxhash64("point_id"), F.lit(shards)).cast("int")
    asked = asked.withColumn("__tile", tile).withColumn("__shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    rows = rows.withColumn("__shard", shard).withColumn("__tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, point_id {points.schema['point_id'].dataType.simpleString()}, score double"
    found = asked.groupBy("__tile", "__shard").cogroup(rows.groupBy("__tile", "__shard")).applyInPandas(_tile_topk(k, exclude_self, digits, filtered), kinds)
    return top(found, k)


def _unit_rows(vectors: list) -> np.ndarray:
    x = np.asarray(vectors, dtype=np.float64)
    n = np.sqrt((x * x).sum(axis=1))
    return x / np.where(n > 0, n, np.nan)[:, None]


def _by_size(vectors: pd.Series) -> dict[int, np.ndarray]:
    """Places of the usable vectors by their size."""
    sizes = np.array([-1 if v is None or pd.isna(np.asarray(v, dtype=object)).any() else len(v) for v in vectors], dtype=np.int64)
    return {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes[sizes > 0])}


def _allowed(rows: pd.DataFrame, exam: str, temas: frozenset) -> np.ndarray:
    """Which points a filter lets through: one mask for all queries that ask for the same."""
    ok = [e is not None and exam in e and (not temas or (t is not None and not temas.isdisjoint(t))) for e, t in zip(rows["exams_id"], rows["tema"], strict=True)]
    return np.array(ok, dtype=bool)


def _tile_topk(k: int, exclude_self: bool, digits: int, filtered: bool):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        asked, given = _by_size(queries["dense"]), _by_size(rows["dense"])
        query_ids = queries["query_id"].to_numpy()
        for size in asked.keys() & given.keys():
            part = rows.iloc[given[size]]
            ids, matrix = part["point_id"].to_numpy(), _unit_rows(list(part["dense"])).T
            groups: dict[tuple, list[int]] = {}
            for place in asked[size]:
                wanted = (queries["exam"].iat[place], frozenset(t for t in queries["temas"].iat[place] if t is not None)) if filtered else ()
                groups.setdefault(wanted, []).append(place)
            for wanted, places in groups.items():
                open_ = np.flatnonzero(_allowed(part, *wanted)) if filtered else np.arange(len(ids))
                for lo in range(0, len(places), 256):
                    block = places[lo : lo + 256]
                    scores = np.round(_unit_rows([queries["dense"].iat[p] for p in block]) @ matrix[:, open_], digits)
                    for place, s in zip(block, scores, strict=True):
                        usable = np.flatnonzero(~np.isnan(s) & (ids[open_] != query_ids[place])) if exclude_self else np.flatnonzero(~np.isnan(s))
                        if len(usable) > k:
                            least = np.partition(s[usable], len(usable) - k)[len(usable) - k]
                            usable = usable[s[usable] >= least]
                            usable = usable[np.lexsort((ids[open_][usable], -s[usable]))][:k]
                        out.append((np.repeat(query_ids[place : place + 1], len(usable)), ids[open_][usable], s[usable]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
        return pd.DataFrame(dict(zip(("query_id", "point_id", "score"), columns, strict=True)))

    return run


def query_terms(queries: DataFrame, spec: Bm25Spec | None = None) -> DataFrame:
    """(query_id, term): the distinct terms of each query's text."""
    spec = spec or Bm25Spec()
    return queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text"), spec))).alias("term"))


def terms(text: Column, spec: Bm25Spec) -> Column:
    """The terms of a text: lower-cased pieces without stop words, and their stems where a language says how (stem_udf)."""
    found = words(text, spec.pattern)
    if spec.stop_words:
        found = F.filter(found, lambda w: ~w.isin(*spec.stop_words))
    return stems(found, spec.language) if spec.language else found


def _weight(tf: str, length: str, spec: Bm25Spec) -> str:
    return f"{tf} * ({spec.k1}D + 1) / ({tf} + {spec.k1}D * (1 - {spec.b}D + {spec.b}D * {length} / {spec.avg_len}D))"


def inverted_index(points: DataFrame, spec: Bm25Spec | None = None, text: str = "content", wanted: DataFrame | None = None) -> DataFrame:
    """term, point_id, weight: the saturated frequency of each term of each point.

    wanted: a table with the terms that will be asked for.  Others are left out before they are counted, so
    that a search shuffles the postings of its own terms only.  With idf all terms of the corpus count their documents, yet
    only the wanted ones come out.  About TEXT_TILE points are counted in a task, at any size of the table.
    """
    spec = spec or Bm25Spec()
    tokens = points.select("point_id", text).repartition(_text_tiles(points), "point_id").select("point_id", terms(F.col(text), spec).alias("w")).select("point_id", F.size("w").alias("len"), F.explode("w").alias("term"))
    if wanted is not None:
        tokens = tokens.join(wanted.select("term").distinct(), "term", "left_semi")
    counted = tokens.groupBy("point_id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    index = counted.select("term", "point_id", F.expr(_weight("tf", "len", spec)).alias("weight"))
    if not spec.idf:
        return index
    n = points.select("point_id").distinct().agg(F.count("*").alias("n"))
    df = index.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", F.expr("ln(1D + (n - df + 0.5D) / (df + 0.5D))").alias("idf"))
    return index.join(df, "term").select("term", "point_id", (F.col("weight") * F.col("idf")).alias("weight"))


def _text_tiles(points: DataFrame) -> int:
    n = points.count()
    return max(1, -(-n // TEXT_TILE), min(points.sparkSession.sparkContext.defaultParallelism, -(-n // 512)))


def sparse_vector(text: Column, spec: Bm25Spec | None = None) -> Column:
    """array<struct<term, weight>> of a text, in the order of terms: what an index stores with each point; the weights without idf."""
    spec = spec or Bm25Spec()

    @F.pandas_udf("array<struct<term: string, tf: int, len: int>>")
    def count(found: pd.Series) -> pd.Series:
        def one(ws) -> list[dict] | None:
            if ws is None:
                return None
            kinds, n = np.unique(np.asarray(ws, dtype=object).astype(str), return_counts=True) if len(ws) else ([], [])
            return [{"term": t, "tf": int(c), "len": len(ws)} for t, c in zip(kinds, n, strict=True)]

        return found.map(one)

    return F.transform(count(terms(text, spec)), lambda x: F.struct(x["term"].alias("term"), (x["tf"] * F.lit(spec.k1 + 1) / (x["tf"] + F.lit(spec.k1) * (F.lit(1 - spec.b) + F.lit(spec.b) * x["len"] / F.lit(spec.avg_len)))).alias("weight")))


def postings(points: DataFrame, wanted: DataFrame, column: str = "sparse") -> DataFrame:
    """term, point_id, weight of the stored sparse vectors, for the wanted terms."""
    return points.select("point_id", F.explode(column).alias("p")).select("p.term", "point_id", "p.weight").join(wanted.select("term").distinct(), "term", "left_semi")


def sparse_scores(queries: DataFrame, index: DataFrame, spec: Bm25Spec | None = None, digits: int = 6) -> DataFrame:
    """queries: query_id, text.  Sums of weights of the distinct terms of each query, rounded."""
    return index.join(query_terms(queries, spec), "term").groupBy("query_id", "point_id").agg(F.round(F.sum("weight"), digits).alias("score"))


def sparse_topk(queries: DataFrame, points: DataFrame, index: DataFrame, k: int, spec: Bm25Spec | None = None, digits: int = 6) -> DataFrame:
    """query_id, point_id, score, rank of the k best points by the sums of sparse_scores.

    The postings of each point become one row, tiles of queries meet tiles of points, and a task keeps k rows per query:
    scores of all pairs are neither shuffled nor held, and what a task holds doesn't grow with the tables.
    queries: query_id, text; index: term, point_id, weight of these points.  With exam and temas the points have
    exams_id and tema, and a query sees those that match only.
    """
    filtered = "exam" in queries.columns
    both = ["exam", "temas"] if filtered else []
    asked = queries.select("query_id", *both, terms(F.col("text"), spec or Bm25Spec()).alias("t")).groupBy("query_id", *both).agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("terms"))
    rows = index.groupBy("point_id").agg(F.collect_list(F.struct("term", "weight")).alias("sparse"))
    if filtered:
        rows = rows.join(points.select("point_id", "exams_id", "tema"), "point_id")
    tiles, shards = max(1, -(-queries.count() // QUERY_TILE)), _text_tiles(points)
    tile, shard = F.pmod(F.xxhash64("query_id"), F.lit(tiles)).cast("int"), F.pmod(F.xxhash64("point_id"), F.lit(shards)).cast("int")
    asked = asked.withColumn("__tile", tile).withColumn("__shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    rows = rows.withColumn("__shard", shard).withColumn("__tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, point_id {index.schema['point_id'].dataType.simpleString()}, score double"
    found = asked.groupBy("__tile", "__shard").cogroup(rows.groupBy("__tile", "__shard")).applyInArrow(_tile_sparse(k, digits, filtered), kinds)
    return top(found, k)


def _tile_sparse(k: int, digits: int, filtered: bool):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        of_query, of_point, scores = [], [], []
        if len(queries) and len(rows):
            lists, vectors = queries["terms"].combine_chunks(), rows["sparse"].combine_chunks()
            words, weights = vectors.flatten().flatten()
            kinds = lists.flatten().unique()
            code = pc.fill_null(pc.index_in(words, value_set=kinds), -1).to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            starts = np.searchsorted(code[order], np.arange(len(kinds) + 1))
            at = np.repeat(np.arange(len(rows)), pc.list_value_length(vectors).to_numpy(zero_copy_only=False))[order]
            weights = weights.to_numpy(zero_copy_only=False)[order]
            ids = rows["point_id"].to_numpy()
            payload = rows.select(["exams_id", "tema"]).to_pandas() if filtered else None
            masks: dict[tuple, np.ndarray] = {}
            for i in range(len(queries)):
                own = pc.index_in(lists[i].values, value_set=kinds).to_numpy(zero_copy_only=False)
                places = [slice(starts[c], starts[c + 1]) for c in own]
                if not places:
                    continue
                met = np.concatenate([at[p] for p in places])
                total = np.bincount(met, weights=np.concatenate([weights[p] for p in places]), minlength=len(rows))
                usable = np.bincount(met, minlength=len(rows)) > 0
                if filtered:
                    temas = queries["temas"][i].as_py()
                    wanted = (queries["exam"][i].as_py(), frozenset(t for t in temas if t is not None))
                    if temas and not wanted[1]:
                        continue
                    if wanted not in masks:
                        masks[wanted] = _allowed(payload, *wanted)
                    usable &= masks[wanted]
                usable = np.flatnonzero(usable)
                s = np.floor(total[usable] * 10.0**digits + 0.5) / 10.0**digits
                if len(usable) > k:
                    high = s >= np.partition(s, len(s) - k)[len(s) - k]
                    usable, s = usable[high], s[high]
                best = np.lexsort((ids[usable], -s))[:k]
                of_query.append(np.full(len(best), i))
                of_point.append(usable[best])
                scores.append(s[best])
        take = lambda table, name, some: table[name].take(pa.array(np.concatenate(some) if some else [], pa.int64()))
        found = pa.array(np.concatenate(scores) if scores else [], pa.float64())
        return pa.table({"query_id": take(queries, "query_id", of_query), "point_id": take(rows, "point_id", of_point), "score": found})

    return run


def stems(found: Column, language: str) -> Column:
    """Each word without its endings, by the rules of a language (STEMS)."""
    rules = STEMS[language]

    def cut(w: Column) -> Column:
        out = w
        for shortest, pattern in rules:
            out = F.when(F.length(out) >= shortest, F.regexp_replace(out, pattern, "")).otherwise(out)
        return F.translate(out, "áéíóúü", "aeiouu")

    return F.transform(found, cut)


#: Endings that go, one rule behind the other, from words of so many letters on.  Light stemmers with rules of their own: plural, then gender.
STEMS = {"spanish": ((5, "(?<=[^aeiouáéíóú])es$|(?<=[aeiouáéíóú])s$"), (5, "(?:amiento|imiento|aci[oó]n|adora|ador|mente|idad)$"), (5, "[aoe]$")), "english": ((5, "(?<=[^s])s$"), (6, "(?:ing|ed|ly)$"))}


def fuse(branches: list[DataFrame], spec: FusionSpec | None = None, digits: int = 9) -> DataFrame:
    """Reciprocal rank fusion of ranked branches (query_id, point_id, rank from 1): query_id, point_id, score."""
    spec = spec or FusionSpec()
    rows = None
    for branch in branches:
        part = branch.select("query_id", "point_id", F.expr(f"1D / ({spec.k0} + rank - {1 - spec.rank_base})").alias("s"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("query_id", "point_id").agg(F.round(F.sum("s"), digits).alias("score"))


def hybrid_topk(dense: DataFrame, sparse: DataFrame, k: int, spec: RetrievalSpec | None = None) -> DataFrame:
    """dense, sparse: scores of both branches.  Each is cut at k before they are fused, so a greater k may change the first ranks."""
    spec = spec or RetrievalSpec()
    return top(fuse([top(dense, k), top(sparse, k)], spec.fusion), k)


def k_sweep(dense: DataFrame, sparse: DataFrame, spec: RetrievalSpec | None = None) -> DataFrame:
    """The hybrid result for each k of the grid, from one ranking of each branch: k, query_id, point_id, score, rank."""
    spec = spec or RetrievalSpec()
    most = max(spec.k_grid)
    grid = F.explode(F.array(*[F.lit(k) for k in spec.k_grid])).alias("k")
    parts = []
    for branch in (top(dense, most), top(sparse, most)):
        parts.append(branch.select("query_id", "point_id", "rank", grid).where("rank <= k").select("query_id", "point_id", "k", F.expr(f"1D / ({spec.fusion.k0} + rank - {1 - spec.fusion.rank_base})").alias("s")))
    fused = parts[0].unionByName(parts[1]).groupBy("k", "query_id", "point_id").agg(F.round(F.sum("s"), 9).alias("score"))
    best = Window.partitionBy("k", "query_id").orderBy(F.desc("score"), "point_id")
    return fused.withColumn("rank", F.row_number().over(best)).where("rank <= k")


def to_result(ranked: DataFrame, points: DataFrame) -> DataFrame:
    """Ranked ids with content and metadata; missing lists become empty, a missing section type none."""
    empty = F.array().cast("array<string>")
    meta = F.col("metadata")
    fixed = F.struct(
        meta["doc_id"].alias("doc_id"), meta["doc_name"].alias("doc_name"), meta["doc_date"].alias("doc_date"), meta["source_url"].alias("source_url"), F.coalesce(meta["exams_id"], empty).alias("exams_id"), F.coalesce(meta["tema"], empty).alias("tema"),
        F.coalesce(meta["tipo_seccion"], F.lit("none")).alias("tipo_seccion"), meta["seccion"].alias("seccion"),
    )
    return ranked.join(points.select("point_id", "content", fixed.alias("metadata")), "point_id").select("query_id", "rank", F.col("point_id").cast("string").alias("point_id"), "content", "metadata", F.col("score").alias("retrieval_score"))
