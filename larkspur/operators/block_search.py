"""Stored indexes in blocks of points, and searches that leave out the blocks whose bound is below the k-th score.

A point has a place: its block and its position in it.  The sparse index has, for each term and block, the
postings and their greatest weight; blocks hold points of about the same length, since a weight
depends on their number of words, so that the greatest weights are near the others.  The dense index has cells round centroids, with the
angle within which all points of a cell lie.  Exams and temas are bitmaps over the positions of each block, which
a filter combines before anything is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import pi

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Bm25Spec
from ..sources.scratch import scratch_dir, written
from .retrieve import QUERY_TILE, _text_tiles, _unit_rows, query_terms, terms, top

#: Points of a block, about.
BLOCK_POINTS = 1024
#: Characters of a block's texts, about: blocks of long texts hold fewer points.
BLOCK_CHARS = 1 << 22
#: Different terms of all queries up to which they are sent to each task; more are joined by a shuffle.
SENT_TERMS = 200_000
#: Points whose vectors give the centroids, and the greatest number of these.
SAMPLE, CELLS = 20_000, 1024
ROUNDS = 10
BITS = 64
#: What a bound computed in doubles may lack.
SLACK = 1e-9


def placed(points: DataFrame, kind: Column, block_points: int = BLOCK_POINTS, parts: int | None = None, load: Column | None = None, of: DataFrame | None = None) -> DataFrame:
    """points with kind, block and pos: rows of one kind are dealt to as many blocks as they need, in each ordered by point_id.

    There must be few kinds (their table is sent to each task): 1,024 at most here.  parts: partitions of whole blocks.
    load: the share of a block that a point fills by itself, where blocks are bounded by more than the number of points.
    of: the same points without the columns that cost most to read, by which they are counted.
    """
    with_kind = points.withColumn("kind", kind)
    upto = Window.orderBy("kind").rowsBetween(Window.unboundedPreceding, -1)
    need = F.count("*") / block_points if load is None else F.greatest(F.count("*") / block_points, F.sum(load))
    counted = with_kind if of is None else of.withColumn("kind", kind)
    sizes = counted.groupBy("kind").agg(F.ceil(need).cast("int").alias("splits")).withColumn("first", F.coalesce(F.sum("splits").over(upto), F.lit(0)).cast("int"))
    dealt = with_kind.join(F.broadcast(sizes), "kind").withColumn("block", F.col("first") + F.pmod(F.xxhash64("point_id"), F.col("splits")).cast("int"))
    dealt = dealt if parts is None else dealt.repartition(parts, "block")
    return dealt.withColumn("pos", F.row_number().over(Window.partitionBy("block").orderBy("point_id")) - 1).drop("splits", "first")


def payload_bitmaps(places: DataFrame) -> DataFrame:
    """field, value, block, words: a bit for each point of a block that has the value; places: block, pos, exams_id, tema."""
    some = lambda c: F.array_distinct(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull()))
    each = None
    for field, column in (("exam", "exams_id"), ("tema", "tema")):
        part = places.select(F.lit(field).alias("field"), F.explode(some(column)).alias("value"), "block", "pos")
        each = part if each is None else each.unionByName(part)
    word = F.floor(F.col("pos") / BITS).cast("int")
    ored = each.groupBy("field", "value", "block", word.alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, pos % {BITS})")).alias("bits"))
    known = ored.groupBy("field", "value", "block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    return known.select("field", "value", "block", F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("m"))), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("words"))


def allowed_blocks(queries: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """query_id, block, words: the points that each query's filter (exam, temas) lets through; blocks without any are left out.

    Bitmaps are combined once for each different filter, not for each query.
    """
    clean = F.array_sort(F.array_distinct(F.filter(F.coalesce("temas", F.array().cast("array<string>")), lambda x: x.isNotNull())))
    asked = queries.select("query_id", "exam", clean.alias("wanted"), (F.size("temas") > 0).alias("narrow")).withColumn("filter", F.struct("exam", "wanted", "narrow"))
    filters = asked.select("filter").distinct().select("filter", "filter.*")
    has = lambda field: bitmaps.where(F.col("field") == field)
    exam = filters.join(has("exam").select(F.col("value").alias("exam"), "block", "words"), "exam").select("filter", "narrow", "block", F.col("words").alias("of_exam"))
    tema = filters.where("narrow").select("filter", F.explode("wanted").alias("value")).join(has("tema").select("value", "block", "words"), "value")
    tema = tema.groupBy("filter", "block").agg(F.collect_list("words").alias("w")).select("filter", "block", F.aggregate("w", F.array().cast("array<bigint>"), lambda a, x: _zipped(a, x, "bitwiseOR")).alias("of_temas"))
    both = exam.join(tema, ["filter", "block"], "left").select("filter", "block", F.when(~F.col("narrow"), F.col("of_exam")).otherwise(_zipped(F.col("of_exam"), F.coalesce("of_temas", F.array().cast("array<bigint>")), "bitwiseAND")).alias("words"))
    return asked.select("query_id", "filter").join(both.where(F.exists("words", lambda w: w != 0)), "filter").select("query_id", "block", "words")


def _zipped(a: Column, b: Column, how: str) -> Column:
    return F.zip_with(a, b, lambda x, y: getattr(F.coalesce(x, F.lit(0).cast("bigint")), how)(F.coalesce(y, F.lit(0).cast("bigint"))))


def build_sparse(points: DataFrame, path: str, spec: Bm25Spec | None = None, text: str = "content", block_points: int = BLOCK_POINTS) -> None:
    """Write postings (term, block, list of pos and weight, greatest weight) and places (block, pos, point_id) below path, and bitmaps where points has exams_id and tema.

    point_id must be unique.  A term that every point has is one row for each block, so no key holds more than a block.
    """
    spec = spec or Bm25Spec()
    spark = points.sparkSession
    payload = [c for c in ("exams_id", "tema") if c in points.columns]
    found = points.select("point_id", *payload, F.col(text).alias("text"), F.coalesce(F.length(F.col(text)), F.lit(0)).alias("chars"))
    kind, load = F.floor(F.log2(F.col("chars") + 1) * 2).cast("int"), F.col("chars") / BLOCK_CHARS
    short = written(found.drop("text"), f"{scratch_dir(spark, 'lengths')}/rows")
    placed(short, kind, block_points, load=load).select("block", "pos", "point_id", *payload).write.parquet(f"{path}/places")
    # whole texts go to their blocks, once, and are cut into terms there only
    there = placed(found.select("point_id", "chars", "text"), kind, block_points, 4 * _text_tiles(short), load, short)  # about 2,048 points a task
    cut = there.select("block", "pos", terms(F.col("text"), spec).alias("terms"))
    cut.groupBy("block").applyInArrow(_block_postings(spec), "term string, block int, list array<struct<pos: int, weight: double>>, most double, n long").write.parquet(f"{path}/postings")
    if len(payload) == 2:
        payload_bitmaps(spark.read.parquet(f"{path}/places")).write.parquet(f"{path}/bitmaps")


def _block_postings(spec: Bm25Spec):
    """The postings of a block's terms, in the order of terms and positions."""

    def run(rows: pa.Table) -> pa.Table:
        lists, pos = rows["terms"].combine_chunks(), rows["pos"].to_numpy()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        code = np.empty(len(order), dtype=np.int64)
        code[order] = np.arange(len(order))
        length = np.zeros(int(pos.max()) + 1, dtype=np.int64)
        length[pos] = sizes
        key, tf = np.unique(code[coded.indices.to_numpy()] * len(length) + np.repeat(pos, sizes), return_counts=True)
        term, at = np.divmod(key, len(length))
        weight = tf * (spec.k1 + 1) / (tf + spec.k1 * (1 - spec.b + spec.b * length[at] / spec.avg_len))
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        items = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(weight, pa.float64())], ["pos", "weight"])
        ends = np.append(starts, len(key))
        return pa.table({
            "term": coded.dictionary.take(pa.array(order[term[starts]])), "block": pa.array(np.full(len(starts), rows["block"][0].as_py()), pa.int32()), "list": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items),
            "most": pa.array(np.maximum.reduceat(weight, starts) if len(starts) else [], pa.float64()), "n": pa.array(np.diff(ends), pa.int64()),
        })

    return run


def _asked_terms(queries: DataFrame, postings: DataFrame, places: DataFrame, spec: Bm25Spec) -> DataFrame:
    """query_id, term, factor: 1, or the term's idf."""
    asked = query_terms(queries, spec)
    if not spec.idf:
        return asked.withColumn("factor", F.lit(1.0))
    total = places.agg(F.count("*").alias("total"))
    df = postings.join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(total))  # one row
    return asked.join(df.select("term", F.expr("ln(1D + (total - df + 0.5D) / (df + 0.5D))").alias("factor")), "term")


def _block_sparse(k: int, digits: int, filtered: bool):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        of_query, places, scores = [], [], []
        if len(queries) and len(rows):
            lists, found = rows["list"].combine_chunks(), queries["terms"].combine_chunks()
            pos, weights = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            upto = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            words, factors = found.flatten().flatten()
            at = pc.fill_null(pc.index_in(words, value_set=rows["term"].combine_chunks()), -1).to_numpy(zero_copy_only=False)
            factors = factors.to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(found).to_numpy(zero_copy_only=False))])
            n = int(pos.max()) + 1
            for i in range(len(queries)):
                own = [j for j in range(ends[i], ends[i + 1]) if at[j] >= 0]
                if not own:
                    continue
                parts = [slice(upto[at[j]], upto[at[j] + 1]) for j in own]
                met = np.concatenate([pos[p] for p in parts])
                total = np.bincount(met, weights=np.concatenate([weights[p] * factors[j] for p, j in zip(parts, own, strict=True)]), minlength=n)
                usable = np.bincount(met, minlength=n) > 0
                if filtered:
                    bits = np.unpackbits(np.array(queries["words"][i].as_py(), dtype="<i8").view(np.uint8), bitorder="little")[:n].astype(bool)
                    usable[: len(bits)] &= bits
                    usable[len(bits) :] = False
                usable = np.flatnonzero(usable)
                s = np.floor(total[usable] * 10.0**digits + 0.5) / 10.0**digits
                best = np.lexsort((usable, -s))[:k]
                of_query.append(np.full(len(best), i))
                places.append(usable[best])
                scores.append(s[best])
        some = pa.array(np.concatenate(of_query) if of_query else [], pa.int64())
        joined = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
        return pa.table({"query_id": queries["query_id"].take(some), "block": queries["block"].take(some), "pos": joined(places, pa.int64()).cast(pa.int32()), "score": joined(scores, pa.float64())})

    return run


class SparseSearch:
    """The k best points of each query (query_id, text; with exam and temas also filtered) in a stored index.

    The bound of a block is the sum of its greatest weights of the query's terms.  The block with the highest
    bound is scored first; its k-th score is the floor below which other blocks can't reach the list.  pairs: all
    (query_id, block) that hold a term; first, rest: those that are scored.
    """

    def __init__(self, queries: DataFrame, path: str, k: int, spec: Bm25Spec | None = None, digits: int = 6) -> None:
        spark, held = queries.sparkSession, scratch_dir(queries.sparkSession, "search")
        self.k, self.digits, self.spec = k, digits, spec or Bm25Spec()
        self.postings, self.places = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/places").select("block", "pos", "point_id")
        self.asked = written(_asked_terms(queries, self.postings, self.places, self.spec), f"{held}/asked")
        wanted = self.asked.select("term").distinct()
        wanted = F.broadcast(wanted) if wanted.count() <= SENT_TERMS else wanted
        # what several steps read is worked out once
        self.lists = written(self.postings.select("term", "block", "most", "list").join(wanted, "term", "left_semi"), f"{held}/lists")
        self.tiles, self.kind = max(1, -(-queries.count() // QUERY_TILE)), queries.schema["query_id"].dataType.simpleString()
        bounds = self.lists.select("term", "block", "most").join(self.asked, "term").groupBy("query_id", "block").agg(F.sum(F.col("most") * F.col("factor")).alias("bound"))
        self.filtered = "exam" in queries.columns
        self.pairs = written(bounds.join(allowed_blocks(queries, spark.read.parquet(f"{path}/bitmaps")), ["query_id", "block"]) if self.filtered else bounds, f"{held}/pairs")
        best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        self.first = self.pairs.withColumn("at", F.row_number().over(best)).where("at = 1").drop("at")
        self.of_first = written(self.scored(self.first), f"{held}/first")
        floor = self.of_first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        beside = self.pairs.join(self.first.select("query_id", F.col("block").alias("one")), "query_id").where("block <> one").drop("one")
        self.rest = beside.join(floor, "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") + F.lit(10.0**-digits) >= F.col("floor"))).drop("floor")

    def scored(self, pairs: DataFrame) -> DataFrame:
        """query_id, block, pos, score of the k best of each (query_id, block); positions are in the order of ids, so ties are too.

        Tiles of a block's queries meet its postings, so that scores of all pairs are neither shuffled nor held.
        """
        some = ["words"] if self.filtered else []
        asked = self.asked.groupBy("query_id").agg(F.collect_list(F.struct("term", "factor")).alias("terms"))
        asked = pairs.select("query_id", "block", *some).join(asked, "query_id").withColumn("tile", F.pmod(F.xxhash64("query_id"), F.lit(self.tiles)).cast("int"))
        rows = self.lists.select("term", "block", "list").join(pairs.select("block").distinct(), "block", "left_semi")
        rows = rows.select(*[F.col(c).alias(c) for c in ("term", "block", "list")]).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(self.tiles - 1))))
        return asked.groupBy("block", "tile").cogroup(rows.groupBy("block", "tile")).applyInArrow(_block_sparse(self.k, self.digits, self.filtered), f"query_id {self.kind}, block int, pos int, score double")

    def result(self) -> DataFrame:
        """query_id, point_id, score, rank; ids are looked up for those whose score is among a query's k highest, ties included."""
        found = self.of_first.unionByName(self.scored(self.rest))
        high = found.withColumn("at", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("at") <= self.k)
        return top(high.join(self.places, ["block", "pos"]).select("query_id", "point_id", "score"), self.k)


def _centroids(sample: np.ndarray, n: int) -> np.ndarray:
    """Directions of n groups by rounds of nearest centroids; it begins with rows that are far from one another."""
    chosen = [0]
    nearest = sample @ sample[0]
    while len(chosen) < min(n, len(sample)):
        at = int(nearest.argmin())
        chosen.append(at)
        nearest = np.maximum(nearest, sample @ sample[at])
    centroids = sample[chosen].copy()
    for _ in range(ROUNDS):
        own = (sample @ centroids.T).argmax(axis=1)
        for c in range(len(centroids)):
            if (own == c).any():
                total = sample[own == c].sum(axis=0)
                norm = np.linalg.norm(total)
                centroids[c] = total / norm if norm > 0 else centroids[c]
    return centroids


def build_dense(points: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, block_points: int = BLOCK_POINTS) -> None:
    """Write places (cell, block, pos, point_id, unit vector, payload), cells (centroid, angle, number of points) and, with exams_id and tema, bitmaps below path.

    At most `sample` vectors, in the order of a hash of their ids, give the centroids; every usable vector gets a
    place.  Null vectors, those with a null, of length zero or of another size than most are left out.
    """
    spark = points.sparkSession
    payload = [c for c in ("exams_id", "tema") if c in points.columns]
    usable = points.where(F.col("dense").isNotNull() & ~F.exists("dense", lambda x: x.isNull() | F.isnan(x)) & F.exists("dense", lambda x: x != 0))
    size = usable.groupBy(F.size("dense").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    size = size[0]["size"] if size else 0
    usable = usable.where(F.size("dense") == size)
    rows = usable.orderBy(F.xxhash64("point_id"), "point_id").limit(sample).select("dense").toArrow()["dense"].combine_chunks()  # no object for each number in the driver
    vectors = _unit_rows(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), size)) if len(rows) else np.zeros((0, size))
    n = cells or max(1, min(CELLS, int(np.sqrt(len(vectors)))))
    centroids = spark.sparkContext.broadcast(_centroids(vectors, n) if len(vectors) else np.zeros((1, size)))
    kinds = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in ("point_id", *payload))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            unit = _unit_rows(list(batch["dense"])) if len(batch) else np.zeros((0, size))
            near = unit @ centroids.value.T
            cell = near.argmax(axis=1) if len(batch) else np.zeros(0, dtype=int)
            yield batch[["point_id", *payload]].assign(cell=cell, cosine=near[np.arange(len(batch)), cell], unit=list(unit))

    assigned = written(usable.select("point_id", *payload, "dense").mapInPandas(nearest, f"{kinds}, cell int, cosine double, unit array<double>"), f"{scratch_dir(spark, 'assigned')}/rows")
    placed(assigned, F.col("cell"), block_points).drop("kind").write.parquet(f"{path}/places")
    places = spark.read.parquet(f"{path}/places")
    angles = places.groupBy("cell").agg(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.min("cosine")))).alias("angle"), F.count("*").alias("n"), F.collect_set("block").alias("blocks"))
    centres = spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centroids.value)], "cell int, centroid array<double>")
    angles.join(centres, "cell").write.parquet(f"{path}/cells")
    if len(payload) == 2:
        payload_bitmaps(places).write.parquet(f"{path}/bitmaps")


def _bounds(table: pd.DataFrame):
    """query_id, cell, near (cosine of the centroid) and bound (of the best cosine a point of the cell can have)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, angle = np.array(list(table["centroid"])), table["angle"].to_numpy()
        for batch in batches:
            batch = batch[[v is not None and len(v) == centroids.shape[1] and not pd.isna(np.asarray(v, dtype=object)).any() for v in batch["dense"]]] if len(batch) else batch
            if not len(batch):
                continue
            near = np.clip(_unit_rows(list(batch["dense"])) @ centroids.T, -1, 1)
            bound = np.cos(np.clip(np.arccos(near) - angle[None, :], 0, pi)) + SLACK
            good = ~np.isnan(near).any(axis=1)
            n, m = int(good.sum()), len(table)
            yield pd.DataFrame({"query_id": np.repeat(batch["query_id"].to_numpy()[good], m), "cell": np.tile(table["cell"].to_numpy(), n), "near": near[good].ravel(), "bound": bound[good].ravel()})

    return run


def _block_topk(k: int, exclude_self: bool, digits: int, filtered: bool):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(queries) and len(rows):
            ids, pos = rows["point_id"].to_numpy(), rows["pos"].to_numpy()
            scores = np.round(_unit_rows(list(queries["dense"])) @ np.array(list(rows["unit"])).T, digits)
            for i, (query, s) in enumerate(zip(queries["query_id"].to_numpy(), scores, strict=True)):
                usable = ~np.isnan(s)
                if filtered:
                    bits = np.unpackbits(np.asarray(queries["words"].iat[i], dtype="<i8").view(np.uint8), bitorder="little")
                    usable &= np.where(pos < len(bits), bits[np.minimum(pos, len(bits) - 1)], 0).astype(bool)
                if exclude_self:
                    usable &= ids != query
                at = np.flatnonzero(usable)
                at = at[np.lexsort((ids[at], -s[at]))][:k]
                out.append((np.repeat(queries["query_id"].to_numpy()[i : i + 1], len(at)), ids[at], s[at]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
        return pd.DataFrame(dict(zip(("query_id", "point_id", "score"), columns, strict=True)))

    return run


class DenseSearch:
    """The k nearest points of each query (query_id, dense; with exam and temas also filtered) in a stored index.

    Exact without probes: the cell nearest to a query is scored first, its k-th score is the floor, and cells whose
    angle leaves no point above it are left out.  With probes only so many of the nearest cells are scored.  Vectors of
    another size than the index's get no result.
    """

    def __init__(self, queries: DataFrame, path: str, k: int, exclude_self: bool = False, digits: int = 6, probes: int | None = None) -> None:
        spark, held = queries.sparkSession, scratch_dir(queries.sparkSession, "search")
        self.k, self.exclude_self, self.digits = k, exclude_self, digits
        self.places, self.queries = spark.read.parquet(f"{path}/places").select("block", "pos", "point_id", "unit"), queries
        cells = spark.read.parquet(f"{path}/cells")
        table = cells.select("cell", "centroid", "angle").orderBy("cell").toPandas()  # CELLS rows at most
        self.filtered = "exam" in queries.columns
        kind = queries.schema["query_id"].dataType.simpleString()
        bounds = queries.select("query_id", "dense").mapInPandas(_bounds(table), f"query_id {kind}, cell int, near double, bound double") if len(table) else spark.createDataFrame([], f"query_id {kind}, cell int, near double, bound double")
        blocks = cells.select("cell", F.explode("blocks").alias("block"))
        # what several steps read is worked out once
        self.pairs = written(bounds.join(F.broadcast(cells.select("cell")), "cell"), f"{held}/pairs")
        near = Window.partitionBy("query_id").orderBy(F.desc("near"), "cell")
        ranked = self.pairs.withColumn("at", F.row_number().over(near))
        self.blocks = blocks
        if self.filtered:
            self.allowed = written(allowed_blocks(queries, spark.read.parquet(f"{path}/bitmaps")), f"{held}/allowed")
        self.first = ranked.where(F.col("at") <= (probes or 1)).select("query_id", "cell")
        self.of_first = written(self.scored(self.first), f"{held}/first")
        self.rest = None
        if probes is None:
            floor = top(self.of_first, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
            self.rest = ranked.where("at > 1").join(floor, "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") + F.lit(10.0**-digits) >= F.col("floor"))).select("query_id", "cell")

    def scored(self, pairs: DataFrame) -> DataFrame:
        """query_id, point_id, score of the k best of each block; queries of a block meet it in tiles."""
        wanted = pairs.join(self.blocks, "cell").select("query_id", "block")
        if self.filtered:
            wanted = wanted.join(self.allowed, ["query_id", "block"])
        tiles = max(1, -(-self.queries.count() // QUERY_TILE))
        asked = wanted.join(self.queries.select("query_id", "dense"), "query_id").withColumn("tile", F.pmod(F.xxhash64("query_id"), F.lit(tiles)).cast("int"))
        rows = self.places.select(*[F.col(c).alias(c) for c in ("block", "pos", "point_id", "unit")], F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))
        rows = rows.join(asked.select(F.col("block").alias("b"), F.col("tile").alias("t")).distinct(), (F.col("block") == F.col("b")) & (F.col("tile") == F.col("t")), "left_semi")
        kinds = f"query_id {self.queries.schema['query_id'].dataType.simpleString()}, point_id {self.places.schema['point_id'].dataType.simpleString()}, score double"
        return asked.groupBy("block", "tile").cogroup(rows.groupBy("block", "tile")).applyInPandas(_block_topk(self.k, self.exclude_self, self.digits, self.filtered), kinds)

    def result(self) -> DataFrame:
        """query_id, point_id, score, rank."""
        return top(self.of_first if self.rest is None else self.of_first.unionByName(self.scored(self.rest)), self.k)


def measured_probes(spark: SparkSession, path: str, k: int, recall: float = 0.9, sample: int = 200) -> tuple[int, float]:
    """The least power of two of probes, and its recall, with which `sample` stored points find so large a share of their k nearest others."""
    cells = spark.read.parquet(f"{path}/cells").count()
    asked = spark.read.parquet(f"{path}/places").orderBy(F.xxhash64("point_id", F.lit(1)), "point_id").limit(sample).select(F.col("point_id").alias("query_id"), F.col("unit").alias("dense"))
    asked = spark.createDataFrame(asked.toPandas(), asked.schema)  # `sample` rows
    true = DenseSearch(asked, path, k, exclude_self=True).result().select("query_id", "point_id").toPandas()
    true, probes = set(map(tuple, true.to_numpy())), 1
    while True:
        found = DenseSearch(asked, path, k, exclude_self=True, probes=probes).result().select("query_id", "point_id").toPandas()
        share = len(true & set(map(tuple, found.to_numpy()))) / max(1, len(true))
        if share >= recall or probes >= cells:
            return probes, share
        probes *= 2


def hybrid_stored(queries: DataFrame, sparse_path: str, dense_path: str, k: int, bm25: Bm25Spec | None = None) -> tuple[DataFrame, DataFrame]:
    """The dense and the sparse list of each query; a filter goes before both."""
    columns = ["query_id", *[c for c in ("exam", "temas") if c in queries.columns]]
    dense = DenseSearch(queries.select(*columns, "dense"), dense_path, k).result()
    return dense, SparseSearch(queries.select(*columns, "text"), sparse_path, k, bm25).result()
