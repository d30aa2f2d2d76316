"""Connected components by alternating stars, as joins and aggregates of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, release


def _written(edges: DataFrame) -> DataFrame:
    return materialize(edges, "edges", n=F.count("*"), hash=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of the undirected edges (u, v): one row (node, root) per node with an edge, root the least node.

    Large-star and small-star steps until nothing changes.  Each step is a
    grouped minimum (combined before the shuffle) and a join on the node, so that
    a node with very many edges is split by the adaptive skew join.  Every
    round is written to the shared folder.  No edges give no rows; loops and
    nulls are ignored.
    """
    e = edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    stats = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        before, e = e, _written(small.select("e.u", "e.v").where("u <> v").distinct())
        if stats is not None:
            release(before)
        if e.stats == stats or not e.stats["n"]:
            break
        stats = e.stats
    else:
        raise RuntimeError(f"components have not settled within {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
