"""Mixing sources to target weights by hierarchical budgets.

A budget of tokens goes down a tree of domain, language and source.  At each
node the children get their shares by weight, none more than it can give (its
tokens times the epochs allowed); what a child can't take goes to its siblings
by weight, and only what all of them can't take has been kept back by the level above,
whose own siblings then get it.  A leaf gives whole seeded epochs and a prefix of the
next one: the documents of least md5(seed:epoch:doc_id) whose running sum of tokens
stays within the rest.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, named, part_of, release

LEVELS = ("domain", "lang", "source")
WORDS = r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')"
#: A table of leaves of at most so many rows is broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 20_000


@dataclass(frozen=True)
class Mix:
    """weights: whole numbers by the path of a node, e.g. ("web",) or ("web", "en"); others have 1.

    budget: tokens, or None for a share of those of the input (a fraction, all by default).  tokens,
    domain: SQL expressions over the columns of documents.
    """

    weights: dict[tuple[str, ...], int] = field(default_factory=dict)
    budget: int | None = None
    share: tuple[int, int] = (1, 1)
    epochs: int = 2
    seed: str = "mix"
    tokens: str = WORDS
    domain: str = r"coalesce(concat('d', pmod(cast(nullif(regexp_extract(source, '([0-9]{1,9})$', 1), '') as int), 4)), 'other')"


def _leaves(documents: DataFrame, mix: Mix, keep: list[str] | None = None) -> DataFrame:
    """The leaf and tokens of each row; keep: its columns, as one struct, so that no name of theirs can clash."""
    row = [] if keep is None else [F.struct(*named(keep)).alias("__row")]
    return documents.select(
        *row, F.expr(mix.domain).alias("__domain"), F.coalesce("lang", F.lit("?")).alias("__lang"), F.coalesce("source", F.lit("?")).alias("__source"), F.coalesce(F.expr(mix.tokens), F.lit(0)).cast("long").alias("__tokens"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("__id"),
    )


def _order(mix: Mix) -> F.Column:
    return F.md5(F.concat_ws(":", F.lit(mix.seed), F.col("whole").cast("string"), F.col("__id")).cast("binary"))


def _weight(path: list[str], mix: Mix) -> F.Column:
    own = {k: v for k, v in mix.weights.items() if len(k) == len(path)}
    column = F.lit(1)
    for key, value in own.items():
        column = F.when(F.concat_ws("\x1f", *path) == "\x1f".join(key), value).otherwise(column)
    return column.cast("double")


#: Steps of the ratio of cap and weight, to each doubling, in which the children of a node are summed before any are sorted.
STEPS = 64


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Give each parent's `grant` to its children: columns w (weight) and cap become a whole number `name`.

    A child is full if its cap is at most its share at the level (tokens per
    weight) at which all of the grant is given; the others get their weight times that level.  Children are first
    summed by steps of cap per weight, a few thousand rows for a node however many children it has; only those in the step where
    the level lies are sorted themselves.
    """
    ratio = F.col("cap") / F.col("w")
    own = [c for c in children.columns if c.startswith("__")]
    rows = children.withColumn("ratio", ratio).withColumn("step", F.floor(F.log2(ratio + 1) * STEPS).cast("int"))
    last = F.max_by(F.struct("cap", "w", "ratio"), F.struct("ratio", *own)).alias("last")
    steps = rows.groupBy(*parent, "step").agg(F.sum("cap").alias("caps"), F.sum("w").alias("ws"), F.max("grant").alias("grant"), last)
    order = Window.partitionBy(*parent).orderBy("step")
    before = F.coalesce(F.sum("caps").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = steps.withColumn("before", before).withColumn("from_here", F.sum("ws").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    # a step is full if its last child is, when all others of it are: levels only rise while children are full
    at_last = (F.col("grant") - F.col("before") - (F.col("caps") - F.col("last.cap"))) / (F.col("from_here") - (F.col("ws") - F.col("last.w")))
    ends = steps.where(F.col("last.ratio") > at_last).groupBy(*parent).agg(F.min(F.struct("step", "before", "from_here", "ws")).alias("end"))
    ends = ends.select(*parent, F.col("end.step").alias("end"), F.col("end.before").alias("before"), (F.col("end.from_here") - F.col("end.ws")).alias("behind"))
    # of the children in that step, by cap per weight, the first that isn't full sets the level of all behind it
    w = Window.partitionBy(*parent).orderBy("ratio", *own)
    inside = rows.join(ends, parent).where("step = end")
    caps = F.col("before") + F.coalesce(F.sum("cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (F.col("grant") - caps) / (F.col("behind") + F.sum("w").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    found = inside.withColumn("level", level).withColumn("place", F.row_number().over(w)).where("ratio > level").groupBy(*parent).agg(F.min(F.struct("place", "level")).alias("first"))
    levels = found.select(*parent, F.col("first.level").alias("level"))
    full = F.col("level").isNull() | (F.col("ratio") <= F.col("level"))
    done = rows.join(levels, parent, "left")
    return done.withColumn(name, F.when(full, F.col("cap")).otherwise(F.floor(F.col("w") * F.col("level"))).cast("long")).drop("level", "ratio", "step")


def budgets(documents: DataFrame, mix: Mix, rows: DataFrame | None = None) -> DataFrame:
    """One row per leaf: __domain, __lang, __source, docs, tokens, cap (tokens times epochs), grant.  rows: _leaves(documents, mix), if it is written already."""
    keys = ["__domain", "__lang", "__source"]
    leaves = materialize((_leaves(documents, mix) if rows is None else rows).groupBy(*keys).agg(F.count("*").alias("docs"), F.sum("__tokens").alias("tokens")).withColumn("cap", F.col("tokens") * mix.epochs), "leaves")
    total = (leaves.agg(F.sum("tokens").alias("t")).first()["t"] or 0) * mix.share[0] // mix.share[1]
    grants = leaves.select(F.lit("").alias("__root"), *keys, "cap")
    level = None
    for depth in range(1, len(keys) + 1):
        path = keys[:depth]
        nodes = grants.groupBy("__root", *path).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(path, mix))
        if level is None:
            nodes = nodes.withColumn("grant", F.lit(float(total if mix.budget is None else mix.budget)))
        else:
            nodes = nodes.join(level, ["__root", *path[:-1]])
        # each level is written: its plan reads the nodes several times, and three levels would read them that often to the third power
        nodes = materialize(nodes, "nodes")
        level = materialize(share_out(nodes, ["__root", *path[:-1]], "given").select("__root", *path, F.col("given").alias("grant")), "level")
        release(nodes)
    return leaves.join(level.drop("__root"), keys)


def mix_sources(documents: DataFrame, mix: Mix | None = None) -> DataFrame:
    """The documents chosen, once per epoch, with columns epoch, domain and n_tokens.

    Rows are chosen whole; columns epoch, domain and n_tokens of the input are
    replaced.  A null language or source is the leaf "?"; null and empty texts
    have no tokens and go with the epochs of their leaf.  Rows with equal doc_id in a leaf
    are chosen together.  A leaf without tokens gives one epoch.  A leaf's choice is its number of epochs and one limit of
    the order, so texts aren't shuffled as long as there are at most BROADCAST_ROWS leaves; with more
    each text is shuffled once, to its leaf's limit.  Words are counted once for the budgets and once as the rows are chosen.
    """
    mix = mix or Mix()
    keys = ["__domain", "__lang", "__source"]
    keep = [c for c in documents.columns if c not in ("epoch", "domain", "n_tokens")]
    counted = materialize(_leaves(documents, mix), "counted")
    leaves = budgets(documents, mix, counted)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("grant") / F.col("tokens"))).otherwise(1).cast("int")
    leaves = materialize(leaves.withColumn("whole", whole).withColumn("rest", F.when(F.col("tokens") > 0, F.col("grant") - F.col("whole") * F.col("tokens")).otherwise(0)), "grants")
    stats = leaves.agg(F.count("*").alias("n"), F.max("docs").alias("most")).first()
    small = (lambda df: F.broadcast(df)) if stats["n"] <= BROADCAST_ROWS else (lambda df: df)
    digits = 1
    while digits < 8 and (stats["most"] or 0) / 16**digits > 500:
        digits += 1
    rows = counted.join(small(leaves.select(*keys, "whole", "rest")), keys).withColumn("__order", _order(mix))
    # the bucket of orders in which a leaf's prefix ends, then the row within it
    part = rows.where("rest > 0").withColumn("__bucket", F.substring("__order", 1, digits))
    buckets = part.groupBy(*keys, "__bucket").agg(F.sum("__tokens").alias("t"), F.max("rest").alias("rest"))
    upto = F.sum("t").over(Window.partitionBy(*keys).orderBy("__bucket"))
    ends = materialize(buckets.withColumn("upto", upto).where("upto > rest").groupBy(*keys).agg(F.min(F.struct("__bucket", (F.col("upto") - F.col("t")).alias("before"))).alias("b")).select(*keys, "b.__bucket", "b.before"), "ends")
    last = part.select(*keys, "__bucket", "__order", "__tokens", "rest").join(small(ends), [*keys, "__bucket"])
    running = F.col("before") + F.sum("__tokens").over(Window.partitionBy(*keys).orderBy("__order"))
    inside = last.withColumn("running", running).where("running <= rest").groupBy(*keys).agg(F.max("__order").alias("limit"))
    # a leaf whose bucket gives no row ends below that bucket
    limits = ends.join(inside, keys, "left").select(*keys, F.coalesce("limit", F.col("__bucket")).alias("limit"))
    limits = materialize(leaves.select(*keys, "whole", "rest").join(limits, keys, "left"), "limits")
    release(counted, ends)
    chosen = _leaves(documents, mix, keep).join(small(limits), keys)
    more = (F.col("rest") > 0) & (F.col("limit").isNull() | (_order(mix) <= F.col("limit")))
    chosen = chosen.withColumn("__n", F.col("whole") + more.cast("int")).where("__n > 0")
    rows = chosen.select("__row", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("epoch"), "__domain", "__tokens")
    return rows.select(*[part_of("__row", c) for c in keep], "epoch", F.col("__domain").alias("domain"), F.col("__tokens").alias("n_tokens"))
