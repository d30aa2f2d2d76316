"""What the operators share: scratch tables, input columns and the labelled sample."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

CHECKPOINT = "spark.checkpoint.dir"
#: Rows of an Arrow batch while a scratch table is written.
ARROW_ROWS = 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where it is unset a single local JVM gets a temporary folder; on a cluster, whose executors
    would each write to a folder of their own, that raises.
    """
    found = spark.conf.get(CHECKPOINT, None) or spark.sparkContext.getConf().get(CHECKPOINT, None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"{CHECKPOINT} must name a folder that all executors share (master {master})")
        found = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set(CHECKPOINT, found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Scratch tables that have not been removed, in the order they were written.
_LIVE: dict[str, SparkSession] = {}


@atexit.register
def _remove_all() -> None:
    for path, spark in _LIVE.items():
        _remove(spark, path)


def materialize(df: DataFrame, name: str, **stats: Column) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, survives lost executors.

    Shuffle files of the write are removed when it ends.  stats: aggregates over the rows written,
    found without another job; the result holds them in `stats`.  The tables lie in a folder named by the
    application, so that what an application that died has left can be told and removed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larkspur-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    held = {rows: min(ARROW_ROWS, int(before)) if int(before) > 0 else ARROW_ROWS, "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}  # long texts: smaller batches
    before = {k: spark.conf.get(k, None) for k in held}
    seen = Observation() if stats else None
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        (df.observe(seen, *[c.alias(k) for k, c in stats.items()]) if seen else df).write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    _LIVE[path] = spark
    written = spark.read.schema(df.schema).parquet(path)
    written.scratch_path, written.stats = path, seen.get if seen else {}
    return written


def release(*tables: DataFrame) -> None:
    """Remove tables of materialize() that nothing still to be run reads."""
    for df in tables:
        _LIVE.pop(df.scratch_path, None)
        _remove(df.sparkSession, df.scratch_path)


@contextlib.contextmanager
def scratch():
    """What is written inside and isn't given to the function this yields is removed at the end."""
    before, kept = set(_LIVE), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.scratch_path)
        return df

    try:
        yield keep
    finally:
        for path in [p for p in _LIVE if p not in before and p not in kept]:
            _remove(_LIVE.pop(path), path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _trim() -> None:
    """Give freed memory back to the system: Python workers live on after a task, and what they keep adds up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """A map over batches that gives its memory back at the end of a task."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _trim()

    return wrapped


def named(columns: Iterable[str]) -> list[Column]:
    """Columns by their names, whatever signs these have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def part_of(row: str, name: str) -> Column:
    """A field of a struct column by its name."""
    return F.col(row).getField(name).alias(name)


def extended(schema: StructType, more: str, without: tuple[str, ...] = ()) -> StructType:
    """The fields of a schema and further ones."""
    return StructType([f for f in schema.fields if f.name not in without] + _parse_datatype_string(more).fields)


def with_results(documents: DataFrame, keep: Iterable[str], inputs: dict[str, Column], run, more: str) -> DataFrame:
    """The columns `keep` and those that run adds to each row.

    run maps Arrow batches of `row` (the kept columns as one struct, so that none of their names
    can clash) and the inputs to batches of `row` and the columns of the DDL string `more`.
    """
    keep = list(keep)
    frame = documents.select(F.struct(*named(keep)).alias("row"), *[c.alias(name) for name, c in inputs.items()])
    schema = extended(frame.select("row").schema, more)
    return frame.mapInArrow(lean(run), schema).select(*[part_of("row", c) for c in keep], *schema.fieldNames()[1:])


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def labelled_sample(labels: DataFrame, label: str, folds: int, held_out: int, bound: int) -> DataFrame:
    """At most `bound` labelled ids outside the held-out fold, (doc_id, label), in hash order.

    Ids with a null or contradictory label take no part.  The bound holds at any
    size of the table, so the sample may be broadcast.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (crc_fold("doc_id", folds) != held_out))
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other"))
        .where("label = other AND label IN (0, 1)")
        .select("doc_id", "label")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
