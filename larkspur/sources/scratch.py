"""Folders for what a query writes and reads again; they go at the end of the session."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that have been handed out and not removed.
_LIVE: dict[str, SparkSession] = {}


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder with all that is in it, wherever Spark's paths lead."""
    with contextlib.suppress(Exception):  # the session may have ended
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def release_scratch() -> None:
    """Remove all folders of scratch_dir(); what reads them must have been run."""
    while _LIVE:
        path, spark = _LIVE.popitem()
        remove(spark, path)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; a temporary one where that is unset and there is one local JVM."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not found and master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
    path = f"{found}/{name}-{uuid.uuid4().hex}" if found else f"file://{tempfile.mkdtemp(prefix=f'larkspur-{name}-')}"
    _LIVE[path] = spark
    return path


def written(rows: DataFrame, path: str) -> DataFrame:
    """The rows, written to path once and read from there."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
