"""Artifacts of JSON lines: append, reset and tolerant reading.

Each append is a folder of its own with the next number, which gets its name when all its files are written: a record
is there once or not at all, and later appends are later in order whatever the clocks say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType, _parse_datatype_string

from .files import last_write_wins

_BROKEN = "__broken"


def _number(name: str) -> int:
    return int(name.removeprefix("batch=")) if name.startswith("batch=") and name[6:].isdigit() else 0


def appends(spark: SparkSession, path: str) -> int:
    """The number of the last append; 0 without any."""
    if not exists(spark, path):
        return 0
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return max([_number(s.getPath().getName()) for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)], default=0)


def append(rows: DataFrame, path: str) -> int:
    """Record rows behind all that is there; returns the number of this append.  One that fails leaves nothing to be read."""
    spark = rows.sparkSession
    held = f"{path.rstrip('/')}/_{uuid.uuid4().hex}"
    rows.write.option("ignoreNullFields", "false").json(held)
    jvm = spark._jvm
    source = jvm.org.apache.hadoop.fs.Path(held)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    while True:
        number = appends(spark, path) + 1
        try:
            context.rename(source, jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/batch={number:010d}"), options)
            return number
        except Exception as x:  # another append has taken this number
            if "AlreadyExists" not in str(x) and "not empty" not in str(x):
                raise


def reset(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def parse_lines(lines: DataFrame, schema: str) -> DataFrame:
    """lines: file, number (anything that orders the lines of a file), value.  Parsed rows with file and number.

    Blank lines are skipped.  A broken line is dropped if it is the very last
    of its file (blank ones included), and raises elsewhere.
    """
    wanted: StructType = _parse_datatype_string(schema)
    whole = StructType([*wanted.fields]).add(_BROKEN, StringType())
    last = lines.groupBy("file").agg(F.max("number").alias("last"))  # one row for each file, however long these are
    parsed = lines.where(F.trim("value") != "").join(last, "file").withColumn("r", F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}))
    broken = F.col(f"r.{_BROKEN}").isNotNull()
    kept = parsed.where(~(broken & (F.col("number") == F.col("last"))))
    checked = F.when(broken, F.raise_error(F.concat(F.lit("broken line "), F.substring("value", 1, 80)))).otherwise(F.col("number"))
    return kept.select("file", checked.alias("number"), *[f"r.{f.name}" for f in wanted.fields])


def load_completed(spark: SparkSession, path: str, schema: str, key: str = "row_id") -> DataFrame:
    """The last record of each key; no rows where there is no file.

    Appends go in the order of their numbers; files that lie in the folder itself come first, in the order of their times.
    Files are read in splits by line; a line's place is its split's and its number in there.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    m = F.col("_metadata")
    batch = F.coalesce(F.nullif(F.regexp_extract(m["file_path"], r"/batch=(\d+)/[^/]*$", 1), F.lit("")).cast("long"), F.lit(0))
    place = F.struct(batch.alias("batch"), F.when(batch == 0, m["file_modification_time"]).alias("at"), m["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("line"))
    rows = parse_lines(spark.read.option("recursiveFileLookup", "true").text(path).select(m["file_path"].alias("file"), place.alias("number"), "value"), schema)
    return last_write_wins(rows.withColumn("order", F.struct("number.batch", "number.at", "file", "number")), key, "order").drop("file", "number", "order")
