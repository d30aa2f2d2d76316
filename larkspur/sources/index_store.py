"""The chunk index: snapshots of Parquet files in buckets of doc_id and, within them, folders by exams.

A manifest names the folder of each bucket; readers follow the newest one.  A write puts new files beside the old
ones and its manifest last, in one step, so that a reader sees the state before or behind a write and never a part
of it, and a write that fails changes nothing.  Old files are removed later (vacuum).  Documents are replaced by their
buckets, and a search for some exams reads only the folders that have one of them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import IndexSpec
from .jsonl import exists
from .scratch import remove

_MANIFESTS = "_manifests"


class IndexConflict(RuntimeError):
    """Another write has been committed since this one began."""


def point_id(*columns: str) -> F.Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def to_points(chunks: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """point_id, doc_id, content, metadata (without n_tokens) and, joined by point_id, the vectors."""
    meta = F.struct("doc_id", "doc_name", "doc_date", "source_url", "exams_id", "tema", "tipo_seccion", "seccion")
    points = chunks.select(point_id("doc_id", "section_seq", "part_seq").alias("point_id"), "doc_id", "content", meta.alias("metadata"))
    return points if vectors is None else points.join(vectors, "point_id", "left")


def _bucket(spec: IndexSpec) -> F.Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(spec.buckets)).cast("int")


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, spec: IndexSpec) -> list[int]:
    """Committed versions, oldest first."""
    folder = f"{spec.path}/{_MANIFESTS}"
    if not exists(spark, folder):
        return []
    fs, p = _files(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, spec: IndexSpec, version: int | None = None) -> dict:
    """version, schema and the folder of each bucket (relative to the index) of a version, by default the newest; of none without any."""
    known = versions(spark, spec)
    if version is None and not known:
        return {"version": 0, "schema": None, "buckets": {}}
    if version is not None and version not in known:
        raise ValueError(f"version {version} is none of {known}")
    path = f"{spec.path}/{_MANIFESTS}/{known[-1] if version is None else version:010d}.json"
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _commit(spark: SparkSession, spec: IndexSpec, state: dict) -> None:
    """Write the manifest under another name, then give it its own in one step, which fails if there is one of this version."""
    final = f"{spec.path}/{_MANIFESTS}/{state['version']:010d}.json"
    held = f"{spec.path}/{_MANIFESTS}/.{uuid.uuid4().hex}"
    fs, p = _files(spark, held)
    out = fs.create(p, False)
    try:
        out.write(json.dumps(state).encode())
    finally:
        out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(p, jvm.org.apache.hadoop.fs.Path(final), options)
    except Exception as e:
        fs.delete(p, False)
        if "FileAlreadyExists" in str(e):
            raise IndexConflict(f"version {state['version']} of {spec.path} has been committed by another write") from e
        raise


def _write(points: DataFrame, spec: IndexSpec, version: int) -> str:
    """Write points into a folder of their own; as many tasks as the data needs: buckets are rebalanced, large ones over several tasks and files."""
    folder = f"snapshot={version}-{uuid.uuid4().hex[:12]}"
    exams = F.concat_ws("|", F.sort_array(F.array_distinct(F.coalesce("metadata.exams_id", F.array().cast("array<string>")))))
    rows = points.withColumn("bucket", _bucket(spec)).withColumn("exams", exams).hint("rebalance", "bucket", "exams")
    rows.write.partitionBy("bucket", "exams").parquet(f"{spec.path}/{folder}")
    return folder


def _held(spark: SparkSession, spec: IndexSpec, folder: str) -> dict[str, str]:
    """The buckets that a snapshot's folder has."""
    fs, p = _files(spark, f"{spec.path}/{folder}")
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return {n.removeprefix("bucket="): f"{folder}/{n}" for n in names if n.startswith("bucket=")}


def write_index(points: DataFrame, spec: IndexSpec, doc_ids: list[str] | DataFrame | None = None) -> int:
    """Commit a new version and return its number.

    Without ids (or with an empty list) the index is made anew; otherwise only those documents (a list, or a table with doc_id)
    are replaced, and only their buckets written.  Raises IndexConflict, with nothing changed, where another write was
    committed in between.
    """
    spark = points.sparkSession
    old = manifest(spark, spec)
    version = old["version"] + 1
    whole = doc_ids is None or (isinstance(doc_ids, list) and not doc_ids)
    buckets: dict[str, str] = {}
    fresh = points
    if not whole:
        ids = spark.createDataFrame([(i,) for i in sorted(set(doc_ids))], "doc_id string") if isinstance(doc_ids, list) else doc_ids.select("doc_id").distinct()
        fresh = points.join(ids, "doc_id", "left_semi")
        if old["version"]:
            touched = {str(r[0]) for r in ids.select(_bucket(spec).alias("b")).distinct().collect()}  # spec.buckets at most
            buckets = {b: folder for b, folder in old["buckets"].items() if b not in touched}
            kept = _read(spark, spec, {**old, "buckets": {b: f for b, f in old["buckets"].items() if b in touched}}).drop("bucket", "exams", "snapshot")
            fresh = kept.join(ids, "doc_id", "left_anti").unionByName(fresh, allowMissingColumns=True)
    folder = _write(fresh, spec, version)
    try:
        _commit(spark, spec, {"version": version, "schema": fresh.schema.jsonValue(), "buckets": {**buckets, **_held(spark, spec, folder)}})
    except Exception:
        remove(spark, f"{spec.path}/{folder}")
        raise
    return version


def _read(spark: SparkSession, spec: IndexSpec, state: dict) -> DataFrame:
    if state["schema"] is None:
        raise ValueError(f"no index at {spec.path}")
    schema = StructType.fromJson(state["schema"]).add("snapshot", "string").add("bucket", "integer").add("exams", "string")
    if not state["buckets"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", spec.path).parquet(*[f"{spec.path}/{folder}" for folder in state["buckets"].values()])


def read_index(spark: SparkSession, spec: IndexSpec, exams: tuple[str, ...] | None = None, version: int | None = None) -> DataFrame:
    """The points of a version (the newest); exams: only those of one of these exams, from the folders that have them.

    What has been read stays readable until a vacuum, whatever is written in between.
    """
    found = _read(spark, spec, manifest(spark, spec, version))
    if exams is not None:
        found = found.where(F.arrays_overlap(F.split("exams", r"[|]"), F.array(*[F.lit(e) for e in exams]).cast("array<string>")))
    return found.drop("snapshot", "bucket", "exams")


def vacuum(spark: SparkSession, spec: IndexSpec, keep: int = 1) -> int:
    """Remove all but the newest `keep` versions and the files that none of those names; returns how many folders went.

    Not while a write is under way: its files have no manifest yet.
    """
    known = versions(spark, spec)
    for v in known[:-keep]:
        remove(spark, f"{spec.path}/{_MANIFESTS}/{v:010d}.json")
    used = {folder for v in known[-keep:] for folder in manifest(spark, spec, v)["buckets"].values()}
    fs, p = _files(spark, spec.path)
    gone = 0
    for snapshot in [s.getPath().getName() for s in fs.listStatus(p)]:
        if snapshot.startswith("snapshot="):
            unused = [f for f in _held(spark, spec, snapshot).values() if f not in used]
            for folder in unused:
                remove(spark, f"{spec.path}/{folder}")
            gone += len(unused)
            if not any(f.startswith(f"{snapshot}/") for f in used):
                remove(spark, f"{spec.path}/{snapshot}")
    return gone


def scroll_sections(index: DataFrame, doc_id: str) -> DataFrame:
    return index.where(F.col("doc_id") == doc_id).select("metadata.seccion", "metadata.tipo_seccion")
