"""Corpus, metadata and question files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import QUESTION_TYPES
from ..functions.text import one_of, strip
from ..schemas import DATASET_COLUMNS, METADATA, METADATA_COLUMNS

#: The line that opens the consolidated text of a document.
CONSOLIDATED = r"(?Umd)^.*TEXTO CONSOLIDADO.*$"


def read_texts(spark: SparkSession, folder: str, in_order: bool = False) -> DataFrame:
    """doc_id (file stem), text of each .txt file; in_order: by doc_id, where the order is for people to read."""
    found = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    docs = found.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.txt$", 1).alias("doc_id"), F.col("value").alias("text"))
    return docs.orderBy("doc_id") if in_order else docs


def consolidated(text: F.Column) -> F.Column:
    """Without what stands before the line of the consolidated text, if there is exactly one such line."""
    once = F.regexp_count(text, F.lit(CONSOLIDATED)) == 1
    return F.when(once, F.substring(text, F.regexp_instr(text, F.lit(CONSOLIDATED)), F.length(text))).otherwise(text)


def read_pdfs(spark: SparkSession, folder: str, pages: Callable[[bytes], list[str]]) -> DataFrame:
    """doc_id, text of each .pdf file; pages: the extractor, bytes of a file to the texts of its pages."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "text": ["\n".join(pages(x)) for x in batch["content"]]})

    found = files.select("path", "content").mapInPandas(extract, "path string, text string")
    return found.select(F.regexp_extract("path", r"([^/]*)\.pdf$", 1).alias("doc_id"), consolidated(F.col("text")).alias("text"))


def read_corpus(spark: SparkSession, folder: str, pages: Callable[[bytes], list[str]] | None = None, export: str | None = None, files: bool = False) -> DataFrame:
    """Text files, or PDF files where an extractor is given; export: a folder for the extracted texts, as a table or (files) one file each."""
    docs = read_texts(spark, folder) if pages is None else read_pdfs(spark, folder, pages)
    if export:
        (export_text_files if files else export_texts)(docs, export)
    return docs


def export_texts(docs: DataFrame, folder: str) -> None:
    """Texts as one Parquet table, written over what was there."""
    docs.select("doc_id", "text").write.mode("overwrite").parquet(folder)


def export_text_files(docs: DataFrame, folder: str) -> None:
    """One <doc_id>.txt per document, written by Spark's text writer into a folder of its own.

    They lie in folders named doc_id=<id>; a line end closes the last line.
    """
    docs.select("doc_id", F.col("text").alias("value")).repartition("doc_id").write.mode("overwrite").partitionBy("doc_id").text(folder)


def check_columns(df: DataFrame, needed: tuple[str, ...]) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; blanks are empty, not null."""
    found = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    check_columns(found, METADATA_COLUMNS)
    return found.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in METADATA_COLUMNS])


def empty_metadata(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], METADATA)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions: row_id and the other columns, all trimmed strings."""
    found = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    check_columns(found, DATASET_COLUMNS)
    columns = {"row_id" if c == "id" else c: strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in DATASET_COLUMNS}
    columns["question_type"] = one_of(columns["question_type"], QUESTION_TYPES)
    return found.select(*[c.alias(name) for name, c in columns.items()])


def write_review(review: DataFrame, path: str) -> None:
    """One JSON object per document."""
    review.write.mode("overwrite").json(path)


def review_as_map(review: DataFrame) -> Iterator[str]:
    """The lines of one JSON object {doc_id: review}, in the order of ids; the driver holds one partition at a time."""
    rest = [c for c in review.columns if c != "doc_id"]
    rows = review.orderBy("doc_id").select("doc_id", F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("json"))
    before = "{"
    for row in rows.toLocalIterator():
        yield before
        before = f"  {json.dumps(row['doc_id'], ensure_ascii=False)}: {row['json']},"
    yield before.removesuffix(",")
    yield "}"


def last_write_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    latest = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")
