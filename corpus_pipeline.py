"""The corpus pipeline: toxicity, near duplicates, repeated passages, source mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.byte_bpe import encode_documents
from larkspur.llm.mixing import Mix, mix_sources
from larkspur.llm.ngram_join import drop_near_duplicates
from larkspur.llm.shared import materialize, release, scratch
from larkspur.llm.substring_dedup import dedup_passages
from larkspur.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; labels of the held-out fold are never learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, fit_toxicity(docs, labels)).where("predicted = 0").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the least doc_id stays."""
    return drop_near_duplicates(docs).select(*COLUMNS)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words stay where they occur first; n_chars follows the text, a document without text stays."""
    return dedup_passages(docs, 50).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal weights at each node, as many tokens as there are, two epochs at most; a document of two epochs is two rows."""
    return mix_sources(docs, Mix(epochs=2)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their digests."""
    return encode_documents(docs, str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_copies), ("substring_dedup", drop_passages), ("mixing", mix), ("byte_bpe", encode)]

#: Shingle similarity, learned lexicons and content-defined units aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage has written for itself goes when its result is written, and that one when the next is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir), name))
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
