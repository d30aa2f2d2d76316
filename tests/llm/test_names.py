"""Columns whose names the operators use themselves, or that need quoting."""

from __future__ import annotations

import public_tokenizers
import pytest
from larkspur.llm.byte_bpe import encode_documents
from larkspur.llm.html_extract import extract_pages
from larkspur.llm.license_scan import scan_licenses
from larkspur.llm.mixing import mix_sources
from larkspur.llm.ngram_join import drop_near_duplicates, near_duplicate_classes
from larkspur.llm.quality_classifier import fit_quality, score_quality
from larkspur.llm.quality_rules import quality_rules
from larkspur.llm.substring_dedup import dedup_passages
from larkspur.llm.toxicity import fit_toxicity, score_toxicity
from pyspark.sql import functions as F

NAMES = ["row", "key", "hash", "units", "node", "root", "whole", "rest", "limit", "unit", "token", "label", "words", "t", "grant", "a.b", "__row", "__text", "__html", "__tokens", "__domain", "component_id", "digest"]


@pytest.fixture(scope="module")
def docs(spark):
    base = [(1, "uno dos tres. " * 40, "en", "src1"), (2, "uno dos tres. " * 40, "de", None), (None, None, None, "x"), (3, "", "fr", "src2")]
    df = spark.createDataFrame(base, "doc_id long, text string, lang string, source string")
    for i, name in enumerate(NAMES):
        df = df.withColumn(name, F.struct(F.lit(i).alias("x.y"), F.lit(None).cast("string").alias("z")) if i % 3 == 0 else F.lit(str(i)))
    return df


def unchanged(got, docs, added=()):
    assert got.columns == [*docs.columns, *added]
    assert {str(r[docs.columns.index(n)]) for r in got.collect() for n in NAMES[:1]} <= {str(r[docs.columns.index(n)]) for r in docs.collect() for n in NAMES[:1]}
    return got.count()


def test_clashes(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert unchanged(dedup_passages(docs), docs, ("removed", "removed_words")) == 4
    assert unchanged(drop_near_duplicates(docs), docs) == 3
    assert unchanged(mix_sources(docs), docs, ("epoch", "domain", "n_tokens")) >= 3
    assert unchanged(score_quality(docs, fit_quality(docs, labels)), docs, ("score", "predicted")) == 4
    assert unchanged(score_toxicity(docs, fit_toxicity(docs, labels)), docs, ("score", "predicted")) == 4
    assert near_duplicate_classes(docs).count() == quality_rules(docs).count() == scan_licenses(docs).count() == 4
    path = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert encode_documents(docs, path, public_tokenizers.PATTERN, keep=("doc_id", "a.b")).count() == 4
    assert extract_pages(docs, page="text", keep=("doc_id", "a.b")).columns == ["doc_id", "a.b", "text", "n_chars"]
