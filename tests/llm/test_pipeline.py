"""Every stage of the pipeline against brute force or its own promise, on its own input."""

from __future__ import annotations

import random

import corpus_pipeline as P
import pytest
from helpers import edited, prose
from larkspur.llm.queries import ORACLE, QUERIES
from larkspur.llm.shared import materialize

TERMS = ["idiota", "basurero", "maldito", "cretino"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(9)
    folder = tmp_path_factory.mktemp("sf")
    passage = prose(rng, 65)
    docs, labels = [], []
    for i in range(500):
        text = prose(rng, rng.randint(40, 90))
        toxic = i % 5 == 0
        if toxic:
            text = " ".join(w + (" " + rng.choice(TERMS) if j % 9 == 4 else "") for j, w in enumerate(text.split(" ")))
        elif i % 25 == 1:
            text += " " + passage
        docs.append((i, text))
        labels.append((i, 1, int(toxic)))
    docs += [(600 + i, edited(rng, docs[3 + i][1], 0.005)) for i in range(1, 20) if (3 + i) % 5]
    docs += [(700, None), (701, ""), (702, ""), (703, docs[2][1]), (703, docs[2][1]), (None, "solo una línea")]
    full = [(i, t, ["en", "de"][(i or 0) % 2], f"src{(i or 0) % 7}", len(t or "")) for i, t in docs]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    return f"file://{folder}", passage


def test_stages(spark, tables):
    sf_dir, passage = tables
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "mixing", "byte_bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    steps = {}
    for name, stage in P.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        steps[name] = docs
        if name != "byte_bpe":
            assert docs.columns == list(P.COLUMNS)
    toxic = {i for i in range(500) if i % 5 == 0}
    kept = [r.doc_id for r in steps["toxicity"].collect()]
    assert not toxic & set(kept)
    assert sorted(map(str, kept)) == sorted(str(r.doc_id) for r in before.collect() if r.doc_id not in toxic)
    once = [r.doc_id for r in steps["near_duplicates"].collect()]
    assert 703 not in once and not [i for i in once if i is not None and 600 < i < 620] and set(once) >= {i for i in range(500) if i % 5} | {700, 701, 702, None}
    texts = {r.doc_id: r for r in steps["substring_dedup"].collect()}
    assert sum(passage in (r.text or "") for r in texts.values()) == 1 and len(texts) == len(once)
    assert all(r.n_chars == len(r.text) for r in texts.values() if r.text is not None)
    assert steps["mixing"].join(steps["substring_dedup"], "doc_id", "left_anti").where("doc_id IS NOT NULL").count() == 0
    assert steps["byte_bpe"].count() == steps["mixing"].count()
    assert P.run(spark, sf_dir).count() == steps["byte_bpe"].count()


def test_clashing_columns_and_long_texts(spark, tables, tmp_path):
    """Further columns with names that stages use themselves, and a text of a million words that goes through every stage."""
    rng = random.Random(4)
    long = " ".join(f"{rng.getrandbits(30):x}" for _ in range(150_000))
    docs = spark.createDataFrame([(1, long, "en", "src1", 0), (2, long + " fin", "en", "src1", 0), (3, None, None, None, None), (4, "uno dos " * 200_000, "de", "src2", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("row", "key", "score", "epoch", "removed", "__row", "predicted", "domain"):
        docs = docs.withColumn(name, docs["doc_id"])
    for name, stage in P.STAGES:
        docs = materialize(stage(spark, docs, tables[0]) if name != "mixing" else docs, name)
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == {1, 3, 4} and got[1].n_tokens > 150_000 and got[3].n_tokens == 0
    assert {r.doc_id for r in P.mix(spark, spark.createDataFrame([(1, long, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long"), tables[0]).collect()} == {1}


def test_scratch_goes(spark, tables):
    """Behind a run only the last stage's input is left in the shared folder."""
    from larkspur.llm import shared

    before = set(shared._LIVE)
    assert P.run(spark, tables[0]).count()
    left = [p for p in shared._LIVE if p not in before]
    assert len(left) == 1 and "/mixing-" in left[0]


def test_empty(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, tables[0])
    assert docs.count() == 0


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)] and set(ORACLE) <= set(QUERIES)
