"""Scratch tables: where they lie, what they know, and when they go."""

from __future__ import annotations

import os
from types import SimpleNamespace

import pytest
from larkspur.llm import shared
from pyspark.sql import functions as F


def session(master, found=None):
    conf = {"spark.checkpoint.dir": found} if found else {}
    store = SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__)
    return SimpleNamespace(conf=store, sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k, d=None: d)))


def test_no_shared_folder_on_a_cluster():
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,3000]", "k8s://h"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared.shared_dir(session(master))
        assert shared.shared_dir(session(master, "s3://b/x")) == "s3://b/x"
    one = session("local[4]")
    assert shared.shared_dir(one).startswith("file://") and shared.shared_dir(one) == shared.shared_dir(one)


def test_scratch_tables(spark):
    with shared.scratch() as keep:
        gone = shared.materialize(spark.range(10), "gone")
        kept = keep(shared.materialize(spark.range(7).repartition(3), "kept", n=F.count("*"), top=F.max("id")))
        again = shared.materialize(spark.range(0), "empty", n=F.count("*"))
    assert kept.stats == {"n": 7, "top": 6} and again.stats["n"] == 0
    local = lambda df: df.scratch_path.removeprefix("file://")
    assert os.path.isdir(local(kept)) and not os.path.isdir(local(gone)) and not os.path.isdir(local(again))
    assert spark.sparkContext.applicationId in kept.scratch_path
    assert kept.count() == 7
    shared.release(kept)
    assert not os.path.isdir(local(kept))
