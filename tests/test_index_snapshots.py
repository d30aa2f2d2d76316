"""Snapshots of the chunk index: readers see whole versions, failed writes change nothing."""

from __future__ import annotations

import pytest
from larkspur.config import IndexSpec
from larkspur.sources import index_store as I
from test_sources import chunks


@pytest.fixture
def spec(tmp_path):
    return IndexSpec(f"file://{tmp_path}/index", buckets=3)


def state(spark, spec, **more):
    return sorted((r.doc_id, r.content) for r in I.read_index(spark, spec, **more).collect())


def test_a_reader_keeps_what_it_has_opened(spark, spec):
    assert I.write_index(I.to_points(chunks(spark, [("a", 2, "x"), ("b", 1, "x")])), spec) == 1
    old = I.read_index(spark, spec)
    before = state(spark, spec)
    assert I.write_index(I.to_points(chunks(spark, [("a", 1, "y")])), spec, ["a"]) == 2
    assert sorted((r.doc_id, r.content) for r in old.collect()) == before == state(spark, spec, version=1)
    assert state(spark, spec) == [("a", "a 0 y"), ("b", "b 0 x")]
    with pytest.raises(ValueError, match="none of"):
        I.read_index(spark, spec, version=7)


@pytest.mark.parametrize("step", ["_write", "_commit"])
def test_a_write_that_is_killed_changes_nothing(spark, spec, monkeypatch, step):
    I.write_index(I.to_points(chunks(spark, [("a", 2, "x"), ("b", 1, "x")])), spec)
    before, real = state(spark, spec), getattr(I, step)

    def killed(*args):
        if step == "_write":
            real(*args)
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(I, step, killed)
        with pytest.raises(KeyboardInterrupt):
            I.write_index(I.to_points(chunks(spark, [("a", 1, "y")])), spec, ["a"])
    assert state(spark, spec) == before and I.versions(spark, spec) == [1]
    I.write_index(I.to_points(chunks(spark, [("a", 1, "z")])), spec, ["a"])
    assert state(spark, spec) == [("a", "a 0 z"), ("b", "b 0 x")]
    assert I.vacuum(spark, spec) > 0  # what the killed write has left goes, too
    assert state(spark, spec) == [("a", "a 0 z"), ("b", "b 0 x")]


def test_of_two_writes_at_once_one_is_refused(spark, spec, monkeypatch):
    I.write_index(I.to_points(chunks(spark, [("a", 1, "x")])), spec)
    real = I._write

    def slow(points, where, version):
        folder = real(points, where, version)
        with monkeypatch.context() as m:
            m.setattr(I, "_write", real)
            I.write_index(I.to_points(chunks(spark, [("b", 1, "other")])), spec, ["b"])
        return folder

    monkeypatch.setattr(I, "_write", slow)
    with pytest.raises(I.IndexConflict):
        I.write_index(I.to_points(chunks(spark, [("a", 1, "mine")])), spec, ["a"])
    assert state(spark, spec) == [("a", "a 0 x"), ("b", "b 0 other")]


def test_only_touched_buckets_are_written(spark, spec):
    I.write_index(I.to_points(chunks(spark, [(d, 1, "x") for d in "abcdefgh"])), spec)
    one = I.manifest(spark, spec)["buckets"]
    I.write_index(I.to_points(chunks(spark, [("a", 1, "y")])), spec, ["a"])
    two = I.manifest(spark, spec)["buckets"]
    assert len(one) == 3 and sum(one[b] != two[b] for b in one) == 1
    I.write_index(I.to_points(chunks(spark, [])), spec, list("abcdefgh"))
    assert state(spark, spec) == [] and len(state(spark, spec, version=2)) == 8
    assert I.vacuum(spark, spec, keep=1) == 4 and I.versions(spark, spec) == [3]


def test_no_index(spark, spec):
    with pytest.raises(ValueError, match="no index"):
        I.read_index(spark, spec)
