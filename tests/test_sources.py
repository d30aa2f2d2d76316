from __future__ import annotations

import json

import pytest
from larkspur.config import IndexSpec
from larkspur.functions.text import nfc, estimate_tokens, normalize_ref, one_of, pipe_split, strip
from larkspur.functions.vectors import cosine, unit
from larkspur.sources import files, jsonl
from larkspur.sources.index_store import read_index, scroll_sections, to_points, write_index
from pyspark.sql import functions as F


def test_texts(spark, tmp_path):
    (tmp_path / "b.txt").write_text("dos\nlíneas", encoding="utf-8")
    (tmp_path / "a.txt").write_text("uno", encoding="utf-8")
    (tmp_path / "c.md").write_text("no")
    docs = files.read_corpus(spark, f"file://{tmp_path}", export=f"file://{tmp_path}/out")
    assert sorted(map(tuple, docs.collect())) == [("a", "uno"), ("b", "dos\nlíneas")]
    assert [r.doc_id for r in files.read_texts(spark, f"file://{tmp_path}", in_order=True).collect()] == ["a", "b"]
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2
    files.read_corpus(spark, f"file://{tmp_path}", export=f"file://{tmp_path}/each", files=True)
    found = {p.parent.name: p.read_text(encoding="utf-8") for p in (tmp_path / "each").glob("doc_id=*/*.txt")}
    assert found == {"doc_id=a": "uno\n", "doc_id=b": "dos\nlíneas\n"}


def test_pdfs(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"uno|antes\nTEXTO CONSOLIDADO\nfin")
    docs = files.read_corpus(spark, f"file://{tmp_path}", pages=lambda raw: raw.decode().split("|"))
    assert list(map(tuple, docs.collect())) == [("x", "TEXTO CONSOLIDADO\nfin")]


def test_consolidated(spark):
    df = spark.createDataFrame([("a\nx TEXTO CONSOLIDADO y\nb",), ("TEXTO CONSOLIDADO\nTEXTO CONSOLIDADO",), ("nada",)], "t string")
    assert [r[0] for r in df.select(files.consolidated(F.col("t"))).collect()] == ["x TEXTO CONSOLIDADO y\nb", "TEXTO CONSOLIDADO\nTEXTO CONSOLIDADO", "nada"]


def test_csv(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('doc_id,doc_name,doc_date,source_url,exams_id,tema\nd1,"Ley ""x""",,,A1|A2,\n', encoding="utf-8")
    row = files.read_metadata(spark, f"file://{p}").first()
    assert (row.doc_name, row.doc_date, row.exams_id, row.tema) == ('Ley "x"', "", "A1|A2", "")
    p.write_text("doc_id,doc_name\nd1,x\n")
    with pytest.raises(ValueError, match="doc_date"):
        files.read_metadata(spark, f"file://{p}")
    q = tmp_path / "q.csv"
    q.write_text("﻿id,exam,question_type,question,ground_truth_answer,ground_truth_ref,ground_truth_doc_id\n 1 ,A2,standard, ¿qué? ,,r,d\n", encoding="utf-8")
    row = files.read_dataset(spark, f"file://{q}").first()
    assert (row.row_id, row.question, row.ground_truth_answer) == ("1", "¿qué?", "")
    q.write_text("id,exam,question_type,question,ground_truth_answer,ground_truth_ref,ground_truth_doc_id\n1,A2,otra,q,,r,d\n", encoding="utf-8")
    with pytest.raises(Exception, match="not one of"):
        files.read_dataset(spark, f"file://{q}").collect()


def test_jsonl(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    schema = "row_id string, v int"
    assert jsonl.load_completed(spark, f"file://{p}", schema).count() == 0
    p.write_text('{"row_id": "a", "v": 1}\n\n{"row_id": "b", "v": 2}\n{"row_id": "a", "v": 3}\n{"row_id": "c", "v"')
    assert sorted(map(tuple, jsonl.load_completed(spark, f"file://{p}", schema).collect())) == [("a", 3), ("b", 2)]
    p.write_text('{"row_id": "a", "v"\n{"row_id": "b", "v": 2}\n')
    with pytest.raises(Exception, match="broken line"):
        jsonl.load_completed(spark, f"file://{p}", schema).collect()
    p.write_text('{"row_id": "b", "v": 2}\n{"row_id": "a", "v"\n\n')
    with pytest.raises(Exception, match="broken line"):
        jsonl.load_completed(spark, f"file://{p}", schema).collect()
    folder = f"file://{tmp_path}/many"
    jsonl.append(spark.createDataFrame([("a", 1), ("b", None)], schema), folder)
    jsonl.append(spark.createDataFrame([("c", 1)], schema), folder)
    assert jsonl.load_completed(spark, folder, schema).count() == 3
    jsonl.reset(spark, folder)
    assert jsonl.load_completed(spark, folder, schema).count() == 0


def chunks(spark, rows):
    full = [(d, i, 0, f"{d} {i} {t}", "n", "", "", ["A1", "A2"], [], "articulo", f"Art. {i}", 3) for d, n, t in rows for i in range(n)]
    return spark.createDataFrame(full, "doc_id string, section_seq int, part_seq int, content string, doc_name string, doc_date string, source_url string, exams_id array<string>, tema array<string>, tipo_seccion string, seccion string, n_tokens int")


def test_index(spark, tmp_path):
    spec = IndexSpec(f"file://{tmp_path}/index", buckets=3)
    write_index(to_points(chunks(spark, [("a", 2, "x"), ("b", 1, "x"), ("c", 1, "x")])), spec, ["a", "b", "c"])
    write_index(to_points(chunks(spark, [("a", 3, "y"), ("c", 9, "y")])), spec, ["a", "b"])
    rows = read_index(spark, spec)
    assert sorted((r.doc_id, r.content[-1]) for r in rows.collect()) == [("a", "y")] * 3 + [("c", "x")]
    assert "n_tokens" not in rows.select("metadata.*").columns and rows.select("point_id").distinct().count() == 4
    assert scroll_sections(rows, "a").count() == 3
    assert read_index(spark, spec, ("A2", "C1")).count() == 4 and read_index(spark, spec, ("C1",)).count() == 0
    plan = read_index(spark, spec, ("C1",))._jdf.queryExecution().executedPlan().toString()
    assert "exams" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    write_index(to_points(chunks(spark, [("z", 1, "w")])), spec, [])
    assert [r.doc_id for r in read_index(spark, spec).collect()] == ["z"]


def test_review_map(spark):
    df = spark.createDataFrame([("b", 1, ["x"]), ("a", 2, [])], "doc_id string, n int, sections array<string>")
    assert json.loads("\n".join(files.review_as_map(df))) == {"a": {"n": 2, "sections": []}, "b": {"n": 1, "sections": ["x"]}}
    assert json.loads("\n".join(files.review_as_map(df.where("false")))) == {}


def test_strings(spark):
    df = spark.createDataFrame([("  a  b ",), (None,), ("é",)], "t string")
    assert [r[0] for r in df.select(normalize_ref(F.col("t"))).collect()] == ["a b", "", "é"]
    assert df.select(strip(F.col("t"))).first()[0] == "a  b"
    df = spark.createDataFrame([("",), (None,), ("A1||A2|",)], "t string")
    assert [r[0] for r in df.select(pipe_split(F.col("t"))).collect()] == [[], [], ["A1", "A2"]]
    df = spark.createDataFrame([("",), ("x",), ("xxx",), ("xxxx",)], "t string")
    assert [r[0] for r in df.select(estimate_tokens(F.col("t"))).collect()] == [0, 1, 1, 2]
    with pytest.raises(Exception, match="not one of"):
        df.select(one_of(F.col("t"), ("", "x"))).collect()


def test_only_texts_that_may_change_are_composed_in_python(spark):
    """All signs below U+0300 are composed as they stand; Python sees null for texts of such."""
    import unicodedata

    assert all(unicodedata.normalize("NFC", chr(i)) == chr(i) for i in range(0x300))
    assert all(unicodedata.normalize("NFC", chr(i) + chr(j)) == chr(i) + chr(j) for i in range(0x20, 0x300, 7) for j in range(0x300))
    rows = [("Artículo 1",), ("Arti\u0301culo 1",), ("한",), ("\u1112\u1161\u11ab",), ("\u212b",), ("\u02ff",), (None,), ("",)]
    df = spark.createDataFrame(rows, "t string")
    assert [r[0] for r in df.select(nfc(F.col("t"))).collect()] == [None if t is None else unicodedata.normalize("NFC", t) for (t,) in rows]
    plan = df.select(nfc(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN RLIKE" in plan and "ArrowEvalPython" in plan


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = df.select(cosine(F.col("a"), F.col("b")).alias("c"), unit(F.col("a")).alias("u")).collect()
    assert abs(got[0].c - 0.96) < 1e-12 and got[1].c is None and got[0].u == [0.6, 0.8] and got[1].u == [0.0, 0.0]
