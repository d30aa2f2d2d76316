from __future__ import annotations

from larkspur.queries import _containing


def test_short_passages(spark):
    docs = spark.createDataFrame([(1, "uno dos tres cuatro cincuenta seis siete"), (2, "dos tres"), (3, None), (4, "")], "doc_id long, body string")
    texts = ["dos", "os tre", "uno dos tres cuatro", "uno dos tres cuatro cinc", "no dos tres cuatro cincuenta se", "nada", "", None]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    got = {r.query_id: r.n for r in _containing(items, docs).collect()}
    bodies = [r.body for r in docs.collect() if r.body is not None]
    expected = {i: sum(t in b for b in bodies) for i, t in enumerate(texts) if t is not None}
    assert got == {i: n for i, n in expected.items() if n}
