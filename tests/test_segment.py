from __future__ import annotations

import itertools
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from larkspur.config import ChunkSpec
from larkspur.operators import segment as G
from larkspur.operators.patterns import LEGAL, PatternSet, find_title
from larkspur.operators.segment import chunk_review, drop_citations, layers, matches, numeric_sequence, resolve_headings, sections_of, segment, split_long
from larkspur.operators.splitter import Splitter, WordTokenizer
from pyspark.sql import functions as F

CASES = {
    "plain": ("Intro.\nArtículo 1. Uno.\nArtículo 2. Dos.", ["preambulo", "articulo", "articulo"]),
    "no_preamble": ("Artículo 1. Uno.\nArtículo 2. Dos.", ["articulo", "articulo"]),
    "open_quote": ("Artículo 1. Se modifica «\nArtículo 91. Texto.\n»\nArtículo 2. Fin.", ["articulo", "articulo"]),
    "quoted_line": ("Artículo 1. Uno.\n«Artículo 91. Otro.»\nArtículo 2. Fin.", ["articulo", "articulo"]),
    "category_ordinals": ("DISPOSICIONES FINALES\nPrimera. a\nSegunda. b", ["preambulo", "disposicion", "disposicion"]),
    "category_alone": ("DISPOSICIÓN FINAL\nTexto", ["disposicion"]),
    "ordinal_first": ("Primero. x\nArtículo 1. y\nSegundo. z", ["articulo", "articulo"]),
    "numbers": ("1. a\n2. b\n3. c", ["articulo"] * 3),
    "stray_number": ("1. a\n7. p\n2. b\n3. c", ["none"]),
    "two_numbers": ("1. a\n2. b", ["none"]),
    "numbered_body": ("1. a\n2. b\n3. c\nDisposición final única. d", ["articulo"] * 3 + ["disposicion"]),
    "annex": ("Artículo 1. a\nANEXO I\nArtículo 9. z\nANEJO\nw", ["articulo", "anexo", "anexo"]),
    "annex_boundary": ("Primero.\n\nANEXO", ["none", "anexo"]),
    "chapters": ("Antes\nCAPÍTULO II Uno\na\nCAPÍTULO 3 Dos\nb", ["preambulo", "capitulo", "capitulo"]),
    "titles": ("TÍTULO 1 Uno\na", ["titulo"]),
    "prose": ("nada que cortar", ["none"]),
    "nbsp": ("Artículo 1. Uno.", ["articulo"]),
    "doc198": ("Artículo 1. Uno.\nArtículo 2. Dos.", ["none"]),
    "embedded": ("Artículo 1. fuera\nPLAN GENERAL DE CONTABILIDAD\n«Artículo 1. dentro\nArtículo 2. más", ["preambulo", "articulo", "articulo"]),
    "embedded_twice": ("fuera\nPLAN GENERAL DE CONTABILIDAD\nmedio\nREGLAMENTO DE\nREUTILIZACIÓN DEL AGUA\nArtículo 1. dentro", ["preambulo", "preambulo", "articulo"]),
    "empty": ("", []),
    "null": (None, []),
}


@pytest.fixture(scope="module")
def sections(spark):
    docs = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "doc_id string, text string")
    found = segment(docs).collect()
    return {k: sorted((r for r in found if r.doc_id == k), key=lambda r: r.section_seq) for k in CASES}


@pytest.mark.parametrize("case", CASES)
def test_cases(sections, case):
    assert [r.tipo_seccion for r in sections[case]] == CASES[case][1]
    assert [r.section_seq for r in sections[case]] == list(range(len(sections[case])))


def test_names(sections):
    assert [r.seccion for r in sections["category_ordinals"]] == [None, "DISPOSICIONES FINALES Primera.", "DISPOSICIONES FINALES Segunda."]
    assert sections["annex"][0].content == "Artículo 1. a"
    assert sections["annex"][1].content == "ANEXO I\nArtículo 9. z"
    assert [r.content for r in sections["embedded"]] == ["Artículo 1. fuera", "Artículo 1. dentro", "Artículo 2. más"]
    assert {r.level for r in sections["chapters"]} == {"capitulo"}
    assert {r.level for r in sections["prose"]} == {"documento completo"}


@pytest.mark.parametrize("name", ["Artículo 26 quáter.", "Artículo ciento treinta y dos.", "Disposición adicional vigésima quinta.", "Artículo cuatrocientos uno.", "Disposición final decimotercera terdecies."])
def test_whole_headings(spark, name):
    docs = spark.createDataFrame([("d", f"{name} Texto.")], "doc_id string, text string")
    assert [r.seccion for r in segment(docs).collect()] == [name]


def fold(kinds):
    """What a walk over the tags gives: (place, type) of the sections."""
    out, pending, seen = [], False, False
    for i, kind in enumerate(kinds):
        if kind == "category":
            seen = True
            pending = i + 1 < len(kinds) and kinds[i + 1] == "ordinal"
            if not pending:
                out.append((i, "disposicion"))
        elif kind == "ordinal":
            if pending:
                out.append((i, "disposicion"))
            elif not seen:
                out.append((i, "articulo"))
        else:
            pending, seen = False, True
            out.append((i, "articulo"))
    return out


def test_windows_equal_the_walk(spark):
    runs = [list(x) for n in range(1, 6) for x in itertools.product(("heading", "category", "ordinal"), repeat=n)]
    rows = [(j, i, k, f"h{i}") for j, run in enumerate(runs) for i, k in enumerate(run)]
    tags = spark.createDataFrame(rows, "doc_id int, start int, kind string, heading string")
    found = {}
    for r in resolve_headings(tags, ("doc_id",)).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.tipo_seccion))
    for j, run in enumerate(runs):
        assert sorted(found.get(j, [])) == fold(run), run


def test_map_equals_windows(spark):
    """The rules of the map and those for tables of marks say the same, quotations included."""
    pieces = {"h": "Artículo 1. x\n", "c": "DISPOSICIONES FINALES\n", "o": "Primera. x\n", "(": "dice «\n", ")": "fin»\n"}
    runs = [x for n in range(1, 6) for x in itertools.product(pieces, repeat=n)]
    texts = ["".join(pieces[k] for k in run) for run in runs]
    rows = []
    for j, text in enumerate(texts):
        tags = [m for kind, p in (("heading", LEGAL.heading), ("category", LEGAL.category), ("ordinal", LEGAL.ordinal), ("quote", "[«»]")) for m in G.marks(text, kind, p)]
        rows += [(j, m.start, m.kind, m.heading) for m in tags]
    marks = spark.createDataFrame(rows, "doc_id int, start int, kind string, heading string")
    found = {}
    for r in resolve_headings(drop_citations(marks, ("doc_id",)), ("doc_id",)).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.tipo_seccion, r.seccion))
    for j, text in enumerate(texts):
        assert G.headings(text, LEGAL, ChunkSpec()) == sorted(found.get(j, [])), runs[j]
    for run in itertools.product(range(1, 5), repeat=4):
        kept = G.in_sequence([G.Mark("number", i, i, "", n) for i, n in enumerate(run)])
        assert [m.number for m in kept] == ([*range(1, len(kept) + 1)] if len(kept) >= 3 else [])


def test_a_document_that_comes_twice(spark):
    docs = spark.createDataFrame([("a", "Artículo 1. x\nArtículo 2. y")] * 2, "doc_id string, text string")
    assert sorted((r.section_seq, r.seccion) for r in segment(docs).collect()) == [(0, "Artículo 1.")] * 2 + [(1, "Artículo 2.")] * 2


def test_nothing_is_shuffled_or_kept(spark):
    docs = spark.createDataFrame([("a", "Artículo 1. x")], "doc_id string, text string")
    plan = split_long(segment(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "InMemory" not in plan


def test_the_model_limits_the_parts(spark):
    class Small(WordTokenizer):
        limit = 32

    docs = spark.createDataFrame([("a", "palabra " * 100)], "doc_id string, text string")
    spec = ChunkSpec(overlap=4)
    rows = split_long(segment(docs, spec, Small()), spec, Small()).collect()
    assert len(rows) > 1 and max(r.n_tokens for r in rows) <= 32


def test_numeric_sequence(spark):
    runs = [[1, 2, 3], [1, 7, 2, 3], [1, 2], [1, 9, 2, 3, 4], [], [2, 3, 4]]
    df = spark.createDataFrame([(i, [(n,) for n in r]) for i, r in enumerate(runs)], "i int, m array<struct<number: int>>")
    got = {r.i: [x.number for x in r.k] for r in df.select("i", numeric_sequence(F.col("m")).alias("k")).collect()}
    assert [got[i] for i in range(len(runs))] == [[1, 2, 3], [], [], [1, 2, 3, 4], [], []]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=200), st.integers(5, 20), st.integers(0, 4))
def test_splitter(text, size, overlap):
    parts = Splitter(size, overlap, len).split(text)
    assert all(0 < len(p) <= size and p == p.strip() for p in parts)
    at = 0
    for p in parts:  # in order, each found in the text
        at = text.index(p, max(0, at - overlap - 1) if at else 0)
    assert {c for p in parts for c in p} >= set(text.replace(" ", "").replace("\n", ""))
    if overlap == 0:
        assert "".join("".join(parts).split()) == "".join(text.split())


def test_long_sections(spark):
    docs = spark.createDataFrame([("a", "Artículo 1. " + "palabra " * 300 + "\nArtículo 2. corto")], "doc_id string, text string")
    spec = ChunkSpec(max_tokens=64, overlap=8)
    sections = segment(docs, spec)
    chunks = split_long(sections, spec)
    rows = chunks.collect()
    assert max(r.n_tokens for r in rows) <= 64
    assert {r.seccion for r in rows} == {"Artículo 1.", "Artículo 2."}
    review = chunk_review(chunks).first()
    assert (review.n_different_sections, review.n_split_chunks, review.final_n_chunks) == (2, 1, len(rows))
    assert review.sections == ["Artículo 1.", "Artículo 2."]


def test_own_patterns(spark):
    docs = spark.createDataFrame([("a", "x\nMI LIBRO\nArtículo 1. y")], "doc_id string, text string")
    found = segment(docs, patterns=PatternSet.with_titles("MI LIBRO")).orderBy("section_seq").collect()
    assert [(r.tipo_seccion, r.content) for r in found] == [("preambulo", "x"), ("articulo", "Artículo 1. y")]


def test_citation_flags(spark):
    text = "Artículo 1. Uno a que se refiere la\nDisposición adicional primera. x\nArtículo 2. «\nArtículo segundo. y"
    docs = spark.createDataFrame([("a", text)], "doc_id string, text string")
    assert segment(docs).count() == 3
    assert segment(docs, ChunkSpec(reject_leadins=True)).count() == 2
    assert segment(docs, ChunkSpec(exempt_ordinals=True)).count() == 4


def test_word_tokenizer():
    assert WordTokenizer().count("uno, dos") == 3


def test_line_patterns_find_what_finditer_finds():
    """Every pattern on texts put together at random: the same places as by the pattern as a whole."""
    bits = ["Artículo 1", "Artículo primero bis.", "\n", "\n\n", " ", "\t\n", "\r\n", "DISPOSICIONES FINALES", " \n ", "Primero.", " texto", "1.", " x", "2. y", "CAPÍTULO I", "TÍTULO II algo", "ANEXO", "Disposición final primera.", "Disposición adicional", "«", "bis", "\x0b", "Artículo 5\n\n\n", "."]
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        for pattern in (LEGAL.heading, LEGAL.category, LEGAL.ordinal, LEGAL.number, LEGAL.chapter, LEGAL.title, LEGAL.annex):
            assert [(a, b) for a, b, _ in matches(text, pattern)] == [m.span() for m in re.finditer(pattern, text)], (text, pattern)


def took(run):
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


@pytest.mark.parametrize("text", [lambda n: "x\n" + "\n" * n + "Artículo 1. a\n" + "\n" * n, lambda n: "\n".join(f"Artículo {i}. texto de conformidad con el" for i in range(n // 8)), lambda n: "REGLAMENTO\n" * (n // 8) + "DEL\n"])
def test_segmentation_takes_time_in_proportion(text):
    spec, splitter = ChunkSpec(reject_leadins=True), Splitter(254, 32, len)
    small, large = (min(took(lambda n=n: sections_of(text(n), LEGAL, spec, splitter)) for _ in range(3)) for n in (4000, 32000))
    assert large < 24 * small + 0.05  # 64 times as long if it grew with the square


def test_titles_with_any_white_space_between_their_words():
    text = "antes\nPLAN GENERAL" + "\n" * 500 + " DE\tCONTABILIDAD  \nArtículo 1. a"
    assert find_title(text, LEGAL.titles) == (6, text.index("DAD") + 3)
    assert find_title(text.replace("DAD  \n", "DAD x\n"), LEGAL.titles) is None
    assert [t for t, _ in layers(text, LEGAL)] == ["antes", "Artículo 1. a"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "palabra", "extraordinariamente", " ", "  ", "\n", "\n\n", ".", ", ", "é", "_", "\t", "x" * 40, "\xa0", "٣"]), max_size=50), st.integers(1, 25), st.integers(0, 25))
def test_offsets_split_as_counts_do(pieces, size, overlap):
    """Ranges of token starts give the parts that counting each piece gives, and each part's own count."""
    text, tok = "".join(pieces), WordTokenizer()
    assert tok.starts(text).tolist() == [m.start() for m in tok._token.finditer(text)]
    found = Splitter(size, min(size, overlap), tok.count, starts=tok.starts).parts(text)
    assert [x for x, _ in found] == Splitter(size, min(size, overlap), tok.count).split(text)
    assert all(n == tok.count(x) for x, n in found)


def test_results_go_on_in_bounded_batches():
    """What a map holds of its results doesn't grow with the batch of texts, nor with the parts of one text."""
    import pyarrow as pa
    from larkspur.operators import segment as S

    class Rows:
        """Takes the map that would run in a task."""

        def select(self, *columns):
            self.columns = columns
            return self

        schema = type("Schema", (), {"fields": []})()

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    texts = ["\n".join(f"Artículo {i}. {'palabra ' * 20}" for i in range(1, 3000)), *["Artículo 1. a\nArtículo 2. b"] * 6000, None]

    def parts_of(batch, splitter):
        for row, text in enumerate(batch["text"]):
            yield row, [(i, *s, "x") for i, s in enumerate(S.sections_of(text.as_py() or "", S.LEGAL, S.ChunkSpec(), splitter)[1])]

    run = S._exploded(Rows(), ["doc_id"], parts_of, "section_seq int, tipo_seccion string, seccion string, content string, level string", S.ChunkSpec(), S.WordTokenizer())
    batch = pa.RecordBatch.from_pydict({"doc_id": [str(i) for i in range(len(texts))], "text": texts})
    found = list(run(iter([batch])))
    assert sum(b.num_rows for b in found) == 2999 + 2 * 6000 and len(found) > 3
    assert max(b.num_rows for b in found) <= S.HELD_ROWS and max(b.nbytes for b in found) < 6_000_000
    assert [r for b in found for r in b["doc_id"].to_pylist()] == ["0"] * 2999 + [str(i) for i in range(1, 6001) for _ in range(2)]
