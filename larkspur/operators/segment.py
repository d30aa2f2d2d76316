"""Segmentation of legal texts into sections.

A text goes through one map in Python: the patterns need lookahead and Unicode classes, Spark has no
function for all offsets, and a substring of a UTF-8 text by its character offset costs the whole text before
it.  No row meets another one, so nothing is shuffled or kept, and a document that comes twice is segmented twice.
Tables of marks without texts have the same rules as windows: drop_citations and resolve_headings.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..config import ChunkSpec
from ..functions.text import strip
from .patterns import LEGAL, PatternSet, find_title
from .splitter import Splitter, Tokenizer, WordTokenizer

LEVELS = {"articles": "articulo_disposicion", "numbers": "articulo_disposicion", "chapter": "capitulo", "title": "titulo", "length": "documento completo"}
KINDS = {"articles": "articulo", "numbers": "articulo", "chapter": "capitulo", "title": "titulo"}


class Mark(NamedTuple):
    kind: str
    start: int
    end: int
    heading: str
    number: int | None = None


class Section(NamedTuple):
    tipo_seccion: str
    seccion: str | None
    content: str


@lru_cache(maxsize=32)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)


def layers(text: str, patterns: PatternSet) -> Iterator[tuple[str, bool]]:
    """The text from outside inwards: (what stands before an embedded title, True) and at last (the rest, False)."""
    while place := find_title(text, patterns.titles):
        yield text[: place[0]].strip(), True
        text = text[place[1] :].lstrip().lstrip("«")
    yield text, False


#: How patterns of lines begin.
_LINE = r"(?m)^\s*"
#: Words before a heading among which what leads into a citation is looked for.
LEAD_WORDS = 16


def matches(text: str, pattern: str) -> Iterator[tuple[int, int, re.Match]]:
    """(start, end, match) of all that finditer finds.

    A pattern of lines is tried once at each line by itself, whatever blank lines go before; the match starts at the
    first of these, as the pattern says.
    """
    if not pattern.startswith(_LINE):
        yield from ((m.start(), m.end(), m) for m in _compiled(pattern).finditer(text))
        return
    end = 0
    for found in _compiled(r"(?m)^[^\S\n]*" + f"(?:{pattern.removeprefix(_LINE)})").finditer(text):
        line = found.start()
        before = text[end:line]  # up to the match before, so that all of these together are one text
        full = len(before.rstrip())
        start = end if not full and (end == 0 or text[end - 1] == "\n") else text.find("\n", end + full, line) + 1
        end = found.end()
        yield start, end, found


def marks(text: str, kind: str, pattern: str) -> list[Mark]:
    """All matches of a pattern; of bare numbers with the number."""
    return [Mark(kind, start, end, text[start:end].strip(), int(m[1]) if kind == "number" else None) for start, end, m in matches(text, pattern)]


def leads_in(body: str, words: list[int], start: int, pattern: str) -> bool:
    """Whether the words before a place lead into a citation; words: where each word of the body starts."""
    before = bisect_left(words, start)
    return bool(before and _compiled(pattern).search(body[words[max(0, before - LEAD_WORDS)] : start]))


def in_sequence(found: list[Mark]) -> list[Mark]:
    """Of numbers in text order those that go 1, 2, 3 and on; none if fewer than 3 or under 0.8 of all."""
    run: list[Mark] = []
    for mark in found:
        if mark.number == len(run) + 1:
            run.append(mark)
    return run if len(run) >= 3 and len(run) * 10 >= len(found) * 8 else []


def headings(body: str, patterns: PatternSet, spec: ChunkSpec) -> list[tuple[int, str, str]]:
    """(start, tipo_seccion, seccion) of the articles and dispositions of a body, in order.

    Headings in an open quotation or (on request) behind words that lead into a citation don't count.
    """
    tags = [*marks(body, "heading", patterns.heading), *marks(body, "category", patterns.category), *marks(body, "ordinal", patterns.ordinal)]
    quotes = [(m.start(), m[0] == "«") for m in re.finditer("[«»]", body)]
    tags.sort(key=lambda t: t.start)  # stable: a heading before a category before an ordinal
    starts = [m.start() for m in re.finditer(r"\S+", body)] if spec.reject_leadins else []
    kept, at, open_ = [], 0, False
    for tag in tags:
        while at < len(quotes) and quotes[at][0] < tag.start:
            open_, at = quotes[at][1], at + 1
        if tag.kind == "heading":
            free = spec.exempt_ordinals and _compiled(patterns.ordinal_article).search(tag.heading)
            if (open_ and not free) or (spec.reject_leadins and leads_in(body, starts, tag.start, patterns.lead_in)):
                continue
        kept.append(tag)
    found, last = [], None
    for i, tag in enumerate(kept):
        if tag.kind == "heading":
            found.append((tag.start, "disposicion" if tag.heading.lower().startswith(patterns.disposition) else "articulo", tag.heading))
        elif tag.kind == "category":
            if i + 1 == len(kept) or kept[i + 1].kind != "ordinal":
                found.append((tag.start, "disposicion", tag.heading))
        elif last is None:
            found.append((tag.start, "articulo", tag.heading))
        elif last.kind == "category":
            found.append((tag.start, "disposicion", f"{last.heading} {tag.heading}"))
        last = last if tag.kind == "ordinal" else tag
    return found


def strategy(text: str, body: str, patterns: PatternSet, spec: ChunkSpec, forced: bool) -> tuple[str, list[tuple[int, str, str]]]:
    """The first of articles, numbers, chapters, titles and length that the body has, and the starts of its sections."""
    if forced:
        return "length", []
    found = headings(body, patterns, spec)
    if found:
        first = found[0][0]
        early = [] if any(t == "articulo" for _, t, _ in found) else in_sequence(marks(text[:first], "number", patterns.number))
        return "articles", sorted([*found, *((m.start, "articulo", m.heading) for m in early)])
    for name, some in (("numbers", lambda: in_sequence(marks(body, "number", patterns.number))), ("chapter", lambda: marks(body, "chapter", patterns.chapter)), ("title", lambda: marks(body, "title", patterns.title))):
        if starts := some():
            return name, [(m.start, KINDS[name], m.heading) for m in starts]
    return "length", []


def slices(text: str, starts: list[tuple[int, str, str]]) -> list[Section]:
    """Each section up to the next start, and what stands before the first as a preamble if not blank."""
    ends = [s for s, _, _ in starts[1:]] + [len(text)]
    before = text[: starts[0][0]].strip()
    return [Section("preambulo", None, before)] * bool(before) + [Section(tipo, name, text[s:e].strip()) for (s, tipo, name), e in zip(starts, ends, strict=True)]


def with_annexes(sections: list[Section], patterns: PatternSet) -> list[Section]:
    """The last section cut at annex headings; what stands before keeps its name if not blank."""
    if not sections:
        return []
    *most, last = sections
    found = marks(last.content, "annex", patterns.annex)
    if not found:
        return sections
    before = last.content[: found[0].start].strip()
    ends = [m.start for m in found[1:]] + [len(last.content)]
    return most + [last._replace(content=before)] * bool(before) + [Section("anexo", m.heading, last.content[m.start : e].strip()) for m, e in zip(found, ends, strict=True)]


def sections_of(text: str, patterns: PatternSet, spec: ChunkSpec, splitter: Splitter, forced: bool = False) -> tuple[str, list[Section]]:
    """The level and the sections of a text.

    Embedded documents first, then by the strategy; the annexes of a text without headings go behind its last part.
    """
    *outer, (inner, _) = layers(text, patterns)
    found = [Section("preambulo", None, part) for part, _ in outer if part]
    annex = next(matches(inner, patterns.annex), (None,))[0]
    body = inner if annex is None else inner[:annex]
    name, starts = strategy(inner, body, patterns, spec, forced)
    if name == "length":
        parts = splitter.split(body) if body.strip() else []
        if annex is not None:
            tail = inner[annex:]
            parts = [*parts[:-1], f"{parts[-1]}\n{tail}"] if parts else [tail]
        found += [Section("none", None, part) for part in parts]
    else:
        found += slices(inner, starts)
    return LEVELS[name], with_annexes(found, patterns)


def numeric_sequence(marks: F.Column) -> F.Column:
    """Of marks in text order those that go 1, 2, 3 and on; none if fewer than 3 or under 0.8 of all."""
    start = F.struct(F.lit(1).alias("next"), F.filter(marks, lambda m: F.lit(False)).alias("kept"))
    run = F.aggregate(
        marks, start,
        lambda a, m: F.when(m["number"] == a["next"], F.struct((a["next"] + 1).alias("next"), F.concat(a["kept"], F.array(m)).alias("kept"))).otherwise(a),
        lambda a: a["kept"],
    )
    enough = (F.size(run) >= 3) & (F.size(run) * 10 >= F.size(marks) * 8)
    return F.when(enough, run).otherwise(F.filter(marks, lambda m: F.lit(False)))


def drop_citations(tags: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """tags with kind "quote" among them: headings inside an open quotation are dropped, and so are the quotes."""
    before = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind") == "quote", F.col("heading")), ignorenulls=True).over(before)
    return tags.withColumn("__open", F.coalesce(last == "«", F.lit(False))).where("kind <> 'quote' AND NOT (kind = 'heading' AND __open)").drop("__open")


def resolve_headings(tags: DataFrame, keys: tuple[str, ...], disposition: str = "disposici") -> DataFrame:
    """tags (kind heading, category or ordinal; start, heading) become section starts with tipo_seccion and seccion.

    With p as the last tag before that isn't an ordinal: a heading is a section; a
    category is one unless an ordinal follows it; an ordinal is an article where there is no p,
    a disposition named by p where p is a category, and text otherwise.
    """
    rank = F.when(F.col("kind") == "heading", 0).when(F.col("kind") == "category", 1).otherwise(2)
    w = Window.partitionBy(*keys).orderBy("start", rank)
    p = F.last(F.when(F.col("kind") != "ordinal", F.struct("kind", "heading")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    tags = tags.withColumn("__p", p).withColumn("__next", F.lead("kind").over(w))
    kind = F.col("kind")
    tipo = (
        F.when(kind == "heading", F.when(F.lower("heading").startswith(disposition), "disposicion").otherwise("articulo"))
        .when((kind == "category") & ~F.coalesce(F.col("__next") == "ordinal", F.lit(False)), "disposicion")
        .when((kind == "ordinal") & F.col("__p").isNull(), "articulo")
        .when((kind == "ordinal") & (F.col("__p.kind") == "category"), "disposicion")
    )
    name = F.when((kind == "ordinal") & (F.col("__p.kind") == "category"), F.concat_ws(" ", "__p.heading", "heading")).otherwise(F.col("heading"))
    return tags.withColumn("tipo_seccion", tipo).withColumn("seccion", name).where("tipo_seccion IS NOT NULL").drop("__p", "__next")


def slice_texts(texts: DataFrame, starts: str = "starts") -> DataFrame:
    """texts: text and an array of starts (start, tipo_seccion, seccion) in order.  Its other columns, section_seq (0 for a preamble), tipo_seccion, seccion, content."""

    @F.pandas_udf("array<struct<section_seq: int, tipo_seccion: string, seccion: string, content: string>>")
    def cut(text: pd.Series, places: pd.Series) -> pd.Series:
        def one(t: str, some: Iterable) -> list[tuple]:
            found = slices(t or "", [(p["start"], p["tipo_seccion"], p["seccion"]) for p in some]) if some is not None and len(some) else []
            first = 0 if found and found[0].tipo_seccion == "preambulo" and len(found) > len(some) else 1
            return [{"section_seq": i, **s._asdict()} for i, s in enumerate(found, first)]

        return pd.Series([one(t, some) for t, some in zip(text, places, strict=True)])

    rest = [c for c in texts.columns if c not in ("text", starts)]
    return texts.select(*rest, F.explode(cut("text", starts)).alias("__s")).select(*rest, "__s.*")


def _splitter(spec: ChunkSpec, tokenizer: Tokenizer) -> Splitter:
    return Splitter(spec.clamped(tokenizer.limit).max_tokens - tokenizer.specials, spec.overlap, tokenizer.count, starts=getattr(tokenizer, "starts", None))


def segment(docs: DataFrame, spec: ChunkSpec | None = None, tokenizer: Tokenizer | None = None, patterns: PatternSet = LEGAL) -> DataFrame:
    """docs (doc_id, text) to sections: doc_id, section_seq, tipo_seccion, seccion, content, level.

    Strategies in this order: embedded document, forced by id (length), articles and
    dispositions, bare numbers, chapters, titles, length; then the last section is cut at annexes.
    """
    spec, tokenizer = spec or ChunkSpec(), tokenizer or WordTokenizer()

    def parts_of(batch: pa.RecordBatch, splitter: Splitter) -> Iterator[tuple[int, list[tuple]]]:
        for row, (own, text) in enumerate(zip(batch["__id"], batch["text"], strict=True)):
            level, sections = sections_of(text.as_py() or "", patterns, spec, splitter, own.as_py() in spec.forced)
            yield row, [(i, *s, level) for i, s in enumerate(sections)]

    rows = docs.select("doc_id", F.col("doc_id").cast("string").alias("__id"), "text")
    return _exploded(rows, ["doc_id"], parts_of, "section_seq int, tipo_seccion string, seccion string, content string, level string", spec, tokenizer)


#: Characters and rows of the results that a map of texts holds before it hands them on.
HELD_CHARS, HELD_ROWS = 2_000_000, 4096


def _exploded(rows: DataFrame, keep: list[str], parts_of, more: str, spec: ChunkSpec, tokenizer: Tokenizer) -> DataFrame:
    """The columns `keep` of each row with those of each of its parts (DDL `more`), in batches of bounded size.

    parts_of gives the place of each row of a batch and its parts.  The results of one text are held at once, never those of a batch.
    """
    added = _parse_datatype_string(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = _splitter(spec, tokenizer)
        for batch in batches:
            text = next((f.type for f in batch.schema if pa.types.is_large_string(f.type)), pa.string())
            kinds = [{"string": text, "int": pa.int32(), "boolean": pa.bool_()}[f.dataType.simpleString()] for f in added]
            kept = [batch[c] for c in keep]

            def flushed(places: list[int], held: list[tuple], kinds=kinds, kept=kept) -> pa.RecordBatch:
                columns = zip(*held, strict=True)
                return pa.RecordBatch.from_arrays([*[c.take(pa.array(places, pa.int32())) for c in kept], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[*keep, *added.names])

            places, held, chars = [], [], 0
            for place, parts in parts_of(batch, splitter):
                for part in parts:
                    places.append(place)
                    held.append(part)
                    chars += sum(len(x) for x in part if isinstance(x, str))
                    if chars >= HELD_CHARS or len(held) >= HELD_ROWS:
                        yield flushed(places, held)
                        places, held, chars = [], [], 0
            if held:
                yield flushed(places, held)

    return rows.mapInArrow(run, StructType([*rows.select(*keep).schema.fields, *added.fields]))


def split_long(sections: DataFrame, spec: ChunkSpec | None = None, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Sections over the limit become parts with its name; adds part_seq, n_tokens and was_split.

    The limit is the lesser of the setting and what the tokenizer's model takes; special tokens count.
    """
    spec, tokenizer = spec or ChunkSpec(), tokenizer or WordTokenizer()
    limit = spec.clamped(tokenizer.limit).max_tokens

    def parts_of(batch: pa.RecordBatch, splitter: Splitter) -> Iterator[tuple[int, list[tuple]]]:
        more = tokenizer.specials
        for row, content in enumerate(batch["content"]):
            t = content.as_py()
            starts = splitter.starts(t or "") if splitter.starts else None
            n = (tokenizer.count(t or "") if starts is None else len(starts)) + more
            yield row, [(n > limit, i, x, k + more) for i, (x, k) in enumerate(splitter.parts(t, starts))] if n > limit else [(False, 0, t, n)]

    rest = [c for c in sections.columns if c != "content"]
    return _exploded(sections.select(*rest, "content"), rest, parts_of, "was_split boolean, part_seq int, content string, n_tokens int", spec, tokenizer)


def chunk_review(chunks: DataFrame) -> DataFrame:
    """Per document: level, sections in order before long ones were split, and counts; one aggregate over the chunks."""
    name = F.coalesce(F.nullif("seccion", F.lit("")), F.col("tipo_seccion"))
    first = F.col("part_seq") == 0
    found = chunks.groupBy("doc_id").agg(
        F.first("level").alias("segmentation_level"), F.count_if(first).alias("n_different_sections"), F.array_sort(F.collect_list(F.when(first, F.struct("section_seq", name.alias("name"))))).alias("s"),
        F.count_if(first & F.col("was_split")).alias("n_split_chunks"), F.count("*").alias("final_n_chunks"), F.coalesce(F.sum(F.when(F.col("tipo_seccion") == "preambulo", F.col("n_tokens"))), F.lit(0)).alias("preamble_length_tokens"),
    )
    return found.select("doc_id", "segmentation_level", "n_different_sections", F.transform("s", lambda x: x["name"]).alias("sections"), "n_split_chunks", "final_n_chunks", "preamble_length_tokens")
