"""Token counts: pieces are counted once for each distinct pre-token and summed by the frequencies in each document."""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import extended, lean, materialize, named, part_of

#: Pre-tokens that are at least one in so many of all occurrences are looked up where the texts are read.
COMMON = 1_000_000
#: Longer pre-tokens are never among them, which bounds what is sent to each task.
COMMON_CHARS = 64
#: Characters that are looked at together.
CHUNK = 1 << 18
#: Documents whose rare pre-tokens are held at once.
ROWS = 256
#: Distinct pre-tokens a task holds before it hands their frequencies on.
HELD = 200_000


class _Pieces:
    """A sentencepiece model: a text is cut wherever no piece of the vocabulary holds both neighbours.

    What the library merges or chooses is always a piece of the vocabulary (or a single character), so that
    such a cut never changes the pieces on its sides.  That holds for models whose normaliser changes
    nothing but white space to its own sign; others are refused.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.space = "▁"
        model, ids = self.model, range(self.model.get_piece_size())
        pieces = [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        for probe in ("a", " a  b ", "\tA\n　ﬁ ① é", "▁x", " "):
            if model.normalize(probe) != self.space + probe.replace(" ", self.space):
                raise ValueError(f"{path}: the normaliser changes texts or adds no space before them")
        signs = sorted({c for p in pieces for c in p})
        self.sign = np.zeros(0x110000, dtype=np.int32)
        self.sign[[ord(c) for c in signs]] = np.arange(1, len(signs) + 1)
        self.joined = np.zeros((len(signs) + 1, len(signs) + 1), dtype=bool)
        for p in pieces:
            at = self.sign[[ord(c) for c in p]]
            self.joined[at[:-1], at[1:]] = True
        # stands before a pre-token so that the library's own space goes to it and not to the pre-token
        self.guard = next(c for c in map(chr, range(1, 0x3000)) if not self.sign[ord(c)] and c.isprintable() is False and c != "\0")
        self.extra = len(model.encode(self.guard))

    def cuts(self, text: str) -> np.ndarray:
        """Places between whose neighbours no piece reaches."""
        sign = self.sign[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)]
        return np.flatnonzero(~self.joined[sign[:-1], sign[1:]]) + 1

    def pre_tokens(self, text: str) -> Iterator[list[str]]:
        """All pre-tokens of a text, in lists of those of about CHUNK characters."""
        if not text:
            return
        text, rest = self.space + text.replace(" ", self.space), ""
        for lo in range(0, len(text), CHUNK):
            part = rest + text[lo : lo + CHUNK]
            at = self.cuts(part).tolist()
            if lo + CHUNK < len(text):
                if not at:
                    rest = part
                    continue
                rest = part[at[-1] :]
                yield [part[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)]
            else:
                yield [part[a:b] for a, b in zip([0, *at], [*at, len(part)], strict=True)]

    def count(self, tokens: list[str]) -> list[int]:
        return [len(ids) - self.extra for ids in self.model.encode([self.guard + t for t in tokens], num_threads=1)]


class _Ranks:
    """A rank file with a pattern: the pattern's matches are the pre-tokens."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("pre-tokens", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})  # takes each as it is
        self.pattern = regex.compile(pattern)

    def pre_tokens(self, text: str) -> Iterator[list[str]]:
        held = []
        for match in self.pattern.finditer(text):
            held.append(match[0])
            if len(held) == CHUNK:
                yield held
                held = []
        yield held

    def count(self, tokens: list[str]) -> list[int]:
        return [len(self.encoding.encode_ordinary(t)) for t in tokens]


class _Model:
    """A tokenizers file: its normaliser and pre-tokenizer give the pre-tokens, its model the pieces.

    Added tokens (special strings) that stand in a text are cut out first, as the library does by default.
    """

    def __init__(self, path: str):
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        if any(t.lstrip or t.rstrip or t.single_word for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError(f"{path}: added tokens that take white space or whole words only")
        self.added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)

    def pre_tokens(self, text: str) -> Iterator[list[str]]:
        import regex

        parts = regex.split("(" + "|".join(map(regex.escape, self.added)) + ")", text) if self.added else [text]
        for i, part in enumerate(parts):
            if i % 2:
                yield [part]
            elif part:
                t = self.tokenizer
                part = t.normalizer.normalize_str(part) if t.normalizer else part
                yield [p for p, _ in t.pre_tokenizer.pre_tokenize_str(part)] if t.pre_tokenizer else [part]

    def count(self, tokens: list[str]) -> list[int]:
        return [1 if t in self.added else len(self.tokenizer.model.tokenize(t)) for t in tokens]


@lru_cache(maxsize=2)
def counter(path: str, pattern: str | None = None) -> _Pieces | _Ranks | _Model:
    """How a tokenizer file cuts texts into pre-tokens and counts the pieces of each."""
    if path.endswith(".model"):
        return _Pieces(path)
    return _Model(path) if path.endswith(".json") else _Ranks(path, pattern)


def _frequencies(load: Callable):
    """token, n: how often each pre-token occurs in a part of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])
        for batch in batches:
            for text in batch.column("text"):
                for tokens in load().pre_tokens(text.as_py() or ""):
                    seen.update(tokens)
                    if len(seen) > HELD:
                        yield out()
                        seen.clear()
        yield out()

    return lean(run)


def _counted(load: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = load().count(batch.column("token").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("token"), batch.column("n"), pa.array(pieces, pa.int64())], names=["token", "n", "pieces"])

    return lean(run)


def _known(load: Callable, common):
    """place, known and rare of each document: pieces of common pre-tokens, and the others with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, at = common.value, TaskContext.get().partitionId() << 40
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                known, ends, rare, times = [], [0], [], []
                for text in batch.column("text"):
                    n, others = 0, Counter()
                    for tokens in load().pre_tokens(text.as_py() or ""):
                        for token, k in Counter(tokens).items():
                            found = pieces.get(token)
                            if found is None:
                                others[token] += k
                            else:
                                n += found * k
                    known.append(n)
                    rare.extend(others)
                    times.extend(others.values())
                    ends.append(len(rare))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(rare, pa.string()), pa.array(times, pa.int64())], names=["token", "times"]))
                columns = [batch.column("row"), batch.column("n_bytes"), pa.array(np.arange(at, at + batch.num_rows)), pa.array(known, pa.int64()), lists]
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays(columns, names=["row", "n_bytes", "place", "known", "rare"])

    return lean(run)


def count_tokens(documents: DataFrame, path: str, pattern: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 4096) -> DataFrame:
    """keep columns, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every whole text.

    path: a sentencepiece .model, a tokenizers .json or a rank file (with its pattern), readable on every executor; begin, end
    and other added special tokens are never counted.  Token ids are made for distinct pre-tokens only.

    The frequencies of pre-tokens in the corpus are summed, and pieces are counted once for each.  A pre-token that
    is at least one in COMMON of all occurrences goes to every task: there can be no more than COMMON of
    them, of COMMON_CHARS characters at most, whatever the corpus.  The others are joined to the documents'
    frequencies by a shuffle; none of them is a hot key, being rarer than that.

    A null text counts as empty: no bytes, no tokens.  Rows repeat as they come; an empty table gives no rows.  Other columns
    are dropped, and those kept may have any names.
    """
    spark = documents.sparkSession
    load = lambda: counter(path, pattern)
    texts = documents.select(F.col(text).cast("string").alias("text"))
    occurring = texts.mapInArrow(_frequencies(load), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    pieces = materialize(occurring.mapInArrow(_counted(load), "token string, n long, pieces long"), "pieces", total=F.sum("n"))
    least = (pieces.stats["total"] or 0) / COMMON
    is_common = (F.col("n") >= least) & (F.length("token") <= COMMON_CHARS)
    common = spark.sparkContext.broadcast({row["token"]: row["pieces"] for row in pieces.where(is_common).select("token", "pieces").toLocalIterator()})
    frame = documents.select(F.struct(*named(keep)).alias("row"), F.col(text).cast("string").alias("text"), F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    schema = extended(frame.select("row").schema, "n_bytes long, place long, known long, rare array<struct<token: string, times: long>>")
    each = materialize(frame.mapInArrow(_known(load, common), schema), "known_tokens")
    rare = each.select(F.col("place").alias("at"), F.explode("rare").alias("r")).select("at", "r.token", "r.times")
    rare = rare.join(pieces.where(~is_common).select("token", "pieces"), "token").groupBy("at").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    total = F.col("known") + F.coalesce("more", F.lit(0))
    found = each.drop("rare").join(rare, F.col("place") == F.col("at"), "left")
    return found.select(*[part_of("row", c) for c in keep], "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
