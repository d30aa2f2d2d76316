"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import with_results

#: Longer texts are cut before they are encoded.
PIECE_CHARS = 100_000
#: Between a letter and a space that a letter follows, or a letter and a line end that a character other
#: than white space follows, no match of the usual patterns reaches across.
_SAFE = regex.compile(r"(?<=\p{L})(?= \p{L})|(?<=\p{L})(?=\n\S)")
_PROBES = ("a b", "ab cd", "A b", "Ab Cd", "é ñ", "日 本", "a\nb", "ab\n1", "a\n'", "a's b", "1a b", "a\nB", "don't a", "a  b c", "x\n\tz")


@lru_cache(maxsize=4)
def _encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def cuts_are_safe(pattern: str) -> bool:
    """Whether a pattern's matches are the same on both sides of the places at which long texts are cut: tried on samples of every kind of such places.

    With a pattern that fails this every text is encoded whole.
    """
    for text in _PROBES:
        whole = regex.findall(pattern, text)
        for place in _SAFE.finditer(text):
            if regex.findall(pattern, text[: place.start()]) + regex.findall(pattern, text[place.start() :]) != whole:
                return False
    return True


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """text in parts of about `size` characters, cut only where no pre-split match can reach across.

    Where a stretch has no such place the part is longer.
    """
    at = 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def encode(text: str, rank_file: str, pattern: str, size: int = PIECE_CHARS) -> list[int]:
    encoding = _encoding(rank_file, pattern)
    if len(text) <= size or not cuts_are_safe(pattern):
        return encoding.encode_ordinary(text)
    return [i for piece in pieces(text, size) for i in encoding.encode_ordinary(piece)]


def decode(ids: list[int], rank_file: str, pattern: str) -> bytes:
    """Raw bytes; a cut inside a character is kept as it is."""
    return _encoding(rank_file, pattern).decode_bytes(ids)


def _run(rank_file: str, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for lo in range(0, batch.num_rows, 256):
                part, n, ids_hash, bytes_hash, ids_out = batch.slice(lo, 256), [], [], [], []
                for text in texts.slice(lo, 256):
                    ids = encode(text.as_py() or "", rank_file, pattern)
                    n.append(len(ids))
                    ids_hash.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                    bytes_hash.append(hashlib.sha256(decode(ids, rank_file, pattern)).hexdigest())
                    if with_ids:
                        ids_out.append(ids)
                columns = [part.column("row"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(bytes_hash, pa.string())]
                names = ["row", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(ids_out, pa.list_(pa.int32())))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode_documents(documents: DataFrame, rank_file: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """Encode and decode every text: keep columns, n_tokens, ids_sha256, decoded_sha256 and, if asked for, token_ids.

    Every match of the pattern is encoded separately, without special tokens.  A
    null text is encoded as an empty one: no ids, and hashes of nothing.  Rows
    repeat as they come; other columns are dropped.  rank_file must be readable
    on every executor under the same path; the text itself never needs a file.
    """
    more = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * ids
    return with_results(documents, keep, {"text": F.col(text).cast("string")}, _run(rank_file, pattern, ids), more)


def decode_documents(encoded: DataFrame, rank_file: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """encoded and decoded_bytes (binary): the bytes of each row's ids; null for null ids."""

    @F.pandas_udf("binary")
    def undo(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else decode([int(i) for i in x], rank_file, pattern))

    return encoded.withColumn("decoded_bytes", undo(F.col(ids)))
