"""String columns: trimming, references, multi-values, token estimates and labels."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def strip(c: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def or_else(c: Column, other: Column) -> Column:
    """other where c is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), other)


#: A sign from U+0300 on; a text without any is composed as it stands, since marks and all that composition changes lie there.
_BEYOND = "[^\\x00-\\x{2FF}]"


def nfc(c: Column) -> Column:
    """Canonical composition.  The JVM side has no function for it, so texts with signs that it may change, and only those, go to Python."""
    compose = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x)), StringType())
    open_ = c.rlike(_BEYOND)
    return F.when(open_, compose(F.when(open_, c))).otherwise(c)


def normalize_ref(c: Column) -> Column:
    """A section reference for comparison: composed, trimmed, white space as one space; null is empty."""
    return F.regexp_replace(strip(nfc(F.coalesce(c, F.lit("")))), r"(?U)[\s\x1c-\x1f]+", " ")


def pipe_split(c: Column) -> Column:
    """Values between |, without empty ones; an empty array for null."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[|]"), lambda x: x != "")


def estimate_tokens(c: Column, chars_per_token: int = 3) -> Column:
    return F.ceil(F.length(F.coalesce(c, F.lit(""))) / F.lit(chars_per_token)).cast("long")


def one_of(c: Column, values: tuple[str, ...]) -> Column:
    """c where it is one of the values; anything else raises."""
    return F.when(c.isNull() | c.isin(*values), c).otherwise(F.raise_error(F.concat(F.lit(f"not one of {', '.join(values)}: "), c)))


def words(c: Column, pattern: str) -> Column:
    """Lower-cased pieces between matches of pattern, without empty ones."""
    return F.array_remove(F.split(F.lower(c), pattern), "")


def heading(doc_name: Column, seccion: Column) -> Column:
    """name — section, with empty parts left out."""
    return F.concat_ws(" — ", F.nullif(doc_name, F.lit("")), F.nullif(seccion, F.lit("")))
