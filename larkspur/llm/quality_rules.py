"""Quality rules by distribution divergence, in DataFrame expressions only.

Per document: base counts, a histogram of character classes and one of common
words, in which all other words have one cell.  References are the same histograms summed over
all documents of each language.  A document that is long enough is kept if its histograms are close
(Jensen-Shannon distance) to those of one language.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: Common words of the languages with references (fixed values).
COMMON = {
    "en": "the of and to in a is that for it was on with as are be this by from at",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur",
    "es": "de la que el en y a los se del las un por con no una su para es al",
}
_SPACE = r" \t\n\u000b\u000c\r"
_SPLIT = r"[\\x20\\x09-\\x0D]+"
#: What stands between the words of the common-word histogram, which have letters only.
_BETWEEN = r"[^\\p{L}]+"
_CLASSES = ("lower", "space", "upper", "digit", "stop", "symbol", "other")


@dataclass(frozen=True)
class Rules:
    """least_words: base rule; repeat_percent: base rule on words in repeated 3-word windows.

    char_words, word_words: texts with fewer words aren't judged by that histogram;
    char_distance, word_distance: the greatest distance that is kept.  They were set on labelled rows
    (sf0.1, crc32 of the id modulo 3 not 1): together they reject 0.84 of the rows of low quality that have 50
    words and none of the others; characters alone reject 0.52 of the former.
    """

    least_words: int = 50
    repeat_percent: int = 50
    char_words: int = 50
    word_words: int = 50
    char_distance: float = 0.3
    word_distance: float = 0.35


def _let(value: str, name: str, body: str) -> str:
    """body with name bound to value, which is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeat_words() -> str:
    """Words in 3-word windows that occur twice or more, from the array `words`."""
    few = "filter(transform(h, (x, i) -> if(array_contains(d, x), i, -1)), i -> i >= 0)"
    pairs = "sort_array(transform(h, (x, i) -> struct(x AS x, i AS i)))"
    many = _let(pairs, "p", "sort_array(transform(filter(p, (e, j) -> (j > 0 AND e.x = p[greatest(j - 1, 0)].x) OR (j < size(p) - 1 AND e.x = p[least(j + 1, size(p) - 1)].x)), e -> e.i))")
    covered = "aggregate(at, struct(0L AS n, -3 AS last), (a, i) -> struct(a.n + least(3, i - a.last) AS n, i AS last), a -> a.n)"
    twice = "array_distinct(filter(s, (x, j) -> j > 0 AND x = s[greatest(j - 1, 0)]))"
    body = _let("sort_array(h)", "s", _let(twice, "d", _let(f"if(size(d) <= 24, {few}, {many})", "at", covered)))
    windows = "transform(sequence(1, size(w) - 2), i -> xxhash64(w[i - 1], w[i], w[i + 1]))"
    return _let("words", "w", f"if(size(w) < 3, 0L, {_let(windows, 'h', f'if(size(array_distinct(h)) = size(h), 0L, {body})')})")


def measure(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, lang, the base counts, classes (array of counts) and common (array of word and count; the empty word stands for all others)."""
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    stop = r".,;:!?()-\"\'"
    vocabulary = ", ".join(f"'{w}'" for w in sorted({w for words in COMMON.values() for w in words.split()}))
    docs = documents.select("doc_id", "lang", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    first = docs.selectExpr(
        "doc_id", "lang", "t",
        f"translate(t, '{_SPACE}', '') AS t1",
        f"array_remove(split(t, '{_SPLIT}'), '') AS words",
        f"array_remove(split(lower(t), '{_BETWEEN}'), '') AS runs",
    )
    second = first.selectExpr(
        "doc_id", "lang", "words", "runs", "length(t) AS n0", "length(t1) AS n1", f"translate(t1, '{lower}', '') AS t2",
        "length(t1) - length(translate(t1, '#*$%&|<>', '')) AS n_symbols",
        f"{_let("filter(split(t, '\\\\n'), l -> translate(l, '" + _SPACE + "', '') <> '')", 'l', 'size(l) - size(array_distinct(l))')} AS n_dup_lines",
    )
    third = second.selectExpr("*", f"translate(t2, '{upper}', '') AS t3")
    fourth = third.selectExpr("*", f"translate(t3, '{digit}', '') AS t4", f"length(translate(t3, '{digit}{stop}', '')) AS n5", f"length(translate(t3, '{digit}{stop}#*$%&|<>', '')) AS n6")
    return fourth.selectExpr(
        "doc_id", "lang", "cast(size(words) AS long) AS n_words", "cast(n1 AS long) AS word_chars", "cast(n_symbols AS long) AS n_symbols", "cast(n_dup_lines AS long) AS n_dup_lines",
        f"{_repeat_words()} AS n_repeat_words",
        "array(n1 - length(t2), n0 - n1, length(t2) - length(t3), length(t3) - length(t4), length(t4) - n5, n5 - n6, n6) AS classes",
        _let(f"filter(runs, w -> w IN ({vocabulary}))", "c", "array_append(transform(array_distinct(c), x -> struct(x AS word, size(c) - size(array_remove(c, x)) AS n)), struct('' AS word, size(runs) - size(c) AS n))") + " AS common",
    )


def references(measured: DataFrame) -> dict[str, tuple[list[float], dict[str, float]]]:
    """Shares of character classes and of common words (and of all others), over all documents of each language in COMMON.

    The result has one entry for each of these languages that has documents: a fixed bound.
    """
    own = measured.where(F.col("lang").isin(list(COMMON)))
    sums = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(len(_CLASSES))]
    found: dict[str, tuple[list[float], dict[str, float]]] = {}
    for row in own.groupBy("lang").agg(*sums).collect():
        counts = [float(row[f"c{i}"] or 0) for i in range(len(_CLASSES))]
        if sum(counts):
            found[row["lang"]] = ([c / sum(counts) for c in counts], {})
    words: dict[str, dict[str, float]] = {}
    for row in own.select("lang", F.explode("common").alias("c")).groupBy("lang", "c.word").agg(F.sum("c.n").alias("n")).collect():
        words.setdefault(row["lang"], {})[row["word"]] = float(row["n"])
    for lang, counts in words.items():
        total = sum(counts.values())
        if total:
            found.setdefault(lang, ([0.0] * len(_CLASSES), {}))[1].update({w: n / total for w, n in sorted(counts.items())})
    return found


def _distance_terms(p: str, q: str) -> str:
    """The two terms of the Jensen-Shannon divergence (in bits) for one cell; 0 log 0 is 0."""
    return f"if({p} > 0, 0.5D * {p} * log2(2D * {p} / ({p} + {q})), 0D) + if({q} > 0, 0.5D * {q} * log2(2D * {q} / ({p} + {q})), 0D)"


def _char_distance(reference: list[float]) -> str:
    q = "array(" + ", ".join(f"{x!r}D" for x in reference) + ")"
    total = "aggregate(classes, 0L, (a, x) -> a + x)"
    cells = _let(total, "n", f"aggregate(zip_with(classes, {q}, (c, q) -> {_distance_terms('(c / n)', 'q')}), 0D, (a, x) -> a + x)")
    return f"if({total} = 0, 0D, sqrt(greatest({cells}, 0D)))"


def _word_distance(reference: dict[str, float]) -> str:
    """Cells without the word in the document give half their share of the reference."""
    if not reference:
        return "1D"
    q = "map(" + ", ".join(f"'{w}', {x!r}D" for w, x in reference.items()) + ")"
    total = "aggregate(common, 0L, (a, x) -> a + x.n)"
    body = f"aggregate(common, 0.5D, (a, x) -> a + {_let(f'coalesce(try_element_at({q}, x.word), 0D)', 'q', _distance_terms('(x.n / n)', 'q') + ' - 0.5D * q')})"
    return f"if({total} = 0, 1D, sqrt(greatest({_let(total, 'n', body)}, 0D)))"


def quality_rules(documents: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance, word_distance, base_failed, kept.

    A null text has no words and fails the base rules.  Texts below the length
    guards of a histogram pass it; a longer one without any letter is at distance 1 from all words.  Documents of any language, null included,
    are held against every reference, and the nearest counts; without references
    (no documents of the languages in COMMON) only the base rules decide.
    Further columns are ignored; rows that repeat come out alike.
    """
    rules = rules or Rules()
    measured = materialize(measure(documents), "measured")
    found = references(measured)
    least = lambda parts: "0D" if not parts else parts[0] if len(parts) == 1 else f"least({', '.join(parts)})"
    char = least([_char_distance(found[k][0]) for k in sorted(found)])
    word = least([_word_distance(found[k][1]) for k in sorted(found)])
    judged = measured.selectExpr(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", f"{char} AS char_distance", f"{word} AS word_distance",
        f"n_words < {rules.least_words} OR 100 * n_repeat_words > {rules.repeat_percent} * n_words AS base_failed",
    )
    kept = f"NOT base_failed AND (n_words < {rules.char_words} OR char_distance <= {rules.char_distance}D) AND (n_words < {rules.word_words} OR word_distance <= {rules.word_distance}D)"
    return judged.selectExpr("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance", "base_failed", f"{kept} AS kept")
