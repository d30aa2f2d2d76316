"""Toxicity: a lexicon trie met by Levenshtein automata, and scores of context windows.

The lexicon (terms and stems) is learned from labelled documents.  Its trie is
intersected with the Levenshtein automaton of each word: the reachable pairs of
trie node and edits are followed as one state of a deterministic automaton that
is built as words need it.  Each hit is scored in its window of words: hits
inside quotation marks or after a word of reporting count as quotation, hits in
company of others as abuse.  A logistic model over these sums gives the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_fold, labelled_sample, lean, materialize, with_results
from .wordhash import slices, string_buffers, words_with_spans

#: Labelled documents that the lexicon and the model are fitted on, at most.
SAMPLE = 20_000
#: Terms in the lexicon, at most.
TERMS = 4000
WINDOW = 8
FOLDS, HELD_OUT = 5, 0
_QUOTES = "\"'“”„«»‘’‹›"
#: Words that report another's speech.
REPORTING = frozenset("said says say quoted quotes quote wrote writes called calls told replied claims dit disait écrit cité sagte sagt schrieb zitiert nannte dijo dice escribió citó llamó".split())
#: Signs written for letters.
SIGNS = str.maketrans("013457@$!", "oleastasi")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
#: Words as they are learned: letters only.
_LETTERS = re.compile(r"[^\W\d_]+")
FEATURES = ("exact", "stem", "near", "quoted", "density", "distinct", "crowd", "bias")


def normalise(word: str) -> str:
    word = word.lower()
    return _EDGES.sub("", word)


class Lexicon:
    """Terms in a trie and the lazily determinised product with Levenshtein automata.

    A term of at least `fuzzy` letters is found with one edit (a letter too many, too few or
    another one; two letters in each other's place are two edits), shorter ones exactly.  A stem is
    found as the beginning of a word.  A word between spaces is looked up as it is and, where it has several
    runs of letters, run by run, as the lexicon is learned.
    """

    def __init__(self, terms: dict[str, float], stems: dict[str, float], fuzzy: int = 5) -> None:
        self.terms, self.stems, self.fuzzy = sorted(terms), dict(stems), fuzzy
        self.weight = [terms[t] for t in self.terms]
        self.children: list[dict[str, int]] = [{}]
        self.final: list[int] = [-1]
        self.longest: list[int] = [0]
        for i, term in enumerate(self.terms):
            node = 0
            self.longest[0] = max(self.longest[0], len(term))
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.final.append(-1)
                    self.longest.append(0)
                node = self.children[node][c]
                self.longest[node] = max(self.longest[node], len(term))
            self.final[node] = i
        self.stem_sizes = sorted({len(s) for s in stems})
        self.reset()

    def reset(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.start = self._state(self._closure({(0, 0)}))

    def _closure(self, pairs: set[tuple[int, int]]) -> frozenset:
        """With letters of the term that the word lacks."""
        out, todo = set(pairs), list(pairs)
        while todo:
            node, edits = todo.pop()
            if edits < 1:
                for child in self.children[node].values():
                    if self.longest[child] >= self.fuzzy and (child, edits + 1) not in out:
                        out.add((child, edits + 1))
                        todo.append((child, edits + 1))
        return frozenset(p for p in out if p[1] == 0 or (p[0], 0) not in out)

    def _state(self, pairs: frozenset) -> int:
        if pairs not in self.states:
            self.states[pairs] = len(self.members)
            self.members.append(pairs)
            self.steps.append({})
            found = [(e, self.final[n]) for n, e in pairs if self.final[n] >= 0 and (e == 0 or len(self.terms[self.final[n]]) >= self.fuzzy)]
            best = min(found, key=lambda x: (x[0], -self.weight[x[1]], x[1])) if found else None
            self.accepts.append((best[1], best[0]) if best else None)
        return self.states[pairs]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, edits in self.members[state]:
            child = self.children[node].get(c)
            if child is not None:
                out.add((child, edits))
            if edits < 1 and self.longest[node] >= self.fuzzy:
                out.add((node, edits + 1))  # a letter too many
                out |= {(other, edits + 1) for other in self.children[node].values() if self.longest[other] >= self.fuzzy}
        to = self._state(self._closure(out)) if out else -1
        self.steps[state][c] = to
        return to

    def find(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term, or None."""
        state = self.start
        for c in word:
            to = self.steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return None
        return self.accepts[state]

    def look_up(self, word: str) -> tuple[int, float, int]:
        """Kind (0 none, 1 exact, 2 stem, 3 near), weight and an identity of what was found, the best of the word and its runs of letters."""
        word = normalise(word)
        runs = _LETTERS.findall(word)
        found = [self._look_up(w) for w in ([word] if runs == [word] else [word, *runs])]
        return min((x for x in found if x[0]), key=lambda x: (x[0], -x[1], x[2]), default=(0, 0.0, 0))

    def _look_up(self, word: str) -> tuple[int, float, int]:
        found = self.find(word)
        if found is None and (plain := word.translate(SIGNS)) != word:
            found = self.find(plain)
            if found and found[1] == 0:
                found = (found[0], 1)
        if found and found[1] == 0:
            return 1, self.weight[found[0]], found[0]
        for size in reversed(self.stem_sizes):
            if (stem := word[:size]) in self.stems:
                return 2, self.stems[stem], -1 - hash_of(stem)
        if found:
            return 3, self.weight[found[0]], found[0]
        return 0, 0.0, 0


def hash_of(stem: str) -> int:
    return int.from_bytes(stem.encode()[:6], "big")


class Finder:
    """Lexicon hits in whole texts; what is known of words is kept in arrays of bounded size."""

    KNOWN = 1 << 20

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.keys, self.codes = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
        self.found: list[tuple[int, float, int]] = [(0, 0.0, 0)]
        self.index: dict[tuple[int, float, int], int] = {self.found[0]: 0}

    def codes_of(self, words: np.ndarray, first: np.ndarray, end: np.ndarray, data: np.ndarray) -> np.ndarray:
        distinct, where, back = np.unique(words, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        known = self.keys[at] == distinct if len(self.keys) else np.zeros(len(distinct), dtype=bool)
        codes = np.zeros(len(distinct), dtype=np.int32)
        codes[known] = self.codes[at[known]] if len(self.keys) else 0
        new = np.flatnonzero(~known)
        for i in new:
            lo, hi = int(first[where[i]]), int(end[where[i]])
            hit = self.lexicon.look_up(data[lo:hi].tobytes().decode("utf-8", "replace"))
            if hit[0]:
                if hit not in self.index:
                    self.index[hit] = len(self.found)
                    self.found.append(hit)
                codes[i] = self.index[hit]
        if len(new):
            keys, values = np.concatenate([self.keys, distinct[new]]), np.concatenate([self.codes, codes[new]])
            if len(keys) > self.KNOWN:
                keys, values = distinct, codes
                if len(self.lexicon.members) > 200_000:
                    self.lexicon.reset()
            order = np.argsort(keys)
            self.keys, self.codes = keys[order], values[order]
        return codes[back]

    def features(self, batch: pa.RecordBatch) -> np.ndarray:
        """A row of FEATURES per text."""
        texts = batch.column("text")
        _, data = string_buffers(texts)
        words, at, first, end = words_with_spans(texts)
        out = np.zeros((batch.num_rows, len(FEATURES)))
        out[:, -1] = 1.0
        if not len(words):
            return out
        codes = self.codes_of(words, first, end, data)
        hits = np.flatnonzero(codes)
        rows = np.searchsorted(at, hits, side="right") - 1
        for row in np.unique(rows):
            lo, hi = int(at[row]), int(at[row + 1])
            own = hits[(i := np.searchsorted(hits, lo)) : np.searchsorted(hits, hi)]
            sums, distinct, crowd = [0.0] * 4, set(), 0
            for place in own:
                kind, weight, what = self.found[codes[place]]
                a, b = max(lo, int(place) - WINDOW), min(hi, int(place) + WINDOW + 1)
                company = int(np.searchsorted(own, b) - np.searchsorted(own, a))
                before = data[first[a] : first[place]].tobytes().decode("utf-8", "replace")
                itself = data[first[place] : end[place]].tobytes().decode("utf-8", "replace")
                behind = data[end[place] : end[b - 1]].tobytes().decode("utf-8", "replace")
                if quoted(before, itself, behind):
                    sums[3] += weight
                else:
                    sums[kind - 1] += weight
                    distinct.add(what)
                    crowd = max(crowd, company)
            assert i >= 0
            out[row, :4] = np.log1p(sums)
            out[row, 4] = np.log1p(100.0 * sum(sums[:3]) / max(50, hi - lo))
            out[row, 5] = np.log1p(len(distinct))
            out[row, 6] = np.log1p(crowd)
        return out


def quoted(before: str, word: str, behind: str) -> bool:
    """Whether a hit stands in quotation marks within its window, or shortly after a word of reporting."""
    marks = "\"“”„«»‹›"
    opened = sum(before.count(m) for m in marks) % 2 == 1 or (word[:1] in _QUOTES and word[:1] != "")
    closed = any(m in behind for m in marks) or word.rstrip(".,;:!?")[-1:] in tuple(_QUOTES)
    if opened and closed:
        return True
    return any(normalise(w) in REPORTING for w in before.split()[-3:])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps on the ridge-penalised likelihood; the last column (bias) isn't penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


class ToxicityModel:
    def __init__(self, lexicon: tuple[dict[str, float], dict[str, float]], weights: np.ndarray) -> None:
        self.lexicon, self.weights = lexicon, weights

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights, -30, 30)))


def _finder(lexicon: tuple[dict[str, float], dict[str, float]]) -> Finder:
    return Finder(Lexicon(*lexicon))


def _features(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(lexicon.value)
        for batch in batches:
            for part in slices(batch):
                x = finder.features(part)
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])

    return run


def learn_lexicon(sample: DataFrame, terms: int = TERMS) -> tuple[dict[str, float], dict[str, float]]:
    """Words and word beginnings (4 to 6 letters) that mark toxic documents: (terms, stems), with log odds.

    sample: text, label of labelled documents.  Kept are those in 3 toxic documents at least (a stem: 8)
    that are ten times as frequent there as elsewhere.  At most `terms` of each, by log odds.
    """
    words = F.expr("array_distinct(transform(split(lower(text), '[^\\\\p{L}]+'), w -> w))")
    docs = sample.select("label", words.alias("words"))
    n = docs.agg(F.sum("label").alias("p"), F.count("*").alias("n")).first()
    positive, rest = n["p"] or 0, (n["n"] or 0) - (n["p"] or 0)
    if not positive or not rest:
        return {}, {}
    odds = F.log((F.col("p") + 0.5) / (positive + 1)) - F.log((F.col("n") - F.col("p") + 0.5) / (rest + 1))

    def marked(items: F.Column, least: int, shortest: int) -> dict[str, float]:
        counts = docs.select("label", F.explode(items).alias("w")).groupBy("w").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
        top = counts.where((F.length("w") >= shortest) & (F.col("p") >= least) & (odds > float(np.log(10.0)))).select("w", odds.alias("o")).orderBy(F.desc("o"), "w").limit(terms)
        return {r["w"]: float(r["o"]) for r in top.collect()}

    found = marked(F.col("words"), 3, 4)
    stems = marked(F.expr("array_distinct(flatten(transform(filter(words, w -> length(w) >= 5), w -> transform(filter(sequence(4, 6), k -> k < length(w)), k -> left(w, k)))))"), 8, 4)
    return found, stems


def fit_toxicity(documents: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, sample: int = SAMPLE) -> ToxicityModel:
    """Fit lexicon and model on at most `sample` labelled documents outside the held-out fold.

    One half (by hash of the id) gives the lexicon, the other the weights of the
    sums, so that terms seen in fitting don't count for more than new ones.
    Only texts and labels go in.  Without labels of both kinds the score is the
    share of toxic labels (a half without any).
    """
    chosen = labelled_sample(labels, "toxic", folds, held_out, sample)
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")
    texts = materialize(texts, "labelled")
    half = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2))
    lexicon = learn_lexicon(texts.where(half == 0))
    spread = texts.sparkSession.sparkContext.broadcast(lexicon)
    rows = texts.where(half == 1).select("text", "label").mapInArrow(lean(_features(spread)), "label int, x array<double>").collect()
    if not lexicon[0] or len({r["label"] for r in rows}) < 2:
        n = texts.agg(F.avg("label").alias("p")).first()["p"]
        share = min(0.99, max(0.01, 0.5 if n is None else n))
        weights = np.zeros(len(FEATURES))
        weights[-1] = np.log(share / (1 - share))
        return ToxicityModel(lexicon, weights)
    rows.sort(key=lambda r: (r["label"], r["x"]))
    x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], dtype=float)
    return ToxicityModel(lexicon, fit_logistic(x, y))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(model.value.lexicon)
        for batch in batches:
            for part in slices(batch):
                score = np.round(model.value.score(finder.features(part)), 6)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["row", "score", "predicted"])

    return run


def score_toxicity(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """documents with score (0 to 1) and predicted (1 from 0.5 on) behind its columns.

    Null and empty texts get the score of a text without hits.  Columns score
    and predicted of the input are replaced.
    """
    keep = [c for c in documents.columns if c not in ("score", "predicted")]
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return with_results(documents, keep, {"text": F.col("text").cast("string")}, _score(shared), "score double, predicted int")


def with_fold(scored: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    return scored.withColumn("held_out", F.coalesce(crc_fold("doc_id", folds) == held_out, F.lit(False)))
