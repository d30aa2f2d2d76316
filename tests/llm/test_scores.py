"""Quality classifier, toxicity and quality rules."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import prose, word
from larkspur.llm import quality_classifier as Q
from larkspur.llm import quality_rules as R
from larkspur.llm import toxicity as T

TERMS = ["idiota", "basurero", "maldito", "cretino"]


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = prose(rng, rng.randint(30, 120))
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.7)
        if toxic:
            words = text.split(" ")
            for _ in range(4):
                t = rng.choice(TERMS)
                if rng.random() < 0.3:
                    k = rng.randrange(len(t))
                    t = t[:k] + rng.choice("xyz") + t[k + 1 :]
                words.insert(rng.randrange(len(words)), t)
            text = " ".join(words)
        if not good:
            text, toxic = (" ".join(w.upper() + "!!" for w in text.split()), toxic) if i % 2 else ((text.split(" ")[0] + " ") * 80, 0)
        out.append((i, text, good, toxic))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    extra = [(5000, None), (5001, ""), (5002, "z" * 1_000_000), (5003, "palabra " * 100_000), (None, "sin id"), (5001, "")]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _, _ in rows] + [(i, t, None) for i, t in extra], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows] + [(None, 1, 1), (0, None, None), (7000, 1, 0)], "doc_id long, quality int, toxic int")
    return docs.cache(), labels.cache(), {i: (q, t) for i, _, q, t in rows}, len(rows) + len(extra)


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out_accuracy(tables, kind):
    docs, labels, truth, n = tables
    if kind == "quality":
        scored, folds, fold = Q.with_fold(Q.score_quality(docs, Q.fit_quality(docs, labels))), Q.FOLDS, Q.HELD_OUT
    else:
        scored, folds, fold = T.with_fold(T.score_toxicity(docs, T.fit_toxicity(docs, labels))), T.FOLDS, T.HELD_OUT
    rows = scored.collect()
    assert len(rows) == n and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) for r in rows if r.doc_id is not None)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    right = [r.predicted == truth[r.doc_id][kind == "toxic"] for r in held]
    assert len(held) > 100 and sum(right) / len(right) > 0.95


def test_held_out_labels_change_nothing(tables, spark):
    docs, labels, truth, _ = tables
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, (q, t) in truth.items()], "doc_id long, quality int, toxic int")
    straight = spark.createDataFrame([(i, q, t) for i, (q, t) in truth.items()], "doc_id long, quality int, toxic int")
    a, b = Q.fit_quality(docs, flipped), Q.fit_quality(docs, straight)
    assert np.array_equal(a.value, b.value) and np.array_equal(a.threshold, b.threshold)


def test_no_labels(tables, spark):
    docs, labels, _, n = tables
    for none in (labels.where("false"), labels.where("quality = 1 AND toxic = 0")):
        assert Q.score_quality(docs, Q.fit_quality(docs, none)).count() == n
        assert T.score_toxicity(docs, T.fit_toxicity(docs, none)).count() == n
    empty = docs.where("false")
    assert Q.score_quality(empty, Q.fit_quality(empty, labels)).count() == 0
    assert T.score_toxicity(empty, T.fit_toxicity(empty, labels)).count() == 0


def test_trees_equal_a_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    model = Q.fit_trees(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=20)
    for row, raw in zip(x, model.raw(x), strict=True):
        total = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += v[node - len(f)]
        assert abs(total - raw) < 1e-9
    assert ((model.score(x) >= 0.5) == (x[:, 0] * x[:, 1] > 0)).mean() > 0.9


def test_first_splits_are_the_best():
    """The root of the first tree against every cut of every statistic, and the leaves against plain sums."""
    rng = np.random.default_rng(5)
    for seed in range(6):
        x, rest = rng.normal(size=(120, 3)).round(1), 1.0
        y = ((x[:, seed % 3] > 0.3) ^ (rng.random(120) < 0.15)).astype(float)
        model = Q.fit_trees(x, y, trees=1, depth=1, rate=1.0, bins=8, ridge=rest)
        p = y.mean()
        best = []
        for j in range(3):
            for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 9)[1:-1])):
                gain = 0.0
                for side in (x[:, j] <= cut, x[:, j] > cut):
                    g, h = sum(p - v for v in y[side]), p * (1 - p) * side.sum()
                    gain += g * g / (h + rest)
                    if h < 2.0:
                        gain = -np.inf
                best.append((gain, j, cut))
        top = max(best)[0]
        assert any(abs(gain - top) < 1e-9 and (model.feature[0, 0], model.threshold[0, 0]) == (j, cut) for gain, j, cut in best)
        left = x[:, model.feature[0, 0]] <= model.threshold[0, 0]
        for value, side in zip(model.value[0], (left, ~left), strict=True):
            assert abs(value + sum(p - v for v in y[side]) / (p * (1 - p) * side.sum() + rest)) < 1e-9


def test_scores_of_whole_tables(tables):
    """The query's scores are those of a model fitted and walked text by text in plain Python."""
    docs, labels, truth, _ = tables
    got = {r.doc_id: r.score for r in Q.score_quality(docs.select("doc_id", "text"), Q.fit_quality(docs, labels)).collect() if r.doc_id in truth}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in truth}
    one = lambda t: Q.statistics(pa.array([t], pa.string()))[0]
    learned = sorted((truth[i][0], list(one(t))) for i, t in texts.items() if zlib.crc32(str(i).encode()) % 3 != 1)
    model = Q.fit_trees(np.array([x for _, x in learned]), np.array([y for y, _ in learned], dtype=float))
    for i, t in texts.items():
        raw = model.base
        x = one(t)
        for feature, threshold, value in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
            raw += value[node - len(feature)]
        assert abs(got[i] - 1 / (1 + math.exp(-raw))) < 1e-6, i


def test_statistics():
    texts = ["", None, "Abc 12!\nabc abc", "é é é"]
    x = Q.statistics(pa.array(texts, pa.string()))
    f = {n: i for i, n in enumerate(Q.FEATURES)}
    assert not x[0].any() and not x[1].any()
    assert x[2, f["log_words"]] == math.log1p(4) and x[2, f["distinct"]] == 0.5 and x[2, f["top_word"]] == 0.75 and x[2, f["upper"]] == 1 / 15
    assert x[3, f["repeat_1"]] == 1 and abs(x[3, f["high"]] - 6 / 8) < 1e-12


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row, old = [i], row
        for j, d in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != d)))
    return row[-1]


def test_automaton_equals_distances():
    rng = random.Random(4)
    terms = sorted({word(rng) for _ in range(40)})
    lexicon = T.Lexicon({t: 1.0 for t in terms}, {})
    words = [word(rng) for _ in range(500)] + terms + [t[:-1] for t in terms] + [t + "a" for t in terms] + [t[:2] + "x" + t[3:] for t in terms] + ["", "x"]
    for w in words:
        best = min((d for t in terms if (d := distance(w, t)) <= (1 if len(t) >= 5 else 0)), default=None)
        found = lexicon.find(w)
        assert (found[1] if found else None) == best
        assert not found or distance(w, terms[found[0]]) == best


def test_quotation():
    assert T.quoted('dijo que "eres un ', "idiota", '" y se fue')
    assert T.quoted("el juez escribió que ", "idiota", " no")
    assert not T.quoted("eres un ", "idiota", " y ya")
    finder = T.Finder(T.Lexicon({"idiota": 3.0}, {"basur": 2.0}))
    x = finder.features(pa.record_batch({"text": ["eres un idiota", 'un "idiota" decían', "basurilla", "1diota", "nada", None, "idiotas idiota"]}))
    assert [list(np.flatnonzero(r[:4])) for r in x] == [[0], [3], [1], [2], [], [], [0, 2]]


def test_one_tokenisation():
    """A term is found wherever learning would have seen it as a word: between any signs."""
    finder = T.Lexicon({"idiota": 3.0, "moron": 2.0}, {})
    for text in ("d'idiota", "idiota-nada", "nada/idiota", "(l'idiota)", "uno_idiota", "uno2idiota"):
        assert finder.look_up(text)[:2] == (1, 3.0), text
    assert finder.look_up("moron-idiota")[:2] == (1, 3.0)
    assert finder.look_up("d'idiotta")[0] == 3 and finder.look_up("uno-dos")[0] == 0


def base_counts(x):
    w = re.findall(r"[^\x20\x09-\x0D]+", x or "")
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (x or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((x or "").count(s) for s in "#*$%&|<>"), dup, len(covered)


def jsd(p, q):
    m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in {*p, *q}}
    half = lambda a: sum(v * math.log2(v / m[k]) for k, v in a.items() if v)
    return math.sqrt(max(0, (half(p) + half(q)) / 2))


def test_rules_against_brute_force(spark):
    rng = random.Random(6)
    english = R.COMMON["en"].split()
    texts = [" ".join(rng.choice(english) if rng.random() < 0.5 else word(rng) for _ in range(rng.randint(5, 200))) for _ in range(60)]
    texts += ["a b c a b c a b", "x y", "", None, "\x0b\x0c", "l\nl\n\n\nl #|$", "%% && ## " * 60, "ABC DEF " * 60, " ".join(str(i % 40) for i in range(400)), "😀 é " * 40, "solo " * 100_000, " ".join(map(str, range(30_000))) + " " + " ".join(map(str, range(30_000)))]
    rows = [(i, t, "en" if i < 60 else None, 1) for i, t in enumerate(texts)] + [(1, texts[1], "xx", 1), (None, "una dos", "es", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, words int")
    got = R.quality_rules(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        n, chars, symbols, dup, repeat = base_counts(t)
        r = by[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat), i
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.base_failed and r.kept)
    vocabulary = {w for x in R.COMMON.values() for w in x.split()}
    common = lambda t: Counter(w.lower() if w.lower() in vocabulary else "" for w in re.findall(r"[^\W\d_]+", t or ""))
    total = sum((common(t) for t in texts[:60]), Counter())
    share = lambda c: {k: v / sum(c.values()) for k, v in c.items()}
    spanish = share(common("una dos"))
    for i in range(60):
        c = common(texts[i])
        expected = min(jsd(share(c), share(total)), jsd(share(c), spanish)) if c else 1.0
        assert abs(by[i].word_distance - expected) < 1e-6
    assert by[66].kept is False and by[67].kept is False


def test_either_histogram_decides(spark):
    """Long texts without common words and texts of signs are rejected each by its own histogram; signs at a word's edges hide no common word."""
    rng = random.Random(8)
    english = R.COMMON["en"].split()
    plain = lambda: [rng.choice(english) if rng.random() < 0.5 else word(rng) for _ in range(300)]
    texts = [" ".join(plain()) for _ in range(40)] + [" ".join(word(rng) for _ in range(300)), " ".join(w + "," * (i % 4 == 0) for i, w in enumerate(plain())), " ".join(w + "%%%&&&" for w in plain()), "12 34 " * 20 + " ".join(map(str, range(200)))]
    got = {r.doc_id: r for r in R.quality_rules(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")).collect()}
    rules = R.Rules()
    assert all(got[i].kept for i in range(40))
    assert not got[40].kept and got[40].word_distance > rules.word_distance and got[40].char_distance <= rules.char_distance
    assert got[41].kept
    assert not got[42].kept and got[42].char_distance > rules.char_distance and got[42].word_distance <= rules.word_distance
    assert not got[43].kept and got[43].word_distance == 1.0


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert R.quality_rules(df).count() == 0


