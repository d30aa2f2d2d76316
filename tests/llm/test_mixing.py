from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from larkspur.llm.mixing import Mix, budgets, mix_sources, share_out

DOCS = "doc_id long, text string, lang string, source string, epoch string"


def domain(source):
    digits = ""
    while source and source[: len(source) - len(digits)][-1:].isdigit() and len(digits) < 9:
        digits = source[-len(digits) - 1 :]
    return f"d{int(digits) % 4}" if digits else "other"


def water(grant, children, weight):
    """Shares by weight within caps: fill, take out the full ones, share the rest again."""
    left, open_, out = float(grant), dict(children), {}
    while open_:
        level = left / sum(weight(k) for k in open_)
        full = [k for k in open_ if open_[k] / weight(k) <= level]
        if not full:
            out.update({k: int(weight(k) * level) for k in open_})
            return out
        for k in full:
            out[k] = open_.pop(k)
            left -= out[k]
    return out


def brute(rows, mix):
    leaves = defaultdict(list)
    for i, text, lang, source in rows:
        leaves[domain(source), lang or "?", source or "?"].append((i, len((text or "").split())))
    tokens = {k: sum(n for _, n in v) for k, v in leaves.items()}
    total = sum(tokens.values()) * mix.share[0] // mix.share[1] if mix.budget is None else mix.budget
    grants = {(): total}
    for depth in (1, 2, 3):
        level = {}
        for parent, grant in grants.items():
            caps = defaultdict(int)
            for k, n in tokens.items():
                if k[: depth - 1] == parent:
                    caps[k[:depth]] += n * mix.epochs
            level.update(water(grant, caps, lambda k: mix.weights.get(k, 1)))
        grants = level
    out = []
    for leaf, docs in leaves.items():
        if not tokens[leaf]:
            out += [(i, 0) for i, _ in docs]
            continue
        whole, rest = divmod(grants[leaf], tokens[leaf])
        out += [(i, e) for e in range(whole) for i, _ in docs]
        key = lambda i: hashlib.md5(f"{mix.seed}:{whole}:{'null' if i is None else i}".encode()).hexdigest()
        by = defaultdict(list)
        for i, n in docs:
            by[key(i)].append((i, n))
        running = 0
        for k in sorted(by):
            running += sum(n for _, n in by[k])
            if running > rest or not rest:
                break
            out += [(i, whole) for i, _ in by[k]]
    return sorted(out, key=str), grants


def rows(n=600, seed=1):
    rng = random.Random(seed)
    out = [(i, "a " * rng.randint(1, 30), rng.choice(["en", "en", "en", "de", None]), rng.choice(["src0"] * 8 + ["src1", "src5", "web", "src6", None])) for i in range(n)]
    return out + [(9000, None, "fr", "src7"), (9001, "", "fr", "src7"), (None, "x y", "en", "src0"), (5, "b b b", "en", "src0"), (5, "b b b", "en", "src0")]


@pytest.mark.parametrize("mix", [Mix(), Mix(budget=900), Mix(budget=10**9, epochs=3), Mix(weights={("d0",): 5, ("d0", "de"): 3, ("d1", "en", "src1"): 2}, budget=4000, seed="z"), Mix(budget=0), Mix(weights={("d0",): 3, ("d1", "en"): 2}, share=(2, 3))])
def test_against_brute_force(spark, mix):
    data = rows()
    df = spark.createDataFrame([(*r, "clash") for r in data], DOCS).repartition(3)
    expected, grants = brute(data, mix)
    got = mix_sources(df, mix)
    assert got.columns == ["doc_id", "text", "lang", "source", "epoch", "domain", "n_tokens"]
    assert sorted(((r.doc_id, r.epoch) for r in got.collect()), key=str) == expected
    found = {(r["__domain"], r["__lang"], r["__source"]): r.grant for r in budgets(df, mix).collect()}
    assert found == grants


def test_equal_leaves(spark):
    data = [(i, "uno dos", lang, f"src{s}") for i, (lang, s) in enumerate((x, y) for x in ("en", "de", "fr") for y in range(8))] + [(90, "", "en", "src9"), (91, None, None, None)]
    for mix in (Mix(), Mix(budget=30), Mix(budget=70, epochs=3)):
        expected, grants = brute(data, mix)
        df = spark.createDataFrame([(*r, "") for r in data], DOCS)
        assert sorted(((r.doc_id, r.epoch) for r in mix_sources(df, mix).collect()), key=str) == expected
        assert {(r["__domain"], r["__lang"], r["__source"]): r.grant for r in budgets(df, mix).collect()} == grants


def test_many_children(spark):
    """Thousands of children of a node, many of them alike, against the same shares taken one by one."""
    rng = random.Random(6)
    for grant in (1_000, 77_777, 400_000, 10**7):
        caps = {f"s{i}": rng.choice([0, 1, 5, 5, 5, rng.randint(0, 900)]) for i in range(3000)}
        weights = {k: rng.choice([1, 1, 1, 2, 7]) for k in caps}
        df = spark.createDataFrame([("", k, c, float(weights[k]), float(grant)) for k, c in caps.items()], "__root string, __source string, cap long, w double, grant double")
        got = {r["__source"]: r.given for r in share_out(df, ["__root"], "given").collect()}
        assert got == water(grant, caps, weights.get)


def test_empty(spark):
    assert mix_sources(spark.createDataFrame([], DOCS)).count() == 0
