"""The fuzzy fold against the sequential one, and the bounds that its join relies on."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.functions.scalars import common_length, token_sort_ratio
from lodestrata.operators import alike


def longest(x, y):
    row = [0] * (len(y) + 1)
    for c in x:
        last = 0
        for k, e in enumerate(y, 1):
            last, row[k] = row[k], last + 1 if c == e else max(row[k], row[k - 1])
    return row[-1]


def fold(phrases, score):
    first = {}
    for p, position in phrases:
        if p is not None:
            p = p.strip().lower()
            first[p] = min(position, first.get(p, position))
    found = {}
    for p in sorted(first, key=lambda p: (first[p], p)):
        hit = next((c for c in found if token_sort_ratio(c, p) >= score), None)
        found.setdefault(p, []) if hit is None else found[hit].append(p)
    return found


@given(st.text("abcd", max_size=30), st.text("abcd", max_size=30))
def test_common_length(x, y):
    assert common_length(x, y) == longest(x, y)


@given(st.text("abc", min_size=1, max_size=24), st.text("abc", min_size=1, max_size=24), st.sampled_from([60.0, 75.0, 88.0, 95.0, 100.0]))
@settings(max_examples=500)
def test_bounds_of_common_grams(x, y, score):
    if 200.0 * longest(x, y) < score * (len(x) + len(y)):
        return
    q, share = alike.gram_size(score), score / 200
    assert alike.least_length(len(x), share) <= len(y)
    if min(len(x), len(y)) >= q:
        shared = sum((Counter(x[k : k + q] for k in range(len(x) - q + 1)) & Counter(y[k : k + q] for k in range(len(y) - q + 1))).values())
        assert shared >= max(alike.least_common(len(s), share, q) for s in (x, y))
    else:
        assert x == y


def made(r, n):
    words = ["".join(r.choices("abcde", k=r.randrange(3, 7))) for _ in range(12)]
    out = []
    for k in range(n):
        p = list(" ".join(r.choices(words, k=r.randrange(1, 4))))
        for _ in range(r.randrange(3)):
            p[r.randrange(len(p))] = r.choice("abcde ")
        out.append(("".join(p), r.randrange(n // 2)))
    return out


@pytest.mark.parametrize("score,seed", [(88.0, 1), (60.0, 2), (100.0, 3), (80.0, 4)])
def test_fold(spark, score, seed):
    phrases = made(random.Random(seed), 260) + [("A b", 3), ("b  A", 1), (None, 0), ("x", 5), ("X ", 9), ("", 7), ("   ", 8), ("ü", 4), ("same same", 6), ("same", 6)]
    df = spark.createDataFrame(phrases, "phrase string, position long")
    assert {r["canonical"]: r["aliases"] for r in alike.fuzzy_unique(df, score).collect()} == fold(phrases, score)
    assert alike.fuzzy_unique(df.limit(0), score).collect() == []


def test_a_chain_of_neighbours(spark):
    """Each phrase is alike to the next only: every other one is canonical."""
    phrases = [("".join(chr(0x100 + k + j) for j in range(10)), k) for k in range(30)]
    df = spark.createDataFrame(phrases, "phrase string, position long")
    got = alike.fuzzy_unique(df, 90.0)
    assert {r["canonical"]: r["aliases"] for r in got.collect()} == fold(phrases, 90.0)


def test_parts(spark, sf_dir):
    rows = [(r["p_name"], r["p_partkey"]) for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()]
    got = {r["canonical"]: r["n"] for r in alike.QUERIES["in_fuzzy_unique"](spark, sf_dir).collect()}
    assert got == {c: len(a) for c, a in fold(rows, 88.0).items()}
