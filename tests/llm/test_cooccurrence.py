"""Pair counts against brute force; the null keeps the margins; tails against enumeration."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from terralace.llm import cooccurrence as c


def test_counts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(c, "CHUNK_CODES", 7)
    monkeypatch.setattr(c, "FLUSH_PAIRS", 11)
    rng = random.Random(1)
    rows = [(rng.choice([*[f"b{i}" for i in range(30)], "hot", "other", None]), rng.choice([*"abcdefgh", None])) for _ in range(500)]
    rows += [("wide", f"w{i:02d}") for i in range(30)] + rows[:50]
    baskets = [(f"b{i}",) for i in range(30)] + [("hot",), ("wide",), ("empty",), ("empty",), (None,)]
    o, b = spark.createDataFrame(rows, "basket string, item string").selectExpr("*", "1 AS no"), spark.createDataFrame(baskets, "basket string")
    pairs, n = c.co_occurrence(o, b)
    held = {}
    for k, i in rows:
        if k and i and (k,) in baskets:
            held.setdefault(k, set()).add(i)
    freq = Counter(i for v in held.values() for i in v)
    want = Counter(p for v in held.values() for p in combinations(sorted(v), 2))
    assert n == 33
    assert {(r["item_a"], r["item_b"]): (r["n_ab"], r["n_a"], r["n_b"]) for r in pairs.collect()} == {p: (k, freq[p[0]], freq[p[1]]) for p, k in want.items()}


def test_null_keeps_frequencies_and_sizes():
    freq, sizes = {40: 1, 10: 5, 3: 8}, {1: 30, 2: 20, 4: 11}
    assert sum(k * n for k, n in freq.items()) == sum(k * n for k, n in sizes.items())
    x, y = c.fit_null(freq, sizes)
    p = lambda f, k: x[f] * y[k] / (1 + x[f] * y[k])
    for f in freq:
        assert abs(sum(n * p(f, k) for k, n in sizes.items()) - f) < 1e-3
    for k in sizes:
        assert abs(sum(n * p(f, k) for f, n in freq.items()) - k) < 1e-3
    assert c.fit_null({}, {}) == ({}, {})
    with pytest.raises(RuntimeError):
        c.fit_null(freq, sizes, rounds=1)


def test_the_null_decides_where_baskets_differ_in_size(spark):
    """Two large baskets hold all items: by frequency alone their pairs look surprising, by basket size they don't."""
    rows = [(f"big{b}", f"i{i:02d}") for b in range(3) for i in range(30)] + [(f"b{b}", f"i{b % 30:02d}") for b in range(300)]
    o, baskets = spark.createDataFrame(rows, "basket string, item string"), spark.createDataFrame([(b,) for b in {r[0] for r in rows}], "basket string")
    pairs, n = c.co_occurrence(o, baskets)
    got = c.surprise(pairs, o, baskets).collect()
    assert all(r["n_ab"] * n >= 3 * r["n_a"] * r["n_b"] * 0.5 for r in got) and not any(r["surprising"] for r in got)


def test_tails():
    q, times = np.array([0.1, 0.3, 0.02]), np.array([40, 10, 200])
    mass = np.array([1.0])
    for chance, n in zip(q, times):
        for _ in range(n):
            mass = np.convolve(mass, [1 - chance, chance])
    for least in (0, 1, 5, 11, 15, 25, 300):
        assert abs(c.tail(q, times, least) - mass[least:].sum()) < 1e-9
    exact = [c.tail(q, times, k) for k in range(1, 30)]
    limit, c.EXACT_BASKETS = c.EXACT_BASKETS, 10
    try:
        near = [c.tail(q, times, k) for k in range(1, 30)]
    finally:
        c.EXACT_BASKETS = limit
    assert all(abs(a - b) < 0.02 and (b < 1e-6 or 0.8 < a / b < 1.25) for a, b in zip(near, exact) if abs(b - 0.5) > 0.05)


def test_a_planted_pair_is_found(spark):
    rng = random.Random(2)
    rows = []
    for b in range(400):
        items = {i for i in "abcdefghij" if rng.random() < 0.15}
        if rng.random() < 0.2:
            items |= {"x", "y"}
        rows += [(f"b{b}", i) for i in items]
    o = spark.createDataFrame(rows, "basket string, item string")
    baskets = spark.createDataFrame([(f"b{b}",) for b in range(400)], "basket string")
    pairs, _ = c.co_occurrence(o, baskets)
    got = {(r["item_a"], r["item_b"]): r for r in c.surprise(pairs, o, baskets).collect()}
    assert got["x", "y"]["surprising"] and got["x", "y"]["lift"] > 2
    assert sum(r["surprising"] for r in got.values()) <= 4
    assert all(r["q_value"] >= r["p_value"] * 0.99 for r in got.values())


def test_empty(spark):
    o, b = spark.createDataFrame([], "basket string, item string"), spark.createDataFrame([], "basket string")
    pairs, n = c.co_occurrence(o, b)
    assert n == 0 and pairs.count() == 0 and c.surprise(pairs, o, b).count() == 0
