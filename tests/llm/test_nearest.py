"""Nearest in time against brute force."""

import random

import pytest

from terralace.llm.nearest import first_width, nearest_in_time, rings


def brute(left, right, tolerance):
    out = {}
    for i, k, t in left:
        fit = [(abs(t - rt), rt, r) for r, rk, rt in right if None not in (k, t, r, rk, rt, i) and rk == k and abs(t - rt) <= tolerance] if None not in (i, k, t) else []
        if fit:
            out[i] = (min(fit)[2], min(fit)[0])
    return out


@pytest.mark.parametrize("seed, hot", [(1, 50_000_000), (2, 50)])
def test_equals_brute_force(spark, seed, hot):
    rng = random.Random(seed)
    when = lambda: rng.choice([None, rng.randrange(20_000), rng.randrange(20_000), -rng.randrange(500)])
    left = [(f"l{i}", rng.choice(["hot", "hot", "a", None]), when()) for i in range(400)] + [("l0", "hot", 5), ("x", "hot", 100), (None, "hot", 1)]
    left = [r for i, r in enumerate(left) if r[0] is None or r[0] not in {q[0] for q in left[:i]}]
    right = [(f"r{i:03d}", rng.choice(["hot", "a", "b", None]), when()) for i in range(120)] + [("r000x", "hot", 60), ("r000y", "hot", 140), ("r000z", "hot", 60), (None, "hot", 100)]
    l = spark.createDataFrame(left, "left_id string, key string, t_us long").selectExpr("*", "1 AS bucket", "2 AS r_us")  # noqa: E741
    r = spark.createDataFrame(right, "right_id string, key string, t_us long")
    for tolerance, first in ((120, None), (120, 1), (7, 100), (0, None)):
        got = {x["left_id"]: (x["right_id"], x["gap_us"]) for x in nearest_in_time(l, r, tolerance, first, hot).collect()}
        assert got == brute(left, right, tolerance)


def test_first_width_follows_the_data(spark):
    schema = "key string, r_us long, right_id string"
    sparse = spark.createDataFrame([("k", i * 1_000_000, f"r{i}") for i in range(50)], schema)
    dense = spark.createDataFrame([("k", i * 10, f"r{i}") for i in range(5000)], schema)
    assert first_width(sparse, 120_000) == (120_000, 1)
    width, most = first_width(dense, 120_000)
    assert width < 1_000 and most <= width // 10 + 1
    assert first_width(sparse.limit(0), 7) == (7, 0)


def test_rings_double_up_to_the_tolerance():
    assert rings(120, 15) == [15, 30, 60, 120] and rings(100, 15) == [15, 30, 60, 100] and rings(10, 50) == [10]


def test_empty(spark):
    l, r = spark.createDataFrame([], "left_id string, key string, t_us long"), spark.createDataFrame([], "right_id string, key string, t_us long")
    assert nearest_in_time(l, r, 10).count() == 0
