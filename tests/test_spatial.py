"""The dual-tree join and the grid join against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terralace.operators.spatial import dual_tree_pairs, grid_join, points_in_regions, points_near_points, region_pieces

REGION = "region_id long, shape string, lat double, lon double, radius_m double, lat_min double, lat_max double, lon_min double, lon_max double"
POINT = "id long, lat double, lon double"


def metres(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371000 * math.asin(min(1, math.sqrt(h)))


def inside(p, r):
    _, la, lo = p
    if la is None or lo is None or la != la or lo != lo or not -90 <= la <= 90 or not -180 <= lo <= 180 or (la == 0 and lo == 0):
        return False
    _, shape, rla, rlo, rad, s, n, w, e = r
    if shape == "circle":
        return None not in (rla, rlo, rad) and metres(la, lo, rla, rlo) <= rad
    if None in (s, n, w, e):
        return False
    return s <= la <= n and ((lo >= w or lo <= e) if w > e else w <= lo <= e)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    centres = [(rng.uniform(-80, 80), rng.choice([rng.uniform(-180, 180), 179.99, -179.99])) for _ in range(12)] + [(89.9, 10.0), (-89.99, -170.0)]
    regions = []
    for i, (la, lo) in enumerate(centres):
        regions.append((i, "circle", la, lo, rng.choice([100.0, 3000.0, 60_000.0]), None, None, None, None))
        w = lo - 0.05
        e = lo + 0.05
        regions.append((100 + i, "box", None, None, None, la - 0.03, min(90.0, la + 0.03), w + 360 if w < -180 else w, e - 360 if e > 180 else e))
    regions += [(900, "circle", 1.0, 1.0, None, None, None, None, None), (901, "box", None, None, None, 1.0, 2.0, None, 3.0), (902, "circle", 89.0, 0.0, 300_000.0, None, None, None, None), (903, "circle", 5.0, 5.0, 0.0, None, None, None, None)]
    points = []
    for i in range(1500):
        la, lo = rng.choice(centres)
        la, lo = la + rng.gauss(0, 0.03), lo + rng.gauss(0, 0.05)
        points.append((i, max(-90.0, min(90.0, la)), lo - 360 if lo > 180 else lo + 360 if lo < -180 else lo))
    points += [(2000, None, 1.0), (2001, 0.0, 0.0), (2002, 91.0, 0.0), (2003, float("nan"), 0.0), (2004, 90.0, 55.0), (2005, -90.0, 0.0), (2006, 10.0, 180.0), (2007, 10.0, -180.0), (2008, 5.0, 5.0), (2009, 5.0, 5.0)]
    points += [(3000 + i, centres[0][0], centres[0][1]) for i in range(700)]  # a third at one place
    p = spark.createDataFrame(points, POINT).withColumn("shape", F.lit("clash")).withColumn("x", F.lit(1))
    got = sorted((r["id"], r["region_id"]) for r in points_in_regions(p, spark.createDataFrame(regions, REGION)).collect())
    assert got == sorted((a[0], b[0]) for a in points for b in regions if inside(a, b))


def test_coarse_trees_give_the_same(spark):
    regions = spark.createDataFrame([(1, "circle", 0.5, 0.5, 30_000.0, None, None, None, None), (2, "box", None, None, None, -1.0, 1.0, 179.0, -179.0)], REGION)
    points = spark.createDataFrame([(i, (i % 40) / 20 - 1, (i // 40) / 20 - 1) for i in range(1600)] + [(9000, 0.3, -179.5)], POINT)
    deep, flat = (sorted(map(tuple, points_in_regions(points, regions, leaf=n).select("id", "region_id").collect())) for n in (14, 3))
    assert deep == flat and (9000, 2) in deep


def test_sure_nodes_are_accepted_at_their_level(spark):
    regions = spark.createDataFrame([(1, "box", None, None, None, -90.0, 90.0, 0.0, 180.0), (2, "box", None, None, None, -90.0, 90.0, 10.0, 9.0)], REGION)
    points = [(i, (i % 50) * 3.5 - 87, (i // 50) * 5.9 - 176.9) for i in range(3000)]
    df = spark.createDataFrame(points, POINT)
    pairs = dual_tree_pairs(df, region_pieces(regions.where("region_id = 1")))
    assert pairs.count() <= 256 and {r["level"] for r in pairs.select("level").distinct().collect()} == {4}
    for leaf in (14, 2):
        got = sorted((r["id"], r["region_id"]) for r in points_in_regions(df, regions, leaf=leaf).collect())
        want = [(i, 1) for i, _, lo in points if lo >= 0] + [(i, 2) for i, _, lo in points if lo >= 10 or lo <= 9]
        assert got == sorted(want)


def test_points_near_points_over_the_meridian_and_the_pole(spark):
    rng = random.Random(8)
    spot = lambda: (rng.choice([rng.gauss(89.8, 0.2), rng.gauss(10, 0.2), rng.gauss(-45, 0.2)]), rng.choice([rng.uniform(-180, 180), rng.choice([-1, 1]) * rng.uniform(179.7, 180)]))
    a, b = ([(i, min(90.0, la), lo) for i, (la, lo) in enumerate(spot() for _ in range(n))] for n in (300, 60))
    a += [(900, None, 1.0), (901, 0.0, 0.0), (902, *b[0][1:]), (902, *b[0][1:])]
    p = spark.createDataFrame(a, POINT).withColumn("near_id", F.lit("clash")).withColumn("region_id", F.lit(5))
    o = spark.createDataFrame(b + [(800, None, 2.0), (None, 1.0, 1.0)], POINT).withColumnRenamed("id", "near_id")
    got = sorted((r["id"], r["near_id"]) for r in points_near_points(p, o, 25_000.0).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] is not None and x[0] != 901 and metres(*x[1:], *y[1:]) <= 25_000)
    assert points_near_points(p.limit(0), o, 5.0).count() == 0
    with pytest.raises(ValueError):
        points_near_points(p, o, -1.0)


def test_empty_sides(spark):
    r, p = spark.createDataFrame([], REGION), spark.createDataFrame([], POINT)
    one = spark.createDataFrame([(1, "circle", 1.0, 1.0, 10.0, None, None, None, None)], REGION)
    at = spark.createDataFrame([(1, 1.0, 1.0)], POINT)
    assert points_in_regions(p, one).count() == 0 and points_in_regions(at, r).count() == 0 and points_in_regions(at, one).count() == 1


def test_grid_join_equals_brute_force(spark):
    rng = random.Random(4)
    a = [(i, rng.choice("uv"), rng.uniform(-1, 1), rng.uniform(-1, 1)) for i in range(150)] + [(999, "u", None, 0.0)]
    b = [(i, rng.choice("uv"), rng.uniform(-1, 1), rng.uniform(-1, 1)) for i in range(150)]
    schema = "id int, label string, x double, y double"
    got = sorted((r["l_id"], r["r_id"]) for r in grid_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 0.2, ["label"]).collect())
    assert got == sorted((p[0], q[0]) for p in a for q in b if p[2] is not None and p[1] == q[1] and math.hypot(p[2] - q[2], p[3] - q[3]) <= 0.2)
    with pytest.raises(ValueError):
        grid_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 0)
