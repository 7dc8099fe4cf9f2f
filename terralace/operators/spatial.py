"""Points in regions and points near points by a dual-tree join; grid joins in the plane.

Both sides are put into trees over the same hierarchy of cells. A pair of nodes is compared by its bounding boxes:
pairs that cannot meet are discarded, pairs in which every point lies in every region are accepted wholesale at their
level and not looked at again, and only the rest is refined, level by level, as joins that run on all executors. Exact
tests are left for uncertain leaves.
"""

from __future__ import annotations

from functools import reduce
from math import log2, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralace.sources.tables import small_enough, written

EARTH_M = 6_371_000.0
LEAF = 14
#: Levels of the trees that are compared below the root; the leaves come last.
LEVELS = (4, 8, 11)


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres on a sphere of radius 6,371,000 m (haversine)."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def usable(lat: Column, lon: Column) -> Column:
    """Coordinates that are given and possible; the pair (0, 0) stands for "not given"."""
    return F.coalesce(
        lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False)
    )


def _cell(lat: Column, lon: Column, level: int) -> list[Column]:
    n = 1 << level
    x = F.least(F.floor((lon + 180) / 360 * n), F.lit(n - 1)).cast("int")
    y = F.least(F.floor((lat + 90) / 180 * n), F.lit(n - 1)).cast("int")
    return [x.alias("x"), y.alias("y")]


def region_pieces(regions: DataFrame) -> DataFrame:
    """Regions as pieces with an outer and an inner box; a region across the 180th meridian has two pieces.

    ``regions``: region_id, shape (circle, box), lat, lon, radius_m, lat_min, lat_max, lon_min, lon_max. Regions with
    missing numbers have no piece. Result: region_id, o_* (outer box), i_* (inner box, empty where none is known).
    """
    deg = F.degrees(F.col("radius_m") / EARTH_M)
    # how far a circle reaches in longitude; everywhere if it holds a pole
    free = F.abs("lat") + deg < 90
    reach = F.when(free, F.degrees(F.asin(F.sin(F.radians(deg)) / F.cos(F.radians(F.col("lat"))))))
    slack = 1e-9  # wider than rounding, far below any distance that matters
    circle = regions.where("shape = 'circle' AND radius_m >= 0 AND lat IS NOT NULL AND lon IS NOT NULL").select(
        "region_id", "shape", "lat", "lon", "radius_m", "lat_min", "lat_max", "lon_min", "lon_max",
        (F.col("lat") - deg - slack).alias("o_s"), (F.col("lat") + deg + slack).alias("o_n"),
        F.when(free, F.col("lon") - reach - slack).otherwise(-180.0).alias("o_w"),
        F.when(free, F.col("lon") + reach + slack).otherwise(180.0).alias("o_e"),
        # a box with half of either reach lies well inside the circle
        (F.col("lat") - deg / 2).alias("i_s"), (F.col("lat") + deg / 2).alias("i_n"),
        F.when(free, F.col("lon") - reach / 2).otherwise(999.0).alias("i_w"),
        F.when(free, F.col("lon") + reach / 2).otherwise(-999.0).alias("i_e"),
    )
    regions = regions.where("region_id IS NOT NULL")
    full = "lat_min IS NOT NULL AND lat_max IS NOT NULL AND lon_min IS NOT NULL AND lon_max IS NOT NULL"
    east = F.when(F.col("lon_min") > F.col("lon_max"), F.col("lon_max") + 360).otherwise(F.col("lon_max"))
    box = regions.where(f"shape = 'box' AND {full}").select(
        "region_id", "shape", "lat", "lon", "radius_m", "lat_min", "lat_max", "lon_min", "lon_max",
        *[
            c.alias(f"{k}_{a}")
            for k in "oi"
            for a, c in (("s", F.col("lat_min")), ("n", F.col("lat_max")), ("w", F.col("lon_min")), ("e", east))
        ],
    )
    both = circle.unionByName(box)
    # copies shifted by a turn, cut to [-180, 180]: at most two of them are not empty
    turned = both.withColumn("turn", F.explode(F.array(F.lit(-360.0), F.lit(0.0), F.lit(360.0))))
    for k in "oi":
        turned = turned.withColumn(f"{k}_w", F.greatest(F.col(f"{k}_w") + F.col("turn"), F.lit(-180.0))).withColumn(
            f"{k}_e", F.least(F.col(f"{k}_e") + F.col("turn"), F.lit(180.0))
        )
    return turned.where("o_w <= o_e AND (turn = 0 OR o_w < o_e)").drop("turn")


def _point_nodes(points: DataFrame, level: int) -> DataFrame:
    return points.groupBy(*_cell(F.col("lat"), F.col("lon"), level)).agg(
        F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e")
    )


_OUTER = [F.min, F.max, F.min, F.max]
_INNER = [F.max, F.min, F.max, F.min]


def _up(nodes: DataFrame, down: int, fields: dict) -> DataFrame:
    """Nodes ``down`` levels higher."""
    return nodes.groupBy(F.shiftright("x", down).alias("x"), F.shiftright("y", down).alias("y")).agg(
        *[f(c).alias(c) for c, f in fields.items()]
    )


_REGION = ("lat", "lon", "radius_m", "lat_min", "lat_max", "lon_min", "lon_max")
_PIECE = (*_REGION, "o_w", "o_e")


def dual_tree_pairs(points: DataFrame, pieces: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Descend both trees: level, x, y (a node of the points' tree), region_id, the region's numbers, and ``sure``.

    ``points``: lat, lon, all usable. ``pieces``: see region_pieces. A sure pair says that all points below the node are
    in the region, and is put out at the level where that is first known; the others are pairs of leaves that may meet.
    Every pair of a point and a region that meet is below exactly one of them for each piece. The nodes are aggregates
    over all points.
    """
    p_fields = dict(zip("snwe", _OUTER))
    s_fields = {f"o_{a}": f for a, f in zip("snwe", _OUTER)} | {f"i_{a}": f for a, f in zip("snwe", _INNER)}
    leaves = written(_point_nodes(points, leaf), "point-leaves")
    centre = _cell((F.col("o_s") + F.col("o_n")) / 2, (F.col("o_w") + F.col("o_e")) / 2, leaf)
    placed = written(pieces.select(*centre, "*"), "region-leaves")
    apart = "s > o_n OR n < o_s OR w > o_e OR e < o_w"
    within = F.coalesce(F.expr("s >= i_s AND n <= i_n AND w >= i_w AND e <= i_e"), F.lit(False))

    def p_nodes(level: int) -> DataFrame:
        return leaves if level == leaf else _up(leaves, leaf - level, p_fields)

    def s_nodes(level: int) -> DataFrame:
        return _up(placed.select("x", "y", *s_fields), leaf - level, s_fields)

    def up(c: str, down: int):
        return F.shiftright(c, down) if down else F.col(c)

    def regions_of(pairs: DataFrame, level: int) -> DataFrame:
        below = placed.select(up("x", leaf - level).alias("sx"), up("y", leaf - level).alias("sy"), "region_id", "shape", *_REGION, *s_fields)
        return pairs.join(below, ["sx", "sy"])

    def shaped(pairs: DataFrame, level: int, sure) -> DataFrame:
        return pairs.select(
            F.lit(level).alias("level"), F.col("px").alias("x"), F.col("py").alias("y"), "region_id", "shape",
            *[F.col(c).alias(f"r_{c}") for c in _PIECE], sure.alias("sure"),
        )

    root_p = p_nodes(0).select(F.col("x").alias("px"), F.col("y").alias("py"), *"snwe")
    root_s = s_nodes(0).select(F.col("x").alias("sx"), F.col("y").alias("sy"), *s_fields)
    judged = root_p.join(root_s, (F.col("px") == F.col("sx")) & (F.col("py") == F.col("sy"))).where(f"NOT ({apart})")
    out, level = [], 0
    for deeper in (*[n for n in LEVELS if n < leaf], leaf):
        judged = written(judged.select("px", "py", "sx", "sy", within.alias("sure")), "node-pairs")
        out.append(shaped(regions_of(judged.where("sure"), level), level, F.lit(True)))
        down = deeper - level
        p = p_nodes(deeper).select(up("x", down).alias("px"), up("y", down).alias("py"), F.col("x").alias("cx"), F.col("y").alias("cy"), *"snwe")
        s = s_nodes(deeper).select(up("x", down).alias("sx"), up("y", down).alias("sy"), F.col("x").alias("dx"), F.col("y").alias("dy"), *s_fields)
        below = judged.where("NOT sure").join(s, ["sx", "sy"]).join(p, ["px", "py"]).where(f"NOT ({apart})")
        judged = below.select(F.col("cx").alias("px"), F.col("cy").alias("py"), F.col("dx").alias("sx"), F.col("dy").alias("sy"), *"snwe", *s_fields)
        level = deeper
    # at the leaves the regions of a node are told apart
    last = regions_of(judged.select("px", "py", "sx", "sy", *"snwe"), leaf)
    out.append(shaped(last.where(f"NOT ({apart})"), leaf, within))
    return reduce(DataFrame.unionByName, out)


def points_in_regions(points: DataFrame, regions: DataFrame, sample_of: DataFrame | None = None, leaf: int = LEAF) -> DataFrame:
    """Every (point, region) with the point in the region: the columns of ``points`` and region_id.

    A column region_id that the points have themselves is left out. ``points``: lat, lon and any other
    columns; points without usable coordinates are in no region. ``regions``: see region_pieces; null ids are none.
    Circle: great-circle distance of at most radius_m. Box: within the bounds, edges included; lon_min > lon_max crosses
    the 180th meridian. ``sample_of``: optionally a cheaper table with (at least) the same lat, lon to build the nodes
    from. Repeated points give repeated rows. Either side may be empty. Where many points share a leaf, adaptive skew
    handling splits them and repeats the few pairs of the leaf.
    """
    # the row travels as one column, so that its names cannot clash
    kept = [F.col(f"`{c}`") for c in points.columns if c.lower() != "region_id"]
    good = points.where(usable(F.col("lat"), F.col("lon"))).select(F.struct(*kept).alias("row"), "lat", "lon")
    shape = (sample_of if sample_of is not None else points).select("lat", "lon")
    shape = shape.where(usable(F.col("lat"), F.col("lon")))
    pairs = written(dual_tree_pairs(shape, region_pieces(regions), leaf), "tree-pairs")
    # a point looks up its node at every level that pairs were put out at
    levels = sorted(r["level"] for r in pairs.select("level").distinct().collect())
    nodes = F.array(*[F.struct(F.lit(n).alias("level"), *_cell(F.col("lat"), F.col("lon"), n)) for n in levels or [leaf]])
    keyed = good.withColumn("node", F.explode(nodes)).select("row", "lat", "lon", "node.*")
    # pairs are bounded by regions times nodes; only a checked size is broadcast, else both sides are shuffled
    side = F.broadcast(pairs) if small_enough(pairs) else pairs
    joined = keyed.join(side, ["level", "x", "y"])
    near = great_circle_m(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")) <= F.col("r_radius_m")
    across = F.when(
        F.col("r_lon_min") > F.col("r_lon_max"), (F.col("lon") >= F.col("r_lon_min")) | (F.col("lon") <= F.col("r_lon_max"))
    ).otherwise(F.col("lon").between(F.col("r_lon_min"), F.col("r_lon_max")))
    inside = F.col("lat").between(F.col("r_lat_min"), F.col("r_lat_max")) & across
    # the pieces of a region have no longitude in common, so a point comes out once
    here = F.col("lon").between(F.col("r_o_w"), F.col("r_o_e"))
    hit = F.col("sure") | (here & F.when(F.col("shape") == "circle", near).otherwise(inside))
    return joined.where(hit).select("row.*", "region_id")


def leaf_for(radius_m: float) -> int:
    """The level whose cells are about as high as a circle of that radius is wide."""
    return max(4, min(20, int(log2(max(1.0, pi * EARTH_M / (2 * radius_m))))))


def points_near_points(points: DataFrame, others: DataFrame, radius_m: float) -> DataFrame:
    """Every (point, other) at most ``radius_m`` apart by great circle: the columns of ``points`` and near_id.

    ``others``: near_id, lat, lon; each is a circle of the dual-tree join, so the 180th meridian and the poles need no
    care. Others without usable coordinates or id are near nothing; else as points_in_regions.
    """
    if not radius_m >= 0:
        raise ValueError("radius_m must not be negative")
    none = F.lit(None).cast("double")
    circles = others.where(usable(F.col("lat"), F.col("lon"))).select(
        F.col("near_id").alias("region_id"), F.lit("circle").alias("shape"), "lat", "lon", F.lit(float(radius_m)).alias("radius_m"),
        *[none.alias(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max")],
    )
    rest = points.drop(*[c for c in points.columns if c.lower() == "near_id"])
    return points_in_regions(rest, circles, leaf=leaf_for(radius_m)).withColumnRenamed("region_id", "near_id")


def grid_join(left: DataFrame, right: DataFrame, radius: float, on: list[str] = []) -> DataFrame:  # noqa: B006
    """All pairs of points at most ``radius`` apart (Euclidean, in the unit of x and y), equal in the columns ``on``.

    ``left`` and ``right``: x, y, the columns ``on``, and others, which get the prefixes l_ and r_. Result: the columns
    ``on``, l_*, r_* and distance. Cells of the size of the radius turn the distance bound into an equi-join: each
    left point looks into nine cells, each right point lies in one, so a pair comes out once.
    """
    if not radius > 0:
        raise ValueError("radius must be positive")
    cell = [F.floor(F.col(a) / radius).alias(f"cell_{a}") for a in "xy"]
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    a = left.where("x IS NOT NULL AND y IS NOT NULL").select(
        *on, *[F.col(c).alias(f"l_{c}") for c in left.columns if c not in on], *cell
    )
    a = a.withColumn("sx", F.explode(steps)).withColumn("sy", F.explode(steps))
    a = a.withColumn("cell_x", F.col("cell_x") + F.col("sx")).withColumn("cell_y", F.col("cell_y") + F.col("sy")).drop("sx", "sy")
    b = right.where("x IS NOT NULL AND y IS NOT NULL").select(
        *on, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in on], *cell
    )
    gap = F.sqrt(F.pow(F.col("l_x") - F.col("r_x"), 2) + F.pow(F.col("l_y") - F.col("r_y"), 2))
    return a.join(b, [*on, "cell_x", "cell_y"]).withColumn("distance", gap).where(F.col("distance") <= radius).drop("cell_x", "cell_y")

