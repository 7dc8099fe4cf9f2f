"""Boxes, points, masks and pixels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def euclid(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Euclidean distance in the unit of the coordinates."""
    return F.sqrt(F.pow(x1 - x2, 2) + F.pow(y1 - y2, 2))


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    """The four columns x1, y1, x2, y2 with a prefix."""
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def area(b: tuple) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def overlap(a: tuple, b: tuple) -> Column:
    """Area of the intersection, 0 if disjoint."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: tuple, b: tuple) -> Column:
    """Intersection over union; 0 for disjoint boxes."""
    i = overlap(a, b)
    return i / (area(a) + area(b) - i + EPS)


def iomin(a: tuple, b: tuple) -> Column:
    """Intersection over the smaller area."""
    return overlap(a, b) / (F.least(area(a), area(b)) + EPS)


def gaps(a: tuple, b: tuple) -> tuple[Column, Column]:
    """Horizontal and vertical gap between two boxes; 0 where they overlap."""
    return (
        F.greatest(F.lit(0.0), F.greatest(a[0], b[0]) - F.least(a[2], b[2])),
        F.greatest(F.lit(0.0), F.greatest(a[1], b[1]) - F.least(a[3], b[3])),
    )


def size_ratio(a: Column, b: Column) -> Column:
    """Smaller size over larger size, with a floor of 1e-6."""
    a, b = F.greatest(a, F.lit(EPS)), F.greatest(b, F.lit(EPS))
    return F.least(a, b) / F.greatest(a, b)


def proximity(distance: Column, reach: float) -> Column:
    """1 at the same place, falling to 0 at ``reach``."""
    return F.greatest(F.lit(0.0), 1 - distance / reach)


def mixed_score(base: Column, size: Column, size_weight: float = 0.2) -> Column:
    return base * (1 - size_weight) + size * size_weight


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(a: Column) -> Column:
    """The array divided by its Euclidean norm; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.transform(a, lambda v: F.when(norm > 0, v.cast("double") / norm).otherwise(0.0))


def in_extent(lat: Column, lon: Column, south: Column, north: Column, west: Column, east: Column) -> Column:
    """Whether a point lies in an extent; true where the extent is not known."""
    return F.coalesce(lat.between(south, north) & lon.between(west, east), F.lit(True))


def pixel_to_geo(x: Column, y: Column, width: Column, height: Column, extent: tuple, centre: tuple) -> tuple[Column, Column]:
    """(lat, lon) of a pixel by linear mapping of the extent (south, north, west, east); the centre where it is unknown."""
    south, north, west, east = extent
    lat = north - y / F.nullif(height.cast("double"), F.lit(0.0)) * (north - south)
    lon = west + x / F.nullif(width.cast("double"), F.lit(0.0)) * (east - west)
    known = lat.isNotNull() & lon.isNotNull()
    return F.when(known, lat).otherwise(centre[0]), F.when(known, lon).otherwise(centre[1])


def geo_to_pixels(geo: tuple, width: Column, height: Column, extent: tuple, pad: int = 4) -> Column:
    """A geographic box (south, north, west, east) as a pixel box, padded and clamped; null if nothing is left."""
    south, north, west, east = extent
    col = lambda lon: ((lon - west) / F.nullif(east - west, F.lit(0.0)) * width).cast("int")
    row = lambda lat: ((north - lat) / F.nullif(north - south, F.lit(0.0)) * height).cast("int")
    x1, x2 = F.greatest(col(geo[2]) - pad, F.lit(0)), F.least(col(geo[3]) + pad, width)
    y1, y2 = F.greatest(row(geo[1]) - pad, F.lit(0)), F.least(row(geo[0]) + pad, height)
    return F.when((x2 > x1) & (y2 > y1), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


MASK_TYPE = "struct<shape:array<int>,rle:array<array<int>>>"


def mask(text: Column) -> Column:
    """A run-length mask from its JSON text: shape [height, width] and runs [value, length]; null if it is none."""
    return F.from_json(text, MASK_TYPE)


def mask_area(m: Column) -> Column:
    """Pixels that are set."""
    return F.aggregate(m["rle"], F.lit(0), lambda s, r: s + F.when(r[0] > 0, r[1]).otherwise(0))


def mask_pixels(m: Column) -> Column:
    """The mask as a flat array of 0 and 1."""
    return F.flatten(F.transform(m["rle"], lambda r: F.array_repeat(r[0], r[1])))


def mask_runs(pixels: Column) -> Column:
    """Runs [value, length] of a flat array."""
    start = F.filter(F.transform(pixels, lambda p, i: F.when((i == 0) | (F.get(pixels, i - 1) != p), i)), lambda i: i.isNotNull())
    return F.transform(start, lambda at, k: F.array(F.get(pixels, at), F.coalesce(F.get(start, k + 1), F.size(pixels)) - at))


def mask_box(m: Column) -> Column:
    """The box of the pixels that are set, x1, y1, x2, y2, both ends included; null if none is.

    Read off the runs: a run that goes over the end of a row reaches from edge to edge.
    """
    width = F.get(m["shape"], F.lit(1)).cast("long")
    start = F.struct(
        F.lit(0).cast("long").alias("at"), *[F.lit(None).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")]
    )

    def step(s: Column, r: Column) -> Column:
        a, z = s["at"], s["at"] + r[1] - 1
        top, bottom = F.floor(a / width), F.floor(z / width)
        left = F.when(top < bottom, F.lit(0)).otherwise(F.pmod(a, width)).cast("long")
        right = F.when(top < bottom, width - 1).otherwise(F.pmod(z, width)).cast("long")
        on = (r[0] > 0) & (r[1] > 0)
        grow = lambda f, c, v: F.when(on, f(F.coalesce(s[c], v), v)).otherwise(s[c]).alias(c)
        return F.struct(
            (s["at"] + r[1]).cast("long").alias("at"), grow(F.least, "x1", left), grow(F.least, "y1", top), grow(F.greatest, "x2", right), grow(F.greatest, "y2", bottom)
        )

    b = F.aggregate(m["rle"], start, step)
    return F.when(b["x1"].isNotNull(), F.struct(*[b[c].cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")]))


def box_pixels(b: Column, shape: Column) -> Column:
    """A flat mask of the shape [height, width] that is set inside a box, both ends included."""
    height, width = F.get(shape, F.lit(0)), F.get(shape, F.lit(1))
    inside = lambda i: F.pmod(i, width).between(b["x1"], b["x2"]) & F.floor(i / width).between(b["y1"], b["y2"])
    return F.when(height * width > 0, F.transform(F.sequence(F.lit(0), height * width - 1), lambda i: inside(i).cast("int"))).otherwise(F.array().cast("array<int>"))


def mask_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two flat masks; null if both are empty."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: ((x > 0) & (y > 0)).cast("int")), F.lit(0), lambda s, v: s + v)
    either = F.aggregate(F.zip_with(a, b, lambda x, y: ((x > 0) | (y > 0)).cast("int")), F.lit(0), lambda s, v: s + v)
    return F.try_divide(both.cast("double"), either)


def geo_box(b: tuple, width: Column, height: Column, extent: tuple) -> Column:
    """A pixel box as north, west, south, east of an extent (south, north, west, east); null where anything is unknown."""
    south, north, west, east = extent
    w, h = F.when(width > 0, width.cast("double")), F.when(height > 0, height.cast("double"))
    lat = lambda y: north - y / h * (north - south)
    lon = lambda x: west + x / w * (east - west)
    out = {"north": lat(b[1]), "west": lon(b[0]), "south": lat(b[3]), "east": lon(b[2])}
    known = out["north"].isNotNull() & out["west"].isNotNull() & out["south"].isNotNull() & out["east"].isNotNull()
    return F.when(known, F.struct(*[v.alias(k) for k, v in out.items()]))


def scaled_size(width: Column, height: Column, most_width: int, most_height: int) -> Column:
    """The largest size of the same proportions within the bounds, never smaller than it is: width, height."""
    scale = F.least(F.lit(float(most_width)) / width, F.lit(float(most_height)) / height)
    grown = lambda c: F.when(scale <= 1, c).otherwise((c * scale).cast("int"))
    return F.struct(grown(width).alias("width"), grown(height).alias("height"))


def row_key(*columns: str) -> Column:
    """A key that is the same whenever the values are: sha2 of the values as texts; null is unlike any text but ``~``."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]), 256)
