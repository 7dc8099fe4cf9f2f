"""Predicates from the arguments that are given, first-or-none, alerts, and the choice of the nearest."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tests a filter can name, behind two underscores.
TESTS = {
    "is": lambda c, v: c == v, "in": lambda c, v: c.isin(list(v)), "like": lambda c, v: c.ilike(f"%{v}%"), "least": lambda c, v: c >= v,
    "most": lambda c, v: c <= v, "between": lambda c, v: c.between(*v), "known": lambda c, v: c.isNotNull() if v else c.isNull(),
    "not": lambda c, v: ~c.eqNullSafe(F.lit(v)),
}


def matching(rows: DataFrame, given: Mapping[str, object]) -> DataFrame:
    """Rows that pass all the tests that are given, as ``column`` or ``column__test``; a value of None is not given.

    Tests: is (the default), in, like (any case), least, most, between, known, not (nulls pass).
    """
    for name, value in given.items():
        if value is None:
            continue
        column, _, test = name.partition("__")
        if (test or "is") not in TESTS:
            raise ValueError(f"no test named {test}")
        rows = rows.where(TESTS[test or "is"](F.col(column), value))
    return rows


def latest(rows: DataFrame, at: str, key: str, limit: int | None = None) -> DataFrame:
    """Rows by falling time, ties by key, as many as asked for (1: the first or none); null times come last."""
    out = rows.orderBy(F.desc_nulls_last(at), key)
    return out if limit is None else out.limit(limit)


def alerts(rows: DataFrame, key: str, limits: Mapping[str, int], usual: int) -> DataFrame:
    """Keys that occur more often than their limit: key, n, most. Keys without a limit of their own have the ``usual`` one."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    own = F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col(key)) if limits else F.lit(None).cast("int")
    return counts.withColumn("most", F.coalesce(own, F.lit(usual))).where("n > most")


def nearest_in_zone(rows: DataFrame, zone: Column, target: tuple[float, float], fallback: tuple[float, float], key: str) -> DataFrame:
    """The row in the zone that is nearest to ``target``, else the one nearest to ``fallback``; by squared degrees."""
    off = lambda to: F.pow(F.col("lat") - to[0], 2) + F.pow(F.col("lon") - to[1], 2)
    inside = F.coalesce(zone, F.lit(False))
    order = F.struct((~inside).alias("out"), F.when(inside, off(target)).otherwise(off(fallback)).alias("far"), F.col(key).alias("key"))
    best = rows.where("lat IS NOT NULL AND lon IS NOT NULL").agg(F.min(F.struct(order.alias("o"), F.struct("*").alias("row"))).alias("b"))
    return best.where("b IS NOT NULL").select("b.row.*")
