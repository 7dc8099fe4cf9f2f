"""As-of lookups and batch lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def as_of(
    left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, value: Column, strict: bool = False, bucket_us: int = DAY_US
) -> DataFrame:
    """Add ``found``: ``value`` of the latest right row of the same key at or before (``strict``: before) the left row.

    ``left_at`` and ``right_at`` are microseconds (long). Ties of the right side's time go to the largest value. Keys
    are cut into time buckets, so a hot key is many window partitions; what lies before a bucket is carried over from
    the last row of each earlier bucket. Left rows without an earlier right row, or with a null key or time, get null.
    """
    bucket = lambda at: F.floor(F.col(at) / bucket_us).cast("long").alias("bucket")
    offer = F.struct(F.col(right_at).alias("at"), value.alias("value"))
    offers = right.where(F.col(key).isNotNull() & F.col(right_at).isNotNull()).select(
        F.col(key).alias("k"), bucket(right_at), F.col(right_at).alias("at"), F.lit(0).alias("kind"), offer.alias("offer")
    )
    lasts = offers.groupBy("k", "bucket").agg(F.max("offer").alias("offer"))
    before = Window.partitionBy("k").orderBy("bucket", "kind").rowsBetween(Window.unboundedPreceding, 0)
    asked_buckets = left.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), bucket(left_at)).distinct()
    carried = (
        lasts.select("k", (F.col("bucket") + 1).alias("bucket"), F.lit(0).alias("kind"), "offer")
        .unionByName(asked_buckets.select("k", "bucket", F.lit(1).alias("kind")), allowMissingColumns=True)
        .withColumn("offer", F.last("offer", ignorenulls=True).over(before))
        .where("kind = 1").select("k", "bucket", F.col("offer").alias("carried"))
    )
    rows = left.select(F.col(key).alias("k"), bucket(left_at), F.col(left_at).alias("at"), F.lit(-1 if strict else 1).alias("kind"), F.struct(*[F.col(c) for c in left.columns]).alias("row"))
    inside = Window.partitionBy("k", "bucket").orderBy("at", "kind", "offer").rowsBetween(Window.unboundedPreceding, 0)
    seen = offers.unionByName(rows, allowMissingColumns=True).withColumn("offer", F.last("offer", ignorenulls=True).over(inside))
    out = seen.where("kind <> 0").join(carried, ["k", "bucket"], "left")
    return out.select("row.*", F.coalesce("offer", "carried").getField("value").alias("found"))


def latest_batch(rows: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """All rows with the latest time of their key; rows with a null time are in no batch."""
    latest = rows.groupBy(*keys).agg(F.max(at).alias("latest_at"))
    return rows.join(latest, list(keys)).where(F.col(at) == F.col("latest_at")).drop("latest_at")


def near_square(points: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """Rows of ``points`` (lat, lon) in the inclusive square around each row of ``queries`` (q_lat, q_lon).

    Cells of the size of the radius make an equi-join of the two bounds; each query looks into nine cells.
    """
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    cell = lambda lat, lon: [F.floor(F.col(lat) / radius).alias("cy"), F.floor(F.col(lon) / radius).alias("cx")]
    q = queries.where("q_lat IS NOT NULL AND q_lon IS NOT NULL").select("*", *cell("q_lat", "q_lon"))
    q = q.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    q = q.withColumn("cy", F.col("cy") + F.col("dy")).withColumn("cx", F.col("cx") + F.col("dx")).drop("dx", "dy")
    p = points.where("lat IS NOT NULL AND lon IS NOT NULL").select("*", *cell("lat", "lon"))
    near = F.col("lat").between(F.col("q_lat") - radius, F.col("q_lat") + radius) & F.col("lon").between(
        F.col("q_lon") - radius, F.col("q_lon") + radius
    )
    return p.join(q, ["cy", "cx"]).where(near).drop("cy", "cx")
