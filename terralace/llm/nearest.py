"""Nearest record in time within a tolerance, by expanding rings.

Time is cut into buckets of a width w. A left row looks into its own bucket and the two beside it, which hold every
right row at most w away; a match at most w away is therefore the nearest one, and the row is done. Rows without such
a match go on to buckets of twice the width, up to the tolerance. The first width is the widest at which, counted over
all right rows, three buckets still hold a handful of them: dense data starts fine and settles most rows at once, and
where the tolerance itself is fine enough, one ring does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralace.sources.tables import cut_folder, small_enough, written

#: Right rows that the bucket of a right row may hold on average, and the fullest bucket, at the first width.
USUAL_OFFERS, MOST_OFFERS = 32, 10_000
#: Pairs that one (key, bucket) may compare in a task; beyond, its left rows are spread over several tasks.
MOST_PAIRS = 50_000_000
#: Widths that are measured, each half of the one before.
MEASURED = 24


def rings(tolerance_us: int, first_us: int) -> list[int]:
    """Doubling widths from ``first_us``; the last is the tolerance itself."""
    widths = []
    w = min(first_us, tolerance_us)
    while w < tolerance_us:
        widths.append(w)
        w *= 2
    return [*widths, tolerance_us]


def first_width(offers: DataFrame, tolerance_us: int) -> tuple[int, int]:
    """The first width (a half, quarter ... of the tolerance) and how many right rows its fullest bucket holds."""
    widths = sorted({max(1, tolerance_us >> k) for k in range(MEASURED)}, reverse=True)
    # every fourth width is counted, in one pass; the fullest bucket of a width bounds those of finer ones
    tried = F.explode(F.array(*[F.lit(w) for w in widths[::4]])).alias("width")
    counts = offers.select("key", "r_us", tried).groupBy("width", "key", F.floor(F.col("r_us") / F.col("width"))).count()
    rows = counts.groupBy("width").agg(F.sum(F.col("count") * F.col("count")).alias("squares"), F.sum("count").alias("n"), F.max("count").alias("most"))
    measured = sorted((tuple(r) for r in rows.collect()), reverse=True)  # one row per width
    for width, squares, n, most in measured:
        if squares <= USUAL_OFFERS * n and most <= MOST_OFFERS:
            return width, most
    return (measured[-1][0], measured[-1][3]) if measured else (max(1, tolerance_us), 0)


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance_us: int, first_us: int | None = None, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Pair each left row with the right row of the same key that is nearest in time, if within the tolerance.

    ``left``: left_id, key, t_us (long, microseconds). ``right``: right_id, key, t_us. Result: left_id, right_id,
    gap_us, one row per left row that has a partner (edge included). Of equally near right rows the earlier time wins,
    then the smaller id. Rows with a null key, time or id take no part; right rows repeated at one instant count once;
    left rows repeated with the same id, key and time count once. Other columns are ignored. ``first_us``: the first
    width, measured if it is not given.
    """
    rest = left.where("left_id IS NOT NULL AND key IS NOT NULL AND t_us IS NOT NULL").select("left_id", "key", "t_us")
    offers = written(
        right.where("right_id IS NOT NULL AND key IS NOT NULL AND t_us IS NOT NULL")
        .groupBy("key", F.col("t_us").alias("r_us"))
        .agg(F.min("right_id").alias("right_id")),
        "offers",
    )
    width, most = first_width(offers, tolerance_us)
    if first_us:
        width = first_us
        most = offers.groupBy("key", F.floor(F.col("r_us") / width)).count().agg(F.max("count")).first()[0] or 0
    settled = []
    for turn, width in enumerate(rings(tolerance_us, width)):
        span = max(1, width)  # a tolerance of zero asks for equal times
        bucket = F.floor(F.col("t_us") / span).cast("long")
        place = F.floor(F.col("r_us") / span).cast("long")
        rows = rest.withColumn("bucket", bucket)
        near = offers.withColumn("bucket", F.explode(F.sequence(place - 1, place + 1)))
        on = ["key", "bucket"]
        # twice the width holds at most twice (and one) as many in its fullest bucket
        at_most = max(1, most_pairs // (3 * max(1, (2 * most + 1 if turn else most))))
        most = 2 * most + 1 if turn else most
        hot_keys = rest.groupBy("key").count().where(F.col("count") > at_most).select("key")  # few, combined before they move
        hot_keys = written(hot_keys, "hot-keys")
        if not hot_keys.isEmpty():
            crowds = rows.join(F.broadcast(hot_keys), "key", "left_semi").groupBy(*on).count().where(F.col("count") > at_most)
            crowds = written(crowds.select(*on, F.ceil(F.col("count") / at_most).cast("int").alias("parts")), "crowds")
            crowds = F.broadcast(crowds) if small_enough(crowds) else crowds
            parts = F.coalesce("parts", F.lit(1))
            rows = rows.join(crowds, on, "left").withColumn("part", F.pmod(F.xxhash64("left_id"), parts).cast("int"))
            near = near.join(crowds, on, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
            on = [*on, "part"]
        best = F.min(F.when(F.col("r_us").isNotNull(), F.struct(F.abs(F.col("t_us") - F.col("r_us")).alias("gap_us"), "r_us", "right_id")))
        # grouping by the keys of the join and more: no further shuffle
        found = rows.join(near.select(*on, "r_us", "right_id"), on, "left").groupBy(*on, "left_id", "t_us").agg(best.alias("best"))
        done = F.coalesce(F.col("best.gap_us") <= width, F.lit(False))
        folder = cut_folder(left.sparkSession, "ring")
        if width == tolerance_us:
            settled.append(found.where(done).select("left_id", "best.right_id", "best.gap_us"))
            break
        # settled and unsettled rows apart, so that neither is read for the other
        step = found.select("left_id", "key", "t_us", F.col("best.right_id").alias("right_id"), F.col("best.gap_us").alias("gap_us"), done.alias("done"))
        step.write.partitionBy("done").parquet(folder)
        step = left.sparkSession.read.schema(step.schema).parquet(folder)
        settled.append(step.where("done").select("left_id", "right_id", "gap_us"))
        rest = step.where("NOT done").select("left_id", "key", "t_us")
    return reduce(DataFrame.unionByName, settled)
