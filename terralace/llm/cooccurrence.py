"""Items that appear together: exact pair counts, and how surprising they are under a bipartite configuration null.

The null keeps, on average, every item's frequency and every basket's size: item i is in basket s with probability
x_i y_s / (1 + x_i y_s). Items of one frequency share x and baskets of one size share y, so the fit works on the tables
of frequencies and of sizes, not on rows. The number of baskets that hold a pair is then a sum of independent binomials,
one per basket size; its upper tail is the p-value, and Benjamini-Hochberg gives the q-value.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import erfc

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralace.sources.tables import written

#: Distinct pairs a task keeps before it hands its partial counts on.
FLUSH_PAIRS = 1_000_000
#: Pair codes made at a time, which bounds memory for large baskets.
CHUNK_CODES = 2_000_000
EXACT_BASKETS = 2048
BINS_PER_DECADE = 100


def _count_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    codes: list[np.ndarray] = []
    kept: dict[str, np.ndarray] = {"code": np.empty(0, np.int64), "n": np.empty(0, np.int64)}
    waiting = 0

    def merge() -> None:
        nonlocal waiting
        parts = np.concatenate([kept["code"], *[c for c, _ in codes]]) if codes else kept["code"]
        weights = np.concatenate([kept["n"], *[w for _, w in codes]]) if codes else kept["n"]
        unique, place = np.unique(parts, return_inverse=True)
        kept["code"], kept["n"] = unique, np.bincount(place, weights, len(unique)).astype(np.int64)
        codes.clear()
        waiting = 0

    def flush() -> pd.DataFrame:
        out = pd.DataFrame({"a": kept["code"] >> 31, "b": kept["code"] & 0x7FFFFFFF, "n_ab": kept["n"]})
        kept["code"], kept["n"] = np.empty(0, np.int64), np.empty(0, np.int64)
        return out

    for batch in batches:
        for items, times in zip(batch["items"], batch["times"]):
            held = np.sort(np.asarray(items, dtype=np.int64))
            if len(held) and held[-1] > 0x7FFFFFFF:
                raise OverflowError("more than 2**31 distinct items")
            # whole rows of the upper triangle, a bounded number of codes at a time
            rows = max(1, CHUNK_CODES // max(1, len(held)))
            for at in range(0, len(held) - 1, rows):
                i, j = np.nonzero(np.arange(len(held)) > np.arange(at, min(at + rows, len(held)))[:, None])
                codes.append(((held[i + at] << 31) | held[j], np.full(len(i), times, np.int64)))
                waiting += len(i)
                if waiting > CHUNK_CODES:
                    merge()
                    if len(kept["code"]) > FLUSH_PAIRS:
                        yield flush()
    merge()
    if len(kept["code"]):
        yield flush()


#: Cells of the table of frequencies and sizes that are computed at a time.
CELLS = 4_000_000
#: Stand for the limits of x and y where a chance is 1 or 0 for sure.
SURE, NEVER = 1e18, 1e-9


def _peel(f: np.ndarray, nf: np.ndarray, k: np.ndarray, nk: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x and y of items and baskets whose chances are 0 or 1 for sure, else nan; and what is left of frequencies and sizes.

    A basket that holds every item left has them for sure, an item that is in every basket left likewise; taking them
    out may make others so.
    """
    f, k = f.copy(), k.copy()
    x, y = np.full(len(f), np.nan), np.full(len(k), np.nan)
    while True:
        items, baskets = nf[np.isnan(x)].sum(), nk[np.isnan(y)].sum()
        for value, rest, many, other in ((y, k, nk, f), (x, f, nf, k)):
            free = np.isnan(value)
            sure = free & (rest >= (items if value is y else baskets))
            value[sure] = SURE
            value[free & ~sure & (rest <= 0)] = NEVER
            if sure.any():
                open_ = np.isnan(x if value is y else y)
                other[open_] -= many[sure].sum()
                break
        else:
            if not np.isnan(x).any() or not np.isnan(y).any() or ((f[np.isnan(x)] > 0).all() and (k[np.isnan(y)] > 0).all()):
                return x, y, f, k


def fit_null(frequencies: dict[int, int], sizes: dict[int, int], rounds: int = 20_000, error: float = 1e-5) -> tuple[dict[int, float], dict[int, float]]:
    """Fit x per item frequency and y per basket size; both maps are value -> how many items or baskets have it.

    Ends when every frequency and size is met to the relative ``error``; fails if it isn't after ``rounds``.
    """
    f, nf = np.array(list(frequencies), float), np.array(list(frequencies.values()), float)
    k, nk = np.array(list(sizes), float), np.array(list(sizes.values()), float)
    if not len(f) or not len(k):
        return {}, {}
    sure_x, sure_y, left_f, left_k = _peel(f, nf, k, nk)
    named = lambda x, y: (dict(zip(f.astype(int).tolist(), x.tolist())), dict(zip(k.astype(int).tolist(), y.tolist())))
    open_x, open_y = np.isnan(sure_x), np.isnan(sure_y)
    if not open_x.any() or not open_y.any():
        return named(np.nan_to_num(sure_x, nan=NEVER), np.nan_to_num(sure_y, nan=NEVER))
    whole_x, whole_y = sure_x, sure_y
    f_open, nf, k_open, nk = left_f[open_x], nf[open_x], left_k[open_y], nk[open_y]
    total = max(1.0, (f_open * nf).sum())
    x, y = f_open / np.sqrt(total), k_open / np.sqrt(total)
    step = max(1, CELLS // len(y))

    def over_sizes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each frequency, the sum over baskets of y / (1 + x y)."""
        return np.concatenate([(nk * y / (1 + x[i : i + step, None] * y)).sum(1) for i in range(0, len(x), step)])

    def over_items(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each size, the sum over items of x / (1 + x y)."""
        return sum((nf[i : i + step, None] * x[i : i + step, None] / (1 + x[i : i + step, None] * y)).sum(0) for i in range(0, len(x), step))

    for _ in range(rounds):
        x = f_open / over_sizes(x, y)
        y = k_open / over_items(x, y)
        if np.abs(x * over_sizes(x, y) / f_open - 1).max() <= error and np.abs(y * over_items(x, y) / k_open - 1).max() <= error:
            whole_x[open_x], whole_y[open_y] = x, y
            return named(whole_x, whole_y)
    raise RuntimeError(f"the null didn't settle in {rounds} rounds")


def tail(q: np.ndarray, times: np.ndarray, least: int) -> float:
    """P(X >= least) for X a sum of times[k] trials of chance q[k] each: exact up to 2048 trials, else by saddle point."""
    n, mean = int(times.sum()), float((q * times).sum())
    if least <= 0:
        return 1.0
    if least > n:
        return 0.0
    if n <= EXACT_BASKETS:
        w = np.exp(2j * np.pi * np.arange(n + 1) / (n + 1))
        waves = np.prod((1 - q[:, None] + q[:, None] * w) ** times[:, None], 0)
        mass = np.fft.fft(waves).real / (n + 1)
        return float(min(1.0, max(0.0, mass[least:].sum())))
    point = least - 0.5  # continuity correction

    def cumulants(t: float) -> tuple[float, float, float]:
        e = np.exp(t)
        p = q * e / (1 - q + q * e)
        return float((times * np.log1p(q * (e - 1))).sum()), float((times * p).sum()), float((times * p * (1 - p)).sum())

    if abs(point - mean) < 1e-9:
        return 0.5
    low, high = -60.0, 60.0
    for _ in range(200):
        t = (low + high) / 2
        low, high = (t, high) if cumulants(t)[1] < point else (low, t)
    k0, _, k2 = cumulants(t)
    r = np.sign(t) * np.sqrt(max(0.0, 2 * (t * point - k0)))
    u = 2 * np.sinh(t / 2) * np.sqrt(k2)
    if abs(r) < 1e-4 or u == 0:
        return 0.5
    value = 0.5 * erfc(r / np.sqrt(2)) + np.exp(-r * r / 2) / np.sqrt(2 * np.pi) * (1 / u - 1 / r)
    return float(min(1.0, max(0.0, value)))


def pair_counts(baskets: DataFrame, items: DataFrame) -> DataFrame:
    """Exact counts of pairs: a, b (item numbers, a < b), n_ab. ``baskets``: basket, item (distinct); ``items``: item, no.

    Equal baskets are counted once with their multiplicity; each task adds up its pairs and hands on partial counts,
    so pairs are never shuffled one by one.
    """
    held = (
        baskets.join(items, "item").groupBy("basket").agg(F.sort_array(F.collect_set("no")).alias("items"))
        .where(F.size("items") > 1).groupBy("items").agg(F.count(F.lit(1)).alias("times"))
    )
    parts = held.mapInPandas(_count_pairs, "a long, b long, n_ab long")
    return parts.groupBy("a", "b").agg(F.sum("n_ab").alias("n_ab"))


def numbered(items: DataFrame, parts: int = 1024) -> DataFrame:
    """Add ``no``, dense numbers from 0 for the distinct values of ``item``, without sorting them all in one task."""
    hashed = items.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)))
    before = hashed.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = before.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("item"))
    rows = hashed.withColumn("place", place).join(F.broadcast(before), "part")
    return rows.withColumn("no", F.col("before") + F.col("place") - 1).drop("part", "place", "before")


def co_occurrence(occurrences: DataFrame, baskets: DataFrame) -> tuple[DataFrame, int]:
    """Pairs of items that occur together: item_a, item_b, n_a, n_b, n_ab, and the number of baskets n.

    ``occurrences``: basket, item; repeated rows count once, nulls take no part. ``baskets``: basket, all the baskets
    there are (some may be empty); occurrences in other baskets don't count. item_a < item_b as strings. Pairs that
    never occur together have no row. A basket's distinct items are bounded by the list of items, whatever its rows.
    """
    all_baskets = baskets.where("basket IS NOT NULL").select("basket").distinct()
    n = all_baskets.count()
    held = occurrences.where("basket IS NOT NULL AND item IS NOT NULL").select("basket", "item").distinct()
    held = held.join(all_baskets, "basket", "left_semi")
    freq = held.groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))
    items = numbered(freq)
    pairs = pair_counts(held, items.select("item", "no"))
    a = items.select(F.col("no").alias("a"), F.col("item").alias("left"), F.col("n_item").alias("n_left"))
    b = items.select(F.col("no").alias("b"), F.col("item").alias("right"), F.col("n_item").alias("n_right"))
    both = pairs.join(a, "a").join(b, "b")
    swap = F.col("left") > F.col("right")
    return both.select(
        F.least("left", "right").alias("item_a"), F.greatest("left", "right").alias("item_b"),
        F.when(swap, F.col("n_right")).otherwise(F.col("n_left")).alias("n_a"),
        F.when(swap, F.col("n_left")).otherwise(F.col("n_right")).alias("n_b"), "n_ab",
    ), n


def surprise(pairs: DataFrame, occurrences: DataFrame, baskets: DataFrame, level: float = 0.05) -> DataFrame:
    """How much more often than chance: adds expected, lift, p_value, q_value and surprising (q_value <= level).

    ``pairs``: of co_occurrence; ``occurrences`` and ``baskets`` as there. The p-value is for at least n_ab joint
    baskets under the null; pairs that never occur together have the p-value 1 and count as tested.
    """
    spark = pairs.sparkSession
    held = occurrences.where("basket IS NOT NULL AND item IS NOT NULL").select("basket", "item").distinct()
    held = held.join(baskets.where("basket IS NOT NULL").select("basket").distinct(), "basket", "left_semi")
    # tables of how many items (baskets) have a frequency (size): their length grows slower than the square root
    freq = held.groupBy("item").count().groupBy("count").agg(F.count(F.lit(1)).alias("times")).collect()
    size = held.groupBy("basket").count().groupBy("count").agg(F.count(F.lit(1)).alias("times")).collect()
    sizes = {r["count"]: r["times"] for r in size}
    x, y = fit_null({r["count"]: r["times"] for r in freq}, sizes)
    ys = np.array([y[k] for k in sizes])
    times = np.array(list(sizes.values()))
    items = sum(r["times"] for r in freq)
    tested = items * (items - 1) // 2

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        @lru_cache(maxsize=100_000)  # pairs with the same numbers are judged once
        def judged_once(n_a: int, n_b: int, n_ab: int) -> tuple[float, float]:
            q = (x[n_a] * ys / (1 + x[n_a] * ys)) * (x[n_b] * ys / (1 + x[n_b] * ys))
            return float((q * times).sum()), max(1e-300, tail(q, times, n_ab))

        for batch in batches:
            got = [judged_once(min(a, b), max(a, b), ab) for a, b, ab in zip(*(batch[c].tolist() for c in ("n_a", "n_b", "n_ab")))]
            out = batch.assign(expected=[g[0] for g in got], p_value=[g[1] for g in got])
            yield out.assign(lift=out["n_ab"] / out["expected"])

    schema = "item_a string, item_b string, n_a long, n_b long, n_ab long, expected double, p_value double, lift double"
    judged = written(pairs.select("item_a", "item_b", "n_a", "n_b", "n_ab").mapInPandas(judge, schema), "judged")
    # p-values rounded up to a hundredth of a decade: at most 30,000 bins, whatever the number of pairs
    place = F.floor(-F.log10("p_value") * BINS_PER_DECADE).cast("int")
    bins = judged.groupBy(place.alias("bin")).count().orderBy(F.desc("bin")).collect()
    rank, rows = 0, []
    for r in bins:
        rank += r["count"]
        rows.append((r["bin"], min(1.0, 10 ** (-r["bin"] / BINS_PER_DECADE) * tested / rank)))
    least = 1.0
    q_of = []
    for b, q in reversed(rows):
        least = min(least, q)
        q_of.append((b, least))
    table = spark.createDataFrame(q_of, "bin int, q_value double")
    return (
        judged.withColumn("bin", place).join(F.broadcast(table), "bin").drop("bin").withColumn("surprising", F.col("q_value") <= level)
    )
