"""One-to-one matching and the classification of links between two points in time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralace.functions.geometry import euclid, in_extent
from terralace.operators.grouped import map_groups
from terralace.sources.tables import cut_folder, written


def greedy_match(candidates: DataFrame, group: Sequence[str]) -> DataFrame:
    """One-to-one pairs by falling score; ties go to the smaller left_id, then right_id.

    ``candidates``: the group columns, left_id, right_id, score. With this total order the result is also the stable
    matching of deferred acceptance. A group's candidates are handled in one task; use ``match_in_rounds`` where groups
    are not bounded.
    """
    rows = candidates.select(*group, "left_id", "right_id", "score").dropna(subset=["left_id", "right_id", "score"])
    n = len(group)

    def rule(ranked: list[tuple]) -> list[tuple]:
        left, right, kept = set(), set(), []
        for row in ranked:
            if row[n] not in left and row[n + 1] not in right:
                left.add(row[n])
                right.add(row[n + 1])
                kept.append(row)
        return kept

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return map_groups(rows, group, [F.desc("score"), "left_id", "right_id"], schema, rule)


def match_in_rounds(candidates: DataFrame, group: Sequence[str]) -> DataFrame:
    """The same pairs as greedy_match, by rounds of mutually best pairs: any group size, no Python.

    Each round keeps the pairs that are the best of both their sides and drops what they take, until no candidate is
    left. At least the best pair left is kept, so it ends, after one round a pair at worst (a chain of falling scores);
    each round is written to the shared folder, which cuts the lineage.
    """
    spark = candidates.sparkSession
    folder = cut_folder(spark, "matched")
    order = [F.desc("score"), "left_id", "right_id"]
    rest = written(candidates.select(*group, "left_id", "right_id", "score").dropna(subset=["left_id", "right_id", "score"]).distinct(), "candidates")
    columns, turn = rest.columns, 0
    rest.limit(0).write.parquet(f"{folder}/turn=-1")
    while not rest.isEmpty():
        best = rest
        for side in ("left_id", "right_id"):
            best = best.withColumn(f"rank_{side}", F.row_number().over(Window.partitionBy(*group, side).orderBy(*order)))
        best.where("rank_left_id = 1 AND rank_right_id = 1").select(*columns).write.parquet(f"{folder}/turn={turn}")
        best = spark.read.schema(rest.schema).parquet(f"{folder}/turn={turn}")
        for side in ("left_id", "right_id"):
            taken = best.select(*[F.col(c).alias(f"taken_{c}") for c in (*group, side)])
            same = [F.col(c).eqNullSafe(F.col(f"taken_{c}")) for c in group] + [F.col(side) == F.col(f"taken_{side}")]
            rest = rest.join(taken, reduce(and_, same), "left_anti")
        rest, turn = written(rest, "candidates"), turn + 1
    return spark.read.schema(rest.schema).parquet(folder).select(*columns)


def dedup_by_priority(links: DataFrame, priority: Column, left: str, right: str, tie: str) -> DataFrame:
    """Keep links that come first, by priority and then ``tie``, for both of their ends; a null end is no conflict."""
    rows = links.withColumn("prio", priority)
    for side in (left, right):
        place = F.row_number().over(Window.partitionBy(side).orderBy("prio", tie))
        rows = rows.withColumn(f"at_{side}", F.when(F.col(side).isNull(), 1).otherwise(place))
    return rows.where((F.col(f"at_{left}") == 1) & (F.col(f"at_{right}") == 1)).drop("prio", f"at_{left}", f"at_{right}")


def staged_match(stages: Sequence[DataFrame], group: Sequence[str]) -> DataFrame:
    """Match by several candidate tables in turn; what a stage takes is not open to the next. Adds ``stage``."""
    out = None
    for n, rows in enumerate(stages):
        if out is not None:
            for side in ("left_id", "right_id"):
                rows = rows.join(out.select(*group, side), [*group, side], "left_anti")
        got = greedy_match(rows, group).select(*group, "left_id", "right_id", "score").withColumn("stage", F.lit(n))
        got = written(got, "stage")
        out = got if out is None else out.unionByName(got)
    return out


def dedup_links(links: DataFrame) -> DataFrame:
    """Of the links of a pair of frames, each observation keeps one on its side: by status, then the smaller ids."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(RANKED) for x in (s, i)]), F.col("status")), F.lit(len(RANKED)))
    order = [rank, F.coalesce("current_id", F.lit("")), F.coalesce("past_id", F.lit(""))]
    for side in ("current_id", "past_id"):
        place = F.row_number().over(Window.partitionBy("pair_id", side).orderBy(*order))
        links = links.withColumn(f"at_{side}", F.when(F.col(side).isNull(), 1).otherwise(place))
    return links.where("at_current_id = 1 AND at_past_id = 1").drop("at_current_id", "at_past_id")


# The states of links, the best first.
RANKED = ("matched", "changed", "moved", "new", "disappeared", "past_not_included", "current_not_included")


def link_frames(
    current: DataFrame, past: DataFrame, scored: DataFrame | Sequence[DataFrame], fixed: Sequence[str] = (), fixed_radius: float = 0.001, threshold: float = 0.5,
    late_s: int = 0, similarity: DataFrame | None = None, same: float = 0.5, fixed_by_place_only: bool = False,
) -> DataFrame:
    """Link what is seen now with what was seen before: pair_id, current_id, past_id, status, score.

    ``current`` and ``past``: pair_id (of the two frames), obs_id, label, lat, lon, at, frame_at, and the extent of the
    *other* frame as south, north, west, east (null if unknown). ``scored``: pair_id, left_id (current), right_id
    (past), score, candidates of one label; or several such tables, which match in turn, what one takes not being open to
    the next (those are taken as they are, without ``threshold``).

    Rules, in this order: pairs whose current frame isn't later give nothing; past rows more than ``late_s`` seconds later
    than their frame are left out; fixed labels match by place within ``fixed_radius``, unless one of the two frames has no
    known extent, so that its places are no more than its centre; the rest by score above ``threshold``
    (``fixed_by_place_only``: without the fixed labels); unmatched current rows are ``new``, or ``past_not_included``
    outside the past extent; unmatched past rows are ``disappeared``, or ``current_not_included`` outside the current
    extent. ``similarity``: pair_id, left_id, right_id, similarity; fixed labels matched by place are ``changed`` where it
    is below ``same``, and ``matched`` where it isn't, isn't known or isn't given. At the end every observation keeps one
    link on its side (``dedup_links``).
    """
    order = current.groupBy("pair_id").agg(F.max("frame_at").alias("now")).join(
        past.groupBy("pair_id").agg(F.max("frame_at").alias("then")), "pair_id", "left"
    )
    bad = order.where("now <= then").select("pair_id")
    cur = current.join(bad, "pair_id", "left_anti").withColumn("label", F.lower("label"))
    old = past.join(bad, "pair_id", "left_anti").where(F.col("at") <= F.col("frame_at") + F.make_dt_interval(secs=F.lit(late_s))).withColumn("label", F.lower("label"))
    is_fixed = F.coalesce(F.col("label").isin([f.lower() for f in fixed]), F.lit(False))
    bounded = reduce(and_, [F.col(c).isNotNull() for c in ("south", "north", "west", "east")])
    l = cur.select("pair_id", F.col("obs_id").alias("left_id"), "label", F.col("lat").alias("la"), F.col("lon").alias("lo"), bounded.alias("l_bounded"), is_fixed.alias("fixed"))  # noqa: E741
    r = old.select("pair_id", F.col("obs_id").alias("right_id"), "label", F.col("lat").alias("lb"), F.col("lon").alias("lp"), bounded.alias("r_bounded"))
    far = euclid(F.col("la"), F.col("lo"), F.col("lb"), F.col("lp"))
    ends = ["pair_id", "left_id", "right_id"]
    at_place = l.where("fixed AND l_bounded").join(r.where("r_bounded"), ["pair_id", "label"]).where(far <= fixed_radius).select(*ends, (-far).alias("score"))
    open_l = l.where("NOT fixed") if fixed_by_place_only else l
    free = [scored.where(F.col("score") > threshold)] if isinstance(scored, DataFrame) else list(scored)
    free = [
        f.select(*ends, "score").join(open_l.select("pair_id", "left_id"), ["pair_id", "left_id"], "left_semi").join(r.select("pair_id", "right_id"), ["pair_id", "right_id"], "left_semi").select(*ends, "score")
        for f in free
    ]
    matched = staged_match([at_place, *free], ["pair_id"])
    by_place = F.col("stage") == 0
    matched = matched.withColumns({"score": F.when(by_place, 1.0).otherwise(F.col("score")), "status": F.lit("matched")})
    if similarity is not None:
        least = similarity.groupBy(*ends).agg(F.min("similarity").alias("similarity"))
        changed = by_place & F.coalesce(F.col("similarity") < same, F.lit(False))
        matched = matched.join(least, ends, "left").withColumn("status", F.when(changed, "changed").otherwise("matched"))
    inside = in_extent(F.col("lat"), F.col("lon"), F.col("south"), F.col("north"), F.col("west"), F.col("east"))
    new = cur.join(matched.select("pair_id", F.col("left_id").alias("obs_id")), ["pair_id", "obs_id"], "left_anti")
    gone = old.join(matched.select("pair_id", F.col("right_id").alias("obs_id")), ["pair_id", "obs_id"], "left_anti")
    none = F.lit(None).cast("string")
    out = (
        matched.select("pair_id", F.col("left_id").alias("current_id"), F.col("right_id").alias("past_id"), "status", "score")
        .unionByName(new.select("pair_id", F.col("obs_id").alias("current_id"), none.alias("past_id"), F.when(inside, "new").otherwise("past_not_included").alias("status"), F.lit(None).cast("double").alias("score")))
        .unionByName(gone.select("pair_id", none.alias("current_id"), F.col("obs_id").alias("past_id"), F.when(inside, "disappeared").otherwise("current_not_included").alias("status"), F.lit(None).cast("double").alias("score")))
    )
    return dedup_links(out)


def cross_check(links: DataFrame, similarity: DataFrame, least: float = 0.5) -> DataFrame:
    """Look for what is unmatched in the other frame: links of ``link_frames`` with ``synthetic``.

    ``similarity``: pair_id, obs_id, similarity (of the place of the observation in the other frame). Where it is at least
    ``least``, a ``new`` or ``disappeared`` link becomes ``matched`` to a row made up for the other side, whose id
    is the same whenever pair and observation are. The highest of repeated similarities counts; unknown ones change nothing.
    """
    best = similarity.groupBy("pair_id", "obs_id").agg(F.max("similarity").alias("similarity"))
    rows = links.withColumn("obs_id", F.coalesce("current_id", "past_id")).join(best, ["pair_id", "obs_id"], "left")
    hit = F.col("status").isin("new", "disappeared") & F.coalesce(F.col("similarity") >= least, F.lit(False))
    made = F.concat(F.lit("synthetic-"), F.left(F.sha2(F.concat_ws("|", "pair_id", "obs_id"), 256), F.lit(16)))
    return rows.select(
        "pair_id", F.when(hit, F.coalesce("current_id", made)).otherwise(F.col("current_id")).alias("current_id"), F.when(hit, F.coalesce("past_id", made)).otherwise(F.col("past_id")).alias("past_id"),
        F.when(hit, "matched").otherwise(F.col("status")).alias("status"), F.when(hit, F.col("similarity")).otherwise(F.col("score")).alias("score"), hit.alias("synthetic"),
    )
