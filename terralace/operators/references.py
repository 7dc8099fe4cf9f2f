"""References to records that do not exist, or exist only later than the row that uses them.

Parent keys are integers (UUIDs are 128-bit integers). They are sorted inside blocks of 2**16 consecutive integers
and compressed into contiguous runs; each distinct reference is matched as-of to the run that starts at or before it,
and is an orphan if it lies beyond the end of that run. A block holds at most 2**16 parents and as many distinct
references, however the rows are distributed: a key that a third of all rows refer to is one row by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralace.functions.keys import OUTER_BLANKS, hex_block, uuid_hex
from terralace.sources.tables import month_of, written


def distinct_keys(parents: DataFrame) -> DataFrame:
    """Parent keys as places in blocks: parent_table, block, offset, arrived.

    ``parents``: parent_table, digits (32 hex digits), arrived. Repeated keys keep their first arrival; null keys drop out.
    """
    block, offset = hex_block(F.col("digits"))
    keys = parents.where(F.col("digits").isNotNull()).groupBy("parent_table", block.alias("block"), offset.alias("offset"))
    return keys.agg(F.min("arrived").alias("arrived"))


def key_runs(keys: DataFrame) -> DataFrame:
    """Compress ``distinct_keys`` into contiguous runs: parent_table, block, run_start, run_end, latest.

    ``latest`` is the latest first arrival of a key of the run. Runs end at block borders; an empty input gives no run.
    """
    in_block = Window.partitionBy("parent_table", "block").orderBy("offset")
    # within a run of consecutive offsets, offset minus row number is constant
    numbered = keys.withColumn("run", F.col("offset") - F.row_number().over(in_block))
    return (
        numbered.groupBy("parent_table", "block", "run")
        .agg(F.min("offset").alias("run_start"), F.max("offset").alias("run_end"), F.max("arrived").alias("latest"))
        .drop("run")
    )


def match_as_of(wanted: DataFrame, keys: DataFrame, bad_only: bool = False) -> DataFrame:
    """Match each distinct reference (parent_table, digits, first_use) to the run that starts at or before it.

    Adds ``found`` (the key doesn't lie beyond the end of that run) and ``arrived``: its parent's first arrival, or null
    where nothing of the run arrived after the first use. References carry no more of a run than its ends and its
    latest arrival; only where that is too late for a reference, and the run has several keys, is the key itself looked up.
    ``bad_only``: leave out what is found in a run without a late arrival. The few others are written, so that looking
    them up costs nothing where there is nothing to look up.
    """
    block, offset = hex_block(F.col("digits"))
    run = F.struct("run_start", "run_end", "latest")
    lines = key_runs(keys).select(
        "parent_table", "block", F.col("run_start").alias("offset"), F.lit(0).alias("kind"), run.alias("run"),
        F.lit(None).cast("string").alias("digits"), F.lit(None).cast(wanted.schema["first_use"].dataType).alias("first_use"),
    ).unionByName(
        wanted.select("parent_table", block.alias("block"), offset.alias("offset"), F.lit(1).alias("kind"), "digits", "first_use"),
        allowMissingColumns=True,
    )
    as_of = Window.partitionBy("parent_table", "block").orderBy("offset", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = lines.withColumn("run", F.last("run", ignorenulls=True).over(as_of)).where("kind = 1")
    late = F.col("run.latest") > F.col("first_use")
    seen = seen.select(
        "parent_table", "digits", "first_use", "block", "offset",
        F.coalesce(F.col("offset") <= F.col("run.run_end"), F.lit(False)).alias("found"),
        F.when(late, F.col("run.latest")).alias("latest"), (F.col("run.run_start") == F.col("run.run_end")).alias("single"),
    ).withColumn("open", F.coalesce(F.col("found") & ~F.col("single") & F.col("latest").isNotNull(), F.lit(False)))
    if bad_only:
        seen = written(seen.where("NOT found OR latest IS NOT NULL"), "bad-references")
        if seen.where("open").isEmpty():
            return seen.select("parent_table", "digits", "first_use", "found", F.when(F.col("found"), F.col("latest")).alias("arrived"))
    settled = seen.where("NOT open").withColumn("arrived", F.when(F.col("found"), F.col("latest")))
    looked_up = seen.where("open").join(keys, ["parent_table", "block", "offset"])
    looked_up = looked_up.withColumn("arrived", F.when(F.col("arrived") > F.col("first_use"), F.col("arrived")))
    columns = ["parent_table", "digits", "first_use", "found", "arrived"]
    return settled.select(*columns).unionByName(looked_up.select(*columns))


def orphans(references: DataFrame, parents: DataFrame, deleted: DataFrame) -> DataFrame:
    """Every reference whose record is absent, was deleted, or first arrived after the row that uses it.

    ``references``: ref_field, parent_table, rec_id, ref (as written), used_at (first arrival of the using row).
    ``parents``: parent_table, id (as written), arrived. ``deleted``: parent_table, id.
    Result: ref_field, rec_id, defect (late, deleted, missing), month_key (yyyy-MM of used_at).

    Null and blank references are no case. A reference that is no whole UUID fits no record: ``missing``. A null
    ``used_at`` gives a null month and is never late. Parents arriving at the very time of use are not late. Extra
    columns are ignored. Empty parents make every reference missing, empty references give an empty result.
    """
    given = references.where(F.btrim("ref", F.lit(OUTER_BLANKS)) != "").select(
        "ref_field", "parent_table", "rec_id", "used_at", uuid_hex(F.col("ref")).alias("digits")
    )
    keyed = given.where(F.col("digits").isNotNull())
    wanted = keyed.groupBy("parent_table", "digits").agg(F.min("used_at").alias("first_use"))
    known = parents.select("parent_table", uuid_hex(F.col("id")).alias("digits"), "arrived")
    verdicts = match_as_of(wanted, distinct_keys(known), bad_only=True).where("NOT found OR arrived > first_use")
    gone = deleted.select("parent_table", uuid_hex(F.col("id")).alias("digits"), F.lit(True).alias("gone")).distinct()
    verdicts = verdicts.join(gone, ["parent_table", "digits"], "left").select(
        "parent_table", "digits", "arrived",
        F.when(F.col("found"), "late").when(F.col("gone"), "deleted").otherwise("missing").alias("defect"),
    )
    # few keys are bad; where one of them is hot, adaptive skew handling splits the rows and repeats the key
    bad = keyed.join(verdicts, ["parent_table", "digits"]).where("defect <> 'late' OR arrived > used_at")
    unfit = given.where(F.col("digits").isNull()).withColumn("defect", F.lit("missing"))
    columns = ["ref_field", "rec_id", "defect", month_of(F.col("used_at")).alias("month_key")]
    return bad.select(*columns).unionByName(unfit.select(*columns))


def orphan_report(found: DataFrame) -> DataFrame:
    """Count orphans per reference field, defect and month."""
    return found.groupBy("ref_field", "month_key", "defect").agg(F.count(F.lit(1)).alias("n_refs"))
