"""Queries of the problems tagged llm over the domain tables; their SQL is in ``terralace.llm.sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralace.llm.canonical import map_values
from terralace.llm.cooccurrence import co_occurrence, surprise
from terralace.llm.leakage import copied, leaks
from terralace.llm.nearest import nearest_in_time
from terralace.llm.packing import containers, pack_texts
from terralace.llm.sql import ORACLE  # noqa: F401
from terralace.llm.subjects import subject_areas
from terralace.sources.tables import first_arrivals, small_enough, table, written

TOLERANCE_US = 120_000_000


def p3_nearest(spark: SparkSession, d: str) -> DataFrame:
    pairs = first_arrivals(
        table(spark, d, "pairing_records"), "id", "pairing_time", ["session_id", "current_capture_time", "past_capture_time"]
    )
    images = first_arrivals(table(spark, d, "image_records"), "id", "ingestion_time", ["session_id", "capture_time"])
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    sides = F.explode(
        F.array(*[F.struct(F.lit(s).alias("side"), micros(f"{s}_capture_time").alias("t_us")) for s in ("current", "past")])
    )
    left = pairs.select("id", F.col("session_id").alias("key"), sides.alias("x")).where("x.t_us IS NOT NULL")
    left = left.select(F.concat("x.side", F.lit("/"), "id").alias("left_id"), "key", "x.t_us")
    right = images.select(F.col("id").alias("right_id"), F.col("session_id").alias("key"), micros("capture_time").alias("t_us"))
    near = nearest_in_time(left, right, TOLERANCE_US)
    cut = F.instr("left_id", "/")
    return near.select(
        F.substr("left_id", cut + 1).alias("pairing_id"), F.substring_index("left_id", "/", 1).alias("side"),
        F.col("right_id").alias("image_id"), "gap_us",
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_nearest(spark, d).drop("gap_us")


def _class_baskets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    labels = table(spark, d, "class_labels").select(F.col("label").alias("object_class")).distinct()
    # the reference list is fixed at every scale
    rows = table(spark, d, "detection_records").select("session_id", "object_class").join(F.broadcast(labels), "object_class")
    baskets = table(spark, d, "pairing_records").select(F.col("session_id").alias("basket")).distinct()
    return rows.select(F.col("session_id").alias("basket"), F.col("object_class").alias("item")).distinct(), baskets


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    occurrences, baskets = _class_baskets(spark, d)
    occurrences, baskets = written(occurrences, "occurrences"), written(baskets, "baskets")
    pairs, n = co_occurrence(occurrences, baskets)
    return surprise(pairs, occurrences, baskets).withColumnsRenamed({"item_a": "class_a", "item_b": "class_b"}), n


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of classes with their surprise."""
    return _judged(spark, d)[0]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that occur together more often than the fitted null expects, by item frequency and basket size, and often."""
    judged, n = _judged(spark, d)
    often = (F.col("n_ab") >= 3) & (200 * F.col("n_ab") >= n) & (F.col("n_ab") * n >= 3 * F.col("n_a") * F.col("n_b"))
    return judged.where((F.col("n_ab") > F.col("expected")) & often).select("class_a", "class_b")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "class_labels").select("label_id", "label")
    det = first_arrivals(table(spark, d, "detection_records"), "id", "ingestion_time", ["object_class"])
    edits = first_arrivals(table(spark, d, "detection_in"), "edit_id", "submitted_at", ["object_class"])
    rows = det.select(F.lit("detection_records").alias("rec_table"), F.col("id").alias("rec_id"), F.col("object_class").alias("value"))
    rows = rows.unionByName(
        edits.select(F.lit("detection_in").alias("rec_table"), F.col("edit_id").cast("string").alias("rec_id"), F.col("object_class").alias("value"))
    ).where("value IS NOT NULL")
    # the reference list is fixed at every scale
    typed = written(rows.join(F.broadcast(labels.select(F.col("label").alias("value"))), "value", "left_anti"), "typed")
    mapped = written(map_values(typed.select("value"), labels), "mapped")
    mapped = F.broadcast(mapped) if small_enough(mapped) else mapped
    return typed.join(mapped, "value").select("rec_table", "rec_id", "label_id")


def p7_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that name no label, by how often they were typed."""
    det = table(spark, d, "detection_records").select(F.col("object_class").alias("value"))
    values = det.unionByName(table(spark, d, "detection_in").select(F.col("object_class").alias("value"))).where("value IS NOT NULL")
    counts = written(values.groupBy("value").agg(F.count(F.lit(1)).alias("n_rows")), "values")
    mapped = map_values(counts.select("value"), table(spark, d, "class_labels").select("label_id", "label"))
    return mapped.where("label_id = -1").join(counts, "value").select("value", "n_rows")


WINDOW = 15


def p9_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Documents and test items with their alignment, edited copies included: at least half of the item's score."""
    return leaks(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items"), 0.5).withColumn("coverage", F.round("coverage", 4))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return copied(table(spark, d, "documents"), table(spark, d, "eval_items"), WINDOW).select("doc_id", "item_id")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack_texts(table(spark, d, "documents").select("doc_id", "text"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return containers(p8_packed(spark, d))


def p10_mixtures(spark: SparkSession, d: str) -> DataFrame:
    return subject_areas(table(spark, d, "documents"), table(spark, d, "doc_labels"), table(spark, d, "subject_areas"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_mixtures(spark, d).where("about").select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Share of each subject in the documents: how many are about it, and its part of all subject terms."""
    mixed = p10_mixtures(spark, d)
    n = table(spark, d, "documents").count()
    return mixed.groupBy("subject").agg(
        F.count_if("about").alias("n_docs"), F.round(F.count_if("about") / F.lit(max(n, 1)), 6).alias("share_of_docs"),
        F.round(F.sum("weight"), 3).alias("weight"),
    )


QUERIES = {
    "p3_found": p3_found,
    "p3_nearest": p3_nearest,
    "p4_found": p4_found,
    "p4_pairs": p4_pairs,
    "p7_found": p7_found,
    "p7_unmatched": p7_unmatched,
    "p8_packed": p8_packed,
    "p8_containers": p8_containers,
    "p9_found": p9_found,
    "p9_alignments": p9_alignments,
    "p10_found": p10_found,
    "p10_mixtures": p10_mixtures,
    "p10_composition": p10_composition,
}
