"""Queries of the relational operators over the domain tables: frames, observations, links, entities, relations.

A record that was delivered several times counts once, by its first arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralace.functions import geometry as G
from terralace.operators import dml, graph, matching, text
from terralace.operators.asof import as_of, latest_batch, near_square
from terralace.operators.boxes import merge_adjacent, merge_contained, nms, tiles
from terralace.operators.features import class_slug, place_key
from terralace.operators.spatial import grid_join
from terralace.plans.core_queries import STATUSES
from terralace.sources.readers import groups_of_files, with_defaults
from terralace.sources.tables import first_arrivals, table, written
from terralace.streaming import windows as stream

FIXED_CLASSES = ["bridge", "dam", "pier", "lighthouse", "runway", "stadium", "wind turbine", "storage tank"]
NEAR = 0.05


def frames(spark: SparkSession, d: str) -> DataFrame:
    keep = ["capture_time", "source_type", "image_path", "lat_center", "lon_center", "lat_min", "lat_max", "lon_min", "lon_max", "sensor_platform", "det_width", "det_height", "session_id"]
    return first_arrivals(table(spark, d, "image_records"), "id", "ingestion_time", keep)


def observations(spark: SparkSession, d: str) -> DataFrame:
    keep = ["image_id", "detection_time", "object_class", "confidence", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "lat", "lon", "mask_rle", "mask_area_px", "source_type", "session_id"]
    return first_arrivals(table(spark, d, "detection_records"), "id", "ingestion_time", keep)


def links(spark: SparkSession, d: str) -> DataFrame:
    keep = [c for c in table(spark, d, "pairing_records").columns if c not in ("id", "pairing_time")]
    return first_arrivals(table(spark, d, "pairing_records"), "id", "pairing_time", keep)


def places(spark: SparkSession, d: str) -> DataFrame:
    """Circular sites as query points: fixed at every scale."""
    return table(spark, d, "sites").where("shape = 'circle'").select("site_id", F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon"))


def micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


# scans, filters, projections


def row_counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t in ("image_records", "detection_records", "pairing_records"):
        n = table(spark, d, t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
        out = n if out is None else out.unionByName(n)
    return out


def filter_optional(spark: SparkSession, d: str) -> DataFrame:
    """AND of the given predicates: type, platform (case doesn't matter), extent, known session."""
    given = [F.col("source_type") == "satellite", F.col("sensor_platform").ilike("%orbit%"), F.col("lat_center").between(-30, 60), F.col("session_id").isNotNull()]
    rows = table(spark, d, "image_records")
    for g in given:
        rows = rows.where(g)
    return rows.select("id", "ingestion_time", "sensor_platform")


def filter_in_or_null(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pairing_records")
    wanted = F.lower(F.trim("status")).isin("new", "moved") & (F.col("current_capture_time").isNotNull() | F.col("past_capture_time").isNotNull())
    return rows.where(wanted).select("id", "pairing_time", "status")


def not_synthetic(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "detection_records").where(F.coalesce("source_type", F.lit("")) != "synthetic").select("id", "ingestion_time", "source_type")


def quality_filter(spark: SparkSession, d: str) -> DataFrame:
    """Observations of at least 4 pixels a side whose box is not too large for the frame, by class."""
    o = table(spark, d, "detection_records").select("id", "image_id", "ingestion_time", "object_class", *[f"bbox_{c}" for c in ("x1", "y1", "x2", "y2")])
    f = frames(spark, d).select(F.col("id").alias("image_id"), "det_width", "det_height")
    w, h = F.col("bbox_x2") - F.col("bbox_x1"), F.col("bbox_y2") - F.col("bbox_y1")
    most = F.when(F.lower(F.trim("object_class")).isin(FIXED_CLASSES), 0.7).otherwise(0.15)
    return o.where((w >= 4) & (h >= 4)).join(f, "image_id").where(w * h <= most * F.col("det_width") * F.col("det_height")).select("id", "ingestion_time")


def point_in_extent(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d).select("id", "image_id", "lat", "lon")
    f = frames(spark, d).select(F.col("id").alias("image_id"), "lat_min", "lat_max", "lon_min", "lon_max")
    inside = G.in_extent(*[F.col(c) for c in ("lat", "lon", "lat_min", "lat_max", "lon_min", "lon_max")])
    known = F.col("lat_min").isNotNull() & F.col("lat_max").isNotNull() & F.col("lon_min").isNotNull() & F.col("lon_max").isNotNull()
    return o.join(f, "image_id").select("id", inside.alias("inside"), known.alias("bounds_known"))


def shaped_links(spark: SparkSession, d: str) -> DataFrame:
    """Rows as an interface shows them: short ids, rounded scores, times as text, parsed boxes, labels per status."""
    rows = links(spark, d).withColumn("st", F.coalesce(F.lower(F.trim("status")), F.lit("")))
    prefix = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for s, p in zip(STATUSES, "MCVNDP") for x in (s, p)]), F.col("st")), F.lit("X"))
    b = F.from_json("current_bbox", "struct<x1:double,y1:double,x2:double,y2:double>")
    return rows.select(
        "id", F.left("id", F.lit(8)).alias("short_id"), (F.floor(F.col("current_confidence") * 100 + 0.5) / 100).alias("conf"), F.date_format("pairing_time", "yyyy-MM-dd HH:mm:ss").alias("time_text"),
        b["x1"].alias("x1"), b["y2"].alias("y2"), prefix.alias("prefix"),
    )


def running_labels(spark: SparkSession, d: str) -> DataFrame:
    """N1, N2, D1 ... per session and status; the hot session is split by status only, so ranks come from counted blocks."""
    rows = links(spark, d).select("id", "session_id", F.coalesce(F.lower(F.trim("status")), F.lit("unknown")).alias("st"), "pairing_time")
    day = F.to_date("pairing_time")
    rows = rows.withColumn("day", day)
    per_day = rows.groupBy("session_id", "st", "day").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("session_id", "st").orderBy("day")) - F.col("n")
    place = F.row_number().over(Window.partitionBy("session_id", "st", "day").orderBy("pairing_time", "id"))
    ranked = rows.withColumn("place", place).join(per_day.withColumn("before", before).drop("n"), ["session_id", "st", "day"])
    return ranked.select("id", F.concat(F.upper(F.left("st", F.lit(1))), (F.col("before") + F.col("place")).cast("string")).alias("label"))


def json_props(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("properties")
    get = lambda k: F.round(F.coalesce(F.get_json_object(p, f"$.{k}").cast("double"), F.lit(0.0)), 4)
    return table(spark, d, "graph_entities").select("id", get("lat").alias("lat"), get("lon").alias("lon"))


def meta_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "image_meta").distinct()
    return with_defaults(rows).groupBy("source_type", "valid").agg(F.count(F.lit(1)).alias("n"), F.max("captured_at").alias("latest"))


def file_groups(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "image_records").select(F.concat(F.regexp_replace("image_path", "^frames/", ""), F.lit("_"), F.coalesce("source_type", F.lit("none"))).alias("path")).distinct()
    return groups_of_files(files.select(F.translate("path", "/", "_").alias("name")), 2)


# geometry


def pixel_to_geo(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d).select("id", "image_id", *[f"bbox_{c}" for c in ("x1", "y1", "x2", "y2")])
    f = frames(spark, d).drop("ingestion_time", "session_id").withColumnRenamed("id", "image_id")
    j = o.join(f, "image_id")
    x, y = (F.col("bbox_x1") + F.col("bbox_x2")) / 2, (F.col("bbox_y1") + F.col("bbox_y2")) / 2
    extent = tuple(F.col(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max"))
    lat, lon = G.pixel_to_geo(x, y, F.col("det_width"), F.col("det_height"), extent, (F.col("lat_center"), F.col("lon_center")))
    return j.select("id", (F.floor(lat * 100_000 + 0.5) / 100_000).alias("lat_px"), (F.floor(lon * 100_000 + 0.5) / 100_000).alias("lon_px"))


def geo_to_pixels(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d).select("id", "image_id", "lat", "lon")
    f = frames(spark, d).select(F.col("id").alias("image_id"), "lat_min", "lat_max", "lon_min", "lon_max", "det_width", "det_height")
    r = F.lit(0.0005)
    extent = tuple(F.col(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max"))
    geo = (F.col("lat") - r, F.col("lat") + r, F.col("lon") - r, F.col("lon") + r)
    j = o.join(f, "image_id").where("lon_min < lon_max AND lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max")
    return j.select("id", G.geo_to_pixels(geo, F.col("det_width"), F.col("det_height"), extent).alias("b")).where("b IS NOT NULL").select("id", "b.x1", "b.y1", "b.x2", "b.y2")


def mask_areas(spark: SparkSession, d: str) -> DataFrame:
    rows = observations(spark, d).where("mask_rle IS NOT NULL").select("id", G.mask(F.col("mask_rle")).alias("m"))
    return rows.select("id", F.get("m.shape", F.lit(0)).alias("height"), G.mask_area(F.col("m")).alias("area_px"))


def frame_tiles(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).select(F.col("id").alias("frame_id"), F.col("det_width").alias("width"), F.col("det_height").alias("height"))
    return tiles(f, 256, 64)


def boxes(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d)
    return o.select(
        F.col("image_id").alias("frame_id"), F.col("id").alias("box_id"), F.coalesce(F.lower(F.trim("object_class")), F.lit("")).alias("label"), F.col("confidence").alias("score"),
        *[F.col(f"bbox_{c}").cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")],
    ).where("frame_id IS NOT NULL")


def suppressed(spark: SparkSession, d: str) -> DataFrame:
    return nms(boxes(spark, d)).select("frame_id", "box_id")


def contained_merged(spark: SparkSession, d: str) -> DataFrame:
    return merge_contained(boxes(spark, d)).select("frame_id", "box_id", "label", "score")


def adjacent_merged(spark: SparkSession, d: str) -> DataFrame:
    return merge_adjacent(boxes(spark, d)).select("frame_id", "box_id", "label", "score", "x1", "x2")


# joins


def frame_counts(spark: SparkSession, d: str) -> DataFrame:
    """Observations per frame that aren't synthetic, zero included; an unknown type doesn't count."""
    f = frames(spark, d).select(F.col("id").alias("image_id"), "session_id")
    o = table(spark, d, "detection_records").where("source_type <> 'synthetic'").groupBy("image_id").agg(F.count_distinct("id").alias("n"))
    return f.join(o, "image_id", "left").select("image_id", F.coalesce("n", F.lit(0)).alias("n_observations"))


def semi_frames(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "detection_records").where(F.lower(F.trim("object_class")).like("%crane%"))
    return frames(spark, d).select("id", "session_id").join(o.select(F.col("image_id").alias("id")), "id", "left_semi")


def anti_unlinked(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "pairing_records").select(F.explode(F.array("current_detection_id", "past_detection_id")).alias("id")).where("id IS NOT NULL").distinct()
    return table(spark, d, "detection_records").select("id").distinct().join(used, "id", "left_anti")


def batches_before(spark: SparkSession, d: str) -> DataFrame:
    """Most recent earlier frame near each frame: of its own session if there is one, else of any."""
    f = frames(spark, d).where("capture_time IS NOT NULL AND lat_center IS NOT NULL AND lon_center IS NOT NULL AND NOT (lat_center = 0 AND lon_center = 0)")
    mine = f.select("id", F.col("session_id").alias("s"), F.col("capture_time").alias("t"), F.col("lat_center").alias("q_lat"), F.col("lon_center").alias("q_lon"))
    other = f.select(F.col("id").alias("prev_id"), F.col("session_id").alias("prev_s"), F.col("capture_time").alias("prev_t"), F.col("lat_center").alias("lat"), F.col("lon_center").alias("lon"))
    near = near_square(other, mine, 0.02).where("prev_t < t")
    rank = F.struct(F.coalesce(F.col("s") == F.col("prev_s"), F.lit(False)).alias("own"), "prev_t", "prev_id")
    return near.groupBy("id").agg(F.max(rank).alias("b")).select("id", F.col("b.prev_id").alias("prev_id"), F.col("b.own").alias("own_session"))


def latest_observations_near(spark: SparkSession, d: str) -> DataFrame:
    """For each place the observations of the latest time strictly before a moment, by the observations' own points."""
    o = observations(spark, d).where("detection_time < TIMESTAMP_NTZ'2024-10-01 00:00:00'").select("id", "image_id", "detection_time", "lat", "lon")
    f = frames(spark, d).select(F.col("id").alias("image_id"), "capture_time")
    near = near_square(o.join(f, "image_id"), places(spark, d), NEAR)
    return latest_batch(near, ["site_id"], "capture_time").select("site_id", "id")


def latest_frame_near(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).select("id", "capture_time", F.col("lat_center").alias("lat"), F.col("lon_center").alias("lon"))
    near = near_square(f, places(spark, d), NEAR).where("capture_time IS NOT NULL")
    best = F.max(F.struct("capture_time", "id")).alias("b")
    return near.groupBy("site_id").agg(best).select("site_id", F.col("b.id").alias("image_id"))


def previous_frame(spark: SparkSession, d: str) -> DataFrame:
    """The latest frame of the session that is strictly earlier."""
    f = frames(spark, d).select("id", "session_id", micros("capture_time").alias("at"))
    return as_of(f, f, "session_id", "at", "at", F.col("id"), strict=True).select("id", F.col("found").alias("prev_id")).where("prev_id IS NOT NULL")


def has_earlier_frame(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).select("id", "session_id", "capture_time")
    first = f.groupBy("session_id").agg(F.min("capture_time").alias("first_at"))
    return f.join(first, "session_id").where("capture_time > first_at").select("id")


def link_batch_before(spark: SparkSession, d: str) -> DataFrame:
    """The link batch of the session nearest before each frame's ingestion, and whether it is within 30 minutes."""
    f = frames(spark, d).select("id", "session_id", micros("ingestion_time").alias("at"))
    b = links(spark, d).select("session_id", micros("pairing_time").alias("p_at"))
    got = as_of(f, b, "session_id", "at", "p_at", F.col("p_at"))
    return got.select("id", F.col("found").alias("batch_us"), (F.col("found") >= F.col("at") - 1_800_000_000).alias("within")).where("batch_us IS NOT NULL")


def within_tolerance(spark: SparkSession, d: str) -> DataFrame:
    """Frames of the session at most 30 seconds from a link's current time, counted per link."""
    width = 30_000_000
    f = frames(spark, d).select("session_id", micros("capture_time").alias("f_at")).where("f_at IS NOT NULL").withColumn("slot", F.explode(F.array(*[F.floor(F.col("f_at") / width) + i for i in (-1, 0, 1)])))
    l = links(spark, d).select("id", "session_id", micros("current_capture_time").alias("at")).where("at IS NOT NULL").withColumn("slot", F.floor(F.col("at") / width))  # noqa: E741
    return l.join(f, ["session_id", "slot"]).where(F.abs(F.col("at") - F.col("f_at")) <= width).groupBy("id").agg(F.count(F.lit(1)).alias("n_frames"))


def sites_near_frames(spark: SparkSession, d: str) -> DataFrame:
    """Distance-bounded join in degrees: frames and places at most 0.05 apart."""
    f = frames(spark, d).select("id", F.col("lat_center").alias("x"), F.col("lon_center").alias("y"))
    s = places(spark, d).select("site_id", F.col("q_lat").alias("x"), F.col("q_lon").alias("y"))
    return grid_join(f, s, NEAR).select(F.col("l_id").alias("image_id"), F.col("r_site_id").alias("site_id"), F.round("distance", 6).alias("distance"))


def _pairs_of_frames(spark: SparkSession, d: str, near: bool = True) -> DataFrame:
    """Observations of each frame with those of the previous frame of its session, of one class.

    ``near``: only those whose places are given and at most 0.01 degrees apart. The others have no score.
    """
    prev = previous_frame(spark, d)
    o = observations(spark, d).select("id", "image_id", F.lower(F.trim("object_class")).alias("label"), "lat", "lon", *[F.col(f"bbox_{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])
    placed = F.expr("lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0)")
    o = o.where("label IS NOT NULL").withColumns({c: F.when(placed, F.col(c)) for c in ("lat", "lon")})
    o = o.where("lat IS NOT NULL") if near else o
    cur = o.join(prev.withColumnRenamed("id", "image_id"), "image_id")
    old = o.select(*[F.col(c).alias(f"p_{c}") for c in o.columns])
    far = G.euclid(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))
    joined = cur.join(old, (F.col("prev_id") == F.col("p_image_id")) & (F.col("label") == F.col("p_label")))
    a, b = G.box(), G.box("p_")
    size = G.size_ratio(G.area(a), G.area(b))
    joined = joined.withColumn("far", far)
    score = F.round(G.mixed_score(G.proximity(F.col("far"), 0.01), size), 6)
    middle = lambda x: ((x[0] + x[2]) / 2, (x[1] + x[3]) / 2)
    return (joined.where("far <= 0.01") if near else joined).select(
        "image_id", F.col("id").alias("left_id"), F.col("p_id").alias("right_id"), "label", F.round(G.iou(a, b), 6).alias("iou"),
        F.when(F.col("far") <= 0.01, score).alias("score"), G.euclid(*middle(a), *middle(b)).alias("moved"),
        F.greatest(b[2] - b[0], b[3] - b[1], F.lit(1.0)).alias("side"),
    )


def scored_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs_of_frames(spark, d).where("score > 0.5").select("left_id", "right_id", "score")


def best_iou(spark: SparkSession, d: str) -> DataFrame:
    """Best box of the current frame for each earlier box, not one-to-one, from an IoU of 0.1."""
    rows = _pairs_of_frames(spark, d, near=False).where("iou >= 0.1")
    best = F.max_by("left_id", F.struct("iou", "left_id"))
    return rows.groupBy("right_id").agg(best.alias("left_id"), F.max("iou").alias("iou"))


def one_to_one(spark: SparkSession, d: str) -> DataFrame:
    c = _pairs_of_frames(spark, d).where("score > 0.5")
    return matching.greedy_match(c, ["image_id"]).select("left_id", "right_id", "score")


def one_to_one_rounds(spark: SparkSession, d: str) -> DataFrame:
    c = _pairs_of_frames(spark, d).where("score > 0.5")
    return matching.match_in_rounds(c, ["image_id"]).select("left_id", "right_id", "score")


def _stages(spark: SparkSession, d: str) -> list[DataFrame]:
    """Box overlap first, then pixels between the centres, less than twice the longest side of the earlier box, then
    closeness in degrees: what a stage takes isn't open to the next."""
    pairs = _pairs_of_frames(spark, d, near=False).where("iou > 0.25 OR moved < 2 * side OR score IS NOT NULL")
    c = written(pairs.select("image_id", "left_id", "right_id", "iou", "moved", "side", "score"), "pairs")
    ends = ["image_id", "left_id", "right_id"]
    return [c.where("iou > 0.25").select(*ends, F.col("iou").alias("score")), c.where("moved < 2 * side").select(*ends, (-F.col("moved")).alias("score")), c.where("score IS NOT NULL").select(*ends, "score")]


def staged_pairs(spark: SparkSession, d: str) -> DataFrame:
    return matching.staged_match(_stages(spark, d), ["image_id"]).select("left_id", "right_id", "stage")


def _linked(spark: SparkSession, d: str, scored, **rules) -> DataFrame:
    """Each frame linked with the previous one of its session."""
    f = frames(spark, d).select("id", "capture_time", "lat_min", "lat_max", "lon_min", "lon_max")
    prev = previous_frame(spark, d)
    o = observations(spark, d).select("id", "image_id", F.trim("object_class").alias("label"), "lat", "lon", "detection_time")
    pick = lambda own, other: [
        F.col("id").alias("obs_id"), F.coalesce("label", F.lit("")).alias("label"), "lat", "lon", F.coalesce("detection_time", F.col(f"{own}_at")).alias("at"), F.col(f"{own}_at").alias("frame_at"),
        *[F.col(f"{other}_{k}").alias(a) for k, a in (("lat_min", "south"), ("lat_max", "north"), ("lon_min", "west"), ("lon_max", "east"))],
    ]
    both = prev.withColumnRenamed("id", "pair_id")
    for own, key in (("cur", "pair_id"), ("old", "prev_id")):
        both = both.join(f.select(F.col("id").alias(key), F.col("capture_time").alias(f"{own}_at"), *[F.col(c).alias(f"{own}_{c}") for c in ("lat_min", "lat_max", "lon_min", "lon_max")]), key)
    both = written(both, "frame-pairs")
    cur = o.join(both.withColumn("image_id", F.col("pair_id")), "image_id").select("pair_id", *pick("cur", "old"))
    old = o.join(both.withColumn("image_id", F.col("prev_id")), "image_id").select("pair_id", *pick("old", "cur"))
    # an observation is written up to two minutes after its frame was taken; what is later was not seen in it
    return matching.link_frames(cur, old, scored, FIXED_CLASSES, late_s=120, **rules)


def linked_frames(spark: SparkSession, d: str) -> DataFrame:
    """The whole linking by score."""
    return _linked(spark, d, _pairs_of_frames(spark, d).select(F.col("image_id").alias("pair_id"), "left_id", "right_id", "score"))


def tracked_links(spark: SparkSession, d: str) -> DataFrame:
    """The whole linking by boxes: overlap, pixels between centres, degrees; fixed classes by place only."""
    return _linked(spark, d, [s.withColumnRenamed("image_id", "pair_id") for s in _stages(spark, d)], fixed_by_place_only=True)


def cross_checked(spark: SparkSession, d: str) -> DataFrame:
    """Linking by score, then a second look at what is unmatched; the confidence stands for the similarity."""
    o = observations(spark, d).select(F.col("id").alias("obs_id"), F.col("confidence").alias("similarity"))
    links_ = written(linked_frames(spark, d), "links")
    seen = links_.select("pair_id", F.explode(F.array_compact(F.array("current_id", "past_id"))).alias("obs_id")).join(o, "obs_id")
    return matching.cross_check(links_, seen, 0.8)


def box_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Gaps between boxes of one class in a frame and the previous one that are at most 20 pixels apart."""
    prev = previous_frame(spark, d)
    o = observations(spark, d).select("id", "image_id", F.lower(F.trim("object_class")).alias("label"), *[F.col(f"bbox_{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])
    old = o.select(*[F.col(c).alias(f"p_{c}") for c in o.columns])
    both = o.join(prev.withColumnRenamed("id", "image_id"), "image_id").join(old, (F.col("prev_id") == F.col("p_image_id")) & (F.col("label") == F.col("p_label")))
    across, down = G.gaps(G.box(), G.box("p_"))
    return both.select("id", F.col("p_id").alias("past_id"), F.round(across, 3).alias("across"), F.round(down, 3).alias("down")).where("across <= 20 AND down <= 20")


def best_links(spark: SparkSession, d: str) -> DataFrame:
    """Links without conflicts: an observation keeps the link of the best status, then the smallest id."""
    rows = links(spark, d).select("id", F.nullif(F.trim("current_detection_id"), F.lit("")).alias("cur"), F.nullif(F.trim("past_detection_id"), F.lit("")).alias("old"), F.lower(F.trim("status")).alias("st"))
    order = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(STATUSES) for x in (s, i)]), F.col("st")), F.lit(9))
    return matching.dedup_by_priority(rows, order, "cur", "old", "id").select("id")


def change_status(spark: SparkSession, d: str) -> DataFrame:
    """Classes per place before and after a moment, by a full outer join."""
    l = links(spark, d).select(place_key(F.col("lat_center"), F.col("lon_center")).alias("place"), class_slug(F.coalesce("current_object_class", "past_object_class", F.lit("unknown object"))).alias("slug"), F.coalesce("current_capture_time", "past_capture_time", "pairing_time").alias("t"))  # noqa: E741
    cut = F.lit("2024-09-01 00:00:00").cast("timestamp_ntz")
    seen = l.groupBy("place", "slug").agg(F.max(F.col("t") < cut).alias("before"), F.max(F.col("t") >= cut).alias("after"))
    any_ = l.groupBy("place").agg(F.max(F.col("t") < cut).alias("place_before"), F.max(F.col("t") >= cut).alias("place_after"))
    status = (
        F.when(F.col("before") & F.col("after"), "matched").when(F.col("after") & ~F.col("place_before"), "past_not_included").when(F.col("after"), "new")
        .when(~F.col("place_after"), "current_not_included").otherwise("disappeared")
    )
    return seen.join(any_, "place").select("place", "slug", status.alias("status"))


def lineage(spark: SparkSession, d: str) -> DataFrame:
    """Link to observation to frame: by the current reference, else by the past one; written keys only."""
    l = links(spark, d).select("id", "current_detection_id", "past_detection_id")  # noqa: E741
    o = table(spark, d, "detection_records").groupBy("id").agg(F.min("image_id").alias("image_id"))
    cur = o.select(F.col("id").alias("current_detection_id"), F.col("image_id").alias("cur_image"))
    old = o.select(F.col("id").alias("past_detection_id"), F.col("image_id").alias("old_image"))
    f = table(spark, d, "image_records").groupBy(F.col("id").alias("image_id")).agg(F.min("image_path").alias("image_path"))
    j = l.join(cur, "current_detection_id", "left").join(old, "past_detection_id", "left").withColumn("image_id", F.coalesce("cur_image", "old_image"))
    return j.join(f, "image_id").select("id", "image_path")


def sessions_near(spark: SparkSession, d: str) -> DataFrame:
    """For each place the newest link batch of the sessions seen near it, else the newest of all."""
    l = links(spark, d).select("session_id", "pairing_time", F.col("lat_center").alias("lat"), F.col("lon_center").alias("lon"))  # noqa: E741
    newest = l.groupBy("session_id").agg(F.max("pairing_time").alias("batch_at"))
    q = places(spark, d)
    near = near_square(l.select("session_id", "lat", "lon").distinct(), q, NEAR).select("site_id", "session_id").distinct().join(newest, "session_id")
    top = near.groupBy("site_id").agg(F.max(F.struct("batch_at", "session_id")).alias("b"))
    # one row: the newest batch of all
    whole = newest.agg(F.max(F.struct("batch_at", "session_id")).alias("w"))
    joined = q.select("site_id").join(top, "site_id", "left").withColumn("one", F.lit(1)).join(F.broadcast(whole.withColumn("one", F.lit(1))), "one")
    best = F.coalesce("b", "w")
    return joined.select("site_id", best["session_id"].alias("session_id"), F.col("b").isNotNull().alias("near"))


# aggregations, windows, limits


def class_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "detection_records").groupBy(F.lower(F.trim("object_class")).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("avg_conf"), F.min("confidence").alias("min_conf"), F.max("confidence").alias("max_conf")
    ).orderBy(F.desc("n"), "label")


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = links(spark, d).select("session_id", F.lower(F.trim("status")).alias("st"))
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_links"), *[F.count_if(F.col("st") == s).alias(f"n_{s}") for s in STATUSES])


def session_summary(spark: SparkSession, d: str) -> DataFrame:
    """Centre, first past and last current time, and extent of the frames of each session."""
    l = links(spark, d).groupBy("session_id").agg(F.round(F.avg("lat_center"), 4).alias("lat"), F.round(F.avg("lon_center"), 4).alias("lon"), F.min("past_capture_time").alias("first_past"), F.max("current_capture_time").alias("last_current"))  # noqa: E741
    e = table(spark, d, "image_records").groupBy("session_id").agg(F.min("lat_min").alias("south"), F.max("lat_max").alias("north"), F.min("lon_min").alias("west"), F.max("lon_max").alias("east"))
    return l.join(e, "session_id", "left")


def common_classes(spark: SparkSession, d: str) -> DataFrame:
    """The five most common classes of each session as one text."""
    n = links(spark, d).select("session_id", F.lower(F.trim(F.coalesce("current_object_class", "past_object_class"))).alias("label")).where("label IS NOT NULL").groupBy("session_id", "label").agg(F.count(F.lit(1)).alias("n"))
    top = n.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("n"), "label"))).where("place <= 5")
    listed = F.array_sort(F.collect_list(F.struct("place", "label", "n")))
    return top.groupBy("session_id").agg(F.array_join(F.transform(listed, lambda x: F.concat(x["label"], F.lit(" x"), x["n"].cast("string"))), ", ").alias("classes"))


def top_with_rest(spark: SparkSession, d: str) -> DataFrame:
    """Per session the 20 links of highest confidence, and how many are left with what mean."""
    rows = links(spark, d).where("current_confidence IS NOT NULL AND session_id IS NOT NULL").select("session_id", "id", "current_confidence")
    # thousandths add up exactly in any order
    thousandths = F.sum(F.round(F.col("current_confidence") * 1000).cast("long"))
    # the best of parts first, so that a hot session is ranked in several tasks
    order = [F.desc("current_confidence"), "id"]
    part = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(32)))
    local = part.withColumn("p", F.row_number().over(Window.partitionBy("session_id", "part").orderBy(*order))).where("p <= 20")
    best = local.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(*order))).where("place <= 20")
    whole = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), thousandths.alias("s"))
    kept = best.groupBy("session_id").agg(F.count(F.lit(1)).alias("k"), thousandths.alias("ks"), F.max("current_confidence").alias("best"))
    left = F.col("n") - F.col("k")
    return whole.join(kept, "session_id").select("session_id", "best", "k", left.alias("n_rest"), F.coalesce(F.floor((F.col("s") - F.col("ks")) * 10 / F.nullif(left, F.lit(0)) + 0.5) / 10_000, F.lit(0.0)).alias("mean_rest"))


def latest_link_batch(spark: SparkSession, d: str) -> DataFrame:
    return latest_batch(links(spark, d).select("id", "session_id", "pairing_time"), ["session_id"], "pairing_time").select("id")


# graph


def _located(spark: SparkSession, d: str) -> DataFrame:
    place = place_key(F.col("lat_center"), F.col("lon_center"))
    slug = class_slug(F.coalesce("current_object_class", "past_object_class", F.lit("unknown object")))
    return links(spark, d).select(
        place.alias("place"), slug.alias("slug"), F.lower(F.trim("status")).alias("status"), F.coalesce("current_confidence", "past_confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("current_capture_time", "past_capture_time").alias("seen_at"), "session_id",
    )


def entity_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = _located(spark, d).withColumn("entity_id", F.concat(F.lit("loc:"), "place"))
    return graph.entity_rollup(rows, STATUSES)


def relation_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "graph_relations").groupBy("id").agg(F.min(F.struct("source_id", "target_id", "relation_type", "properties")).alias("r")).select("r.*")
    kind = F.translate(F.lower(F.trim("relation_type")), " -", "__")
    n = F.coalesce(F.get_json_object("properties", "$.count").cast("long"), F.lit(0))
    return rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_relations"), F.sum(n).alias("total"), F.count_distinct("source_id").alias("n_sources"))


def cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """Classes seen together at a place in two or more sessions; each pair once."""
    seen = _located(spark, d).select("session_id", "place", "slug").distinct()
    other = seen.withColumnRenamed("slug", "slug_b")
    # the classes of one session at one place are few, whatever the session has elsewhere
    pairs = seen.join(other, ["session_id", "place"]).where("slug < slug_b")
    return pairs.groupBy("place", F.col("slug").alias("slug_a"), "slug_b").agg(F.count(F.lit(1)).alias("n_sessions")).where("n_sessions >= 2")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_relations").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "graph_relations").groupBy("id").agg(F.min(F.struct("source_id", "target_id", "properties")).alias("r")).select("r.*")
    n = F.coalesce(F.get_json_object("properties", "$.count").cast("long"), F.lit(0))
    return graph.undirected(rows.withColumn("n", n), "source_id", "target_id", "n")


def components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(_edges(spark, d))


def communities(spark: SparkSession, d: str) -> DataFrame:
    entities = table(spark, d, "graph_entities").select("id", "entity_type", "observation_count")
    return graph.community_rollup(graph.components(_edges(spark, d)), entities)


def local_search(spark: SparkSession, d: str) -> DataFrame:
    """Entities near each place with their totals: how many, of how many classes, and with how many observations."""
    e = table(spark, d, "graph_entities").select("id", "entity_type", "observation_count", F.get_json_object("properties", "$.lat").cast("double").alias("lat"), F.get_json_object("properties", "$.lon").cast("double").alias("lon"))
    near = near_square(e, places(spark, d), NEAR)
    return near.groupBy("site_id").agg(F.count(F.lit(1)).alias("n_entities"), F.count_if(F.col("entity_type") == "asset").alias("n_assets"), F.coalesce(F.sum("observation_count"), F.lit(0)).alias("n_observations"))


def global_search(spark: SparkSession, d: str) -> DataFrame:
    """Communities by their overlap with the entities near the places; the first five."""
    e = table(spark, d, "graph_entities").select("id", F.get_json_object("properties", "$.lat").cast("double").alias("lat"), F.get_json_object("properties", "$.lon").cast("double").alias("lon"))
    local = near_square(e, places(spark, d), NEAR).select(F.col("id").alias("node"))
    return graph.overlapping_communities(graph.components(_edges(spark, d)), local)


# text and vectors


def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(text.sentences(F.col("text"))).alias("n_sentences"))


def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = text.chunks(table(spark, d, "documents").select("doc_id", "text"))
    return c.select("doc_id", "chunk_no", F.length("text").alias("n_chars"), text.shorten(F.col("text"), 40).alias("start"))


def vector_top_k(spark: SparkSession, d: str) -> DataFrame:
    """Exact search: every vector whose id is divisible by 50 against all vectors."""
    e = table(spark, d, "embeddings").select("vec_id", G.unit(F.col("embedding")).alias("v"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return text.vector_top_k(q, e, 5).select("query_id", "vec_id", F.round("score", 4).alias("score"))


# changes


def dml_partial_update(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).select("id", "lat_min", "lat_max", "source_type")
    change = f.where("lat_min IS NULL").select("id", F.lit(-1.0).alias("lat_min"), F.lit(None).cast("double").alias("lat_max"))
    return dml.partial_update(f, change, "id", ["lat_min", "lat_max"])


def dml_delete(spark: SparkSession, d: str) -> DataFrame:
    return dml.delete_where(table(spark, d, "detection_records"), F.col("source_type") == "synthetic").select("id", "ingestion_time", "object_class", "source_type")


def dml_replace(spark: SparkSession, d: str) -> DataFrame:
    """Replace the observations of every frame that was edited by the edited ones."""
    o = observations(spark, d).select(F.col("id").alias("obs_id"), "image_id", "object_class", "confidence")
    n = first_arrivals(table(spark, d, "detection_in"), "edit_id", "submitted_at", ["image_id", "object_class", "confidence"])
    n = n.where("image_id IS NOT NULL").select(F.concat(F.lit("edit-"), F.col("edit_id").cast("string")).alias("obs_id"), "image_id", "object_class", F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)).alias("confidence"))
    return dml.replace_groups(o, n, "image_id")


def dml_remap(spark: SparkSession, d: str) -> DataFrame:
    """Links to observations of an edited frame go to the first edit of that frame."""
    o = table(spark, d, "detection_records").groupBy("id").agg(F.min("image_id").alias("image_id"))
    e = table(spark, d, "detection_in").where("image_id IS NOT NULL").groupBy("image_id").agg(F.concat(F.lit("edit-"), F.min("edit_id").cast("string")).alias("new_id"))
    mapping = o.join(e, "image_id").select(F.col("id").alias("old_id"), "new_id")
    return dml.remap(links(spark, d).select("id", "current_detection_id", "past_detection_id"), mapping, ["current_detection_id", "past_detection_id"])


def dml_merge(spark: SparkSession, d: str) -> DataFrame:
    """Stored entities merged with the rollup of the links, as an incremental index does it."""
    old = table(spark, d, "graph_entities").where("entity_type = 'location'").select("id", F.coalesce("observation_count", F.lit(0)).cast("long").alias("n"), "first_seen", "last_seen")
    new = _located(spark, d).groupBy(F.concat(F.lit("loc:"), "place").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))
    return dml.merge_counts(old, new, "id", ["n"], ["first_seen"], ["last_seen"])


# streams


def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return stream.available_now(stream.tumbling(stream.event_stream(spark, d)), "complete")


def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    return stream.available_now(stream.sliding(stream.event_stream(spark, d)), "complete")


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return stream.available_now(stream.sessions(stream.event_stream(spark, d)), "complete")


def stream_first_deliveries(spark: SparkSession, d: str) -> DataFrame:
    return stream.available_now(stream.first_deliveries(stream.event_stream(spark, d)).select("event_id", "event_type"))


def stream_follow_ups(spark: SparkSession, d: str) -> DataFrame:
    return stream.available_now(stream.follow_ups(stream.event_stream(spark, d)))


def stream_value_changes(spark: SparkSession, d: str) -> DataFrame:
    return stream.available_now(stream.value_changes(stream.event_stream(spark, d)), "update", ["user_id"])


def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    return stream.available_now(stream.counts(stream.event_stream(spark, d)), "update", ["event_type"])


QUERIES = {
    f.__name__: f
    for f in (
        row_counts, filter_optional, filter_in_or_null, not_synthetic, quality_filter, point_in_extent, shaped_links, running_labels, json_props,
        meta_parse, file_groups, pixel_to_geo, geo_to_pixels, mask_areas, frame_tiles, suppressed, contained_merged, adjacent_merged, frame_counts,
        semi_frames, anti_unlinked, batches_before, latest_observations_near, latest_frame_near, previous_frame, has_earlier_frame,
        link_batch_before, within_tolerance, sites_near_frames, scored_pairs, best_iou, one_to_one, one_to_one_rounds, staged_pairs, linked_frames, tracked_links, cross_checked, box_gaps,
        best_links, change_status, lineage, sessions_near, class_summary, status_counts, session_summary, common_classes, top_with_rest,
        latest_link_batch, entity_rollup, relation_rollup, cooccurrence, graph_edges, components, communities, local_search, global_search,
        sentence_counts, text_chunks, vector_top_k, dml_partial_update, dml_delete, dml_replace, dml_remap, dml_merge, stream_tumbling,
        stream_sliding, stream_sessions, stream_first_deliveries, stream_follow_ups, stream_value_changes, stream_counts,
    )
}

from terralace.plans.reference_sql import ORACLE  # noqa: E402, F401
