"""Queries of the general problems (p1, p2, p5, p6) over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralace.operators.features import class_slug, disagreements, entity_features, event_totals, place_key
from terralace.operators.references import orphan_report, orphans
from terralace.operators.spatial import points_in_regions, points_near_points
from terralace.operators.timestamps import normalise
from terralace.sources.tables import first_arrivals, table

# The states a link can be in.
STATUSES = ("matched", "changed", "moved", "new", "disappeared", "past_not_included")


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    det = first_arrivals(table(spark, d, "detection_records"), "id", "ingestion_time", ["image_id"])
    pair = first_arrivals(
        table(spark, d, "pairing_records"), "id", "pairing_time", ["current_detection_id", "past_detection_id"]
    )
    refs = det.select(
        F.lit("detection_records.image_id").alias("ref_field"), F.lit("image_records").alias("parent_table"),
        F.col("id").alias("rec_id"), F.col("image_id").alias("ref"), F.col("ingestion_time").alias("used_at"),
    )
    sides = F.explode(
        F.array(
            *[
                F.struct(F.lit(f"pairing_records.{c}").alias("ref_field"), F.col(c).alias("ref"))
                for c in ("current_detection_id", "past_detection_id")
            ]
        )
    ).alias("side")
    links = pair.select("id", "pairing_time", sides).select(
        "side.ref_field", F.lit("detection_records").alias("parent_table"), F.col("id").alias("rec_id"), "side.ref",
        F.col("pairing_time").alias("used_at"),
    )
    parents = [
        table(spark, d, t).groupBy("id").agg(F.min("ingestion_time").alias("arrived")).select(F.lit(t).alias("parent_table"), "id", "arrived")
        for t in ("image_records", "detection_records")
    ]
    deleted = table(spark, d, "deleted_records").select(F.col("rec_table").alias("parent_table"), F.col("rec_id").alias("id"))
    return refs.unionByName(links), parents[0].unionByName(parents[1]), deleted


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans(*_references(spark, d))


def p1_orphan_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(p1_found(spark, d))


def link_events(spark: SparkSession, d: str) -> DataFrame:
    """Pairing records, each once, with the two entities they belong to, their event type and their time."""
    raw = [
        "lat_center", "lon_center", "status", "current_object_class", "past_object_class", "current_capture_time", "past_capture_time",
    ]
    rows = first_arrivals(table(spark, d, "pairing_records"), "id", "pairing_time", raw)
    place = place_key(F.col("lat_center"), F.col("lon_center"))
    slug = class_slug(F.coalesce("current_object_class", "past_object_class", F.lit("unknown object")))
    return rows.select(
        "id",
        F.concat(F.lit("loc:"), place).alias("place"),
        F.concat(F.lit("asset:"), slug, F.lit(":"), place).alias("asset"),
        F.concat(F.coalesce(F.lower(F.trim("status")), F.lit("unknown")), F.lit(":"), slug).alias("event_type"),
        F.coalesce("current_capture_time", "past_capture_time").alias("seen_at"),
    )


def p2_event_totals(spark: SparkSession, d: str) -> DataFrame:
    return event_totals(link_events(spark, d), ["place", "asset"], "event_type", "seen_at")


def _event_types(spark: SparkSession, d: str) -> list[str]:
    """Every status with every class of the reference list (fixed, 60) or none."""
    labels = [r[0] for r in table(spark, d, "class_labels").select("label").distinct().orderBy("label").collect()]
    return [f"{s}:{c.strip().lower().replace(' ', '_')}" for s in STATUSES for c in (*labels, "unknown object")]


def p2_features(spark: SparkSession, d: str) -> DataFrame:
    """The wide table with recency at the latest pairing time."""
    now = table(spark, d, "pairing_records").agg(F.max("pairing_time")).first()[0]
    return entity_features(p2_event_totals(spark, d), _event_types(spark, d), F.lit(now))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return disagreements(table(spark, d, "graph_entities"), entity_features(p2_event_totals(spark, d), _event_types(spark, d)))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    img = first_arrivals(table(spark, d, "image_records"), "id", "ingestion_time", ["capture_time_raw", "station_id"])
    det = table(spark, d, "detection_records").where("detection_time_raw IS NOT NULL")
    det = first_arrivals(det, "id", "ingestion_time", ["detection_time_raw", "extra"])
    meta = table(spark, d, "image_meta").groupBy("meta_id").agg(F.min(F.struct("capture_time", "station_id")).alias("m"))
    rows = (
        img.select(F.lit("image_records").alias("rec_table"), F.col("id").alias("rec_id"), "station_id", F.col("capture_time_raw").alias("raw"))
        .unionByName(det.select(F.lit("detection_records").alias("rec_table"), F.col("id").alias("rec_id"), F.get_json_object("extra", "$.station").alias("station_id"), F.col("detection_time_raw").alias("raw")))
        .unionByName(meta.select(F.lit("image_meta").alias("rec_table"), F.col("meta_id").alias("rec_id"), "m.station_id", F.col("m.capture_time").alias("raw")))
        .where("raw IS NOT NULL")
    )
    stations = table(spark, d, "stations").select("station_id", "time_zone", F.col("date_order").alias("declared"))
    # one row per station, fixed at every scale
    return rows.join(F.broadcast(stations), "station_id", "left").withColumnRenamed("station_id", "source")


def p5_normalised(spark: SparkSession, d: str) -> DataFrame:
    return normalise(_texts(spark, d))


def p5_inferred_orders(spark: SparkSession, d: str) -> DataFrame:
    """As p5_normalised, with the declared orders withheld: the mixture of each station decides."""
    return normalise(_texts(spark, d).withColumn("declared", F.lit(None).cast("string")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_normalised(spark, d).where("utc_us IS NOT NULL").select("rec_table", "rec_id", "utc_us")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    img, det = table(spark, d, "image_records"), table(spark, d, "detection_records")
    columns = lambda t, lat, lon: [F.lit(t).alias("rec_table"), F.col("id").alias("rec_id"), F.col(lat).alias("lat"), F.col(lon).alias("lon")]
    points = (
        first_arrivals(img, "id", "ingestion_time", ["lat_center", "lon_center"]).select(*columns("image_records", "lat_center", "lon_center"))
        .unionByName(first_arrivals(det, "id", "ingestion_time", ["lat", "lon"]).select(*columns("detection_records", "lat", "lon")))
    )
    # nodes of all deliveries cover those of the first ones, and need no shuffle by id
    cover = img.select(F.col("lat_center").alias("lat"), F.col("lon_center").alias("lon")).unionByName(det.select("lat", "lon"))
    regions = table(spark, d, "sites").withColumnRenamed("site_id", "region_id")
    return points_in_regions(points, regions, cover).select("rec_table", "rec_id", F.col("region_id").alias("site_id"))


def p6_near_points(spark: SparkSession, d: str) -> DataFrame:
    """Image centres at most 20 km from the centre of a circular site."""
    img = first_arrivals(table(spark, d, "image_records"), "id", "ingestion_time", ["lat_center", "lon_center"])
    points = img.select(F.col("id").alias("rec_id"), F.col("lat_center").alias("lat"), F.col("lon_center").alias("lon"))
    others = table(spark, d, "sites").where("shape = 'circle'").select(F.col("site_id").alias("near_id"), "lat", "lon")
    return points_near_points(points, others, 20_000.0).select("rec_id", F.col("near_id").alias("site_id"))


QUERIES = {
    "p1_found": p1_found,
    "p1_orphan_report": p1_orphan_report,
    "p2_found": p2_found,
    "p2_event_totals": p2_event_totals,
    "p2_features": p2_features,
    "p5_found": p5_found,
    "p5_normalised": p5_normalised,
    "p5_inferred_orders": p5_inferred_orders,
    "p6_found": p6_found,
    "p6_near_points": p6_near_points,
}

# The reference list of classes, for the SQL that p2_features is compared with (the query reads the table).
_CLASSES = """
cargo ship, container ship, oil tanker, fishing boat, ferry, tugboat, barge, sailing yacht, dredger, passenger
jet, propeller aircraft, helicopter, glider, runway, taxiway, hangar, control tower, passenger car, pickup
truck, delivery van, articulated lorry, bus, tractor, combine harvester, excavator, bulldozer, concrete mixer,
motorcycle, locomotive, freight wagon, tram, warehouse, apartment block, detached house, greenhouse, grain
silo, storage tank, water tower, wind turbine, solar array, power pylon, substation, cooling chimney, bridge,
overpass, roundabout, tower crane, gantry crane, pier, breakwater, lighthouse, dam, sluice gate, fish pond,
quarry, gravel heap, landfill, stadium, tennis court, playground
"""
_TYPES = [f"{s}:{c}" for s in STATUSES for c in ("_".join(c.split()) for c in (*_CLASSES.split(","), "unknown object"))]

_BARE = "replace(replace(replace(CASE WHEN starts_with(lower(trim({0})), 'urn:uuid:') THEN substr(lower(trim({0})), 10) ELSE lower(trim({0})) END, '{{', ''), '}}', ''), '-', '')"
_P1 = f"""
WITH det AS (SELECT id, arg_min(image_id, ingestion_time) AS image_id, min(ingestion_time) AS t FROM detection_records GROUP BY id),
img AS (SELECT id, min(ingestion_time) AS t FROM image_records GROUP BY id),
pair AS (SELECT id, min(pairing_time) AS t, any_value(current_detection_id) AS c, any_value(past_detection_id) AS p FROM pairing_records GROUP BY id),
refs AS (
  SELECT 'detection_records.image_id' AS ref_field, 'image_records' AS tab, id, image_id AS ref, t FROM det
  UNION ALL SELECT 'pairing_records.current_detection_id', 'detection_records', id, c, t FROM pair
  UNION ALL SELECT 'pairing_records.past_detection_id', 'detection_records', id, p, t FROM pair),
k AS (SELECT *, {_BARE.format("ref")} AS bare FROM refs WHERE trim(ref) <> ''),
par AS (SELECT 'image_records' AS tab, {_BARE.format("id")} AS bare, t FROM img
  UNION ALL SELECT 'detection_records', {_BARE.format("id")}, t FROM det),
del AS (SELECT DISTINCT rec_table AS tab, {_BARE.format("rec_id")} AS bare FROM deleted_records),
j AS (SELECT k.*, par.t AS pt, del.bare IS NOT NULL AS gone FROM k LEFT JOIN par ON par.tab = k.tab AND par.bare = k.bare
  LEFT JOIN del ON del.tab = k.tab AND del.bare = k.bare),
o AS (SELECT ref_field, id AS rec_id, CASE WHEN pt IS NOT NULL THEN 'late' WHEN gone THEN 'deleted' ELSE 'missing' END AS defect,
  strftime(t, '%Y-%m') AS month_key FROM j WHERE pt IS NULL OR pt > t)
"""
_P2 = """
WITH pair AS (SELECT id, any_value(lat_center) AS la, any_value(lon_center) AS lo, any_value(status) AS st,
  any_value(coalesce(current_object_class, past_object_class)) AS cl, any_value(coalesce(current_capture_time, past_capture_time)) AS t
  FROM pairing_records GROUP BY id),
e AS (SELECT printf('%.2f', la) || ',' || printf('%.2f', lo) AS place,
  replace(lower(trim(coalesce(cl, 'unknown object'))), ' ', '_') AS slug, coalesce(lower(trim(st)), 'unknown') AS st, t FROM pair),
x AS (SELECT 'loc:' || place AS entity_id, st || ':' || slug AS event_type, t FROM e
  UNION ALL SELECT 'asset:' || slug || ':' || place, st || ':' || slug, t FROM e)
"""
_P6 = """
WITH pts AS (
  SELECT 'image_records' AS rec_table, id AS rec_id, arg_min(lat_center, ingestion_time) AS lat, arg_min(lon_center, ingestion_time) AS lon FROM image_records GROUP BY id
  UNION ALL SELECT 'detection_records', id, arg_min(lat, ingestion_time), arg_min(lon, ingestion_time) FROM detection_records GROUP BY id),
good AS (SELECT * FROM pts WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0))
SELECT rec_table, rec_id, site_id FROM good g JOIN sites s ON
  (s.shape = 'circle' AND abs(g.lat - s.lat) <= s.radius_m / 110000.0 AND 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(s.lat - g.lat) / 2), 2)
    + cos(radians(g.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - g.lon) / 2), 2)))) <= s.radius_m)
  OR (s.shape = 'box' AND g.lat BETWEEN s.lat_min AND s.lat_max AND
    CASE WHEN s.lon_min > s.lon_max THEN g.lon >= s.lon_min OR g.lon <= s.lon_max ELSE g.lon BETWEEN s.lon_min AND s.lon_max END)
"""

ORACLE = {
    "p1_found": _P1 + "SELECT * FROM o",
    "p1_orphan_report": _P1 + "SELECT ref_field, month_key, defect, count(*) AS n_refs FROM o GROUP BY ALL",
    "p2_found": _P2
    + """, r AS (SELECT entity_id, count(*) AS n, min(t) AS f FROM x GROUP BY 1),
    j AS (SELECT g.id, g.observation_count AS oc, g.first_seen AS fs, coalesce(r.n, 0) AS n, r.f FROM graph_entities g LEFT JOIN r ON r.entity_id = g.id)
    SELECT DISTINCT id AS entity_id, 'observation_count' AS feature FROM j WHERE oc IS DISTINCT FROM n
    UNION ALL SELECT DISTINCT id, 'first_seen' FROM j WHERE fs IS DISTINCT FROM f""",
    "p2_event_totals": _P2
    + "SELECT entity_id, event_type, count(*) AS n, min(t) AS first_time, max(t) AS last_time FROM x GROUP BY 1, 2",
    "p2_features": _P2
    + """, n AS (SELECT max(pairing_time) AS now FROM pairing_records)
    SELECT entity_id, count(*) AS n_links, min(t) AS first_time, max(t) AS last_time,
    round((epoch_us((SELECT now FROM n)) - epoch_us(max(t))) / 86400000000, 4) AS recency_days, """
    + ", ".join(f"""count(*) FILTER (event_type = '{t}') AS "{t}\"""" for t in _TYPES)
    + " FROM x GROUP BY 1",
    "p6_found": _P6,
    "p6_near_points": """WITH f AS (SELECT id AS rec_id, arg_min(lat_center, ingestion_time) AS lat, arg_min(lon_center, ingestion_time) AS lon FROM image_records GROUP BY id),
    g AS (SELECT * FROM f WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0))
    SELECT rec_id, site_id FROM g JOIN sites s ON s.shape = 'circle' AND abs(g.lat - s.lat) <= 0.19 AND 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(s.lat - g.lat) / 2), 2)
      + cos(radians(g.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - g.lon) / 2), 2)))) <= 20000""",
}
