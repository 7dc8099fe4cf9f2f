"""Queries of graphs made from links, of what is known around places, and of sessions with their frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralace.operators import filters, graph
from terralace.operators.asof import near_square
from terralace.plans.core_queries import STATUSES
from terralace.plans.reference_queries import NEAR, _edges, _located, frames, links, places
from terralace.plans.reference_sql import _COMP, _FR, _GEO, _LK, _LOC, _PL, _near
from terralace.sources.tables import cut_folder, table


def _ten_thousandths(c: str):
    return (F.floor(F.col(c) * 1000 + 0.5) / 1000).alias(c)


def extracted_entities(spark: SparkSession, d: str) -> DataFrame:
    e, _ = graph.extract(_located(spark, d))
    return e.select("id", "entity_type", "observation_count", _ten_thousandths("confidence_sum"), "first_seen", "last_seen")


def extracted_relations(spark: SparkSession, d: str) -> DataFrame:
    _, r = graph.extract(_located(spark, d))
    return r.select("source_id", "target_id", "relation_type", "n", _ten_thousandths("confidence_sum"))


def asset_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = _located(spark, d).where("place IS NOT NULL").withColumn("entity_id", F.concat(F.lit("asset:"), "slug", F.lit(":"), "place"))
    return graph.entity_rollup(rows, STATUSES)


def relations_merged(spark: SparkSession, d: str) -> DataFrame:
    """Stored relations by source, target and type; spellings of the type don't matter. Repeated rows count once."""
    rows = table(spark, d, "graph_relations").groupBy("id").agg(F.min(F.struct("source_id", "target_id", "relation_type", "properties", "created_at", "updated_at")).alias("r")).select("r.*")
    n = F.coalesce(F.get_json_object("properties", "$.count").cast("long"), F.lit(0))
    place = F.array_compact(F.array(F.nullif(F.substring_index("source_id", ":", -1), F.lit(""))))
    rows = rows.select("source_id", "target_id", F.translate(F.lower(F.trim("relation_type")), " -", "__").alias("kind"), n.alias("n"), "created_at", "updated_at", place.alias("locations"))
    return graph.relation_rollup(rows).withColumn("locations", F.array_join("locations", ";"))


def _entities_near(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "graph_entities").where("entity_type = 'asset'").select(
        "id", F.split_part("id", F.lit(":"), F.lit(2)).alias("object_class"), "observation_count",
        F.get_json_object("properties", "$.lat").cast("double").alias("lat"), F.get_json_object("properties", "$.lon").cast("double").alias("lon"),
    )
    return near_square(e, places(spark, d), NEAR)


def context_entities(spark: SparkSession, d: str) -> DataFrame:
    return graph.context(_entities_near(spark, d), "site_id")[0]


def context_classes(spark: SparkSession, d: str) -> DataFrame:
    return graph.context(_entities_near(spark, d), "site_id")[1]


def community_profiles(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "graph_entities").where("entity_type = 'asset'").select(
        "id", F.split_part("id", F.lit(":"), F.lit(2)).alias("object_class"), F.split_part("id", F.lit(":"), F.lit(3)).alias("cell"), "observation_count"
    )
    return graph.community_profile(graph.components(_edges(spark, d)), e)


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    """A graph indexed in two batches, one of them twice."""
    rows = _located(spark, d)
    index = graph.GraphIndex(spark, cut_folder(spark, "graph"))
    for batch, part in (("known", rows.where("status = 'matched'")), ("rest", rows), ("rest", rows.where("NOT status <=> 'matched'"))):
        index.index(part, batch)
    return index.stats()


def filter_built(spark: SparkSession, d: str) -> DataFrame:
    given = {"source_type": "satellite", "sensor_platform__like": "orbit", "lat_center__between": (-30, 60), "station_id__in": None, "session_id__known": True, "resolution_m__most": 0.5}
    return filters.matching(table(spark, d, "image_records"), given).select("id", "ingestion_time")


def latest_frames(spark: SparkSession, d: str) -> DataFrame:
    """A report of the hundred latest frames."""
    return filters.latest(frames(spark, d), "capture_time", "id", 100).select("id", "capture_time")


def first_or_none(spark: SparkSession, d: str) -> DataFrame:
    return filters.latest(filters.matching(frames(spark, d), {"source_type": "satellite"}), "capture_time", "id", 1).select("id", "session_id")


def busy_stations(spark: SparkSession, d: str) -> DataFrame:
    return filters.alerts(table(spark, d, "image_records"), "station_id", {"ST-01": 1, "ST-02": 1_000_000}, 50)


def nearest_frame(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).select("id", F.col("lat_center").alias("lat"), F.col("lon_center").alias("lon"))
    return filters.nearest_in_zone(f, F.col("lat").between(30, 60) & F.col("lon").between(-20, 40), (45.0, 10.0), (0.0, 0.0), "id").select("id", "lat", "lon")


def session_places(spark: SparkSession, d: str) -> DataFrame:
    """Where the first link of each session lies, for sessions of frames; else the place of its latest frame."""
    first = links(spark, d).where("session_id IS NOT NULL AND lat_center IS NOT NULL AND lon_center IS NOT NULL").groupBy("session_id").agg(F.min_by(F.struct("lat_center", "lon_center"), F.struct("pairing_time", "id")).alias("l"))
    last = frames(spark, d).where("session_id IS NOT NULL").groupBy("session_id").agg(F.max_by(F.struct("lat_center", "lon_center"), F.struct("capture_time", "id")).alias("f"))
    both = last.join(first, "session_id", "left")
    return both.select("session_id", F.coalesce("l.lat_center", "f.lat_center").alias("lat"), F.coalesce("l.lon_center", "f.lon_center").alias("lon"), F.col("l").isNotNull().alias("by_link"))


def session_frames(spark: SparkSession, d: str) -> DataFrame:
    """The current and the past frame of each session's latest link batch, by a chain of four ways.

    Current: the latest frame of the session, else that of the current observations, else one taken at their time.
    Past: the frame of the past observations, else one taken at their time. Of several, the latest time, then the largest id.
    """
    l = links(spark, d).where("session_id IS NOT NULL")  # noqa: E741
    newest = l.groupBy("session_id").agg(F.max("pairing_time").alias("pairing_time"))
    batch = l.join(newest, ["session_id", "pairing_time"])
    o = table(spark, d, "detection_records").groupBy("id").agg(F.min_by("image_id", "ingestion_time").alias("image_id")).where("image_id IS NOT NULL")
    f = frames(spark, d)
    own = f.where("session_id IS NOT NULL AND capture_time IS NOT NULL").groupBy("session_id").agg(F.max_by("id", F.struct("capture_time", "id")).alias("own_id"))
    out = newest.select("session_id").join(own, "session_id", "left")
    for side in ("current", "past"):
        at = F.col(f"{side}_capture_time")
        by_row = batch.join(o.select(F.col("id").alias(f"{side}_detection_id"), "image_id"), f"{side}_detection_id")
        by_row = by_row.groupBy("session_id").agg(F.max_by("image_id", F.struct(at.alias("t"), "image_id")).alias(f"{side}_row"))
        times = batch.where(at.isNotNull()).select("session_id", at.alias("capture_time")).distinct()
        by_time = times.join(f.select("capture_time", "id"), "capture_time").groupBy("session_id").agg(F.max_by("id", F.struct("capture_time", "id")).alias(f"{side}_time"))
        out = out.join(by_row, "session_id", "left").join(by_time, "session_id", "left")
    return out.select("session_id", F.coalesce("own_id", "current_row", "current_time").alias("current_image"), F.coalesce("past_row", "past_time").alias("past_image"))


QUERIES = {
    f.__name__: f
    for f in (
        extracted_entities, extracted_relations, asset_rollup, relations_merged, context_entities, context_classes, community_profiles, graph_stats,
        filter_built, latest_frames, first_or_none, busy_stations, nearest_frame, session_places, session_frames,
    )
}

_X = f"""WITH {_LK}, {_LOC}, g AS (SELECT *, 'loc:' || place AS l, 'asset:' || slug || ':' || place AS a FROM loc WHERE place IS NOT NULL),
e AS (SELECT l AS id, 'location' AS entity_type, conf, seen_at, st FROM g UNION ALL SELECT a, 'asset', conf, seen_at, st FROM g),
en AS (SELECT id, entity_type, count(*) AS observation_count, floor(sum(conf) * 1000 + 0.5) / 1000 AS confidence_sum, min(seen_at) AS first_seen, max(seen_at) AS last_seen FROM e GROUP BY 1, 2),
s AS (SELECT DISTINCT session_id, place, a FROM g WHERE session_id IS NOT NULL),
re AS (SELECT a AS source_id, l AS target_id, 'found_at' AS relation_type, count(*) AS n, floor(sum(conf) * 1000 + 0.5) / 1000 AS confidence_sum FROM g GROUP BY 1, 2
  UNION ALL SELECT x.a, y.a, 'co_occurred_with', count(*), NULL FROM s x JOIN s y ON x.session_id = y.session_id AND x.place = y.place AND x.a < y.a GROUP BY 1, 2)
"""
_NEAR = f"""{_GEO}, {_PL}, n AS (SELECT site_id, id, split_part(id, ':', 2) AS object_class, coalesce(observation_count, 0) AS c FROM ent JOIN pl ON {_near(0.05)} WHERE entity_type = 'asset')"""
_ROLL = ", ".join(f"count(*) FILTER (st = '{s}') AS n_{s}" for s in STATUSES)

ORACLE = {
    "extracted_entities": _X + "SELECT * FROM en",
    "extracted_relations": _X + "SELECT * FROM re",
    "asset_rollup": f"""WITH {_LK}, {_LOC}, g AS (SELECT *, 'asset:' || slug || ':' || place AS entity_id FROM loc WHERE place IS NOT NULL),
      s AS (SELECT entity_id, session_id, max(seen_at) AS t FROM g GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY t DESC NULLS LAST, session_id) AS k FROM s WHERE session_id IS NOT NULL),
      r AS (SELECT entity_id, string_agg(session_id, ',' ORDER BY k) AS last_sessions FROM k WHERE k <= 10 GROUP BY 1),
      a AS (SELECT entity_id, count(*) AS observation_count, round(sum(conf), 4) AS confidence_sum, min(seen_at) AS first_seen, max(seen_at) AS last_seen, count(DISTINCT session_id) AS n_sessions, {_ROLL} FROM g GROUP BY 1)
      SELECT a.*, last_sessions FROM a LEFT JOIN r ON r.entity_id = a.entity_id""",
    "relations_merged": """WITH r AS (SELECT id, any_value(source_id) AS s, any_value(target_id) AS t, any_value(relation_type) AS k, any_value(properties) AS p, any_value(created_at) AS c, any_value(updated_at) AS u FROM graph_relations GROUP BY id)
      SELECT s AS source_id, t AS target_id, replace(replace(lower(trim(k)), ' ', '_'), '-', '_') AS kind, CAST(sum(coalesce(CAST(json_extract_string(p, '$.count') AS BIGINT), 0)) AS BIGINT) AS n, min(c) AS created_at, max(u) AS updated_at,
        CASE WHEN s IS NULL THEN '' ELSE list_last(string_split(s, ':')) END AS locations FROM r GROUP BY 1, 2, 3""",
    "context_entities": f"WITH {_NEAR}, k AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY c DESC, id) AS place FROM n) SELECT site_id, CAST(place AS INT) AS place, id, object_class, c AS observation_count FROM k WHERE place <= 12",
    "context_classes": f"""WITH {_NEAR}, t AS (SELECT site_id, object_class, count(*) AS n_entities, CAST(sum(c) AS BIGINT) AS total FROM n GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY total DESC, object_class) AS k FROM t)
      SELECT site_id, object_class, n_entities, total FROM k WHERE k <= 5""",
    "community_profiles": _COMP
    + """, ce AS (SELECT component, split_part(id, ':', 2) AS cls, split_part(id, ':', 3) AS cell, observation_count AS c FROM comp JOIN graph_entities g ON g.id = comp.node WHERE entity_type = 'asset'),
      t AS (SELECT component, cls, CAST(sum(coalesce(c, 1)) AS BIGINT) AS n FROM ce GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY n DESC, cls) AS k FROM t),
      l AS (SELECT component, string_agg(cls || '(' || n || ')', ', ' ORDER BY k) AS label FROM k WHERE k <= 4 GROUP BY 1)
      SELECT ce.component, count(DISTINCT cell) AS n_cells, CAST(sum(coalesce(c, 0)) AS BIGINT) AS n_observations, any_value(label) AS label FROM ce LEFT JOIN l ON l.component = ce.component GROUP BY 1""",
    "graph_stats": _X.replace("count(*), NULL FROM s x", "count(DISTINCT x.session_id || x.st), NULL FROM s x").replace("SELECT DISTINCT session_id, place, a FROM g", "SELECT DISTINCT session_id, place, a, CASE WHEN st = 'matched' THEN 'm' ELSE 'r' END AS st FROM g").replace("AND x.a < y.a", "AND x.st = y.st AND x.a < y.a")
    + """SELECT entity_type AS kind, count(*) AS n, CAST(sum(observation_count) AS BIGINT) AS total FROM en GROUP BY 1 UNION ALL SELECT relation_type, count(*), CAST(sum(n) AS BIGINT) FROM re GROUP BY 1""",
    "filter_built": "SELECT id, ingestion_time FROM image_records WHERE source_type = 'satellite' AND sensor_platform ILIKE '%orbit%' AND lat_center BETWEEN -30 AND 60 AND session_id IS NOT NULL AND resolution_m <= 0.5",
    "latest_frames": f"WITH {_FR} SELECT id, capture_time FROM fr ORDER BY capture_time DESC NULLS LAST, id LIMIT 100",
    "first_or_none": f"WITH {_FR} SELECT id, session_id FROM fr WHERE source_type = 'satellite' ORDER BY capture_time DESC NULLS LAST, id LIMIT 1",
    "busy_stations": """WITH c AS (SELECT station_id, count(*) AS n, CAST(CASE station_id WHEN 'ST-01' THEN 1 WHEN 'ST-02' THEN 1000000 ELSE 50 END AS INT) AS most FROM image_records WHERE station_id IS NOT NULL GROUP BY 1) SELECT * FROM c WHERE n > most""",
    "nearest_frame": f"""WITH {_FR}, f AS (SELECT id, lat_center AS lat, lon_center AS lon, lat_center BETWEEN 30 AND 60 AND lon_center BETWEEN -20 AND 40 AS z FROM fr WHERE lat_center IS NOT NULL AND lon_center IS NOT NULL)
      SELECT id, lat, lon FROM f ORDER BY NOT z, CASE WHEN z THEN pow(lat - 45, 2) + pow(lon - 10, 2) ELSE pow(lat, 2) + pow(lon, 2) END, id LIMIT 1""",
    "session_places": f"""WITH {_FR}, {_LK}, a AS (SELECT session_id, lat_center AS la, lon_center AS lo FROM lk WHERE session_id IS NOT NULL AND lat_center IS NOT NULL AND lon_center IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY pairing_time, id) = 1),
      b AS (SELECT session_id, lat_center AS la, lon_center AS lo FROM fr WHERE session_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY capture_time DESC NULLS LAST, id DESC) = 1)
      SELECT b.session_id, coalesce(a.la, b.la) AS lat, coalesce(a.lo, b.lo) AS lon, a.session_id IS NOT NULL AS by_link FROM b LEFT JOIN a ON a.session_id = b.session_id""",
    "session_frames": f"""WITH {_FR}, {_LK}, nw AS (SELECT session_id AS s, max(pairing_time) AS t FROM lk WHERE session_id IS NOT NULL GROUP BY 1), bt AS (SELECT lk.* FROM lk JOIN nw ON s = session_id AND t = pairing_time),
      ob AS (SELECT id, arg_min(image_id, ingestion_time) AS image_id FROM detection_records WHERE image_id IS NOT NULL GROUP BY 1),
      ow AS (SELECT session_id AS s, max({{'t': capture_time, 'i': id}}).i AS i FROM fr WHERE session_id IS NOT NULL AND capture_time IS NOT NULL GROUP BY 1),
      c1 AS (SELECT session_id AS s, image_id AS i FROM bt JOIN ob ON ob.id = current_detection_id QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY current_capture_time DESC NULLS LAST, image_id DESC) = 1),
      c2 AS (SELECT bt.session_id AS s, fr.id AS i FROM bt JOIN fr ON fr.capture_time = current_capture_time QUALIFY row_number() OVER (PARTITION BY bt.session_id ORDER BY fr.capture_time DESC, fr.id DESC) = 1),
      p1 AS (SELECT session_id AS s, image_id AS i FROM bt JOIN ob ON ob.id = past_detection_id QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY past_capture_time DESC NULLS LAST, image_id DESC) = 1),
      p2 AS (SELECT bt.session_id AS s, fr.id AS i FROM bt JOIN fr ON fr.capture_time = past_capture_time QUALIFY row_number() OVER (PARTITION BY bt.session_id ORDER BY fr.capture_time DESC, fr.id DESC) = 1)
      SELECT nw.s AS session_id, coalesce(ow.i, c1.i, c2.i) AS current_image, coalesce(p1.i, p2.i) AS past_image FROM nw LEFT JOIN ow ON ow.s = nw.s LEFT JOIN c1 ON c1.s = nw.s LEFT JOIN c2 ON c2.s = nw.s LEFT JOIN p1 ON p1.s = nw.s LEFT JOIN p2 ON p2.s = nw.s""",
}
