"""The SQL that the reference queries are compared with (DuckDB)."""

from __future__ import annotations

_FR = "fr AS (SELECT * FROM image_records QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingestion_time) = 1)"
_OB = "ob AS (SELECT * FROM detection_records QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingestion_time) = 1)"
_LK = "lk AS (SELECT * FROM pairing_records QUALIFY row_number() OVER (PARTITION BY id ORDER BY pairing_time) = 1)"
_PL = "pl AS (SELECT site_id, lat AS q_lat, lon AS q_lon FROM sites WHERE shape = 'circle')"
_FIXED = "('bridge', 'dam', 'pier', 'lighthouse', 'runway', 'stadium', 'wind turbine', 'storage tank')"
_STATUSES = ("matched", "changed", "moved", "new", "disappeared", "past_not_included")
_PLACE = "printf('%.2f', lat_center) || ',' || printf('%.2f', lon_center)"
_SLUG = "replace(lower(trim(coalesce(current_object_class, past_object_class, 'unknown object'))), ' ', '_')"
_LOC = f"""loc AS (SELECT {_PLACE} AS place, {_SLUG} AS slug, lower(trim(status)) AS st, coalesce(current_confidence, past_confidence, 0.0) AS conf,
  coalesce(current_capture_time, past_capture_time) AS seen_at, session_id FROM lk)"""

# white space of all kinds, as a class and as a list of characters
_WHITE = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BLANKS = " || ".join(f"chr({i})" for i in (*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))
_SENTENCES = rf"""st AS (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?]){_WHITE}+', '\1' || chr(1), 'g'), '\n{{2,}}', chr(1), 'g'), chr(1)),
  lambda x: trim(x, {_BLANKS})), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL)"""


def _near(radius: float, lat: str = "lat", lon: str = "lon") -> str:
    return f"{lat} BETWEEN q_lat - {radius} AND q_lat + {radius} AND {lon} BETWEEN q_lon - {radius} AND q_lon + {radius}"


_OVER = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0.0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0.0)"
_AREA = "(greatest({0}.x2 - {0}.x1, 0.0) * greatest({0}.y2 - {0}.y1, 0.0))"
_PREV = """pv AS (SELECT a.id, (SELECT max({'t': b.capture_time, 'i': b.id}) FROM fr b WHERE b.session_id = a.session_id AND b.capture_time < a.capture_time).i AS prev_id FROM fr a),
prev AS (SELECT * FROM pv WHERE prev_id IS NOT NULL)"""
_PAIRS = f"""{_FR}, {_OB}, {_PREV},
bx AS (SELECT id, image_id, lower(trim(object_class, ' ')) AS label, lat, lon, bbox_x1 AS x1, bbox_y1 AS y1, bbox_x2 AS x2, bbox_y2 AS y2 FROM ob
  WHERE object_class IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0)),
pr AS (SELECT a.image_id, a.id AS left_id, b.id AS right_id, a.label, sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2)) AS far,
  round({_OVER} / ({_AREA.format("a")} + {_AREA.format("b")} - {_OVER} + 1e-6), 6) AS iou,
  least(greatest({_AREA.format("a")}, 1e-6), greatest({_AREA.format("b")}, 1e-6)) / greatest(greatest({_AREA.format("a")}, 1e-6), greatest({_AREA.format("b")}, 1e-6)) AS size
  FROM bx a JOIN prev ON prev.id = a.image_id JOIN bx b ON b.image_id = prev.prev_id AND b.label = a.label),
pairs AS (SELECT *, round(greatest(0.0, 1 - far / 0.01) * 0.8 + size * 0.2, 6) AS score FROM pr WHERE far <= 0.01)"""
# all pairs of one class in a frame and the previous one; places that are not given have no distance
_ALL = f"""{_FR}, {_OB}, {_PREV},
bx AS (SELECT id, image_id, lower(trim(object_class, ' ')) AS label, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0) THEN lat END AS lat,
  CASE WHEN lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0) THEN lon END AS lon, bbox_x1 AS x1, bbox_y1 AS y1, bbox_x2 AS x2, bbox_y2 AS y2 FROM ob WHERE object_class IS NOT NULL),
ap AS (SELECT a.image_id, a.id AS left_id, b.id AS right_id, a.label, sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2)) AS far,
  round({_OVER} / ({_AREA.format("a")} + {_AREA.format("b")} - {_OVER} + 1e-6), 6) AS iou,
  least(greatest({_AREA.format("a")}, 1e-6), greatest({_AREA.format("b")}, 1e-6)) / greatest(greatest({_AREA.format("a")}, 1e-6), greatest({_AREA.format("b")}, 1e-6)) AS size,
  sqrt(pow((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2, 2) + pow((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2, 2)) AS moved, greatest(b.x2 - b.x1, b.y2 - b.y1, 1.0) AS side,
  greatest(0.0, greatest(a.x1, b.x1) - least(a.x2, b.x2)) AS across, greatest(0.0, greatest(a.y1, b.y1) - least(a.y2, b.y2)) AS down
  FROM bx a JOIN prev ON prev.id = a.image_id JOIN bx b ON b.image_id = prev.prev_id AND b.label = a.label),
al AS (SELECT *, CASE WHEN far <= 0.01 THEN round(greatest(0.0, 1 - far / 0.01) * 0.8 + size * 0.2, 6) END AS score FROM ap)"""
# candidates (image_id, k, left_id, right_id, score) matched stage by stage: one fold in the order of stage and score
_STAGED = """sg AS (SELECT image_id, list({'l': left_id, 'r': right_id, 's': score, 'k': k} ORDER BY k, score DESC, left_id, right_id) AS c FROM cands GROUP BY image_id),
sm AS (SELECT image_id, unnest(list_reduce(list_transform(c, lambda x: [x]), lambda acc, x:
  CASE WHEN len(list_filter(acc, lambda q: q.l = x[1].l OR q.r = x[1].r)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS m FROM sg)"""
# both sides of each pair of frames, with the extent of the other frame
_SIDES = f"""fp AS (SELECT prev.id AS pair_id, prev_id, c.lat_min AS cs, c.lat_max AS cn, c.lon_min AS cw, c.lon_max AS ce, p.capture_time AS pt, p.lat_min AS ps, p.lat_max AS pn, p.lon_min AS pw, p.lon_max AS pe
  FROM prev JOIN fr c ON c.id = prev.id JOIN fr p ON p.id = prev_id),
cu AS (SELECT pair_id, ob.id, lower(coalesce(trim(object_class, ' '), '')) AS label, lat, lon, ps AS s, pn AS n, pw AS w, pe AS e FROM ob JOIN fp ON image_id = pair_id),
ol AS (SELECT pair_id, ob.id, lower(coalesce(trim(object_class, ' '), '')) AS label, lat, lon, cs AS s, cn AS n, cw AS w, ce AS e FROM ob JOIN fp ON image_id = prev_id WHERE coalesce(detection_time, pt) <= pt + INTERVAL 120 SECOND),
fx AS (SELECT cu.pair_id AS image_id, 0 AS k, cu.id AS left_id, ol.id AS right_id, -sqrt(pow(cu.lat - ol.lat, 2) + pow(cu.lon - ol.lon, 2)) AS score FROM cu JOIN ol ON cu.pair_id = ol.pair_id AND cu.label = ol.label
  WHERE cu.label IN {_FIXED} AND sqrt(pow(cu.lat - ol.lat, 2) + pow(cu.lon - ol.lon, 2)) <= 0.001 AND cu.s IS NOT NULL AND cu.n IS NOT NULL AND cu.w IS NOT NULL AND cu.e IS NOT NULL
  AND ol.s IS NOT NULL AND ol.n IS NOT NULL AND ol.w IS NOT NULL AND ol.e IS NOT NULL)"""
_LINKS = """li AS (SELECT image_id AS pair_id, m.l AS current_id, m.r AS past_id, 'matched' AS status, CASE WHEN m.k = 0 THEN 1.0 ELSE m.s END AS score FROM sm
  UNION ALL SELECT pair_id, id, NULL, CASE WHEN coalesce(lat BETWEEN s AND n AND lon BETWEEN w AND e, true) THEN 'new' ELSE 'past_not_included' END, NULL FROM cu WHERE NOT EXISTS (SELECT 1 FROM sm WHERE sm.image_id = cu.pair_id AND sm.m.l = cu.id)
  UNION ALL SELECT pair_id, NULL, id, CASE WHEN coalesce(lat BETWEEN s AND n AND lon BETWEEN w AND e, true) THEN 'disappeared' ELSE 'current_not_included' END, NULL FROM ol WHERE NOT EXISTS (SELECT 1 FROM sm WHERE sm.image_id = ol.pair_id AND sm.m.r = ol.id))"""
_SCORED = f"""WITH {_ALL}, {_SIDES}, cands AS (SELECT * FROM fx UNION ALL SELECT image_id, 1, left_id, right_id, score FROM al WHERE score > 0.5 AND right_id IN (SELECT id FROM ol)), {_STAGED}, {_LINKS}"""
_THREE = """SELECT image_id, {0} AS k, left_id, right_id, iou AS score FROM al WHERE iou > 0.25 {3} UNION ALL SELECT image_id, {1}, left_id, right_id, -moved FROM al WHERE moved < 2 * side {3}
  UNION ALL SELECT image_id, {2}, left_id, right_id, score FROM al WHERE score IS NOT NULL {3}"""


def _merged(joins: str, together: str) -> str:
    """Boxes of a label merged by sweeps until none is left: a fold per sweep, repeated by recursion.

    ``joins`` tests a kept box q and the box x[1]; ``together`` is what q becomes.
    """
    first = f"list_position(list_transform(acc, lambda q: {joins}), true)"
    sweep = f"""list_reduce(list_transform(c, lambda x: [x]), lambda acc, x: CASE WHEN coalesce({first}, 0) = 0 THEN list_concat(acc, x)
      ELSE list_concat(list_concat(acc[1:{first} - 1], list_transform(acc[{first}:{first}], lambda q: {together})), acc[{first} + 1:]) END)"""
    return f"""WITH RECURSIVE {_OB}, b AS (SELECT image_id AS frame_id, lower(coalesce(lower(trim(object_class, ' ')), '')) AS label, list({{'i': id, 's': confidence, 'x1': bbox_x1, 'y1': bbox_y1, 'x2': bbox_x2, 'y2': bbox_y2}} ORDER BY confidence DESC, id) AS c
        FROM ob WHERE image_id IS NOT NULL AND confidence IS NOT NULL AND bbox_x1 IS NOT NULL AND bbox_y1 IS NOT NULL AND bbox_x2 IS NOT NULL AND bbox_y2 IS NOT NULL GROUP BY 1, 2),
      r AS (SELECT frame_id, label, c, 0 AS before FROM b UNION ALL SELECT frame_id, label, {sweep}, len(c) FROM r WHERE before <> len(c)),
      z AS (SELECT frame_id, label, unnest(c) AS k FROM r WHERE before = len(c))"""


_QX = "(greatest(least(q.x2, x[1].x2) - greatest(q.x1, x[1].x1), 0.0) * greatest(least(q.y2, x[1].y2) - greatest(q.y1, x[1].y1), 0.0))"
_QA, _XA = "((q.x2 - q.x1) * (q.y2 - q.y1))", "((x[1].x2 - x[1].x1) * (x[1].y2 - x[1].y1))"
_LARGER = ", ".join(f"'{c}': CASE WHEN {_QA} >= {_XA} THEN q.{c} ELSE x[1].{c} END" for c in ("x1", "y1", "x2", "y2"))
_CONTAINED = _merged(f"{_QX} > 0 AND {_QX} / (least({_QA}, {_XA}) + 1e-6) >= 0.99", f"{{'i': q.i, 's': greatest(q.s, x[1].s), {_LARGER}}}")
_ADJACENT = _merged(
    "greatest(0.0, greatest(q.x1, x[1].x1) - least(q.x2, x[1].x2)) <= 5 AND greatest(0.0, greatest(q.y1, x[1].y1) - least(q.y2, x[1].y2)) <= 5",
    "{'i': q.i, 's': greatest(q.s, x[1].s), 'x1': least(q.x1, x[1].x1), 'y1': least(q.y1, x[1].y1), 'x2': greatest(q.x2, x[1].x2), 'y2': greatest(q.y2, x[1].y2)}",
)
# greedy one-to-one matching as a fold over the candidates of a frame in order
_GREEDY = """g AS (SELECT image_id, list({'l': left_id, 'r': right_id, 's': score} ORDER BY score DESC, left_id, right_id) AS c FROM pairs WHERE score > 0.5 GROUP BY image_id),
m AS (SELECT unnest(list_reduce(list_transform(c, lambda x: [x]), lambda acc, x:
  CASE WHEN len(list_filter(acc, lambda k: k.l = x[1].l OR k.r = x[1].r)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k FROM g)"""
_TILE = "unnest(list_distinct(list_transform(range(0, greatest({0}, 1), 192), lambda s: greatest(least(s, {0} - 256), 0))))"
_COMP = """WITH RECURSIVE e AS (SELECT DISTINCT source_id AS a, target_id AS b FROM graph_relations WHERE source_id IS NOT NULL AND target_id IS NOT NULL),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e),
reach AS (SELECT a AS node, a AS root FROM (SELECT DISTINCT a FROM u)
  UNION SELECT u.b, reach.root FROM reach JOIN u ON u.a = reach.node),
comp AS (SELECT node, min(root) AS component FROM reach GROUP BY node)"""
_GEO = """ent AS (SELECT id, entity_type, observation_count, CAST(json_extract_string(properties, '$.lat') AS DOUBLE) AS lat,
  CAST(json_extract_string(properties, '$.lon') AS DOUBLE) AS lon FROM graph_entities)"""

ORACLE = {
    "row_counts": "SELECT 'image_records' AS table_name, count(*) AS n_rows FROM image_records UNION ALL SELECT 'detection_records', count(*) FROM detection_records UNION ALL SELECT 'pairing_records', count(*) FROM pairing_records",
    "filter_optional": "SELECT id, ingestion_time, sensor_platform FROM image_records WHERE source_type = 'satellite' AND sensor_platform ILIKE '%orbit%' AND lat_center BETWEEN -30 AND 60 AND session_id IS NOT NULL",
    "filter_in_or_null": "SELECT id, pairing_time, status FROM pairing_records WHERE lower(trim(status)) IN ('new', 'moved') AND (current_capture_time IS NOT NULL OR past_capture_time IS NOT NULL)",
    "not_synthetic": "SELECT id, ingestion_time, source_type FROM detection_records WHERE coalesce(source_type, '') <> 'synthetic'",
    "quality_filter": f"""WITH {_FR} SELECT o.id, o.ingestion_time FROM detection_records o JOIN fr ON fr.id = o.image_id
      WHERE bbox_x2 - bbox_x1 >= 4 AND bbox_y2 - bbox_y1 >= 4 AND (bbox_x2 - bbox_x1) * (bbox_y2 - bbox_y1) <=
      CASE WHEN lower(trim(object_class, ' ')) IN {_FIXED} THEN 0.7 ELSE 0.15 END * det_width * det_height""",
    "point_in_extent": f"""WITH {_FR}, {_OB} SELECT ob.id, coalesce(ob.lat BETWEEN lat_min AND lat_max AND ob.lon BETWEEN lon_min AND lon_max, true) AS inside,
      lat_min IS NOT NULL AND lat_max IS NOT NULL AND lon_min IS NOT NULL AND lon_max IS NOT NULL AS bounds_known FROM ob JOIN fr ON fr.id = ob.image_id""",
    "shaped_links": f"""WITH {_LK} SELECT id, left(id, 8) AS short_id, floor(current_confidence * 100 + 0.5) / 100 AS conf, strftime(pairing_time, '%Y-%m-%d %H:%M:%S') AS time_text,
      CAST(json_extract(current_bbox, '$.x1') AS DOUBLE) AS x1, CAST(json_extract(current_bbox, '$.y2') AS DOUBLE) AS y2,
      CASE lower(trim(status)) WHEN 'matched' THEN 'M' WHEN 'changed' THEN 'C' WHEN 'moved' THEN 'V' WHEN 'new' THEN 'N' WHEN 'disappeared' THEN 'D' WHEN 'past_not_included' THEN 'P' ELSE 'X' END AS prefix FROM lk""",
    "running_labels": f"""WITH {_LK}, x AS (SELECT id, session_id, coalesce(lower(trim(status)), 'unknown') AS st, pairing_time FROM lk)
      SELECT id, upper(left(st, 1)) || row_number() OVER (PARTITION BY session_id, st ORDER BY pairing_time, id) AS label FROM x WHERE session_id IS NOT NULL""",
    "json_props": "SELECT id, round(coalesce(CAST(json_extract_string(properties, '$.lat') AS DOUBLE), 0.0), 4) AS lat, round(coalesce(CAST(json_extract_string(properties, '$.lon') AS DOUBLE), 0.0), 4) AS lon FROM graph_entities",
    "meta_parse": """WITH x AS (SELECT DISTINCT * FROM image_meta),
      p AS (SELECT coalesce(source_type, 'satellite') AS source_type, image_file, lat_center, lon_center,
        try_cast(CASE WHEN regexp_full_match(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}( [0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?)?') THEN t END AS TIMESTAMP) AS captured_at
        FROM (SELECT *, replace(regexp_replace(trim(capture_time, ' '), '(Z|[+-][0-9]{2}:?[0-9]{2})$', ''), 'T', ' ') AS t FROM x))
      SELECT source_type, image_file IS NOT NULL AND lat_center IS NOT NULL AND lon_center IS NOT NULL AND captured_at IS NOT NULL AS valid, count(*) AS n, max(captured_at) AS latest FROM p GROUP BY 1, 2""",
    "file_groups": """WITH f AS (SELECT DISTINCT replace(regexp_replace(image_path, '^frames/', '') || '_' || coalesce(source_type, 'none'), '/', '_') AS name FROM image_records WHERE image_path IS NOT NULL)
      SELECT array_to_string(string_split(name, '_')[1:2], '_') AS stem, count(*) AS n_files FROM f GROUP BY 1 HAVING count(*) >= 2""",
    "pixel_to_geo": f"""WITH {_FR}, {_OB}, j AS (SELECT ob.id, lat_max - (bbox_y1 + bbox_y2) / 2 / nullif(det_height, 0) * (lat_max - lat_min) AS la,
      lon_min + (bbox_x1 + bbox_x2) / 2 / nullif(det_width, 0) * (lon_max - lon_min) AS lo, lat_center, lon_center FROM ob JOIN fr ON fr.id = ob.image_id)
      SELECT id, floor(CASE WHEN la IS NOT NULL AND lo IS NOT NULL THEN la ELSE lat_center END * 100000 + 0.5) / 100000 AS lat_px, floor(CASE WHEN la IS NOT NULL AND lo IS NOT NULL THEN lo ELSE lon_center END * 100000 + 0.5) / 100000 AS lon_px FROM j""",
    "geo_to_pixels": f"""WITH {_FR}, {_OB}, j AS (SELECT ob.id, det_width AS w, det_height AS h,
      greatest(trunc((ob.lon - 0.0005 - lon_min) / (lon_max - lon_min) * det_width)::INT - 4, 0) AS x1, least(trunc((ob.lon + 0.0005 - lon_min) / (lon_max - lon_min) * det_width)::INT + 4, det_width) AS x2,
      greatest(trunc((lat_max - (ob.lat + 0.0005)) / (lat_max - lat_min) * det_height)::INT - 4, 0) AS y1, least(trunc((lat_max - (ob.lat - 0.0005)) / (lat_max - lat_min) * det_height)::INT + 4, det_height) AS y2
      FROM ob JOIN fr ON fr.id = ob.image_id WHERE lon_min < lon_max AND lat_min < lat_max AND ob.lat BETWEEN lat_min AND lat_max AND ob.lon BETWEEN lon_min AND lon_max)
      SELECT id, x1, y1, x2, y2 FROM j WHERE x2 > x1 AND y2 > y1""",
    "mask_areas": f"""WITH {_OB}, x AS (SELECT id, CAST(json_extract(mask_rle, '$.shape[0]') AS INT) AS height, CAST(json_extract(mask_rle, '$.rle') AS INT[][]) AS r FROM ob WHERE mask_rle IS NOT NULL)
      SELECT id, height, coalesce(list_sum(list_transform(r, lambda p: CASE WHEN p[1] > 0 THEN p[2] ELSE 0 END)), 0)::INT AS area_px FROM x""",
    "frame_tiles": f"""WITH {_FR}, a AS (SELECT id AS frame_id, det_width AS w, det_height AS h, {_TILE.format("det_width")} AS x1 FROM fr WHERE det_width > 0 AND det_height > 0),
      b AS (SELECT *, {_TILE.format("h")} AS y1 FROM a)
      SELECT frame_id, x1, y1, least(x1 + 256, w) AS x2, least(y1 + 256, h) AS y2 FROM b""",
    "suppressed": f"""WITH {_OB}, g AS (SELECT image_id AS frame_id, list({{'i': id, 'x1': bbox_x1, 'y1': bbox_y1, 'x2': bbox_x2, 'y2': bbox_y2}} ORDER BY confidence DESC, id) AS c
        FROM ob WHERE image_id IS NOT NULL AND confidence IS NOT NULL AND bbox_x1 IS NOT NULL AND bbox_y1 IS NOT NULL AND bbox_x2 IS NOT NULL AND bbox_y2 IS NOT NULL GROUP BY 1),
      m AS (SELECT frame_id, unnest(list_reduce(list_transform(c, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda b:
        (greatest(least(x[1].x2, b.x2) - greatest(x[1].x1, b.x1), 0.0) * greatest(least(x[1].y2, b.y2) - greatest(x[1].y1, b.y1), 0.0)) /
          ((x[1].x2 - x[1].x1) * (x[1].y2 - x[1].y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(least(x[1].x2, b.x2) - greatest(x[1].x1, b.x1), 0.0) * greatest(least(x[1].y2, b.y2) - greatest(x[1].y1, b.y1), 0.0) + 1e-6) > 0.3
        OR (greatest(least(x[1].x2, b.x2) - greatest(x[1].x1, b.x1), 0.0) * greatest(least(x[1].y2, b.y2) - greatest(x[1].y1, b.y1), 0.0)) /
          (least((x[1].x2 - x[1].x1) * (x[1].y2 - x[1].y1), (b.x2 - b.x1) * (b.y2 - b.y1)) + 1e-6) > 0.5)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k FROM g)
      SELECT frame_id, k.i AS box_id FROM m""",
    "frame_counts": f"""WITH {_FR} SELECT fr.id AS image_id, count(DISTINCT d.id) AS n_observations FROM fr LEFT JOIN detection_records d ON d.image_id = fr.id AND d.source_type <> 'synthetic' GROUP BY 1""",
    "semi_frames": f"""WITH {_FR} SELECT id, session_id FROM fr WHERE id IN (SELECT image_id FROM detection_records WHERE lower(trim(object_class, ' ')) LIKE '%crane%')""",
    "anti_unlinked": """SELECT DISTINCT id FROM detection_records d WHERE NOT EXISTS (SELECT 1 FROM pairing_records p WHERE p.current_detection_id = d.id) AND NOT EXISTS (SELECT 1 FROM pairing_records p WHERE p.past_detection_id = d.id)""",
    "batches_before": f"""WITH {_FR}, f AS (SELECT * FROM fr WHERE capture_time IS NOT NULL AND lat_center IS NOT NULL AND lon_center IS NOT NULL AND NOT (lat_center = 0 AND lon_center = 0)),
      j AS (SELECT a.id, b.id AS prev_id, coalesce(a.session_id = b.session_id, false) AS own, row_number() OVER (PARTITION BY a.id ORDER BY coalesce(a.session_id = b.session_id, false) DESC, b.capture_time DESC, b.id DESC) AS k
        FROM f a JOIN f b ON b.capture_time < a.capture_time AND b.lat_center BETWEEN a.lat_center - 0.02 AND a.lat_center + 0.02 AND b.lon_center BETWEEN a.lon_center - 0.02 AND a.lon_center + 0.02)
      SELECT id, prev_id, own AS own_session FROM j WHERE k = 1""",
    "latest_observations_near": f"""WITH {_FR}, {_OB}, {_PL}, n AS (SELECT site_id, ob.id, fr.capture_time AS t FROM ob JOIN fr ON fr.id = ob.image_id JOIN pl ON {_near(0.05, "ob.lat", "ob.lon")}
        WHERE ob.detection_time < TIMESTAMP '2024-10-01 00:00:00'), m AS (SELECT site_id, max(t) AS t FROM n GROUP BY 1)
      SELECT n.site_id, n.id FROM n JOIN m ON m.site_id = n.site_id AND m.t = n.t""",
    "latest_frame_near": f"""WITH {_FR}, {_PL} SELECT site_id, max({{'t': capture_time, 'i': id}}).i AS image_id FROM fr JOIN pl ON {_near(0.05, "lat_center", "lon_center")} WHERE capture_time IS NOT NULL GROUP BY 1""",
    "previous_frame": f"WITH {_FR}, {_PREV} SELECT * FROM prev",
    "has_earlier_frame": f"""WITH {_FR} SELECT id FROM fr a WHERE EXISTS (SELECT 1 FROM fr b WHERE b.session_id = a.session_id AND b.capture_time < a.capture_time)""",
    "link_batch_before": f"""WITH {_FR}, {_LK}, x AS (SELECT fr.id, epoch_us(fr.ingestion_time) AS t_us, max(epoch_us(lk.pairing_time)) AS b FROM fr JOIN lk ON lk.session_id = fr.session_id AND lk.pairing_time <= fr.ingestion_time GROUP BY ALL)
      SELECT id, b AS batch_us, b >= t_us - 1800000000 AS within FROM x""",
    "within_tolerance": f"""WITH {_FR}, {_LK} SELECT lk.id, count(*) AS n_frames FROM lk JOIN fr ON fr.session_id = lk.session_id AND fr.capture_time BETWEEN lk.current_capture_time - INTERVAL 30 SECOND AND lk.current_capture_time + INTERVAL 30 SECOND GROUP BY 1""",
    "sites_near_frames": f"""WITH {_FR}, {_PL}, j AS (SELECT id AS image_id, site_id, sqrt(pow(lat_center - q_lat, 2) + pow(lon_center - q_lon, 2)) AS g FROM fr JOIN pl ON {_near(0.05, "lat_center", "lon_center")})
      SELECT image_id, site_id, round(g, 6) AS distance FROM j WHERE g <= 0.05""",
    "scored_pairs": f"WITH {_PAIRS} SELECT left_id, right_id, score FROM pairs WHERE score > 0.5",
    "best_iou": f"WITH {_ALL} SELECT right_id, max({{'s': iou, 'l': left_id}}).l AS left_id, max(iou) AS iou FROM al WHERE iou >= 0.1 GROUP BY right_id",
    "box_gaps": f"WITH {_ALL} SELECT left_id AS id, right_id AS past_id, round(across, 3) AS across, round(down, 3) AS down FROM al WHERE round(across, 3) <= 20 AND round(down, 3) <= 20",
    "staged_pairs": f"WITH {_ALL}, cands AS ({_THREE.format(0, 1, 2, '')}), {_STAGED} SELECT m.l AS left_id, m.r AS right_id, CAST(m.k AS INT) AS stage FROM sm",
    "linked_frames": f"{_SCORED} SELECT * FROM li",
    "tracked_links": f"WITH {_ALL}, {_SIDES}, cands AS (SELECT * FROM fx UNION ALL {_THREE.format(1, 2, 3, f'AND label NOT IN {_FIXED} AND right_id IN (SELECT id FROM ol)')}), {_STAGED}, {_LINKS} SELECT * FROM li",
    "cross_checked": f"""{_SCORED}, x AS (SELECT li.*, ob.confidence AS c, status IN ('new', 'disappeared') AND coalesce(ob.confidence >= 0.8, false) AS synthetic, coalesce(current_id, past_id) AS o FROM li LEFT JOIN ob ON ob.id = coalesce(current_id, past_id))
      SELECT pair_id, CASE WHEN synthetic THEN coalesce(current_id, 'synthetic-' || left(sha256(pair_id || '|' || o), 16)) ELSE current_id END AS current_id, CASE WHEN synthetic THEN coalesce(past_id, 'synthetic-' || left(sha256(pair_id || '|' || o), 16)) ELSE past_id END AS past_id,
        CASE WHEN synthetic THEN 'matched' ELSE status END AS status, CASE WHEN synthetic THEN c ELSE score END AS score, synthetic FROM x""",
    "contained_merged": f"{_CONTAINED} SELECT frame_id, k.i AS box_id, label, k.s AS score FROM z",
    "adjacent_merged": f"{_ADJACENT} SELECT frame_id, k.i AS box_id, label, k.s AS score, k.x1 AS x1, k.x2 AS x2 FROM z",
    "one_to_one": f"WITH {_PAIRS}, {_GREEDY} SELECT k.l AS left_id, k.r AS right_id, k.s AS score FROM m",
    "one_to_one_rounds": f"WITH {_PAIRS}, {_GREEDY} SELECT k.l AS left_id, k.r AS right_id, k.s AS score FROM m",
    "best_links": f"""WITH {_LK}, x AS (SELECT id, nullif(trim(current_detection_id), '') AS c, nullif(trim(past_detection_id), '') AS p,
        coalesce(list_position(['matched', 'changed', 'moved', 'new', 'disappeared', 'past_not_included'], lower(trim(status))) - 1, 9) AS prio FROM lk),
      y AS (SELECT *, CASE WHEN c IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY c ORDER BY prio, id) END AS kc, CASE WHEN p IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY p ORDER BY prio, id) END AS kp FROM x)
      SELECT id FROM y WHERE kc = 1 AND kp = 1""",
    "change_status": f"""WITH {_LK}, l AS (SELECT {_PLACE} AS place, {_SLUG} AS slug, coalesce(current_capture_time, past_capture_time, pairing_time) AS t FROM lk),
      b AS (SELECT DISTINCT place, slug FROM l WHERE t < TIMESTAMP '2024-09-01'), a AS (SELECT DISTINCT place, slug FROM l WHERE t >= TIMESTAMP '2024-09-01')
      SELECT coalesce(a.place, b.place) AS place, coalesce(a.slug, b.slug) AS slug, CASE WHEN a.place IS NOT NULL AND b.place IS NOT NULL THEN 'matched'
        WHEN a.place IS NOT NULL THEN CASE WHEN a.place IN (SELECT place FROM b) THEN 'new' ELSE 'past_not_included' END
        ELSE CASE WHEN b.place IN (SELECT place FROM a) THEN 'disappeared' ELSE 'current_not_included' END END AS status
      FROM a FULL OUTER JOIN b ON a.place = b.place AND a.slug = b.slug""",
    "lineage": f"""WITH {_FR}, {_OB}, {_LK} SELECT lk.id, fr.image_path FROM lk LEFT JOIN ob c ON c.id = lk.current_detection_id LEFT JOIN ob p ON p.id = lk.past_detection_id
      JOIN fr ON fr.id = coalesce(c.image_id, p.image_id)""",
    "sessions_near": f"""WITH {_LK}, {_PL}, nw AS (SELECT session_id, max(pairing_time) AS t FROM lk GROUP BY 1),
      s AS (SELECT site_id, max({{'t': nw.t, 's': nw.session_id}}) AS b FROM lk JOIN pl ON {_near(0.05, "lat_center", "lon_center")} JOIN nw ON nw.session_id = lk.session_id GROUP BY 1)
      SELECT pl.site_id, CASE WHEN b IS NOT NULL THEN b.s ELSE (SELECT max({{'t': t, 's': session_id}}).s FROM nw) END AS session_id, b IS NOT NULL AS near FROM pl LEFT JOIN s ON s.site_id = pl.site_id""",
    "class_summary": "SELECT lower(trim(object_class, ' ')) AS label, count(*) AS n, round(avg(confidence), 4) AS avg_conf, min(confidence) AS min_conf, max(confidence) AS max_conf FROM detection_records GROUP BY 1",
    "status_counts": f"WITH {_LK} SELECT session_id, count(*) AS n_links, "
    + ", ".join(f"count(*) FILTER (lower(trim(status)) = '{s}') AS n_{s}" for s in _STATUSES)
    + " FROM lk GROUP BY 1",
    "session_summary": f"""WITH {_LK}, l AS (SELECT session_id, round(avg(lat_center), 4) AS lat, round(avg(lon_center), 4) AS lon, min(past_capture_time) AS first_past, max(current_capture_time) AS last_current FROM lk GROUP BY 1),
      e AS (SELECT session_id, min(lat_min) AS south, max(lat_max) AS north, min(lon_min) AS west, max(lon_max) AS east FROM image_records GROUP BY 1)
      SELECT l.*, south, north, west, east FROM l LEFT JOIN e ON e.session_id = l.session_id""",
    "common_classes": f"""WITH {_LK}, n AS (SELECT session_id, lower(trim(coalesce(current_object_class, past_object_class), ' ')) AS label, count(*) AS n FROM lk WHERE coalesce(current_object_class, past_object_class) IS NOT NULL GROUP BY 1, 2),
      t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, label) AS k FROM n)
      SELECT session_id, string_agg(label || ' x' || n, ', ' ORDER BY k) AS classes FROM t WHERE k <= 5 GROUP BY 1""",
    "top_with_rest": f"""WITH {_LK}, r AS (SELECT session_id, current_confidence AS c, row_number() OVER (PARTITION BY session_id ORDER BY current_confidence DESC, id) AS k FROM lk WHERE current_confidence IS NOT NULL AND session_id IS NOT NULL)
      SELECT session_id, max(c) AS best, count(*) FILTER (k <= 20) AS k, count(*) FILTER (k > 20) AS n_rest, coalesce(floor(sum(CAST(round(c * 1000) AS BIGINT)) FILTER (k > 20) * 10 / count(*) FILTER (k > 20) + 0.5) / 10000, 0.0) AS mean_rest FROM r GROUP BY 1""",
    "latest_link_batch": f"WITH {_LK} SELECT id FROM lk JOIN (SELECT session_id AS s, max(pairing_time) AS t FROM lk GROUP BY 1) ON s = session_id AND t = pairing_time",
    "entity_rollup": f"WITH {_LK}, {_LOC}, s AS (SELECT 'loc:' || place AS entity_id, session_id, max(seen_at) AS t FROM loc GROUP BY 1, 2), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY t DESC NULLS LAST, session_id) AS k FROM s WHERE session_id IS NOT NULL), "
    "r AS (SELECT entity_id, string_agg(session_id, ',' ORDER BY k) AS last_sessions FROM k WHERE k <= 10 GROUP BY 1), "
    "a AS (SELECT 'loc:' || place AS entity_id, count(*) AS observation_count, round(sum(conf), 4) AS confidence_sum, min(seen_at) AS first_seen, max(seen_at) AS last_seen, count(DISTINCT session_id) AS n_sessions, "
    + ", ".join(f"count(*) FILTER (st = '{s}') AS n_{s}" for s in _STATUSES)
    + " FROM loc GROUP BY 1) SELECT a.*, last_sessions FROM a LEFT JOIN r ON r.entity_id = a.entity_id",
    "relation_rollup": """WITH r AS (SELECT id, any_value(source_id) AS s, any_value(relation_type) AS k, any_value(properties) AS p FROM graph_relations GROUP BY id)
      SELECT replace(replace(lower(trim(k)), ' ', '_'), '-', '_') AS kind, count(*) AS n_relations, CAST(sum(coalesce(CAST(json_extract_string(p, '$.count') AS BIGINT), 0)) AS BIGINT) AS total, count(DISTINCT s) AS n_sources FROM r GROUP BY 1""",
    "cooccurrence": f"""WITH {_LK}, {_LOC}, d AS (SELECT DISTINCT session_id, place, slug FROM loc WHERE session_id IS NOT NULL)
      SELECT a.place, a.slug AS slug_a, b.slug AS slug_b, count(*) AS n_sessions FROM d a JOIN d b ON a.session_id = b.session_id AND a.place = b.place AND a.slug < b.slug GROUP BY ALL HAVING count(*) >= 2""",
    "graph_edges": """WITH r AS (SELECT id, any_value(source_id) AS s, any_value(target_id) AS t, any_value(properties) AS p FROM graph_relations GROUP BY id)
      SELECT least(s, t) AS a, greatest(s, t) AS b, CAST(sum(coalesce(CAST(json_extract_string(p, '$.count') AS BIGINT), 0)) AS BIGINT) AS weight FROM r WHERE s <> t GROUP BY 1, 2""",
    "components": _COMP + " SELECT * FROM comp",
    "communities": _COMP
    + """ SELECT component, count(*) AS n_members, count(*) FILTER (entity_type = 'asset') AS n_assets, count(*) FILTER (entity_type = 'location') AS n_locations,
      CAST(sum(observation_count) AS BIGINT) AS n_observations FROM comp LEFT JOIN graph_entities g ON g.id = comp.node GROUP BY 1""",
    "local_search": f"""WITH {_GEO}, {_PL} SELECT site_id, count(*) AS n_entities, count(*) FILTER (entity_type = 'asset') AS n_assets, CAST(coalesce(sum(observation_count), 0) AS BIGINT) AS n_observations
      FROM ent JOIN pl ON {_near(0.05)} GROUP BY 1""",
    "global_search": _COMP
    + f""", {_GEO}, {_PL}, loc AS (SELECT DISTINCT id FROM ent JOIN pl ON {_near(0.05)}), o AS (SELECT component, count(*) AS overlap FROM comp JOIN loc ON loc.id = comp.node GROUP BY 1),
      z AS (SELECT component, count(*) AS n_members FROM comp GROUP BY 1) SELECT o.component, overlap, n_members FROM o JOIN z ON z.component = o.component ORDER BY overlap DESC, n_members DESC, o.component LIMIT 5""",
    "vector_top_k": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e),
      s AS (SELECT q.vec_id AS query_id, n.vec_id, round(list_dot_product(q.v, n.v), 6) AS s FROM n q JOIN n ON n.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS k FROM s) SELECT query_id, vec_id, round(s, 4) AS score FROM r WHERE k <= 5""",
    "dml_partial_update": f"WITH {_FR} SELECT id, coalesce(lat_min, -1.0) AS lat_min, lat_max, source_type FROM fr",
    "dml_delete": "SELECT id, ingestion_time, object_class, source_type FROM detection_records WHERE source_type IS DISTINCT FROM 'synthetic'",
    "dml_replace": f"""WITH {_OB}, n AS (SELECT 'edit-' || edit_id AS obs_id, any_value(image_id) AS image_id, any_value(object_class) AS object_class, least(greatest(any_value(confidence), 0.0), 1.0) AS confidence FROM detection_in GROUP BY edit_id)
      SELECT id AS obs_id, image_id, object_class, confidence FROM ob WHERE image_id IS NULL OR image_id NOT IN (SELECT image_id FROM n WHERE image_id IS NOT NULL)
      UNION ALL SELECT * FROM n WHERE image_id IS NOT NULL""",
    "dml_remap": f"""WITH {_OB}, {_LK}, e AS (SELECT image_id, 'edit-' || min(edit_id) AS new_id FROM detection_in WHERE image_id IS NOT NULL GROUP BY 1),
      m AS (SELECT ob.id AS old_id, new_id FROM ob JOIN e ON e.image_id = ob.image_id)
      SELECT lk.id, coalesce(a.new_id, current_detection_id) AS current_detection_id, coalesce(b.new_id, past_detection_id) AS past_detection_id
      FROM lk LEFT JOIN m a ON a.old_id = current_detection_id LEFT JOIN m b ON b.old_id = past_detection_id""",
    "dml_merge": f"""WITH {_LK}, {_LOC}, u AS (SELECT id, coalesce(observation_count, 0) AS n, first_seen, last_seen FROM graph_entities WHERE entity_type = 'location'
      UNION ALL SELECT 'loc:' || place, count(*), min(seen_at), max(seen_at) FROM loc GROUP BY 1)
      SELECT id, CAST(sum(n) AS BIGINT) AS n, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM u GROUP BY 1""",
    "stream_tumbling": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2",
    "stream_sliding": """WITH b AS (SELECT time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') AS h, event_type FROM events), s AS (SELECT h AS start, event_type FROM b UNION ALL SELECT h - INTERVAL 12 HOUR, event_type FROM b)
      SELECT start, event_type, count(*) AS n FROM s GROUP BY 1, 2""",
    "stream_sessions": """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      y AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x)
      SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM y GROUP BY user_id, s""",
    "stream_first_deliveries": "SELECT DISTINCT event_id, event_type FROM events",
    "stream_follow_ups": """SELECT x.user_id, x.event_id AS first_id, x.event_type AS first_type, y.event_id AS second_id, y.event_type AS second_type
      FROM events x JOIN events y ON x.user_id = y.user_id AND y.ts BETWEEN x.ts AND x.ts + INTERVAL 10 MINUTE WHERE x.event_type <> y.event_type""",
    "stream_counts": "SELECT event_type, count(*) AS n, max(ts) AS latest FROM events GROUP BY 1",
    # a fold over the values of a user in order: the last value that counted, and how often it moved
    "stream_value_changes": """WITH u AS (SELECT user_id, list({'last': value, 'n': 0} ORDER BY ts, event_id) FILTER (value IS NOT NULL AND NOT isnan(value)) AS v FROM events GROUP BY 1),
      f AS (SELECT user_id, list_reduce(v, lambda a, x: CASE WHEN abs(x.last - a.last) > 50 THEN {'last': x.last, 'n': a.n + 1} ELSE a END) AS s FROM u)
      SELECT user_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_changes, s.last AS last_value FROM f""",
    "sentence_counts": f"""WITH {_SENTENCES} SELECT doc_id, CAST(len(s) AS INT) AS n_sentences FROM st""",
    "text_chunks": f"""WITH {_SENTENCES},
      c AS (SELECT doc_id, CASE WHEN length(text) <= 512 THEN CASE WHEN len(s) > 0 THEN [text] ELSE [] END WHEN len(s) = 0 THEN [] ELSE
        list_append(f.done, f.now) END AS c FROM (SELECT doc_id, text, s, CASE WHEN len(s) > 0 THEN list_reduce(list_transform(s, lambda x: {{'done': []::VARCHAR[], 'now': x}}), lambda a, x:
          CASE WHEN length(a.now) + 1 + length(x.now) <= 512 THEN {{'done': a.done, 'now': a.now || ' ' || x.now}}
          ELSE {{'done': list_append(a.done, a.now), 'now': trim("right"(a.now, 64) || ' ' || x.now, {_BLANKS})}} END) END AS f FROM st)),
      u AS (SELECT doc_id, unnest(c) AS t, generate_subscripts(c, 1) - 1 AS n FROM c)
      SELECT doc_id, CAST(n AS INT) AS chunk_no, CAST(length(t) AS INT) AS n_chars, CASE WHEN length(t) > 40 THEN regexp_replace("left"(t, 40), ' [^ ]*$', '') || '...' ELSE t END AS start FROM u""",
}
