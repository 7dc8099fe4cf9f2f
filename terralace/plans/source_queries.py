"""Queries of readers, sinks, changes, masks and small functions; files are made from the tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralace.functions import geometry as G
from terralace.operators import boxes as B
from terralace.operators import dml
from terralace.operators.models import apply_model
from terralace.plans.reference_queries import boxes, frames, links, observations
from terralace.sources import readers
from terralace.sources.tables import cut_folder, first_arrivals, table


def metadata_scan(spark: SparkSession, d: str) -> DataFrame:
    """Sidecar entries as JSON arrays, one file for each source type, scanned with defaults and validity."""
    entries = table(spark, d, "image_meta").distinct()
    kept = [c for c in entries.columns if c != "meta_id"]
    whole = F.to_json(F.struct("meta_id", *kept), {"ignoreNullFields": "false"})
    # the sidecar of a folder is one array; 64 of them here
    files = entries.select(F.pmod(F.xxhash64("meta_id"), F.lit(64)).alias("part"), whole.alias("entry"))
    files = files.groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("entry"), ","), F.lit("]")).alias("value"))
    path = cut_folder(spark, "sidecars")
    files.write.partitionBy("part").text(path)
    got = readers.read_metadata(spark, path)
    return got.select(F.col("extra")["meta_id"].alias("meta_id"), "image_file", "captured_at", "source_type", "lat_center", "valid")


def _texts(spark: SparkSession, d: str) -> str:
    path = cut_folder(spark, "texts")
    table(spark, d, "subject_areas").select("subject", F.col("description").alias("value")).write.partitionBy("subject").text(path)
    return path


def text_scan(spark: SparkSession, d: str) -> DataFrame:
    got = readers.read_texts(spark, _texts(spark, d))
    return got.select(F.regexp_extract("source", "subject=([^/]+)/", 1).alias("subject"), F.rtrim(F.translate("text", "\n", " ")).alias("text"))


def image_scan(spark: SparkSession, d: str) -> DataFrame:
    got = readers.read_images(spark, _texts(spark, d), "*.txt")
    return got.select(F.regexp_extract("path", "subject=([^/]+)/", 1).alias("subject"), F.length("content").alias("n_bytes"))


def image_times(spark: SparkSession, d: str) -> DataFrame:
    f = first_arrivals(table(spark, d, "image_records"), "id", "ingestion_time", ["capture_time", "lat_min"])
    xml = F.concat(F.lit("<m:CaptureTime> "), F.date_format("capture_time", "yyyy-MM-dd HH:mm:ss"), F.lit(" </m:CaptureTime>"))
    tag = F.when(F.col("lat_min").isNotNull(), F.date_format("ingestion_time", "yyyy:MM:dd HH:mm:ss"))
    return f.select("id", readers.image_time(F.coalesce(xml, F.lit("<m/>")), tag, F.col("ingestion_time")).alias("taken_at"))


def annotation_scan(spark: SparkSession, d: str) -> DataFrame:
    """Annotation documents, one for each frame, and the categories in one of their own."""
    labels = table(spark, d, "class_labels").select(F.array(F.struct(F.col("label_id").cast("long").alias("id"), F.col("label").alias("name"))).alias("categories"))
    f = frames(spark, d).select(F.array(F.struct("id", F.col("image_path").alias("file_name"), F.col("det_width").alias("width"), F.col("det_height").alias("height"))).alias("images"))
    o = observations(spark, d).where("image_id IS NOT NULL")
    names = table(spark, d, "class_labels").select(F.col("label_id").cast("long").alias("category_id"), F.col("label").alias("object_class"))
    box = F.array(F.col("bbox_x1"), F.col("bbox_y1"), F.col("bbox_x2") - F.col("bbox_x1"), F.col("bbox_y2") - F.col("bbox_y1"))
    # the list of classes is fixed; a frame bounds its annotations
    marked = o.join(F.broadcast(names), "object_class").groupBy("image_id").agg(F.collect_list(F.struct("image_id", "category_id", box.alias("bbox"))).alias("annotations"))
    documents = labels.unionByName(f, allowMissingColumns=True).unionByName(marked.select("annotations"), allowMissingColumns=True)
    return readers.coco_boxes(documents)


def vector_store(spark: SparkSession, d: str) -> DataFrame:
    path = cut_folder(spark, "vectors")
    readers.write_vectors(table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), path, "given")
    info = spark.read.json(f"{path}/info").select(F.col("n_chunks"), F.col("width"))
    # one row about the store
    return spark.read.parquet(f"{path}/chunks").groupBy().agg(F.count(F.lit(1)).alias("n_read"), F.sum("chunk_id").alias("ids")).join(info, F.lit(True))


def appended(spark: SparkSession, d: str) -> DataFrame:
    path = cut_folder(spark, "appended")
    for rows in (table(spark, d, "deleted_records"), table(spark, d, "deleted_records").where("reason IS NULL")):
        dml.append(rows, path)
    return spark.read.parquet(path).select("rec_table", "rec_id", "deleted_at")


def partitions_replaced(spark: SparkSession, d: str) -> DataFrame:
    path = cut_folder(spark, "partitioned")
    rows = table(spark, d, "deleted_records").select("rec_id", "deleted_at", "rec_table")
    dml.overwrite_partitions(rows, path, "rec_table")
    dml.overwrite_partitions(rows.where("rec_table = 'image_records'").select(F.upper("rec_id").alias("rec_id"), "deleted_at", "rec_table"), path, "rec_table")
    return spark.read.parquet(path).select("rec_id", "deleted_at", "rec_table")


def allowed_updated(spark: SparkSession, d: str) -> DataFrame:
    return dml.allowed_update(table(spark, d, "stations"), "station_id", "ST-01", {"date_order": "YMD"}, ["date_order"])


def columns_added(spark: SparkSession, d: str) -> DataFrame:
    return dml.add_columns(table(spark, d, "sites").select("site_id", "shape"), {"note": "string", "shape": "string", "rank": "int"})


def lists_merged(spark: SparkSession, d: str) -> DataFrame:
    """Classes seen in each session by either side of its links, as sets that unite."""
    rows = links(spark, d).where("session_id IS NOT NULL")
    seen = lambda c: rows.where(f"{c} IS NOT NULL").groupBy("session_id", F.lower(F.trim(c)).alias("c")).agg(F.count(F.lit(1)).alias("n")).select("session_id", "n", F.array("c").alias("classes"))
    out = dml.merge_counts(seen("current_object_class"), seen("past_object_class"), "session_id", ["n"], lists=["classes"])
    return out.select("session_id", "n", F.array_join("classes", ",").alias("classes"))


def mask_round_trips(spark: SparkSession, d: str) -> DataFrame:
    """Masks decoded and encoded again: the number of runs, and whether the pixels are the same."""
    rows = observations(spark, d).where("mask_rle IS NOT NULL").select("id", G.mask(F.col("mask_rle")).alias("m")).where("m IS NOT NULL")
    rows = rows.withColumn("p", G.mask_pixels(F.col("m"))).withColumn("r", G.mask_runs(F.col("p")))
    again = F.flatten(F.transform("r", lambda x: F.array_repeat(x[0], x[1])))
    return rows.select("id", F.size("p").alias("n_pixels"), (again == F.col("p")).alias("same"))


def mask_boxes(spark: SparkSession, d: str) -> DataFrame:
    rows = observations(spark, d).where("mask_rle IS NOT NULL").select("id", G.mask_box(G.mask(F.col("mask_rle"))).alias("b"))
    return rows.where("b IS NOT NULL").select("id", "b.x1", "b.y1", "b.x2", "b.y2")


def mask_ious(spark: SparkSession, d: str) -> DataFrame:
    """How much of its box a mask fills, as the overlap of two masks; the mean by class."""
    rows = observations(spark, d).where("mask_rle IS NOT NULL").select(F.lower(F.trim("object_class")).alias("label"), G.mask(F.col("mask_rle")).alias("m"))
    rows = rows.withColumn("b", G.mask_box(F.col("m"))).where("b IS NOT NULL")
    iou = G.mask_iou(G.mask_pixels(F.col("m")), G.box_pixels(F.col("b"), F.col("m")["shape"]))
    return rows.groupBy("label").agg(F.round(F.avg(iou), 4).alias("mean_iou"))


def suppressed_iou_only(spark: SparkSession, d: str) -> DataFrame:
    return B.nms(boxes(spark, d), 0.3, None).select("frame_id", "box_id")


def multi_scale_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Two scales (the observations by the parity of their width) as one set."""
    b = boxes(spark, d)
    small = F.col("x2") - F.col("x1") < 40
    return B.multi_scale([b.where(small), b.where(~small)]).select("frame_id", "label", "box_id", "score")


def geo_boxes(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d).select("id", "image_id", *[f"bbox_{c}" for c in ("x1", "y1", "x2", "y2")])
    f = frames(spark, d).select(F.col("id").alias("image_id"), "lat_min", "lat_max", "lon_min", "lon_max", "det_width", "det_height")
    extent = tuple(F.col(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max"))
    box = G.geo_box(G.box("bbox_"), F.col("det_width"), F.col("det_height"), extent)
    five = lambda c: (F.floor(F.col(f"b.{c}") * 100_000 + 0.5) / 100_000).alias(c)
    return o.join(f, "image_id").select("id", box.alias("b")).where("b IS NOT NULL").select("id", *[five(c) for c in ("north", "west", "south", "east")])


def scaled_sizes(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).where("det_width > 0 AND det_height > 0")
    return f.select("id", G.scaled_size(F.col("det_width"), F.col("det_height"), 3840, 2160).alias("s")).select("id", "s.width", "s.height")


def row_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "detection_in").distinct()
    return rows.select("edit_id", G.row_key("edit_id", "image_id", "object_class", "desk").alias("row_key")).distinct()


def metadata_built(spark: SparkSession, d: str) -> DataFrame:
    """Entries of frames in order of time, with bounds about their centre, and those of their western and eastern parts."""
    f = frames(spark, d).where("capture_time IS NOT NULL AND lat_center IS NOT NULL AND lon_center IS NOT NULL").select("id", "image_path", "capture_time", "lat_center", "lon_center")
    parts = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(a).alias("start")) for p, a in (("A", 0.0), ("B", 0.25))])).alias("p")
    return readers.build_metadata(f.select("*", parts).select("*", "p.*"), 0.01, 0.75, "start").select(
        "id", "part", "place", *[(F.floor(F.col(c) * 100_000 + 0.5) / 100_000).alias(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max", "lon_center")]
    )


def model_scores(spark: SparkSession, d: str) -> DataFrame:
    """The surface for models: loaded once for each task, fed Arrow batches. The model here counts letters."""
    rows = table(spark, d, "class_labels").select("label_id", "label")
    load = lambda: lambda batch: batch.str.len().astype("int64")
    return apply_model(rows, "label", "n_letters", "long", load)


QUERIES = {
    f.__name__: f
    for f in (
        metadata_scan, text_scan, image_scan, image_times, annotation_scan, vector_store, appended, partitions_replaced, allowed_updated,
        columns_added, lists_merged, mask_round_trips, mask_boxes, mask_ious, suppressed_iou_only, multi_scale_boxes, geo_boxes, scaled_sizes, row_keys,
        metadata_built, model_scores,
    )
}

_OB = "ob AS (SELECT * FROM detection_records QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingestion_time) = 1)"
_FR = "fr AS (SELECT * FROM image_records QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingestion_time) = 1)"
_LK = "lk AS (SELECT * FROM pairing_records QUALIFY row_number() OVER (PARTITION BY id ORDER BY pairing_time) = 1)"
# runs of a mask with the pixels before each; the first and last pixel that is set, by row and column
_MASK = f"""{_OB}, mk AS (SELECT id, lower(trim(object_class, ' ')) AS label, CAST(json_extract(mask_rle, '$.shape') AS INT[]) AS s, CAST(json_extract(mask_rle, '$.rle') AS INT[][]) AS r FROM ob WHERE mask_rle IS NOT NULL),
ru AS (SELECT id, label, s[2] AS w, unnest(r) AS p, generate_subscripts(r, 1) AS k FROM mk),
pt AS (SELECT *, sum(p[2]) OVER (PARTITION BY id ORDER BY k) - p[2] AS a, sum(p[2]) OVER (PARTITION BY id ORDER BY k) - 1 AS z FROM ru),
bx AS (SELECT id, label, min(a // w) AS y1, max(z // w) AS y2, min(CASE WHEN a // w < z // w THEN 0 ELSE a % w END) AS x1, max(CASE WHEN a // w < z // w THEN w - 1 ELSE z % w END) AS x2, sum(p[2]) AS n
  FROM pt WHERE p[1] > 0 AND p[2] > 0 GROUP BY 1, 2)"""
_PARSED = """p AS (SELECT meta_id, coalesce(source_type, 'satellite') AS source_type, image_file, lat_center, lon_center,
  try_cast(CASE WHEN regexp_full_match(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}( [0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?)?') THEN t END AS TIMESTAMP) AS captured_at
  FROM (SELECT *, replace(regexp_replace(trim(capture_time, ' '), '(Z|[+-][0-9]{2}:?[0-9]{2})$', ''), 'T', ' ') AS t FROM (SELECT DISTINCT * FROM image_meta)))"""

ORACLE = {
    "metadata_scan": f"WITH {_PARSED} SELECT meta_id, image_file, captured_at, source_type, lat_center, image_file IS NOT NULL AND lat_center IS NOT NULL AND lon_center IS NOT NULL AND captured_at IS NOT NULL AS valid FROM p",
    "text_scan": "SELECT subject, description AS text FROM subject_areas",
    "image_scan": "SELECT subject, CAST(strlen(description) + 1 AS INT) AS n_bytes FROM subject_areas",
    "image_times": f"WITH {_FR} SELECT id, coalesce(date_trunc('second', capture_time), CASE WHEN lat_min IS NOT NULL THEN date_trunc('second', ingestion_time) END, ingestion_time) AS taken_at FROM fr",
    "annotation_scan": f"""WITH {_OB}, {_FR} SELECT fr.image_path AS file_name, label, det_width AS width, det_height AS height, bbox_x1 AS x1, bbox_y1 AS y1, bbox_x1 + (bbox_x2 - bbox_x1) AS x2, bbox_y1 + (bbox_y2 - bbox_y1) AS y2
      FROM ob JOIN fr ON fr.id = ob.image_id JOIN class_labels ON label = object_class WHERE bbox_x2 > bbox_x1 AND bbox_y2 > bbox_y1""",
    "vector_store": "SELECT count(*) AS n_read, CAST(sum(vec_id) AS BIGINT) AS ids, count(*) AS n_chunks, CAST(max(len(embedding)) AS BIGINT) AS width FROM embeddings",
    "appended": "SELECT rec_table, rec_id, deleted_at FROM deleted_records UNION ALL SELECT rec_table, rec_id, deleted_at FROM deleted_records WHERE reason IS NULL",
    "partitions_replaced": "SELECT CASE WHEN rec_table = 'image_records' THEN upper(rec_id) ELSE rec_id END AS rec_id, deleted_at, rec_table FROM deleted_records",
    "allowed_updated": "SELECT station_id, time_zone, CASE WHEN station_id = 'ST-01' THEN 'YMD' ELSE date_order END AS date_order FROM stations",
    "columns_added": "SELECT site_id, shape, CAST(NULL AS VARCHAR) AS note, CAST(NULL AS INT) AS rank FROM sites",
    "lists_merged": f"""WITH {_LK}, u AS (SELECT session_id, lower(trim(current_object_class, ' ')) AS c FROM lk WHERE current_object_class IS NOT NULL
      UNION ALL SELECT session_id, lower(trim(past_object_class, ' ')) FROM lk WHERE past_object_class IS NOT NULL)
      SELECT session_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT c)), ',') AS classes FROM u WHERE session_id IS NOT NULL GROUP BY 1""",
    "mask_round_trips": f"WITH {_MASK} SELECT id, CAST(sum(p[2]) AS INT) AS n_pixels, true AS same FROM ru GROUP BY 1",
    "mask_boxes": f"WITH {_MASK} SELECT id, CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1, CAST(x2 AS INT) AS x2, CAST(y2 AS INT) AS y2 FROM bx",
    "mask_ious": f"WITH {_MASK} SELECT label, round(avg(n / ((x2 - x1 + 1) * (y2 - y1 + 1))), 4) AS mean_iou FROM bx GROUP BY 1",
    "geo_boxes": f"""WITH {_OB}, {_FR}, j AS (SELECT ob.id, lat_max - bbox_y1 / det_height * (lat_max - lat_min) AS n, lat_max - bbox_y2 / det_height * (lat_max - lat_min) AS s,
        lon_min + bbox_x1 / det_width * (lon_max - lon_min) AS w, lon_min + bbox_x2 / det_width * (lon_max - lon_min) AS e FROM ob JOIN fr ON fr.id = ob.image_id WHERE det_width > 0 AND det_height > 0)
      SELECT id, floor(n * 100000 + 0.5) / 100000 AS north, floor(w * 100000 + 0.5) / 100000 AS west, floor(s * 100000 + 0.5) / 100000 AS south, floor(e * 100000 + 0.5) / 100000 AS east FROM j
      WHERE n IS NOT NULL AND s IS NOT NULL AND w IS NOT NULL AND e IS NOT NULL""",
    "scaled_sizes": f"""WITH {_FR}, x AS (SELECT id, det_width AS w, det_height AS h, least(3840.0::DOUBLE / det_width, 2160.0::DOUBLE / det_height) AS k FROM fr WHERE det_width > 0 AND det_height > 0)
      SELECT id, CASE WHEN k <= 1 THEN w ELSE CAST(trunc(w * k) AS INT) END AS width, CASE WHEN k <= 1 THEN h ELSE CAST(trunc(h * k) AS INT) END AS height FROM x""",
    "row_keys": """SELECT DISTINCT edit_id, sha256(concat_ws('|', coalesce(CAST(edit_id AS VARCHAR), '~'), coalesce(image_id, '~'), coalesce(object_class, '~'), coalesce(desk, '~'))) AS row_key FROM detection_in""",
    "metadata_built": f"""WITH {_FR}, f AS (SELECT id, capture_time, lat_center AS la, lon_center AS lo FROM fr WHERE capture_time IS NOT NULL AND lat_center IS NOT NULL AND lon_center IS NOT NULL),
      x AS (SELECT *, row_number() OVER (PARTITION BY part, CAST(capture_time AS DATE) ORDER BY capture_time, id) AS place FROM f, (VALUES ('A', 0.0::DOUBLE), ('B', 0.25::DOUBLE)) v(part, a)),
      y AS (SELECT *, lo - 0.01::DOUBLE + a * 0.02::DOUBLE AS w, lo - 0.01::DOUBLE + (a + 0.75::DOUBLE) * 0.02::DOUBLE AS e FROM x)
      SELECT id, part, CAST(place AS INT) AS place, floor((la - 0.01::DOUBLE) * 100000 + 0.5) / 100000 AS lat_min, floor((la + 0.01::DOUBLE) * 100000 + 0.5) / 100000 AS lat_max, floor(w * 100000 + 0.5) / 100000 AS lon_min,
        floor(e * 100000 + 0.5) / 100000 AS lon_max, floor((w + e) / 2 * 100000 + 0.5) / 100000 AS lon_center FROM y""",
    "model_scores": "SELECT label_id, label, CAST(length(label) AS BIGINT) AS n_letters FROM class_labels",
}
