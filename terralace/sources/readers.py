"""Readers of metadata, documents, images and annotations; the sink of a vector store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The keys of a metadata entry that have columns of their own.
META_KEYS = {
    "image_file": "string", "capture_time": "string", "source_type": "string", "lat_center": "double", "lon_center": "double",
    "lat_min": "double", "lat_max": "double", "lon_min": "double", "lon_max": "double", "resolution_m": "double", "sensor_platform": "string",
}
# Fixed value: the ISO-8601 texts that metadata may use; an offset behind them is stripped, not applied.
ISO = "^[0-9]{4}-[0-9]{2}-[0-9]{2}( [0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?)?\\z"
REQUIRED = ("image_file", "capture_time", "lat_center", "lon_center")


def with_defaults(entries: DataFrame) -> DataFrame:
    """Metadata entries with parsed times and defaults, and whether they are ``valid`` (all required keys, a time)."""
    wall = F.regexp_replace(F.regexp_replace(F.trim("capture_time"), "(Z|[+-][0-9]{2}:?[0-9]{2})\\z", ""), "T", " ")
    at = F.when(wall.rlike(ISO), F.try_to_timestamp(wall))
    rows = entries.withColumn("captured_at", at.cast("timestamp_ntz")).withColumn("source_type", F.coalesce("source_type", F.lit("satellite")))
    needed = [F.col(k).isNotNull() for k in REQUIRED if k != "capture_time"] + [F.col("captured_at").isNotNull()]
    valid = needed[0]
    for n in needed[1:]:
        valid = valid & n
    return rows.withColumn("valid", valid)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of metadata entries; keys without a column go into the map ``extra``; malformed entries are invalid."""
    raw = spark.read.text(path, wholetext=True)
    entry = F.explode(F.from_json("value", "array<map<string,string>>"))
    entries = raw.select(entry.alias("e"))
    known = list(META_KEYS)
    columns = [F.expr(f"try_cast(e['{k}'] AS {t})").alias(k) for k, t in META_KEYS.items()]
    extra = F.map_filter("e", lambda k, v: ~k.isin(known))
    return with_defaults(entries.select(*columns, extra.alias("extra")))


def read_texts(spark: SparkSession, folder: str, pattern: str = "*.{txt,md}") -> DataFrame:
    """Text files of a folder and all below it: source (path) and text."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


def read_images(spark: SparkSession, folder: str, pattern: str = "*.{tif,tiff,png,jpg}") -> DataFrame:
    """Image files: path, time of change, length and content; files that are missing or can't be read are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return reader.option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").load(folder)


def image_time(xml: Column, tag: Column, changed: Column) -> Column:
    """Capture time of an image file: from its XML, else from its date tag, else the time the file was changed."""
    return F.coalesce(
        F.try_to_timestamp(F.regexp_extract(xml, r"<(?:\w+:)?CaptureTime>\s*([^<]+?)\s*<", 1)).cast("timestamp_ntz"),
        F.try_to_timestamp(tag, F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz"),
        changed.cast("timestamp_ntz"),
    )


def coco_boxes(annotations: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Annotations of a COCO document (columns images, categories, annotations): file_name, class, box and frame size.

    Images and categories are joined by id; annotations of other classes and empty boxes are left out.
    """
    image = annotations.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height")
    name = annotations.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("label")).distinct()
    box = annotations.select(F.explode("annotations").alias("a")).select("a.image_id", "a.category_id", "a.bbox")
    out = box.join(image, "image_id").join(name, "category_id").where("bbox[2] > 0 AND bbox[3] > 0")
    if classes is not None:
        out = out.where(F.col("label").isin(classes))
    return out.select("file_name", "label", "width", "height", *[F.expr(e).alias(a) for a, e in (("x1", "bbox[0]"), ("y1", "bbox[1]"), ("x2", "bbox[0] + bbox[2]"), ("y2", "bbox[1] + bbox[3]"))])


def groups_of_files(files: DataFrame, least: int = 2) -> DataFrame:
    """Files grouped by the first two parts of their names: stem and n_files, from ``least`` files on."""
    stem = F.substring_index(F.substring_index("name", "/", -1), "_", 2).alias("stem")
    return files.groupBy(stem).agg(F.count(F.lit(1)).alias("n_files")).where(F.col("n_files") >= least)


def crop_pairs(files: DataFrame) -> DataFrame:
    """Files ``*_crop_A.*`` joined to ``*_crop_B.*`` of the same stem: stem, a, b."""
    side = lambda s: files.select(F.regexp_extract("name", rf"^(.*)_crop_{s}\.[^.]+$", 1).alias("stem"), F.col("name").alias(s.lower())).where("stem <> ''")
    return side("A").join(side("B"), "stem")


def build_metadata(files: DataFrame, radius: float, size: float, start: str) -> DataFrame:
    """Metadata entries of files (part, id, capture_time, lat_center, lon_center): bounds, and ``place`` by time.

    The bounds reach ``radius`` degrees from the centre. A file that shows part of the scene from west to east (the
    column ``start`` is where it begins, ``size`` how much it is, as parts of the whole) gets the bounds and centre of
    that part. ``place`` numbers the files of a part and day by time, the oldest first.
    """
    span = 2 * radius
    west = F.col("lon_center") - radius + F.col(start) * span
    east = F.col("lon_center") - radius + (F.col(start) + size) * span
    order = Window.partitionBy("part", F.to_date("capture_time")).orderBy("capture_time", "id")
    return files.withColumns({
        "lat_min": F.col("lat_center") - radius, "lat_max": F.col("lat_center") + radius, "lon_min": west, "lon_max": east,
        "lon_center": (west + east) / 2, "place": F.row_number().over(order),
    })


def write_vectors(chunks: DataFrame, path: str, model: str) -> None:
    """A vector store: chunks with their vectors as parquet, and a row about how it was made."""
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    info = chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.max(F.size("embedding")).alias("width")).withColumn("model", F.lit(model))
    info.write.mode("overwrite").json(f"{path}/info")
