"""Operators on the boxes of a frame: tiles, suppression, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralace.operators.grouped import map_groups

BOX = ["x1", "y1", "x2", "y2"]
EPS = 1e-6


def tiles(frames: DataFrame, size: int = 1008, overlap: int = 400) -> DataFrame:
    """Tiles that cover each frame (frame_id, width, height): frame_id, x1, y1, x2, y2.

    Tiles step by size - overlap; the last one is shifted back to end at the border. Frames without a size have none.
    """
    step = size - overlap

    def starts(length: str):
        full = F.sequence(F.lit(0), F.greatest(F.col(length) - 1, F.lit(0)), F.lit(step))
        return F.array_distinct(F.transform(full, lambda s: F.greatest(F.least(s, F.col(length) - size), F.lit(0))))

    known = frames.where("width > 0 AND height > 0").select("frame_id", "width", "height")
    at = known.withColumn("x1", F.explode(starts("width"))).withColumn("y1", F.explode(starts("height")))
    return at.select(
        "frame_id", "x1", "y1", F.least(F.col("x1") + size, F.col("width")).alias("x2"), F.least(F.col("y1") + size, F.col("height")).alias("y2")
    )


def suppress(iou: float, iomin: float | None):
    """The rule for the boxes of a frame by falling score: kept unless one that is kept overlaps by more than a threshold."""

    def rule(rows: list[tuple]) -> list[tuple]:
        kept: list[tuple] = []
        for row in rows:
            x1, y1, x2, y2 = row[4:8]
            size = max(0.0, x2 - x1) * max(0.0, y2 - y1)
            for other in kept:
                w = min(x2, other[6]) - max(x1, other[4])
                h = min(y2, other[7]) - max(y1, other[5])
                if w > 0 and h > 0:
                    theirs = max(0.0, other[6] - other[4]) * max(0.0, other[7] - other[5])
                    if w * h / (size + theirs - w * h + EPS) > iou or (iomin is not None and w * h / (min(size, theirs) + EPS) > iomin):
                        break
            else:
                kept.append(row)
        return kept

    return rule


SCHEMA = "frame_id string, box_id string, label string, score double, x1 double, y1 double, x2 double, y2 double"
_COLUMNS = ["frame_id", "box_id", "label", "score", *BOX]


def nms(boxes: DataFrame, iou: float = 0.3, iomin: float | None = 0.5) -> DataFrame:
    """Greedy suppression in each frame, over all classes; ties of the score go to the smaller box_id.

    ``boxes``: frame_id, box_id, label, score, x1..y2. A frame is an image, which bounds its boxes. Rows with a null
    number are dropped.
    """
    good = boxes.dropna(subset=["score", *BOX]).select(*_COLUMNS)
    return map_groups(good, ["frame_id"], [F.desc("score"), "box_id"], SCHEMA, suppress(iou, iomin))


def _merge(boxes: DataFrame, joins, together) -> DataFrame:
    """Boxes of one label in a frame, by falling score, each taking in the later ones that join it; again until none does.

    A sweep looks at every pair once. Ties of the score go to the smaller box_id, which is also the id that is kept.
    """

    def sweep(rows: list[dict]) -> list[dict]:
        kept = []
        while rows:
            first, later = rows[0], []
            for other in rows[1:]:
                if joins(first, other):
                    first = together(first, other)
                else:
                    later.append(other)
            kept.append(first)
            rows = later
        return kept

    def rule(group: list[tuple]) -> list[tuple]:
        rows = [dict(zip(_COLUMNS, r)) for r in group]
        while len(fewer := sweep(rows)) < len(rows):
            rows = fewer
        return [tuple(r[c] for c in _COLUMNS) for r in fewer]

    good = boxes.dropna(subset=["score", *BOX]).withColumn("label", F.lower("label")).select(*_COLUMNS)
    return map_groups(good, ["frame_id", "label"], [F.desc("score"), "box_id"], SCHEMA, rule)


def _size(b: dict) -> float:
    return max(0.0, b["x2"] - b["x1"]) * max(0.0, b["y2"] - b["y1"])


def merge_contained(boxes: DataFrame, iomin: float = 0.99) -> DataFrame:
    """Of two boxes of a label (case doesn't matter) one of which holds the other, keep the larger with the higher score.

    The row keeps the id of the box with the higher score.
    """

    def joins(a: dict, b: dict) -> bool:
        w, h = min(a["x2"], b["x2"]) - max(a["x1"], b["x1"]), min(a["y2"], b["y2"]) - max(a["y1"], b["y1"])
        return w > 0 and h > 0 and w * h / (min(_size(a), _size(b)) + EPS) >= iomin

    def together(a: dict, b: dict) -> dict:
        larger = a if _size(a) >= _size(b) else b
        return {**a, **{c: larger[c] for c in BOX}, "score": max(a["score"], b["score"])}

    return _merge(boxes, joins, together)


def merge_adjacent(boxes: DataFrame, gap: float = 5.0) -> DataFrame:
    """Unite boxes of a label whose horizontal and vertical gaps are at most ``gap``, with the higher score.

    A ``gap`` of zero or less merges nothing.
    """
    if gap <= 0:
        return boxes.dropna(subset=["score", *BOX]).withColumn("label", F.lower("label")).select(*_COLUMNS)

    def joins(a: dict, b: dict) -> bool:
        return (
            max(0.0, max(a["x1"], b["x1"]) - min(a["x2"], b["x2"])) <= gap and max(0.0, max(a["y1"], b["y1"]) - min(a["y2"], b["y2"])) <= gap
        )

    def together(a: dict, b: dict) -> dict:
        return {
            **a, "x1": min(a["x1"], b["x1"]), "y1": min(a["y1"], b["y1"]), "x2": max(a["x2"], b["x2"]), "y2": max(a["y2"], b["y2"]),
            "score": max(a["score"], b["score"]),
        }

    return _merge(boxes, joins, together)


def multi_scale(scales: list[DataFrame], gap: float = 5.0) -> DataFrame:
    """Boxes found at several scales as one set: suppression, then merging of adjacent and of contained boxes."""
    union = scales[0]
    for s in scales[1:]:
        union = union.unionByName(s)
    return merge_contained(merge_adjacent(nms(union), gap))
