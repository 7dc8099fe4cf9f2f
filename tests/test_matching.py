"""Matching, suppression and merging: properties, and the scenarios of linking two points in time."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from terralace.operators.boxes import merge_adjacent, merge_contained, multi_scale, nms, tiles
from terralace.operators.matching import cross_check, dedup_by_priority, dedup_links, greedy_match, link_frames, match_in_rounds, staged_match
from terralace.plans import reference_queries as queries

PAST, NOW, FUTURE = datetime(2024, 1, 1, 6), datetime(2024, 1, 1, 12), datetime(2024, 1, 1, 18)
CAND = "g string, left_id string, right_id string, score double"
SEEN = "pair_id string, obs_id string, label string, lat double, lon double, at timestamp_ntz, frame_at timestamp_ntz, south double, north double, west double, east double"
SCORED = "pair_id string, left_id string, right_id string, score double"


def test_greedy_equals_rounds_and_is_stable(spark):
    rng = random.Random(5)
    rows = [(f"g{g}", f"l{a}", f"r{b}", round(rng.random(), 1)) for g in range(3) for a in range(8) for b in range(8) if rng.random() < 0.5]
    rows += rows[:3] + [("g0", None, "r1", 0.9), ("g0", "l1", "r1", None)]
    df = spark.createDataFrame(rows, CAND)
    a, b = (sorted(map(tuple, f(df, ["g"]).collect())) for f in (greedy_match, match_in_rounds))
    assert a == b
    kept = {(g, l): (s, r) for g, l, r, s in a}  # noqa: E741
    back = {(g, r): (s, l) for g, l, r, s in a}  # noqa: E741
    assert len(kept) == len(back) == len(a)
    for g, l, r, s in rows:  # noqa: E741
        if l and s is not None:  # no pair that both sides would rather have
            mine, theirs = kept.get((g, l)), back.get((g, r))
            assert (mine and (-mine[0], mine[1]) <= (-s, r)) or (theirs and (-theirs[0], theirs[1]) <= (-s, l)) or (mine and mine[0] >= s) or (theirs and theirs[0] >= s)
    assert greedy_match(df.limit(0), ["g"]).count() == 0 and match_in_rounds(df.limit(0), ["g"]).count() == 0


def test_stages_do_not_share(spark):
    one = spark.createDataFrame([("g", "a", "x", 0.9)], CAND)
    two = spark.createDataFrame([("g", "a", "y", 0.9), ("g", "b", "x", 0.8), ("g", "b", "y", 0.1)], CAND)
    assert sorted((r["left_id"], r["right_id"], r["stage"]) for r in staged_match([one, two], ["g"]).collect()) == [("a", "x", 0), ("b", "y", 1)]


def test_dedup_needs_both_ends(spark):
    rows = [("1", "a", "x", 0), ("2", "a", "y", 1), ("3", "b", "x", 1), ("4", None, "z", 3), ("5", None, "q", 3), ("6", "c", None, 2), ("7", "c", None, 2)]
    df = spark.createDataFrame(rows, "id string, c string, p string, k int")
    assert sorted(r["id"] for r in dedup_by_priority(df, F.col("k"), "c", "p", "id").collect()) == ["1", "4", "5", "6"]


def key(rows):
    return sorted(rows, key=str)


C = [("c1", "a", 10.0, 20.0, NOW), ("c2", "b", 10.0, 20.0, NOW)]
P = [("p1", "a", 10.0, 20.0, PAST), ("p2", "b", 10.0, 20.0, PAST)]


@pytest.mark.parametrize(
    "current, past, scores, kw, want",
    [
        (C[:1], P[:1], [("c1", "p1", 0.9)], {"now": PAST, "then": NOW}, []),
        (C[:1], P[:1], [("c1", "p1", 0.9)], {"now": PAST, "then": PAST}, []),
        (C, [], [], {}, [("c1", None, "new"), ("c2", None, "new")]),
        ([], P, [], {}, [(None, "p1", "disappeared"), (None, "p2", "disappeared")]),
        (C[:1], P[:1], [("c1", "p1", 0.9)], {}, [("c1", "p1", "matched")]),
        (C[:1], P[:1], [("c1", "p1", 0.28)], {}, [("c1", None, "new"), (None, "p1", "disappeared")]),
        (C[:1], P[:1], [("c1", "p1", 0.5)], {}, [("c1", None, "new"), (None, "p1", "disappeared")]),
        (C, P, [("c1", "p1", 0.9), ("c1", "p2", 0.1), ("c2", "p1", 0.1), ("c2", "p2", 0.1)], {}, [("c1", "p1", "matched"), ("c2", None, "new"), (None, "p2", "disappeared")]),
        (C[:1], [("p1", "a", 10.0, 20.0, FUTURE)], [("c1", "p1", 0.9)], {}, [("c1", None, "new")]),
        (C[:1], P[:1], [], {"fixed": ["A"], "box": (0.0, 50.0, 0.0, 50.0)}, [("c1", "p1", "matched")]),
        (C[:1], P[:1], [], {"fixed": ["A"]}, [("c1", None, "new"), (None, "p1", "disappeared")]),
        (C[:1], [("p1", "a", 10.1, 20.0, PAST)], [], {"fixed": ["a"], "box": (0.0, 50.0, 0.0, 50.0)}, [("c1", None, "new"), (None, "p1", "disappeared")]),
        (C[:1], P[1:], [], {"box": (0.0, 1.0, 0.0, 1.0)}, [("c1", None, "past_not_included"), (None, "p2", "current_not_included")]),
    ],
)
def test_scenarios(spark, current, past, scores, kw, want):
    now, then = kw.pop("now", NOW), kw.pop("then", PAST)
    box = kw.pop("box", (None,) * 4)
    rows = lambda side, t: spark.createDataFrame([("p", i, c, la, lo, at, t, *box) for i, c, la, lo, at in side], SEEN)
    out = link_frames(rows(current, now), rows(past, then), spark.createDataFrame([("p", a, b, float(s)) for a, b, s in scores], SCORED), **kw)
    assert key((r["current_id"], r["past_id"], r["status"]) for r in out.collect()) == key(want)


def test_slack_for_late_rows_leaves_the_order_of_frames(spark):
    then, now = PAST, PAST + timedelta(seconds=60)
    rows = lambda side, t: spark.createDataFrame([("p", i, "a", 10.0, 20.0, t + timedelta(seconds=s), t, *(None,) * 4) for i, s in side], SEEN)
    score = spark.createDataFrame([("p", "c1", "p1", 0.9)], SCORED)
    past = rows([("p1", 90), ("p2", 120), ("p3", 121)], then)
    got = lambda cur, at: key((r["current_id"], r["past_id"], r["status"]) for r in link_frames(rows(cur, at), past, score, late_s=120).collect())
    assert got([("c1", 0)], now) == key([("c1", "p1", "matched"), (None, "p2", "disappeared")])
    assert got([("c1", 0)], then) == []


def test_fixed_labels_change_by_similarity(spark):
    rows = lambda side, t: spark.createDataFrame([("p", f"{side}{i}", c, 10.0 + i, 20.0, t, t, 0.0, 50.0, 0.0, 50.0) for i, c in enumerate(("pier", "pier", "pier", "pier", "ship"))], SEEN)
    scored = spark.createDataFrame([("p", "c4", "p4", 0.9)], SCORED)
    alike = spark.createDataFrame([("p", "c0", "p0", 0.2), ("p", "c1", "p1", 0.9), ("p", "c2", "p2", None), ("p", "c4", "p4", 0.1)], "pair_id string, left_id string, right_id string, similarity double")
    got = lambda **kw: {r["current_id"]: r["status"] for r in link_frames(rows("c", NOW), rows("p", PAST), scored, ["pier"], **kw).collect()}
    assert got(similarity=alike) == {"c0": "changed", **{f"c{i}": "matched" for i in (1, 2, 3, 4)}}
    assert set(got().values()) == {"matched"}


def frames_and_boxes(spark, folder, gap, seen):
    """Two frames ``gap`` seconds apart and the observations (id, frame, class, box, lat, lon) in them."""
    for name, rows in (
        ("image_records", [{"id": i, "session_id": "s", "ingestion_time": NOW, "capture_time": t} for i, t in (("old", PAST), ("new", PAST + timedelta(seconds=gap)))]),
        ("detection_records", [{"id": i, "image_id": f, "ingestion_time": NOW, "object_class": c, "lat": la, "lon": lo, **dict(zip(("bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2"), map(float, b)))} for i, f, c, b, la, lo in seen]),
    ):
        kind = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").schema
        spark.createDataFrame([tuple(r.get(c) for c in kind.names) for r in rows], kind).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_frames_close_in_time_are_linked(spark, tmp_path):
    box = (0, 0, 10, 10)
    d = frames_and_boxes(spark, tmp_path, 60, [("a", "old", "ship", box, 10.0, 20.0), ("b", "new", "Ship", box, 10.0, 20.0), ("c", "new", "car", box, 10.0, 20.0)])
    got = queries.linked_frames(spark, d).collect()
    assert key((r["current_id"], r["past_id"], r["status"]) for r in got) == key([("b", "a", "matched"), ("c", None, "new")])


def test_boxes_overlap_without_places(spark, tmp_path):
    d = frames_and_boxes(spark, tmp_path, 3600, [
        ("a1", "old", "ship", (0, 0, 10, 10), None, None), ("b1", "new", " Ship ", (1, 0, 11, 10), 10.0, 20.0), ("c1", "new", "ship", (5, 0, 15, 10), 0.0, 0.0),
        ("a2", "old", "car", (0, 0, 10, 10), 10.0, 20.0), ("b2", "new", "car", (0, 0, 10, 10), 11.0, 20.0), ("b3", "new", "bus", (0, 0, 10, 10), 10.0, 20.0),
    ])
    assert key((r["right_id"], r["left_id"]) for r in queries.best_iou(spark, d).collect()) == [("a1", "b1"), ("a2", "b2")]


def test_overlap_then_pixels_then_degrees(spark, tmp_path):
    d = frames_and_boxes(spark, tmp_path, 3600, [
        ("a1", "old", "ship", (0, 0, 10, 10), None, None), ("b1", "new", "ship", (1, 0, 11, 10), 10.0, 20.0),
        ("a2", "old", "car", (0, 0, 10, 10), 10.0, 20.0), ("b2", "new", "car", (0, 19, 10, 29), 11.0, 20.0), ("c2", "new", "car", (0, 18, 10, 28), 0.0, 0.0), ("d2", "new", "car", (500, 0, 510, 10), 10.0, 20.0),
        ("a3", "old", "bus", (0, 0, 10, 10), 10.0, 20.0), ("b3", "new", "bus", (0, 20, 10, 30), 10.001, 20.0), ("c3", "new", "bus", (0, 20, 90, 30), 11.0, 20.0),
    ])
    got = queries.staged_pairs(spark, d).collect()
    assert key((r["left_id"], r["right_id"], r["stage"]) for r in got) == [("b1", "a1", 0), ("b3", "a3", 2), ("c2", "a2", 1)]


BOXES = "frame_id string, box_id string, label string, score double, x1 double, y1 double, x2 double, y2 double"


def test_survivors_do_not_overlap_and_the_rest_does(spark):
    rng = random.Random(6)
    rows = []
    for i in range(120):
        x, y = rng.uniform(0, 60), rng.uniform(0, 60)
        rows.append((f"f{i % 3}", f"b{i:03d}", rng.choice("ab"), round(rng.random(), 2), x, y, x + rng.uniform(1, 25), y + rng.uniform(1, 25)))
    rows.append(("f0", "bad", "a", None, 0.0, 0.0, 1.0, 1.0))
    kept = [tuple(r) for r in nms(spark.createDataFrame(rows, BOXES)).collect()]

    def over(a, b):
        w, h = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
        i = max(0, w) * max(0, h)
        s, t = (a[6] - a[4]) * (a[7] - a[5]), (b[6] - b[4]) * (b[7] - b[5])
        return i / (s + t - i + 1e-6) > 0.3 or i / (min(s, t) + 1e-6) > 0.5

    for a in rows[:-1]:
        better = [b for b in kept if b[0] == a[0] and b[1] != a[1] and (-b[3], b[1]) < (-a[3], a[1]) and over(a, b)]
        assert (a in kept) == (not better)


def test_merging(spark):
    rows = [
        ("f", "1", "A", 0.5, 0.0, 0.0, 10.0, 10.0), ("f", "2", "a", 0.9, 1.0, 1.0, 5.0, 5.0), ("f", "3", "b", 0.8, 1.0, 1.0, 5.0, 5.0),
        ("g", "1", "a", 0.5, 0.0, 0.0, 10.0, 10.0), ("g", "2", "a", 0.6, 14.0, 0.0, 20.0, 10.0), ("g", "3", "a", 0.7, 24.0, 0.0, 30.0, 10.0), ("g", "4", "a", 0.7, 50.0, 0.0, 60.0, 10.0),
    ]
    df = spark.createDataFrame(rows, BOXES)
    inner = sorted((r["box_id"], r["label"], r["score"], r["x2"]) for r in merge_contained(df.where("frame_id = 'f'")).collect())
    assert inner == [("2", "a", 0.9, 10.0), ("3", "b", 0.8, 5.0)]
    wide = sorted((r["x1"], r["x2"], r["score"]) for r in merge_adjacent(df.where("frame_id = 'g'"), 5.0).collect())
    assert wide == [(0.0, 30.0, 0.7), (50.0, 60.0, 0.7)]
    assert merge_adjacent(df, 0).count() == df.count()
    both = multi_scale([df, df.withColumn("box_id", F.concat("box_id", F.lit("x")))])
    # suppression leaves one box of each place over all labels, and only neighbours within the gap unite
    assert sorted((r["frame_id"], r["label"], r["score"], r["x1"], r["x2"]) for r in both.collect()) == [
        ("f", "a", 0.9, 1.0, 5.0), ("g", "a", 0.7, 0.0, 30.0), ("g", "a", 0.7, 50.0, 60.0),
    ]


def test_a_chain_of_falling_scores_is_matched_to_its_end(spark):
    chain = [(None, f"l{i // 2 + i % 2}", f"r{i // 2}", 1 - i / 100) for i in range(13)]
    df = spark.createDataFrame(chain, CAND)
    a, b = (sorted(map(str, f(df, ["g"]).collect())) for f in (greedy_match, match_in_rounds))
    assert a == b and len(a) == 7


def test_tiles_cover_the_frame(spark):
    got = tiles(spark.createDataFrame([("a", 500, 200), ("b", None, 5), ("c", 256, 256)], "frame_id string, width int, height int"), 256, 64).collect()
    a = [r for r in got if r["frame_id"] == "a"]
    assert {(r["x1"], r["x2"]) for r in a} == {(0, 256), (192, 448), (244, 500)} and {(r["y1"], r["y2"]) for r in a} == {(0, 200)}
    assert len(a) == 3 and [tuple(r) for r in got if r["frame_id"] == "c"] == [("c", 0, 0, 256, 256)]


def test_links_keep_one_of_each_side(spark):
    rows = [("p", "c1", "o1", "matched", 0.9), ("p", "c1", None, "new", None), ("p", None, "o1", "disappeared", None), ("q", "c1", None, "new", None), ("p", None, None, "new", None), ("p", "c2", "o1", "matched", 0.8)]
    got = dedup_links(spark.createDataFrame(rows, "pair_id string, current_id string, past_id string, status string, score double")).collect()
    assert key((r["pair_id"], r["current_id"], r["past_id"]) for r in got) == key([("p", "c1", "o1"), ("q", "c1", None), ("p", None, None)])


def test_a_second_look_makes_the_missing_side_up(spark):
    links = spark.createDataFrame([("p", "c1", None, "new", None), ("p", None, "o1", "disappeared", None), ("p", "c2", None, "new", None), ("p", "c3", "o3", "changed", 1.0), ("p", "c4", None, "past_not_included", None)], "pair_id string, current_id string, past_id string, status string, score double")
    seen = spark.createDataFrame([("p", "c1", 0.5), ("p", "c1", 0.2), ("p", "o1", 0.7), ("p", "c2", 0.4), ("p", "c3", 0.9), ("p", "c4", 0.9), ("p", "c2", None)], "pair_id string, obs_id string, similarity double")
    got = {r["current_id"] if not (r["current_id"] or "").startswith("synthetic-") else r["past_id"]: r for r in cross_check(links, seen).collect()}
    assert {k: (r["status"], r["synthetic"]) for k, r in got.items()} == {"c1": ("matched", True), "o1": ("matched", True), "c2": ("new", False), "c3": ("changed", False), "c4": ("past_not_included", False)}
    assert got["c1"]["past_id"] != got["o1"]["current_id"] and got["c1"]["score"] == 0.5
    assert cross_check(links.limit(0), seen).count() == 0 and cross_check(links, seen.limit(0)).where("synthetic").count() == 0
