"""Lookups, graphs, texts, vectors, changes, readers and first arrivals."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from terralace.functions import geometry as G
from terralace.operators import dml
from terralace.operators.asof import as_of, latest_batch, near_square
from terralace.operators.graph import components, overlapping_communities, undirected
from terralace.operators.text import chunks, sentences, shorten, vector_top_k
from terralace.sources import readers
from terralace.sources.tables import first_arrivals, shared_folder, size_in_bytes, small_enough, written


def test_first_arrivals(spark):
    t = datetime(2024, 1, 1)
    rows = [("a", t + timedelta(1), "late"), ("a", t, "early"), ("b", None, "x"), ("b", t, "y"), ("c", t, "z"), ("c", t, "q"), (None, t, "n"), ("d", None, None)]
    got = first_arrivals(spark.createDataFrame(rows, "id string, at timestamp_ntz, v string"), "id", "at", ["v"])
    assert sorted((r["id"], r["v"]) for r in got.collect()) == [("a", "early"), ("b", "y"), ("c", "q"), ("d", None)]


def test_written_cuts_and_keeps(spark):
    df = written(spark.range(10).withColumn("n", F.col("id") * 2), "t")
    assert df.count() == 10 and "Range" not in df._jdf.queryExecution().toString()
    assert small_enough(df) and not small_enough(df, 1) and size_in_bytes(df) > 0 and shared_folder(spark)


def test_as_of_equals_brute_force(spark):
    rng = random.Random(7)
    left = [(i, rng.choice(["hot", "hot", "k1", None]), rng.choice([None, rng.randrange(500)])) for i in range(200)]
    right = [(rng.choice(["hot", "k1", "k2", None]), rng.randrange(500), f"v{i:03d}") for i in range(80)]
    l = spark.createDataFrame(left, "id int, k string, t long").withColumn("kind", F.lit("clash"))  # noqa: E741
    r = spark.createDataFrame(right, "k string, t long, v string")
    for strict in (False, True):
        got = {x["id"]: x["found"] for x in as_of(l, r, "k", "t", "t", F.col("v"), strict, bucket_us=50).collect()}
        for i, k, t in left:
            fit = [(rt, v) for rk, rt, v in right if k is not None and t is not None and rk == k and (rt < t if strict else rt <= t)]
            assert got.get(i) == (max(fit)[1] if fit else None)
        assert len(got) == len(left)


def test_batches_and_squares(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("b", 1, 4), ("b", None, 5)], "k string, t int, id int")
    assert sorted(r["id"] for r in latest_batch(df, ["k"], "t").collect()) == [2, 3, 4]
    p = spark.createDataFrame([(1, 0.1, 0.1), (2, 0.2, -0.2), (3, 0.201, 0.0), (4, None, 0.0)], "id int, lat double, lon double")
    q = spark.createDataFrame([(9, 0.0, 0.0), (8, None, 1.0)], "qid int, q_lat double, q_lon double")
    assert sorted(r["id"] for r in near_square(p, q, 0.2).collect()) == [1, 2]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(80):02d}", f"n{rng.randrange(80):02d}") for _ in range(50)] + [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(40)] + [("x", "x"), (None, "y")]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        if a and b:
            ra, rb = sorted((find(a), find(b)))
            root[rb] = ra
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: find(n) for n in root}


def test_graph_helpers(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "a", 2), ("a", "a", 5), (None, "b", 9)], "s string, t string, n int")
    assert [tuple(r) for r in undirected(e, "s", "t", "n").collect()] == [("a", "b", 3)]
    m = spark.createDataFrame([("a", "c1"), ("b", "c1"), ("c", "c2")], "node string, component string")
    local = spark.createDataFrame([("a",), ("c",), ("b",), ("b",)], "node string")
    assert [tuple(r) for r in overlapping_communities(m, local).collect()] == [("c1", 2, 2), ("c2", 1, 1)]
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def reference_chunks(parts, size, overlap):
    done, now = [], ""
    for s in parts:
        if not now or len(now) + 1 + len(s) <= size:
            now = f"{now} {s}" if now else s
        else:
            done.append(now)
            now = f"{now[-overlap:]} {s}".strip()
    return done + ([now] if now else [])


def test_chunks(spark):
    rng = random.Random(8)
    texts = [" ".join("x" * rng.randrange(1, 40) + rng.choice(".!?") for _ in range(rng.randrange(60))) for _ in range(20)] + ["", None, "no end", "y" * 5000, "a.\n\n\nb. c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    parts = {r["doc_id"]: r["s"] for r in df.select("doc_id", sentences(F.col("text")).alias("s")).collect()}
    assert parts[len(texts) - 1] == ["a.", "b.", "c"]
    got = {}
    for r in chunks(df, 100, 20).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == {i: w for i, t in enumerate(texts) if t is not None and (w := reference_chunks(parts[i], 100, 20) if len(t) > 100 else [t] if t.strip() else [])}
    short = spark.createDataFrame([("one two three",), ("one",), (None,)], "t string").select(shorten(F.col("t"), 9)).collect()
    assert [r[0] for r in short] == ["one two...", "one", None]


def test_vectors(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, v array<float>").select("vec_id", G.unit(F.col("v")).alias("v"))
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    unit = {r["vec_id"]: r["v"] for r in v.collect()}
    assert all(abs(sum(x * x for x in u) - 1) < 1e-9 for u in unit.values())
    top = vector_top_k(q, v, 3)
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()
    got = {(r["query_id"], r["place"]): r["vec_id"] for r in top.collect()}
    assert sorted(map(tuple, vector_top_k(q, v, 3, block=1).collect())) == sorted(map(tuple, top.collect()))
    for i in (0, 20, 40):
        order = sorted((j for j in unit if j != i), key=lambda j: (-round(sum(a * b for a, b in zip(unit[i], unit[j])), 6), j))[:3]
        assert [got[i, k] for k in (1, 2, 3)] == order


def test_masks_and_pixels(spark):
    text = json.dumps({"shape": [2, 4], "rle": [[0, 3], [1, 4], [0, 1]]})
    m = G.mask(F.lit(text))
    row = spark.range(1).select(G.mask_area(m).alias("a"), G.mask_pixels(m).alias("p"), G.mask_runs(G.mask_pixels(m)).alias("r"), G.mask(F.lit("junk")).alias("n")).first()
    assert row["a"] == 4 and row["p"] == [0, 0, 0, 1, 1, 1, 1, 0] and [list(x) for x in row["r"]] == [[0, 3], [1, 4], [0, 1]]
    e = tuple(F.lit(x) for x in (0.0, 1.0, 10.0, 12.0))
    lat, lon = G.pixel_to_geo(F.lit(50.0), F.lit(25.0), F.lit(100), F.lit(100), e, (F.lit(9.0), F.lit(9.0)))
    none = G.pixel_to_geo(F.lit(50.0), F.lit(25.0), F.lit(100), F.lit(100), (F.lit(None).cast("double"), *e[1:]), (F.lit(9.0), F.lit(8.0)))
    row = spark.range(1).select(lat.alias("a"), lon.alias("b"), none[0].alias("c"), none[1].alias("d"), G.geo_to_pixels((F.lit(0.4), F.lit(0.6), F.lit(10.5), F.lit(11.0)), F.lit(100), F.lit(100), e).alias("g"), G.geo_to_pixels((F.lit(5.0), F.lit(6.0), F.lit(10.5), F.lit(11.0)), F.lit(100), F.lit(100), e).alias("o")).first()
    assert (row["a"], row["b"], row["c"], row["d"]) == (0.75, 11.0, 9.0, 8.0) and tuple(row["g"]) == (21, 36, 54, 64) and row["o"] is None


def test_changes(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), ("c", None, "z")], "id string, n int, s string")
    change = spark.createDataFrame([("a", 9, None, 1), ("c", None, "q", 1)], "id string, n int, s string, extra int")
    assert sorted(map(tuple, dml.partial_update(rows, change, "id", ["n", "s"]).collect())) == [("a", 9, "x"), ("b", 2, None), ("c", None, "q")]
    assert sorted(map(tuple, dml.allowed_update(rows, "id", "b", {"n": 5}, ["n"]).collect())) == [("a", 1, "x"), ("b", 5, None), ("c", None, "z")]
    with pytest.raises(ValueError):
        dml.allowed_update(rows, "id", "b", {"id": 5}, ["n"])
    assert sorted(r["id"] for r in dml.delete_where(rows, F.col("n") > 1).collect()) == ["a", "c"]
    new = spark.createDataFrame([("a", 7)], "id string, n int")
    assert sorted(map(tuple, dml.replace_groups(rows, new, "id").collect()), key=str) == sorted([("a", 7, None), ("b", 2, None), ("c", None, "z")], key=str)
    m = spark.createDataFrame([("x", "y")], "old_id string, new_id string")
    assert sorted(r["s"] or "" for r in dml.remap(rows, m, ["s"]).collect()) == ["", "y", "z"]
    old = spark.createDataFrame([("a", 1, 5, 5, ["p"])], "id string, n int, f int, l int, k array<string>")
    delta = spark.createDataFrame([("a", 2, 3, 9, ["q", "p"]), ("b", 1, 1, 1, None)], "id string, n int, f int, l int, k array<string>")
    assert sorted(tuple(r)[:4] for r in dml.merge_counts(old, delta, "id", ["n"], ["f"], ["l"], ["k"]).collect()) == [("a", 3, 3, 9), ("b", 1, 1, 1)]
    assert dml.add_columns(rows, {"z": "double", "n": "int"}).dtypes[-1] == ("z", "double")


def test_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int").write.partitionBy("k").parquet(path)
    dml.overwrite_partitions(spark.createDataFrame([("a", 9)], "k string, n int"), path, "k")
    assert sorted((r["k"], r["n"]) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 2)]
    dml.append(spark.createDataFrame([(5,)], "n int"), str(tmp_path / "u"))
    dml.append(spark.createDataFrame([(5,)], "n int"), str(tmp_path / "u"))
    assert spark.read.parquet(str(tmp_path / "u")).count() == 2


def test_readers(spark, tmp_path):
    entries = [
        {"image_file": "a.tif", "capture_time": "2024-01-01T06:00:00+09:00", "lat_center": 1, "lon_center": 2, "region_name": "x"},
        {"image_file": "b.tif", "capture_time": "soon", "lat_center": 1, "lon_center": 2}, {"capture_time": "2024-01-01T06:00:00"},
    ]
    (tmp_path / "m.json").write_text(json.dumps(entries))
    rows = {r["image_file"]: r for r in readers.read_metadata(spark, str(tmp_path / "m.json")).collect()}
    assert rows["a.tif"]["valid"] and rows["a.tif"]["captured_at"] == datetime(2024, 1, 1, 6) and rows["a.tif"]["extra"] == {"region_name": "x"}
    assert rows["a.tif"]["source_type"] == "satellite" and not rows["b.tif"]["valid"] and not rows[None]["valid"]
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "x.txt").write_text("one\ntwo")
    (tmp_path / "d" / "e" / "y.md").write_text("three")
    (tmp_path / "d" / "z.bin").write_bytes(b"\0")
    assert sorted(r["text"] for r in readers.read_texts(spark, str(tmp_path / "d")).collect()) == ["one\ntwo", "three"]
    (tmp_path / "i.png").write_bytes(b"12345")
    assert [r["length"] for r in readers.read_images(spark, str(tmp_path)).collect()] == [5]
    times = spark.createDataFrame([("<m:CaptureTime> 2024-01-02 03:04:05 </m>", None), (None, "2024:01:02 03:04:05"), ("<x/>", "bad")], "x string, t string")
    got = [r[0] for r in times.select(readers.image_time(F.col("x"), F.col("t"), F.lit(datetime(2020, 1, 1)))).collect()]
    assert got == [datetime(2024, 1, 2, 3, 4, 5)] * 2 + [datetime(2020, 1, 1)]
    names = spark.createDataFrame([("d/a_1_x.tif",), ("d/a_1_y.tif",), ("b_2_z.tif",), ("q_crop_A.png",), ("q_crop_B.png",), ("r_crop_A.png",)], "name string")
    assert [tuple(r) for r in readers.groups_of_files(names.where("name LIKE '%tif'")).collect()] == [("a_1", 2)]
    assert [r["stem"] for r in readers.crop_pairs(names).collect()] == ["q"]
    coco = {"images": [{"id": 1, "file_name": "f", "width": 9, "height": 8}], "categories": [{"id": 5, "name": "u"}, {"id": 6, "name": "v"}], "annotations": [{"image_id": 1, "category_id": 5, "bbox": [1.0, 2.0, 3.0, 4.0]}, {"image_id": 1, "category_id": 6, "bbox": [1.0, 2.0, 3.0, 4.0]}, {"image_id": 1, "category_id": 5, "bbox": [1.0, 2.0, 0.0, 4.0]}]}
    (tmp_path / "c.json").write_text(json.dumps(coco))
    rows = readers.coco_boxes(spark.read.option("multiLine", True).json(str(tmp_path / "c.json")), ["u"]).collect()
    assert [(r["label"], r["x2"], r["y2"]) for r in rows] == [("u", 4.0, 6.0)]
    readers.write_vectors(spark.createDataFrame([("s", 1, "t", [0.5, 0.5])], "source string, chunk_id int, text string, embedding array<float>"), str(tmp_path / "v"), "none")
    assert spark.read.json(str(tmp_path / "v" / "info")).first()["width"] == 2
