"""Indexed graphs batch by batch, and predicates from what is given."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from terralace.operators import filters
from terralace.operators.graph import GraphIndex, community_profile, extract, relation_rollup

T0 = datetime(2024, 1, 1)
LINKS = "session_id string, place string, slug string, status string, confidence double, seen_at timestamp_ntz"
ROWS = [
    ("s1", "1,1", "a", "new", 0.5, T0), ("s1", "1,1", "b", "matched", 0.25, T0 + timedelta(1)), ("s1", "1,1", "b", "matched", 0.25, None), ("s2", "1,1", "a", None, None, T0 + timedelta(2)),
    ("s2", "1,1", "b", "new", 1.0, T0), (None, "1,1", "c", "new", 1.0, T0), ("s1", None, "a", "new", 1.0, T0), ("s1", "2,2", "a", "new", 1.0, T0),
]


def test_extracted(spark):
    e, r = extract(spark.createDataFrame(ROWS, LINKS))
    entities = {x["id"]: (x["observation_count"], x["first_seen"]) for x in e.collect()}
    assert entities["loc:1,1"] == (6, T0) and entities["asset:b:1,1"] == (3, T0) and len(entities) == 6
    relations = {(x["source_id"], x["target_id"], x["relation_type"]): x["n"] for x in r.collect()}
    assert relations["asset:a:1,1", "asset:b:1,1", "co_occurred_with"] == 2 and relations["asset:b:1,1", "loc:1,1", "found_at"] == 3
    assert not any("asset:c:1,1" in k[:2] and k[2] == "co_occurred_with" for k in relations)
    assert all(x.count() == 0 for x in extract(spark.createDataFrame([], LINKS)))


def test_index_adds_batches_and_replaces_those_of_a_name(spark, tmp_path):
    df = spark.createDataFrame(ROWS, LINKS)
    index = GraphIndex(spark, str(tmp_path / "graph"))
    index.index(df, "one")
    index.index(df, "two")
    index.index(df.limit(0), "two")
    assert {r["kind"]: (r["n"], r["total"]) for r in index.stats().collect()} == {"location": (2, 7), "asset": (4, 7), "found_at": (4, 7), "co_occurred_with": (1, 2)}
    index.reindex({"all": df.where("place = '2,2'")})
    assert index.entities().count() == 2
    index.clear()
    assert not (tmp_path / "graph").exists()


def test_rollups(spark):
    rows = [("a", "b", "k", 1, T0, T0, ["x"]), ("a", "b", "k", 2, T0, T0 + timedelta(1), ["y", "x"]), (None, "b", "k", 1, T0, T0, None), ("a", "b", "k", None, None, None, [])]
    got = {r["source_id"]: r for r in relation_rollup(spark.createDataFrame(rows, "source_id string, target_id string, kind string, n long, created_at timestamp_ntz, updated_at timestamp_ntz, locations array<string>")).collect()}
    assert got["a"]["n"] == 3 and got["a"]["locations"] == ["x", "y"] and got["a"]["updated_at"] == T0 + timedelta(1) and got[None]["locations"] == []
    members = spark.createDataFrame([("n1", "c"), ("n2", "c"), ("n3", "d")], "node string, component string")
    entities = spark.createDataFrame([("n1", "ship", "1,1", 3), ("n2", "car", "1,1", None), ("n3", None, None, None)], "id string, object_class string, cell string, observation_count int")
    got = {r["component"]: (r["n_cells"], r["n_observations"], r["label"]) for r in community_profile(members, entities).collect()}
    assert got == {"c": (1, 3, "ship(3), car(1)"), "d": (0, 0, None)}


def test_filters(spark):
    df = spark.createDataFrame([(1, "Aa", 1.0), (2, "ab", None), (3, None, 3.0)], "id int, name string, x double")
    ids = lambda **given: sorted(r["id"] for r in filters.matching(df, given).collect())
    assert ids() == ids(name=None) == [1, 2, 3] and ids(name__like="A") == [1, 2] and ids(name__not="ab") == [1, 3] and ids(id__in=[1, 3], x__least=2.0) == [3]
    assert ids(x__known=False) == [2] and ids(x__between=(0, 1)) == [1] and ids(x__most=0.5) == []
    with pytest.raises(ValueError):
        ids(x__near=1)
    assert filters.latest(df, "x", "id", 1).first()["id"] == 3 and filters.latest(df.limit(0), "x", "id", 1).first() is None
    assert {r["name"] for r in filters.alerts(df.union(df), "name", {"Aa": 2}, 1).collect()} == {"ab"} and filters.alerts(df, "name", {}, 0).count() == 2
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0), (3, None, 1.0)], "id int, lat double, lon double")
    pick = lambda zone: [r["id"] for r in filters.nearest_in_zone(p, F.expr(zone), (9.0, 9.0), (1.0, 1.0), "id").collect()]
    assert pick("lat > 1") == [2] and pick("lat > 50") == [1] and filters.nearest_in_zone(p.limit(0), F.lit(True), (0, 0), (0, 0), "id").count() == 0
