"""Feature tables against plain Python."""

from collections import defaultdict
from datetime import datetime, timedelta
import random

from pyspark.sql import functions as F

from terralace.operators.features import class_slug, disagreements, entity_features, event_totals, place_key

T0 = datetime(2024, 5, 1)


def test_totals_and_pivot_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        hot = i % 3 == 0
        rows.append((("hot" if hot else f"e{rng.randrange(9)}"), rng.choice([None, "x", "y"]), rng.choice(["a", "b", None]), rng.choice([None, T0 + timedelta(hours=rng.randrange(99))])))
    df = spark.createDataFrame(rows, "p string, q string, kind string, t timestamp_ntz")
    totals = event_totals(df, ["p", "q"], "kind", "t")
    want = defaultdict(list)
    for p, q, k, t in rows:
        for e in (p, q):
            if e is not None:
                want[e, k or "unknown"].append(t)
    got = {(r["entity_id"], r["event_type"]): (r["n"], r["first_time"], r["last_time"]) for r in totals.collect()}
    assert got == {k: (len(v), min((t for t in v if t), default=None), max((t for t in v if t), default=None)) for k, v in want.items()}
    wide = {r["entity_id"]: r for r in entity_features(totals, ["a", "never"], F.lit(T0 + timedelta(days=10))).collect()}
    for e in {k[0] for k in want}:
        mine = [t for k, v in want.items() if k[0] == e for t in v]
        assert wide[e]["n_links"] == len(mine) and wide[e]["a"] == len(want.get((e, "a"), [])) and wide[e]["never"] == 0
        last = max((t for t in mine if t), default=None)
        assert wide[e]["recency_days"] == (None if last is None else round((T0 + timedelta(days=10) - last) / timedelta(days=1), 4))


def test_disagreements(spark):
    stored = [("ok", 2, T0), ("count", 3, T0), ("time", 2, None), ("both", None, None), ("none", 0, None), ("absent", 1, T0), ("ok", 2, T0)]
    computed = [(e, 2, T0, None) for e in ("ok", "count", "time", "both")]
    s = spark.createDataFrame(stored, "id string, observation_count int, first_seen timestamp_ntz").withColumn("n_links", F.lit(7))
    c = spark.createDataFrame(computed, "entity_id string, n_links long, first_time timestamp_ntz, last_time timestamp_ntz")
    got = sorted(tuple(r) for r in disagreements(s, c).collect())
    o, f = "observation_count", "first_seen"
    assert got == sorted([("count", o), ("time", f), ("both", o), ("both", f), ("absent", o), ("absent", f)])


def test_keys(spark):
    row = spark.sql("SELECT 3.625555D AS a, -0.001D AS b, ' Cargo  Ship ' AS c").select(place_key(F.col("a"), F.col("b")), class_slug(F.col("c"))).first()
    assert tuple(row) == ("3.63,-0.00", "cargo__ship")


def test_empty(spark):
    none = spark.createDataFrame([], "p string, kind string, t timestamp_ntz")
    totals = event_totals(none, ["p"], "kind", "t")
    assert totals.count() == 0 and entity_features(totals, ["a"]).count() == 0
