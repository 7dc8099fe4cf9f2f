"""Streams against the same plan over a batch, and state against plain Python."""

from datetime import datetime, timedelta
import random

import pytest

from terralace.streaming import windows as w

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def folder(spark, tmp_path, n=300):
    rng = random.Random(10)
    at = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        at += timedelta(minutes=rng.randrange(1, 20))
        rows.append((i, at, rng.randrange(4), rng.choice(["a", "b"]), rng.choice([None, round(rng.uniform(0, 200), 1)])))
    spark.createDataFrame(rows + rows[:20], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path), rows


def test_windows_and_deliveries(spark, tmp_path):
    d, rows = folder(spark, tmp_path)
    batch = spark.read.parquet(f"{d}/events.parquet")
    for f in (w.tumbling, w.sliding, w.sessions):
        a = sorted(map(str, w.available_now(f(w.event_stream(spark, d)), "complete").collect()))
        assert a == sorted(map(str, f(batch).collect())) and a
    once = w.available_now(w.first_deliveries(w.event_stream(spark, d)).select("event_id"))
    assert sorted(r[0] for r in once.collect()) == [r[0] for r in rows]


def test_state_and_follow_ups(spark, tmp_path):
    d, rows = folder(spark, tmp_path)
    got = {r["user_id"]: (r["n_changes"], r["last_value"]) for r in w.available_now(w.value_changes(w.event_stream(spark, d)), "update", ["user_id"]).collect()}
    for user in range(4):
        last, n = None, 0
        for _, _, _, _, v in sorted((r for r in rows if r[2] == user), key=lambda r: (r[1], r[0])):
            if v is not None and (last is None or abs(v - last) > 50):
                n += last is not None
                last = v
        assert got[user] == (n, last)
    pairs = w.available_now(w.follow_ups(w.event_stream(spark, d))).distinct().collect()
    want = {(a[2], a[0], a[3], b[0], b[3]) for a in rows for b in rows if a[3] != b[3] and a[2] == b[2] and timedelta(0) <= b[1] - a[1] <= timedelta(minutes=10)}
    assert {tuple(r) for r in pairs} == want


def test_updates_of_all_batches_count(spark, tmp_path):
    at = datetime(2024, 1, 1)
    for u in range(3):
        rows = [(10 * u + i, at + timedelta(hours=u, minutes=i), u, "a", 100.0 * i) for i in range(2)] + [(10 * u + 5, at + timedelta(hours=u, minutes=9), 0, "b", 500.0 * u)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    d = str(tmp_path)
    got = {r["user_id"]: r["n_changes"] for r in w.available_now(w.value_changes(w.event_stream(spark, d, files_per_batch=1)), "update", ["user_id"]).collect()}
    assert set(got) == {0, 1, 2} and got[1] == got[2] == 1 and got[0] >= 3
    n = {r["event_type"]: r["n"] for r in w.available_now(w.counts(w.event_stream(spark, d, files_per_batch=1)), "update", ["event_type"]).collect()}
    assert n == {"a": 6, "b": 3}
    assert w.available_now(w.counts(w.event_stream(spark, d, files_per_batch=1)), "complete").count() == 2
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none.parquet"))
    empty = w.event_stream(spark, d, "none")
    assert w.available_now(empty.select("event_id")).count() == 0 and w.available_now(w.counts(empty), "complete").count() == 0
    with pytest.raises(ValueError):
        w.available_now(w.counts(w.event_stream(spark, d)), "update")
