"""Instants of texts, one fixture per notation, and the mixture of date orders."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from terralace.functions.instants import read
from terralace.operators.timestamps import mixtures, normalise, readings, with_priors


def us(text: str) -> int:
    return (datetime.fromisoformat(text).replace(tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


@pytest.mark.parametrize(
    "text, zone, want",
    [
        ("2024-01-15T11:19:30+01:00", "UTC", "2024-01-15T10:19:30"), ("2024-02-03T22:09:04-03:30", None, "2024-02-04T01:39:04"), ("2024-03-05T03:23:51+1300", None, "2024-03-04T14:23:51"),
        ("2024-08-09T09:54:46-04", None, "2024-08-09T13:54:46"), ("2024-05-18T00:51:57,696368-03:30", None, "2024-05-18T04:21:57.696368"), ("2024-01-17T19:23:24.731924999Z", None, "2024-01-17T19:23:24.731924"),
        ("2024-01-16T07:24:47z", None, "2024-01-16T07:24:47"), ("2024-02-07 19:18:01.645 UTC+09:00", None, "2024-02-07T10:18:01.645"), ("2024-01-28T11:07:20[Europe/Berlin]", "UTC", "2024-01-28T10:07:20"),
        ("20240112T024433", "Europe/London", "2024-01-12T02:44:33"), ("20240130T004639Z", None, "2024-01-30T00:46:39"), ("2024:01:12 11:32:14", "Asia/Kathmandu", "2024-01-12T05:47:14"),
        ("2024.06.03 08:15:54", "Asia/Seoul", "2024-06-02T23:15:54"), ("Fri, 12 Jan 2024 20:59:59 +0000", None, "2024-01-12T20:59:59"), ("31 Mar 2024 14:17:21 KST", "Asia/Seoul", "2024-03-31T05:17:21"),
        ("2024-06-13 21:43:53 BST", "Europe/London", "2024-06-13T20:43:53"), ("20 Feb 2024 01:57:52 AEDT", "Australia/Sydney", "2024-02-19T14:57:52"), ("Jul 13, 2024 12:17:27 PM", "UTC", "2024-07-13T12:17:27"),
        ("Jan 14, 2024 12:33:40 AM", "UTC", "2024-01-14T00:33:40"), ("2024년 1월 11일 오전 12시 39분 37초", "UTC", "2024-01-11T00:39:37"), ("2024년 10월 4일 오후 11시 30분 42초", "Asia/Seoul", "2024-10-04T14:30:42"),
        ("091740ZMAR24", None, "2024-03-09T17:40:00"), ("2024-032T09:38:43Z", None, "2024-02-01T09:38:43"), ("2024-W03-6T02:25:19Z", None, "2024-01-20T02:25:19"), ("1704992752", None, "2024-01-11T17:05:52"),
        ("1706575767992", None, "2024-01-30T00:49:27.992"), ("1705277833978564", None, "2024-01-15T00:17:13.978564"), ("1707779728.656400", None, "2024-02-12T23:15:28.656400"), ("1705277833978564999", None, "2024-01-15T00:17:13.978564"),
        (" \t2024-01-28 00:20:27.88\n", "America/New_York", "2024-01-28T05:20:27.88"), ("2024-10-27 02:30:00", "Europe/Berlin", "2024-10-27T00:30:00"), ("2024-11-03 01:30:00", "America/New_York", "2024-11-03T05:30:00"),
        ("2024-11-03 01:30:00 EST", "America/New_York", "2024-11-03T06:30:00"),
    ],
)
def test_one_meaning(text, zone, want):
    # bare numbers are narrowed down by the years of the data, doubled wall times by the rule for them
    fit = [at for kind, at in read(text, zone)[1] if not kind.endswith(":later") and (not kind.startswith("number") or 2015 <= 1970 + at / 31_556_952e6 < 2035)]
    assert fit == [us(want)]


@pytest.mark.parametrize(
    "text, zone",
    [
        ("2024-02-30T10:15:00Z", "UTC"), ("2024-11-05T25:61:00Z", "UTC"), ("2024-06-31 08:00:00", "UTC"), ("0000-00-00 00:00:00", "UTC"), ("2024-03-31 02:15:24", "Europe/Berlin"), ("20240310T022813", "America/New_York"),
        ("2024-366T00:00:00Z x", "UTC"), ("2025-366T00:00:00Z", "UTC"), ("2025-W53-1T00:00:00Z", "UTC"), ("yesterday", "UTC"), ("", "UTC"), (None, "UTC"), ("T", "UTC"), ("-", "UTC"), ("n/a", None),
        ("2024-01-01 00:00:00", None), ("2024-01-01 00:00:00 XYZ", "UTC"), ("Mon, 12 Jan 2024 20:59:59 +0000", "UTC"), ("2024년 1월 11일 오전 13시 39분 37초", "UTC"), ("x" * 100_000, "UTC"), ("9" * 5000, "UTC"),
        ("2024-01-01T00:00:00[No/Where]", "UTC"), ("2024-01-01T00:00:00+99:00", "UTC"),
    ],
)
def test_no_existing_time(text, zone):
    assert read(text, zone)[1] == []


def test_date_orders_units_and_doubled_times():
    got = dict(read("03/04/2024 10:00:00", "UTC")[1])
    assert got == {"numeric:DMY": us("2024-04-03T10:00:00"), "numeric:MDY": us("2024-03-04T10:00:00")}
    assert dict(read("24/2/15 14:29", "UTC")[1]) == {"numeric:DMY": us("2015-02-24T14:29:00"), "numeric:YMD": us("2024-02-15T14:29:00")}
    assert read("24/13/45 99:10", "UTC")[1] == []
    assert dict(read("2024-10-27 02:30:00", "Europe/Berlin")[1]) == {"iso": us("2024-10-27T00:30:00"), "iso:later": us("2024-10-27T01:30:00")}
    units = dict(read("1704992752", None)[1])
    assert units["number:s"] == us("2024-01-11T17:05:52") and units["number:ms"] == 1704992752000 and "number:d" not in units


RAW = "rec_table string, rec_id string, source string, raw string, time_zone string, declared string"


def test_declared_orders_decide_and_refuse(spark):
    rows = [
        ("t", "a", "s1", "03/04/2024 10:00:00", "UTC", "DMY"), ("t", "b", "s2", "03/04/2024 10:00:00", "UTC", "MDY"), ("t", "c", "s2", "13/04/2024 10:00:00", "UTC", "MDY"),
        ("t", "d", "s3", "24/2/15 14:29", "UTC", "YMD"), ("t", "e", None, "2024-01-01T00:00:00Z", None, None), ("t", "f", "s1", None, "UTC", "DMY"), ("t", "g", "s1", "", "UTC", "DMY"),
        ("t", "h", "s1", "x" * 100_000, "UTC", "DMY"), ("t", "i", "s1", "1704992752", "UTC", "DMY"), ("t", "i", "s1", "1704992752", "UTC", "DMY"),
    ]
    df = spark.createDataFrame(rows, RAW).withColumn("utc_us", F.lit("clash"))
    out = normalise(df).collect()
    got = {r["rec_id"]: (r["outcome"], r["utc_us"]) for r in out}
    assert got == {
        "a": ("declared", us("2024-04-03T10:00:00")), "b": ("declared", us("2024-03-04T10:00:00")), "c": ("refused", None), "d": ("declared", us("2024-02-15T14:29:00")),
        "e": ("plain", us("2024-01-01T00:00:00")), "f": ("refused", None), "g": ("refused", None), "h": ("refused", None), "i": ("inferred", us("2024-01-11T17:05:52")),
    }
    assert len(out) == len(rows)


def test_mixture_settles_or_marks_ambiguity(spark):
    rows = [("t", f"c{i}", "clear", f"{13 + i % 15}/0{1 + i % 9}/2024 10:00:00", "UTC", None) for i in range(40)]
    rows += [("t", "x", "clear", "03/04/2024 10:00:00", "UTC", None), ("t", "y", "alone", "03/04/2024 10:00:00", "UTC", None), ("t", "z", "alone", "05/05/2024 10:00:00", "UTC", None)]
    rows += [("t", f"m{i}", "mixed", ("25/04/2024 10:00:00" if i % 2 else "04/25/2024 10:00:00"), "UTC", None) for i in range(20)] + [("t", "w", "mixed", "03/04/2024 10:00:00", "UTC", None)]
    df = spark.createDataFrame(rows, RAW)
    got = {r["rec_id"]: (r["outcome"], r["utc_us"]) for r in normalise(df).collect()}
    # the mixture decides x: without it x would be as open as y
    assert got["x"] == ("inferred", us("2024-04-03T10:00:00"))
    assert got["y"] == ("ambiguous", None) and got["w"] == ("ambiguous", None)
    assert got["z"] == ("inferred", us("2024-05-05T10:00:00"))
    w = {(r["source"], r["kind"]): r["weight"] for r in mixtures(with_priors(readings(df), None, True)).collect()}
    assert w["clear", "numeric:DMY"] > 0.95 and abs(w["mixed", "numeric:DMY"] - 0.5) < 0.05


def test_priors_on_years_and_doubled_times(spark):
    rows = [("t", "n", "s", "20000", "Europe/Berlin", None), ("t", "d", "s", "2024-10-27 02:30:00", "Europe/Berlin", None), ("t", "p", "s", "2024-05-01 00:00:00", "Europe/Berlin", None)]
    df = spark.createDataFrame(rows, RAW)
    by_rule = {r["rec_id"]: (r["outcome"], r["utc_us"]) for r in normalise(df).collect()}
    assert by_rule["n"] == ("inferred", us("2024-10-04T00:00:00")) and by_rule["d"] == ("inferred", us("2024-10-27T00:30:00"))
    left_open = {r["rec_id"]: r["outcome"] for r in normalise(df.where("rec_id <> 'p'"), earlier=False).collect()}
    assert left_open["d"] == "ambiguous"
    assert normalise(df.where("rec_id = 'n'"), years=(1900, 1980)).first()["outcome"] == "ambiguous"


def test_empty(spark):
    assert normalise(spark.createDataFrame([], RAW)).count() == 0
