"""Orphan references against a plain dictionary."""

import random
from datetime import datetime, timedelta

from terralace.functions.keys import hex_block, integer_hex, uuid_hex
from terralace.operators.references import distinct_keys, key_runs, match_as_of, orphan_report, orphans
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 31, 23, 0)
REF = "ref_field string, parent_table string, rec_id string, ref string, used_at timestamp_ntz"
PAR = "parent_table string, id string, arrived timestamp_ntz"
DEL = "parent_table string, id string"


def uid(n: int) -> str:
    h = f"{n:032x}"
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def test_spellings_of_a_key(spark):
    h = uid(0xABCDEF)
    forms = [h, h.upper(), "{" + h + "}", "urn:uuid:" + h, "URN:UUID:" + h.upper(), f" \t{h}\n", h.replace("-", "")]
    bad = [h[:-1], h + "0", "", None, "g" + h[1:], "x" * 100_000]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in forms + bad], "k string").select(uuid_hex(F.col("k"))).collect()]
    assert got == [h.replace("-", "")] * len(forms) + [None] * len(bad)


def test_runs_cover_consecutive_keys_and_end_at_blocks(spark):
    keys = [*range(5, 9), *range(65530, 65540), 70000, 70000, 2**40]
    df = spark.createDataFrame([("t", k, T0 + timedelta(seconds=k % 50)) for k in keys], "parent_table string, n long, arrived timestamp_ntz")
    runs = key_runs(distinct_keys(df.select("parent_table", integer_hex(F.col("n")).alias("digits"), "arrived"))).collect()
    got = sorted((int(r["block"], 16) * 65536 + r["run_start"], r["run_end"] - r["run_start"] + 1, (r["latest"] - T0).seconds) for r in runs)
    assert got == [(5, 4, 8), (65530, 6, 35), (65536, 4, 39), (70000, 1, 0), (2**40, 1, 2**40 % 50)]


def test_as_of_match_equals_lookup(spark):
    rng = random.Random(1)
    parents = {rng.choice([rng.randrange(200), rng.randrange(65500, 65600), rng.randrange(2**60)]) for _ in range(400)}
    wanted = {rng.choice([rng.randrange(250), rng.randrange(65400, 65700), *list(parents)[:3]]) for _ in range(400)}
    p = spark.createDataFrame([("t", k, T0 + timedelta(seconds=k % 97)) for k in parents], "parent_table string, n long, arrived timestamp_ntz")
    w = spark.createDataFrame([("t", k, T0) for k in wanted], "parent_table string, n long, first_use timestamp_ntz")
    digits = integer_hex(F.col("n")).alias("digits")
    got = match_as_of(w.select("parent_table", digits, "first_use"), distinct_keys(p.select("parent_table", digits, "arrived"))).collect()
    assert {int(r["digits"], 16): r["found"] for r in got} == {k: k in parents for k in wanted}
    assert {int(r["digits"], 16): r["arrived"] for r in got} == {k: (T0 + timedelta(seconds=k % 97) if k in parents and k % 97 else None) for k in wanted}


def test_dense_keys_are_few_runs_and_carry_nothing_else(spark):
    n = 3 * 65536
    p = spark.range(n).select(F.lit("t").alias("parent_table"), integer_hex(F.col("id")).alias("digits"), F.timestamp_seconds(F.col("id") % 7).cast("timestamp_ntz").alias("arrived"))
    keys = distinct_keys(p)
    assert key_runs(keys).count() == 3
    w = spark.range(0, 2 * n, 2).select(F.lit("t").alias("parent_table"), integer_hex(F.col("id")).alias("digits"), F.timestamp_seconds(F.lit(5)).cast("timestamp_ntz").alias("first_use"))
    got = match_as_of(w, keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("found").alias("found"), F.count_if(F.expr("arrived > first_use")).alias("late")).first()
    assert tuple(got) == (n, n // 2, sum(1 for k in range(0, n, 2) if k % 7 > 5))


def test_defects(spark):
    refs = [
        ("f", "t", "ok", uid(1), T0), ("f", "t", "same time", uid(2), T0), ("f", "t", "late", uid(3).upper(), T0), ("f", "t", "not late", uid(3), T0 + timedelta(days=2)),
        ("f", "t", "gone", uid(4), T0), ("f", "t", "back again", uid(5), T0), ("f", "t", "missing", uid(6), T0), ("f", "t", "broken", "abc", T0), ("f", "t", "blank", "  ", T0),
        ("f", "t", "null", None, T0), ("f", "t", "empty", "", T0), ("f", "u", "other table", uid(1), T0 + timedelta(days=1)), ("f", "t", "no time", uid(3), None), ("f", "t", "no time, missing", uid(7), None),
        ("f", "t", "missing", uid(6), T0),
    ]
    parents = [("t", uid(1), T0), ("t", uid(1), T0 + timedelta(days=9)), ("t", uid(2), T0), ("t", uid(3), T0 + timedelta(days=1)), ("t", uid(5), T0), ("t", None, T0)]
    deleted = [("t", uid(4)), ("t", uid(4)), ("t", uid(5)), ("u", uid(6)), ("t", None)]
    r = spark.createDataFrame(refs, REF).withColumn("digits", F.lit("clash")).withColumn("block", F.lit(1))
    got = sorted(tuple(x) for x in orphans(r, spark.createDataFrame(parents, PAR).withColumn("block", F.lit(2)), spark.createDataFrame(deleted, DEL)).collect())
    want = [
        ("f", "broken", "missing", "2024-01"), ("f", "gone", "deleted", "2024-01"), ("f", "late", "late", "2024-01"), ("f", "missing", "missing", "2024-01"),
        ("f", "missing", "missing", "2024-01"), ("f", "no time, missing", "missing", None), ("f", "other table", "missing", "2024-02"),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], REF), spark.createDataFrame([], PAR), spark.createDataFrame([], DEL)
    assert orphans(*none).count() == 0
    one = spark.createDataFrame([("f", "t", "a", uid(1), T0)], REF)
    report = orphan_report(orphans(one, none[1], none[2])).collect()
    assert [tuple(r) for r in report] == [("f", "2024-01", "missing", 1)]


def test_blocks_keep_order(spark):
    rng = random.Random(2)
    ks = sorted(rng.randrange(2**62) for _ in range(50))
    rows = spark.createDataFrame([(k,) for k in ks], "n long").select("n", *[c.alias(a) for a, c in zip(("b", "o"), hex_block(integer_hex(F.col("n"))))]).orderBy("b", "o").collect()
    assert [r["n"] for r in rows] == ks and all(int(r["b"], 16) * 65536 + r["o"] == r["n"] for r in rows)
