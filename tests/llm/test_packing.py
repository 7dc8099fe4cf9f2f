"""Packing: every token once, no container overfull, and little room unused."""

import random

from pyspark.sql import functions as F

from terralace.llm.packing import BestFit, containers, pack_texts, token_counter


def test_best_fit_against_a_list():
    rng = random.Random(1)
    bins = BestFit(100, 4)
    open_bins, closed, made = {}, 0, 0
    for _ in range(2000):
        size = rng.randrange(101)
        fit = [(free, b) for b, free in open_bins.items() if free >= size]
        b, offset = bins.place(size)
        if fit:
            assert open_bins[b] == min(fit)[0] and offset == 100 - open_bins[b]
            open_bins[b] -= size
        else:
            if len(open_bins) >= 4:
                least = min(open_bins.values())
                gone = set(open_bins) - {x for x, _ in bins.left()} - {b}
                assert len(gone) == 1 and open_bins[gone.copy().pop()] == least
                del open_bins[gone.pop()]
                closed += 1
            assert b == made and offset == 0
            made += 1
            open_bins[b] = 100 - size
        if not open_bins[b] and size:
            del open_bins[b]
        assert dict(bins.left()) == {x: 100 - f for x, f in open_bins.items()}
    assert closed


def test_every_token_once(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma7", "물", "<b>"]) for _ in range(rng.choice([0, 3, 40, 200, 900]))) for _ in range(300)] + [None, "", "word " * 20_000, "x" * 5000]
    sizes = dict(enumerate(token_counter()([t or "" for t in texts])))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kind", F.lit("clash")).repartition(3)
    rows = pack_texts(df, capacity=256, open_bins=8).collect()
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append((r["piece_no"], r["start_token"], r["n_tokens"]))
        by_bin.setdefault(r["container_id"], []).append((r["offset"], r["n_tokens"]))
    for doc, size in sizes.items():
        at = 0
        for k, (no, start, n) in enumerate(sorted(by_doc[doc])):
            assert (no, start) == (k, at) and (n == 256 or k == len(by_doc[doc]) - 1)
            at += n
        assert at == size and (size > 256 or len(by_doc[doc]) == 1)
    for held in by_bin.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 256
    assert sum(sizes.values()) / 256 / len(by_bin) > 0.97
    same = sorted(map(tuple, pack_texts(df, capacity=256, open_bins=8).collect()))
    assert same == sorted(map(tuple, rows))
    total = containers(pack_texts(df, capacity=256)).agg(F.sum("n_tokens"), F.min("free")).first()
    assert total[0] == sum(sizes.values()) and total[1] >= 0


def test_empty(spark):
    assert pack_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert pack_texts(spark.createDataFrame([("a", "one")], "doc_id string, text string")).count() == 1
