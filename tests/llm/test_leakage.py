"""Leakage against all windows by brute force, and alignment against the textbook table."""

import random

import numpy as np
from pyspark.sql import functions as F

from terralace.llm.leakage import align, align_all, copied, leaks
from terralace.llm.words import passages, words


def test_words():
    assert words("<p>The re­actor​-7,</p> a_b ÉTÉ 비행장 <i>x</i>") == ["the", "reactor", "7", "a", "b", "été", "비행장", "x"]
    assert words(None) == [] and words("") == [] and words("<>") == [] and words("1 < 2 and 3 > 2") == ["1", "2"]
    assert passages("One two.\r\nThree 4\n\n\n<p>Five</p>\r\n7") == [["one", "two"], ["three"], ["five"]]


def brute(docs, items, window):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - window + 1):
            grams.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words(t)
        for k in range(len(w) - window + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + window]), ())}
    return out


def test_no_copied_window_is_missed(spark):
    rng = random.Random(1)
    common = "this phrase is in very many texts and items of all kinds".split()
    vocabulary = [f"w{i}" for i in range(60)]
    say = lambda n: [*(rng.choice(vocabulary) for _ in range(n)), *common[: rng.randrange(12)]]
    items = [(i, " ".join(say(rng.randrange(10, 40)))) for i in range(40)] + [(90, None), (91, ""), (92, "two words"), (93, " ".join(common)), (94, "w1 w2 w3 w4")]
    docs = []
    for d in range(200):
        w = say(rng.randrange(60))
        if rng.random() < 0.6:
            src = words(items[rng.randrange(40)][1])
            n = rng.choice([10, 14, 15, 16, 20])
            at = rng.randrange(max(1, len(src) - n))
            w[rng.randrange(len(w) + 1) : 0] = src[at : at + n]
            w = w if rng.random() < 0.7 else [x.upper() + ("</b>" if i % 3 else "") for i, x in enumerate(w)]
        docs.append((d, " ".join(w)))
    docs += [(900, None), (901, ""), (902, docs[3][1]), (903, ("w5 " * 3000) + docs[3][1]), (904, "so two words here")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("runs", F.lit(2))
    i = spark.createDataFrame(items, "item_id long, text string")
    found = copied(d, i, 15).collect()
    assert len(found) == len({(r["doc_id"], r["item_id"]) for r in found}) and all(r["longest_run"] >= 15 for r in found)
    assert {(r["doc_id"], r["item_id"]) for r in found} == brute(docs, items, 15)


def test_many_items_take_one_scan(spark):
    """50,000 items: no block of them, no vocabulary at the driver, the texts read by one stage only."""
    n = 50_000
    items = spark.range(n).select(F.col("id").alias("item_id"), F.concat_ws(" ", *[F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(5000))) for k in range(20)]).alias("text"))
    docs = items.where("item_id % 1000 = 0").select(F.col("item_id").alias("doc_id"), F.concat(F.lit("so it says "), "text", F.lit(" and so on")).alias("text"))
    read = spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            read.add(len(b))
            yield b

    found = copied(docs.mapInPandas(counting, docs.schema), items, 15).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(k, k) for k in range(0, n, 1000)} and all(r["coverage"] == 1.0 for r in found)
    assert read.value == n // 1000


def test_edited_copies_score(spark):
    item = " ".join(f"v{i}" for i in range(40))
    w = item.split()
    edited = " ".join(x if k % 8 else "changed" for k, x in enumerate(w))
    dropped = " ".join(x for k, x in enumerate(w) if k % 8)
    d = spark.createDataFrame([(1, f"before {edited} after"), (2, dropped), (3, "nothing of it"), (4, item)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in leaks(d, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 2, 4} and got[4]["coverage"] == 1.0 and got[1]["longest_run"] == 7 and got[1]["coverage"] > 0.7 and got[2]["coverage"] > 0.7


def test_recall_of_planted_edits(spark):
    """Copies with 5, 10 and 20 percent of the words changed, or with up to 40 words put in somewhere: 0.9 at least."""
    rng = random.Random(12)
    fill = lambda n: [f"f{rng.randrange(400)}" for _ in range(n)]
    items = [[f"u{rng.randrange(900)}" for _ in range(rng.randrange(30, 90))] for _ in range(60)]
    docs, want = [], {}
    for k in range(400):
        i = rng.randrange(60)
        w = list(items[i])
        way = rng.choice([0.05, 0.1, 0.2, "insertion"])
        if way == "insertion":
            at = rng.randrange(len(w))
            w[at:at] = fill(rng.randrange(25, 41))
        else:
            for p in rng.sample(range(len(w)), max(1, round(way * len(w)))):
                w[p : p + 1] = rng.choice([[], fill(1), fill(2)])
        docs.append((k, " ".join(fill(rng.randrange(80)) + w + fill(rng.randrange(80)))))
        want.setdefault(way, []).append((k, i))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks(d, i).collect()}
    for way, pairs in want.items():
        assert sum(p in got for p in pairs) >= 0.9 * len(pairs), way


def test_align_equals_the_table():
    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.randrange(1, 5) for _ in range(rng.randrange(1, 15))] for _ in range(2))
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        run, longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                same = a[i - 1] == b[j - 1]
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if same else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
                run[i][j] = run[i - 1][j - 1] + 1 if same else 0
                longest = max(longest, run[i][j])
        score, _, got = align(np.array(a), np.array(b))
        assert (score, got) == (max(map(max, h)), longest)


def test_empty(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one, other = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    for find in (leaks, copied):
        assert find(d, i).count() == 0 and find(one, i).count() == 0 and find(d, other).count() == 0
    assert copied(one, other, 6).count() == 1 and copied(one, other, 7).count() == 0


def test_common_runs_reach_the_coverage(spark):
    """Pairs of half the score come out though all their runs are common, or though they share no run of five."""
    rng = random.Random(8)
    phrases = [[f"p{k}w{i}" for i in range(8)] for k in range(6)]
    texts = [" ".join(w for k in rng.sample(range(6), 4) for w in phrases[k]) for _ in range(150)]
    item = [f"v{i}" for i in range(60)]
    texts += [" ".join(w if k % 5 else "other" for k, w in enumerate(item)), " ".join(w for x in item[:40] for w in (x, "and")), " ".join(item[:29])]
    items = [(i, " ".join([*phrases[i], f"own{i}", *phrases[(i + 1) % 6], f"rare{i}", f"more{i}"])) for i in range(6)] + [(9, " ".join(item))]
    want = set()
    for d, t in enumerate(texts):
        for i, x in items:
            number = {w: k + 1 for k, w in enumerate(words(x))}
            score, _, longest = align(np.array(list(number.values())), np.array([number.get(w, 0) for w in words(t)]))
            if score >= len(number):
                want.add((d, i, score, longest))
    dd, ii = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (20_000, 2):
        got = leaks(dd, ii, 0.5, block).collect()
        assert len(got) == len(want) > 100 and {(r["doc_id"], r["item_id"], r["score"], r["longest_run"]) for r in got} == want
    assert (150, 9) in {w[:2] for w in want} and (152, 9) not in {w[:2] for w in want}


def test_align_all_equals_align():
    rng = random.Random(4)
    pairs = [tuple(np.array([rng.randrange(low, 6) for _ in range(rng.randrange(1, n))]) for low, n in ((1, 20), (0, 200))) for _ in range(300)]
    pairs.append((np.array([1, 2]), np.array([1, 2] * 40_000)))
    assert align_all(pairs) == [align(a, b) for a, b in pairs] and align_all([]) == []
