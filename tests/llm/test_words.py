"""The terms of passages: hashes in place of words, and what they cost."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralace.llm import subjects
from terralace.llm import words as w

ODD = [None, "", "\n", "a", "A\r\nb c\fd\x0be\x85f\x1cg\u2028h\u2029i", "<b", "x<b\n>y", "İstanbul ΣΑΣ\u00adΣ", "123 !!!", "\ufeffone\u200dtwo", "_a_b1c", "y" * 9000 + " z", "\U0001d518 ⅷ ² ½ ª"]


def texts(seed, n, longest):
    rng = random.Random(seed)
    letters = "aBeÉσΣ 1_\n\r\u2028\u2029\f \u00ad\u200b<>한글é\t\x0b-"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("at_once", [3, w.AT_ONCE])
def test_hashes_stand_for_the_words_of_passages(monkeypatch, at_once):
    monkeypatch.setattr(w, "AT_ONCE", at_once)
    some = [*ODD, *texts(3, 2000, 60)]
    hashes, n_words, n_passages = w.passage_hashes(some)
    want = [w.passages(t) for t in some]
    assert n_passages.tolist() == [len(p) for p in want] and n_words.tolist() == [len(p) for d in want for p in d]
    pairs = set(zip((x for d in want for p in d for x in p), hashes.tolist(), strict=True))
    assert len(pairs) == len({x for x, _ in pairs}) == len({h for _, h in pairs})
    assert [len(x) for x in w.passage_hashes([])] == [0, 0, 0] and w.passage_hashes([None])[2].tolist() == [0]


def test_unseen_characters_don_t_count():
    assert w.plain("\ufeffA\u200bb\u00adC\u2060 \u200c\u200dΣ<i>") == "abc σ"


def test_terms_cost_less_than_words():
    """The texts are most of the work of ``p10_found``: beyond half of what the words cost, the job leaves its budget."""
    rng = random.Random(4)
    names = ["".join(rng.choice("abcdefghü") for _ in range(rng.randint(2, 10))) for _ in range(500)]
    some = ["\n\n".join(" ".join(rng.choices(names, k=60)) + "." for _ in range(4)) for _ in range(1500)]

    def cost(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    w.passage_hashes(some[:10])
    terms, made = min(cost(lambda: w.passage_hashes(some)) for _ in range(3)), min(cost(lambda: [w.passages(t) for t in some]) for _ in range(3))
    assert terms < 0.5 * made


@pytest.mark.parametrize("at_once", [64, subjects.TEXT_AT_ONCE])
def test_the_matrix_holds_all_passages(spark, monkeypatch, at_once):
    monkeypatch.setattr(subjects, "TEXT_AT_ONCE", at_once)
    some = [*ODD, *texts(5, 300, 200)]
    docs = spark.createDataFrame([(d, t, "EN" if d % 3 else None) for d, t in enumerate(some)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in subjects.passage_terms(docs.repartition(3)).collect()}
    want = {d: p for d, t in enumerate(some) if (p := w.passages(t))}
    assert got.keys() == want.keys()
    for d, found in want.items():
        hashes, sizes, _ = w.passage_hashes([some[d]])
        assert got[d]["terms"] == hashes.view(np.int64).tolist() and got[d]["ends"] == np.cumsum([len(p) for p in found]).tolist() == np.cumsum(sizes).tolist()
        assert got[d]["lang"] == ("en" if d % 3 else "")
    assert subjects.passage_terms(docs.where(F.lit(False))).count() == 0


def test_mixtures_don_t_depend_on_the_blocks(monkeypatch):
    rng = np.random.default_rng(6)
    parts = rng.random((40, 5)).astype(np.float32)
    terms, starts = rng.integers(0, 40, 5000), np.unique(np.concatenate(([0], rng.integers(1, 5000, 300))))
    whole = subjects.mixtures(terms, starts, parts, 8)
    monkeypatch.setattr(subjects, "TERMS_AT_ONCE", 50)
    assert all(np.array_equal(a, b) for a, b in zip(whole, subjects.mixtures(terms, starts, parts, 8)))


def test_terms_are_found_among_many_others():
    rng = np.random.default_rng(7)
    known = rng.integers(-(2**63), 2**63 - 1, 300)
    found = subjects.Components([{"term": int(t), "subject": "a", "tie": 1.0} for t in known], ["a", "b"])
    terms = np.concatenate((known, rng.integers(-(2**63), 2**63 - 1, 100_000)))
    assert (found.terms[found.numbers(terms)[:300]] == known).all() and (found.numbers(terms)[300:] == -1).all()
