"""Evaluation texts that leak into a corpus.

``copied`` finds copies of passages of ``window`` consecutive words. The items are a table of their runs of five words;
the tasks get no more of it than a bit array of bounded size that says which runs any item may have. One scan of the
texts, whatever the number of items, counts the documents of every such run and keeps the passages in which so many
runs follow each other that they can hold a copied window: a few words around each, never the text. The rarest run of
each window of an item, by the counts of the whole corpus, is its seed. Seeds join passages to items, Smith-Waterman
alignment scores what they find. Every copied window holds a seed, so none is missed however common all its runs are.

``leaks`` finds edited copies down to a stated coverage: every document and item whose words in common allow that
coverage are aligned over the whole text, with or without a shared run. The test items are its query side: they are
stated sets of bounded size, handled in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralace.llm.words import words
from terralace.sources.tables import small_enough, spread, written

GRAM = 5
#: Items handled at a time by ``leaks``: their words are sent to every task.
BLOCK_ITEMS = 20_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words around a passage that belong to its alignment.
MARGIN = 24
#: Words of text (with padding) that are aligned at a time.
AT_ONCE = 32_768
#: Bits of the array that says which runs the items have: 16 a run, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
#: Distinct words whose hashes a task keeps, and counts of runs that it keeps before it hands them on.
KEPT_WORDS, KEPT_RUNS = 500_000, 1_000_000


class Hashes(dict):
    """64-bit hashes of words, kept while they are few."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, texts: list[list[str]]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.uint64, sum(map(len, texts)))


def run_hashes(flat: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``GRAM`` consecutive word hashes."""
    h = np.zeros(max(0, len(flat) - GRAM + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            h = (h ^ flat[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def item_runs(items: DataFrame) -> DataFrame:
    """The runs of items (item_id, text): item_id, words (hashes), place, run. Items of fewer words have none."""
    kind = items.schema["item_id"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for batch in batches:
            out = []
            for item, text in zip(batch["item_id"], batch["text"]):
                flat = hashes.of([words(text)])
                if len(flat) >= GRAM:
                    out.append((item, flat.view(np.int64), run_hashes(flat).view(np.int64)))
            yield pd.DataFrame(out, columns=["item_id", "words", "runs"])

    return items.mapInPandas(cut, f"item_id {kind}, words array<long>, runs array<long>")


def bits_of(runs: DataFrame) -> np.ndarray:
    """The bit array of a column ``run``: made in parts by the tasks, put together at the driver; at most 16 MB."""
    n = LEAST_BITS
    while n < MOST_BITS and n < 16 * runs.count():
        n *= 2

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(n, bool)
        for batch in batches:
            bits[batch["run"].to_numpy(np.int64).view(np.uint64) & np.uint64(n - 1)] = True
        yield pd.DataFrame({"bits": [np.packbits(bits).tobytes()]})

    out = np.zeros(n // 8, np.uint8)
    for r in runs.select("run").coalesce(4).mapInPandas(mark, "bits binary").toLocalIterator():
        out |= np.frombuffer(r["bits"], np.uint8)
    return np.unpackbits(out).astype(bool)


def _scan(bits: np.ndarray, need: int):
    """The pass over the texts: rows with run and n (documents that have it), and rows with passages.

    A passage is ``need`` or more runs in a row that items may have: doc_id, at (its first word), words (hashes, from
    ``MARGIN`` words before it to as many behind it), start (place of the first of them in the text), runs.
    """
    mask = np.uint64(len(bits) - 1)
    packed = np.packbits(bits)
    size = len(bits)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, hashes = np.unpackbits(packed, count=size).astype(bool), Hashes()
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def counted() -> tuple[np.ndarray, np.ndarray]:
            runs, back = np.unique(np.concatenate([r for r, _ in kept]), return_inverse=True)
            return runs, np.bincount(back, np.concatenate([n for _, n in kept]), len(runs)).astype(np.int64)

        for batch in batches:
            texts = [words(t) for t in batch["text"]]
            flat = hashes.of(texts)
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            ends = np.cumsum(sizes)
            owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
            out = []
            if len(flat) >= GRAM:
                runs = run_hashes(flat)
                hit = bits[runs & mask] & (owner[: len(runs)] == owner[GRAM - 1 :])
                at = np.flatnonzero(hit)
                if len(at):
                    order = np.lexsort((owner[at], runs[at]))
                    r, o = runs[at][order], owner[at][order]
                    fresh = np.concatenate(([True], (r[1:] != r[:-1]) | (o[1:] != o[:-1])))
                    kept.append(np.unique(r[fresh], return_counts=True))
                edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
                for low, high in zip(edges[::2], edges[1::2]):
                    if high - low >= need:
                        d = owner[low]
                        first, last = ends[d] - sizes[d], ends[d]
                        a, b = max(first, low - MARGIN), min(last, high + GRAM - 1 + MARGIN)
                        out.append((batch["doc_id"].iloc[d], low - first, a - first, flat[a:b].view(np.int64), runs[low:high].view(np.int64)))
            yield pd.DataFrame(out, columns=["doc_id", "at", "start", "words", "runs"]).assign(run=None, n=None)
            if len(kept) > 1 and sum(len(r) for r, _ in kept) > KEPT_RUNS:
                kept[:] = [counted()]
                if len(kept[0][0]) > KEPT_RUNS // 2:
                    yield _counts(*kept.pop())
        if kept:
            yield _counts(*counted())

    return scan


def _counts(runs: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": None, "at": None, "start": None, "words": None, "runs": None, "run": runs.view(np.int64), "n": n})


def copied(documents: DataFrame, items: DataFrame, window: int = 15) -> DataFrame:
    """Every document and test item that share ``window`` consecutive words, with the best alignment of the two.

    ``documents``: doc_id, text; ``items``: item_id, text. Result: doc_id, item_id, score (Smith-Waterman: +2 equal
    words, -1 unequal, -1 gap), coverage (score over that of the whole item), longest_run (equal consecutive words, at
    least ``window``) and n_passages (of the document that hold such a copy). One row per document and item. Words are
    equal if their 64-bit hashes are. Null and empty texts, and items of fewer words than ``window``, share nothing;
    documents repeated under one id count as one; an item repeated under one id counts with its smallest text.
    """
    if window < GRAM:
        raise ValueError(f"window must be at least {GRAM}")
    listed = items.where("item_id IS NOT NULL AND text IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text"))
    held = written(item_runs(listed).where(F.size("words") >= window), "items")
    runs = held.select("item_id", F.posexplode("runs").alias("place", "run"))
    need = window - GRAM + 1
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, at long, start long, words array<long>, runs array<long>, run long, n long"
    texts = spread(documents.select("doc_id", "text"), "doc_id").where("doc_id IS NOT NULL AND text IS NOT NULL")
    scanned = written(texts.mapInPandas(_scan(bits_of(runs), need), schema), "scanned")
    frequency = scanned.where("run IS NOT NULL").groupBy("run").agg(F.sum("n").alias("n"))
    costs = runs.join(frequency, "run", "left").withColumn("cost", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run"))
    ahead = Window.partitionBy("item_id").orderBy("place").rowsBetween(0, need - 1)
    windows = costs.select("item_id", F.min("cost").over(ahead).alias("best"), F.count(F.lit(1)).over(ahead).alias("held"))
    seeds = windows.where(F.col("held") == need).select("item_id", "best.run").distinct()
    passages = scanned.where("doc_id IS NOT NULL")
    # a document that repeats a passage, or one of many seeds in it, asks for its alignment once
    wanted = passages.select("doc_id", "at", F.explode(F.array_distinct("runs")).alias("run")).join(seeds, "run").select("doc_id", "at", "item_id").distinct()
    shown = held.select("item_id", F.col("words").alias("item_words"))
    shown = F.broadcast(shown) if small_enough(shown) else shown
    both = wanted.join(passages.select("doc_id", "at", "words"), ["doc_id", "at"]).join(shown, "item_id")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = []
            for item, text in zip(batch["item_words"], batch["words"]):
                # narrow numbers instead of hashes; 0 is a word that the item lacks
                known, number = np.unique(item, return_inverse=True)
                place = np.minimum(np.searchsorted(known, text), len(known) - 1)
                pairs.append((number + 1, np.where(known[place] == text, place + 1, 0)))
            got = align_all(pairs)
            out = batch[["doc_id", "item_id"]].copy()
            out["score"], out["longest_run"] = [g[0] for g in got], [g[2] for g in got]
            out["coverage"] = [g[0] / (MATCH * len(item)) for g, item in zip(got, batch["item_words"])]
            yield out

    item_kind = items.schema["item_id"].dataType.simpleString()
    columns = f"doc_id {kind}, item_id {item_kind}, score long, longest_run long, coverage double"
    aligned = both.select("doc_id", "item_id", "words", "item_words").mapInPandas(judge, columns)
    return aligned.where(F.col("longest_run") >= window).groupBy("doc_id", "item_id").agg(
        F.max("score").alias("score"), F.max("coverage").alias("coverage"), F.max("longest_run").alias("longest_run"), F.count(F.lit(1)).alias("n_passages")
    )


class Items:
    """The words of a block of test items, as numbers."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.numbers: dict[int, np.ndarray] = {}
        for item, text in rows:
            found = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if found:
                self.numbers[item] = np.array(found, np.int64)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman of words: (best score, end of the best alignment in ``text``, longest run of equal words)."""
    score = np.zeros(len(text) + 1, np.int64)
    run = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1) * -GAP
    best = end = longest = 0
    for word in item:
        same = text == word
        now = np.zeros_like(score)
        now[1:] = np.maximum(np.maximum(score[:-1] + np.where(same, MATCH, MISMATCH), score[1:] + GAP), 0)
        # gaps along the text: the best start minus the way from there
        score = np.maximum(np.maximum.accumulate(now + steps) - steps, 0)
        run = np.concatenate(([0], np.where(same, run[:-1] + 1, 0)))
        top = int(score.max())
        if top > best:
            best, end = top, int(score.argmax())
        longest = max(longest, int(run.max()))
    return best, end, longest


def align_all(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
    """``align`` of every (item, text), those with texts of like length together."""
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda i: len(pairs[i][1]))
    while order:
        width = len(pairs[order[-1]][1])
        now, order = order[-max(1, AT_ONCE // (width + 1)) :], order[: -max(1, AT_ONCE // (width + 1))]
        # padding that equals nothing: 0 in texts is no word of an item, -1 in items is no word of a text
        text = np.zeros((len(now), width), np.int32)
        item = np.full((max(len(pairs[i][0]) for i in now), len(now)), -1, np.int32)
        for k, i in enumerate(now):
            text[k, : len(pairs[i][1])] = pairs[i][1]
            item[: len(pairs[i][0]), k] = pairs[i][0]
        # the narrowest kind that holds a score and the steps added to it
        kind = np.int16 if width + MATCH * len(item) + 2 < 2**15 else np.int32
        score, run = np.zeros((len(now), width + 1), kind), np.zeros((len(now), width + 1), kind)
        steps = np.arange(width + 1, dtype=kind) * kind(-GAP)
        best, end, longest = (np.zeros(len(now), np.int64) for _ in range(3))
        for word in item:
            same = text == word[:, None]
            step = score + kind(GAP)
            np.maximum(step[:, 1:], score[:, :-1] + (same * kind(MATCH - MISMATCH) + kind(MISMATCH)), out=step[:, 1:])
            np.maximum(step, 0, out=step)
            step += steps
            np.maximum.accumulate(step, axis=1, out=step)
            step -= steps
            score = step
            run[:, 1:] = (run[:, :-1] + kind(1)) * same
            top = score.max(axis=1)
            more = np.flatnonzero(top > best)
            if len(more):
                best[more], end[more] = top[more], score[more].argmax(axis=1)
            np.maximum(longest, run.max(axis=1), out=longest)
        for k, i in enumerate(now):
            out[i] = (int(best[k]), int(end[k]), int(longest[k]))
    return out


class Reach:
    """Which items a text can hold with a score of at least ``coverage`` of the whole item, by bounds that miss none."""

    def __init__(self, items: Items, coverage: float):
        self.numbers = list(items.numbers.values())
        self.need = np.array([coverage * MATCH * len(n) for n in self.numbers]) - 1e-9
        self.words = np.concatenate([*self.numbers, np.zeros(0, np.int64)])
        self.starts = np.cumsum([0, *(len(n) for n in self.numbers)])[:-1]
        self.seen = np.zeros(len(items.vocabulary) + 1, bool)

    def __call__(self, text: np.ndarray) -> list[int]:
        """Places of the items: words of the item that the text has at all, then the best stretch of the text."""
        if not len(text) or not self.numbers:
            return []
        self.seen[text] = True
        self.seen[0] = False
        known = np.add.reduceat(self.seen[self.words].astype(np.int64), self.starts)
        self.seen[text] = False
        out = []
        for k in np.flatnonzero(MATCH * known >= self.need):
            self.seen[self.numbers[k]] = True
            # a word of the text that the item lacks costs one whether it is put beside a word or beside a gap
            total = np.cumsum(np.where(self.seen[text], MATCH, max(MISMATCH, GAP)))
            self.seen[self.numbers[k]] = False
            low = np.minimum.accumulate(np.concatenate(([0], total[:-1])))
            if (total - low).max() >= self.need[k]:
                out.append(int(k))
        return out


def _near(items: Items, coverage: float):
    """The pass over the texts: every document and item that can reach the coverage, aligned over the whole text."""
    reach = Reach(items, coverage)
    get = items.vocabulary.get
    ids = list(items.numbers)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                n = np.array([get(w, 0) for w in words(text)], np.int64)
                pairs += [(doc, ids[k], n.astype(np.int32)) for k in reach(n)]
            got = align_all([(items.numbers[item], n) for _, item, n in pairs])
            out = [
                (doc, item, score, score / (MATCH * len(items.numbers[item])), longest, end)
                for (doc, item, _), (score, end, longest) in zip(pairs, got)
            ]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "score", "coverage", "longest_run", "doc_end"])

    return judge


def leaks(documents: DataFrame, items: DataFrame, coverage: float = 0.5, block: int = BLOCK_ITEMS) -> DataFrame:
    """Every document and test item whose alignment has at least ``coverage`` of the item's score, edited copies included.

    ``documents``: doc_id, text; ``items``: item_id, text. Result: doc_id, item_id, score (Smith-Waterman: +2 equal
    words, -1 unequal, -1 gap), coverage (score over that of the whole item), longest_run (equal consecutive words) and
    doc_end (word of the document after the best alignment). The alignment is that over the whole text. Null and empty
    texts share nothing; repeated documents each have their rows; an item repeated under one id counts with its smallest
    text. Every block of items reads the texts once.
    """
    listed = items.where("item_id IS NOT NULL AND text IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text"))
    texts = spread(documents.select("doc_id", "text"), "doc_id")
    kind = documents.schema["doc_id"].dataType.simpleString()
    item_kind = items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, score long, coverage double, longest_run long, doc_end long"
    out, rows = documents.sparkSession.createDataFrame([], schema), []
    for r in chain(listed.orderBy("item_id").toLocalIterator(), [None]):
        if r is not None:
            rows.append((r["item_id"], r["text"]))
        if rows and (r is None or len(rows) == block):
            out, rows = out.unionByName(texts.mapInPandas(_near(Items(rows), coverage), schema)), []
    return out.where(F.col("coverage") >= coverage)
