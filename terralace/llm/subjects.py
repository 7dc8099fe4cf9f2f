"""Subject areas of documents: a seeded non-negative factorisation of the passage-term matrix.

The texts are read once: the matrix holds the terms of every passage of every document as hashes. Terms that labelled
documents tie to a subject (against how often the subject occurs in documents of that language) anchor one component per
subject. The updates then alternate over the passages of all documents, non-negative and multiplicative: mixtures of the
passages for fixed components, components for fixed mixtures. The first of them is taken over the whole vocabulary: every
term that the passages of a subject have clearly more often than others joins the components, with or without a label;
the rest is background and leaves the matrix. The anchors are kept as prior mass. A document is about a subject if one
of its passages has enough of it; a word in passing is not enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralace.llm.words import passage_hashes
from terralace.sources.tables import spread, written

#: Labelled documents that seeds are learnt from, at most (those with the smallest hashes of their ids).
MOST_LABELLED = 200_000
#: A term anchors if it is in this many labelled documents, and this many times as often under a subject as expected;
#: where subjects are so few that this cannot be, with this part of its documents; and beyond so many deviations.
LEAST_DOCUMENTS, LEAST_LIFT, LEAST_PURITY, LEAST_DEVIATIONS = 2, 4.0, 0.5, 3.0
#: A term without anchor joins by the same rule over passages, but clearer, as there are many more of them: beyond so many
#: deviations, and with this part of its tie to one subject. It must be in this share of the passages (and this many), which
#: bounds the components by the terms of a passage over the share, whatever the number of documents.
LEAST_PASSAGES, TERM_SHARE, JOIN_DEVIATIONS, JOIN_PURITY = 5, 1e-4, 8.0, 0.8
#: The alternation ends when no component moves by more than ``SETTLED`` of its mass, after ``ROUNDS`` at the latest.
ROUNDS, SETTLED, INNER, LAST = 4, 0.02, 4, 8
PRIOR = 1.0
#: A passage is about a subject from this many of its terms, and this share of all its subject terms.
LEAST_TERMS, LEAST_SHARE = 2.0, 0.4
#: Sums of terms that a task keeps before it hands them on.
KEPT_SUMS = 1_000_000
#: Bytes of text that are cut into terms at a time, and terms whose mixtures are fitted at a time; a longer text or passage is taken whole.
TEXT_AT_ONCE, TERMS_AT_ONCE = 1 << 20, 1 << 13


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    """A column of lists of these sizes, that follow each other in ``values``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values))


def passage_terms(documents: DataFrame) -> DataFrame:
    """The matrix: doc_id, lang, terms (hashes, passage by passage), ends (of the passages). No row without a term."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            edges = np.flatnonzero(np.diff(size // TEXT_AT_ONCE, prepend=-1, append=-1)).tolist()
            for at, to in zip(edges[:-1], edges[1:]):
                part = batch.slice(at, to - at)
                hashes, n_words, n_passages = passage_hashes(part.column("text").to_pylist())
                upto = np.concatenate(([0], np.cumsum(n_words)))
                begin, end = upto[np.cumsum(n_passages) - n_passages], upto[np.cumsum(n_passages)]
                rows = np.flatnonzero(n_passages)
                ends = (upto[1:] - np.repeat(begin, n_passages)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(rows)), part.column("lang").take(pa.array(rows)), _lists((end - begin)[rows], hashes.view(np.int64)), _lists(n_passages[rows], ends)],
                    ["doc_id", "lang", "terms", "ends"],
                )

    texts = spread(documents.select("doc_id", F.coalesce(F.lower("lang"), F.lit("")).alias("lang"), "text"), "doc_id")
    return texts.mapInArrow(scan, f"doc_id {kind}, lang string, terms array<long>, ends array<int>")


def tied(seen: DataFrame, met: DataFrame, base: DataFrame, least: float, deviations: float = LEAST_DEVIATIONS, purity: float = 0.0) -> DataFrame:
    """Terms tied to subjects: term, subject, tie (times as often as expected), all subjects of each term that has one.

    ``seen``: term, subject, weight; ``met``: lang, term, weight; ``base``: lang, subject, share (of what is met in that
    language). A term is kept if it is met ``least`` times and some subject passes the bounds above, with ``purity`` of
    all its ties.
    """
    common = base.groupBy("subject").agg(F.sum("all").alias("common"))
    common = common.crossJoin(F.broadcast(common.agg(F.sum("common").alias("total"))))  # one row
    bounds = common.select("subject", F.least(F.lit(LEAST_LIFT), LEAST_PURITY * F.col("total") / F.col("common")).alias("bound"))
    often = met.groupBy("term").agg(F.sum("weight").alias("n")).where(F.col("n") >= least - 1e-6)
    # a row of base for every language and subject: few
    expected = met.join(often, "term").join(F.broadcast(base), "lang").groupBy("term", "subject").agg(
        F.sum(F.col("weight") * F.col("share")).alias("expected"), F.first("n").alias("n")
    )
    rows = expected.join(seen.groupBy("term", "subject").agg(F.sum("weight").alias("seen")), ["term", "subject"], "left")
    rows = rows.na.fill(0.0, ["seen"]).join(F.broadcast(bounds), "subject").where("expected > 0")
    flat = 0.5 / F.col("n")  # half a document more, spread as expected, so that one sight is no proof
    lift = (F.col("seen") + flat * F.col("expected")) / (F.col("expected") * (1 + flat))
    clear = F.col("seen") - F.col("expected") >= deviations * F.sqrt("expected")
    rows = rows.withColumns({"tie": F.col("seen") / F.col("expected"), "fit": (lift >= F.col("bound")) & clear})
    ties = rows.groupBy("term").agg(F.max(F.when(F.col("fit"), F.col("tie"))).alias("best"), F.sum("tie").alias("ties"))
    return rows.join(ties.where(F.col("best") >= purity * F.col("ties")).select("term"), "term").select("term", "subject", "tie")


def anchors(matrix: DataFrame, labels: DataFrame, subjects: list[str], bound: int = MOST_LABELLED) -> DataFrame:
    """The anchoring terms: term, subject, tie. A document with several subjects gives each an equal part of its weight."""
    marked = labels.where("doc_id IS NOT NULL").where(F.col("subject").isin(subjects)).groupBy("doc_id")
    marked = marked.agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    chosen = written(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound), "labelled")
    # at most ``bound`` rows, so that the matrix is not shuffled
    rows = matrix.join(F.broadcast(chosen), "doc_id").withColumn("part", 1 / F.size("subjects"))
    rows = written(rows.select("lang", F.array_distinct("terms").alias("terms"), "subjects", "part"), "labelled-terms")
    seen = rows.select("lang", F.explode("terms").alias("term"), "subjects", "part").select("lang", "term", F.explode("subjects").alias("subject"), "part")
    seen = written(seen.groupBy("lang", "term", "subject").agg(F.sum("part").alias("weight")), "label-counts")
    whole = rows.select("lang", F.explode("subjects").alias("subject"), "part").groupBy("lang", "subject").agg(F.sum("part").alias("all"))
    met = seen.groupBy("lang", "term").agg(F.sum("weight").alias("weight"))
    return tied(seen, met, _shares(whole, rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))), LEAST_DOCUMENTS)


def _shares(whole: DataFrame, met: DataFrame) -> DataFrame:
    """lang, subject, all, share of all that is met (n) in the language."""
    return whole.join(met, "lang").select("lang", "subject", "all", (F.col("all") / F.col("n")).alias("share"))


class Components:
    """Term hashes in order and their loadings, term x subject (columns sum to 1)."""

    def __init__(self, rows: list, subjects: list[str]):
        place = {s: i for i, s in enumerate(subjects)}
        self.terms = np.array(sorted({r["term"] for r in rows}), np.int64)
        tie = np.zeros((len(self.terms), len(subjects)))
        if rows:
            tie[np.searchsorted(self.terms, [r["term"] for r in rows]), [place[r["subject"]] for r in rows]] = [r["tie"] for r in rows]
        tie /= np.maximum(tie.sum(1, keepdims=True), 1e-9)
        self.prior = tie / np.maximum(tie.sum(0), 1e-9)
        self.bits = np.zeros(1 << (16 * len(self.terms)).bit_length(), bool)  # by the last bits of the terms
        self.bits[self.terms & (len(self.bits) - 1)] = True

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """The places of term hashes, -1 for those in no component."""
        out = np.full(len(terms), -1)
        may = np.flatnonzero(self.bits[terms & (len(self.bits) - 1)])  # most terms end here
        at = np.minimum(np.searchsorted(self.terms, terms[may]), len(self.terms) - 1)
        out[may] = np.where(self.terms[at] == terms[may], at, -1)
        return out


def _stacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, first term of each passage, passage of each term, row of each passage) of a batch."""
    lengths = batch.column("terms").value_lengths().to_numpy()
    passages = batch.column("ends").value_lengths().to_numpy()
    ends = batch.column("ends").flatten().to_numpy() + np.repeat(np.cumsum(lengths, dtype=np.int64) - lengths, passages)
    terms, starts = batch.column("terms").flatten().to_numpy(), np.concatenate(([0], ends))[:-1]
    return terms, starts, np.repeat(np.arange(len(starts)), ends - starts), np.repeat(np.arange(batch.num_rows), passages)


def mixtures(terms: np.ndarray, starts: np.ndarray, parts: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Fit the mixtures of passages for fixed components: (terms of each subject by passage, shares of each term).

    ``parts``: term x subject. Multiplicative updates that keep all numbers non-negative. Passages don't depend on each
    other, so that blocks of them that a cache holds are fitted one after the other.
    """
    n_subjects = parts.shape[1]
    columns = np.ascontiguousarray(parts.T)
    mass, q = np.empty((n_subjects, len(starts))), np.empty((n_subjects, len(terms)))
    edges = np.flatnonzero(np.diff(starts // TERMS_AT_ONCE, prepend=-1, append=-1))
    bounds = np.concatenate((starts, [len(terms)]))
    for at, to in zip(edges[:-1], edges[1:]):
        begin, end = bounds[at], bounds[to]
        first, sizes = starts[at:to] - begin, np.diff(bounds[at : to + 1])
        held = columns.take(terms[begin:end], 1)
        w = np.full((n_subjects, to - at), 1 / n_subjects, np.float32)
        for _ in range(rounds):
            share = np.repeat(w, sizes, 1)
            share *= held
            share /= share.sum(0) + 1e-12
            m = np.add.reduceat(share, first, 1)
            w = (m + 0.01) / (sizes + 0.01 * n_subjects)
        mass[:, at:to], q[:, begin:end] = m, share
    return mass.T, q.T


def _about(mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether passages are about subjects, and the shares of the subjects in them."""
    share = mass / np.maximum(mass.sum(1, keepdims=True), 1e-9)
    return (mass >= LEAST_TERMS - 1e-3) & (share >= LEAST_SHARE), share


def widened(matrix: DataFrame, first: Components, subjects: list[str]) -> DataFrame:
    """The first update of the components, over all terms of all passages: term, subject, tie of those that join.

    Each passage that the anchors show to be about subjects gives its terms to them by its mixture; the terms of the
    other passages are met under no subject.
    """
    parts = (first.prior + 1e-9).astype(np.float32)
    n_subjects = len(subjects)

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def summed(lang: str) -> tuple[np.ndarray, np.ndarray]:
            terms, back = np.unique(np.concatenate([t for t, _ in kept[lang]]), return_inverse=True)
            mass = np.concatenate([m for _, m in kept[lang]])
            return terms, np.stack([np.bincount(back, mass[:, s], len(terms)) for s in range(n_subjects + 1)], 1)

        def rows(lang: str, terms: np.ndarray, mass: np.ndarray) -> pa.RecordBatch:
            t, s = np.nonzero(mass)
            return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(t), pa.string()), "term": terms[t], "part": s.astype(np.int32), "weight": mass[t, s]})

        for whole in batches:
            for lang in whole.column("lang").unique().to_pylist():
                batch = whole.filter(pc.equal(whole.column("lang"), lang))
                terms, starts, passage, _ = _stacked(batch)
                coded = pa.array(terms).dictionary_encode()
                distinct, place = coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)
                number = first.numbers(distinct)[place]
                known = number >= 0
                # a term that a passage repeats counts once
                bits = len(starts).bit_length()
                pairs = np.sort((place << bits) | passage)
                pairs = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))]
                t, p = pairs >> bits, pairs & ((1 << bits) - 1)
                given = np.zeros((len(distinct), n_subjects + 1))  # the last column: met at all
                given[:, -1] = np.bincount(t, minlength=len(distinct))
                if known.any():
                    held, begin = np.unique(passage[known], return_index=True)
                    mass, _ = mixtures(number[known], begin, parts, INNER)
                    about, share = _about(mass)
                    for s in np.flatnonzero(about.any(0)):
                        shares = np.zeros(len(starts))
                        shares[held[about[:, s]]] = share[about[:, s], s]
                        some = shares[p] > 0
                        given[:, s] = np.bincount(t[some], shares[p[some]], len(distinct))
                kept.setdefault(lang, []).append((distinct, given))
            for lang in list(kept):
                if len(kept[lang]) > 8:
                    kept[lang] = [summed(lang)]
                    if len(kept[lang][0][0]) > KEPT_SUMS:
                        yield rows(lang, *kept.pop(lang)[0])
        for lang in kept:
            yield rows(lang, *summed(lang))

    sums = matrix.select("lang", "terms", "ends").mapInArrow(update, "lang string, term long, part int, weight double")
    sums = written(sums.groupBy("lang", "term", "part").agg(F.sum("weight").alias("weight")), "term-sums")
    names = F.array(*[F.lit(s) for s in subjects])
    met = sums.where(F.col("part") == n_subjects).select("lang", "term", "weight")
    seen = sums.where(F.col("part") < n_subjects).select("lang", "term", names[F.col("part")].alias("subject"), "weight")
    n = matrix.groupBy("lang").agg(F.sum(F.size("ends")).alias("n"))
    n_passages = n.agg(F.sum("n")).first()[0] or 0
    # how often terms of a language are met under a subject, against how often they are met
    whole = seen.groupBy("lang", "subject").agg(F.sum("weight").alias("all"))
    base = _shares(whole, met.groupBy("lang").agg(F.sum("weight").alias("n")))
    return tied(seen.drop("lang"), met, base, max(LEAST_PASSAGES, TERM_SHARE * n_passages), JOIN_DEVIATIONS, JOIN_PURITY)


def compact(matrix: DataFrame, found: Components) -> DataFrame:
    """The matrix over the terms of the components only: doc_id, terms (their places), ends."""
    kind = matrix.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, _, passage, owner = _stacked(batch)
            number = found.numbers(terms)
            known = number >= 0
            sizes = np.bincount(passage[known], minlength=len(owner))  # terms that are left, by passage
            held = sizes > 0
            n_terms = np.bincount(owner, sizes, batch.num_rows).astype(np.int64)
            n_passages = np.bincount(owner[held], minlength=batch.num_rows)
            rows = np.flatnonzero(n_passages)
            ends = np.cumsum(sizes[held]) - np.repeat(np.cumsum(n_terms) - n_terms, n_passages)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows)), _lists(n_terms[rows], number[known].astype(np.int32)), _lists(n_passages[rows], ends.astype(np.int32))],
                ["doc_id", "terms", "ends"],
            )

    return matrix.select("doc_id", "terms", "ends").mapInArrow(cut, f"doc_id {kind}, terms array<int>, ends array<int>")


def fit(matrix: DataFrame, prior: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Alternate the updates over all passages, starting from ``prior``; term x subject, columns sum to 1."""
    n_terms, n_subjects = prior.shape
    parts = prior.copy()
    for _ in range(rounds):
        now = parts.astype(np.float32) + np.float32(1e-9)

        def update(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n_terms, n_subjects))
            for batch in batches:
                if batch.num_rows:
                    terms, starts, passage, _ = _stacked(batch)
                    _, q = mixtures(terms, starts, now, INNER)
                    # a term that a passage repeats counts once, so that no long text bends a component
                    _, place, times = np.unique(passage * n_terms + terms, return_inverse=True, return_counts=True)
                    once = 1 / times[place]
                    for s in range(n_subjects):
                        total[:, s] += np.bincount(terms, q[:, s] * once, n_terms)
            t, s = np.nonzero(total)
            yield pa.RecordBatch.from_pydict({"term": t.astype(np.int32), "part": s.astype(np.int32), "mass": total[t, s]})

        sums = matrix.select("terms", "ends").mapInArrow(update, "term int, part int, mass double")
        # the components themselves: one row per term and subject
        rows = sums.groupBy("term", "part").agg(F.sum("mass").alias("mass")).toPandas()
        mass = np.zeros((n_terms, n_subjects))
        mass[rows["term"], rows["part"]] = rows["mass"]
        new = mass + PRIOR * prior * np.maximum(mass.sum(0), 1.0)
        new /= np.maximum(new.sum(0), 1e-9)
        moved = np.abs(new - parts).sum(0).max()
        parts = new
        if moved <= SETTLED:
            break
    return parts


def assign(matrix: DataFrame, parts: np.ndarray, subjects: list[str]) -> DataFrame:
    """Subjects of documents: doc_id, subject, weight (share of the subject in the document's subject terms), about.

    ``about`` says that some passage has enough of the subject; a row is there for every subject with a tenth of a term.
    """
    kind = matrix.schema["doc_id"].dataType.simpleString()
    now = parts.astype(np.float32) + np.float32(1e-9)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(subjects, pa.string())
        for batch in batches:
            if not batch.num_rows:
                continue
            terms, starts, _, owner = _stacked(batch)
            mass, _ = mixtures(terms, starts, now, LAST)
            about, _ = _about(mass)
            first = np.searchsorted(owner, np.arange(batch.num_rows))
            whole = np.add.reduceat(mass, first, 0)
            any_about = np.logical_or.reduceat(about, first, 0)
            weight = whole / np.maximum(whole.sum(1, keepdims=True), 1e-9)
            d, s = np.nonzero((whole >= 0.1) | any_about)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(d)), names.take(pa.array(s)), pa.array(weight[d, s]), pa.array(any_about[d, s])],
                ["doc_id", "subject", "weight", "about"],
            )

    return matrix.mapInArrow(judge, f"doc_id {kind}, subject string, weight double, about boolean")


def subject_areas(documents: DataFrame, labels: DataFrame, areas: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Assign subject areas: doc_id, subject, weight, about.

    ``documents``: doc_id, text, lang; ``labels``: doc_id, subject, some of them wrong; ``areas``: subject. Subjects
    that no label names get no document. Null and empty texts, and texts without subject terms, have no row. Repeated
    documents each have their rows. Without labels the result is empty. ``rounds`` of 0 leaves out the updates of the
    components: the anchors alone then decide.
    """
    subjects = sorted(r["subject"] for r in areas.where("subject IS NOT NULL").select("subject").distinct().collect())
    kind = documents.schema["doc_id"].dataType.simpleString()
    nothing = documents.sparkSession.createDataFrame([], f"doc_id {kind}, subject string, weight double, about boolean")
    if not subjects:
        return nothing
    matrix = written(passage_terms(documents), "passage-terms")
    seeds = anchors(matrix, labels, subjects).collect()  # the anchors: bounded by the labelled sample
    if not seeds:
        return nothing
    found = Components(seeds, subjects)
    if rounds:
        known = set(found.terms.tolist())
        joined = [r for r in widened(matrix, found, subjects).collect() if r["term"] not in known]
        found = Components([*seeds, *joined], subjects)
    held = written(compact(matrix, found), "subject-terms")
    return assign(held, fit(held, found.prior, rounds), subjects)
