"""Filling fixed-capacity containers with items: bounded-space online best-fit.

A task keeps a fixed number of open bins. A bitset has a bit for each amount of free space that some open bin has; the
lowest bit at or above an item's size is the best fit. If none fits, a new bin opens, and where that would be one too
many, the fullest closes first. What the tasks leave open at their end (a bounded number each) is packed once more.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralace.sources.tables import small_enough, written

CAPACITY = 2048
OPEN_BINS = 64
#: Open bins that one task of the second round packs.
LEFT_PER_TASK = 50_000


class BestFit:
    """Open bins keyed by free space."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits = 0
        self.by_free: dict[int, list[int]] = {}
        self.n_open = 0
        self.next_bin = 0

    def _put(self, bin_no: int, free: int) -> None:
        self.by_free.setdefault(free, []).append(bin_no)
        self.bits |= 1 << free
        self.n_open += 1

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        bin_no = held.pop(0)
        if not held:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return bin_no

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) of an item of at most the capacity."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            bin_no = self._take(free)
        else:
            if self.n_open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, bin_no = self.capacity, self.next_bin
            self.next_bin += 1
        if free > size or size == 0:
            self._put(bin_no, free - size)
        return bin_no, self.capacity - free

    def left(self) -> list[tuple[int, int]]:
        """(bin, filled) of the bins that are open."""
        return sorted((b, self.capacity - free) for free, held in self.by_free.items() for b in held)


def token_counter(path: str | None = None) -> Callable[[list[str]], list[int]]:
    """Counts tokens by the public byte-level vocabulary in ``path`` (ranks, one token a line)."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    coder = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(coder.encode_ordinary(t)) for t in texts]


_SCHEMA = "kind string, doc_id {0}, piece_no int, start_token long, n_tokens int, container_id string, offset int"


def pack_texts(
    documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS
) -> DataFrame:
    """Put the texts into containers: doc_id, piece_no, start_token, n_tokens, container_id, offset.

    ``documents``: doc_id, text. A text is one piece unless it has more than ``capacity`` tokens; then it is cut into
    full containers and a rest. A null or empty text is a piece of no tokens. Repeated ids and texts are items of their
    own. ``tokenizer`` is the path of the vocabulary. The packing depends only on the order of the rows in the files
    and on how these are split, so a task that is run again gives the same containers.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    columns = ["kind", "doc_id", "piece_no", "start_token", "n_tokens", "container_id", "offset"]

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        count = token_counter(tokenizer)
        bins, whole = BestFit(capacity, open_bins), 0
        for batch in batches:
            out = []
            sizes = count([t or "" for t in batch["text"]])
            for doc, size in zip(batch["doc_id"], sizes):
                at = piece = 0
                while size - at > capacity or size - at == capacity and size > capacity:
                    out.append(("piece", doc, piece, at, capacity, f"f{task}-{whole}", 0))
                    whole, at, piece = whole + 1, at + capacity, piece + 1
                if size > at or not piece:
                    b, offset = bins.place(size - at)
                    out.append(("piece", doc, piece, at, size - at, f"b{task}-{b}", offset))
            yield pd.DataFrame(out, columns=columns)
        # only bins that a later item could still have gone into
        yield pd.DataFrame([("open", None, None, None, filled, f"b{task}-{b}", None) for b, filled in bins.left()], columns=columns).astype(
            {"piece_no": "Int32", "start_token": "Int64", "offset": "Int32", "doc_id": "Int64" if kind == "bigint" else "object"}
        )

    placed = written(documents.select("doc_id", "text").mapInPandas(first, _SCHEMA.format(kind)), "pieces")
    left = placed.where("kind = 'open'").select("container_id", F.col("n_tokens").alias("filled"))
    tasks = max(1, -(-left.count() // LEFT_PER_TASK))

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        bins = BestFit(capacity, open_bins)
        for batch in batches:
            rows = [bins.place(int(size)) for size in batch["filled"]]
            yield pd.DataFrame(
                {"container_id": batch["container_id"], "into": [f"m{task}-{b}" for b, _ in rows], "shift": [o for _, o in rows]}
            )

    # fullest first, as best-fit decreasing; the order within a task is fixed, whatever order the rows arrive in
    sorted_left = left.repartition(tasks, "container_id").sortWithinPartitions(F.desc("filled"), "container_id")
    merged = written(sorted_left.mapInPandas(second, "container_id string, into string, shift int"), "merged")
    pieces = placed.where("kind = 'piece'").drop("kind")
    merged = F.broadcast(merged) if small_enough(merged) else merged
    return pieces.join(merged, "container_id", "left").select(
        "doc_id", "piece_no", "start_token", "n_tokens", F.coalesce("into", "container_id").alias("container_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def containers(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per container: container_id, n_pieces, n_tokens, free."""
    return pieces.groupBy("container_id").agg(
        F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"), (F.lit(capacity) - F.sum("n_tokens")).alias("free")
    )
