"""Sentences, chunks with overlap, and exact vector search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralace.functions.geometry import dot

#: A sentence ends behind . ! or ? before white space, or at an empty line.
SENTENCE = r"(?U)(?<=[.!?])\s+|\n{2,}"
#: White space at the ends of sentences and chunks.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def sentences(text: Column) -> Column:
    """The sentences of a text, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, SENTENCE), lambda s: F.btrim(s, F.lit(BLANKS))), lambda s: s != "")


def chunks(documents: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """Pack sentences greedily into chunks: doc_id, chunk_no, text.

    ``documents``: doc_id, text. A text of at most ``size`` characters is one chunk, as it is. Else a chunk takes
    sentences, joined by a blank, while it stays within ``size`` characters; the next one begins with the last
    ``overlap`` characters of the one before, without blanks at its ends. A sentence longer than ``size`` stays whole.
    Null texts, and texts without any sentence, give no chunk. All of it is one JVM fold per text.
    """
    blanks = F.lit(BLANKS)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(state: Column, s: Column) -> Column:
        now, done = state["now"], state["done"]
        fits = (F.length(now) == 0) | (F.length(now) + 1 + F.length(s) <= size)
        grown = F.when(F.length(now) == 0, s).otherwise(F.concat(now, F.lit(" "), s))
        tail = F.when(F.length(now) > overlap, F.substring(now, -overlap, overlap)).otherwise(now)
        fresh = F.btrim(F.concat(tail, F.lit(" "), s), blanks) if overlap > 0 else s
        return F.when(fits, F.struct(done.alias("done"), grown.alias("now"))).otherwise(
            F.struct(F.array_append(done, now).alias("done"), fresh.alias("now"))
        )

    def finish(state: Column) -> Column:
        return F.when(F.length(state["now"]) > 0, F.array_append(state["done"], state["now"])).otherwise(state["done"])

    packed = F.when(F.length("text") <= size, F.when(F.btrim("text", blanks) != "", F.array("text"))).otherwise(
        F.aggregate(sentences(F.col("text")), start, step, finish)
    )
    return documents.where("text IS NOT NULL").select("doc_id", F.posexplode(packed).alias("chunk_no", "text"))


def shorten(text: Column, n: int) -> Column:
    """The text cut to ``n`` characters at the last blank, with an ellipsis; shorter texts stay as they are."""
    return F.when(F.length(text) > n, F.concat(F.regexp_replace(F.substring(text, 1, n), " [^ ]*$", ""), F.lit("..."))).otherwise(text)


#: Queries that are sent to every task at a time.
BLOCK_QUERIES = 4096


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, block: int = BLOCK_QUERIES) -> DataFrame:
    """The ``k`` vectors of largest inner product for each query: query_id, vec_id, score, place.

    ``queries``: query_id, q; ``vectors``: vec_id, v. A query doesn't find itself. Exact, ties go to the smaller vec_id.
    The queries are a stated set and go through in blocks of a bounded size, each block to every task; a task keeps its
    best ``k`` per query (a group limit below the shuffle of the window) before anything is moved.
    """
    n_blocks = max(1, -(-queries.count() // block))
    out = None
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for b in range(n_blocks):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b) if n_blocks > 1 else queries
        score = F.round(dot(F.col("q"), F.col("v")), 6).alias("score")
        scored = vectors.join(F.broadcast(part), F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", score)
        top = scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
        out = top if out is None else out.unionByName(top)
    return out
