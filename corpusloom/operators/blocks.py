"""Postings in blocks with score bounds: searches for the best few open the blocks that can matter.

Chunks are dealt to buckets by a hash of their number, so a block (term, bucket)
is small whatever the term, and carries the greatest gain of its postings.  The
sum of a query's bounds in a bucket is more than any chunk there can score.  A
search scores each query's most promising buckets, takes the k-th score as the
floor, and opens no other bucket whose bound stays below it.  Blocks lie sorted
by term, so files and pages without a query's terms are passed over as well.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import corpus as C
from corpusloom.operators.retrieval import BROADCAST_TERMS, K1, B, query_terms, summed
from corpusloom.session import checkpointed, dealt, written

#: Chunks of a bucket, on average.
CHUNKS = 32
#: Postings that one task gathers into blocks, or joins in them.
POSTINGS = 4_000_000
#: Terms up to which they are written into the scan's filter.
FILTER_TERMS = 1_000
#: Values that a pushed ``IN`` keeps apart; Spark turns longer lists into one range.
_APART = 10
#: What sums in another order may differ by.
_SLACK = 1e-8


@dataclass(frozen=True)
class Blocks:
    """term, bucket, n, top, rows (seq, tf, dl); how many chunks there are, their mean number of terms, and chunks of a bucket."""

    table: DataFrame
    chunks: int
    avgdl: float
    size: int = CHUNKS


def gain(tf: Column, dl: Column, avgdl: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def build(post: DataFrame, chunks: DataFrame, size: int = CHUNKS) -> Blocks:
    """Blocks of all postings, written once: one shuffle, by ranges of (term, bucket), which also parts frequent terms."""
    n, avgdl = C.corpus_stats(chunks, post).first()  # two numbers
    buckets = max(1, -(-n // size))
    parts = dealt(post, math.ceil(n * avgdl), POSTINGS)  # terms, so no fewer
    placed = post.withColumn("bucket", F.pmod(F.xxhash64("seq"), F.lit(buckets))).repartitionByRange(parts, "term", "bucket")
    rows = placed.groupBy("term", "bucket").agg(
        F.count("*").alias("n"), F.max(gain(F.col("tf"), F.col("dl"), avgdl)).alias("top"), F.collect_list(F.struct("seq", "tf", "dl")).alias("rows")
    )
    return Blocks(written(rows.sortWithinPartitions("term", "bucket")), n, avgdl, size)


def _with_terms(table: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows of these terms (term); a few terms also become a filter that Parquet statistics answer."""
    few = terms.limit(FILTER_TERMS + 1).collect()  # FILTER_TERMS at most are used
    if len(few) > FILTER_TERMS:
        return table
    words = sorted(r[0] for r in few)
    parts = [F.col("term").isin(words[i : i + _APART]) for i in range(0, len(words), _APART)]
    return table.where(reduce(lambda a, b: a | b, parts, F.lit(False)))


def _small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it has been counted as small."""
    return F.broadcast(df) if df.count() <= BROADCAST_TERMS else df


class Search:
    """The blocks that the best ``k`` of each query can be in: ``told`` (query_id, term, w), ``first`` and ``rest`` (query_id, bucket)."""

    def __init__(self, blocks: Blocks, queries: DataFrame, k: int, factor: float = 1.0, extra: float = 0.0) -> None:
        self.avgdl, self.size, self.postings = blocks.avgdl, blocks.size, blocks.chunks * blocks.avgdl  # no fewer than there are
        asked = checkpointed(query_terms(queries))
        terms = checkpointed(asked.select("term").distinct())
        self.table = _with_terms(blocks.table, terms)
        near = written(self.table.select("term", "bucket", "n", "top").join(_small(terms), "term", "left_semi"))  # no postings are read
        df = near.groupBy("term").agg(F.sum("n").alias("df"))
        weight = F.ln(1 + (blocks.chunks - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("qf")
        self.told = checkpointed(asked.join(df, "term").select("query_id", "term", weight.alias("w")))
        bound = F.sum(F.col("w") * F.col("top")).alias("bound")
        self.places = written(near.join(_small(self.told), "term").groupBy("query_id", "bucket").agg(bound))
        turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "bucket"))
        self.first = checkpointed(self.places.withColumn("turn", turn).where(F.col("turn") <= k).select("query_id", "bucket"))  # k rows a query
        self.seen = written(self.score(self.first))
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bm25").desc()))
        kth = self.seen.withColumn("turn", best).where(F.col("turn") == k).select("query_id", F.col("bm25").alias("floor"))  # a row a query
        left = self.places.join(_small(self.first), ["query_id", "bucket"], "left_anti").join(_small(checkpointed(kth)), "query_id", "left")
        able = (F.col("bound") + extra) * factor + _SLACK >= F.coalesce("floor", F.lit(0.0))
        self.rest = checkpointed(left.where(able).select("query_id", "bucket"))

    def score(self, places: DataFrame) -> DataFrame:
        """query_id, seq, bm25 of all chunks in these buckets."""
        wanted = checkpointed(places.join(_small(self.told), "query_id"))
        count = wanted.count()
        parts = dealt(wanted, max(count, self.postings), POSTINGS)  # the table is dealt as they are
        wanted = F.broadcast(wanted) if count <= BROADCAST_TERMS else wanted.repartition(parts, "term", "bucket")
        rows = self.table.join(wanted, ["term", "bucket"]).select("query_id", "w", F.inline("rows"))
        gains = rows.select("query_id", "seq", (F.col("w") * gain(F.col("tf"), F.col("dl"), self.avgdl)).alias("bm25"))
        return summed(gains, places.count() * self.size)

    def hits(self) -> DataFrame:
        return self.seen.unionByName(self.score(self.rest))

    def share(self) -> tuple[int, int]:
        """Blocks opened and blocks of the queries' terms, each counted for every query."""
        near = self.table.select("term", "bucket").join(self.told, "term")
        opened = near.join(self.first.unionByName(self.rest), ["query_id", "bucket"], "left_semi")
        return opened.count(), near.count()


def bm25_best(blocks: Blocks, queries: DataFrame, k: int, factor: float = 1.0, extra: float = 0.0) -> DataFrame:
    """The rows of ``retrieval.bm25`` that the best ``k`` of each query are among, and others of the same buckets.

    ``factor`` and ``extra`` are what a later step may multiply a score by and add
    to it before: no chunk is missing whose score so raised reaches the k-th.
    Queries with fewer than ``k`` hits in their first buckets get all hits; none
    come of queries without terms or of an index without chunks.
    """
    return Search(blocks, queries, k, factor, extra).hits()
