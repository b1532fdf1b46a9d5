"""Which URLs a crawl has asked for already: a Bloom filter in front of an exact join.

Each round's URLs set their bits in a filter of stated size; tasks set bits in
segments of their own, which Spark merges by ``or``.  A candidate that the
filter does not know is new for certain and is shuffled no more; only those that
it may know are joined with the table of visited URLs.  So the filter decides
what is joined, never what is dropped: a wrong "maybe" costs a row in the join.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Greatest size of a filter: 2 ** 27 bits are 16 MB, 14 million URLs at one error in a hundred; more URLs raise the errors, not the size.
MOST_BITS = 1 << 27
#: Bytes of the segments in which tasks return their bits.
SEGMENT = 1 << 16


def _places(h1: np.ndarray, h2: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """The bits of each URL, a row a hash."""
    a, b = h1.astype(np.uint64), h2.astype(np.uint64) | np.uint64(1)
    return np.stack([(a + np.uint64(k) * b) % np.uint64(bits) for k in range(hashes)])


class Visited:
    """Visited URLs as a table, and a filter over them."""

    def __init__(self, spark: SparkSession, expected: int, error: float = 0.01) -> None:
        wanted = math.ceil(max(expected, 1) * -math.log(error) / math.log(2) ** 2)
        self.spark = spark
        self.bits = min(MOST_BITS, max(1024, -(-wanted // 8) * 8))
        self.hashes = max(1, min(16, round(self.bits / max(expected, 1) * math.log(2))))
        self.map = np.zeros(self.bits // 8, np.uint8)
        self.urls = spark.createDataFrame([], "url string")

    def add(self, urls: DataFrame) -> None:
        """A round's URLs (url), a table that can be read again."""
        bits, hashes = self.bits, self.hashes

        def run(batches):
            import pyarrow as pa

            own = np.zeros(bits // 8, np.uint8)
            for b in batches:
                at = _places(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy().view(np.uint64), bits, hashes).ravel()
                np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))
            parts = [(k, own[i : i + SEGMENT]) for k, i in enumerate(range(0, len(own), SEGMENT))]
            parts = [(k, p.tobytes()) for k, p in parts if p.any()]
            yield pa.record_batch([pa.array([k for k, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], ["segment", "part"])

        def merge(batches):
            import pyarrow as pa

            found: dict[int, np.ndarray] = {}  # segments of this task; all of them are MOST_BITS at most
            for b in batches:
                for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    p = np.frombuffer(p, np.uint8)
                    found[k] = found[k] | p if k in found else p
            yield pa.record_batch([pa.array(list(found), pa.int32()), pa.array([p.tobytes() for p in found.values()], pa.binary())], ["segment", "part"])

        told = urls.where("url is not null").select(F.xxhash64("url").alias("a"), F.xxhash64("url", F.lit(1)).alias("b"))
        kind = "segment int, part binary"
        for r in told.mapInArrow(run, kind).repartition("segment").mapInArrow(merge, kind).collect():  # the filter, MOST_BITS at most
            i = r[0] * SEGMENT
            self.map[i : i + SEGMENT] |= np.frombuffer(r[1], np.uint8)
        self.urls = self.urls.union(urls.select("url"))

    def maybe(self):
        """A function of two hashes: whether the filter may know the URL."""
        shared, bits, hashes = self.spark.sparkContext.broadcast(self.map), self.bits, self.hashes  # MOST_BITS at most

        @F.pandas_udf("boolean")
        def known(a: pd.Series, b: pd.Series) -> pd.Series:
            at = _places(a.to_numpy().view(np.uint64), b.to_numpy().view(np.uint64), bits, hashes)
            hit = (shared.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            return pd.Series(hit.all(axis=0))

        return known(F.xxhash64("url"), F.xxhash64("url", F.lit(1)))

    def unvisited(self, candidates: DataFrame) -> DataFrame:
        """The candidates (url and more) that were not asked for; those without a URL stay."""
        maybe = self.maybe()
        new, old = candidates.where("url is null").unionByName(candidates.where(F.col("url").isNotNull() & ~maybe)), candidates.where(F.col("url").isNotNull() & maybe)
        return new.unionByName(old.join(self.urls.distinct(), "url", "left_anti").select(*candidates.columns))
