"""Connected components of an edge table that never leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, release


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long) but the roots.

    Large-star and small-star steps alternate: each node hooks onto the least
    node it sees, until the edge set no longer changes.  A step is a partially
    aggregated minimum and an equi-join, so a hub's edges never meet in one
    row; the tables are written out after each round, and those of the round
    before are deleted.  Two numbers a round go to the driver.  Self-loops,
    repeated edges and an empty table are fine.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    e = cut(e)
    seen = _mark(e)
    while seen[0]:
        both = e.union(e.select("u", "v")).toDF("x", "y")
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u"))
        large = large.where("v <> u").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(
            F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")
        )
        before, e = e, cut(small.select("e.v", "e.u").where("v <> u").distinct())
        release(before)
        now = _mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("v").alias("node"), F.col("u").alias("root"))


def _mark(e: DataFrame) -> tuple:
    """Row count and an order-free checksum of an edge table."""
    h = F.xxhash64("v", "u")
    row = e.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.sum(h.bitwiseAND(F.lit(0xFFFFF)))).first()
    return tuple(row)
