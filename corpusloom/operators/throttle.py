"""Adaptive throttling and lane schedules as windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _joined(events: DataFrame, lane: str, before: DataFrame | None, column: str, name: str) -> DataFrame:
    """``name``: what earlier events of the lane left behind in ``column``, null if nothing; lanes may be null."""
    if before is None:
        return events.withColumn(name, F.lit(None).cast("long"))
    b = before.select(F.col(lane).alias("__lane"), F.col(column).cast("long").alias(name))
    return events.join(b, F.col(lane).eqNullSafe(F.col("__lane")), "left").drop("__lane")


def error_counter(events: DataFrame, lane: str, order: list[str], ok: str = "ok", before: DataFrame | None = None) -> DataFrame:
    """``errors``: +1 for a failure, -1 for a success, never below 0.

    With S the running sum, the floored walk is S minus the least of 0 and S so
    far.  ``before`` (lane, errors) has the counts at which lanes begin.
    """
    events = _joined(events, lane, before, "errors", "__from")
    w = Window.partitionBy(lane).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    s = events.withColumn("__s", F.coalesce("__from", F.lit(0)) + F.sum(F.when(F.col(ok), -1).otherwise(1)).over(w))
    return s.withColumn("errors", (F.col("__s") - F.least(F.lit(0), F.min("__s").over(w))).cast("int")).drop("__s", "__from")


def backoff(counted: DataFrame, ok: str = "ok") -> DataFrame:
    """``wait_ms`` after each failure, 0 after a success."""
    n = F.col("errors")
    slow = F.when(n >= 5, F.least(F.lit(30000), 3000 * n)).otherwise(F.least(F.lit(15000), (1000 * F.pow(F.lit(2.0), n - 1)).cast("int")))
    return counted.withColumn("wait_ms", F.when(F.col(ok) | (n == 0), 0).otherwise(slow))


def penalty(counted: DataFrame, lane: str, order: list[str], at_ms: str, ok: str = "ok", before: DataFrame | None = None) -> DataFrame:
    """``penalty_ms`` at each event: what is left of a cooldown, else by the counter; ``until_ms``: when the last cooldown ends.

    ``before`` (lane, until_ms) has the cooldowns that lanes begin in.
    """
    w = Window.partitionBy(lane).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    waits = _joined(backoff(counted, ok), lane, before, "until_ms", "__until")
    until = F.max(F.when(~F.col(ok) & (F.col("errors") >= 5), F.col(at_ms) + F.col("wait_ms"))).over(w)
    told = waits.withColumn("until_ms", F.greatest(until, F.col("__until")).cast("long")).drop("__until")
    left = F.col("until_ms") - F.col(at_ms)
    by_count = F.when(F.col("errors") >= 2, F.least(F.lit(8000), 800 * F.col("errors"))).otherwise(0)
    return told.withColumn("penalty_ms", F.when(left > 0, left).otherwise(by_count))


BLOCKS = 1024


def lane_schedule(
    requests: DataFrame, lanes: int, gap_ms: int, at_ms: str, order: list[str], blocks: int = BLOCKS, penalty_ms: str | None = None,
    begun: int = 0, last: DataFrame | None = None,
) -> DataFrame:
    """Requests dealt round-robin to lanes; a lane starts one at a time, ``gap_ms``
    and the request's own penalty apart, and lanes are staggered by a fifth of the gap.

    ``order`` must follow ``at_ms``.  With G the running sum of gaps, a start is
    G plus the greatest of arrival - G so far.  Numbers, sums and maxima over
    all requests are put together out of time blocks: each block is worked out
    by itself, and a table of ``blocks`` rows a lane carries them across.
    ``begun`` requests came before these, and ``last`` (lane, start_ms) has the
    lanes' last starts.
    """
    low, high = requests.agg(F.min(at_ms), F.max(at_ms)).first()  # two numbers
    width = max(1, -(-((high or 0) - (low or 0) + 1) // blocks))
    n = requests.withColumn("__b", F.floor((F.col(at_ms) - F.lit(low)) / width).cast("int"))
    across = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # ``blocks`` rows
    first = n.groupBy("__b").agg(F.count("*").alias("n")).select("__b", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("__first"))
    n = n.join(F.broadcast(first), "__b")
    number = F.lit(begun) + F.col("__first") + F.row_number().over(Window.partitionBy("__b").orderBy(*order)) - 1
    n = n.withColumn("number", number).withColumn("lane", F.pmod("number", F.lit(lanes)))
    gap = F.lit(gap_ms) + (F.coalesce(F.col(penalty_ms), F.lit(0)) if penalty_ms else F.lit(0))
    own = Window.partitionBy("__b", "lane").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("lane").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # ``blocks`` rows a lane
    n = n.withColumn("__gap", gap)
    sums = n.groupBy("__b", "lane").agg(F.sum("__gap").alias("s")).select("__b", "lane", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("__base"))
    n = n.join(F.broadcast(sums), ["__b", "lane"]).withColumn("__g", F.col("__base") + F.sum("__gap").over(own))
    n = n.withColumn("__due", F.col(at_ms) + F.col("lane") * int(gap_ms * 0.2) - F.col("__g"))
    peaks = n.groupBy("__b", "lane").agg(F.max("__due").alias("m")).select("__b", "lane", F.max("m").over(before).alias("__ahead"))
    n = n.join(F.broadcast(peaks), ["__b", "lane"])
    if last is not None:
        n = n.join(F.broadcast(last.select("lane", F.col("start_ms").alias("__last"))), "lane", "left")  # a row a lane
    else:
        n = n.withColumn("__last", F.lit(None).cast("long"))
    start = F.greatest(F.max("__due").over(own), "__ahead", "__last") + F.col("__g")
    return n.withColumn("start_ms", start).drop("__b", "__first", "__gap", "__base", "__g", "__due", "__ahead", "__last")
