"""Fetching, over captured attempts: what each URL gave in the end, and in which batches URLs are asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X

# Status codes that mean a block, attempts, pauses in ms, and the least text of a cached copy.
BLOCKED = [403, 429, 451]
ATTEMPTS = 3
RETRY_MS = 700
BATCH_MS = 300
LEAST_CACHED = 500


def outcomes(attempts: DataFrame, cached: DataFrame | None = None, key: str = "url") -> DataFrame:
    """url, outcome (ok, cached, blocked, error), attempts, content_type, is_binary, body of each URL.

    ``attempts`` (url, attempt from 1, status, content_type, body; a null status
    for none) are asked in order, ``ATTEMPTS`` at most, until one is good or
    blocked.  A blocked or failed URL has the first copy in ``cached`` (url,
    place, body) of more than ``LEAST_CACHED`` characters.  Where a URL is asked
    for more than once, ``key`` is the column of both tables that tells the
    requests apart; each then has a row, ``key`` before its URL.
    """
    own = [key] if key == "url" else [key, "url"]
    code = F.when(F.col("status").between(200, 299), "ok").when(F.col("status").isin(BLOCKED), "blocked").otherwise("error")
    some = attempts.where(F.col("attempt") <= ATTEMPTS).withColumn("outcome", code)
    order = F.struct((F.col("outcome") == "error").cast("int"), F.when(F.col("outcome") == "error", -F.col("attempt")).otherwise(F.col("attempt")))
    last = some.groupBy(*own).agg(F.min_by(F.struct("outcome", "attempt", "content_type", "body"), order).alias("r")).select(*own, "r.*")
    if cached is None:
        copies = last.select(key, F.lit(None).cast("string").alias("copy")).limit(0)
    else:
        copies = cached.where(F.length("body") > LEAST_CACHED).groupBy(key).agg(F.min_by("body", "place").alias("copy"))
    both = last.join(copies, key, "left")
    bad = F.col("outcome") != "ok"
    out = F.when(bad & F.col("copy").isNotNull(), "cached").otherwise(F.col("outcome"))
    return both.select(
        *own, out.alias("outcome"), F.col("attempt").alias("attempts"), "content_type", (~bad & X.is_binary_type("content_type")).alias("is_binary"),
        F.when(bad, F.col("copy")).otherwise(F.col("body")).alias("body"),
    )


def batches(candidates: DataFrame, concurrency: int) -> DataFrame:
    """``candidates`` (task_id, turn from 1) with their batch and the pause in ms before it."""
    batch = F.floor((F.col("turn") - 1) / concurrency).cast("int")
    return candidates.withColumn("batch", batch).withColumn("pause_ms", F.when(batch > 0, BATCH_MS).otherwise(0))


def waits(attempts: DataFrame) -> DataFrame:
    """``attempts`` (url, attempt) with the time in ms that passes before each."""
    w = Window.partitionBy("url").orderBy("attempt")
    return attempts.withColumn("wait_ms", F.when(F.row_number().over(w) > 1, RETRY_MS).otherwise(0))
