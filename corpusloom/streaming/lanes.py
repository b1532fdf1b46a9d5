"""Throttling and lanes over a live stream: each micro-batch starts where the one before ended.

What a lane carries is small: its error count and the end of its cool-down, or
its last start.  A batch is worked out by the same windows as a table, begun
from that state, which is written beside the batch's rows under its number.  A
batch that runs again, after a lost driver too, begins from the same state and
overwrites its own folders, so results are those of one run over all events.
Batches must come in order of time, as requests do; a late event counts when it
arrives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators import throttle
from corpusloom.session import remove

#: States kept: the batch that may run again needs the one before it.
KEPT = 2


def _carried(spark: SparkSession, path: str, number: int, schema: str) -> DataFrame:
    if number == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/state/batch={number - 1}")


def _follow(stream: DataFrame, path: str, checkpoint: str, schema: str, step: Callable[[DataFrame, DataFrame], DataFrame], after: Callable[[DataFrame, DataFrame], DataFrame], once: bool) -> StreamingQuery:
    """Write ``step(batch, state)`` as rows, then ``after(rows, state)`` as the next state."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = _carried(spark, path, number, schema)
        rows, place = step(batch, state), f"{path}/rows/batch={number}"
        rows.write.mode("overwrite").parquet(place)
        done = spark.read.schema(rows.schema).parquet(place)
        after(done, state).write.mode("overwrite").parquet(f"{path}/state/batch={number}")
        if number >= KEPT:
            remove(spark, f"{path}/state/batch={number - KEPT}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def throttled(stream: DataFrame, path: str, checkpoint: str, lane: str, order: list[str], at_ms: str, ok: str = "ok", once: bool = True) -> StreamingQuery:
    """The events with ``errors``, ``wait_ms``, ``penalty_ms`` and ``until_ms``, as ``throttle.penalty`` gives them.

    A lane without errors whose cool-down is over is as good as new and leaves
    the state, so the state holds lanes under pressure only.
    """
    kind = stream.schema[lane].dataType.simpleString()

    def step(batch: DataFrame, state: DataFrame) -> DataFrame:
        counted = throttle.error_counter(batch, lane, order, ok, state)
        return throttle.penalty(counted, lane, order, at_ms, ok, state)

    def after(rows: DataFrame, state: DataFrame) -> DataFrame:
        last = lambda c: F.max_by(c, F.struct(*order))
        new = rows.groupBy(lane).agg(last("errors").alias("errors"), last("until_ms").alias("until_ms"), F.max(at_ms).alias("__at"))
        new = new.where((F.col("errors") > 0) | (F.col("until_ms") > F.col("__at"))).drop("__at")
        return state.join(rows.select(lane).distinct(), state[lane].eqNullSafe(rows[lane]), "left_anti").unionByName(new)

    return _follow(stream, path, checkpoint, f"`{lane}` {kind}, errors int, until_ms bigint", step, after, once)


def scheduled(stream: DataFrame, path: str, checkpoint: str, lanes: int, gap_ms: int, at_ms: str, order: list[str], penalty_ms: str | None = None, once: bool = True) -> StreamingQuery:
    """The requests with ``number``, ``lane`` and ``start_ms``, as ``throttle.lane_schedule`` gives them; the state is a row a lane."""

    def step(batch: DataFrame, state: DataFrame) -> DataFrame:
        begun = state.agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0]  # one number
        return throttle.lane_schedule(batch, lanes, gap_ms, at_ms, order, penalty_ms=penalty_ms, begun=begun, last=state.select("lane", "start_ms"))

    def after(rows: DataFrame, state: DataFrame) -> DataFrame:
        both = rows.select("lane", "number", "start_ms").unionByName(state)
        return both.groupBy("lane").agg(F.max("number").alias("number"), F.max("start_ms").alias("start_ms"))

    return _follow(stream, path, checkpoint, "lane bigint, number bigint, start_ms bigint", step, after, once)


def rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows that batches have written so far, with the batch's number."""
    return spark.read.parquet(f"{path}/rows")
