"""Throttling over a stream in micro-batches against the same events as one table."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import throttle
from corpusloom.streaming import lanes

KIND = "lane string, seq long, at long, ok boolean, late long"


def events(spark, parts):
    """Events dealt to lanes, one of them null; errors come in runs, so that cool-downs span batches."""
    rows = [(None if k % 7 == 6 else f"l{k % 3}", k, k * 900 + k % 5, (k // 9) % 3 == 2, k % 4 * 250) for k in range(180)]
    size = -(-len(rows) // parts)
    return [spark.createDataFrame(rows[i : i + size], KIND) for i in range(0, len(rows), size)]


def fed(spark, tmp_path, parts, start):
    for p in parts:  # stopped and begun anew for every part
        p.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        start(spark.readStream.schema(KIND).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    return lanes.rows(spark, str(tmp_path / "out"))


def told(df, *columns):
    return sorted(tuple(r) for r in df.select("seq", *columns).collect())


def test_throttled(spark, tmp_path):
    parts = events(spark, 4)
    table = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    got = fed(spark, tmp_path, parts, lambda s, out, log: lanes.throttled(s, out, log, "lane", ["seq"], "at"))
    want = throttle.penalty(throttle.error_counter(table, "lane", ["seq"]), "lane", ["seq"], "at")
    assert told(got, "errors", "wait_ms", "penalty_ms") == told(want, "errors", "wait_ms", "penalty_ms")
    assert {r.batch for r in got.select("batch").distinct().collect()} == {0, 1, 2, 3}
    assert sorted(p.name for p in (tmp_path / "out" / "state").iterdir()) == ["batch=2", "batch=3"]


def test_lanes_at_rest_leave_the_state(spark, tmp_path):
    bad = spark.createDataFrame([("a", 1, 0, False, 0), ("b", 2, 5, False, 0)], KIND)
    good = spark.createDataFrame([("a", 3, 10, True, 0)], KIND)
    fed(spark, tmp_path, [bad, good], lambda s, out, log: lanes.throttled(s, out, log, "lane", ["seq"], "at"))
    assert [r.lane for r in spark.read.parquet(str(tmp_path / "out" / "state" / "batch=1")).collect()] == ["b"]


@pytest.mark.parametrize("penalty", [None, "late"])
def test_scheduled(spark, tmp_path, penalty):
    parts = events(spark, 3)
    table = parts[0].unionByName(parts[1]).unionByName(parts[2])
    got = fed(spark, tmp_path, parts, lambda s, out, log: lanes.scheduled(s, out, log, 4, 2000, "at", ["at", "seq"], penalty))
    want = throttle.lane_schedule(table, 4, 2000, "at", ["at", "seq"], penalty_ms=penalty)
    assert told(got, "number", "lane", "start_ms") == told(want, "number", "lane", "start_ms")


def test_batch_that_runs_again(spark, tmp_path):
    """A batch whose end was not recorded begins from the same state and replaces what it wrote."""
    parts = events(spark, 2)
    start = lambda s, out, log: lanes.throttled(s, out, log, "lane", ["seq"], "at")
    first = told(fed(spark, tmp_path, parts, start), "errors", "penalty_ms")
    for name in ("1", ".1.crc"):
        (tmp_path / "log" / "commits" / name).unlink(missing_ok=True)
    before = {p.name for p in (tmp_path / "out" / "rows" / "batch=1").iterdir()}
    start(spark.readStream.schema(KIND).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert before.isdisjoint({p.name for p in (tmp_path / "out" / "rows" / "batch=1").glob("part*")})  # it did run again
    assert told(lanes.rows(spark, str(tmp_path / "out")), "errors", "penalty_ms") == first
