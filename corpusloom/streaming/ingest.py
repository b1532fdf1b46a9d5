"""Incremental ingest: postings and additive statistics from a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators import corpus as C


def start(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append each micro-batch's postings and statistics under its batch number.

    A batch that is run again overwrites its own folders, so sums stay right.
    """

    def write(batch: DataFrame, number: int) -> None:
        chunks = C.windows(batch)
        C.postings(chunks).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        post = batch.sparkSession.read.parquet(f"{path}/postings/batch={number}")
        C.document_frequency(post).write.mode("overwrite").parquet(f"{path}/df/batch={number}")
        size = post.select("seq", "dl").distinct().agg(F.count("*").alias("n"), F.sum("dl").alias("terms"))
        size.write.mode("overwrite").parquet(f"{path}/stats/batch={number}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def statistics(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(term, df) and (n, avgdl) over all batches."""
    df = spark.read.parquet(f"{path}/df").groupBy("term").agg(F.sum("df").alias("df"))
    s = spark.read.parquet(f"{path}/stats").agg(F.sum("n").alias("n"), (F.sum("terms") / F.sum("n")).alias("avgdl"))
    return df, s


def first_seen(stream: DataFrame, key: str, time: str, horizon: str = "1 hour") -> DataFrame:
    """The visited set over a stream: each key once within the horizon."""
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark([key])
