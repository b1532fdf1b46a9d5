"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, per_class: int) -> DataFrame:
    """(doc_id, text, y): at most ``per_class`` documents of each label value.

    Ids whose fold is the held-out one take no part.  Which ids are taken
    depends on a hash of the id alone.  Rows that repeat an id in ``labels``
    are averaged; null labels and null ids are left out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("y")).where("y is not null and doc_id is not null")
    known = known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y")).where(fold(mod) != held)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    part = [known.where(F.col("y") == v).orderBy(*order).limit(per_class) for v in (0, 1)]
    chosen = F.broadcast(part[0].union(part[1]))  # 2 * per_class rows at most
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
