"""The corpus pipeline: five stages over ``documents``, each written and read again.

Every stage works on all that its predecessor kept.  The learned stages are
fitted anew on the documents they are given and on ``labels``.  All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import deobfuscate, mil_quality, packing, simhash, surrogates
from corpusloom.llm.common import fresh, remove, shared_folder, table

#: A document stays if the classifier's score is at least this.
LEAST_QUALITY = 0.5
#: A document goes if its toxicity score is at least this.
MOST_TOXIC = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the quality classifier rejects go."""
    net = mil_quality.learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    name = fresh(docs, "quality")
    scored = mil_quality.score(docs, net, name)
    return scored.where(scored[name] >= LEAST_QUALITY).drop(name)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the toxicity classifier rejects go."""
    scorer = deobfuscate.learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    name = fresh(docs, "toxic")
    scored = deobfuscate.score(docs, scorer, name)
    return scored.where(scored[name] < MOST_TOXIC).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each group stays."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: personal data is replaced by surrogates."""
    name = fresh(docs, "spans")
    done = surrogates.anonymise(docs, surrogates.key_of(spark), name)
    if "n_chars" in docs.columns:  # a surrogate may be a little shorter or longer
        found, length = F.size(name) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)
        done = done.withColumn("n_chars", F.when(found, length).otherwise(F.col("n_chars")))
    return done.drop(name)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the place of every piece of every document in the sequences."""
    return packing.pack(docs, packing.default_path())


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", sequences),
]

#: Fitted classifiers cannot be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what is between them lies in the shared folder.

    A stage's table is deleted once the next one is written; the last stays.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, read = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if read is not None:
            remove(spark, read)
        read = path
    return docs
