"""The pipeline's stages against what they must do, and the registered SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from corpusloom.llm import queries, simhash, surrogates


def test_pipeline_stage_by_stage(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, sf).cache()
        seen.append(name)
        if name != "packing":
            assert docs.columns == columns and docs.count() <= before.count()
            assert docs.join(before, "doc_id", "left_anti").count() == 0
        if name == "near_duplicates":
            found = simhash.classes(before).groupBy("component_id").count().count()
            assert docs.count() == found
        if name == "personal_data":
            old = [e.text for r in before.collect() for e in surrogates.detect(r.text)]
            new = "\n".join(r.text for r in docs.collect())
            assert old and not [x for x in old if x in new]
            assert docs.where("n_chars <> length(text)").count() == before.where("n_chars <> length(text)").count()
    assert seen == ["quality", "toxicity", "near_duplicates", "personal_data", "packing"]
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert len(ids) == before.count()


def test_run_over_an_odd_table(spark, tmp_path):
    """The whole run over nulls, repeated ids, clashing names and an empty table."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    some = [(None, "no id here but words enough to stand", "en", "s", 3), (5, None, None, None, None), (5, "", "en", "s", 0), (6, "same text twice", "en", "s", 15), (6, "same text twice", "en", "s", 15), (6, "another text of this id", "en", "s", 23)]
    odd = docs.union(spark.createDataFrame(some, docs.schema)).withColumns({c: F.lit("own") for c in ("score", "entities", "piece", "__quality", "__mark", "__spans")})
    odd.write.parquet(f"{tmp_path}/odd/documents.parquet")
    labels.union(spark.createDataFrame([(None, 1, 1), (6, None, 0)], labels.schema)).withColumn("text", F.lit("own")).write.parquet(f"{tmp_path}/odd/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd")
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    ends = got.toPandas().sort_values(["sequence_id", "offset"])
    assert len(ends) > 100 and ((ends.offset + ends.length).groupby(ends.sequence_id).shift(fill_value=0) == ends.offset).all()
    odd.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    got = entry.queries()[name](spark, sf)
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cols = sorted(got.columns)
    want = con.execute("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(map(repr, want))


def test_all_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
