"""Findings F9 and F10 of round 3: sums of gains are whole where a chunk's postings are read, so no pair is shuffled or sorted."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import corpus as C
from corpusloom.operators import retrieval

CHUNKS = "seq long, library_id string, tier int, doc_id long, file_name string, chunk_index int, text string"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(k, f"src{k % 4}", k % 4, k, f"doc{k}", 0, None if k == 7 else "" if k == 8 else f"tea {'cup ' * (k % 13)}word{k % 11} running leaf{k}") for k in range(900)]
    return spark.createDataFrame(rows, CHUNKS).repartition(3)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(q, f"tea cup run word{q % 11} leaf{q}") for q in range(12)] + [(12, "of"), (13, None)], "query_id long, query string")


def rows_of(df, *columns):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


def best_of(hits, k=5):
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("total", 9).desc(), "seq"))
    return rows_of(hits.withColumn("turn", turn).where(F.col("turn") <= k), "query_id", "seq", "tier", "bm25", "ngram", "total", "turn")


def test_packed_postings_are_the_postings(chunks):
    pack = C.packed(chunks.select("seq", "tier", "text"))
    assert pack.count() == 900 and pack.columns == ["seq", "tier", "dl", "post"]
    assert rows_of(C.unpacked(pack), "seq", "dl", "term", "tf") == rows_of(C.postings(chunks), "seq", "dl", "term", "tf")


@pytest.mark.parametrize("rows", [3, 10_000])
def test_sums_are_whole_across_batches(spark, chunks, queries, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)  # a chunk's gains lie in many batches
    try:
        got = rows_of(retrieval.bm25_whole(retrieval.written(C.packed(chunks.select("seq", "tier", "text"))), queries), "query_id", "seq", "bm25")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == rows_of(retrieval.bm25(chunks, queries), "query_id", "seq", "bm25") and len(got) == 12 * 898


@pytest.mark.parametrize("libraries", [None, ["src0", "src3"]])
def test_searches_shuffle_no_pair(spark, chunks, queries, monkeypatch, libraries):
    plans, short = [], retrieval.shortlist

    def seen(rows, *rest):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return short(rows, *rest)

    monkeypatch.setattr(retrieval, "shortlist", seen)
    wanted = None if libraries is None else spark.createDataFrame([(x,) for x in libraries], "library_id string")
    got = best_of(retrieval.best_hits(chunks, queries, 5, wanted=wanted))
    assert plans and not any(x in plans[0] for x in ("hashpartitioning", "HashAggregate", "Sort")), plans[0]
    want = retrieval.hybrid(chunks, queries)
    assert got == best_of(want if wanted is None else retrieval.in_libraries(want, wanted)) and len(got) == 60


@pytest.mark.parametrize("change", ["repeated ids", "many terms"])
def test_searches_that_cannot_be_whole_are_dealt_out(chunks, queries, monkeypatch, change):
    if change == "many terms":
        monkeypatch.setattr(retrieval, "BROADCAST_TERMS", 5)
    else:
        chunks = chunks.unionByName(chunks.where("seq < 40 and seq <> 11"))
    pack = retrieval.written(C.packed(chunks.select("seq", "tier", "text")))
    assert retrieval.bm25_whole(pack, queries) is None
    got = retrieval.best_hits(chunks, queries, 5)
    assert best_of(got) == best_of(retrieval.best_hits(chunks, queries, 5, post=C.postings(chunks)))
