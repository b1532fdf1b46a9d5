"""Blocked postings: the same best hits as a full scan, with fewer blocks opened."""

import pytest
from pyspark.sql import functions as F

from corpusloom import catalog
from corpusloom.operators import blocks, retrieval
from corpusloom.operators import corpus as C
from corpusloom.session import written
from corpusloom.tools import Store
from tests.test_snapshots import library, scores


def made(chunks, size=blocks.CHUNKS):
    return blocks.build(written(C.postings(chunks)), chunks, size)


def best(hits, k):
    return sorted((r.query_id, r["rank"], r.seq, round(r.bm25, 8)) for r in retrieval.top(hits, k, "bm25").collect())


@pytest.mark.parametrize("size", [3, 10**6])
def test_same_best_hits(spark, sf, size):
    c, q = catalog._chunks(spark, sf).where("seq % 300000 = 0"), catalog._items(spark, sf)
    want = retrieval.bm25(c, q)
    b = made(c, size)
    for k in (2, 500):  # the last is more than there are
        assert best(blocks.bm25_best(b, q, k), k) == best(want, k)


def test_few_blocks_are_opened(spark):
    """One frequent word everywhere, one rare word in nine chunks: the rest of the frequent word's blocks stay shut."""
    text = F.when(F.col("id") % 500 == 7, "falcon falcon common").otherwise("common ordinary filler words here")
    c = spark.range(4500).select(F.col("id").alias("seq"), text.alias("text"))
    q = spark.createDataFrame([(1, "common falcon")], "query_id int, query string")
    search = blocks.Search(made(c, 32), q, 5)
    opened, all_ = search.share()
    assert opened * 5 < all_
    assert best(search.hits(), 5) == best(retrieval.bm25(c, q), 5)


def test_queries_and_indexes_without_words(spark):
    c = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, ""), (4, "alpha beta")], "seq long, text string")
    q = spark.createDataFrame([(1, "alpha"), (1, "alpha"), (2, ""), (3, None), (4, "unknown")], "query_id int, query string")
    assert best(blocks.bm25_best(made(c), q, 1), 9) == best(retrieval.bm25(c, q), 9)
    assert blocks.bm25_best(made(c.limit(0)), q, 3).count() == 0
    assert blocks.bm25_best(made(c), q.limit(0), 3).count() == 0


def test_terms_reach_the_scan(spark):
    """Terms are filters of the scan, and bounds are read without postings."""
    c = spark.range(50).select(F.col("id").alias("seq"), F.concat(F.lit("common word"), F.col("id")).alias("text"))
    q = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(25)))], "query_id int, query string")
    search = blocks.Search(made(c), q, 3)
    plan = search.table.select("term", "bucket", "n", "top")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and "rows" not in plan.split("ReadSchema")[1]


def test_prepared_store(spark, tmp_path):
    store = Store(spark)
    folder = library(tmp_path)
    key = store.add_library("lib", str(folder))
    best = lambda: [(r["rank"], r.file_name, r.total) for r in store.search("green special5", 2).collect()]
    want = best()
    store.prepare()
    assert best() == want and want[0][1] == "f5.md"
    (folder / "f3.md").unlink()
    store.refresh_library(key)  # what was prepared no longer holds
    now = scores(store, "special3 words")
    assert now and not any(r[0] == "f3.md" for r in now)
