"""Findings F8 to F10 of round 3: what a search for the best few writes, holds and shuffles."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import retrieval

CHUNKS = "seq long, library_id string, tier int, doc_id long, file_name string, chunk_index int, text string"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(k, f"src{k % 4}", k % 4, k, f"doc{k}", 0, f"tea {'cup ' * (k % 13)}word{k % 11} {'x' * (k % 7)} leaf{k}") for k in range(3000)]
    return spark.createDataFrame(rows, CHUNKS)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(q, f"tea cup word{q % 11} leaf{q}") for q in range(20)], "query_id long, query string")


def rows_of(df, *columns):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("per_tier", [False, True])
@pytest.mark.parametrize("libraries", [None, ["src0", "src3"]])
def test_searches_write_what_can_be_among_the_best(spark, chunks, queries, monkeypatch, per_tier, libraries):
    sizes, put = [], retrieval.written

    def seen(df):
        made = put(df)
        sizes.append(made.count())
        return made

    post = put(retrieval.C.postings(chunks))
    monkeypatch.setattr(retrieval, "written", seen)
    wanted = None if libraries is None else spark.createDataFrame([(x,) for x in libraries], "library_id string")
    best = retrieval.best_hits(chunks, queries, 5, per_tier=per_tier, wanted=wanted, post=post)
    assert sizes and max(sizes) < 3000 * 20 // 8, sizes  # all 60,000 pairs share a term
    want = retrieval.hybrid(chunks, queries, post=post)
    want = want if wanted is None else retrieval.in_libraries(want, wanted)
    group = ["query_id", "tier"] if per_tier else ["query_id"]
    first = F.row_number().over(Window.partitionBy(*group).orderBy(F.round("total", 9).desc(), "seq"))
    columns = ["query_id", "seq", "library_id", "tier", "doc_id", "chunk_index", "bm25", "ngram", "total"]
    best, want = (rows_of(t.withColumn("turn", first).where("turn <= 5"), *columns) for t in (best, want))
    assert best == want and len(best) == 20 * 5 * (1 if not per_tier else len(libraries or "0123"))


@pytest.mark.parametrize("held", [10, 100_000])
def test_shortlist_leaves_out_only_what_is_below(spark, monkeypatch, held):
    monkeypatch.setattr(retrieval, "HELD", held)
    rows = [(None if k % 11 == 0 else "abc"[k % 3], k % 2, None if k % 17 == 0 else float(k * 7919 % 500)) for k in range(4000)] + [("z", 0, 1.0), ("z", 0, None)]
    df = spark.createDataFrame(rows, "q string, t int, low double").withColumn("high", F.col("low") + 3).repartition(3)
    got = retrieval.shortlist(df, 4, ["q", "t"], "low", "high")
    turn = F.row_number().over(Window.partitionBy("q", "t").orderBy(F.col("low").desc()))
    floor = df.where("low is not null").withColumn("turn", turn).where("turn <= 4").groupBy("q", "t").agg(F.min("low").alias("floor"), F.count("*").alias("n"))
    floor = floor.select(F.col("q").alias("q2"), F.col("t").alias("t2"), F.when(F.col("n") == 4, F.col("floor")).otherwise(-1.0).alias("floor"))
    above = lambda t: rows_of(t.join(floor, F.expr("q <=> q2 and t <=> t2")).where("high >= floor").select(F.coalesce("q", F.lit("-")).alias("q"), "t", "low"), "q", "t", "low")
    assert above(got) == above(df) and got.where("low is null").isEmpty()
    assert got.count() < 1000  # of 4,002


@pytest.mark.parametrize("most", [0, 200_000])
def test_texts_of_hits_are_found_with_few_and_many_hits(spark, chunks, queries, monkeypatch, most):
    for name, n in (("HITS", most), ("TEXTS", 500)):
        monkeypatch.setattr(retrieval, name, n)
    hits = queries.select("query_id", F.explode(F.array(F.col("query_id") * 3, F.lit(7), F.lit(99_999))).alias("seq"))
    got = retrieval.as_hits(hits, chunks)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("LeftSemi" in plan) == bool(most), plan  # texts of chunks that nothing hit are not shuffled
    assert bool(most) or got.rdd.getNumPartitions() == 6  # 3,000 texts
    assert rows_of(got, "query_id", "seq", "title", "snippet") == sorted((q, s, f"doc{s} (src{s % 4})", t) for q in range(20) for s in (q * 3, 7) for t in [chunks.where(F.col("seq") == s).first().text.strip()])
