"""Findings of round 3: rows and references that the small tables do not have, and tasks that stay small."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom import catalog
from corpusloom.functions import text as X
from corpusloom.operators import blocks, extract, retrieval
from corpusloom.operators import corpus as C


def agrees(spark, folder, name, **tables):
    """Whether a query over ``tables`` (name: rows, schema) gives what its SQL does."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, str(folder))
    want = con.execute("select " + ", ".join(f'"{c}"' for c in got.columns) + f" from ({catalog.ORACLE_SQL[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


PAGES = "page_id long, url string, html string"


def test_pages_that_share_a_url_are_fetched_each(spark, tmp_path):
    rows = [(k, f"https://a.org/{k % 3}", f"<p>{'x' * k}</p>") for k in range(20)] + [(20, None, "<p>no address</p>")]
    assert agrees(spark, tmp_path, "fetch_outcomes", pages=(rows, PAGES))


def test_titles_keep_references_without_semicolon(spark, tmp_path):
    heads = ["<h1>Tea &amp;&amp</h1>", "<title>a &lt;b&gt; &copy; &#65;</title>", "<h1>two\n  lines</h1>", "<nav><h1>menu</h1></nav><title>own &amp</title>", "", None]
    assert agrees(spark, tmp_path, "page_title", pages=([(k, f"https://a.org/{k}", h) for k, h in enumerate(heads)], PAGES))


def test_postings_hold_nothing_for_a_task(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = C.postings(C.windows(docs))._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Aggregate", "Sort", "Exchange", "Window") if x in plan], plan  # each would grow with the part it is given


def test_postings_count_terms_as_columns_do(spark):
    bare = ["s", "ss", "ed", "ies", "ves", "xies", "halves", "ing", "inging", "passes", "fitted", "agreement", "tttion", "a--", "__s", "007", "stable", "bless", "nessness"]
    rows = [(k, w, a + w + b) for k, (w, a, b) in enumerate((w, a, b) for w in bare for a in ("", "x", "run") for b in ("", "s", "ing", "ment", "tion"))]
    texts = [(k, " ".join(t for _, _, t in rows[k:]) + " The ÄRGER İs O'Neil's e-mail " + w) for k, w, _ in rows] + [(-1, ""), (-2, None), (-3, "of the")]
    chunks = spark.createDataFrame(texts, "seq long, text string")
    one = chunks.select("seq", F.explode(X.terms("text")).alias("term")).groupBy("seq", "term").agg(F.count("*").alias("tf"))
    want = one.join(one.groupBy("seq").agg(F.sum("tf").alias("dl")), "seq").select("seq", "dl", "term", "tf")
    assert sorted(map(tuple, C.postings(chunks).collect())) == sorted(map(tuple, want.collect()))


def test_sums_are_dealt_by_the_number_of_pairs(spark, monkeypatch):
    chunks = spark.createDataFrame([(k, f"tea word{k % 7} cup") for k in range(300)], "seq long, text string")
    queries = spark.createDataFrame([(q, f"tea word{q}") for q in range(5)], "query_id long, query string")
    for module, name in ((retrieval, "PAIRS"), (blocks, "POSTINGS")):
        monkeypatch.setattr(module, name, 100)
    monkeypatch.setattr(blocks, "BROADCAST_TERMS", 0)
    got = retrieval.bm25(chunks, queries)
    assert got.rdd.getNumPartitions() == 15  # 300 chunks, 5 queries
    made = blocks.build(C.postings(chunks), chunks)
    best = retrieval.top(blocks.bm25_best(made, queries, 3), 3, "bm25")
    rows = lambda df: sorted((r.query_id, r.seq, round(r.bm25, 9)) for r in df.collect())
    assert rows(best) == rows(retrieval.top(got, 3, "bm25")) and len(rows(best)) == 15


def test_a_task_adds_up_a_million_pairs_at_most(spark):
    gains = spark.createDataFrame([(0, 1, 0.5)], "query_id long, seq long, bm25 double")
    assert retrieval.summed(gains, 24_000_000).rdd.getNumPartitions() == 24


def test_trigrams_are_compared_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CHUNKS", 7)
    monkeypatch.setattr(retrieval, "STEP", 20)
    texts = ["", None, "ab", "a-b C", "Äö ü", "zzz zzz", "999", "İstanbul K", "abc" * 400] + [f"tea {'cup of ' * (k % 5)}w{k % 9} Ärger {k % 4}" for k in range(150)]
    chunks = spark.createDataFrame([(k * 7919 % 1000, t) for k, t in enumerate(texts)], "seq long, text string").repartition(3)
    queries = spark.createDataFrame([(q, t) for q, t in enumerate([*texts[:14], "tea cup w3", "w3", "quite other words"])], "query_id int, query string")
    got = retrieval.trigram(chunks, queries, 4)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = retrieval._joined(chunks, queries)
    assert rows(retrieval.trigram(chunks, queries)) == rows(want) and got.count() < want.count()
    assert rows(retrieval.top(got, 4, "ngram")) == rows(retrieval.top(want, 4, "ngram"))
    twice = chunks.unionByName(chunks.limit(20))  # an id of two rows: their counts add up, as in the SQL
    assert rows(retrieval.trigram(twice, queries, 4)) == rows(retrieval._joined(twice, queries))


def test_pages_leave_the_parser_a_few_at_a_time():
    html = "<a href='https://b.org/x'>some words</a>"
    whole = pa.RecordBatch.from_pydict({"page_id": range(150), "url": ["https://a.org/"] * 150, "html": [html] * 149 + [None]})
    got = list(extract.parsed([whole]))
    assert [b.num_rows for b in got] == [64, 64, 22] and [len(x) for b in got for x in b.column(6).to_pylist()] == [1] * 149 + [0]


@pytest.mark.parametrize("name", ["score_outlinks", "discovery_queue"])
def test_pages_with_links_are_parsed_once(spark, sf, name):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan, plan  # what is read twice has been written
