"""Main text by tree scores, keywords in one pass, plans that touch only what they need."""

import random
import time

import pytest
from pyspark.sql import functions as F

from corpusloom import catalog
from corpusloom.functions.tables import DIMENSIONS
from corpusloom.operators import corpus as C
from corpusloom.operators import coverage, extract, retrieval
from corpusloom.plans import planning
from corpusloom.plans.research import Run
from corpusloom.sources import files


@pytest.mark.parametrize("layout", range(len(catalog._LAYOUTS)))
@pytest.mark.parametrize("a", ["It begins, as it were, like this: x", "It begins, as it were, like this: " + "some words, of a longer text. " * 14])
def test_layouts_without_article(layout, a):
    html = catalog._LAYOUTS[layout].replace("{menu}", catalog._MENU).replace("{side}", catalog._SIDE).replace("{b}", catalog._REST).replace("{a}", a)
    want = [a.strip(), *(["see also this page"] if layout == 8 else []), catalog._REST]
    assert extract.parse_page(html, "https://me.org/")[3] == "\n".join(want)


def test_articles_are_taken_as_before():
    long = "many words, and more of them, stand here. " * 9
    page = f"<body><div class=content><p>{long}</p></div><article><h1>T</h1><p>{long}own</p></article>"
    assert extract.parse_page(page, "https://me.org/")[3] == f"T\n{long}own"
    assert extract.parse_page("<body><p>too short for a text</p>", "https://me.org/")[3] == "too short for a text"


def test_tree_scores_are_linear():
    took = []
    for n in (5_000, 20_000):
        began = time.process_time()
        extract.parse_page("<div>" * 50 + "<div><p>words, and more words, that go on for a while.</p>x</div>" * n, "https://me.org/")
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0]


def test_keywords_equal_replacements():
    r = random.Random(2)
    words = [k for d in DIMENSIONS for k in d[2]] + ["how", "howhow", "showhow", "concern", "nextnext", "ix", " ", "vsvs", "new"]
    for _ in range(200):
        t = "".join(r.choice(words) + r.choice(["", " ", "s"]) for _ in range(40))
        total = [0] * len(coverage.KEYWORDS)
        coverage.count_keywords(t, total)
        assert total == [t.count(k) for _, _, k in coverage.KEYWORDS]  # count takes places that do not overlap


def test_keywords_over_tables(spark):
    rows = [(1, "What is it? HOW new; how New"), (2, None), (3, ""), (4, "a study of cost")]
    df = spark.createDataFrame(rows, "idx long, text string")
    hits = {(r.dimension, r.keyword): r.hits for r in coverage.dimension_hits(df).collect()}
    assert len(hits) == len({(d, k) for _, d, k in coverage.KEYWORDS}) and hits["mechanism", "how"] == 2 and hits["current", "new"] == 2 and hits["overview", "means"] == 0
    assert sorted((r.idx, r.dimension) for r in coverage.mentions(df).collect()) == [(1, "current"), (1, "mechanism"), (1, "overview"), (4, "economics"), (4, "evidence")]
    assert {r.hits for r in coverage.dimension_hits(df.limit(0)).collect()} == {0} and coverage.mentions(df.limit(0)).count() == 0


def test_context_looks_up_neighbours_only(spark, sf):
    c = C.windows(spark.read.parquet(f"{sf}/documents.parquet"))
    got = retrieval.context(c.where("seq % 7 = 0").select("seq", F.lit(1).alias("x")), c)
    assert got.columns == ["seq", "x", "context_before", "context_after"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    by = {(r.doc_id, r.chunk_index): r for r in c.collect()}
    for r in got.collect():
        own = next(x for x in by.values() if x.seq == r.seq)
        before, after = by.get((own.doc_id, own.chunk_index - 1)), by.get((own.doc_id, own.chunk_index + 1))
        assert (r.context_before, r.context_after) == (before.text[-200:] if before else "", after.text[:200] if after else "")


def test_pages_are_met_before_they_are_shuffled(spark):
    pages = spark.createDataFrame([("u", "b"), ("u", "a"), ("v", "c"), ("w", None)], "url string, text string")
    hits = spark.createDataFrame([], "query string, seq int, url string, title string, snippet string")
    run = Run(hits, pages, planning.DEPTHS["shallow"], ["x"], 2026, None, 100)
    got = run._fetched(spark.createDataFrame([("u",), ("u",), ("w",)], "url string"))
    assert sorted((r.url, r.text) for r in got.collect()) == [("u", "a"), ("w", None)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.index("BroadcastHashJoin")  # the join lies below the shuffle of the window


def test_skipped_folders_are_not_opened(spark, tmp_path):
    words = "the quick brown foxes jumped over many lazy sleeping dogs while clever birds watched from tall green trees "
    for name in ("a b.md", "c[1].md", "d%20e.md", "node_modules/x.md", ".git/y.md", "deep/z.exe"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(words * 2)
    found = files.scan(spark, str(tmp_path))
    assert sorted(r.name for r in found.collect()) == ["a b.md", "c[1].md", "d%20e.md"] and len(found.inputFiles()) == 3
    assert sorted(r.name for r in files.listed(spark, str(tmp_path)).collect()) == ["a b.md", "c[1].md", "d%20e.md"]
    f, c = files.ingest(spark, str(tmp_path), "l")
    assert f.count() == 3 and c.count() == 3
    (tmp_path / "none").mkdir()
    assert files.scan(spark, str(tmp_path / "none")).count() == 0


def test_fallback_table_equals_single_topics(spark):
    topics = [(1, "a topic of tea leaves"), (2, "what is a license (of use): and more")]
    got = planning.fallback_table(spark.createDataFrame(topics, "key long, topic string"), 12)
    rows = {}
    for r in got.collect():
        rows.setdefault((r.key, r.role), []).append((r.pos, r.query))
    for key, topic in topics:
        want = {}
        for r in planning.fallback_queries(spark, topic, 12).collect():
            want.setdefault(r.role, []).append((r.pos, r.query))
        assert {role: sorted(q) for (k, role), q in rows.items() if k == key} == {role: sorted(q) for role, q in want.items()}


def test_visited_filter_drops_nothing_that_is_new(spark, monkeypatch):
    from corpusloom.operators import visited

    rows = [(k, f"https://a.org/{k}") for k in range(3000)] + [(9001, None)]
    df = spark.createDataFrame(rows, "n long, url string").repartition(4)
    for bits in (visited.MOST_BITS, 1024):  # a filter that knows little, and one that is full: maybe is all that changes
        monkeypatch.setattr(visited, "MOST_BITS", bits)
        monkeypatch.setattr(visited, "SEGMENT", 64)
        v = visited.Visited(spark, 1000)
        v.add(df.where("n % 3 = 0"))
        v.add(df.where("n % 30 = 1"))
        got = {r.n for r in v.unvisited(df).collect()}
        assert got == {n for n, u in rows if u is None or not (n % 3 == 0 or n % 30 == 1)}
        maybe = df.where("url is not null").select("n", v.maybe().alias("m")).where("m").count()
        assert maybe > 1800 if bits == 1024 else 1100 <= maybe < 1200


def test_read_many(spark):
    from corpusloom.tools import read_many

    page = "<article><h1>T</h1><p>" + "words of a page that is long enough to be read as text. " * 4
    pages = spark.createDataFrame([(1, "https://arxiv.org/x", page), (2, "https://b.org/", None)], "page_id long, url string, html string")
    outcomes = spark.createDataFrame([("https://c.org/", "blocked")], "url string, outcome string")
    got = read_many(pages, ["https://c.org/", "https://arxiv.org/x", "https://b.org/", "https://d.org/"], outcomes=outcomes).collect()
    assert [(r.number, r.error) for r in got] == [(1, "fetch: blocked"), (2, None), (3, "the page holds no text"), (4, "the page was not captured")]
    assert got[1].title == "T" and got[1].domain_score > 80 and got[1].word_count > 20 and (got[0].text, got[0].tier, got[0].domain_score) == ("", "general", 0)
    for urls in ([], ["https://a.org/"] * 11):
        with pytest.raises(ValueError):
            read_many(pages, urls)


def test_cancelled_runs_report_what_they_have(spark):
    from corpusloom.tools import Settings, deep_research

    hits = spark.createDataFrame([("what is tea", 1, "https://a.org/research/1", "tea", "tea")], "query string, seq int, url string, title string, snippet string")
    pages = spark.createDataFrame([("https://a.org/research/1", "tea is a drink of leaves " * 20)], "url string, text string")
    asked = []

    def after(n):
        asked.clear()
        return lambda: asked.append(1) or len(asked) > n

    assert deep_research("tea", hits, pages, settings=Settings(depth="shallow"), cancelled=after(1)) == "Research was cancelled before any sources were collected."
    got = deep_research("tea", hits, pages, settings=Settings(depth="standard"), cancelled=after(5))
    assert got["sources"] == 1 and got["rounds"] == 1 and "tea" in got["report"]
    whole = deep_research("tea", hits, pages, settings=Settings(depth="shallow"), cancelled=after(10**6))
    assert len(asked) > 5 and whole["sources"] == 1  # asked before every step
