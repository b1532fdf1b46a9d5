from corpusloom.tools import Settings, Store, deep_research, is_local, prompt_with_clock, read_pages, search_candidates

GREEN = "green tea leaves are picked by hand in early spring and dried quickly to keep their fresh colour and scent "
ENGINE = "the diesel engine compresses air until fuel ignites without any spark and drives heavy ships across oceans "


def test_store(spark, tmp_path):
    for name, words in (("one", GREEN), ("two", ENGINE)):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.md").write_text("# About\n" + words * 4)
    s = Store(spark)
    a = s.add_library("Tea", str(tmp_path / "one"), priority="proprietary", tags=["reports"])
    b = s.add_library("Ships", str(tmp_path / "two"))
    assert [r["name"] for r in s.libraries()] == ["Tea", "Ships"] and s.by_name("tea")["library_id"] == a and len(s.by_tag("reports")) == 1
    for progressive in (False, True):
        hits = s.search("diesel engine fuel", 3, progressive=progressive).collect()
        assert hits[0].file_name == "two.md" and hits[0].bm25 > 0
    assert s.search("diesel engine", library_id=a).where("bm25 > 0").count() == 0 and s.search("*").count() == 2
    stats = s.stats()
    assert stats["by_priority"] == {"proprietary": 1, "general": 1} and stats["terms"] > 20 and stats["words"] > 60
    roles = [r.library_id for r in s.search_by_role("green tea engine", "primary").collect()]
    assert set(roles) == {a, b} and {r.library_id for r in s.search_by_role("green tea", "primary", chosen={"primary": [b]}).collect()} <= {b}
    assert all(is_local(r.url) for r in s.search_hits("green tea").collect()) and s.collections() == s.libraries() and s.search_collections('diesel engine').count() >= 1
    assert s.stats()["files"] == 2 and s.check_changes(a).count() == 0
    (tmp_path / "one" / "more.md").write_text(GREEN * 3)
    (tmp_path / "one" / "one.md").write_text(GREEN * 5)
    assert sorted(r.status for r in s.check_changes(a).collect()) == ["added", "modified"]
    assert s.update_library(b, description="d", name=None)["name"] == "Ships"
    t = Store(spark)
    s.add_library("Tea again", str(tmp_path / "one"))
    assert len(s.records) == 2 and s.by_name("Tea") is None
    s.save_index(str(tmp_path / "index"))
    assert t.load_index(str(tmp_path / "index")) == (2, 0) and t.search("green tea").count() >= 1
    assert s.remove_library(b) and not s.remove_library(b)


def test_pages_and_candidates(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    urls = [r.url for r in pages.select("url").limit(2).collect()]
    got = read_pages(pages, [urls[1], "https://none.org/", urls[0]]).collect()
    assert [r.url for r in got] == [urls[1], "https://none.org/", urls[0]] and got[1].text is None and got[0].text
    hits = pages.selectExpr("page_id as seq", "url", "'t' as title", "'' as snippet")
    assert search_candidates(hits, 5).count() <= 5


def test_pdf_pages_and_settings(spark):
    rows = [(1, "https://a.org/x.pdf", None, "application/pdf", "A title here\nsee https://b.org/y and more", 3, {"Author": "Ann"}), (2, "https://a.org/y", "<h1>Page</h1>", "text/html", None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, content_type string, pdf_text string, pages int, info map<string,string>")
    got = read_pages(pages, ["https://a.org/y", "https://a.org/x.pdf"]).collect()
    assert [r.title for r in got] == ["Page", "A title here"] and got[1].description.startswith("A title here by Ann (3 pages). ") and got[1].outlinks[0].href == "https://b.org/y"
    s = Settings.of({"depth": "odd", "content": 0, "follow_links": False, "other": 1})
    assert s == Settings(follow_links=False) and Settings.of({"depth": "deep"}).depth == "deep"
    assert prompt_with_clock("hi", "2026-01-02 03:04:00").endswith("03:04\n\nhi")


def test_deep_research(spark):
    hits = spark.createDataFrame([("what is tea", 1, "https://a.org/research/1", "tea", "tea")], "query string, seq int, url string, title string, snippet string")
    pages = spark.createDataFrame([("https://a.org/research/1", "tea is a drink of leaves " * 20)], "url string, text string")
    got = deep_research("tea", hits, pages, settings=Settings(depth="shallow"))
    assert got["sources"] == 1 and got["index"][0]["url"] == "https://a.org/research/1" and got["rounds"] == 1 and not got["has_narrative"]
    assert deep_research("tea", hits, pages, cancelled=lambda: True) == "Research cancelled." and deep_research("x", hits, pages).startswith("Error")
    assert deep_research("tea", hits.drop("seq"), pages).startswith("Error: ")
