"""Golden rows and properties of the engine's functions and operators."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import admission, chunking, coverage, extract, retrieval, scoring, serp, throttle
from corpusloom.operators import corpus as C
from corpusloom.plans import planning, report, research
from corpusloom.sources import files
from corpusloom.streaming import ingest


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_tokens_and_stems(spark):
    words = "running studies leaves class movement darkness tables fall agreeable".split()
    stems = [X.stem(F.lit(w)) for w in words]
    got = one(spark, X.tokens(F.lit("The Running-Dogs, of 42 x_y!")), F.array(*stems), X.terms(F.lit("nation")), X.trigrams(F.lit("AI ml")), X.trigrams(F.lit("ab")))
    assert got[0] == ["running-dogs", "x_y"]
    assert got[1] == "run study leaf clas move dark table fal agre".split()
    assert got[2] == ["nation"] and sorted(got[3]) == ["aim", "iml"] and got[4] == []


def test_overlap_heading_fingerprint(spark):
    a = lambda *x: F.array(*[F.lit(v) for v in x])
    long = " ".join(f"w{i}" for i in range(100))
    got = one(spark, X.overlap(a("a", "b", "c"), a("b", "c")), X.heading(F.lit("## Results of test")), X.heading(F.lit("INTRODUCTION PART")), X.heading(F.lit("Abstract text")),
              X.heading(F.lit("plain")), X.fingerprint(F.lit("A b, c!")), X.fingerprint(F.lit(long)))
    assert got[0] == 1.0 and tuple(got[1]) == ("Results of test", 2) and tuple(got[2]) == ("INTRODUCTION PART", 2) and tuple(got[3]) == ("Abstract", 1)
    assert got[4] is None and got[5] == "a b c" and len(got[6].split()) == 70 and got[6].split()[30] == "w40"


def test_queries_and_dates(spark):
    q = F.lit("a b c d e")
    got = one(spark, X.mutate_query(q, 0), X.mutate_query(q, 3), X.iso_date(F.lit("March 5, 2024")), X.iso_date(F.lit("2024-03-05T10:00Z")), X.iso_date(F.lit("soon")),
              X.pdf_date(F.lit("D:20240305120000")), X.host(F.lit("https://www.A.org:80/x")), X.escape_markdown(F.lit("[a]")), X.strip_html(F.lit("<p>a&amp;b<script>x</script> c</p>")))
    assert got[0] == '"a b c d e"' and got[1] == "a b c d" and got[2] == got[3] == got[5] == "2024-03-05" and got[4] is None
    assert got[6] == "a.org" and got[7] == "\\[a\\]" and got[8] == "a&b c"


def test_candidate_scores(spark):
    urls = ["https://www.nature.com/articles/x", "https://example.org/research/2024/05/x#top", "https://ox.ac.uk/", "https://pinterest.com/tag/x/search?q=1", "https://a.b/2030/x"]
    hits = spark.createDataFrame([(i, u, "T", "") for i, u in enumerate(urls)], "seq long, url string, title string, snippet string")
    got = {r.seq: r for r in scoring.score(hits, 2026).collect()}
    assert (got[0].domain_score, got[0].tier, got[0].url_quality, got[0].freshness_score, got[0].total_score) == (98, "academic", 70, 50, 81)
    assert (got[1].domain_score, got[1].tier, got[1].url_quality, got[1].freshness_score, got[1].total_score) == (58, "general", 86, 70, 67)
    assert (got[2].domain_score, got[2].tier, got[2].total_score) == (48, "general", 54)
    assert got[3].url_quality == 0 and got[4].freshness_score == 100
    assert 3 not in {r.seq for r in scoring.rank(scoring.score(hits, 2026), 10).collect()}


def test_relevance(spark):
    t, none = F.lit("alpha beta gamma"), F.lit("")
    got = one(spark, admission.relevance(t, F.lit("Alpha"), none, ["alpha", "delta"]), admission.relevance(t, none, none, []))
    assert got[0] == pytest.approx(0.675) and got[1] == 0.5


def test_admission_rules(spark):
    long = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [("t", 1, "u1", "h", long("a"), 60, 0.9), ("t", 2, "u2", "h", long("a"), 60, 0.9), ("t", 3, "u3", "h", long("b"), 60, 0.9),
            ("t", 4, "u4", "h", long("c"), 60, 0.9), ("t", 5, "seen", "k", long("d"), 60, 0.9), ("t", 6, "u6", "k", "few", 1, 0.9), ("t", 7, "u7", "k", long("e"), 60, 0.01)]
    c = spark.createDataFrame(rows, "task_id string, ord long, url string, host string, text string, word_count int, relevance double")
    seen = spark.createDataFrame([("seen", "x")], "url string, fp string")
    got = admission.admit(c, seen.select("url"), seen.select("fp"), 0.1, 2, 10)
    assert sorted(r.url for r in got.collect()) == ["u1", "u3"]


def test_hybrid_totals(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta " * 3, "src0"), (2, "omega psi chi " * 4, "src3"), (3, "alphabet soup", "src3")], "doc_id long, text string, source string")
    q = spark.createDataFrame([(1, "alpha"), (2, "of the")], "query_id long, query string")
    c = C.windows(docs)
    got = {r.seq: r for r in retrieval.hybrid(c, q).where("query_id = 1").collect()}
    assert got[100000].total == pytest.approx((got[100000].bm25 + 0.2 * got[100000].ngram) * 1.24)
    assert got[300000].bm25 == 0 and got[300000].total == pytest.approx(0.2 * got[300000].ngram)
    assert retrieval.hybrid(c, q).where("query_id = 2").count() == 0


def test_coverage_and_gap_plan(spark):
    one_text = spark.createDataFrame([(1, "vs vs vs")], "idx long, text string")
    r = coverage.covered(coverage.dimension_hits(one_text)).where("dimension = 'comparison'").first()
    assert r.hits == 3 and not r.covered
    plan = coverage.gap_plan(coverage.gaps(coverage.dimension_hits(one_text)), "tea", 5).collect()
    assert {p.role for p in plan} >= {"breadth", "academic"} and all(len(p.queries) <= 5 for p in plan)


def test_consensus(spark):
    s = spark.createDataFrame([(i, "green tea leaves contain caffeine " + "xyzz" * i) for i in range(1, 5)], "idx long, text string")
    got = {r.phrase: r.sources for r in coverage.consensus(s, ["green"]).collect()}
    assert got == {"green leaves": 4, "green leaves contain": 4}
    assert coverage.consensus(s.limit(1), ["green"]).count() == 0


def test_parsers(spark):
    a = spark.createDataFrame([("CLAIM: x | SOURCE_A: [1] p | SOURCE_B: [2] q | SEVERITY: major\nNONE\nCLAIM: y | SOURCE_A: [1] p | SOURCE_B: [9] q |",)], "body string")
    s = spark.createDataFrame([(1, "One"), (2, "Two")], "idx int, title string")
    got = coverage.parse_contradictions(a, s).orderBy("pos").collect()
    assert [(r.claim, r.a_title, r.b_title, r.severity) for r in got] == [("x", "One", "Two", "major"), ("y", "One", "Source 9", "minor")]
    f = spark.createDataFrame([(1, "FINDINGS\n- no section yet\nFINDINGS:\n- 3.5 million users\n* 2\n• Findings suggest a rise\n follow up: \n- 2024 saw growth\n1. look again")], "id long, body string")
    assert [(r.section, r.item) for r in coverage.parse_findings(f).orderBy("pos").collect()] == [
        ("findings", "3.5 million users"), ("findings", "Findings suggest a rise"), ("follow_up", "2024 saw growth"), ("follow_up", "1. look again")]
    body = '[{"role":"academic","queries":["abcd","efgh"],"budgetWeight":0.9},{"role":"odd","queries":["abcd","efgh"]},{"role":"depth","label":"D","queries":["abcd","efgh"]},{"queries":["x"]}]'
    specs = planning.parse_plan("here: " + body)
    assert [s.role for s in specs] == ["academic", "breadth", "depth"] and sum(s.weight for s in specs) == pytest.approx(1)
    assert specs[0].weight == pytest.approx(0.5 / 0.9) and [s.label for s in specs] == ["academic worker", "breadth worker", "D"]
    assert planning.parse_plan("[1, 2, 3]") is None and planning.parse_plan('[{"role":"depth","queries":["abcd","efgh"]}]') is None
    assert planning.parse_plan("no json") is None
    assert planning.short_topic("Long-term safety of GLP-1 drugs: a review") == "Long-term safety GLP-1 drugs: review"
    assert planning.short_topic("abcdefghij klmnopqrst uvwxyzabcd efghijklmn opqrstuvwx yzabcdefgh") == "abcdefghij klmnopqrst uvwxyzabcd efghijklmn opqrstuvwx"
    assert planning.short_topic("a — bc") == "a — bc" and planning.short_topic("Quantum security — all that we know of it today") == "Quantum security"
    assert planning.short_topic("the: of") == "the: of"


def test_result_pages(spark):
    lite = '<a rel="nofollow" href="//e.com/l?uddg=https%3A%2F%2Fa.org%2Fx&k=1">A <b>one</b></a><td class="result-snippet">s1</td><a rel="nofollow" href="/in">in</a><td class="result-snippet">s2</td><a rel="nofollow" href="https://b.org">B</a><td class="result-snippet">s3</td>'
    brave = '<div class="snippet x"><a href="https://c.org">C</a><p class="snippet-description">sc</p></div><div class="snippet y"><a href="https://c.org">C2</a></div>'
    searx = '{"results":[{"url":"https://d.org","title":"D"},{"url":"ftp://x"}]}'
    pages = spark.createDataFrame([("lite", "q", lite), ("brave", "q", brave), ("searx", "q", searx)], "engine string, query string, body string")
    got = serp.parse_all(pages)
    assert sorted((r.engine, r.seq, r.url, r.snippet) for r in got.collect()) == [
        ("brave", 1, "https://c.org", "sc"), ("lite", 1, "https://a.org/x", "s1"), ("lite", 2, "https://b.org", "s3"), ("searx", 1, "https://d.org", "D")]
    assert serp.merge(got, ["lite", "brave", "searx"]).count() == 4


def test_throttle(spark):
    e = spark.createDataFrame([(1, i, c == "S") for i, c in enumerate("EESEEEES")], "lane int, seq int, ok boolean")
    got = throttle.backoff(throttle.error_counter(e, "lane", ["seq"])).orderBy("seq").collect()
    assert [r.errors for r in got] == [1, 2, 1, 2, 3, 4, 5, 4]
    assert [r.wait_ms for r in got] == [1000, 2000, 0, 2000, 4000, 8000, 15000, 0]


def test_page_extraction(spark):
    art = "Article text " * 12
    html = f"""<html><head><title>T</title><meta property="og:title" content="OG"><meta name="description" content="About"><script type="application/ld+json">{{"datePublished": "2024-03-05"}}</script></head>
    <body><header><h1>Head</h1><a href="https://n.org/nav">navigation</a></header><article>{art}<a href="https://o.org/p">other page</a><a href="https://o.org/p">other page</a>
    <a href="/local">local</a><a href="https://o.org/q">ab</a><div style="display: none">hidden</div></article><footer>foot</footer></body></html>"""
    p = spark.createDataFrame([(1, "https://me.org/a", html), (2, "https://me.org/b", None), (3, "https://me.org/2023/01/02/x", "<p>short</p>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in extract.extract(p).collect()}
    assert got[1].title == "T" and got[1].description == "About" and got[1].published == "2024-03-05"
    assert [x.href for x in got[1].outlinks] == ["https://o.org/p"] and "hidden" not in got[1].text and "foot" not in got[1].text
    assert got[3].published == "2023-01-02" and got[3].text == "short"


def test_page_parts_by_hand():
    page = lambda body, head="": extract.parse_page(f"<html><head>{head}</head><body>{body}</body></html>", "https://me.org/a")
    assert page("<h1> A <b>real</b> one </h1>", "<title>T</title>")[0] == "A real one"
    assert page('<div class="site-header"><h1>x</h1></div>', '<meta property="og:title" content=" OG ">')[0] == "OG"
    for noise in ('<aside>noise</aside>', '<p id="comments">noise</p>', '<p class="big promo-box">noise</p>', '<ul role="banner"><li>noise</ul>', '<p style="visibility : HIDDEN">noise</p>', "<figcaption>noise</figcaption>"):
        assert page(f"<main>{'real text ' * 20}{noise}</main>")[3] == ("real text " * 20).strip()
    kept = '<p class="related">kept</p><p class="cookies-free" aria-label="cookies">x</p>'
    assert "kept" in page(f"<main>{'real text ' * 20}{kept}</main>")[3]
    head = '<script type="application/ld+json">{"dateModified": "2024-03-05", "uploadDate": "2020-01-01"}</script><meta name="DC.date" content="2023-01-01"><meta itemprop="datePublished" content="2022-01-01">'
    assert page('<time datetime="2021-01-01">', head)[2] == ["2024-03-05", "2023-01-01", "2022-01-01", "2021-01-01"]
    links = '<a href="x">same host</a><a href="//Far.org">far   away</a><a href="https://far.org/">again</a><a href="HTTP://b.org/p?q#f">b <i>page</i></a><a href="javascript:x()">script</a><a href="https://[bad">broken</a>'
    assert page(links)[4] == [{"text": "far away", "href": "https://far.org/"}, {"text": "b page", "href": "http://b.org/p?q#f"}]
    assert page(links.replace("x", "y"), '<base href="https://other.org/d/">')[4][0] == {"text": "same host", "href": "https://other.org/d/y"}
    assert page("</div></p>" + "<div>" * 3000)[4] == [] and extract.parse_page("", "")[3] == ""


def test_source_block(spark):
    rows = [(2, "Two", None, "general", 50, "x\n\ny " * 9), (1, "One", "2024-03-05", "news", 80, "abc"), (3, "Three", None, "low", 1, "z")]
    s = spark.createDataFrame(rows, "idx int, title string, published string, tier string, domain_score int, text string")
    assert research.M.source_block(s, 2, 7) == '[1] "One" (2024-03-05) — news (score: 80)\nabc\n\n[2] "Two" — general (score: 50)\nx y x'


def test_gap_and_role_queries_of_a_model(spark):
    plan = coverage.gap_plan(spark.createDataFrame([(0, "overview"), (7, "evidence")], "ordinal int, dimension string"), "tea", 6)
    told = lambda prompt, tokens: "1. how tea is grown today\n2. who drinks most tea" if "breadth" in prompt else "one line only"
    got = {r.role: r for r in research.M.gap_queries(told, "tea", plan, planning.DEPTHS["standard"], []).collect()}
    assert got["breadth"].queries == ["how tea is grown today", "who drinks most tea"] and got["academic"].queries[0].startswith("tea research study") and got["breadth"].label == "Gap-fill: Overview & Definition"
    lines = "\n".join(f"- query number {i}" for i in range(6))
    by_role = research.M.role_specs(spark, lambda p, n: lines if "mechanism" in p else "too few", "tea", planning.DEPTHS["shallow"])
    assert by_role == {"depth": [f"query number {i}" for i in range(4)], "academic": [f"query number {i}" for i in range(4)]}


def test_presets_and_roles():
    names = lambda k: planning.roles(planning.DEPTHS[k])
    assert names("standard") == ["breadth", "depth", "recency", "academic", "critical"]
    assert names("deep") == names("standard") + ["technical", "comparative", "statistical"]
    assert names("deeper") == names("standard") + ["statistical", "regulatory", "technical", "primary", "comparative"]
    d = planning.DEPTHS["deep"]
    assert (d.queries, d.links_seen, d.links_followed, d.outlinks, d.pool, d.workers, d.gap_queries, d.search_pages, d.few_hits) == (7, 60, 10, 60, 4, 10, 8, 2, 3)
    assert planning.budget(planning.DEPTHS["standard"], 0.3) == 5 and planning.budget(planning.DEPTHS["standard"], 0.05) == 4


def test_tasks(spark):
    d = planning.DEPTHS["deep"]
    got = planning.first_tasks(spark, "green tea", d)
    assert len(got) == 16 and [t.label for t in got[:2]] == ["Breadth", "Breadth #2"] and all(t.budget == 12 for t in got)
    assert {t.role for t in got if t.follow_links} == {"depth", "academic", "technical"} and {t.role for t in got if t.tiers} == {"academic"}
    assert got[0].queries == ("what is green tea", "green tea explained simply", "green tea real world applications examples", "green tea implementation case studies")[:0] or got[0].queries[0] == "what is green tea"
    specs = [planning.Spec("depth", "D", ["a b", "c d", "e f"], 0.5, True, ["news"]), planning.Spec("breadth", "B", ["g h"], 0.25), planning.Spec("critical", "C", ["i j"], 0.25)]
    made = planning.first_tasks(spark, "green tea", d, specs, links=False)
    assert [(t.label, t.queries, t.budget, t.follow_links, t.tiers) for t in made] == [
        ("D", ("a b", "e f"), 12, False, ("news",)), ("D #2", ("c d",), 12, False, ("news",)), ("B", ("g h",), 6, False, None), ("C", ("i j",), 6, False, None)]


def test_more_text_functions(spark):
    names = ["a.tex", "x.sql", "n.md", "q.yaml", "my_analysis.txt", "b.php", "Legal.csv", "README"]
    tags = one(spark, *[C.file_tags(F.lit(n)) for n in names])
    assert [list(t) for t in tags] == [["academic"], ["data"], ["document"], ["config"], ["document", "report"], ["general"], ["data", "legal"], ["general"]]
    q = F.lit("What is tea and how is it made")
    got = one(spark, X.mutate_query(q, 2), X.mutate_query(q, 5), X.clean_pdf_text(F.lit("-- 1 of 3 --\r\nhy-\nphen\t x\n\n\n\n12\nend ")), X.clean_web_pdf_text(F.lit("a-\nb  c\n 12 \n d ")),
              X.parse_lines(F.lit("\n".join(f"{i}. query number {i}" for i in range(9)))), X.strip_html(F.lit("a<script>x</script>b &amp;lt; &#x27;&nbsp;c")), X.heading(F.lit("\n# A")))
    assert got[0].endswith(" research 2024-2026+") and got[1] == "is tea and  is it made"
    assert got[2] == "hyphen x\n\nend" and got[3] == "ab c\nd" and len(got[4]) == 6 and got[5] == "ab < ' c" and got[6] is None
    dates = {"2024-03-05T23:30:00-05:00": "2024-03-06", "2024-03-05T10:00Z": "2024-03-05", "Tue, 05 Mar 2024 10:00:00 GMT": "2024-03-05", "2024-03": "2024-03-01", "3/5/2024": "2024-03-05", "2024-13-45": None, "5 March 2024": "2024-03-05"}
    assert list(one(spark, *[X.iso_date(F.lit(x)) for x in dates])) == list(dates.values())
    assert one(spark, X.with_clock(F.lit("hi"), F.lit("2026-01-02 03:04:05").cast("timestamp")))[0] == "Current date and time: 2026-01-02 03:04\n\nhi"


def test_outlinks_count_accepted_links(spark):
    own = "".join(f'<a href="/nav{i}">navigation {i}</a><a href="https://me.org/{i}">same host</a>' for i in range(30))
    far = "".join(f'<a href="https://o.org/{i}">other page {i}</a><a href="https://o.org/{i}">again {i}</a>' for i in range(50))
    p = spark.createDataFrame([(1, "https://me.org/a", own + far), (2, "https://me.org/b", far), (3, "https://me.org/c", own)], "page_id long, url string, html string")
    got = extract.outlinks(p).orderBy("page_id", "pos").collect()
    want = [(f"https://o.org/{i}", f"other page {i}") for i in range(40)]
    assert [[(r.href, r.text) for r in got if r.page_id == k] for k in (1, 2, 3)] == [want, want, []]


def test_chunks():
    text = "# One\n" + "Alpha beta gamma delta. " * 300 + "\n# Two\n" + "Short but long enough to keep, well over a hundred characters of text in this one section here, yes. "
    got = chunking.chunk_text(text, 1000)
    assert got[0][1] == "One" and got[-1][1] == "Two" and all(50 < len(c) <= 1300 for c, _, _ in got)
    assert len(got) < 15 and chunking.chunk_text("tiny") == [] and chunking.chunk_text("") == []
    body = "words of a section that is long enough to stand by itself in an index of many chunks, surely so. " * 2
    heads = lambda t, size=4000: [(h, d) for _, h, d in chunking.chunk_text(t, size)]
    assert heads(f"{body}\n## Two\n{body}\nRESULTS\n{body}\n1. First point of it\n{body}") == [("", 0), ("Two", 2), ("RESULTS", 2), ("1. First point of it", 2)]
    assert heads(f"{body}\nRESULTS of all\n{body}") == [("", 0)]  # a line must be capitals as a whole
    assert chunking.chunk_text(f"Short preamble.\n# One\n{body}")[0] == (f"Short preamble.\n# One\n{body}".strip(), "One", 1)
    plain = "".join(f"Sentence number {i} stands here. " for i in range(400))
    parts = [c for c, _, _ in chunking.chunk_text(plain, 1000)]
    assert all(c.endswith(".") for c in parts) and all(f"number {i} stands" in " ".join(parts) for i in range(400)) and chunking.chunk_text(plain, 100, 7)[6:] and len(chunking.chunk_text(plain, 100, 7)) == 7


def test_folder_ingest_and_round_trip(spark, tmp_path):
    d = tmp_path / "lib"
    (d / "node_modules").mkdir(parents=True)
    words = "the quick brown foxes jumped over many lazy sleeping dogs while clever birds watched from tall green trees "
    (d / "a.md").write_text("# Title here\n" + words * 3)
    (d / "b.html").write_text(f"<script>bad()</script><p>{words * 2}</p>")
    (d / "c.ipynb").write_text('{"cells":[{"cell_type":"markdown","source":["' + words + '","' + words + '"]},{"cell_type":"code","source":"x = 1"}]}')
    (d / "d.txt").write_text("short")
    for skipped in (".hidden.txt", "node_modules/x.txt", "e.exe", "f.vue", "long-name-without-any-extension"):
        (d / skipped).write_text(words * 3)
    (d / "g.ipynb").write_text(words * 3)  # no notebook at all
    f, c = files.ingest(spark, str(d), "lib1")
    assert sorted(r.file_name for r in f.collect()) == ["a.md", "b.html", "c.ipynb"]
    assert {r.file_name: (list(r.tags), r.chunk_count) for r in f.collect()}["a.md"] == (["document"], 1) and c.where("word_count >= 15").count() == 3
    (d / "h.pdf").write_bytes(b"%PDF")
    (d / "i.xhtml").write_text(f"<p>{words * 2}</p>")
    (d / "Makefile").write_text(words * 2)
    (d / "j.json").write_text('{"b": [1, {"a": null}], "a": "' + words + '"}')
    path = files.scan(spark, str(d)).where("name = 'h.pdf'").first().path
    more, _ = files.ingest(spark, str(d), "lib1", captured=spark.createDataFrame([(path, "hy-\nphen " + words)], "path string, text string"))
    assert sorted(r.file_name for r in more.collect()) == ["Makefile", "a.md", "b.html", "c.ipynb", "h.pdf", "i.xhtml", "j.json"]
    texts = {r.name: r.text for r in files.read_folder(spark, str(d)).collect()}
    assert texts["j.json"].startswith("{") and "\n" in texts["j.json"] and texts["i.xhtml"].startswith("the quick") and texts["g.ipynb"] is None
    texts = {r.file_name: r.text for r in c.collect()}
    assert "bad()" not in texts["b.html"] and texts["c.ipynb"].startswith("[markdown]\n")
    files.save(spark, {"files": f, "chunks": c}, str(tmp_path / "index"))
    again = files.load(spark, str(tmp_path / "index"))
    assert again["files"].count() == 3 and again["chunks"].count() == c.count() and again["files"].columns == f.columns


def test_stream_equals_batch(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    parts = str(tmp_path / "in")
    docs.repartition(3).write.parquet(parts)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(parts)
    q = ingest.start(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    df, stats = ingest.statistics(spark, str(tmp_path / "out"))
    c = C.windows(docs)
    want = {r.term: r.df for r in C.document_frequency(C.postings(c)).collect()}
    assert {r.term: r.df for r in df.collect()} == want
    filled = c.where(F.size(X.terms("text")) > 0)
    assert stats.first().n == filled.count()


FILL = " word" * 60


def _web(spark, hosts=50):
    qs = [r.query for r in planning.fallback_queries(spark, "tea", 8).collect()]
    rows = [(q, 1, f"https://s{i % hosts}.org/research/{i}", f"tea {i}", "tea") for i, q in enumerate(dict.fromkeys(qs))]
    hits = spark.createDataFrame(rows, "query string, seq int, url string, title string, snippet string")
    return hits, hits.select("url", F.concat(F.lit("Tea research study says that tea is a drink. "), F.col("url"), F.lit(FILL)).alias("text"))


def test_research_rounds(spark):
    hits, pages = _web(spark)
    got = research.research("tea", hits, pages, "shallow")
    n = got.sources.count()
    assert n > 0 and got.rounds == 1 and got.sources.select("url").distinct().count() == n and got.markdown.startswith("# Research report: tea")
    assert report.citations(report.indexed(got.sources)).count() == n


def test_research_over_rounds(spark):
    """Gaps make more rounds; host caps hold across them; links and local chunks become sources."""
    hits, pages = _web(spark, hosts=3)
    link = "array<struct<text:string,href:string>>"
    # a page of a role that follows links leads to one that no search finds, and that one to a further one
    deep = F.array(F.struct(F.lit("research on tea").alias("text"), F.lit("https://linked.org/research/1").alias("href")))
    pages = pages.withColumn("outlinks", F.when(F.col("url").endswith("/9"), deep).otherwise(F.array().cast(link)))
    more = spark.createDataFrame([("https://linked.org/research/1", "Tea found by a link. " + FILL, [("more on tea", "https://second.org/research/2")]), ("https://second.org/research/2", "Tea found by two. " + FILL, [])], f"url string, text string, outlinks {link}")
    docs = spark.createDataFrame([(1, "what is green tea definition and overview of tea " + FILL, "src0"), (2, "nothing of note at all " + FILL, "src3")], "doc_id long, text string, source string")
    got = research.research("tea", hits, pages.unionByName(more), "standard", local=C.windows(docs))
    s = got.sources.collect()
    web = [r for r in s if r.origin == "web"]
    assert got.rounds > 1 and len({r.url for r in s}) == len(s) == len({r.fp for r in s})
    per_host = {h: sum(r.host == h for r in web) for h in {r.host for r in web}}
    assert max(per_host.values()) <= 4 and any(r.ord >= research.ROUND for r in s) or got.rounds > 1
    assert {"https://linked.org/research/1", "https://second.org/research/2"} <= {r.url for r in web}
    local = [r for r in s if r.origin == "local"]
    assert {r.url.split("/")[2] for r in local} == {"src0", "src3"} and {(r.tier, r.domain_score) for r in local} == {("reference", 95), ("general", 75)}
    assert f"({len(web)} web, {len(local)} local)" in got.markdown and "overview" in got.covered + got.gaps


def test_research_with_a_model(spark):
    hits, pages = _web(spark)
    asked = []

    def model(prompt, tokens):
        asked.append((prompt, tokens))
        if "JSON array" in prompt:
            return '[{"role":"depth","label":"Own","queries":["what is tea","tea explained simply"]},{"role":"critical","queries":["who invented tea","tea timeline evolution"]},{"role":"recency","queries":["how does tea work","tea technical architecture"]}]'
        if "paragraphs" in prompt:
            return "A story of tea. " * 20
        if "contradict" in prompt:
            return "CLAIM: x | SOURCE_A: [1] p | SOURCE_B: [2] q | SEVERITY: major"
        raise TimeoutError

    got = research.research("tea", hits, pages, "shallow", model=model)
    assert {r.worker_label for r in got.sources.collect()} <= {"Own", "critical worker", "recency worker"} and set(got.queries) <= {"what is tea", "tea explained simply", "who invented tea", "tea timeline evolution", "how does tea work", "tea technical architecture"}
    assert got.narrative.startswith("A story") and [c["severity"] for c in got.contradictions] == ["major"] and "## Synthesis" in got.markdown and "- (major) x" in got.markdown
    assert any(t == 3000 for _, t in asked) and research.M.ask(model, "else", 5) is None and research.M.paragraphs(21) == "6 to 10"
