"""Search result pages, captured, into hits (engine, query, seq, url, title, snippet)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X

# Where each engine's page has blocks, links, and snippets.
ENGINES = {
    "lite": (None, r"""(?is)<a[^>]*(?:rel=["']nofollow["']|class=["']result-link["'])[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>""", r"""(?is)<td[^>]*class=["']result-snippet["'][^>]*>(.*?)</td>"""),
    "html": (r"""(?is)<div[^>]*class=["'][^"']*result__body.*?(?=<div[^>]*class=["'][^"']*result__body|$)""", r"""(?is)<a[^>]*class=["'][^"']*result__a[^"']*["'][^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>""", r"""(?is)class=["'][^"']*result__snippet[^"']*["'][^>]*>(.*?)</a>"""),
    "brave": (r"""(?is)<div[^>]*class=["'][^"']*snippet\b.*?(?=<div[^>]*class=["'][^"']*snippet\b|$)""", r"""(?is)<a[^>]*href=["'](https?://[^"']+)["'][^>]*>(.*?)</a>""", r"""(?is)class=["'][^"']*snippet-description[^"']*["'][^>]*>(.*?)</"""),
    "scholar": (r"""(?is)<div[^>]*class=["'][^"']*gs_ri.*?(?=<div[^>]*class=["'][^"']*gs_ri|$)""", r"""(?is)<a[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>""", r"""(?is)class=["'][^"']*gs_rs[^"']*["'][^>]*>(.*?)</div>"""),
    "mojeek": (None, r"""(?is)<a[^>]*class=["'][^"']*title[^"']*["'][^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>""", r"""(?is)<p[^>]*class=["']s["'][^>]*>(.*?)</p>"""),
}


# Links that are taken where an engine's page has no hit of the usual form; whether the title is the snippet too.
FALLBACKS = {
    "html": (r"""(?is)\shref="[^"]*?(https?[^?&"]+)[^>]*>([^<]*)""", True),
    "brave": (r"""(?is)<a[^>]+href="(https?://[^"]+)"[^>]*class="[^"]*heading[^"]*"[^>]*>(.*?)</a>""", False),
}
#: The engines' own pages are no hits.
OWN_PAGES = r"(?i)^https?://([^/]*\.)?(duckduckgo|brave)\.com(/|$)"


def target(href: Column) -> Column:
    """The page behind a redirect link."""
    inner = F.regexp_extract(href, r"[?&](?:uddg|url|q)=(https?(?:%3A|:)[^&]+)", 1)
    plain = F.when(F.contains(href, F.lit("%3A%2F%2F")), F.coalesce(F.try_url_decode(href), href)).otherwise(href)
    return F.when(inner != "", F.try_url_decode(inner)).otherwise(F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(plain))


def parse_html(pages: DataFrame, engine: str, most: int = 20) -> DataFrame:
    """Hits of one engine's captured pages (engine, query, body).

    Links and snippets are paired by place before links are filtered.  Pages
    without a hit are read by the engine's fallback, if it has one.
    """
    block, link, snippet = ENGINES[engine]
    own = pages.where(F.col("engine") == engine)
    if block:
        flat = own.select("query", F.posexplode(F.regexp_extract_all("body", F.lit(block), F.lit(0))).alias("pos", "b"))
        rows = flat.select("query", "pos", F.regexp_extract("b", link, 1).alias("href"), F.regexp_extract("b", link, 2).alias("t"), F.regexp_extract("b", snippet, 1).alias("s"))
    else:
        three = F.arrays_zip(
            F.regexp_extract_all("body", F.lit(link), F.lit(1)).alias("href"),
            F.regexp_extract_all("body", F.lit(link), F.lit(2)).alias("t"),
            F.regexp_extract_all("body", F.lit(snippet), F.lit(1)).alias("s"),
        )
        rows = own.select("query", F.posexplode(three).alias("pos", "z")).select("query", "pos", "z.href", "z.t", "z.s")
    hits = _hits(rows, engine)
    if engine in FALLBACKS:
        pattern, twice = FALLBACKS[engine]
        two = F.arrays_zip(F.regexp_extract_all("body", F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all("body", F.lit(pattern), F.lit(2)).alias("t"))
        bare = own.join(hits.select("query").distinct(), "query", "left_anti").select("query", F.posexplode(two).alias("pos", "z"))
        found = _hits(bare.select("query", "pos", "z.href", "z.t", F.lit(None).cast("string").alias("s")), engine)
        hits = hits.unionByName(found if twice else found.withColumn("snippet", F.lit("")))
    return first_urls(hits, most)


def _hits(rows: DataFrame, engine: str) -> DataFrame:
    """Links with a target and a title; a missing snippet is the title."""
    title, text = X.strip_html("t"), X.strip_html(F.coalesce("s", F.lit("")))
    hits = rows.select(F.lit(engine).alias("engine"), "query", "pos", target(F.col("href")).alias("url"), title.alias("title"), F.when(text != "", text).otherwise(title).alias("snippet"))
    return hits.where(F.col("url").rlike("^https?://") & ~F.col("url").rlike(OWN_PAGES) & (F.length("title") > 0))


def parse_json(pages: DataFrame, most: int = 20) -> DataFrame:
    """Hits of captured JSON answers with a ``results`` array."""
    got = F.from_json("body", "results array<struct<url:string,title:string,content:string>>")
    flat = pages.where("engine = 'searx'").select("query", F.posexplode(got["results"]).alias("pos", "r"))
    hits = flat.select(F.lit("searx").alias("engine"), "query", "pos", F.col("r.url").alias("url"), F.coalesce("r.title", F.lit("")).alias("title"),
                       F.coalesce("r.content", "r.title", F.lit("")).alias("snippet"))
    return first_urls(hits.where(F.col("url").rlike("^https?://")), most)


def first_urls(hits: DataFrame, most: int) -> DataFrame:
    one = hits.withColumn("__n", F.row_number().over(Window.partitionBy("engine", "query", "url").orderBy("pos"))).where("__n = 1").drop("__n")
    w = Window.partitionBy("engine", "query").orderBy("pos")
    return one.withColumn("seq", F.row_number().over(w)).where(F.col("seq") <= most).drop("pos")


def parse_all(pages: DataFrame, most: int = 20) -> DataFrame:
    out = parse_json(pages, most)
    for engine in ENGINES:
        out = out.unionByName(parse_html(pages, engine, most))
    return out


def merge(hits: DataFrame, engines: list[str]) -> DataFrame:
    """All engines' hits in engine order, each URL once per query."""
    order = F.struct(F.array_position(F.array(*[F.lit(e) for e in engines]), F.col("engine")), F.col("seq"))
    w = Window.partitionBy("query", "url").orderBy(order)
    return hits.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def pages_until_thin(hits: DataFrame, per_page: int, errors: DataFrame | None = None, most_errors: int = 3) -> DataFrame:
    """Result pages in order, up to and with the first that is less than half full, each URL once.

    ``errors`` (query, page, errors) has the error count before a page is asked
    for; from the second page on ``most_errors`` end the search.
    """
    n = hits.groupBy("query", "page").agg(F.count("*").alias("n"))
    stop = F.coalesce(F.lag(F.col("n") < per_page * 0.5).over(Window.partitionBy("query").orderBy("page")), F.lit(False))
    if errors is not None:
        n = n.join(errors.select("query", "page", "errors"), ["query", "page"], "left")
        stop = stop | ((F.col("page") > 1) & (F.coalesce("errors", F.lit(0)) >= most_errors))
    n = n.withColumn("stop", stop.cast("int"))
    ended = F.max("stop").over(Window.partitionBy("query").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    kept = hits.join(n.withColumn("ended", ended).where("ended = 0").select("query", "page"), ["query", "page"], "left_semi")
    w = Window.partitionBy("query", "url").orderBy("page", "seq")
    return kept.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
