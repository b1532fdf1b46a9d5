"""Candidate pages: host authority, URL quality, freshness, rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.tables import DOMAINS, OTHER_DOMAIN, SUFFIXES, URL_BASE, URL_RULES


def authority(spark: SparkSession) -> DataFrame:
    """ordinal, domain, domain_score, tier."""
    rows = [(d, s, t) for t, of in DOMAINS.items() for d, s in of.items()]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ordinal int, domain string, domain_score int, tier string")


def with_authority(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host, domain_score and tier.

    The exact host wins; then the first listed domain that the host ends in;
    then the first listed suffix; then the default.  Every host is expanded to
    its own endings and joined by equality to the fixed, broadcast table.
    """
    spark = pages.sparkSession
    named = pages.withColumn("host", X.host(url))
    hosts = named.select("host").distinct()
    parts = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    dim = F.broadcast(authority(spark))  # one row per listed domain
    hit = hosts.select("host", F.explode(ends).alias("domain")).join(dim, "domain")
    order = F.struct((F.col("domain") != F.col("host")).cast("int"), "ordinal")
    best = hit.groupBy("host").agg(F.min_by(F.struct("domain_score", "tier"), order).alias("best"))
    suffix = F.coalesce(*[F.when(F.col("host").endswith(s), F.struct(F.lit(n).alias("domain_score"), F.lit(t).alias("tier"))) for s, n, t in SUFFIXES])
    other = F.struct(F.lit(OTHER_DOMAIN[0]).alias("domain_score"), F.lit(OTHER_DOMAIN[1]).alias("tier"))
    both = named.join(best, "host", "left").withColumn("best", F.coalesce("best", suffix, other))
    return both.select(*pages.columns, "host", F.col("best.domain_score").alias("domain_score"), F.col("best.tier").alias("tier"))


def url_quality(url: Column | str) -> Column:
    c = F.col(url) if isinstance(url, str) else url
    total = F.lit(URL_BASE)
    for pattern, delta in URL_RULES:
        total = total + F.when(c.rlike(pattern), delta).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def freshness(url: Column, title: Column, snippet: Column, year: int) -> Column:
    """By the year in the URL, else by words in title and snippet; ``year`` is given, not the clock's."""
    found = F.nullif(F.regexp_extract(url, "/(20[0-9]{2})/", 1), F.lit("")).cast("int")
    age = F.lit(year) - found
    by_url = F.when(age <= 0, 100).when(age == 1, 85).when(age == 2, 70).when(age == 3, 55).otherwise(F.greatest(F.lit(10), 55 - (age - 3) * 8))
    words = F.lower(F.concat_ws(" ", title, snippet))
    by_words = (
        F.when(F.contains(words, F.lit(str(year))), 85)
        .when(F.contains(words, F.lit(str(year - 1))), 70)
        .when(words.rlike(r"latest|new\s|recent|just\s|breaking"), 65)
        .otherwise(50)
    )
    return F.when(found.isNotNull(), by_url).otherwise(by_words)


def score(hits: DataFrame, year: int) -> DataFrame:
    """``hits`` (url, title, snippet) with all scores."""
    s = with_authority(hits).withColumn("url_quality", url_quality("url"))
    s = s.withColumn("freshness_score", freshness(F.col("url"), F.col("title"), F.col("snippet"), year))
    total = F.floor(F.col("domain_score") * 0.55 + F.col("url_quality") * 0.25 + F.col("freshness_score") * 0.2 + 0.5)
    return s.withColumn("total_score", total.cast("int"))


def rank(scored: DataFrame, limit: int, seq: str = "seq") -> DataFrame:
    good = scored.where("total_score > 12 and url_quality > 8")
    return good.orderBy(F.col("total_score").desc(), seq).limit(limit)


def prefer_tiers(candidates: DataFrame, tiers: list[str], task: str = "task_id") -> DataFrame:
    """Keep preferred tiers in each task that has any of them."""
    hit = F.col("tier").isin(tiers).cast("int")
    best = candidates.groupBy(F.col(task).alias("__task")).agg(F.max(hit).alias("__any"))
    both = candidates.join(best, F.col(task).eqNullSafe(F.col("__task")))
    return both.where((hit == 1) | (F.col("__any") == 0)).drop("__task", "__any")


def first_per(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return first_in(rows, [key], order)


def first_in(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each combination of keys."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def outlink_score(domain_score: Column, quality: Column, text: Column, keywords: Column) -> Column:
    """By authority, URL quality, and the keywords (an array) in the anchor's text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return 0.4 * domain_score + 0.2 * quality + 20 * F.size(F.filter(keywords, lambda k: F.contains(low, k)))


def score_outlinks(links: DataFrame, keywords: list[str] | Column, visited: DataFrame, most: int, task: str | None = None) -> DataFrame:
    """The best unvisited links (href, text, seq), ``most`` of all or of each ``task``."""
    words = keywords if isinstance(keywords, Column) else F.array(*[F.lit(k) for k in keywords]).cast("array<string>")
    fresh = links.where(F.col("href").rlike("^https?://")).join(visited.select(F.col("url").alias("href")), "href", "left_anti")
    s = with_authority(fresh, "href").withColumn("url_quality", url_quality("href"))
    s = s.withColumn("score", outlink_score(F.col("domain_score"), F.col("url_quality"), F.col("text"), words)).where("score > 20")
    if task is None:
        return s.orderBy(F.col("score").desc(), "seq").limit(most)
    w = Window.partitionBy(task).orderBy(F.col("score").desc(), "seq")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
