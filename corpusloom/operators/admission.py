"""Which pages become sources: relevance, fingerprints, host caps, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X

LEAST_WORDS = 50
DENSITY_CHARS = 8000


def relevance(text: Column, title: Column, snippet: Column, words: list[str]) -> Column:
    """Shares of keywords in text, title and snippet, and their density, in [0, 1]."""
    if not words:
        return F.lit(0.5)
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    share = lambda c: sum((F.contains(low(c), F.lit(w)).cast("int") for w in words), F.lit(0)) / len(words)
    head = low(F.left(text, F.lit(DENSITY_CHARS)))
    count = sum((X.occurrences(head, w) for w in words), F.lit(0))
    n = F.size(F.split(head, r"\s+"))
    total = share(text) + 0.15 * share(title) + 0.08 * share(snippet) + 0.1 * F.least(F.lit(1.0), 10 * count / n)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def admit(candidates: DataFrame, visited: DataFrame, prints: DataFrame, least_relevance: float, host_cap: int, budget: int | Column, hosts: DataFrame | None = None) -> DataFrame:
    """Candidates (task_id, ord, url, host, text, word_count, relevance) that are let in.

    Order: not visited, long and relevant enough, first of its fingerprint and
    not known, within the host's cap, within the task's budget.  ``hosts``
    (host, n) says how many pages of a host earlier rounds let in.
    """
    c = candidates.join(visited.select("url"), "url", "left_anti")
    c = c.where((F.col("word_count") >= LEAST_WORDS) & (F.col("relevance") >= least_relevance)).withColumn("fp", X.fingerprint("text"))
    c = c.join(prints.select("fp"), "fp", "left_anti")
    c = c.withColumn("__a", _turn("fp")).where("__a = 1")
    c = within_host_cap(c, host_cap, hosts)
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    return c.withColumn("__c", _turn("task_id")).where(F.col("__c") <= limit).drop("__a", "__c")


def _turn(key: str) -> Column:
    return F.row_number().over(Window.partitionBy(key).orderBy("ord"))


def within_host_cap(candidates: DataFrame, cap: int, hosts: DataFrame | None = None) -> DataFrame:
    """The first candidates (host, ord) of each host, as many as the cap leaves after the earlier ones."""
    c = candidates.withColumn("__b", _turn("host")).where(F.col("__b") <= cap)
    if hosts is not None:
        earlier = hosts.select(F.col("host").alias("__host"), F.col("n").alias("__n"))
        c = c.join(earlier, F.col("host") == F.col("__host"), "left").where(F.col("__b") + F.coalesce("__n", F.lit(0)) <= cap).drop("__host", "__n")
    return c.drop("__b")


def discoveries(sources: DataFrame, visited: DataFrame, per_source: int = 5, most: int = 5) -> DataFrame:
    """First outlinks (array of struct text, href) of each source, unvisited, each once, in order."""
    links = sources.select("ord", F.posexplode(F.slice("outlinks", 1, per_source)).alias("pos", "link"))
    flat = links.select("ord", "pos", F.col("link.href").alias("url"), F.col("link.text").alias("text"))
    first = flat.groupBy("url").agg(F.min(F.struct("ord", "pos", "text")).alias("f")).select("f.ord", "f.pos", "url", "f.text")
    return first.join(visited.select("url"), "url", "left_anti").orderBy("ord", "pos").limit(most)
