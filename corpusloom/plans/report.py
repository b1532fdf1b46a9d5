"""The Markdown report and its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import coverage as V


def indexed(sources: DataFrame, order: str = "ord") -> DataFrame:
    """Sources numbered from 1 in collection order."""
    # one numbering over a run's sources, which its page budgets bound
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled"))
    return sources.withColumn("idx", F.row_number().over(Window.orderBy(order))).withColumn("title", title)


def header(sources: DataFrame) -> DataFrame:
    """One row: worker labels in order of appearance, sources, web and local ones, dimensions covered of how many."""
    labels = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "worker_label"))), lambda x: x["worker_label"]), ", ")  # one entry a worker
    who = activity(sources).agg(labels.alias("workers"), F.coalesce(F.sum("sources"), F.lit(0)).alias("sources"))
    local = sources.agg(F.count(F.when(F.col("origin") == "local", 1)).alias("local"))
    cover = V.covered(V.dimension_hits(sources)).agg(F.count(F.when(F.col("covered"), 1)).alias("covered"), F.count("*").alias("dimensions"))
    one = who.withColumn("k", F.lit(1)).join(local.withColumn("k", F.lit(1)), "k").join(cover.withColumn("k", F.lit(1)), "k").drop("k")  # one row each
    return one.withColumn("web", F.col("sources") - F.col("local"))


def activity(sources: DataFrame) -> DataFrame:
    return sources.groupBy("worker_label").agg(F.count("*").alias("sources"), F.min("ord").alias("first")).orderBy("first")


def distinct_queries(sources: DataFrame) -> DataFrame:
    first = sources.groupBy("source_query").agg(F.min("ord").alias("first"))
    return first.withColumn("number", F.row_number().over(Window.orderBy("first")))


def citations(sources: DataFrame) -> DataFrame:
    line = F.concat(F.lit("["), F.col("idx"), F.lit("] "), X.escape_markdown("title"), F.lit(" - "), F.col("url"))
    return sources.select("idx", line.alias("line"))


def tool_output(sources: DataFrame, chars: int = 200) -> DataFrame:
    """What a tool returns of each source: its place, scores, relevance in percent and an excerpt."""
    percent = F.floor(F.col("relevance") * 100 + 0.5).cast("int")
    excerpt = F.left(F.coalesce("description", F.lit("")), F.lit(chars))
    return sources.select("idx", "title", "url", "published", "domain_score", "tier", "worker_role", "worker_label", percent.alias("relevance"), "origin", excerpt.alias("excerpt"))


def details(sources: DataFrame, chars: int = 700) -> DataFrame:
    more = F.when(F.length("text") > chars, F.lit("...")).otherwise(F.lit(""))
    percent = F.floor(F.col("relevance") * 100 + 0.5).cast("int")
    origin = F.when(F.col("origin") == "local", ", local").otherwise("") if "origin" in sources.columns else F.lit("")
    score = F.concat(F.lit(", "), "domain_score", F.lit("/100")) if "domain_score" in sources.columns else F.lit("")
    badge = F.concat("tier", score, origin)
    return sources.select("idx", "title", "url", "tier", badge.alias("badge"), percent.alias("relevance_percent"), F.concat(X.preview("text", chars), more).alias("preview"))


def build(
    topic: str, sources: DataFrame, words: list[str], narrative: str | None = None, contradictions: list[dict] | None = None, rounds: int | None = None,
    queries: list[str] | None = None,
) -> str:
    """The whole report over a run's sources, which its page budgets bound; ``words`` default to the topic's."""
    s = indexed(sources)
    words = words or list(s.sparkSession.range(1).select(X.report_keywords(F.lit(topic))).first()[0])
    top, cover = header(s).first(), V.covered(V.dimension_hits(s)).orderBy("ordinal").collect()
    out = [f"# Research report: {topic}", "", f"Workers: {top.workers}", f"Sources: {top.sources} ({top.web} web, {top.local} local)"]
    out += [f"Rounds: {rounds}"] if rounds else []
    out += [f"Coverage: {top.covered}/{top.dimensions}", "", "| Dimension | Covered |", "| --- | --- |"]
    out += [f"| {r.dimension} | {'yes' if r.covered else 'no'} |" for r in cover]
    if narrative:
        out += ["", "## Synthesis", "", narrative]
    if contradictions:
        out += ["", "## Contradictions", ""] + [f"- ({c['severity']}) {c['claim']}: [{c['a']}] {c['a_says']} / [{c['b']}] {c['b_says']}" for c in contradictions]
    shared = V.consensus(s, words).collect()
    if shared:
        out += ["", "## Consensus", ""] + [f'- "{r.phrase}" ({r.sources} of {top.sources} sources)' for r in shared]
    found = V.findings_by_dimension(s, words).orderBy("ordinal", "idx", "pos").collect()
    at = None
    for r in found:
        if r.dimension != at:
            out += ["", f"## {r.dimension}", ""]
            at = r.dimension
        out.append(f"- {r.sentence} [{r.idx}]")
    out += ["", "## Workers", ""] + [f"- {r.worker_label}: {r.sources}" for r in activity(s).collect()]
    asked = queries if queries is not None else [r.source_query for r in distinct_queries(s).orderBy("number").collect()]
    out += ["", "## Queries", ""] + [f"{k}. {q}" for k, q in enumerate(asked, 1)]
    out += ["", "## Sources", ""]
    out += [f"### [{r.idx}] {r.title}\n{r.url} ({r.badge}, {r.relevance_percent}%)\n\n{r.preview}\n" for r in details(s).orderBy("idx").collect()]
    out += ["## Citations", ""] + [r.line for r in citations(s).orderBy("idx").collect()]
    return "\n".join(out)
