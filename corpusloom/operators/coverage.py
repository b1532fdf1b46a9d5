"""Topical coverage, consensus phrases, key sentences, and parsers of model answers."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as X
from corpusloom.functions.tables import DIMENSIONS, GAP_ROLES, KEY_MARKERS

LEAST_HITS, LEAST_CHARS, CONTEXT = 3, 200, 50


def dimensions(spark: SparkSession) -> DataFrame:
    """ordinal, dimension, label: twelve rows."""
    return spark.createDataFrame([(i, d[0], d[1]) for i, d in enumerate(DIMENSIONS)], "ordinal int, dimension string, label string")


#: (ordinal, dimension, keyword) of all dimensions.
KEYWORDS = [(i, d[0], k) for i, d in enumerate(DIMENSIONS) for k in d[2]]


@functools.cache
def _automaton():
    """An Aho-Corasick automaton over all keywords; a word of several dimensions has the numbers of each."""
    import ahocorasick

    found: dict[str, list[int]] = {}
    for n, (_, _, k) in enumerate(KEYWORDS):
        found.setdefault(k, []).append(n)
    out = ahocorasick.Automaton()
    for k, numbers in found.items():
        out.add_word(k, (len(k), numbers))
    out.make_automaton()
    return out


def count_keywords(text: str, total: list[int]) -> None:
    """Add the non-overlapping places of every keyword in a lower-case text to ``total``; one pass over the text."""
    free: dict[int, int] = {}  # from where on the next place of a keyword counts
    for end, (size, numbers) in _automaton().iter(text):
        first = numbers[0]
        if end - size + 1 >= free.get(first, 0):
            free[first] = end + 1
            for n in numbers:
                total[n] += 1


def dimension_hits(sources: DataFrame, text: str = "text") -> DataFrame:
    """ordinal, dimension, keyword, hits over all texts; one pass over each, one row a keyword and task."""

    def run(batches):
        import pyarrow as pa

        total = [0] * len(KEYWORDS)
        for b in batches:
            for t in b.column(0):
                count_keywords(t.as_py(), total)
        yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.int64())], ["number", "n"])

    counts = sources.select(F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t")).mapInArrow(run, "number int, n long")
    counts = counts.groupBy("number").agg(F.sum("n").alias("n"))
    names = sources.sparkSession.createDataFrame([(n, *k) for n, k in enumerate(KEYWORDS)], "number int, ordinal int, dimension string, keyword string")
    return names.join(F.broadcast(counts), "number", "left").select("ordinal", "dimension", "keyword", F.coalesce("n", F.lit(0)).alias("hits"))  # a hundred rows


def mentions(sources: DataFrame) -> DataFrame:
    """idx, ordinal, dimension: which dimensions each source (idx, text) mentions; one pass over each text."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [sorted({KEYWORDS[n][0] for _, (_, numbers) in _automaton().iter(t.as_py()) for n in numbers}) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], ["idx", "ordinals"])

    low = sources.select("idx", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    kind = T.StructType([low.schema["idx"], T.StructField("ordinals", T.ArrayType(T.IntegerType()))])
    names = F.array(*[F.lit(d[0]) for d in DIMENSIONS])
    return low.mapInArrow(run, kind).select("idx", F.explode("ordinals").alias("ordinal")).select("idx", "ordinal", F.element_at(names, F.col("ordinal") + 1).alias("dimension"))


def covered(hits: DataFrame) -> DataFrame:
    """ordinal, dimension, hits, chars, covered for all twelve dimensions."""
    chars = F.sum(F.col("hits") * (F.length("keyword") + CONTEXT))
    total = hits.groupBy("ordinal", "dimension").agg(F.sum("hits").alias("hits"), chars.alias("chars"))
    return total.withColumn("covered", (F.col("hits") >= LEAST_HITS) & (F.col("chars") >= LEAST_CHARS))


def gaps(hits: DataFrame) -> DataFrame:
    return covered(hits).where("not covered").select("ordinal", "dimension")


def templates(spark: SparkSession, topic: str) -> DataFrame:
    """ordinal, dimension, pos, query; ``topic`` as it is to stand in a query."""
    rows = [(i, d[0], p, q.replace("{t}", topic)) for i, d in enumerate(DIMENSIONS) for p, q in enumerate(d[3])]
    return spark.createDataFrame(rows, "ordinal int, dimension string, pos int, query string")


def gap_queries(gap: DataFrame, topic: str, most: int) -> DataFrame:
    """Queries for the gaps in dimension order, each once."""
    q = templates(gap.sparkSession, topic).join(gap.select("dimension"), "dimension", "left_semi")
    first = q.groupBy("query").agg(F.min(F.struct("ordinal", "pos")).alias("at"))
    return first.orderBy("at").limit(most).select("query", F.col("at.ordinal").alias("ordinal"), F.col("at.pos").alias("pos"))


def gap_plan(gap: DataFrame, topic: str, most: int) -> DataFrame:
    """One row per role that fills gaps: its label, queries, links and tiers; ``topic`` as it is to stand in a query.

    A role's first gap decides on links and tiers; roles are in the order of theirs.
    """
    spark = gap.sparkSession
    label = {d[0]: d[1] for d in DIMENSIONS}
    rows = [(d, label[d], r, f, t) for d, (r, f, t) in GAP_ROLES.items()]
    who = spark.createDataFrame(rows, "dimension string, label string, role string, follow_links boolean, tiers array<string>")
    mine = templates(spark, topic).groupBy("dimension").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "query"))), lambda x: x["query"]).alias("queries"))
    both = gap.join(who, "dimension").join(mine, "dimension")
    out = both.groupBy("role").agg(
        F.min("ordinal").alias("ordinal"),
        F.min_by("follow_links", "ordinal").alias("follow_links"),
        F.min_by("tiers", "ordinal").alias("tiers"),
        F.sort_array(F.collect_list(F.struct("ordinal", "label", "queries"))).alias("of"),  # twelve dimensions at most
    )
    return out.select(
        "ordinal", "role", "follow_links", "tiers",
        F.concat(F.lit("Gap-fill: "), F.array_join(F.slice(F.col("of.label"), 1, 3), ", ")).alias("label"),
        F.slice(F.flatten("of.queries"), 1, most).alias("queries"),
    )


def consensus(sources: DataFrame, words: list[str], most: int = 10) -> DataFrame:
    """Two- and three-word phrases that many sources (idx, text) share."""
    n = sources.count()
    least = max(2, -(-n * 4 // 10))
    ws = F.slice(F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: F.length(w) > 3), 1, 500)
    base = sources.select("idx", ws.alias("w")).where(F.size("w") > 2)
    grams = F.transform(F.array("w"), lambda w: F.flatten(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.array(
        F.struct((i * 2).alias("pos"), F.concat_ws(" ", w[i], w[i + 1]).alias("g")),
        F.struct((i * 2 + 1).alias("pos"), F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("g")),
    ))))[0]
    flat = base.select("idx", F.explode(grams).alias("x")).groupBy("idx", "x.g").agg(F.min("x.pos").alias("pos"))
    total = flat.groupBy("g").agg(F.count("*").alias("sources"), F.min(F.struct("idx", "pos")).alias("first"))
    topical = F.lit(False)
    for w in words:
        topical = topical | F.contains("g", F.lit(w))
    good = total.where((F.col("sources") >= least) & topical) if n > 1 else total.limit(0)
    return good.orderBy(F.col("sources").desc(), "first").limit(most).select(F.col("g").alias("phrase"), "sources")


def sentences(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"\n+", " "), r"(?<=[.!?])\s+")


def sentence_score(sentence: Column, words: list[str]) -> Column:
    low = F.lower(sentence)
    marks = sum((F.contains(low, F.lit(m)).cast("int") for m in KEY_MARKERS), F.lit(0))
    own = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    return 2.0 * marks + 3.0 * own - F.abs(F.length(sentence) - 150) / 50


def key_sentences(sources: DataFrame, words: list[str], n: int = 3) -> DataFrame:
    """The best ``n`` sentences of each source (idx, text), in text order."""
    flat = sources.select("idx", F.posexplode(sentences(F.col("text"))).alias("pos", "raw"))
    flat = flat.withColumn("sentence", F.trim("raw")).where((F.length("sentence") > 40) & (F.length("sentence") < 600))
    scored = flat.withColumn("score", sentence_score(F.col("sentence"), words))
    w = Window.partitionBy("idx").orderBy(F.round("score", 9).desc(), "pos")
    return scored.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n).select("idx", "pos", "sentence", "score")


def findings_by_dimension(sources: DataFrame, words: list[str], per_dimension: int = 5, n: int = 3) -> DataFrame:
    """For each dimension, key sentences of the first sources that mention it."""
    hit = mentions(sources)
    first = hit.withColumn("turn", F.row_number().over(Window.partitionBy("dimension").orderBy("idx"))).where(F.col("turn") <= per_dimension)
    texts = sources.select("idx", "text").join(first.select("idx", "ordinal", "dimension"), "idx")
    extra = F.lit(None)
    for _, (dim, _, ks, _) in enumerate(DIMENSIONS):
        extra = F.when(F.col("dimension") == dim, F.array(*[F.lit(k) for k in ks])).otherwise(extra)
    flat = texts.withColumn("ks", extra).select("ordinal", "dimension", "ks", "idx", F.posexplode(sentences(F.col("text"))).alias("pos", "raw"))
    flat = flat.withColumn("sentence", F.trim("raw")).where((F.length("sentence") > 40) & (F.length("sentence") < 600))
    own = F.size(F.filter("ks", lambda k: F.contains(F.lower("sentence"), k)))
    scored = flat.withColumn("score", sentence_score(F.col("sentence"), words) + 3.0 * own)
    w = Window.partitionBy("dimension", "idx").orderBy(F.round("score", 9).desc(), "pos")
    return scored.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n).select("ordinal", "dimension", "idx", "pos", "sentence")


def parse_contradictions(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Lines ``CLAIM: .. | SOURCE_A: [i] .. | SOURCE_B: [j] .. | SEVERITY: ..``."""
    lines = answers.select(F.posexplode(F.split("body", "\n")).alias("pos", "line")).where(F.col("line").rlike("(?i)CLAIM:.*SOURCE_A:.*SOURCE_B:"))
    part = lambda p, g=1: F.trim(F.regexp_extract("line", p, g))
    got = lines.select(
        "pos",
        part(r"(?i)CLAIM:\s*([^|]*)").alias("claim"),
        part(r"(?i)SOURCE_A:\s*\[(\d+)\]").cast("int").alias("a"),
        part(r"(?i)SOURCE_A:\s*\[\d+\]\s*([^|]*)").alias("a_says"),
        part(r"(?i)SOURCE_B:\s*\[(\d+)\]").cast("int").alias("b"),
        part(r"(?i)SOURCE_B:\s*\[\d+\]\s*([^|]*)").alias("b_says"),
        F.lower(part(r"(?i)SEVERITY:\s*(minor|moderate|major)")).alias("severity"),
    ).where("a is not null and b is not null")
    title = sources.select("idx", "title")
    a = title.toDF("a", "a_title")
    b = title.toDF("b", "b_title")
    name = lambda c: F.coalesce(F.col(f"{c}_title"), F.concat(F.lit("Source "), F.col(c)))
    out = got.join(a, "a", "left").join(b, "b", "left")
    return out.select("pos", "claim", "a", name("a").alias("a_title"), "a_says", "b", name("b").alias("b_title"), "b_says",
                      F.when(F.col("severity") == "", "minor").otherwise(F.col("severity")).alias("severity"))


def parse_findings(answers: DataFrame) -> DataFrame:
    """Items of at least five characters under ``FINDINGS:`` and ``FOLLOW_UP:``: id, section, pos, item."""
    lines = answers.select("id", F.posexplode(F.split("body", "\n")).alias("pos", "raw")).withColumn("line", X.trim("raw"))
    mark = F.when(F.col("line").rlike("(?i)^FINDINGS:"), "findings").when(F.col("line").rlike("(?i)^FOLLOW.?UP:"), "follow_up")
    w = Window.partitionBy("id").orderBy("pos")  # one answer at most
    tagged = lines.withColumn("mark", mark).withColumn("section", F.last("mark", ignorenulls=True).over(w))
    item = X.trim(F.regexp_replace("line", r"^[-*•]\s*", ""))
    return tagged.where("mark is null and section is not null").select("id", "section", "pos", item.alias("item")).where(F.length("item") >= 5)
