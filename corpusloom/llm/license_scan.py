"""License scan by diagonal voting.

Each text's rolling word pairs are hashed and joined to the positions at which
the license templates have the same pair.  A hit votes for the diagonal
``text position - template position``.  Votes are aggregated by diagonal,
neighbouring diagonals (words put in or left out) are merged, and a merged span
is verified: it counts if it covers enough of its template within a bounded band
of diagonals, so that its words stand in the template's order and in about its
length.  Hits compare the words themselves, not only their hashes, so a span's
cover is exact.  A short base phrase counts at every place where one diagonal
holds all of its pairs.

Texts are read once.  The template table is fixed and broadcast; only hits and
one marker row a document are shuffled, by row.

Defined cases: a null text counts as empty; texts without any hit are returned
with zero places; repeated rows are scanned each on its own; a null ``doc_id``
is passed through; an empty table gives an empty result; columns other than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Phrases that count at every exact place, with their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Notices that may be changed a little, with the labels that they add.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: Pairs of two such words say nothing about licenses and do not vote.
PLAIN = set("a an and any are by for in is of or the this to with without".split())

#: Diagonals this close belong to one span.
GAP = 2
#: A span may drift this far from its first diagonal: chains are verified in bands twice as wide, each half shared by two.
DRIFT = 4
#: Share of a notice's voting words that a span must cover.
COVER = 0.85

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_MARK = -1


@dataclass(frozen=True)
class Gram:
    """A voting word pair of a template: 1 if the template is a base phrase."""

    template: int
    at: int
    w1: str
    w2: str


def templates(base=None, notices=NOTICES) -> list[tuple[str, str, bool]]:
    """(label, text, whether it is a base phrase)."""
    base = BASE if base is None else base
    return [(label, text, True) for text, label in base.items()] + [(label, text, False) for label, text in notices]


def grams(of) -> list[Gram]:
    out = []
    for k, (_, text, is_base) in enumerate(of):
        w = text.split()
        out += [Gram(k, i, a, b) for i, (a, b) in enumerate(zip(w, w[1:], strict=False)) if is_base or not {a, b} <= PLAIN]
    return out


def _facts(of) -> list[tuple[int, str, bool, int]]:
    """(template, label, is_base, number of voting words or, for a base phrase, pairs)."""
    g = grams(of)
    return [
        (k, label, is_base, sum(x.template == k for x in g) if is_base else len({p for x in g if x.template == k for p in (x.at, x.at + 1)}))
        for k, (label, _, is_base) in enumerate(of)
    ]


def hits(docs: DataFrame, of) -> DataFrame:
    """One row a hit: rid, doc_id, n_words, template, at, pos.  Each document also
    has one row with template -1, so that documents without hits are not lost."""
    spark = docs.sparkSession
    low = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    words = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.array_remove(F.split(low, _BREAK), "").alias("ws"),
    )
    keyed = words.selectExpr(
        "rid", "doc_id", "ws", f"concat(array({_MARK}L), transform(array(ws), a -> transform(slice(a, 1, greatest(size(a) - 1, 0)), (w, i) -> xxhash64(w, a[i + 1])))[0]) as hs"
    )
    rows = keyed.select("rid", "doc_id", "ws", F.posexplode("hs").alias("k", "h"))
    table = spark.createDataFrame([(g.template, g.at, g.w1, g.w2) for g in grams(of)], "template int, at int, w1 string, w2 string")
    table = table.withColumn("h", F.xxhash64("w1", "w2")).union(
        spark.createDataFrame([(-1, 0, None, None, _MARK)], "template int, at int, w1 string, w2 string, h long")
    )
    met = rows.join(F.broadcast(table), "h")
    same = "(template < 0 and k = 0) or (k > 0 and get(ws, k - 1) = w1 and get(ws, k) = w2)"
    return met.where(same).selectExpr("rid", "doc_id", "size(ws) as n_words", "template", "at", "k - 1 as pos")


def spans(found: DataFrame, of, gap: int = GAP, cover: float = COVER) -> DataFrame:
    """Verified spans: rid, doc_id, n_words, template, start, stop, score, label,
    is_base; the marker rows stay, with a null label."""
    facts = found.sparkSession.createDataFrame([*_facts(of), (-1, None, None, 1)], "template int, label string, is_base boolean, most int")
    own = ["rid", "doc_id", "n_words", "template"]
    votes = found.repartition("rid").groupBy(*own, (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("ats"), F.min("pos").alias("start"), (F.max("pos") + 2).alias("stop")
    )
    votes = votes.join(F.broadcast(facts), "template")
    line = Window.partitionBy("rid", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal", 1).over(line) > gap, F.lit(True))
    votes = votes.withColumn("new", (F.coalesce("is_base", F.lit(True)) | apart).cast("int"))
    band = lambda t: F.struct(F.lit(t).alias("t"), F.floor((F.col("diagonal") + t * DRIFT) / (2 * DRIFT)).alias("n"))
    bands = F.when(F.coalesce("is_base", F.lit(True)), F.array(band(0))).otherwise(F.array(band(0), band(1)))
    chained = votes.withColumn("cluster", F.sum("new").over(line)).withColumn("band", F.explode(bands))
    merged = chained.groupBy(*own, "cluster", "band", "label", "is_base", "most").agg(
        F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.min("start").alias("start"), F.max("stop").alias("stop")
    )
    covered = F.expr("if(is_base, size(ats), size(array_distinct(flatten(transform(ats, a -> array(a, a + 1)))))) / most")
    score = F.when(F.col("template") < 0, 0.0).otherwise(covered)
    needed = F.when(F.col("template") < 0, 0.0).when(F.col("is_base"), 1.0).otherwise(cover)
    return merged.select(*own, "start", "stop", score.alias("score"), "label", "is_base").where(F.col("score") >= needed)


def scan(docs: DataFrame, base=None, notices=NOTICES, gap: int = GAP, cover: float = COVER) -> DataFrame:
    """Per row: doc_id, n_words, the base places, labels, and the best span's cover as score."""
    of = templates(base, notices)
    found = spans(hits(docs, of), of, gap, cover)
    place = F.when(F.col("is_base"), F.col("start"))
    return found.groupBy("rid").agg(
        F.min("doc_id").alias("doc_id"),
        F.max("n_words").cast("long").alias("n_words"),
        F.count(place).alias("n_base"),
        F.min(place).cast("long").alias("first_word"),
        F.max(place).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    ).drop("rid")


def license_scan(spark, sf_dir: str) -> DataFrame:
    """The query over all of ``documents``."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    of = templates()
    g = ", ".join(f"({x.template}, {x.at}, '{x.w1}', '{x.w2}')" for x in grams(of))
    f = ", ".join(f"({k}, '{label}', {str(b).lower()}, {most})" for k, label, b, most in _facts(of))
    return f"""
WITH g(template, "at", w1, w2) AS (VALUES {g}), f(template, label, is_base, most) AS (VALUES {f}),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{_BREAK}'), lambda x: x <> '') AS ws
  FROM documents
), p AS (
  SELECT rid, i - 1 AS pos, ws[i] AS w1, ws[i + 1] AS w2 FROM (SELECT rid, ws, unnest(range(1, len(ws))) AS i FROM d WHERE len(ws) > 1)
), v AS (
  SELECT rid, template, pos - "at" AS diagonal, list(DISTINCT "at") AS ats FROM p JOIN g USING (w1, w2) GROUP BY ALL
), b AS (
  SELECT rid, diagonal AS start, label, 1.0 AS score, true AS is_base FROM v JOIN f USING (template) WHERE is_base AND len(ats) = most
), c AS (
  SELECT *, coalesce(sum(new) OVER (PARTITION BY rid, template ORDER BY diagonal), 0) AS cluster FROM (
    SELECT v.*, label, most, CAST(diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) > {GAP} AS INT) AS new
    FROM v JOIN f USING (template) WHERE NOT is_base)
), s AS (
  SELECT rid, label, len(list_distinct(flatten(list_transform(flatten(list(ats)), lambda a: [a, a + 1])))) / most AS score
  FROM (SELECT *, unnest([[0, diagonal // {2 * DRIFT}], [1, (diagonal + {DRIFT}) // {2 * DRIFT}]]) AS band FROM (SELECT * REPLACE (diagonal + {8 * 10**8} AS diagonal) FROM c))
  GROUP BY rid, template, cluster, band, label, most
), u AS (
  SELECT rid, start, label, score, is_base FROM b
  UNION ALL SELECT rid, NULL, label, score, false FROM s WHERE score >= {COVER}
)
SELECT d.doc_id, CAST(max(len(ws)) AS BIGINT) AS n_words, count(start) AS n_base, CAST(min(start) AS BIGINT) AS first_word,
       CAST(max(start) AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE is_base)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE label IS NOT NULL)), ','), '') AS labels,
       CAST(coalesce(max(score), 0) AS DOUBLE) AS score
FROM d LEFT JOIN u USING (rid) GROUP BY d.rid, d.doc_id"""


LICENSE_SCAN_SQL = _sql()
