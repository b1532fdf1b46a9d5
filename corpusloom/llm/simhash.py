"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into two halves, one fewer than would guarantee an
equal segment: two fingerprints that differ in at most two bits have a half in
which they differ in at most one.  Every fingerprint is indexed by each half
as it is and with each single bit of it wild (66 keys); an equality join on
these keys finds the candidates, which are verified on all 64 bits.

Equal fingerprints are collapsed first, so copies cost nothing.  Keys shared by
more than ``crowd`` fingerprints are not paired off: their members are grouped
by all 2016 two-bit deletion variants instead, where a group holds at most four
fingerprints, all within two bits of each other.  This keeps the work linear in
a large family of near copies and loses no link.

Defined cases: a null text counts as empty and has fingerprint zero, which
links like any other; a row with a null ``doc_id`` takes part in linking but
never names a class (a class of such rows only has a null id); repeated rows
are ordinary members; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, fresh
from corpusloom.llm.graph import components

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Fingerprints on one key beyond which pairs are no longer listed.
CROWD = 512
_SLAB = 1 << 15


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text, as an unsigned integer."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    elif shingle == 3:
        grams = [b"%b %b %b" % w for w in zip(words, words[1:], words[2:], strict=False)]
    else:
        grams = [b" ".join(w) for w in zip(*(words[i:] for i in range(shingle)), strict=False)]
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(grams), _SLAB):
        part = [xxh64_intdigest(g, SEED) for g in grams[at : at + _SLAB]]
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    over = (2 * votes > len(grams)).astype(np.uint8)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, mark, fp) with the fingerprint as a signed long and a hash of the text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            values = [fingerprint(t.as_py() or "", shingle) for t in batch.column(2)]
            fp = np.array(values, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], ["doc_id", "mark", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    return rows.mapInArrow(run, "doc_id long, mark long, fp long")


def _variants(nodes: DataFrame) -> DataFrame:
    """66 keyed rows a fingerprint: key, side (the wild bit; -1: none wild), fp."""
    low = "(fp & 4294967295)"
    high = "shiftrightunsigned(fp, 32)"
    half = f"if(i < 32 or i = 64, {low}, {high})"
    wild = "if(i < 64, shiftleft(1L, i % 32), 0L)"
    return nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("i")).selectExpr(
        f"({half} & ~{wild}) | shiftleft(cast(i as bigint), 32) as key",
        "if(i < 64, cast(shiftrightunsigned(fp, i) & 1 as int), -1) as side",
        "fp",
    )


def links(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between fingerprints of ``nodes`` (fp, distinct) that hold
    every class together: all pairs on sparse keys, a star per group on crowded ones."""
    keyed = _variants(nodes)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum("side").alias("ones"))
    sizes = cut(sizes.where("n > 1 and (ones < 0 or ones between 1 and n - 1)").select("key", "n"))
    sparse = cut(keyed.join(sizes.where(F.col("n") <= crowd).select("key"), "key"))
    a, b = sparse.alias("a"), sparse.alias("b")
    near = "bit_count(a.fp ^ b.fp) <= 2"
    pairs = a.join(
        b,
        F.expr(f"a.key = b.key and ((a.side = 0 and b.side = 1) or (a.side = -1 and b.side = -1 and a.fp < b.fp)) and {near}"),
    ).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    hot = keyed.join(sizes.where(F.col("n") > crowd).select("key"), "key").select("fp").distinct()
    two = hot.select("fp", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("i")).select(
        "fp", "i", F.explode(F.sequence(F.col("i") + 1, F.lit(63))).alias("j")
    )
    two = two.selectExpr("i * 64 + j as tag", "fp & ~(shiftleft(1L, i) | shiftleft(1L, j)) as rest", "fp")
    stars = two.groupBy("tag", "rest").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where("size(all) > 1")
    stars = stars.select("a", F.explode("all").alias("b")).where("a <> b")
    return pairs.union(stars)


def _placed(marked: DataFrame, crowd: int, least) -> DataFrame:
    """(fp, least, root) for every fingerprint of ``marked``; ``least`` is its aggregated minimum."""
    nodes = cut(marked.groupBy("fp").agg(F.min(least).alias("least")))  # partly aggregated, so copies do not meet
    roots = components(links(nodes.select("fp"), crowd)).withColumnRenamed("node", "fp")
    return nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def classes(docs: DataFrame, shingle: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    marked = cut(fingerprints(docs, shingle))
    placed = _placed(marked, crowd, "doc_id")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    lookup = placed.join(named, "root").select("fp", "component_id")
    return marked.join(lookup, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """One row of ``docs`` for each class, columns unchanged.

    Of a class the row of the least ``doc_id`` stays; rows without an id come
    last, and of rows with one id the one whose text has the least hash.  A row
    is known by id and text, so ids that occur with several texts lose none of
    them; of rows that repeat both any one stays.
    """
    marked = cut(fingerprints(docs, shingle))
    place = F.struct(F.col("doc_id").isNull().alias("bare"), F.coalesce("doc_id", F.lit(0)).alias("id"), "mark")
    best = _placed(marked, crowd, place).groupBy("root").agg(F.min("least").alias("best"))
    names = [fresh(docs, stem) for stem in ("bare", "id", "mark")]
    stay = best.select(*[F.col(f"best.{c}").alias(n) for c, n in zip(("bare", "id", "mark"), names, strict=True)])
    doc_id = F.col("doc_id").cast("long")
    rows = docs.withColumns(dict(zip(names, (doc_id.isNull(), F.coalesce(doc_id, F.lit(0)), F.xxhash64("text")), strict=True)))
    return rows.dropDuplicates(names).join(stay, names, "left_semi").drop(*names)


def simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """The query over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classes(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
