"""BM25, trigram and hybrid retrieval for a table of queries at once.

``queries`` has (query_id, query).  Scores come from equi-joins on terms, and from
trigrams counted where chunks are read; searches for the best few drop most term hits by bounds before any
trigram is compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.functions import text as X
from corpusloom.functions.tables import PRIORITIES, ROLE_TAGS
from corpusloom.operators import corpus as C
from corpusloom.session import checkpointed, dealt, written

K1, B = 1.4, 0.75
NGRAM_WEIGHT, NGRAM_LEAST, TIER_BOOST = 0.2, 0.15, 0.08
NGRAM_CHARS = 500
HEADING_BOOST, NAME_BOOST = 1.3, 1.15


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(X.terms("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))


#: Query terms up to which they are sent to all postings; more are joined by shuffle.
BROADCAST_TERMS = 200_000
#: Pairs of a query and a chunk that one task adds up.
PAIRS = 1_000_000
#: Hits up to which their ids are sent to all chunks, and chunks with their texts that one task joins if there are more.
HITS, TEXTS = 200_000, 20_000
#: Rows that a task holds back until it knows more of the best, and what rounding may change of a score.
HELD, SLACK = 100_000, 1e-8


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gains added up within a batch; postings of a chunk stand together, so little is left for others."""
    for b in batches:
        sums = pa.Table.from_batches([b]).group_by(["query_id", "seq"]).aggregate([("bm25", "sum")]).rename_columns(["query_id", "seq", "bm25"])
        yield from sums.to_batches()


def summed(gains: DataFrame, pairs: int) -> DataFrame:
    """query_id, seq, bm25: gains added up, dealt out by chunk to as many tasks as so many pairs can need."""
    return gains.repartition(dealt(gains, pairs, PAIRS), "seq").groupBy("query_id", "seq").agg(F.sum("bm25").alias("bm25"))


def bm25(chunks: DataFrame, queries: DataFrame, post: DataFrame | None = None) -> DataFrame:
    """query_id, seq, bm25 over all chunks; statistics are the whole corpus's.

    ``post`` are the chunks' postings if an index has them; else they are made.
    Few query terms go to the postings, where a chunk's gains are added up
    before anything is shuffled; a task's share does not grow with the table.
    """
    post = written(C.postings(chunks)) if post is None else post  # read three times below
    n, avgdl = C.corpus_stats(chunks, post).first()  # two numbers
    told, asked, small = _told(post, queries, n)
    gains = post.join(small(told), "term").select("query_id", "seq", _gain(avgdl))
    return summed(gains.mapInArrow(_added, gains.schema), n * asked)


def _told(post: DataFrame, queries: DataFrame, n: int) -> tuple[DataFrame, int, Callable[[DataFrame], DataFrame]]:
    """The queries' terms with qf and idf, the number of queries that have terms, and how the terms are sent to postings."""
    qt = checkpointed(query_terms(queries))
    count, asked = qt.agg(F.count("*"), F.countDistinct("query_id")).first()
    small = F.broadcast if count <= BROADCAST_TERMS else lambda t: t
    df = C.document_frequency(post.join(small(qt.select("term").distinct()), "term", "left_semi"))
    told = checkpointed(qt.join(df, "term").withColumn("idf", F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))))
    return told, asked, small


def _gain(avgdl: float) -> Column:
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
    return (F.col("idf") * gain * F.col("qf")).alias("bm25")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gains added up by query and chunk where a task has all of a chunk's, one after another; the last chunk of a batch waits for the next."""
    held = []
    for b in (b for b in batches if b.num_rows):
        keys = [c for c in b.schema.names if c != "bm25"]
        rows = pa.Table.from_batches([*held, b])
        sums = rows.group_by(keys).aggregate([("bm25", "sum")]).rename_columns([*keys, "bm25"]).select(b.schema.names).cast(b.schema)
        last = pc.equal(sums.column("seq"), b.column("seq")[-1])
        yield from sums.filter(pc.invert(last)).to_batches()
        held = sums.filter(last).to_batches()
    yield from held


def bm25_whole(pack: DataFrame, queries: DataFrame, wanted: DataFrame | None = None) -> DataFrame | None:
    """``bm25`` with the tier, where ``pack`` (``corpus.packed``) is read: no pair of query and chunk is shuffled, hashed or sorted.

    A task holds the queries' terms and the sums of one batch; a broadcast join leaves a chunk's postings together.  ``wanted`` (library_id) restricts what is scored, not
    the statistics.  None if it can't be done so: for ids that stand for several rows, and more terms than are broadcast.
    """
    n, avgdl = C.corpus_stats(pack, pack.select(F.col("dl").alias("tf"))).first()  # two numbers
    if not pack.select("seq").repartition(dealt(pack, n, PAIRS), "seq").groupBy("seq").count().where("count > 1 or seq is null").isEmpty():
        return None
    post = C.unpacked(pack)
    told, _, small = _told(post, queries, n)
    if small is not F.broadcast:
        return None
    some = post if wanted is None else C.unpacked(in_libraries(pack, wanted))
    gains = some.join(small(told), "term").select("query_id", "seq", "tier", _gain(avgdl))
    return gains.mapInArrow(_whole, gains.schema)


def boosted(scores: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Raise chunks whose heading or file name contains a query term."""
    words = queries.select("query_id", F.array_distinct(X.terms("query")).alias("words"))
    heading = F.col("heading") if "heading" in chunks.columns else F.lit("")
    facts = chunks.select("seq", F.lower(heading).alias("h"), F.lower("file_name").alias("f"))
    both = scores.join(facts, "seq").join(words, "query_id")
    inside = lambda c: F.exists("words", lambda w: F.contains(F.coalesce(F.col(c), F.lit("")), w))
    raised = F.col("bm25") * F.when(inside("h"), HEADING_BOOST).otherwise(1.0) * F.when(inside("f"), NAME_BOOST).otherwise(1.0)
    return both.select("query_id", "seq", raised.alias("bm25"))


#: Queries up to which their trigrams are sent to all chunks, and places that these have in a table of trigrams by queries.
QUERIES, PLACES = 1_000, 10_000_000
#: Chunks that are compared at once, and chunks whose best hits are picked at once.
CHUNKS, STEP = 64, 2_048
_LETTERS = np.zeros(128, np.int32)
_LETTERS[[ord(x) for x in "0123456789abcdefghijklmnopqrstuvwxyz"]] = range(36)
_GRAMS = 36**3


def _codes(text: bytes) -> np.ndarray:
    """A number for the trigram at every place of a text of letters and digits."""
    v = _LETTERS[np.frombuffer(text, np.uint8)]
    return (v[:-2] * 36 + v[1:-1]) * 36 + v[2:]


def _shared(heads: list[str], column: np.ndarray, asked: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct trigrams each head has, and how many of them each query has too."""
    sizes = [len(h) for h in heads]
    row, text = np.repeat(np.arange(len(heads)), sizes), "".join(heads).encode()
    key = (row[:-2] * _GRAMS + _codes(text))[row[:-2] == row[2:]] if len(text) > 2 else np.zeros(0, np.int64)
    at = np.arange(len(key), dtype=np.int32)
    mark[key] = at
    key = key[mark[key] == at]  # one of each
    row, place = key // _GRAMS, column[key % _GRAMS]
    has = np.zeros((len(heads), len(asked)), np.float32)
    has[row[place >= 0], place[place >= 0]] = 1
    return np.bincount(row, minlength=len(heads)), has @ asked


def trigram(chunks: DataFrame, queries: DataFrame, best: int | None = None) -> DataFrame:
    """query_id, seq, ngram: overlap of the query with the chunk's beginning.

    The trigrams of few queries go to the chunks, where all are counted in one
    pass.  Rows that a query's ``best`` so many (ties by seq) cannot be among may
    then be left out.  More queries, and ids that stand for several rows, whose
    counts add up, are joined on trigrams.
    """
    few = queries.select("query_id", X.trigrams("query")).take(QUERIES + 1)
    places = {g: k for k, g in enumerate(sorted({g for _, grams in few for g in grams or ()}))}
    if len(few) > QUERIES or len(few) * len(places) > PLACES or len({q for q, _ in few}) < len(few) or not chunks.groupBy("seq").count().where("count > 1 or seq is null").isEmpty():
        return _joined(chunks, queries)
    schema = T.StructType([queries.schema["query_id"], chunks.schema["seq"]]).add("ngram", T.DoubleType())
    ids, kind = [q for q, _ in few], to_arrow_type(schema[0].dataType)
    grams, theirs = _codes("".join(places).encode())[::3] if places else np.zeros(0, int), [[places[g] for g in grams or ()] for _, grams in few]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column, asked, mark = np.full(_GRAMS, -1), np.zeros((len(places), len(ids)), np.float32), np.zeros(CHUNKS * _GRAMS, np.int32)
        column[grams] = np.arange(len(grams))
        for q, own in enumerate(theirs):
            asked[own, q] = 1
        own, names = np.array([len(x) for x in theirs]), pa.array(ids, kind)
        for b in batches:
            for k in range(0, b.num_rows, STEP):
                part = b.slice(k, STEP)
                part = part.take(pc.sort_indices(part.column(0)))
                heads = [h or "" for h in part.column(1).to_pylist()]
                ngram = []
                for j in range(0, len(heads), CHUNKS):
                    n, both = _shared(heads[j : j + CHUNKS], column, asked, mark)
                    ngram.append(both / np.maximum(np.minimum(n[:, None], own), 1))
                ngram = np.concatenate(ngram)
                if best is None or best >= len(heads):
                    row, q = np.nonzero(ngram)
                else:  # overlaps that differ do so by more than 1 / NGRAM_CHARS**2, so rounding makes no ties of them
                    row = np.argsort(-ngram, axis=0, kind="stable")[:best].ravel()
                    q = np.tile(np.arange(len(ids)), best)
                    row, q = (x[ngram[row, q] > 0] for x in (row, q))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), part.column(0).take(pa.array(row)), pa.array(ngram[row, q])], schema.names)

    bare = F.regexp_replace(F.lower(F.left("text", F.lit(NGRAM_CHARS))), "[^a-z0-9]", "")
    return chunks.select("seq", bare.alias("head")).mapInArrow(run, schema)


def _joined(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """``trigram`` by a join on trigrams, for any number of queries."""
    c = chunks.select("seq", X.trigrams(F.left("text", F.lit(NGRAM_CHARS))).alias("g"))
    q = queries.select("query_id", X.trigrams("query").alias("g"))
    a = c.select("seq", F.size("g").alias("cn"), F.explode("g").alias("gram"))
    b = q.select("query_id", F.size("g").alias("qn"), F.explode("g").alias("gram"))
    return a.join(b, "gram").groupBy("query_id", "seq", "cn", "qn").agg(F.count("*").alias("n")).select(
        "query_id", "seq", (F.col("n") / F.least("cn", "qn")).alias("ngram")
    )


def _numbered(batch: pa.RecordBatch, group: list[str], known: dict[tuple, int]) -> np.ndarray:
    """A number for the group of every row, the same in all batches."""
    code, values = np.zeros(batch.num_rows, np.int64), [()]
    for c in group:
        d = batch.column(c).dictionary_encode(null_encoding="encode")
        named, m = d.dictionary.to_pylist(), len(d.dictionary)
        pairs, code = np.unique(code * m + d.indices.to_numpy(), return_inverse=True)
        values = [(*values[p // m], named[p % m]) for p in pairs]
    return np.array([known.setdefault(v, len(known)) for v in values])[code]


def shortlist(rows: DataFrame, k: int, group: list[str], low: str, high: str) -> DataFrame:
    """``rows`` without those whose ``high`` is below the ``k``-th ``low`` of their group in the same task, or null.

    A task keeps ``k`` numbers a group and ``HELD`` rows at most; nothing is sorted whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, best, held = {}, np.full((1, k), -np.inf), []

        def left(b: pa.RecordBatch, code: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
            stays = b.column(high).to_numpy(zero_copy_only=False) >= best[code, -1] - SLACK
            return b.filter(pa.array(stays)), code[stays]

        for b in (b for b in batches if b.num_rows):
            code = _numbered(b, group, known)
            if len(known) > len(best):
                best = np.concatenate([best, np.full((len(known), k), -np.inf)])
            score = b.column(low).to_numpy(zero_copy_only=False)
            better = score > best[code, -1]
            own = np.unique(code[better])
            who, what = np.concatenate([np.repeat(own, k), code[better]]), np.concatenate([best[own].ravel(), score[better]])
            order = np.lexsort((-what, who))
            best[own] = what[order][np.searchsorted(who[order], own)[:, None] + np.arange(k)]
            held.append(left(b, code))
            if sum(len(c) for _, c in held) > HELD:
                yield from (left(*x)[0] for x in held)
                held = []
        yield from (left(*x)[0] for x in held)

    return rows.mapInArrow(run, rows.schema)


def beside(hits: DataFrame, facts: DataFrame) -> DataFrame:
    """``hits``, which have been written, joined with ``facts`` of their chunks by seq.

    The ids of few hits go to the chunks, so only what is hit is shuffled; with
    more hits both are dealt out, by as many tasks as the chunks need.
    """
    n = hits.count()
    if n <= HITS:
        return hits.join(facts.join(F.broadcast(hits.select("seq").distinct()), "seq", "left_semi"), "seq")
    parts = max(dealt(hits, n, PAIRS), dealt(hits, facts.count(), TEXTS))
    return hits.repartition(parts, "seq").join(facts.repartition(parts, "seq"), "seq")


def hybrid(chunks: DataFrame, queries: DataFrame, boost: bool = True, post: DataFrame | None = None) -> DataFrame:
    """Both scores and their total; fuzzy hits alone need ``NGRAM_LEAST`` and get no boost."""
    some = queries.where(F.size(X.terms("query")) > 0)
    parts = dealt(chunks, chunks.count() * some.count(), PAIRS)
    terms, grams = (t.repartition(parts, "query_id", "seq") for t in (bm25(chunks, some, post), trigram(chunks, some)))
    both = terms.join(grams, ["query_id", "seq"], "full_outer")
    both = both.select("query_id", "seq", F.coalesce("bm25", F.lit(0.0)).alias("bm25"), F.coalesce("ngram", F.lit(0.0)).alias("ngram"))
    hit = both.where((F.col("bm25") > 0) | (F.col("ngram") >= NGRAM_LEAST)).repartition(parts, "seq").join(chunks.select("seq", "library_id", "tier", "doc_id", "chunk_index"), "seq")
    factor = 1 + (3 - F.col("tier")) * TIER_BOOST if boost else F.lit(1.0)
    total = F.when(F.col("bm25") > 0, (F.col("bm25") + NGRAM_WEIGHT * F.col("ngram")) * factor).otherwise(NGRAM_WEIGHT * F.col("ngram"))
    return hit.withColumn("total", total)


def best_hits(
    chunks: DataFrame, queries: DataFrame, k: int, boost: bool = True, per_tier: bool = False, wanted: DataFrame | None = None, post: DataFrame | None = None,
    scores: DataFrame | None = None,
) -> DataFrame:
    """The rows of ``hybrid`` that the best ``k`` of each query (and tier) can be among.

    Without ``post`` a chunk's terms are written in one row, and its sums are whole where that row is read; else
    gains are dealt out by chunk.
    A term hit's total lies between its BM25 part and that with a full trigram
    score.  Hits whose upper end is below the k-th lower end are dropped before
    any trigram is looked at, most of them in the task that adds them up, and so
    are all purely fuzzy chunks where the k-th lower end exceeds what they can reach.  Only queries with few or weak term
    hits go through the trigram join.  ``wanted`` (library_id) restricts what is
    scored; the statistics stay those of all ``chunks``, whose postings ``post`` are
    if an index has them.  ``scores`` are the queries' BM25 scores, or those that
    blocks with bounds leave (``blocks.bm25_best`` with this search's ``raised``).
    """
    some = queries.where(F.size(X.terms("query")) > 0)
    group = ["query_id", "tier"] if per_tier else ["query_id"]
    if wanted is not None:  # a row a library, read twice below
        wanted = checkpointed(wanted.select("library_id").distinct())
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_TERMS else wanted
    factor = 1 + (3 - F.col("tier")) * TIER_BOOST if boost else F.lit(1.0)
    scored = None
    if post is None:
        pack = written(C.packed(chunks.select("seq", "library_id", "tier", "text")))  # read four times
        post = C.unpacked(pack).select("seq", "dl", "term", "tf")
        scored = bm25_whole(pack, some, wanted) if scores is None else None
    if scored is None:
        facts = chunks if wanted is None else in_libraries(chunks, wanted)
        scored = (bm25(chunks, some, post) if scores is None else scores).join(facts.select("seq", "tier"), "seq")
    scored = scored.withColumn("low", F.col("bm25") * factor).withColumn("high", (F.col("bm25") + NGRAM_WEIGHT) * factor)
    scored = written(shortlist(scored, k, group, "low", "high"))  # read twice below
    turn = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("low").desc()))
    floor = shortlist(scored.select(*group, "low"), k, group, "low", "low").withColumn("turn", turn)
    floor = floor.where(F.col("turn") <= k).groupBy(*group).agg(F.min("low").alias("floor"), F.count("*").alias("n"))
    floor = checkpointed(floor.where((F.col("n") == k) & (F.col("floor") > NGRAM_WEIGHT)).drop("n"))  # a row a query (and tier)
    small = F.broadcast if floor.count() <= BROADCAST_TERMS else lambda t: t
    near = written(scored.join(small(floor), group).where(F.col("high") >= F.col("floor") - SLACK))
    heads = chunks.select("seq", "library_id", "doc_id", "chunk_index", F.left("text", F.lit(NGRAM_CHARS)).alias("head"))
    told = beside(near, heads).join(some, "query_id")
    columns = ["query_id", "seq", "bm25", "ngram", "library_id", "tier", "doc_id", "chunk_index", "total"]
    strong = told.withColumn("ngram", X.overlap(X.trigrams("query"), X.trigrams("head"))).withColumn("total", (F.col("bm25") + NGRAM_WEIGHT * F.col("ngram")) * factor).select(*columns)
    asked = some.select("query_id", F.explode(F.array(*[F.lit(t) for t in range(4)])).alias("tier")) if per_tier else some.select("query_id")
    weak = asked.join(floor, group, "left_anti")
    if weak.isEmpty():
        return strong
    few = some.join(weak.select("query_id").distinct(), "query_id", "left_semi")
    rest = hybrid(chunks, few, boost, post).join(weak, group, "left_semi")
    rest = rest if wanted is None else in_libraries(rest, wanted)
    return strong.unionByName(rest.select(*columns))


def raised(boost: bool = True) -> dict[str, float]:
    """The most that ``best_hits`` makes of a BM25 score: what it multiplies it by after adding to it."""
    return {"factor": 1 + 3 * TIER_BOOST if boost else 1.0, "extra": NGRAM_WEIGHT}


def top(hits: DataFrame, k: int, score: str = "total") -> DataFrame:
    """The best ``k`` of each query, one per chunk, ties by ``seq``."""
    w = Window.partitionBy("query_id").orderBy(F.round(score, 9).desc(), "seq")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def in_libraries(hits: DataFrame, wanted: DataFrame) -> DataFrame:
    return hits.join(wanted.select("library_id"), "library_id", "left_semi")


def progressive(hits: DataFrame, k: int, least: int = 3) -> DataFrame:
    """Tier after tier until there are ``k``; closed form of the loop.

    ``hits`` are scored without the tier boost and hold at least the best
    ``max(k, least)`` of each query and tier.  A tier is asked for the rest,
    ``least`` at any rate, if the tiers before it have fewer than ``k``.
    """
    order = [F.round("total", 9).desc(), F.col("seq")]
    ranked = hits.withColumn("turn", F.row_number().over(Window.partitionBy("query_id", "tier").orderBy(*order)))
    ranked = ranked.where(F.col("turn") <= max(k, least))  # no tier gives more, and a tier with k ends the search
    sizes = ranked.groupBy("query_id", "tier").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("query_id").orderBy("tier").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("query_id", "tier", F.coalesce(before, F.lit(0)).alias("prior"))
    kept = ranked.join(sizes, ["query_id", "tier"]).where((F.col("prior") < k) & (F.col("turn") <= F.greatest(F.lit(k) - F.col("prior"), F.lit(least))))
    w = Window.partitionBy("query_id").orderBy(F.round("total", 9).desc(), "tier", "turn")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def for_role(libraries: DataFrame, role: str, chosen: dict[str, list[str]] | None = None) -> DataFrame:
    """library_id of what a role searches: its chosen libraries, else those that share a tag with it, else all.

    ``libraries`` has library_id and tags.
    """
    if chosen and role in chosen:
        return libraries.where(F.col("library_id").isin(chosen[role])).select("library_id")
    tags = F.array(*[F.lit(t) for t in ROLE_TAGS.get(role, ["general"])])
    flagged = libraries.select("library_id", F.arrays_overlap("tags", tags).alias("hit"))
    some = flagged.agg(F.coalesce(F.max("hit"), F.lit(False)).alias("any"))
    return flagged.join(F.broadcast(some), F.col("hit") | ~F.col("any")).select("library_id")  # one row


def context_window(hits: DataFrame, chunks: DataFrame, w: int = 1) -> DataFrame:
    """The chunks of a hit's file (doc_id) at most ``w`` places away: seq, near_seq, near_index, near_text."""
    at = hits.select("seq").join(chunks.select("seq", "doc_id", "chunk_index"), "seq")
    places = F.filter(F.sequence(F.col("chunk_index") - w, F.col("chunk_index") + w), lambda i: i != F.col("chunk_index"))
    asked = at.select("seq", "doc_id", F.explode(places).alias("near_index"))  # an equality join, 2 w rows a hit
    near = chunks.select("doc_id", F.col("chunk_index").alias("near_index"), F.col("seq").alias("near_seq"), F.col("text").alias("near_text"))
    return asked.join(near, ["doc_id", "near_index"]).select("seq", "near_seq", "near_index", "near_text")


def context(hits: DataFrame, chunks: DataFrame, chars: int = 200) -> DataFrame:
    """The end of the chunk before and the start of the one after, empty if missing.

    Only the neighbours of hits are looked up; chunks are not put in order.
    """
    ends = F.struct(F.left("text", F.lit(chars)).alias("start"), F.right("text", F.lit(chars)).alias("end"))
    near = context_window(hits.select("seq").distinct(), chunks.select("seq", "doc_id", "chunk_index", ends.alias("text")))
    own = chunks.select("seq", F.col("chunk_index").alias("__at"))
    near = near.join(own, "seq").groupBy("seq").agg(
        F.max(F.when(F.col("near_index") < F.col("__at"), F.col("near_text.end"))).alias("context_before"),
        F.max(F.when(F.col("near_index") > F.col("__at"), F.col("near_text.start"))).alias("context_after"),
    )
    empty = [F.coalesce(c, F.lit("")).alias(c) for c in ("context_before", "context_after")]
    return hits.join(near, "seq", "left").select(*hits.columns, *empty)


def list_all(chunks: DataFrame, most: int) -> DataFrame:
    return chunks.orderBy("seq").limit(most).withColumn("score", F.lit(0.0))


# Tier of a local source by its library's priority.
LOCAL_TIERS = ["reference", "reference", "reference", "general"]
LOCAL_FRESHNESS = 70
_BREAK = "\n\n---\n\n"


def local_url(library: Column, file: Column, index: Column) -> Column:
    return F.concat(F.lit("local://"), library, F.lit("/"), file, F.lit("#chunk"), index)


def as_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Local hits as search hits: query_id, seq, url, title, snippet."""
    told = beside(checkpointed(hits.select("query_id", "seq")), chunks.select("seq", "library_id", "file_name", "chunk_index", "text"))
    title = F.concat("file_name", F.lit(" ("), "library_id", F.lit(")"))
    return told.select("query_id", "seq", local_url(F.col("library_id"), F.col("file_name"), F.col("chunk_index")).alias("url"), title.alias("title"), X.preview("text", 250).alias("snippet"))


def as_sources(hits: DataFrame, chunks: DataFrame, limit: int = 4000) -> DataFrame:
    """Local hits as report sources: the chunk between its contexts, and tier, freshness and relevance by priority."""
    by_tier = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("tier") + 1)
    heading = F.coalesce("heading", F.lit("")) if "heading" in chunks.columns else F.lit("")
    told = context(hits, chunks).join(chunks.select("seq", "file_name", "text", heading.alias("heading")), "seq")
    some = lambda c, x: F.when(F.col(c) != "", x).otherwise("")
    text = F.concat(some("context_before", F.concat("context_before", F.lit(_BREAK))), "text", some("context_after", F.concat(F.lit(_BREAK), "context_after")))
    told = told.withColumn("whole", F.left(text, F.lit(limit)))
    return told.select(
        "query_id", "seq", local_url(F.col("library_id"), F.col("file_name"), F.col("chunk_index")).alias("url"),
        F.concat("file_name", some("heading", F.concat(F.lit(" — "), "heading")), F.lit(" ("), "library_id", F.lit(")")).alias("title"),
        X.preview("whole", 250).alias("description"), F.col("whole").alias("text"), X.count_words("text").alias("word_count"),
        by_tier(LOCAL_TIERS).alias("tier"), by_tier([p[1] for p in PRIORITIES]).alias("domain_score"), F.lit(LOCAL_FRESHNESS).alias("freshness_score"),
        F.least(F.lit(1.0), F.least(F.lit(1.0), F.col("total") * 1.5) + by_tier([p[2] for p in PRIORITIES])).alias("relevance"),
    )


def harvest(hits: DataFrame, per_query: int, budget: int) -> DataFrame:
    """Hits of the queries in order, each chunk once, until the budget is spent."""
    best = top(hits, per_query)
    first = Window.partitionBy("seq").orderBy("query_id")
    fresh = best.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return fresh.orderBy("query_id", "rank").limit(budget)
