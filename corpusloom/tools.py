"""The engine's tools as one object: libraries, search, pages, research."""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.tables import PRIORITIES
from corpusloom.operators import corpus as C
from corpusloom.operators import blocks, extract, retrieval, scoring
from corpusloom.plans import planning, report
from corpusloom.plans import research as R
from corpusloom.session import checkpointed, written
from corpusloom.sources import files as S
from corpusloom.sources import pdf

TIERS = [p[0] for p in PRIORITIES]


#: Differences that a library's tables may consist of before they are written anew, and files up to which a difference is read file by file.
MOST_DELTAS = 8
MOST_NAMED = 10_000


class Store:
    """Libraries of files and what can be asked of them.

    Library records are few and kept here; files, chunks and postings are
    tables.  A library that is refreshed keeps its tables: rows of files that
    went or changed are masked, those of new ones are added, and after some such
    differences the tables are written anew.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.records: dict[str, dict] = {}
        self.tables: dict[str, tuple[DataFrame, DataFrame]] = {}
        self.indexes: dict[str, DataFrame] = {}  # postings by library, made once
        self.prepared: tuple[dict, blocks.Blocks] | None = None  # the libraries as they were, and their blocks
        self.listings: dict[str, DataFrame] = {}  # what a folder held when it was indexed, files without text included
        self.deltas: dict[str, int] = {}

    def add_library(self, name: str, folder: str, description: str = "", priority: str = "general", tags: list[str] | None = None, size: int = 4000) -> str:
        """Index a folder; a library of the same folder is replaced."""
        folder = os.path.expanduser(folder)
        for key in [k for k, r in self.records.items() if r["folder"] == folder]:
            self.remove_library(key)
        key = str(uuid.uuid4())
        # written out, so that the index is the folder as it was now
        self.listings[key] = written(S.listing(self.spark, folder))
        self.tables[key] = tuple(checkpointed(t) for t in S.ingest(self.spark, folder, key, size))
        self.records[key] = {"library_id": key, "name": name, "folder": folder, "description": description, "priority": priority, "tags": tags or ["general"], "size": size}
        return key

    def refresh_library(self, key: str) -> dict[str, int]:
        """Index what changed in a library's folder since; how many files went, changed or were added.

        Only files whose path, size or time differ are opened, chunked and split
        into terms.
        """
        record, (files, chunks) = self.records[key], self.tables[key]
        post = self._index(key)
        now = written(S.listing(self.spark, record["folder"]))
        told = written(C.changes(self.listings[key], now))
        counts = {r[0]: r[1] for r in told.groupBy("status").count().collect()}  # three at most
        if not counts:
            return counts
        new = told.where("status <> 'deleted'").select("file_path")
        named = [r[0] for r in new.limit(MOST_NAMED + 1).collect()]
        if named:
            only = named if len(named) <= MOST_NAMED else None
            parts = S.ingest(self.spark, record["folder"], key, record.get("size", 4000), only=only)
            if only is None:
                parts = tuple(t.join(new, "file_path", "left_semi") for t in parts)
            parts = tuple(checkpointed(t) for t in parts)
        gone = told.where("status <> 'added'").select("file_path")
        dead = _numbered(chunks.join(gone, "file_path", "left_semi")).select("seq")
        files, chunks, post = files.join(gone, "file_path", "left_anti"), chunks.join(gone, "file_path", "left_anti"), post.join(dead, "seq", "left_anti")
        if named:
            files, chunks = files.unionByName(parts[0]), chunks.unionByName(parts[1])
            post = post.unionByName(written(C.postings(_numbered(parts[1]))))
        self.deltas[key] = self.deltas.get(key, 0) + 1
        if self.deltas[key] >= MOST_DELTAS:
            files, chunks, post = written(files), written(chunks), written(post)
            self.deltas[key] = 0
        self.tables[key], self.indexes[key], self.listings[key] = (files, chunks), post, now
        return counts

    def libraries(self) -> list[dict]:
        return sorted(self.records.values(), key=lambda r: TIERS.index(r["priority"]))

    def by_name(self, name: str) -> dict | None:
        return next((r for r in self.records.values() if r["name"].lower() == name.lower()), None)

    def by_tag(self, tag: str) -> list[dict]:
        return [r for r in self.libraries() if tag in r["tags"]]

    def remove_library(self, key: str) -> bool:
        self.tables.pop(key, None)
        self.indexes.pop(key, None)
        self.deltas.pop(key, None)
        self.listings.pop(key, None)
        return self.records.pop(key, None) is not None

    def update_library(self, key: str, **new) -> dict:
        """New values where given; nothing is indexed again."""
        self.records[key].update({k: v for k, v in new.items() if v is not None})
        return self.records[key]

    def _union(self, i: int) -> DataFrame:
        out = None
        for pair in self.tables.values():
            out = pair[i] if out is None else out.unionByName(pair[i])
        return out

    def _index(self, key: str) -> DataFrame:
        if key not in self.indexes:
            self.indexes[key] = written(C.postings(_numbered(self.tables[key][1])))
        return self.indexes[key]

    def postings(self) -> DataFrame:
        """Postings of all libraries; a library's are made when it is first searched."""
        out = None
        for key in self.tables:
            out = self._index(key) if out is None else out.unionByName(self._index(key))
        return out

    def chunks(self) -> DataFrame:
        rows = [(k, TIERS.index(r["priority"])) for k, r in self.records.items()]
        tier = F.broadcast(self.spark.createDataFrame(rows, "library_id string, tier int"))  # one row a library
        return _numbered(self._union(1).join(tier, "library_id"))

    def _asked(self, query: str) -> DataFrame:
        return self.spark.createDataFrame([(0, query)], "query_id long, query string")

    def prepare(self) -> None:
        """Lay the postings of all libraries out in blocks, for many searches; they hold until a library changes."""
        self.prepared = (dict(self.tables), blocks.build(self.postings(), self.chunks()))

    def search(self, query: str, most: int = 8, library_id: str | None = None, progressive: bool = False) -> DataFrame:
        """Ranked chunks with scores and neighbouring text; ``*`` lists all."""
        c = self.chunks()
        wanted = None if library_id is None else self.spark.createDataFrame([(library_id,)], "library_id string")
        if query == "*":
            return retrieval.list_all(c if wanted is None else retrieval.in_libraries(c, wanted), most)
        asked, k, scores = self._asked(query), max(most, 3), None
        if wanted is None and not progressive and self.prepared is not None and self.prepared[0] == self.tables:
            scores = blocks.bm25_best(self.prepared[1], asked, k, **retrieval.raised())
        hits = retrieval.best_hits(c, asked, k, boost=not progressive, per_tier=progressive, wanted=wanted, post=self.postings(), scores=scores)
        best = retrieval.progressive(hits, most) if progressive else retrieval.top(hits, most)
        told = retrieval.context(best, c).join(c.select("seq", "file_name", "heading", "total_chunks", "text"), "seq")
        three = [(F.floor(F.col(s) * 1000 + 0.5) / 1000).alias(s) for s in ("total", "bm25", "ngram")]
        place = F.concat(F.col("chunk_index") + 1, F.lit("/"), F.col("total_chunks"))
        return told.select("rank", "library_id", "file_name", place.alias("position"), "heading", *three, "text", "context_before", "context_after").orderBy("rank")

    def check_changes(self, key: str) -> DataFrame:
        """Files added, deleted or modified since a library was indexed."""
        now = S.contents(self.spark, self.records[key]["folder"])
        return C.changes(self.tables[key][0].select("file_path", "content_hash"), now)

    def file_types(self, key: str | None = None) -> DataFrame:
        """library_id, file_type and files: how many files of each extension the libraries, or one of them, hold."""
        files = self._union(0) if key is None else self.tables[key][0]
        return files.groupBy("library_id", "file_type").agg(F.count("*").alias("files"))

    def stats(self) -> dict:
        f, c = self._union(0), self._union(1)
        words, = c.agg(F.sum("word_count")).first()
        terms = c.select(F.explode(F.array_distinct(X.terms("text"))).alias("t")).distinct().count()
        by_priority = {t: n for t in TIERS if (n := sum(r["priority"] == t for r in self.records.values()))}
        return {"libraries": len(self.records), "files": f.count(), "chunks": c.count(), "words": words, "terms": terms, "by_priority": by_priority}

    def context(self, hits: DataFrame, w: int = 1) -> DataFrame:
        """The chunks at most ``w`` places from each hit's (seq), in the same file."""
        return retrieval.context_window(hits, self.chunks(), w)

    def search_by_role(self, query: str, role: str, most: int = 8, chosen: dict[str, list[str]] | None = None) -> DataFrame:
        """Hits in the libraries that a role is told to search, or that share its tags, or in all."""
        c, q = self.chunks(), self._asked(query)
        libs = self.spark.createDataFrame([(k, r["tags"]) for k, r in self.records.items()], "library_id string, tags array<string>")
        return retrieval.top(retrieval.best_hits(c, q, most, wanted=retrieval.for_role(libs, role, chosen), post=self.postings()), most)

    def search_hits(self, query: str, most: int = 8, role: str | None = None) -> DataFrame:
        """Local hits in the form of search hits."""
        c = self.chunks()
        best = self.search_by_role(query, role, most) if role else retrieval.top(retrieval.best_hits(c, self._asked(query), most, post=self.postings()), most)
        return retrieval.as_hits(best, c)

    # collections are another name for libraries
    add_collection, collections, remove_collection = add_library, libraries, remove_library

    def search_collections(self, query: str, most: int = 8) -> DataFrame:
        """Hits in all collections, never tier by tier, twenty at most."""
        return self.search(query, min(most, 20))

    def save_index(self, path: str) -> None:
        """Write libraries, files, chunks and postings as a new snapshot, and read them from there from now on.

        The path may hold the index that was loaded: what a snapshot holds never
        changes.
        """
        if not self.records:
            raise ValueError("there is no library to save")
        path = os.path.expanduser(path)
        rows = [(r["library_id"], r["name"], r["folder"], r["description"], r["priority"], r["tags"], r.get("size", 4000)) for r in self.records.values()]
        schema = "library_id string, name string, folder string, description string, priority string, tags array<string>, size int"
        of = lambda tables: functools.reduce(DataFrame.unionByName, [t.withColumn("library_id", F.lit(key)) for key, t in tables.items()])
        more = {"postings": of({key: self._index(key) for key in self.tables}), "listing": of(self.listings)}
        S.save(self.spark, {"libraries": self.spark.createDataFrame(rows, schema).coalesce(1), "files": self._union(0), "chunks": self._union(1), **more}, path)
        found = S.load(self.spark, path)
        for key in self.records:
            self._bind(key, found)

    def _bind(self, key: str, found: dict[str, DataFrame]) -> None:
        own = {name: t.where(F.col("library_id") == key) for name, t in found.items()}
        self.tables[key] = (own["files"], own["chunks"])
        self.indexes[key] = own["postings"].drop("library_id")
        self.listings[key] = own["listing"].drop("library_id")
        self.deltas.pop(key, None)

    def load_index(self, path: str) -> tuple[int, int]:
        """(loaded, skipped): a library whose folder is gone is skipped, all are if the version differs."""
        found = S.load(self.spark, os.path.expanduser(path))
        if found is None:
            return 0, 0
        rows = [r.asDict() for r in found["libraries"].collect()]  # one row a library
        good = [r for r in rows if os.path.isdir(r["folder"])]
        for r in good:
            self.records[r["library_id"]] = r
            self._bind(r["library_id"], found)
        return len(good), len(rows) - len(good)


def _numbered(chunks: DataFrame) -> DataFrame:
    """Chunks with the number by which postings know them."""
    return chunks.withColumn("seq", F.xxhash64("library_id", "file_path", "chunk_index"))


def is_local(url: str) -> bool:
    return url.startswith("local://")


def search_candidates(hits: DataFrame, most: int = 8, year: int = 2026) -> DataFrame:
    """Captured hits, scored and ranked."""
    return scoring.rank(scoring.score(hits, year), most)


def read_pages(pages: DataFrame, urls: list[str], limit: int = 8000, links: int = 10) -> DataFrame:
    """Captured pages by URL in the order asked for; a page that is missing has null text.

    ``pages`` has page_id, url, html; where it also has content_type and
    content, PDFs are read from these bytes, and where it has content_type,
    pdf_text, pages and info, from what a parser captured of them.
    """
    asked = pages.sparkSession.createDataFrame(list(enumerate(dict.fromkeys(urls))), "number int, url string")
    own = pages.join(F.broadcast(asked.select("url")), "url", "left_semi")
    if "content" in pages.columns:
        is_pdf = F.col("content").isNotNull() & (X.is_pdf_type("content_type") | X.is_pdf_url("url"))
        read = extract.extract_pdf(pdf.captured(own.where(is_pdf).select("page_id", "url", "content")), limit)
        got = extract.extract(own.where(~is_pdf), limit).unionByName(read)
    elif "pdf_text" in pages.columns:
        is_pdf = F.col("pdf_text").isNotNull() & (X.is_pdf_type("content_type") | X.is_pdf_url("url"))
        read = extract.extract_pdf(own.where(is_pdf).select("page_id", "url", F.col("pdf_text").alias("text"), "pages", "info"), limit)
        got = extract.extract(own.where(~is_pdf), limit).unionByName(read)
    else:
        got = extract.extract(own, limit)
    got = got.withColumn("outlinks", F.slice("outlinks", 1, links))
    return asked.join(got.drop("page_id"), "url", "left").orderBy("number")


#: URLs that may be read at once.
MOST_URLS = 10


def read_many(pages: DataFrame, urls: list[str], limit: int = 8000, outcomes: DataFrame | None = None, year: int = 2026) -> DataFrame:
    """Up to ten captured pages: number, url, title, published, word_count, domain_score, tier, text, error.

    A page that could not be read has no text and says why: what ``outcomes``
    (url, outcome, as ``sources.fetch`` tells them) has of it, or that it was not
    captured or holds nothing.
    """
    if not 1 <= len(urls) <= MOST_URLS:
        raise ValueError(f"between 1 and {MOST_URLS} URLs can be read at once, not {len(urls)}")
    got = read_pages(pages, urls, limit)
    known = pages.join(F.broadcast(got.select("url")), "url", "left_semi").select("url").distinct().withColumn("captured", F.lit(True))
    got = got.join(known, "url", "left")
    if outcomes is None:
        got = got.withColumn("outcome", F.lit(None).cast("string"))
    else:
        got = got.join(outcomes.select("url", "outcome").dropDuplicates(["url"]), "url", "left")
    bad = F.coalesce(F.trim("text"), F.lit("")) == ""
    why = F.when(F.col("outcome").isin("blocked", "error"), F.concat(F.lit("fetch: "), "outcome")).when(F.col("captured"), "the page holds no text").otherwise("the page was not captured")
    scored = scoring.with_authority(got.withColumn("title", F.coalesce("title", F.lit(""))))
    none = lambda c, x: F.when(F.col("error").isNull(), F.col(c)).otherwise(F.lit(x)).alias(c)
    return scored.withColumn("error", F.when(bad, why)).select(
        F.col("number") + 1, "url", "title", "published", none("word_count", 0), none("domain_score", 0), none("tier", "general"), none("text", ""), "error"
    ).withColumnRenamed("(number + 1)", "number").orderBy("number")


def prompt_with_clock(message: str, now: str) -> str:
    """A message with the date and time before it; ``now`` as ISO text, for the clock is the caller's."""
    spark = SparkSession.getActiveSession()
    return spark.range(1).select(X.with_clock(F.lit(message), F.to_timestamp(F.lit(now)))).first()[0]


# Bounds of what may be asked for.
CONTENT = (1000, 20000)
MOST_FOCUS = 6
LEAST_TOPIC = 3


@dataclass(frozen=True)
class Settings:
    """What a user may set; ``content`` unset means what the depth says."""

    depth: str = "standard"
    content: int | None = None
    follow_links: bool = True
    use_model: bool = True
    local_sources: bool = True

    @classmethod
    def of(cls, given: dict) -> Settings:
        """Settings with defaults for what is missing, empty or not known."""
        known = {k: v for k, v in given.items() if k in cls.__dataclass_fields__ and v is not None}
        if known.get("depth") not in planning.DEPTHS:
            known.pop("depth", None)
        if not known.get("content"):
            known.pop("content", None)
        return cls(**known)


def deep_research(
    topic: str, hits: DataFrame, pages: DataFrame, store: Store | None = None, model: planning.Model | None = None, settings: Settings | None = None,
    focus: list[str] | None = None, depth: str | None = None, content: int | None = None, year: int = 2026, cancelled: Callable[[], bool] = lambda: False,
) -> dict | str:
    """A whole run: rounds, queries, coverage, report and an index of its sources; a message if it fails or is cancelled before it has any."""
    if len(topic.strip()) < LEAST_TOPIC:
        return f"Error: a topic needs {LEAST_TOPIC} characters"
    s = settings or Settings()
    size = content or s.content
    if cancelled():
        return "Research cancelled."
    try:
        own = store if store and store.records and s.local_sources else None
        got = R.research(
            topic, hits, pages, depth or s.depth, year, local=own and own.chunks(), postings=own and own.postings(), model=model if s.use_model else None, links=s.follow_links,
            focus=(focus or [])[:MOST_FOCUS], content=min(max(size, CONTENT[0]), CONTENT[1]) if size else None, cancelled=cancelled,
        )
    except Exception as e:  # a tool answers with the reason
        return f"Error: {e}"
    if cancelled() and got.sources.isEmpty():
        return "Research was cancelled before any sources were collected."
    index = [r.asDict() for r in report.tool_output(report.indexed(got.sources)).orderBy("idx").collect()]  # bounded by the budgets
    return {
        "topic": topic, "rounds": got.rounds, "sources": len(index), "queries": got.queries, "covered": got.covered, "gaps": got.gaps,
        "has_narrative": got.narrative is not None, "contradictions": len(got.contradictions), "report": got.markdown, "index": index,
    }


research = R.research
