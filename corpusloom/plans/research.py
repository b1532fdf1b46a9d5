"""Rounds of a research run over captured hits and pages, and over local libraries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.tables import PLAN_STOP_WORDS
from corpusloom.operators import admission, coverage, retrieval, scoring
from corpusloom.operators import corpus as C
from corpusloom.plans import model as M
from corpusloom.plans import planning, report
from corpusloom.plans.planning import Depth, Model, Task
from corpusloom.session import checkpointed, written

_LINKS = "array<struct<text:string,href:string>>"
#: Columns of a source, with their types.
SOURCE = {
    "ord": "bigint", "url": "string", "host": "string", "title": "string", "description": "string", "published": "string", "text": "string", "word_count": "int",
    "relevance": "double", "tier": "string", "domain_score": "int", "freshness_score": "int", "source_query": "string", "worker_role": "string",
    "worker_label": "string", "origin": "string", "fp": "string", "task_id": "string", "outlinks": _LINKS,
}
#: Engines whose pages are asked first; others only where a preset names them, for fewer hits.
MAIN_ENGINES = ["lite", "html"]
MORE_HITS = 8
MUTATIONS = 2
#: Share of a task's budget that local libraries may fill, and its least.
LOCAL_SHARE, LEAST_LOCAL = 0.3, 2
DISCOVERIES = 5
ROUND = 10_000_000  # sources of a round are numbered from its multiple


@dataclass
class Result:
    sources: DataFrame
    rounds: int
    gaps: list[str]
    markdown: str
    queries: list[str] = field(default_factory=list)
    covered: list[str] = field(default_factory=list)
    narrative: str | None = None
    contradictions: list[dict] = field(default_factory=list)


def topic_words(topic: str) -> list[str]:
    words = "".join(c if c.isascii() and (c.isalnum() or c.isspace()) else "" for c in topic.lower()).split()
    return [w for w in words if len(w) > 2 and w not in PLAN_STOP_WORDS][:8]


class Run:
    """One run's captured tables and what it has collected so far."""

    def __init__(self, hits: DataFrame, pages: DataFrame, depth: Depth, words: list[str], year: int, local: DataFrame | None, content: int, postings: DataFrame | None = None, cancelled: Callable[[], bool] = lambda: False):
        self.cancelled = cancelled
        self.spark, self.depth, self.words, self.year, self.local, self.content = hits.sparkSession, depth, words, year, local, content
        self.postings = written(C.postings(local)) if local is not None and postings is None else postings  # for all rounds
        engine = F.col("engine") if "engine" in hits.columns else F.lit(MAIN_ENGINES[0])
        self.hits = hits.select("query", "seq", "url", *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "snippet")], engine.alias("engine"))
        told = {"title": "string", "description": "string", "published": "string", "outlinks": _LINKS}
        own = [(F.col(c) if c in pages.columns else F.lit(None)).cast(t).alias(f"page_{c}") for c, t in told.items()]
        self.pages = pages.select("url", F.left("text", F.lit(content)).alias("text"), *own)
        self.sources = checkpointed(self.spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in SOURCE.items())))
        self.tried = self.spark.createDataFrame([], "url string")
        self.asked: list[str] = []

    def _fetched(self, urls: DataFrame) -> DataFrame:
        """One captured page of each of ``urls``: of several captures the least by its fields.

        Candidates are few; captures of other URLs are dropped before anything is shuffled.
        """
        own = self.pages.join(F.broadcast(urls.select("url").distinct()), "url", "left_semi")  # bounded by the budgets
        links = F.transform("page_outlinks", lambda x: F.to_json(x))
        order = F.row_number().over(Window.partitionBy("url").orderBy("text", "page_title", "page_description", "page_published", links))
        return own.withColumn("__n", order).where("__n = 1").drop("__n")

    # --------------------------------------------------------- one round

    def collect(self, tasks: list[Task], number: int) -> int:
        """Run a round's tasks; the number of new sources.  Whether the run is cancelled is asked before every step."""
        before = self.sources.count()
        for step in self._steps(tasks, number):
            if self.cancelled():
                break
            step()
        return self.sources.count() - before

    def _steps(self, tasks: list[Task], number: int) -> Iterator[Callable[[], None]]:
        self.number, self.base = number, number * ROUND
        t, q = planning.as_tables(self.spark, tasks)
        tasks_, queries = F.broadcast(t), F.broadcast(q)  # some dozens of rows, by the preset
        if self.local is not None:
            yield lambda: self._add(self._local(t, q))
        yield lambda: self._search(queries, tasks_)
        links = [x for x in tasks if x.follow_links]
        if links:
            yield lambda: self._follow(tasks_, links)
        yield lambda: self._discover(tasks, tasks_)

    def _search(self, queries: DataFrame, tasks_: DataFrame) -> None:
        """Ask the queries and let in what they find."""
        hits = checkpointed(self._hits(queries))
        self.asked += [r.query for r in hits.groupBy("query").agg(F.min(F.struct("task_id", "pos")).alias("at")).orderBy("at").collect()]
        if not self.cancelled():
            self._admit(self._ranked(hits, tasks_), tasks_, "budget")

    def _hits(self, queries: DataFrame) -> DataFrame:
        """Hits of each task's queries: main engines, rephrased queries where they give few, then further engines."""
        d = self.depth
        main = F.col("engine").isin(MAIN_ENGINES)
        got = self.hits.where(main & (F.col("seq") <= d.hits)).join(queries, "query")
        n = queries.join(got.groupBy("task_id", "pos").agg(F.count("*").alias("n")), ["task_id", "pos"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        forms = F.array(*[F.struct(F.lit(k).alias("attempt"), X.mutate_query("query", k).alias("new")) for k in range(MUTATIONS)])
        again = n.where(F.col("n") < d.few_hits).select("task_id", "pos", "n", F.explode(forms).alias("f")).select("task_id", "pos", "n", "f.attempt", F.col("f.new").alias("query"))
        more = self.hits.where(main & (F.col("seq") <= d.hits)).join(F.broadcast(again.where("query is not null")), "query")
        counted = more.withColumn("m", F.count("*").over(Window.partitionBy("task_id", "pos", "attempt"))).where("m > n")
        first = counted.withColumn("a", F.min("attempt").over(Window.partitionBy("task_id", "pos"))).where("attempt = a")
        extra = self.hits.where(F.col("engine").isin(list(d.engines)) & (F.col("seq") <= min(d.hits, MORE_HITS))).join(queries, "query")
        names = F.array(*[F.lit(e) for e in (*MAIN_ENGINES, *d.engines)])
        columns = ["task_id", "query", "pos", "kind", "seq", "url", "title", "snippet"]
        parts = [(got, F.lit(0)), (first, F.lit(1)), (extra, 2 + F.array_position(names, F.col("engine")).cast("int"))]
        out = [p.withColumn("kind", k).select(*columns) for p, k in parts]
        return out[0].unionByName(out[1]).unionByName(out[2])

    def _ranked(self, hits: DataFrame, tasks: DataFrame) -> DataFrame:
        """Candidates of each task by score, preferred tiers first, as many as its pool holds."""
        place = F.struct("pos", "kind", "seq")
        w = Window.partitionBy("task_id", "url").orderBy(place)
        one = hits.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
        scored = scoring.score(one, self.year).join(tasks, "task_id")
        fits = F.coalesce(F.array_contains("tiers", F.col("tier")), F.lit(True))
        any_fits = F.max(fits.cast("int")).over(Window.partitionBy("task_id"))
        scored = scored.withColumn("keep", fits | (any_fits == 0)).where("keep and total_score > 12 and url_quality > 8")
        turn = F.row_number().over(Window.partitionBy("task_id").orderBy(F.col("total_score").desc(), place))
        return scored.withColumn("turn", turn).where(F.col("turn") <= F.col("budget") * self.depth.pool).select("task_id", "turn", "url", "title", "snippet", "query")

    # --------------------------------------------------------- admission

    def _admit(self, candidates: DataFrame, tasks: DataFrame, limit: str, more: DataFrame | None = None) -> None:
        """Fetch candidates (task_id, turn, url, title, snippet, query) and let in what passes.

        ``limit`` names the column that bounds a task's new sources, in
        ``tasks`` or in ``more`` (task_id and that column).
        """
        seen = self.sources.select("url").union(self.tried)
        c = scoring.first_per(candidates.withColumn("ord", F.struct("task_id", "turn")), "url", "ord").join(seen, "url", "left_anti")
        c = checkpointed(c)
        self.tried = checkpointed(self.tried.union(c.select("url")))
        page = c.join(self._fetched(c), "url").withColumn("word_count", X.count_words("text"))
        page = page.withColumn("relevance", admission.relevance(F.col("text"), F.col("page_title"), F.col("snippet"), self.words))
        told = scoring.score(page.withColumn("shown", F.col("title")).withColumn("title", F.coalesce("page_title", "title")).withColumn("snippet", F.coalesce("page_description", "snippet")), self.year)
        told = told.join(tasks.select("task_id", "role", "label", "budget"), "task_id")
        if more is not None:
            told = told.join(more, "task_id")
        else:  # what local sources left
            have = self._have()
            told = told.join(F.broadcast(have), "task_id", "left").withColumn("budget", F.col("budget") - F.coalesce("have", F.lit(0)))
        hosts = self.sources.where("origin = 'web'").groupBy("host").agg(F.count("*").alias("n"))
        got = admission.admit(told, self.spark.createDataFrame([], "url string"), self.sources.select("fp").distinct(), self.depth.relevance, self.depth.host_cap, F.col(limit), hosts)
        self._add(got.select(
            "ord", "url", "host", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled")).alias("title"),
            F.coalesce("page_description", F.left("text", F.lit(250))).alias("description"), F.col("page_published").alias("published"), "text", "word_count", "relevance",
            "tier", "domain_score", "freshness_score", F.col("query").alias("source_query"), F.col("role").alias("worker_role"), F.col("label").alias("worker_label"),
            F.lit("web").alias("origin"), "fp", "task_id", F.slice(F.coalesce("page_outlinks", F.array().cast(_LINKS)), 1, self.depth.outlinks).alias("outlinks"),
        ))

    def _have(self) -> DataFrame:
        """Sources of each task of this round."""
        return self.sources.where(F.col("ord") > self.base).groupBy("task_id").agg(F.count("*").cast("int").alias("have"))

    def _add(self, new: DataFrame) -> None:
        """Number new sources (``ord`` is their order) after this round's earlier ones."""
        last = self.sources.agg(F.max("ord")).first()[0] or 0
        # one numbering over a step's new sources, which the tasks' budgets bound
        turn = F.row_number().over(Window.orderBy("ord")) + F.lit(max(last, self.base))
        self.sources = checkpointed(self.sources.unionByName(new.withColumn("ord", turn.cast("bigint")).select(*[F.col(c).cast(t).alias(c) for c, t in SOURCE.items()])))

    # --------------------------------------------------------- more ways to a source

    def _local(self, tasks: DataFrame, queries: DataFrame) -> DataFrame:
        """Chunks of local libraries for each task; they pass by relevance and host caps, but are known by URL and text."""
        asked = queries.select(F.xxhash64("query").alias("query_id"), "query").distinct()
        most = max(LEAST_LOCAL, -(-self.depth.pages * 3 // 10))
        best = retrieval.progressive(retrieval.best_hits(self.local, asked, max(most, 3), boost=False, per_tier=True, post=self.postings), most)
        told = retrieval.as_sources(best, self.local, self.content).join(best.select("query_id", "seq", "rank"), ["query_id", "seq"])
        told = told.join(queries.withColumn("query_id", F.xxhash64("query")), "query_id").join(tasks.select("task_id", "role", "label", "budget"), "task_id")
        told = told.join(self.sources.select("url"), "url", "left_anti")
        share = F.greatest(F.lit(LEAST_LOCAL), F.ceil(F.col("budget") * LOCAL_SHARE))
        told = told.withColumn("ord", F.struct("task_id", "pos", "rank"))
        told = scoring.first_per(told, "url", "ord")  # a chunk serves one task
        told = told.withColumn("turn", F.row_number().over(Window.partitionBy("task_id").orderBy("ord"))).where(F.col("turn") <= share)
        return told.select(
            "ord", "url", F.lit("").alias("host"), "title", "description", F.lit(None).cast("string").alias("published"), "text", "word_count", "relevance", "tier", "domain_score",
            "freshness_score", F.col("query").alias("source_query"), F.col("role").alias("worker_role"), F.col("label").alias("worker_label"), F.lit("local").alias("origin"),
            X.fingerprint("text").alias("fp"), "task_id", F.array().cast(_LINKS).alias("outlinks"),
        )

    def _follow(self, tasks: DataFrame, linked: list[Task]) -> None:
        """Links of a task's sources, the best first, level by level while they bring something."""
        d = self.depth
        words = self.spark.createDataFrame(
            [(t.task_id, [w for w in " ".join(t.queries).lower().split() if len(w) > 3][:12], t.queries[0], t.budget) for t in linked],
            "task_id string, words array<string>, query string, most int",
        )
        for level in range(1, d.link_depth + 1):
            if self.cancelled():
                return
            room = words.join(self._have(), "task_id").withColumn("room", F.least(F.col("most") - F.col("have"), F.lit(d.links_followed))).where("room > 0")
            room = checkpointed(room)  # a row a task
            if room.isEmpty():
                return
            own = self.sources.where(F.col("ord") > self.base).join(F.broadcast(room), "task_id")
            if level > 1:
                late = F.row_number().over(Window.partitionBy("task_id").orderBy(F.col("ord").desc()))
                own = own.withColumn("late", late).where(F.col("late") <= 2 * F.col("room"))
            links = own.select("task_id", "words", "query", "ord", F.posexplode("outlinks").alias("pos", "link"))
            links = links.select("task_id", "words", "query", F.col("link.href").alias("href"), F.col("link.text").alias("text"), F.struct("ord", "pos").alias("seq"))
            known = self.sources.select("url").union(self.tried).distinct()
            best = scoring.score_outlinks(scoring.first_in(links, ["task_id", "href"], "seq"), F.col("words"), known, min(d.links_seen, d.links_followed), "task_id")
            n = self.sources.count()
            self._admit(_as_candidates(best, F.lit("")), tasks, "room", room.select("task_id", "room"))
            if self.sources.count() == n:
                return

    def _discover(self, tasks: list[Task], table: DataFrame) -> None:
        """First outlinks of this round's sources, dealt in order to the tasks with room, five each at most."""
        have = {r.task_id: r.have for r in self._have().collect()}  # a row a task
        room, start = [], 0
        for t in tasks:
            n = min(DISCOVERIES, t.budget - have.get(t.task_id, 0))
            if n > 0:
                room += [(t.task_id, start + k, n, t.queries[0]) for k in range(n)]
                start += n
        if not room:
            return
        known = self.sources.select("url").union(self.tried).distinct()
        found = admission.discoveries(self.sources.where(F.col("ord") > self.base), known, DISCOVERIES, start)
        slots = self.spark.createDataFrame(room, "task_id string, slot int, room int, query string")
        # one numbering over at most five links a task
        found = found.withColumn("slot", F.row_number().over(Window.orderBy("ord", "pos")) - 1).withColumnRenamed("url", "href")
        dealt = found.join(F.broadcast(slots), "slot").withColumn("rank", F.col("slot"))
        self._admit(_as_candidates(dealt, F.col("text")), table, "room", slots.select("task_id", "room").distinct())


def _as_candidates(links: DataFrame, title: Column) -> DataFrame:
    return links.select("task_id", F.col("rank").alias("turn"), F.col("href").alias("url"), title.alias("title"), F.lit("").alias("snippet"), "query")


def research(
    topic: str, hits: DataFrame, pages: DataFrame, depth: str = "standard", year: int = 2026, *, local: DataFrame | None = None, postings: DataFrame | None = None,
    model: Model | None = None, links: bool = True, focus: list[str] | None = None, content: int | None = None, cancelled: Callable[[], bool] = lambda: False,
) -> Result:
    """Collect sources round by round until every dimension is covered or nothing new comes.

    ``hits`` (query, seq, url, title, snippet, engine if there are several) stands
    for search, ``pages`` (url, text, and title, description, published, outlinks
    if known) for fetching; both are captured tables.  ``local`` holds chunks of
    local libraries, ``postings`` theirs if an index has them.  Without a ``model`` queries come from templates.
    ``cancelled`` is asked before every round and step; a cancelled run reports what it has, without a model's part.
    """
    spark = hits.sparkSession
    d = planning.DEPTHS[depth]
    run = Run(hits, pages, d, topic_words(topic), year, local, content or d.content, postings, cancelled)
    specs = M.decompose(model, topic, d, focus)
    tasks = planning.first_tasks(spark, topic, d, specs, focus, links, None if specs else M.role_specs(spark, model, topic, d, focus))
    short = planning.short_topic(topic)
    done, stagnant, gap, covered, follow_ups = 0, 0, [], [], []
    for number in range(d.rounds):
        if cancelled():
            break
        new = run.collect(tasks, number)
        done = number + 1
        cover = coverage.covered(coverage.dimension_hits(run.sources)).orderBy("ordinal").collect()  # twelve rows
        covered, gap = [r.dimension for r in cover if r.covered], [r.dimension for r in cover if not r.covered]
        stagnant = 0 if new or number == 0 else stagnant + 1
        if not gap or stagnant >= d.stagnant or done == d.rounds or cancelled():
            break
        if new:
            follow_ups = M.summarise(model, topic, run.sources)
        missing = spark.createDataFrame([(r.ordinal, r.dimension) for r in cover if not r.covered], "ordinal int, dimension string")
        plan = M.gap_queries(model, topic, coverage.gap_plan(missing, short, d.gap_queries), d, follow_ups)
        tasks = planning.gap_tasks(plan, d, done + 1, links)
    told = report.indexed(run.sources)
    model = None if cancelled() else model
    story = M.narrative(model, topic, told, d, covered, gap)
    against = M.contradictions(model, topic, told, d)
    queries = list(dict.fromkeys(run.asked))
    return Result(run.sources, done, gap, report.build(topic, run.sources, run.words, story, against, done, queries), queries, covered, story, against)
