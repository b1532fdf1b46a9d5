"""Depth presets, roles, queries and tasks of a research run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.tables import DIMENSIONS, LINK_ROLES, ROLE_DIMENSIONS, ROLE_LABELS, SOLID_TIERS, TIER_ROLES

#: A language model: a prompt and the most tokens of its answer; None or an exception where there is no answer.
Model = Callable[[str, int], "str | None"]


@dataclass(frozen=True)
class Depth:
    """What a preset allows."""

    rounds: int
    pages: int
    gap_pages: int
    content: int
    hits: int
    queries: int
    host_cap: int
    links_seen: int
    links_followed: int
    outlinks: int
    pool: int
    fetches: int
    workers: int
    gap_queries: int
    spacing_ms: int
    relevance: float
    told_sources: int
    told_chars: int
    told_tokens: int
    compared_sources: int
    stagnant: int
    search_pages: int
    lanes: int
    fan_out: int
    engines: tuple[str, ...]
    link_depth: int
    few_hits: int


# The five presets, fields in the order of ``Depth``.
DEPTHS = {
    "shallow": Depth(1, 5, 4, 5000, 8, 4, 3, 30, 3, 30, 3, 3, 6, 5, 2200, 0.15, 20, 600, 3000, 15, 1, 1, 2, 1, (), 1, 2),
    "standard": Depth(3, 8, 6, 6000, 10, 5, 4, 50, 6, 40, 3, 3, 8, 6, 2000, 0.13, 30, 600, 4000, 20, 1, 1, 2, 1, ("brave",), 1, 2),
    "deep": Depth(5, 12, 10, 8000, 15, 7, 5, 60, 10, 60, 4, 4, 10, 8, 1800, 0.10, 50, 500, 5000, 30, 2, 2, 3, 2, ("brave", "searxng"), 2, 3),
    "deeper": Depth(10, 18, 14, 12000, 18, 10, 6, 80, 14, 80, 5, 5, 12, 10, 1500, 0.08, 70, 450, 6500, 40, 2, 2, 4, 2, ("brave", "scholar", "searxng"), 2, 3),
    "exhaustive": Depth(15, 25, 18, 16000, 20, 12, 8, 120, 18, 100, 6, 6, 14, 14, 1200, 0.06, 100, 400, 8000, 60, 3, 3, 5, 3, ("brave", "scholar", "searxng", "mojeek"), 3, 4),
}

# Roles by preset.
CORE_ROLES = ["breadth", "depth", "recency", "academic", "critical"]
MORE_ROLES = ["technical", "comparative", "statistical"]  # from five rounds on
ALL_ROLES = ["statistical", "regulatory", "technical", "primary", "comparative"]  # from ten rounds on


def roles(depth: Depth) -> list[str]:
    """Five roles; eight from five rounds on; all ten from ten rounds on."""
    return CORE_ROLES + (ALL_ROLES if depth.rounds >= 10 else MORE_ROLES if depth.rounds >= 5 else [])


def short_topic(topic: str) -> str:
    """A topic short enough for a query (``text.short_topic`` of one value)."""
    spark = SparkSession.getActiveSession()
    return spark.range(1).select(X.short_topic(F.lit(topic))).first()[0]


def fallback_queries(spark: SparkSession, topic: str, most: int, focus: list[str] | None = None) -> DataFrame:
    """role, pos, query: templates of the role's dimensions in dimension order, then focus areas, each once."""
    short, rows = short_topic(topic), []
    for role, dims in ROLE_DIMENSIONS.items():
        qs = [q.replace("{t}", short) for d in DIMENSIONS if d[0] in dims for q in d[3]] + [f"{short} {f}" for f in focus or ()]
        rows += [(role, i, q) for i, q in enumerate(list(dict.fromkeys(qs))[:most])]
    return spark.createDataFrame(rows, "role string, pos int, query string")


def fallback_table(topics: DataFrame, most: int) -> DataFrame:
    """key, role, pos, query for a table of topics (key, topic): each role's templates with the short topic, each once."""
    rows = [(r, i, p, q) for r, dims in ROLE_DIMENSIONS.items() for i, d in enumerate(DIMENSIONS) if d[0] in dims for p, q in enumerate(d[3])]
    forms = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(i).alias("i"), F.lit(p).alias("p"), F.lit(q).alias("form")) for r, i, p, q in rows])
    told = topics.select("key", X.short_topic("topic").alias("short"), F.explode(forms).alias("f"))
    told = told.select("key", "f.role", F.struct("f.i", "f.p").alias("at"), F.replace("f.form", F.lit("{t}"), F.col("short")).alias("query"))
    once = told.groupBy("key", "role", "query").agg(F.min("at").alias("at"))
    pos = F.row_number().over(Window.partitionBy("key", "role").orderBy("at")) - 1
    return once.withColumn("pos", pos).where(F.col("pos") < most).select("key", "role", "pos", "query")


def fan_out(queries: DataFrame, groups: int, key: str | list[str] = "role") -> DataFrame:
    """Deal each role's queries round-robin to ``groups``, if there are more than two."""
    size = queries.groupBy(key).agg(F.count("*").alias("__n"))
    dealt = queries.join(size, key)
    return dealt.withColumn("grp", F.when((F.col("__n") > 2) & F.lit(groups > 1), F.pmod("pos", F.lit(groups))).otherwise(0)).drop("__n")


# ------------------------------------------------------------- plans of a model


@dataclass(frozen=True)
class Spec:
    role: str
    label: str
    queries: list[str] = field(default_factory=list)
    weight: float = 0.2
    follow_links: bool = False
    tiers: list[str] | None = None


LEAST_WORKERS = 3
LEAST_WEIGHT, MOST_WEIGHT, USUAL_WEIGHT = 0.05, 0.5, 0.2


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def plan_specs(answers: DataFrame, workers: int = 14, queries: int = 12) -> DataFrame:
    """id, pos, role, label, queries, weight, follow_links, tiers of the workers in a model's JSON (id, body).

    The first ``workers`` items count; an item needs two queries of more than
    three characters and keeps ``queries`` of them; unknown roles are breadth;
    weights are bounded, then scaled to 1.  An answer with fewer than three
    items, or fewer than three sound ones, gives nothing.
    """
    body = F.regexp_extract(F.regexp_replace("body", "```(?:json)?", ""), r"(?s)(\[.*\])", 1)
    items = F.try_variant_get(F.try_parse_json(body), "$", "array<variant>")
    flat = answers.select("id", items.alias("x")).where(F.size("x") >= LEAST_WORKERS).select("id", F.posexplode(F.slice("x", 1, workers)).alias("pos", "item"))
    get = lambda path, kind: F.try_variant_get("item", f"$.{path}", kind)
    text = lambda v: F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))
    asked = F.filter(F.transform(get("queries", "array<variant>"), text), lambda q: F.length(q) > 3)
    role = get("role", "string")
    weight = F.when(_kind(get("budgetWeight", "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), get("budgetWeight", "double"))
    told = flat.select(
        "id", "pos", F.when(role.isin(list(ROLE_DIMENSIONS)), role).otherwise("breadth").alias("role"), text(get("label", "variant")).alias("label"),
        F.slice(asked, 1, queries).alias("queries"),
        F.when(weight.isNull(), USUAL_WEIGHT).otherwise(F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(MOST_WEIGHT), weight))).alias("weight"),
        F.coalesce((_kind(get("followLinks", "variant")) == "BOOLEAN") & get("followLinks", "boolean"), F.lit(False)).alias("follow_links"),
        get("preferredTiers", "array<string>").alias("tiers"),
    ).where(F.size("queries") >= 2)
    w = Window.partitionBy("id")  # one answer, ``workers`` rows at most
    sound = told.withColumn("__n", F.count("*").over(w)).where(F.col("__n") >= LEAST_WORKERS)
    label = F.left(F.coalesce("label", F.concat("role", F.lit(" worker"))), F.lit(60))
    return sound.select("id", "pos", "role", label.alias("label"), "queries", (F.col("weight") / F.sum("weight").over(w)).alias("weight"), "follow_links", "tiers")


def parse_plan(body: str, workers: int = 14, queries: int = 12) -> list[Spec] | None:
    """Workers out of one answer; none unless three sound ones are there."""
    spark = SparkSession.getActiveSession()
    rows = plan_specs(spark.createDataFrame([(0, body)], "id int, body string"), workers, queries).orderBy("pos").collect()
    return [Spec(r.role, r.label, list(r.queries), r.weight, r.follow_links, r.tiers) for r in rows] or None


# ------------------------------------------------------------- tasks


@dataclass(frozen=True)
class Task:
    """One worker's share of a round."""

    task_id: str
    role: str
    label: str
    queries: tuple[str, ...]
    budget: int
    follow_links: bool
    tiers: tuple[str, ...] | None


def budget(depth: Depth, weight: float | None) -> int:
    """Pages of a task: by weight where a plan gives one."""
    if weight is None:
        return depth.pages
    return max(int(depth.pages * weight * 2 + 0.5), -(-depth.pages // 2))


def _dealt(spec: Spec, depth: Depth, pages: int, links: bool) -> list[Task]:
    """A spec's task, or one for each group that its queries are dealt to."""
    groups = depth.fan_out if depth.fan_out > 1 and len(spec.queries) > 2 else 1
    parts = [spec.queries[k::groups] for k in range(groups)]
    return [
        Task(f"{spec.role}-{k}", spec.role, spec.label if k == 0 else f"{spec.label} #{k + 1}", tuple(part), pages, links and spec.follow_links, tuple(spec.tiers) if spec.tiers else None)
        for k, part in enumerate(parts)
        if part
    ]


def first_tasks(
    spark: SparkSession, topic: str, depth: Depth, specs: list[Spec] | None = None, focus: list[str] | None = None, links: bool = True,
    by_role: dict[str, list[str]] | None = None,
) -> list[Task]:
    """Tasks of the first round: a model's workers if there are three, else one for each role of the preset.

    ``by_role`` has queries that a model wrote for some roles; the others get templates.
    """
    if specs and len(specs) >= LEAST_WORKERS:
        found = [t for s in specs for t in _dealt(s, depth, budget(depth, s.weight), links)]
    else:
        asked: dict[str, list[str]] = {}
        for r in fallback_queries(spark, topic, depth.queries, focus).orderBy("role", "pos").collect():  # ten roles, a dozen queries
            asked.setdefault(r.role, []).append(r.query)
        asked |= by_role or {}
        plain = [Spec(r, ROLE_LABELS[r], asked[r], 0.0, r in LINK_ROLES, SOLID_TIERS if r in TIER_ROLES else None) for r in roles(depth) if asked.get(r)]
        found = [t for s in plain for t in _dealt(s, depth, depth.pages, links)]
    return _numbered(found, "r1")


def gap_tasks(plan: DataFrame, depth: Depth, number: int, links: bool = True) -> list[Task]:
    """Tasks of a later round out of ``coverage.gap_plan``."""
    rows = plan.orderBy("ordinal").collect()  # one row a role
    return _numbered([Task(r.role, r.role, r.label, tuple(r.queries), depth.gap_pages, links and r.follow_links, tuple(r.tiers) if r.tiers else None) for r in rows], f"r{number}")


def _numbered(tasks: list[Task], prefix: str) -> list[Task]:
    return [Task(f"{prefix}-{k:03d}-{t.role}", t.role, t.label, t.queries, t.budget, t.follow_links, t.tiers) for k, t in enumerate(tasks)]


def as_tables(spark: SparkSession, tasks: list[Task]) -> tuple[DataFrame, DataFrame]:
    """(tasks, queries): a row a task; a row a query of a task."""
    one = [(t.task_id, t.role, t.label, t.budget, t.follow_links, list(t.tiers) if t.tiers else None) for t in tasks]
    many = [(t.task_id, i, q) for t in tasks for i, q in enumerate(t.queries)]
    return (
        spark.createDataFrame(one, "task_id string, role string, label string, budget int, follow_links boolean, tiers array<string>"),
        spark.createDataFrame(many, "task_id string, pos int, query string"),
    )
