"""What a language model may add to a run; without one every step has its fallback.

A model is any callable of a prompt and a number of tokens.  Its answers are
parsed by ``planning`` and ``coverage``; an answer that fails, is empty or too
thin counts as none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import coverage
from corpusloom.plans import planning
from corpusloom.plans.planning import Depth, Model, Spec

# Tokens of an answer by its purpose, and what an answer must have.
QUERY_TOKENS, PLAN_TOKENS, SUMMARY_TOKENS, LEAST_CONTRADICTION_TOKENS = 500, 1200, 600, 1500
LEAST_QUERIES, LEAST_GAP_QUERIES, LEAST_NARRATIVE = 4, 2, 100
SUMMARY_SOURCES, SUMMARY_CHARS, CONTRADICTION_CHARS = 20, 300, 400
LEAST_COMPARED = 3


def ask(model: Model | None, prompt: str, tokens: int) -> str | None:
    """The answer, or none where there is no model or it fails."""
    if model is None:
        return None
    try:
        return model(prompt, tokens) or None
    except Exception:  # whatever a model's client raises, the run goes on
        return None


def _lines(spark, body: str | None, most: int) -> list[str]:
    return [] if body is None else list(spark.range(1).select(X.parse_lines(F.lit(body), most)).first()[0])


def decompose(model: Model | None, topic: str, depth: Depth, focus: list[str] | None = None) -> list[Spec] | None:
    """Workers that the model divides the topic among; none unless three are sound."""
    about = f" Pay attention to: {', '.join(focus)}." if focus else ""
    body = ask(
        model,
        f"Divide research on '{topic}' among 3 to {depth.workers} workers.{about} Answer with a JSON array only; each item has role (one of "
        f"{', '.join(planning.ROLE_DIMENSIONS)}), label, queries (2 to {depth.queries} strings), budgetWeight (0.05 to 0.5), followLinks, preferredTiers.",
        PLAN_TOKENS,
    )
    return None if body is None else planning.parse_plan(body, depth.workers, depth.queries)


def role_specs(spark, model: Model | None, topic: str, depth: Depth, focus: list[str] | None = None) -> dict[str, list[str]]:
    """Queries by role, for the roles that the model gives at least four for."""
    out = {}
    for role in planning.roles(depth) if model else ():
        wanted = ", ".join(planning.ROLE_DIMENSIONS[role] + (focus or []))
        got = _lines(spark, ask(model, f"Write {depth.queries} different search queries on '{topic}' that look into: {wanted}. One a line, nothing else.", QUERY_TOKENS), depth.queries)
        if len(got) >= LEAST_QUERIES:
            out[role] = got
    return out


def source_block(sources: DataFrame, most: int, chars: int) -> str:
    """The first ``most`` sources (idx, title, published, tier, domain_score, text) for a prompt, ``chars`` of each."""
    date = F.when(F.col("published").isNotNull(), F.concat(F.lit(" ("), "published", F.lit(")"))).otherwise("")
    head = F.concat(F.lit("["), "idx", F.lit('] "'), "title", F.lit('"'), date, F.lit(" — "), "tier", F.lit(" (score: "), "domain_score", F.lit(")\n"))
    rows = sources.orderBy("idx").limit(most).select("idx", F.concat(head, X.preview("text", chars)).alias("block"))
    return "\n\n".join(r.block for r in sorted(rows.collect(), key=lambda r: r.idx))  # bounded by the preset


def summarise(model: Model | None, topic: str, sources: DataFrame) -> list[str]:
    """Follow-up questions after a round."""
    if model is None:
        return []
    rows = sources.orderBy("ord").limit(SUMMARY_SOURCES).select("ord", "worker_label", "title", F.left("text", F.lit(SUMMARY_CHARS)).alias("text")).collect()
    told = "\n\n".join(f"[{k}] {r.worker_label}: {r.title} — {r.text}" for k, r in enumerate(sorted(rows, key=lambda r: r.ord), 1))
    body = ask(model, f"Sources on '{topic}':\n\n{told}\n\nGive 3 to 5 findings under a line FINDINGS: and 3 to 5 open questions under a line FOLLOW_UP:, one a line, with a dash.", SUMMARY_TOKENS)
    if body is None:
        return []
    answer = sources.sparkSession.createDataFrame([(0, body)], "id int, body string")
    return [r.item for r in coverage.parse_findings(answer).where("section = 'follow_up'").orderBy("pos").collect()]


def gap_queries(model: Model | None, topic: str, plan: DataFrame, depth: Depth, follow_ups: list[str]) -> DataFrame:
    """``coverage.gap_plan`` with the model's queries for the roles that it gives at least two for."""
    if model is None:
        return plan
    spark, own = plan.sparkSession, []
    hint = f" Open questions: {'; '.join(follow_ups[:6])}." if follow_ups else ""
    for r in plan.orderBy("ordinal").collect():  # one row a role
        n = min(3 * len(r.label.split(", ")), depth.gap_queries)
        got = _lines(spark, ask(model, f"Research on '{topic}' lacks {r.label}.{hint} Write {n} search queries for a {r.role} worker, one a line.", QUERY_TOKENS), depth.gap_queries)
        if len(got) >= LEAST_GAP_QUERIES:
            own.append((r.role, got))
    new = spark.createDataFrame(own, "role string, own array<string>")
    return plan.join(F.broadcast(new), "role", "left").withColumn("queries", F.coalesce("own", "queries")).drop("own")  # ten roles at most


def paragraphs(sources: int) -> str:
    return "8 to 15" if sources > 50 else "6 to 10" if sources > 20 else "4 to 8"


def narrative(model: Model | None, topic: str, sources: DataFrame, depth: Depth, covered: list[str], gaps: list[str]) -> str | None:
    """A synthesis of more than a hundred characters, or none."""
    n = sources.count() if model else 0
    if n == 0:
        return None
    missing = f" Not covered: {', '.join(gaps)}." if gaps else ""
    body = ask(
        model,
        f"Write {paragraphs(n)} paragraphs that bring together {n} sources on '{topic}' by theme, citing them as [1], [2]. Say where they agree, where not, and what is "
        f"missing; end with takeaways. Covered: {', '.join(covered)}.{missing}\n\n{source_block(sources, depth.told_sources, depth.told_chars)}",
        depth.told_tokens,
    )
    return body if body and len(body) > LEAST_NARRATIVE else None


def contradictions(model: Model | None, topic: str, sources: DataFrame, depth: Depth) -> list[dict]:
    """Contradictions that the model finds among at least three sources."""
    n = sources.count() if model else 0
    if n < LEAST_COMPARED:
        return []
    most = min(10, max(5, n // 5))
    body = ask(
        model,
        f"Which of these sources on '{topic}' contradict each other? One line each, at most {most}, as\nCLAIM: .. | SOURCE_A: [i] .. | SOURCE_B: [j] .. | "
        f"SEVERITY: minor/moderate/major\nor NONE.\n\n{source_block(sources, depth.compared_sources, CONTRADICTION_CHARS)}",
        max(LEAST_CONTRADICTION_TOKENS, 200 * most),
    )
    if body is None:
        return []
    spark = sources.sparkSession
    return [r.asDict() for r in coverage.parse_contradictions(spark.createDataFrame([(body,)], "body string"), sources).orderBy("pos").collect()]
