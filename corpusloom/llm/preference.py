"""Preference formatting: one prompt, a chosen and a rejected completion.

A conversation is the set of its turns in the order (turn, role, text).  Both
sides of a pair are sorted by that order, so their longest common prefix is all
that comes before the least turn that only one side has: a minimum, not a
sequence to be walked.  The common turns are rendered once, as prompt; later
turns are rendered for each side that has them, as completion.  Only the words
and the end mark of the assistant's turns there bear loss, not their headers,
and none do where a side is missing.

``format_pairs`` gives one row per rendered turn, so that a long conversation
need not fit into one row or one task; ``assemble`` puts the turns of pairs of
at most ``MOST_CHARS`` characters together, one row a part, and leaves the turns
of longer ones as they are.

Only built-in functions are used: one aggregation that removes repeated rows
before the shuffle, one aggregated minimum, one join (by broadcast for the few
pairs that hold a large share of all rows), one grouping of bounded groups.

Defined cases: rows that repeat a turn exactly count once; several texts at one
turn are ordered by role and text; identical sides are all prompt; a pair with
one side missing has no prompt, its turns are completion without loss and
``paired`` is false; null roles and texts sort first and render as empty; turns
without a conversation (null id) come back one by one as part ``none``, without
loss; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut

#: Turn template; a marker inside a text is broken up so that it cannot act.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Characters of a pair's rendered turns up to which its parts are put together.
MOST_CHARS = 1_000_000
#: A pair is joined by broadcast if it has more turns than this and than ``HOT`` of all; there are fewer than 1 / HOT.
HOT_TURNS, HOT = 1000, 1 / 2000


def _safe(c: Column) -> Column:
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))


def _header(role: Column) -> Column:
    return F.concat(F.lit(OPEN), _safe(role), F.lit("\n"))


def _body(text: Column) -> Column:
    return F.concat(_safe(text), F.lit(CLOSE))


def format_pairs(turns: DataFrame) -> DataFrame:
    """``turns`` (pair_id, side 0 chosen or 1 rejected, turn, role, text) rendered: pair_id, part, turn, role, content,
    loss, loss_start, loss_stop (characters of content that bear loss), paired, chars (of the pair)."""
    rows = turns.groupBy("pair_id", "turn", "role", "text").agg(
        F.max((F.coalesce("side", F.lit(-1)) == 0).cast("int")).alias("c"),
        F.max((F.coalesce("side", F.lit(-1)) == 1).cast("int")).alias("r"),
    )
    rows = rows.withColumns({"header": _header(F.col("role")), "body": _body(F.col("text"))})
    place = F.struct("turn", "role", "text")
    size = F.length("header") + F.length("body") + 1
    known, bare = rows.where("pair_id is not null"), rows.where("pair_id is null")
    facts = known.groupBy("pair_id").agg(
        F.min(F.when(F.col("c") != F.col("r"), place)).alias("split"), (F.max("c") + F.max("r") == 2).alias("paired"),
        F.count("*").alias("turns"), F.sum(size).alias("chars"),
    )
    facts = cut(facts)  # a row a pair
    total = facts.agg(F.coalesce(F.sum("turns"), F.lit(0))).first()[0]
    large = F.col("turns") > max(HOT_TURNS, total * HOT)
    hot = F.broadcast(facts.where(large))  # fewer than 1 / HOT rows
    cold = known.join(hot.select("pair_id"), "pair_id", "left_anti").join(facts.where(~large), "pair_id")
    columns = ["pair_id", "turn", "role", "text", "header", "body", "c", "r", "split", "paired", "chars"]
    none = {"split": F.lit(None).cast(facts.schema["split"].dataType), "paired": F.lit(False), "chars": size.cast("long")}
    met = known.join(hot, "pair_id").select(*columns).union(cold.select(*columns)).union(bare.withColumns(none).select(*columns))
    # after the split a turn that both sides have belongs to both completions
    both = F.col("c") + F.col("r") == 2
    prompt = both & (F.col("split").isNull() | (place < F.col("split")))
    parts = (
        F.when(F.col("pair_id").isNull(), F.array(F.lit("none")))
        .when(prompt, F.array(F.lit("prompt")))
        .when(both, F.array(F.lit("chosen"), F.lit("rejected")))
        .when(F.col("c") == 1, F.array(F.lit("chosen")))
        .when(F.col("r") == 1, F.array(F.lit("rejected")))
        .otherwise(F.array(F.lit("none")))
    )
    out = met.withColumn("part", F.explode(parts))
    loss = F.col("part").isin("chosen", "rejected") & F.col("paired") & F.coalesce(F.col("role") == "assistant", F.lit(False))
    start = F.length("header")
    return out.select(
        "pair_id", "part", "turn", "role", "text", F.concat("header", "body", F.lit("\n")).alias("content"), loss.cast("int").alias("loss"),
        F.when(loss, start).otherwise(0).alias("loss_start"), F.when(loss, start + F.length("body")).otherwise(0).alias("loss_stop"), "paired", "chars",
    )


def assemble(formatted: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """pair_id, part, place (0, or the turn where one row is one turn), role, n_turns, content, loss_spans, paired.

    ``loss_spans`` lists the stretches of ``content`` that bear loss as
    ``start-stop``, comma-joined, in characters.
    """
    fits = F.col("pair_id").isNotNull() & (F.col("chars") <= most_chars)
    turn = F.struct("turn", "role", "text", "content", "loss_start", "loss_stop")
    some = formatted.where(fits).groupBy("pair_id", "part", "paired").agg(F.sort_array(F.collect_list(turn)).alias("turns"))  # ``most_chars`` at most
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(seen: Column, t: Column) -> Column:
        at = seen["at"]
        span = F.concat((at + t["loss_start"]).cast("string"), F.lit("-"), (at + t["loss_stop"]).cast("string"))
        return F.struct((at + F.length(t["content"])).alias("at"), F.when(t["loss_stop"] > 0, F.concat(seen["spans"], F.array(span))).otherwise(seen["spans"]).alias("spans"))

    whole = some.select(
        "pair_id", "part", F.lit(0).cast("long").alias("place"), F.lit(None).cast("string").alias("role"), F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.col("turns.content"), "").alias("content"), F.array_join(F.aggregate("turns", empty, add)["spans"], ",").alias("loss_spans"), "paired",
    )
    span = F.when(F.col("loss") == 1, F.concat(F.col("loss_start").cast("string"), F.lit("-"), F.col("loss_stop").cast("string"))).otherwise("")
    rest = formatted.where(~fits).select(
        "pair_id", "part", F.col("turn").cast("long").alias("place"), "role", F.lit(1).cast("long").alias("n_turns"), "content", span.alias("loss_spans"), "paired"
    )
    return whole.union(rest)


def from_conversations(conversations: DataFrame) -> DataFrame:
    """Conversations 2k and 2k + 1 as the chosen and rejected side of pair k."""
    conv = F.col("conv_id").cast("long")
    return conversations.select(F.shiftright(conv, 1).alias("pair_id"), conv.bitwiseAND(F.lit(1)).alias("side"), "turn", "role", "text")


def preference_pairs(spark, sf_dir: str) -> DataFrame:
    """The query over all of ``conversations``."""
    return assemble(format_pairs(from_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def with_other_answers(conversations: DataFrame) -> DataFrame:
    """Every conversation as the chosen side of a pair; on the rejected side its last assistant turn has the text of the next conversation's.

    Such pairs share all turns before that one.  A conversation without a next
    one, or without an assistant, has an empty answer or two equal sides.
    """
    c = conversations.select(F.col("conv_id").cast("long").alias("pair_id"), "turn", "role", "text")
    last = c.where("role = 'assistant' and turn is not null").groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("own"))
    other = last.select((F.col("pair_id") - 1).alias("pair_id"), F.col("own.text").alias("other"))
    new = last.join(other, "pair_id", "left").select("pair_id", F.col("own.turn").alias("at"), F.coalesce("other", F.lit("")).alias("other"))  # a row a conversation
    swapped = F.when((F.col("role") == "assistant") & (F.col("turn") == F.col("at")), F.col("other")).otherwise(F.col("text"))
    rejected = c.join(new, "pair_id", "left").select("pair_id", F.lit(1).cast("long").alias("side"), "turn", "role", swapped.alias("text"))
    return c.select("pair_id", F.lit(0).cast("long").alias("side"), "turn", "role", "text").union(rejected)


def preference_prompts(spark, sf_dir: str) -> DataFrame:
    """Pairs with long common beginnings, from all of ``conversations``."""
    return assemble(format_pairs(with_other_answers(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


_PAIRED = "WITH t AS (SELECT conv_id >> 1 AS pair_id, conv_id & 1 AS side, turn, role, text FROM conversations)"
_SWAPPED = """WITH l AS (SELECT conv_id, max(ROW(turn, text)) AS own FROM conversations WHERE role = 'assistant' AND turn IS NOT NULL GROUP BY conv_id),
n AS (SELECT a.conv_id, a.own[1] AS spot, coalesce(b.own[2], '') AS other FROM l a LEFT JOIN l b ON b.conv_id = a.conv_id + 1),
t AS (SELECT conv_id AS pair_id, 0 AS side, turn, role, text FROM conversations
  UNION ALL SELECT c.conv_id, 1, turn, role, CASE WHEN role = 'assistant' AND turn = spot THEN other ELSE text END FROM conversations c LEFT JOIN n ON n.conv_id = c.conv_id)"""
_PARTS_SQL = f""",
u AS (
  SELECT pair_id, turn, role, text, max(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS c, max(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS r,
         '{OPEN}' || replace(coalesce(role, ''), '<|', '< |') || chr(10) AS header, replace(coalesce(text, ''), '<|', '< |') || '{CLOSE}' AS body
  FROM t GROUP BY ALL
), f AS (
  SELECT pair_id, min(ROW(turn, role, text)) FILTER (WHERE c <> r) AS split, max(c) + max(r) = 2 AS paired, sum(length(header) + length(body) + 1) AS chars FROM u GROUP BY pair_id
), m AS (
  SELECT u.*, f.paired AND u.pair_id IS NOT NULL AS paired, u.pair_id IS NOT NULL AND chars <= {MOST_CHARS} AS fits, c + r = 2 AND (split IS NULL OR ROW(turn, role, text) < split) AS prompt
  FROM u JOIN f ON u.pair_id IS NOT DISTINCT FROM f.pair_id
), p AS (
  SELECT *, header || body || chr(10) AS content,
         unnest(CASE WHEN pair_id IS NULL THEN ['none'] WHEN prompt THEN ['prompt'] WHEN c + r = 2 THEN ['chosen', 'rejected'] WHEN c = 1 THEN ['chosen']
                     WHEN r = 1 THEN ['rejected'] ELSE ['none'] END) AS part FROM m
), q AS (
  SELECT *, part IN ('chosen', 'rejected') AND paired AND coalesce(role = 'assistant', false) AS loss,
         sum(length(content)) OVER (PARTITION BY pair_id, part ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - length(content) AS base FROM p
), s AS (SELECT *, CASE WHEN loss THEN (CASE WHEN fits THEN base ELSE 0 END + length(header)) || '-' || (CASE WHEN fits THEN base ELSE 0 END + length(header) + length(body)) END AS span FROM q)
SELECT pair_id, part, 0 AS place, CAST(NULL AS VARCHAR) AS role, count(*) AS n_turns, string_agg(content, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS content,
       coalesce(string_agg(span, ',' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST), '') AS loss_spans, paired
FROM s WHERE fits GROUP BY pair_id, part, paired
UNION ALL SELECT pair_id, part, turn, role, 1, content, coalesce(span, ''), paired FROM s WHERE NOT fits"""
PREFERENCE_SQL = _PAIRED + _PARTS_SQL
PREFERENCE_PROMPTS_SQL = _SWAPPED + _PARTS_SQL
