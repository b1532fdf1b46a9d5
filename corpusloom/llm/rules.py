"""Quality rules: a threshold table compiled into one projection.

Every metric is a built-in expression of the text column, so the whole rule
set is one Project over the scan: no shuffle, no user function.  Work per text
is O(n log n) in its words, from sorting one array of longs.

Defined cases: a null text counts as empty (0 words, so it fails the base
rule); ties cannot arise; repeated rows are judged alike; an empty table gives
an empty result; only ``doc_id`` and ``text`` are read, so other columns do not
matter; a null ``doc_id`` is returned as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STOP_WORDS = (
    "the of and to in is that it for was on with as are be by this an at from or "
    "der die und das den von zu mit ist nicht ein eine auf für im dem des "
    "le la les de des et un une du en que est pour dans il elle au sur "
    "el los las y del se por con una su para al lo como no mi"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= metric <= high`` (either may be open)."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The table that judges what the base rule lets through.
THRESHOLDS = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("stop_word_ratio", 0.04, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("repeat_word_ratio", None, 0.3),
    Rule("upper_ratio", None, 0.4),
)

_SPACE = r"[\\x20\\x09-\\x0D]"


def _let(value: str, name: str, body: str) -> str:
    """Bind ``value`` once; a plain alias may be inlined into every lambda call."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeat_words(words: str) -> str:
    """Words inside 3-word windows that occur twice or more.

    Each window becomes one long: hash bits above, position below.  Sorting
    brings equal windows together; only those are then compared as text.
    """
    packed = "sort_array(transform(slice(ws, 1, size(ws) - 2), (w, i) -> shiftleft(xxhash64(w, ws[i + 1], ws[i + 2]), b) | cast(i as bigint)))"
    near = "filter(sequence(0, size(p) - 2), i -> shiftrightunsigned(p[i] ^ p[i + 1], b) = 0)"
    spots = "array_distinct(flatten(transform(q, i -> array(cast(p[i] & (shiftleft(1L, b) - 1) as int), cast(p[i + 1] & (shiftleft(1L, b) - 1) as int)))))"
    texts = f"sort_array(transform({spots}, i -> struct(concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) as t, i as i)))"
    same = "filter(s, (x, k) -> coalesce(x.t = get(s, k + 1).t, false) or coalesce(x.t = get(s, k - 1).t, false))"
    cover = f"size(array_distinct(flatten(transform({same}, x -> array(x.i, x.i + 1, x.i + 2)))))"
    body = _let(near, "q", f"if(size(q) = 0, 0, {_let(texts, 's', cover)})")
    inner = _let(packed, "p", body)
    return _let(words, "ws", f"if(size(ws) < 4, 0, {_let('cast(ceil(log2(size(ws))) as int)', 'b', inner)})")


def metrics(text: Column | str = "text") -> dict[str, Column]:
    """The counts that rules are made of, as expressions over a text column name."""
    t = f"coalesce(`{text}`, '')"
    words = f"array_remove(split({t}, '{_SPACE}+'), '')"
    lines = f"filter(split({t}, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return {
        "n_words": F.expr(f"cast(size({words}) as bigint)"),
        "word_chars": F.expr(f"cast(length(array_join({words}, '')) as bigint)"),
        "n_symbols": F.expr(f"cast(regexp_count({t}, '[#*$%&|<>]') as bigint)"),
        "n_lines": F.expr(f"cast(size({lines}) as bigint)"),
        "n_dup_lines": F.expr(f"cast({_let(lines, 'ls', 'size(ls) - size(array_distinct(ls))')} as bigint)"),
        "n_repeat_words": F.expr(f"cast({_repeat_words(words)} as bigint)"),
        "n_stop_words": F.expr(f"cast(size(filter({words}, w -> lower(w) in ({stops}))) as bigint)"),
        "n_upper": F.expr(f"cast(regexp_count({t}, '[A-Z]') as bigint)"),
    }


def _ratios() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "mean_word_chars": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "stop_word_ratio": F.col("n_stop_words") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_word_ratio": F.col("n_repeat_words") / words,
        "upper_ratio": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
    }


def compile_rules(rules=THRESHOLDS) -> Column:
    """One boolean expression for a threshold table."""
    ratios = _ratios()
    verdict = F.lit(True)
    for r in rules:
        if r.low is not None:
            verdict = verdict & (ratios[r.metric] >= F.lit(r.low))
        if r.high is not None:
            verdict = verdict & (ratios[r.metric] <= F.lit(r.high))
    return verdict


def judge(docs: DataFrame, rules=THRESHOLDS) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row of ``docs``."""
    counts = metrics("text")
    base = docs.select("doc_id", *[c.alias(n) for n, c in counts.items()])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return base.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def quality_rules(spark, sf_dir: str) -> DataFrame:
    """The query over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql() -> str:
    space = r"[\x20\x09-\x0D]+"
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    ratio = {
        "mean_word_chars": "word_chars / greatest(n_words, 1)",
        "symbols_per_word": "n_symbols / greatest(n_words, 1)",
        "stop_word_ratio": "n_stop_words / greatest(n_words, 1)",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
        "repeat_word_ratio": "n_repeat_words / greatest(n_words, 1)",
        "upper_ratio": "n_upper / greatest(word_chars, 1)",
    }
    checks = [f"{ratio[r.metric]} >= {r.low}" for r in THRESHOLDS if r.low is not None]
    checks += [f"{ratio[r.metric]} <= {r.high}" for r in THRESHOLDS if r.high is not None]
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '{space}'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM d
), g AS (
  SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) > 3
), g3 AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM g
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM g3) WHERE n > 1
), cov AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) v(k) GROUP BY rid
), m AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(list_filter(ws, lambda x: lower(x) IN ({stops}))) AS n_stop_words,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper
  FROM w LEFT JOIN cov USING (rid)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(checks)} AS kept
FROM b"""


QUALITY_RULES_SQL = _sql()
