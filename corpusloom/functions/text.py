"""Text functions, Column to Column, all built in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.tables import INDEX_STOP_WORDS, PDF_DATE_KEYS, PDF_URLS, PLAN_STOP_WORDS, REPORT_STOP_WORDS


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Index words of a text: ASCII, longer than two characters, no stop words."""
    words = F.split(F.lower(_c(text)), "[^a-z0-9_-]+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(INDEX_STOP_WORDS))


# Endings that a stem loses, longest first.
ENDINGS = ["tion", "ment", "ness", "able", "ible", "ing", "ed", "s"]


def stem(word: Column | str) -> Column:
    """A light stem: plural and suffix endings off, a doubled last letter once.

    Plain string functions; per word they are several times faster than patterns.
    """
    cut = lambda w, n: F.substr(w, F.lit(1), F.length(w) - n)
    bind = lambda w, f: F.transform(F.array(w), f)[0]

    def suffix(w: Column) -> Column:
        out = F.when(F.lit(False), w)
        for e in ENDINGS:
            out = out.when(F.endswith(w, F.lit(e)), cut(w, len(e)))
        return out.otherwise(w)

    def single(w: Column) -> Column:
        last = F.right(w, F.lit(1))
        twice = (F.length(w) > 1) & (last == F.substr(w, F.length(w) - 1, F.lit(1)))
        return F.when(twice, F.concat(F.rtrim(w, last), last)).otherwise(w)

    y = lambda w: F.when(F.endswith(w, F.lit("ies")), F.concat(cut(w, 3), F.lit("y"))).otherwise(w)
    f = lambda w: F.when(F.endswith(w, F.lit("ves")), F.concat(cut(w, 3), F.lit("f"))).otherwise(w)
    return bind(bind(bind(bind(_c(word), y), f), suffix), single)


def terms(text: Column | str) -> Column:
    """Tokens, each followed by its stem where that differs and is long enough."""

    def both(w: Column) -> Column:
        # the inner transform binds the stem, so that it is computed once
        return F.flatten(F.transform(F.array(stem(w)), lambda s: F.when((s != w) & (F.length(s) > 2), F.array(w, s)).otherwise(F.array(w))))

    return F.flatten(F.transform(tokens(text), both))


def trigrams(text: Column | str) -> Column:
    """Distinct character trigrams of the letters and digits, across words."""
    bare = F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]", "")
    grams = F.transform(F.array(bare), lambda b: F.transform(F.sequence(F.lit(1), F.length(b) - 2), lambda i: F.substr(b, i, F.lit(3))))
    return F.when(F.length(bare) < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(grams[0]))


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two sets; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least <= 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def fingerprint(text: Column | str) -> Column:
    """Whole text if short, else its first 30, middle 20 and last 20 words, cleaned."""
    clean = F.split(F.regexp_replace(F.lower(_c(text)), r"[^a-z0-9\s]", ""), r"\s+")
    words = F.filter(clean, lambda w: w != "")

    def sample(ws: Column) -> Column:
        n = F.size(ws)
        mid = F.floor((n - 20) / 2).cast("int")
        picked = F.concat(F.slice(ws, 1, 30), F.slice(ws, mid + 1, F.lit(20)), F.slice(ws, F.greatest(n - 19, F.lit(1)), F.lit(20)))
        return F.array_join(F.when(n <= 70, ws).otherwise(picked), " ")

    return F.transform(F.array(words), sample)[0]


def count_words(text: Column | str) -> Column:
    return F.size(F.filter(F.split(_c(text), r"\s+"), lambda w: w != ""))


def occurrences(text: Column, word: Column | str) -> Column:
    """Non-overlapping places of a phrase."""
    w = F.lit(word) if isinstance(word, str) else word
    return F.try_divide(F.length(text) - F.length(F.replace(text, w, F.lit(""))), F.length(w)).cast("int")


def keywords(topic: Column | str, stops: list[str] = PLAN_STOP_WORDS, most: int = 8) -> Column:
    words = F.split(F.regexp_replace(F.lower(_c(topic)), r"[^a-z0-9\s]", ""), r"\s+")
    return F.slice(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(stops)), 1, most)


def report_keywords(topic: Column | str) -> Column:
    return keywords(topic, REPORT_STOP_WORDS)


def trim(text: Column | str) -> Column:
    """All white space off both ends."""
    return F.regexp_replace(_c(text), r"^\s+|\s+$", "")


# Entities in the order in which they are read.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&nbsp;", " ")]


def strip_html(html: Column | str) -> Column:
    """Scripts and styles out, tags to blanks, six entities, white space collapsed."""
    t = F.regexp_replace(_c(html), r"(?is)<script.*?</script>", "")
    t = F.regexp_replace(t, r"(?is)<style.*?</style>", "")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for entity, plain in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def strip_tags(html: Column | str, fold: bool = True) -> Column:
    """Tags to nothing and six entities; white space is collapsed and taken off both ends, or left as it is."""
    t = F.regexp_replace(_c(html), r"<[^>]+>", "")
    for entity, plain in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(plain))
    return trim(F.regexp_replace(t, r"\s+", " ")) if fold else t


# ------------------------------------------------------------- PDF


def _joined_lines(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"(\w)-\n(\w)", "$1$2")


def _fewer_blanks(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")


def clean_pdf_text(text: Column | str) -> Column:
    """Text of a PDF file: page marks out, words joined over line ends, blanks folded, lone page numbers out."""
    t = F.regexp_replace(F.regexp_replace(_c(text), r"\r\n?", "\n"), r"(?m)^--\s*\d+\s*of\s*\d+\s*--\s*$", "")
    return trim(F.regexp_replace(_fewer_blanks(_joined_lines(t)), r"(?m)^\s*\d{1,4}\s*$", ""))


def clean_web_pdf_text(text: Column | str) -> Column:
    """Text of a fetched PDF: the same without page marks; number lines go wherever they stand, lines are trimmed."""
    t = F.regexp_replace(_fewer_blanks(_joined_lines(_c(text))), r"\n\s*\d+\s*\n", "\n")
    return trim(F.array_join(F.transform(F.split(t, "\n"), trim), "\n"))


def pdf_title(text: Column | str) -> Column:
    """The first line of more than five characters, at most 200 of them; empty if there is none."""
    line = F.get(F.filter(F.split(_c(text), "\n"), lambda x: F.length(trim(x)) > 5), F.lit(0))
    return F.coalesce(F.left(trim(line), F.lit(200)), F.lit(""))


def pdf_date(raw: Column | str) -> Column:
    """``D:YYYYMMDD...`` or any date that ``iso_date`` reads."""
    day = F.regexp_extract(_c(raw), r"D:(\d{8})", 1)
    return F.coalesce(F.when(day != "", F.regexp_replace(day, r"(\d{4})(\d{2})(\d{2})", "$1-$2-$3")), iso_date(raw))


def pdf_info_date(info: Column) -> Column:
    """Of a PDF's properties (a map): the first of four keys that holds a date."""
    found = F.transform(F.array(*[F.lit(k) for k in PDF_DATE_KEYS]), lambda k: pdf_date(F.nullif(F.element_at(info, k), F.lit(""))))
    return F.get(F.filter(found, lambda d: d.isNotNull()), F.lit(0))


def pdf_description(title: Column, author: Column, pages: Column, text: Column, most: int = 250) -> Column:
    """Title, author and number of pages where there are any, then the text, cut at ``most`` characters."""
    some = lambda c, x: F.when(F.coalesce(c, F.lit("")) != "", x)
    meta = F.concat_ws(" ", some(title, title), some(author, F.concat(F.lit("by "), author)), F.when(pages > 0, F.concat(F.lit("("), pages, F.lit(" pages)"))))
    meta = F.when(meta == "", meta).otherwise(F.concat(meta, F.lit(". ")))
    return F.left(F.concat(meta, F.coalesce(text, F.lit(""))), F.lit(most))


def pdf_links(text: Column | str, url: Column, most: int = 20) -> Column:
    """URLs in a text on other hosts than ``url``'s, each once, as (text, href); text is host and path."""
    found = F.regexp_extract_all(_c(text), F.lit(r"(?i)https?://[^\s)<>\"']+"), F.lit(0))
    clean = F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)]+$", "")))
    name = lambda u: F.lower(F.regexp_extract(u, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    own = F.filter(clean, lambda u: (name(u) != "") & (name(u) != F.coalesce(name(url), F.lit(""))))
    path = lambda u: F.coalesce(F.nullif(F.regexp_extract(u, r"^[^/]*//[^/?#]*(/[^?#]*)", 1), F.lit("")), F.lit("/"))
    return F.slice(F.transform(own, lambda u: F.struct(F.concat(name(u), F.left(path(u), F.lit(60))).alias("text"), u.alias("href"))), 1, most)


def is_pdf_url(url: Column | str) -> Column:
    hit = F.lit(False)
    for pattern in PDF_URLS:
        hit = hit | _c(url).rlike(pattern)
    return hit


def is_pdf_type(content_type: Column | str) -> Column:
    return F.coalesce(F.lower(_c(content_type)).rlike("application/(x-)?pdf"), F.lit(False))


def is_binary_type(content_type: Column | str) -> Column:
    return F.coalesce(F.lower(_c(content_type)).rlike("application/(x-)?pdf|application/octet-stream"), F.lit(False))


# ------------------------------------------------------------- queries and headings


def host(url: Column | str) -> Column:
    """Lower-case host without one leading ``www.``; empty if there is none."""
    h = F.lower(F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(h, r"^www\.", "")


def trim_query(query: Column | str) -> Column:
    """At most 80 characters, cut at a blank where there is one beyond the 20th."""
    q = F.trim(_c(query))
    head = F.left(q, F.lit(80))
    at = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when(F.contains(head, F.lit(" ")) & (at > 20), F.substr(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(q) <= 80, q).otherwise(cut)


def mutate_query(query: Column | str, attempt: int) -> Column:
    """The ``attempt``-th rephrasing of a query, null if it changes nothing."""
    q = _c(query)
    forms = [
        F.concat(F.lit('"'), q, F.lit('"')),
        F.concat(q, F.lit(" explained")),
        F.concat(q, F.lit(" research 2024-2026+")),
        F.array_join(F.slice(F.split(q, " "), 1, 4), " "),
        F.concat(q, F.lit(" guide overview")),
        F.trim(F.regexp_replace(q, r"(?i)\b(how|what|why|when)\b", "")),
    ]
    new = forms[attempt]
    return F.when((new != q) & (F.length(new) > 3), new)


def short_topic(topic: Column | str) -> Column:
    """A topic short enough for a query.

    What stands before a colon or dash in its first 60 %, without commas, stop
    words and single characters: words while there are at most six and the text
    so far and the next word have at most 58 characters; five plain words if
    that leaves fewer than five characters.
    """
    t = _c(topic)
    colon, dash = F.instr(t, ":") - 1, F.instr(t, " — ") - 1
    at = F.when(colon > 3, colon).otherwise(dash)
    core = F.when((at > 3) & (at < 0.6 * F.length(t)), F.substr(t, F.lit(1), at)).otherwise(t)
    words = F.filter(F.split(F.regexp_replace(core, "[,;()]", " "), r"\s+"), lambda w: (F.length(w) > 1) & ~F.lower(w).isin(PLAN_STOP_WORDS))

    def fits(ws: Column, i: Column) -> Column:  # the first i words joined, and the next one
        return F.length(F.array_join(F.slice(ws, F.lit(1), i), " ")) + F.length(F.get(ws, i)) <= 58

    def head(ws: Column) -> Column:
        at = F.filter(F.transform(ws, lambda _, i: F.when(~fits(ws, i), i)), lambda i: i.isNotNull())
        return F.array_join(F.slice(ws, F.lit(1), F.coalesce(F.get(at, F.lit(0)), F.size(ws))), " ")

    short = F.transform(F.array(F.slice(words, 1, 6)), head)[0]
    return F.when(F.length(short) < 5, F.array_join(F.slice(F.split(t, r"\s+"), 1, 5), " ")).otherwise(short)


# What a section's first line looks like; group 1 is the heading; its depth.
HEADINGS = [
    (r"^#\s+(.+)$", 1), (r"^##\s+(.+)$", 2), (r"^#{3,6}\s+(.+)$", 3), (r"^([A-Z][A-Z\s]{5,60})$", 2), (r"^([0-9]+\.[0-9.]*\s+.{5,80})$", 2),
    (r"(?i)^(Chapter\s+[0-9]+[.:]\s*.+)$", 1), (r"(?i)^(Section\s+[0-9]+[.:]\s*.+)$", 2),
    (r"(?i)^(Abstract|Introduction|Conclusion|References|Methods|Results|Discussion)\b", 1),
]


def heading(text: Column | str) -> Column:
    """Heading of a text's first line as (heading, depth), null if it is none."""
    line = trim(F.split(_c(text), "\n")[0])
    found = [
        F.when(line.rlike(p), F.struct(F.left(trim(F.regexp_extract(line, p, 1)), F.lit(120)).alias("heading"), F.lit(d).alias("depth")))
        for p, d in HEADINGS
    ]
    return F.coalesce(*found)


def parse_lines(text: Column | str, most: int = 6) -> Column:
    """Distinct lines of an answer without numbers or bullets, 6 to 159 characters."""
    lines = F.transform(F.split(_c(text), "\n"), lambda x: trim(F.regexp_replace(trim(x), r"^(?:[0-9]+[.)]|[-*•])\s*", "")))
    return F.slice(F.array_distinct(F.filter(lines, lambda x: (F.length(x) > 5) & (F.length(x) < 160))), 1, most)


# Spellings of dates and times that are read, besides ISO ones.
DATE_FORMS = [
    "yyyy/M/d", "M/d/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy",
    "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z", "MMM d, yyyy HH:mm:ss", "MMMM d, yyyy h:mm a",
]


def iso_date(raw: Column | str) -> Column:
    """A date, or the UTC day of a time with an offset, as YYYY-MM-DD, else null."""

    def read(c: Column) -> Column:
        iso = c.rlike(r"^\d{4}(-\d{2}(-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?)?)?$")
        full = F.regexp_replace(F.when(F.length(c) == 4, F.concat(c, F.lit("-01-01"))).when(F.length(c) == 7, F.concat(c, F.lit("-01"))).otherwise(c), r"([+-]\d{2})(\d{2})$", "$1:$2")
        full = F.regexp_replace(full, r"([T ]\d{2}:\d{2})\s*(Z|[+-])", "$1:00$2")  # seconds before an offset
        times = [F.when(iso, F.try_to_timestamp(full)), *[F.try_to_timestamp(c, F.lit(p)) for p in DATE_FORMS]]
        return F.date_format(F.to_utc_timestamp(F.coalesce(*times), F.current_timezone()), "yyyy-MM-dd")

    clean = F.regexp_replace(trim(raw), r"^(?i)(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+", "")
    return F.transform(F.array(clean), read)[0]  # bound once, for it is used many times


def escape_markdown(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"([\[\]])", r"\\$1")


def preview(text: Column | str, most: int) -> Column:
    return F.trim(F.regexp_replace(F.left(_c(text), F.lit(most)), r"\n+", " "))


def with_clock(text: Column | str, now: Column) -> Column:
    """A message prefixed with a given date and time."""
    return F.concat(F.lit("Current date and time: "), F.date_format(now, "yyyy-MM-dd HH:mm"), F.lit("\n\n"), _c(text))
