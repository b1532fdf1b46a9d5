"""Main text of web pages by composite text density.

A page becomes a flat tree (``corpusloom.functions.dom``).  Elements that are
never part of an article are taken out first: scripts, styles, menus, footers,
sidebars, forms, controls, hidden elements, page headers, and what its class, id
or role names an advert, a notice, a menu, a comment and the like (unless it
holds the article).  For every element that is left the *density* is its
characters per tag, adjusted by links: with ``C`` characters, ``T`` tags, ``LC``
and ``LT`` of them in links, and ``r`` the share of link characters in the page,

    density = C / T * ln(C / LC * T / LT) / ln(ln(C / (C - LC) * LC + r * C + e^e))

(divisors of zero count as one; ``e^e`` keeps the base at ``e`` or more on pages
without links).  The *density sum* of an element adds the densities of its
children and of its own text.  The element of the greatest sum is the core; it
is looked for inside ``article`` elements if the page has any, else inside
``main``, else everywhere.  A core in an article stands for that article.  Else
the least density on the path from the top to the core is the threshold: parts
beside the path that reach it belong to the text as well, and so does all that
is in the lowest element that holds the core and them; of the top itself only
parts that reach the threshold and headings are taken.  A first-level heading
before the text is put in front.

Everything is linear in the page; a page is one row, so nothing is shuffled.

Defined cases: a null or empty page has an empty text of zero characters, and so
has a page without visible text; a null ``url`` or ``page_id`` stays null;
repeated rows give repeated rows; an empty table gives an empty result; other
columns are not read, whatever their names; markup that is cut off or misnested
is read as browsers read it; pages of any length are read whole; equal sums go
to the first element of the page.  White space is what ``str.split`` splits at,
a line break element is a blank.
"""

from __future__ import annotations

import re
from math import e, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.dom import Tree

#: Elements that hold no article text.
NEVER = frozenset(
    "head title script style template noscript noframes iframe object embed canvas svg audio video map nav aside footer menu dialog search button input select "
    "textarea option datalist legend label output progress meter".split()
)
#: Roles of such elements.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog status menu menubar toolbar tablist".split())
#: Words in a class or id that name such elements.
WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer masthead toolbar pagination pager toc skip cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay lightbox tooltip disclaimer copyright banner ad ads adbox adsense adslot advert adverts advertisement advertisements "
    "advertising sponsor sponsors sponsored promo promos promotion promoted newsletter subscribe subscription signup login register share sharing shares social "
    "related recommended recommendations comment comments commentlist commentform reply replies respond responses disqus discussion outbrain taboola".split()
)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_CORES = frozenset(("article", "main"))


def _named(attrs: dict[str, str], words: frozenset[str]) -> bool:
    name = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    return any(w.lower() in words for w in _WORD.findall(name))


def _hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(_HIDDEN.search(attrs.get("style", "")))


_HEADER = frozenset(("header",))


def dropped(t: Tree) -> list[bool]:
    """For every element, whether it or what it stands in is no part of an article."""
    n = len(t)
    hard, soft = [False] * n, [False] * n
    for v in range(1, n):
        tag, a = t.tag[v], t.attrs[v]
        hard[v] = tag in NEVER or bool(a) and _hidden(a)
        if tag in ("form", "header"):
            soft[v] = True
        elif a and tag not in ("html", "body"):
            soft[v] = a.get("role", "") in ROLES or _named(a, WORDS) or _named(a, _HEADER)
    holds = [False] * n  # an article or main element of its own
    heading, paragraphs = [False] * n, [0] * n
    for v in range(n - 1, 0, -1):
        tag, p = t.tag[v], t.parent[v]
        if not hard[v] and p >= 0:
            holds[p] |= holds[v] or tag in _CORES and not soft[v]
            heading[p] |= heading[v] or tag in _HEADINGS
            paragraphs[p] += paragraphs[v] + (tag == "p")
    gone, within = [False] * n, [False] * n
    for v in range(1, n):
        p, tag = t.parent[v], t.tag[v]
        drop = hard[v]
        if soft[v] and not holds[v]:
            own = tag == "header" or not _named(t.attrs[v], WORDS) and t.attrs[v].get("role", "") not in ROLES and tag != "form"
            if own:  # the header of an article keeps its heading
                drop = drop or not (within[p] and heading[v])
            elif tag == "form" and not holds[0]:  # some pages stand in one form altogether
                drop = drop or not (heading[v] or paragraphs[v] > 2)
            else:
                drop = True
        gone[v] = gone[p] or drop
        within[v] = within[p] or tag in _CORES and not gone[v]
    return gone


def _density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    if not chars:
        return 0.0
    spread = chars / max(link_chars, 1) * tags / max(link_tags, 1)
    base = log(chars / max(chars - link_chars, 1) * link_chars + share * chars + e**e)
    return chars / tags * log(max(spread, 1.0)) / log(base)


class Densities:
    """Density, density sum and greatest density of a subtree, for every element that is not dropped."""

    def __init__(self, t: Tree, gone: list[bool]) -> None:
        n = len(t)
        linked = [False] * n
        for v in range(1, n):
            linked[v] = t.tag[v] == "a" or linked[t.parent[v]]
        own = [0] * n
        for v, _, piece in t.pieces:
            if not gone[v]:
                own[v] += len(piece.strip())
        chars, links = own[:], [c if x else 0 for c, x in zip(own, linked, strict=True)]
        tags, link_tags = [1] * n, [int(tag == "a") for tag in t.tag]
        for v in range(n - 1, 0, -1):
            if not gone[v]:
                p = t.parent[v]
                chars[p] += chars[v]
                links[p] += links[v]
                tags[p] += tags[v]
                link_tags[p] += link_tags[v]
        share = links[0] / max(chars[0], 1)
        self.chars = chars
        self.density = [0.0 if gone[v] else _density(chars[v], tags[v], links[v], link_tags[v], share) for v in range(n)]
        self.sum = [0.0 if gone[v] else _density(own[v], 1, own[v] if linked[v] else 0, int(linked[v]), share) for v in range(n)]
        self.most = self.density[:]
        for v in range(n - 1, 0, -1):
            p = t.parent[v]
            self.sum[p] += self.density[v]
            self.most[p] = max(self.most[p], self.most[v])


def _chosen(t: Tree, gone: list[bool], d: Densities) -> list[int]:
    """The elements whose subtrees hold the text, in page order."""
    n = len(t)
    seen = [v for v in range(n) if not gone[v] and d.chars[v]]
    if not seen:
        return []
    article = [-1] * n  # the outermost article or, on pages without one, main element
    core = next((tag for tag in ("article", "main") if any(t.tag[v] == tag for v in seen)), None)
    for v in seen:
        up = article[t.parent[v]] if v else -1
        article[v] = up if up >= 0 else v if t.tag[v] == core else -1
    places = [v for v in seen if core is None or article[v] >= 0]
    best = max(places, key=lambda v: (d.sum[v], -v))
    if core == "article":
        return [article[best]]
    top = article[best] if core else next((v for v in seen if t.tag[v] == "body"), 0)
    path = [best]
    while path[-1] > top:
        path.append(t.parent[path[-1]])
    least = min(d.density[v] for v in path)
    at = 0
    for k in range(1, len(path)):
        if any(u != path[k - 1] and not gone[u] and d.chars[u] and d.most[u] >= least for u in t.children(path[k])):
            at = k
    if at == 0 or path[at] != top:
        return [path[at]]
    within = [u for u in t.children(top) if not gone[u] and d.chars[u]]
    return [u for u in within if u == path[at - 1] or d.most[u] >= least or t.tag[u] in _HEADINGS]


def main_text(html: str) -> str:
    """The article of a page, a line a block."""
    t = Tree(html)
    gone = dropped(t)
    parts = _chosen(t, gone, Densities(t, gone))
    if not parts:
        return ""
    inside = [False] * len(t)
    for v in parts:
        inside[v : t.end[v]] = [True] * (t.end[v] - v)
    heads = [v for v in range(len(t)) if t.tag[v] == "h1" and not gone[v]]
    if heads and not any(inside[v] for v in heads) and heads[-1] < parts[0]:
        v = heads[-1]
        inside[v : t.end[v]] = [True] * (t.end[v] - v)
    return t.text(lambda v: inside[v] and not gone[v])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages`` (page_id, url, html)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [main_text(h.as_py() or "") for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return narrow.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def html_extraction(spark, sf_dir: str) -> DataFrame:
    """The query over all of ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: The pages of the shared tables have one ``article`` of paragraphs and a heading, which patterns can cut out.
HTML_EXTRACTION_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS x FROM pages),
l AS (SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(x, '</?(?:p|h1)>'), lambda b:
  trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(b, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)),
    '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda b: b <> '') AS blocks FROM a)
SELECT page_id, url, coalesce(array_to_string(blocks, chr(10)), '') AS text, CAST(length(coalesce(array_to_string(blocks, chr(10)), '')) AS BIGINT) AS n_chars FROM l
"""
