"""The main text of a page by scores carried up its tree.

Blocks of running text earn points for their length and commas.  A block gives
its points to its parent in full, to its grandparent by half and to further
ancestors by less and less; kinds of elements and words in their class or id add
or take some, and what stands in links lowers a score by its share.  The element
of the best score is the core; its siblings come along if they score well beside
it or read like a paragraph.  One pass up and one down, linear in the page.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from corpusloom.functions.dom import BLOCK, Tree

#: Characters from which a block earns points.
LEAST_BLOCK = 25
#: Levels above a block that earn from it.
LEVELS = 5
HINT = 25
#: What elements score by their kind.
KINDS = {"div": 5, "section": 5, "pre": 3, "td": 3, "blockquote": 3, "form": -3, "ol": -3, "ul": -3, "dl": -3, "li": -3, "address": -3, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5, "th": -5}
_GOOD = re.compile(r"\b(?:article|body|blog|content|entry|main|page|post|story|text)\b|article|content|story", re.I)
_BAD = re.compile(r"\b(?:ads?|banner|combx|comments?|community|contact|extra|foot(?:er)?|gdpr|legend|links|login|masthead|media|menu|meta|nav|outbrain|promo|related|rss|scroll|share|shoutbox|side(?:bar)?|skyscraper|sponsor|shopping|tags|tool|widget)\b", re.I)
#: Share of the best score from which a sibling comes along, and the least such score.
SIBLING, LEAST_SIBLING = 0.2, 10.0
_SENTENCE = re.compile(r"[.!?。！？](?:\s|$)")


class Scores:
    def __init__(self, t: Tree, gone: list[bool]) -> None:
        n = len(t)
        linked, own, commas = [False] * n, [0] * n, [0] * n
        for v in range(1, n):
            linked[v] = t.tag[v] == "a" or linked[t.parent[v]]
        chars, links = [0] * n, [0] * n
        blocks = [False] * n  # holds a block-level element
        for v, _, piece in t.pieces:
            if not gone[v]:
                size = len(" ".join(piece.split()))
                chars[v] += size
                own[v] += size
                commas[v] += sum(piece.count(c) for c in ",،、，；")
                links[v] += size if linked[v] else 0
        for v in range(n - 1, 0, -1):
            p = t.parent[v]
            if not gone[v]:
                chars[p] += chars[v]
                links[p] += links[v]
                commas[p] += commas[v]
                blocks[p] = blocks[p] or blocks[v] or t.tag[v] in BLOCK
        self.chars, self.links, self.score = chars, links, [0.0] * n
        self.candidate = [False] * n
        for v in range(1, n):
            if gone[v] or t.tag[v] not in BLOCK or chars[v] < LEAST_BLOCK or blocks[v] and own[v] < LEAST_BLOCK:
                continue
            if blocks[v]:  # text beside blocks: only its own counts, and for the element itself
                points, at, share = 1 + min(own[v] // 100, 3), v, 1.0
            else:
                points, at, share = 1 + commas[v] + min(chars[v] // 100, 3), t.parent[v], 1.0
            for level in range(LEVELS):
                if at < 0:
                    break
                self.candidate[at] = True
                self.score[at] += points * share
                share = 0.5 if level == 0 else 1 / (3 * (level + 1))
                at = t.parent[at]
        for v in range(n):
            if self.candidate[v]:
                name = f"{t.attrs[v].get('class', '')} {t.attrs[v].get('id', '')}"
                hint = HINT * (bool(_GOOD.search(name)) - bool(_BAD.search(name))) if name != " " else 0
                self.score[v] = (self.score[v] + KINDS.get(t.tag[v], 0) + hint) * (1 - self.density(v))

    def density(self, v: int) -> float:
        return self.links[v] / self.chars[v] if self.chars[v] else 0.0


def chosen(t: Tree, gone: list[bool]) -> list[int]:
    """The core and the siblings that come along, in page order."""
    s = Scores(t, gone)
    found = [v for v in range(len(t)) if s.candidate[v] and s.score[v] > 0]
    if not found:
        return []
    core = max(found, key=lambda v: (s.score[v], -v))
    if core == 0 or t.tag[core] == "body":
        return [core]
    least = max(LEAST_SIBLING, s.score[core] * SIBLING)
    name, out = t.attrs[core].get("class", ""), []
    for v in t.children(t.parent[core]):
        if gone[v] or not s.chars[v]:
            continue
        bonus = SIBLING * s.score[core] if name and t.attrs[v].get("class") == name else 0.0
        takes = v == core or s.candidate[v] and s.score[v] + bonus >= least
        if not takes and t.tag[v] == "p":
            takes = s.density(v) < 0.25 if s.chars[v] > 80 else s.links[v] == 0 and bool(_SENTENCE.search(t.text(lambda u, v=v: v <= u < t.end[v])))
        if takes:
            out.append(v)
    return out


def main_text(html: str, drops: Callable[[str, dict[str, str]], bool]) -> str:
    """Blocks of the main text, a line each; ``drops`` says which elements are boilerplate."""
    t = Tree(html)
    gone = [False] * len(t)
    for v in range(1, len(t)):
        gone[v] = gone[t.parent[v]] or t.tag[v] in ("head", "title") or drops(t.tag[v], t.attrs[v])
    inside = [False] * len(t)
    for v in chosen(t, gone):
        inside[v : t.end[v]] = [True] * (t.end[v] - v)
    return t.text(lambda v: inside[v] and not gone[v])
