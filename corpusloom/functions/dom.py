"""A tolerant HTML tree in flat lists, built in one pass that is linear in the page.

Elements are numbered in page order, so a subtree is a run of numbers
``[v, end[v])``.  Text stands beside the tree as pieces that know their element
and their block: pieces with one block number belong to one stretch of running
text.  Unclosed, misnested and cut-off markup is read as browsers read it in the
cases that change where text belongs: open paragraphs, items and cells end
where the next one starts, an inline end tag closes no block, a comment, script
or tag that never ends takes the rest of the page.
"""

from __future__ import annotations

import re
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand on lines of their own; text on two sides of their edges is never one stretch.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_SILENT = frozenset("script style xmp iframe noembed noframes".split())
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main "
    "menu nav ol p pre search section summary table ul".split()
)
#: What an opening tag ends, and what it does not look beyond.
_SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "thead": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
    "option": (("option",), ("select", "optgroup")),
    "optgroup": (("optgroup", "option"), ("select",)),
}
_WALLS = frozenset(("td", "th", "caption", "button", "object"))
_TABLE = frozenset(("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"))
_HEAD = frozenset("base link meta noscript script style template title".split())

_START = re.compile(r"<([A-Za-z][^\s/>]*+)")
_ATTR = re.compile(r"""[\s/=]*+([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")
_END = {t: re.compile(rf"</{t}(?=[\s/>]|$)", re.I) for t in _RAW}


class Tree:
    """``tag``, ``attrs``, ``parent`` and ``end`` by element; ``pieces`` of (element, block, text) in page order."""

    def __init__(self, html: str) -> None:
        self.tag: list[str] = ["#root"]
        self.attrs: list[dict[str, str]] = [{}]
        self.parent: list[int] = [-1]
        self.end: list[int] = [0]
        self.pieces: list[tuple[int, int, str]] = []
        self._block = 0
        self._stack = [0]
        self._depths: dict[str, list[int]] = {}  # open elements of each name, by their place in the stack
        self._blocks = [0]
        self._walls = [0]
        self._read(html)
        self._close_to(0)
        del self._stack, self._depths, self._blocks, self._walls

    def __len__(self) -> int:
        return len(self.tag)

    # ------------------------------------------------------------- tokens

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            start = html.find("<", at)
            if start < 0:
                self._text(html[at:])
                return
            if start > at:
                self._text(html[at:start])
            after = html[start + 1 : start + 2]
            if after.isascii() and after.isalpha():
                at = self._open(html, start)
            elif after == "/" and html[start + 2 : start + 3].isascii() and html[start + 2 : start + 3].isalpha():
                stop = html.find(">", start)
                name = _START.match("<" + html[start + 2 : size if stop < 0 else min(stop, start + 80)])
                at = size if stop < 0 else stop + 1
                if stop >= 0:
                    self._end_tag(name.group(1).lower())
            elif html.startswith("<!--", start):
                stop = html.find("-->", start + 2 if html.startswith("<!-->", start) else start + 4)
                at = size if stop < 0 else stop + 3
            elif after in ("!", "?", "/"):
                stop = html.find(">", start)
                at = size if stop < 0 else stop + 1
            else:
                self._text("<")
                at = start + 1

    def _open(self, html: str, start: int) -> int:
        m = _START.match(html, start)
        tag, at, attrs = m.group(1).lower(), m.end(), {}
        while a := _ATTR.match(html, at):
            at = a.end()
            name = a.group(1).lower()
            if name not in attrs:  # of repeated attributes the first holds
                value = next((g for g in a.groups()[1:] if g is not None), "")
                attrs[name] = unescape(value) if "&" in value else value
        stop = html.find(">", at)
        if stop < 0:
            return len(html)
        self._start_tag(tag, attrs)
        at = stop + 1
        if tag in _RAW:
            close = _END[tag].search(html, at)
            inner = html[at : close.start() if close else len(html)]
            if tag not in _SILENT:
                self._text(inner)
            self._end_tag(tag)
            stop = html.find(">", close.end()) if close else -1
            return len(html) if stop < 0 else stop + 1
        return at

    # ------------------------------------------------------------- the tree

    def _text(self, raw: str) -> None:
        self.pieces.append((self._stack[-1], self._block, unescape(raw) if "&" in raw else raw))

    def _close_to(self, depth: int) -> None:
        """Close all elements from this place in the stack on."""
        while len(self._stack) > depth:
            v = self._stack.pop()
            tag, d = self.tag[v], len(self._stack)
            self.end[v] = len(self.tag)
            if v:
                self._depths[tag].pop()
            if tag in BLOCK:
                self._block += 1
                if self._blocks[-1] == d:
                    self._blocks.pop()
            if tag in _WALLS and self._walls[-1] == d:
                self._walls.pop()

    def _last(self, *tags: str) -> int:
        return max((self._depths[t][-1] for t in tags if self._depths.get(t)), default=0)

    def _start_tag(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("html", "body") and self._depths.get(tag):
            return
        if self._depths.get("head") and (tag == "body" or tag not in _HEAD):
            self._close_to(self._last("head"))
        if tag in _ENDS_P and self._last("p") > self._walls[-1]:
            self._close_to(self._last("p"))
        if tag in _SIBLINGS:
            those, beyond = _SIBLINGS[tag]
            d = self._last(*those)
            if d > self._last(*beyond):
                self._close_to(d)
        v, d = len(self.tag), len(self._stack)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.parent.append(self._stack[-1])
        self.end.append(v + 1)
        if tag in BLOCK:
            self._block += 1
        if tag in VOID:
            if tag == "br":
                self._text(" ")
            return
        self._stack.append(v)
        self._depths.setdefault(tag, []).append(d)
        if tag in BLOCK:
            self._blocks.append(d)
        if tag in _WALLS:
            self._walls.append(d)

    def _end_tag(self, tag: str) -> None:
        if tag in ("html", "body"):  # what follows still belongs to the page
            return
        if tag == "br":
            self._text(" ")
            return
        d = self._last(tag)
        least = self._blocks[-1] if tag not in BLOCK and tag not in _RAW else 0 if tag in _TABLE else self._walls[-1]
        if d and d >= least:
            self._close_to(d)

    # ------------------------------------------------------------- text

    def children(self, v: int) -> list[int]:
        out, u = [], v + 1
        while u < self.end[v]:
            out.append(u)
            u = self.end[u]
        return out

    def text(self, keep, between: str = "\n") -> str:
        """Blocks of the pieces whose element ``keep`` says yes to: white space is one blank, empty blocks go."""
        out, now, parts = [], None, []
        for v, block, piece in self.pieces:
            if keep(v):
                if block != now:
                    if parts:
                        out.append(" ".join("".join(parts).split()))
                    now, parts = block, []
                parts.append(piece)
        if parts:
            out.append(" ".join("".join(parts).split()))
        return between.join(b for b in out if b)
