"""The tolerant tree on cut-off, misnested and very large markup."""

import time

import pytest

from corpusloom.functions.dom import Tree

CASES = [
    ("<p>a<p>b<br>c <b>d<p>e</p>", "a\nb c d\ne"),
    ("<ul><li>x<li>y<ul><li>z</ul></ul>t", "x\ny\nz\nt"),
    ("a < b &amp; c &am &amp", "a < b & c &am &"),
    ("x<!-- <p>y", "x"),
    ("<!-->y<!-- z -->w", "yw"),
    ("<table><tr><td>1<td><p>2</td><tr><td>3</table>z", "1\n2\n3\nz"),
    ("<div><span>in<div>x</span>y</div>z</div>", "in\nxy\nz"),
    ("<b><p>k</b>l</p>m", "kl\nm"),
    ("<title>T</title><body>u<script>var a='</p>'</script>v<textarea><p>w</textarea>", "T\nuv<p>w"),
    ("u<script>never closed <p>x", "u"),
    ("<p title='a>b' class=c>x</p><p", "x"),
    ("</div></p>x<?php y ?>z<!doctype html>", "xz"),
    ("<dl><dt>a<dd>b<dt>c</dl>", "a\nb\nc"),
    ("  a \t\n b&nbsp;", "a b"),
    ("", ""),
]


@pytest.mark.parametrize("html,text", CASES)
def test_text(html, text):
    assert Tree(html).text(lambda v: True) == text


def test_tree_is_consistent():
    t = Tree("<html><head><title>x</title><body class='a' class='b'><p>1<b>2</p><div><i>3</div></body>4")
    assert t.attrs[t.tag.index("body")] == {"class": "a"}
    for v in range(1, len(t)):
        assert t.parent[v] < v < t.end[v] <= t.end[t.parent[v]]
    assert sum(len(t.children(v)) for v in range(len(t))) == len(t) - 1


@pytest.mark.parametrize("part", ["<div>", '<a href="', "<!--", "<a '", "</span>", "<b><p>x</b>", "<td><p>", "<", "<script>", "<i a='b' c>", "<p>x&amp;y"])
def test_linear(part):
    """Twice as much takes about twice as long, not four times."""
    took = []
    for n in (50_000, 200_000):
        began = time.process_time()
        Tree(part * n)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5
