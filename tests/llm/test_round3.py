"""Density extraction, conversation tries and exact k-means against plain loops and hand-made cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import density, lloyd, prefix_trie

# ------------------------------------------------------------- main text

LONG = "Words of the story go on and on, with a comma, and they say something that is worth reading. " * 4
NOTE = "<div class='cookie-notice'>We value your privacy. Accept all cookies or read our long policy on how data is used here.</div>"
MENU = "<ul class='menu'>" + "".join(f"<li><a href='/{k}'>Section {k}</a></li>" for k in range(9)) + "</ul>"
TALK = f"<section id='comments'><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></section>"


def paragraphs(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


A, B, C, D = (f"{k} {LONG}".strip() for k in "ABCD")
LAYOUTS = [
    (f"<body><nav>{MENU}</nav><article><h1>T</h1>{paragraphs(A, B)}</article>{TALK}<footer>f</footer>", ["T", A, B]),
    (f"<body>{NOTE}{MENU}<article>x</article><div class='ad'>{LONG}</div>", ["x"]),
    (f"<body><div id=wrap>{MENU}<div class=left><a href=x>one</a> <a href=y>two</a></div><div class=mid><h1>T</h1>{paragraphs(A, B, C)}</div><div>Hot: x</div></div>", ["T", A, B, C]),
    (f"<body><div><div><h2>S</h2>{paragraphs(A, B)}</div><div>{paragraphs(C, 'Yes.', D)}</div></div><p><a href=x>about us</a></p>", ["S", A, B, C, "Yes.", D]),
    (f"<body><h1>T</h1>{paragraphs(A, 'Short.', B)}", ["T", A, "Short.", B]),
    (f"<body><div class='page-title'><h1>T</h1></div>{MENU}<div class='content'>{paragraphs(A, B)}</div><div>c 2020 Us</div>", ["T", A, B]),
    (f"<body><main><h1>T</h1><div>{paragraphs(A, B)}</div><form>{paragraphs('Sign up now for news')}<input></form></main>", ["T", A, B]),
    (f"<body><article><header><h1>T</h1></header>{paragraphs(A)}<aside>{LONG}</aside><footer>tags</footer><div class='share-buttons'>Share</div></article>", ["T", A]),
    (f"<body class='has-sidebar'><form id=aspnet><h1>T</h1>{paragraphs(A, B)}<input></form>", ["T", A, B]),
    (f"<body><div>{A}<br>{B}</div><div style='display:none'>{C}</div><div hidden>{D}</div>", [f"{A} {B}"]),
    (f"<body><article>{paragraphs(A)}<ul><li>i</li><li>j</li></ul><table><tr><td>k</td></tr></table><pre>l\n m</pre></article>", [A, "i", "j", "k", "l m"]),
    (f"<article>{paragraphs(A)}<article class='comment'>{LONG}</article>", [A]),
    ("<article><p>a&nbsp;&lt;b&gt; &eacute;&#233;&#xe9; &am</p>", ["a <b> ééé &am"]),
    ("<article><a href=x>only a link</a></article>", ["only a link"]),
    ("<body><script>x</script><style>y</style>", []),
    ("plain words", ["plain words"]),
    ("", []),
]


@pytest.mark.parametrize("html,blocks", LAYOUTS)
def test_layouts(html, blocks):
    assert density.main_text(html) == "\n".join(blocks)


def test_density_sums_follow_the_formula():
    from math import e, log

    from corpusloom.functions.dom import Tree

    t = Tree("<body><div><p>abcdefghij</p><p>kl<a href=x>mnop</a></p></div>")
    d = density.Densities(t, [False] * len(t))
    share = 4 / 16
    want = lambda c, n, lc, lt: c / n * log(c / max(lc, 1) * n / max(lt, 1)) / log(log(c / max(c - lc, 1) * lc + share * c + e**e))
    by = dict(zip(t.tag, d.density, strict=True))
    assert by["div"] == pytest.approx(want(16, 4, 4, 1)) and d.density[3] == pytest.approx(want(10, 1, 0, 0)) and by["a"] == 0
    assert d.sum[2] == pytest.approx(d.density[3] + d.density[4]) and d.sum[4] == pytest.approx(want(2, 1, 0, 0))


def test_pages_of_all_kinds(spark):
    rows = [(1, "u", "<article>x</article>"), (1, "u", "<article>x</article>"), (2, None, None), (None, "v", ""), (3, "w", "<article><p>" + "word " * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("own"), "n_chars": F.lit("own")})
    got = density.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted(((r.page_id, r.url, r.text[:5], r.n_chars) for r in got.collect()), key=repr)
    assert found == sorted([(1, "u", "x", 1), (1, "u", "x", 1), (2, None, "", 0), (None, "v", "", 0), (3, "w", "word ", 1_499_999)], key=repr)
    assert density.extract(pages.limit(0)).count() == 0


# ------------------------------------------------------------- tries


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    for r in convs.values():
        r.sort()
    sql = lambda c: c - int(np.sign(c)) * (abs(c) % 5)
    paths = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = [r[2:] for r in convs.get(sql(c), [])[:h] + own[h:]]
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    out = []
    for node, of in members.items():
        sub = [n for n in members if n[: len(node)] == node]
        kids = [n for n in sub if len(n) == len(node) + 1]
        saved = sum((len(members[n]) - 1) * (len(n[-1][1].encode()) if n else 0) for n in sub)
        leaves = sum(1 for n in sub if not any(m[: len(n)] == n and len(m) == len(n) + 1 for m in sub))
        ends = ",".join(map(str, sorted(c for c in of if len(paths[c]) == len(node))))
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, n=60):
    r = random.Random(seed)
    rows = []
    for c in range(-7, n):
        if r.random() < 0.15:
            continue
        same = r.random() < 0.4
        for turn in range(r.choice([1, 2, 3, 9, 14])):
            text = "hot" if same else r.choice(["a", "b", "é", None])
            rows.append((c, turn if r.random() < 0.9 else None, r.choice(["user", None]) if not same else "user", text))
    rows += [(None, 1, "user", "x"), (3, 2, "user", "a"), (3, 2, "user", "a")]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("long", [100_000, 12, 0])
def test_trie_equals_plain_loops(spark, seed, long, monkeypatch):
    rows = conversations(seed)
    ties = defaultdict(set)  # keep equal turns of one role apart: their order is by digest
    rows = [x for x in rows if x[0] is None or not ((x[1], x[2] or "") in ties[x[0]] or ties[x[0]].add((x[1], x[2] or "")))]
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "CHAIN", 4)
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit("own"), "fam": F.lit("own"), "k1": F.lit(1)})
    assert sorted(map(tuple, prefix_trie.trie(df, long).collect()), key=repr) == plain_trie(rows)


@pytest.mark.parametrize("long", [100_000, 3])
def test_wide_nodes_copies_and_repeats(spark, long, monkeypatch):
    rows = [(c, t, "user", "hot" if t == 0 or c % 3 else f"own {c}") for c in range(0, 400) for t in range(2)]
    rows += [(400, 0, "user", None)] * 3
    monkeypatch.setattr(prefix_trie, "HOT", 1 / 10)
    assert sorted(map(tuple, prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), long).collect()), key=repr) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0


# ------------------------------------------------------------- k-means


def plain_lloyd(rows, k=8, rounds=10, dim=64):
    import math

    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * float(x)) for x in v]))
    first = sorted(kept, key=lambda r: hashlib.sha256(f"3:{r[0]}".encode()).hexdigest())[:k]
    c = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        mine = defaultdict(list)
        for _, v in kept:
            mine[near(v)[1]].append(v)
        c = [[sum(x) // len(mine[j]) for x in zip(*mine[j], strict=True)] if j in mine else w for j, w in enumerate(c)]
    done = [(i, near(v)) for i, v in kept]
    of = lambda j: sum(d for _, (d, x) in done if x == j)
    sha = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    sums = [of(j) for j in range(len(c))]
    held = lambda x: x if x < 2**63 else None
    return sorted((i, j, held(d), held(sums[j]), held(sum(sums)), sha[j]) for i, (d, j) in done)


def vectors(seed, n, scale=1.0):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, scale) for _ in range(64)]) for i in range(n)]
    same = [0.25 * scale] * 64
    return rows + [(n + i, same) for i in range(n)] + [(2 * n, None), (2 * n + 1, [1.0] * 63), (2 * n + 2, [1.0] * 63 + [float("nan")]), (2 * n + 3, [1.0] * 63 + [float("inf")]), (2 * n + 4, [None] * 64)]


@pytest.mark.parametrize("seed,n,scale", [(1, 150, 1.0), (2, 3, 1.0), (3, 40, 3e3), (4, 40, 3e5)])
def test_lloyd_equals_plain_loops(spark, seed, n, scale):
    rows = vectors(seed, n, scale)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("own"), "key": F.lit("own"), "copies": F.lit(1), "__hot": F.lit(1)})
    assert sorted(map(tuple, lloyd.clusters(df).collect())) == plain_lloyd(rows)


def test_lloyd_odd_tables(spark):
    kind = "vec_id long, embedding array<double>"
    assert lloyd.clusters(spark.createDataFrame([], kind)).count() == 0
    assert lloyd.clusters(spark.createDataFrame([(1, None)], kind)).count() == 0
    rows = [(1, [0.5] * 64), (1, [0.5] * 64), (None, [0.25] * 64), (7, [1e300] * 64)]
    got = sorted(((r.vec_id, r.distance) for r in lloyd.clusters(spark.createDataFrame(rows, kind)).collect()), key=repr)
    assert got == sorted([(1, 0), (1, 0), (None, 0), (7, 0)], key=repr)
    far = lloyd.clusters(spark.createDataFrame([(k, [float(k % 2) * 1e300] * 64) for k in range(30)], kind), k=1).collect()
    assert len(far) == 30 and {r.inertia for r in far} == {None}


def test_keys_are_canonical():
    x = np.array([[1, -2], [2**15, 0], [2**31, -1], [-(2**15), 2**15 - 1]], np.int64)
    keys = lloyd.pack(x)
    assert [len(k) for k in keys] == [4, 8, 16, 4] and (lloyd.unpack(keys, 2) == x).all()
