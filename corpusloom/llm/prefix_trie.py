"""A trie of conversations that share their first turns, merged family by family.

Conversations with one base id (``conv_id - conv_id % 5``) form a family of a few
members.  A turn travels as a 16-byte digest of role and text and its number of
bytes.  Families are cogrouped, base conversation with the others; each rebuilds
its conversations and merges them into a trie of its own, and only the nodes of
these small tries are shuffled again.  A node is known by its depth and a
128-bit sum, over the turns that lead to it, of digests mixed with their places;
so a node's parent follows from the node, and a sum can be built in parts.

What a node says of its whole subtree comes without walking the tree.  A node is
*owned* by its smallest member; what a conversation owns is the end of its path,
a chain.  A node's subtree is the rest of its own chain below it, and the whole
chains of those of its members that own deeper nodes only.  The first is a
running sum along the chain, the second one sum over family nodes.

Families with very many turns, of which there are few, never meet in one task:
their turns are numbered in blocks cut at quantiles, and node sums are running
sums within blocks plus the sums of the blocks before.  Very wide nodes are
joined by broadcast, few by count.  Member lists are hashed in order as blocks
of ids, so no list has to fit into a row or a task's memory.

Defined cases: rows with a null ``conv_id`` are left out; a null role or text is
empty; a null turn comes first; rows with equal turns are ordered by role, then
by the digest of their text, and all stay; repeated rows are turns like any
other; negative ids take ``%`` as SQL does, with the sign of the id; an empty
table gives an empty result; turns of any length and conversations of any number
of turns are read whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import written

FAMILY = 5
MOST_HEAD = 9
#: A family with more turns than this, and than ``HOT`` of all, is numbered in blocks; so is a node with so many children joined by broadcast.
LONG = 100_000
HOT = 1 / 200_000
#: Turns of one block of a long family, at least; the most cuts by quantiles of one conversation, and of all together.
BLOCK = 65_536
MOST_CUTS = 10_000
ALL_CUTS = 1_000_000
#: Depths that one running sum along a chain spans; and (as a power of two) ids that one block of a member list spans.
CHAIN = 4096
IDS = 14

_TURN = ["fam", "conv", "known", "turn", "role", "digest", "bytes"]
_NODE = "fam long, depth long, k1 long, k2 long, p1 long, p2 long, bytes long, members array<long>, ends array<long>"
_KEY = ["depth", "k1", "k2"]

# ------------------------------------------------------------- turns


def turns(conversations: DataFrame) -> DataFrame:
    """One row a turn, without its text."""
    conv, role, text = F.col("conv_id").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return conversations.where("conv_id is not null").select(
        (conv - conv % FAMILY).alias("fam"), conv.alias("conv"), F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        role.alias("role"), F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"), F.octet_length(text).cast("long").alias("bytes"),
    )


def head_of(conv: int) -> int:
    """How many turns of its base a conversation begins with, at most."""
    return zlib.crc32(str(conv).encode()) % MOST_HEAD


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def placed(digests: list[bytes], depth: np.ndarray) -> np.ndarray:
    """Two numbers a turn that depend on its digest and its place."""
    two = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2).astype(np.uint64)
    at = depth.astype(np.uint64)[:, None] * np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03], np.uint64)
    return _mix(two + _mix(at))


# ------------------------------------------------------------- families


def _family(base, others):
    """The trie of one family; ``base`` holds the turns of its base conversation, ``others`` those of the rest."""
    import pyarrow as pa

    own: dict[int, list] = {}
    for table in (t for t in (base, others) if t.num_rows):  # a side without rows has no columns
        for row in zip(*[table.column(c).to_pylist() for c in _TURN[1:]], strict=True):
            own.setdefault(row[0], []).append(row[1:])
    for rows in own.values():
        rows.sort()
    fam = (base if base.num_rows else others).column("fam")[0].as_py()
    first = own.get(fam, [])
    nodes: dict[tuple, list] = {(0, 0, 0): [0, 0, 0, sorted(own), []]}  # parent's sums, bytes, members, ends
    for conv in sorted(own):
        h = head_of(conv)
        path = first[:h] + own[conv][h:]
        if not path:
            nodes[0, 0, 0][4].append(conv)
            continue
        step = placed([r[3] for r in path], np.arange(1, len(path) + 1))
        at = np.cumsum(step, axis=0, dtype=np.uint64)
        below = (at - step).view(np.int64).tolist()
        for d, (k, p, row) in enumerate(zip(at.view(np.int64).tolist(), below, path, strict=True), 1):
            node = nodes.setdefault((d, k[0], k[1]), [p[0], p[1], row[4], [], []])
            node[3].append(conv)
        node[4].append(conv)
    keys, facts = zip(*nodes.items(), strict=True)
    depth, k1, k2 = (pa.array(x, pa.int64()) for x in zip(*keys, strict=True))
    p1, p2, size, members, ends = zip(*facts, strict=True)
    lists = pa.list_(pa.int64())
    columns = [pa.array([fam] * len(keys), pa.int64()), depth, k1, k2, *[pa.array(x, pa.int64()) for x in (p1, p2, size)], pa.array(members, lists), pa.array(ends, lists)]
    return pa.table(columns, names=["fam", "depth", "k1", "k2", "p1", "p2", "bytes", "members", "ends"])


def _few(rows: DataFrame) -> DataFrame:
    """Nodes of families that fit into a task: the base conversation cogrouped with the others."""
    base, others = rows.where("conv = fam"), rows.where("conv <> fam").select(*[F.col(c).alias(c) for c in _TURN])  # columns of its own
    return base.groupBy("fam").cogroup(others.groupBy("fam")).applyInArrow(_family, _NODE)


def _numbered(rows: DataFrame, most: int, total: int) -> DataFrame:
    """Turns with their place ``i`` in their conversation, numbered in blocks cut at quantiles."""
    block = max(BLOCK, total // ALL_CUTS)
    cuts = max(1, min(MOST_CUTS, most // block))
    every = F.greatest(F.lit(1), F.floor(F.lit(cuts * block) / F.count("*")))  # a shorter conversation has fewer blocks
    at = rows.groupBy("conv").agg(F.percentile_approx("turn", [k / cuts for k in range(1, cuts + 1)], 10 * cuts).alias("cuts"), every.alias("every"))
    at = F.broadcast(at.select("conv", F.filter("cuts", lambda _, k: (k + 1) % F.col("every") == 0).alias("cuts")))  # ALL_CUTS at most
    rows = rows.join(at, "conv").withColumn("block", F.when(F.col("known"), F.size(F.filter("cuts", lambda c: c < F.col("turn"))) + 1).otherwise(0)).drop("cuts")
    before = rows.groupBy("conv", "block").count().withColumn("before", F.sum("count").over(Window.partitionBy("conv").orderBy("block")) - F.col("count")).drop("count")
    place = F.row_number().over(Window.partitionBy("conv", "block").orderBy("turn", "role", "digest"))
    return rows.withColumn("i", place.cast("long")).join(before, ["conv", "block"]).withColumn("i", F.col("i") + F.col("before")).drop("before", "block")


def _many(rows: DataFrame, most: int, total: int) -> DataFrame:
    """The same nodes, one a conversation and place, for families of any size."""
    n = written(_numbered(rows, most, total).select("fam", "conv", "digest", "bytes", "i"))
    convs = n.select("fam", "conv").distinct().withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % MOST_HEAD)
    head = n.where((F.col("conv") == F.col("fam")) & (F.col("i") < MOST_HEAD)).select("fam", "digest", "bytes", "i")
    have = convs.join(head.groupBy("fam").agg(F.max("i").alias("have")), "fam", "left").select("fam", "conv", "h", F.least("h", F.coalesce("have", F.lit(0))).alias("have"))
    have = F.broadcast(have)  # conversations of long families
    cols = ["fam", "conv", "digest", "bytes", "d"]
    path = n.join(have.drop("fam"), "conv").where("i > h").withColumn("d", F.col("i") - F.col("h") + F.col("have")).select(*cols)
    path = path.union(head.join(have, "fam").where("i <= h").withColumn("d", F.col("i")).select(*cols))

    def halves(batches):
        import pyarrow as pa

        for b in batches:
            d = b.column(4).to_numpy()
            step = placed(b.column(2).to_pylist(), d) if len(d) else np.zeros((0, 2), np.uint64)
            parts = [pa.array((x & np.uint64(0xFFFFFFFF) if low else x >> np.uint64(32)).astype(np.int64)) for x in step.T for low in (True, False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), *parts], ["fam", "conv", "bytes", "d", "a0", "a1", "b0", "b1"])

    four = ["a0", "a1", "b0", "b1"]
    path = path.mapInArrow(halves, "fam long, conv long, bytes long, d long, a0 long, a1 long, b0 long, b1 long").withColumn("block", F.floor(F.col("d") / BLOCK))
    upto = Window.partitionBy("conv").orderBy("block")
    sums = path.groupBy("conv", "block").agg(*[F.sum(c).alias(c) for c in four])
    sums = sums.select("conv", "block", *[(F.sum(c).over(upto) - F.col(c)).alias(f"{c}_before") for c in four])
    within = Window.partitionBy("conv", "block").orderBy("d")
    path = path.select("*", *[F.sum(c).over(within).alias(f"{c}_upto") for c in four]).join(sums, ["conv", "block"])
    last = path.groupBy("conv").agg(F.max("d").alias("last"))
    path = path.join(F.broadcast(last), "conv")

    def keys(batches):
        import pyarrow as pa

        for b in batches:
            c = {name: b.column(name).to_numpy().astype(np.uint64) for name in b.schema.names if name[:1] in "ab" and name[:2] in ("a0", "a1", "b0", "b1")}
            out = []
            for lane in "ab":
                own = c[f"{lane}0"] + (c[f"{lane}1"] << np.uint64(32))
                sums = [c[f"{lane}{x}_upto"] + c[f"{lane}{x}_before"] for x in (0, 1)]
                at = sums[0] + (sums[1] << np.uint64(32))
                out.append((at.view(np.int64), (at - own).view(np.int64)))
            (k1, p1), (k2, p2) = out
            conv, d = b.column("conv").to_pylist(), b.column("d")
            lists = pa.list_(pa.int64())
            ends = pa.array([[x] if e else [] for x, e in zip(conv, (d.to_numpy() == b.column("last").to_numpy()), strict=True)], lists)
            columns = [b.column("fam"), d, *[pa.array(x) for x in (k1, k2, p1, p2)], b.column("bytes"), pa.array([[x] for x in conv], lists), ends]
            yield pa.RecordBatch.from_arrays(columns, ["fam", "depth", "k1", "k2", "p1", "p2", "bytes", "members", "ends"])

    nodes = path.select("fam", "conv", "d", "bytes", "last", *four, *[f"{c}_{x}" for c in four for x in ("upto", "before")]).mapInArrow(keys, _NODE)
    zero = F.lit(0).cast("long")
    root = convs.join(F.broadcast(last), "conv", "left").select(
        "fam", *[zero.alias(c) for c in ("depth", "k1", "k2", "p1", "p2", "bytes")], F.array("conv").alias("members"),
        F.when(F.col("last").isNull(), F.array("conv")).otherwise(F.array().cast("array<long>")).alias("ends"),
    )
    return nodes.union(root)


def family_nodes(conversations: DataFrame, long: int = LONG) -> DataFrame:
    """fam, depth, k1, k2, p1, p2, bytes, members, ends, and whether the family is a long one."""
    rows = turns(conversations)
    size = rows.groupBy("fam").count()
    total = rows.count()
    least = max(long, int(total * HOT))
    most = size.where(F.col("count") > least).agg(F.max("count")).first()[0]
    if most is None:
        return written(_few(rows).withColumn("long", F.lit(False)))
    large = F.broadcast(size.where(F.col("count") > least).select("fam"))  # fewer than 1 / HOT
    few = _few(rows.join(large, "fam", "left_anti")).withColumn("long", F.lit(False))
    many = _many(rows.join(large, "fam", "left_semi"), most, total).withColumn("long", F.lit(True))
    return written(few.union(many))


# ------------------------------------------------------------- the whole trie


def _chains(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the saved tokens of the rest of their chain, from themselves on."""
    down = Window.partitionBy("conv_id", "part").orderBy(F.col("depth").desc())
    nodes = nodes.withColumn("part", F.floor(F.col("depth") / CHAIN))
    out = nodes.withColumn("rest", F.sum("saves").over(down))
    if (nodes.agg(F.max("part")).first()[0] or 0) == 0:
        return out.drop("part")
    later = Window.partitionBy("conv_id").orderBy(F.col("part").desc())
    parts = nodes.groupBy("conv_id", "part").agg(F.sum("saves").alias("s")).select("conv_id", "part", (F.sum("s").over(later) - F.col("s")).alias("later"))
    return out.join(parts, ["conv_id", "part"]).withColumn("rest", F.col("rest") + F.col("later")).drop("part", "later")


def _digests(family: DataFrame) -> DataFrame:
    """depth, k1, k2 and the hash of the ids that end there, for nodes where some do."""
    ends = family.select(*_KEY, F.explode("ends").alias("id")).withColumn("block", F.shiftright("id", IDS))
    blocks = ends.groupBy(*_KEY, "block").agg(F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))  # 2 ** IDS ids at most
    blocks = blocks.repartition(*_KEY).sortWithinPartitions(*_KEY, "block")

    def run(batches):
        import pyarrow as pa

        def out(key, h):
            return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in key], pa.array([h.hexdigest()])], [*_KEY, "ends_sha256"])

        def rows(done):
            return pa.Table.from_batches(done).combine_chunks().to_batches()

        now, h, done = None, None, []
        for b in batches:
            for *key, _, ids in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if key == now:
                    h.update(b",")
                else:
                    if h is not None:
                        done.append(out(now, h))
                    now, h = key, hashlib.sha256()
                h.update(ids.encode())
            if len(done) > 1000:
                yield from rows(done)
                done = []
        if h is not None:
            done.append(out(now, h))
        if done:
            yield from rows(done)

    return blocks.mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(conversations: DataFrame, long: int = LONG) -> DataFrame:
    """A row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    family = family_nodes(conversations, long)
    nodes = family.groupBy(*_KEY).agg(
        F.min(F.get("members", F.lit(0))).alias("conv_id"), F.sum(F.size("members")).alias("n_convs"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("bytes").alias("bytes"),
    )
    nodes = written(nodes)
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("saves", (F.col("n_convs") - 1) * F.col("bytes"))
    nodes = written(_chains(nodes))
    chains = nodes.groupBy("conv_id").agg(F.min("depth").alias("start"), F.sum("saves").alias("more"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    chains = chains.where("start > 0").withColumnRenamed("conv_id", "x")  # of members that own deeper nodes only
    members = family.select("fam", "long", *_KEY, F.explode("members").alias("x"))
    shared = members.where("not long").join(chains, "x")
    if family.where("long").limit(1).count():
        large = chains.join(members.where("long and depth = 0").select("x"), "x", "left_semi")
        shared = shared.unionByName(members.where("long").join(F.broadcast(large), "x"))  # conversations of few families
    shared = shared.where("depth < start").groupBy(*_KEY).agg(F.sum("more").alias("more"), F.sum("leaf").alias("leaves"))
    leaf = nodes.groupBy("conv_id").agg(F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    leaf = leaf.where("leaf = 1")
    out = nodes.join(shared, _KEY, "left").join(_digests(family), _KEY, "left").join(leaf, "conv_id", "left")
    return _with_parents(out, nodes).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.coalesce("leaf", F.lit(0)) + F.coalesce("leaves", F.lit(0))).alias("n_leaves"),
        (F.col("rest") + F.coalesce("more", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def _with_parents(out: DataFrame, nodes: DataFrame) -> DataFrame:
    """``parent_conv_id`` of every node; parents with very many children by broadcast."""
    least = max(1000, int(nodes.count() * HOT))
    up = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    wide = F.broadcast(up.where(F.col("n_children") > least).drop("n_children"))  # fewer than 1 / HOT
    slim = up.where(F.col("n_children") <= least).drop("n_children")
    on = ["depth", "p1", "p2"]
    below, root = out.where("depth > 0"), out.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    keep = [*out.columns, "parent_conv_id"]
    return root.select(*keep).union(below.join(wide, on).select(*keep)).union(below.join(wide, on, "left_anti").join(slim, on).select(*keep))


def conversation_trie(spark, sf_dir: str) -> DataFrame:
    """The query over all of ``conversations``."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: crc32 bit by bit, for SQL has none.
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(c::VARCHAR) + 1), lambda i: CAST(ascii(substr(c::VARCHAR, i, 1)) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""
CONVERSATION_TRIE_SQL = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
hs AS (SELECT c, {_CRC} % 9 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT hs.c, i, 0 AS part, role, text FROM hs JOIN t ON t.c = hs.c - hs.c % 5 AND i <= h UNION ALL SELECT c, i, 1, role, text FROM t JOIN hs USING (c) WHERE i > h),
d AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY part, i) AS depth FROM r),
p AS (SELECT c, depth, text, string_agg(md5(role || chr(1) || text), '') OVER (PARTITION BY c ORDER BY depth) AS k FROM d UNION ALL SELECT c, 0, '', '' FROM hs),
n AS (SELECT k, depth, min(c) AS conv_id, count(*) AS n_convs, max(octet_length(encode(text))) AS bytes FROM p GROUP BY k, depth),
up AS (SELECT k, left(k, CAST(length(k) - 32 AS BIGINT)) AS pk FROM n WHERE depth > 0),
ch AS (SELECT pk AS k, count(*) AS n_children FROM up GROUP BY pk),
sub AS (SELECT p.k, sum((n.n_convs - 1) * n.bytes) AS saved, count(*) FILTER (ch.k IS NULL) AS leaves
  FROM n LEFT JOIN ch ON ch.k = n.k JOIN p ON p.c = n.conv_id AND p.depth <= n.depth GROUP BY p.k),
l AS (SELECT c, max(depth) AS depth FROM p GROUP BY c),
e AS (SELECT p.k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS s FROM p JOIN l USING (c, depth) GROUP BY p.k)
SELECT n.conv_id, n.depth, parent.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  coalesce(e.s, sha256('')) AS ends_sha256
FROM n LEFT JOIN up ON up.k = n.k LEFT JOIN n parent ON parent.k = up.pk LEFT JOIN ch ON ch.k = n.k JOIN sub ON sub.k = n.k LEFT JOIN e ON e.k = n.k
"""
