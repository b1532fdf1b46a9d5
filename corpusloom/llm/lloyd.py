"""Exact integer k-means over distinct vectors with multiplicities.

Components become integers ``floor(1024 * x)``.  Equal integer vectors are
grouped first, so a group of copies, however large, is one row with a count;
partial counts are taken before the shuffle.  Lloyd's rounds then run over the
distinct vectors alone: a task assigns its vectors and returns, for each of the
few centroids, a count and integer sums weighted by multiplicity, which Spark
adds up; the driver sees one row a centroid and a round.  When no centroid moves
the rounds that are left change nothing and are passed over.  The last
assignment is joined back to the ids; vectors with very many copies, of which
there are few, by broadcast, so that no group of copies meets in one task.

All arithmetic is exact: products run as doubles where these hold every integer
that can come up, else as 64-bit integers, else as integers of Python.

Defined cases: vectors that are null, have another number of components than
``dim``, or hold null or non-finite components are left out; rows that repeat an
id or a vector count as often as they occur; a null id is kept and can only be a
first centroid when ids run out; ids that hash alike (repeated ones) are ordered
by their vector; with fewer than ``k`` kept rows there are fewer centroids; ties
between centroids go to the smaller number; an empty table gives an empty
result; other columns are not read.  Integers beyond 2^40 (components of 1e9 or
more) count as 2^40; a distance or sum that no long can hold is null.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh
from corpusloom.session import written

K = 8
ROUNDS = 10
DIM = 64
SCALE = 1024
#: A vector with more than this share of all rows is joined by broadcast; there are fewer than its inverse.
HOT = 1 / 2000
#: Rows compared with the centroids at a time.
BLOCK = 4096
_LARGEST = 2.0**40
_LONG = 2**63 - 1

# ------------------------------------------------------------- vectors as keys


def pack(x: np.ndarray) -> list[bytes]:
    """Integer rows as bytes, each in the narrowest width that holds it: equal rows have equal bytes."""
    low, high = x.min(axis=1), x.max(axis=1)
    width = np.select([(low >= -(2**15)) & (high < 2**15), (low >= -(2**31)) & (high < 2**31)], [2, 4], 8)
    out = [b""] * len(x)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        for i, r in zip(rows, x[rows].astype(f"<i{w}"), strict=True):
            out[i] = r.tobytes()
    return out


def unpack(keys: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(keys), dim), np.int64)
    size = np.array([len(k) for k in keys])
    for w in np.unique(size):
        rows = np.flatnonzero(size == w)
        out[rows] = np.frombuffer(b"".join(keys[i] for i in rows), f"<i{w // dim}").reshape(-1, dim)
    return out


def quantised(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(vec_id, key) of every vector that is kept."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(flat * SCALE), -_LARGEST, _LARGEST).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pack(x), pa.binary())], ["vec_id", "key"])

    narrow = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = narrow.where(F.size("embedding") == dim).where("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    return good.mapInArrow(run, "vec_id long, key binary")


# ------------------------------------------------------------- rounds


def assign(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and the squared distance; rows and centroids are int64."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    kind = np.float64 if most < 2**21 else np.int64 if most < 2**27 else object  # 4 * 64 * most ** 2 is held exactly
    if x.shape[1] > 64 and kind is not object:
        kind = object if most >= 2**20 or x.shape[1] > 2**10 else np.float64
    x, c = x.astype(kind), c.astype(kind)
    if kind is object:
        d = np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)
    else:
        d = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
    near = np.argmin(d, axis=1) if kind is not object else np.array([min(range(len(c)), key=r.__getitem__) for r in d], np.int64)
    return near, d[np.arange(len(x)), near]


def _long(values) -> list[int | None]:
    return [int(v) if v <= _LONG else None for v in values]


def _blocks(batches, dim: int):
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            part = b.slice(at, BLOCK)
            yield part, unpack(part.column(0).to_pylist(), dim), part.column(1).to_numpy()


def step(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The next centroids: exact floors of weighted means; an empty one stays."""
    k, dim = centroids.shape

    def run(batches):
        import pyarrow as pa

        count, total = [0] * k, np.zeros((k, dim), object)
        for _, x, n in _blocks(batches, dim):
            near, _ = assign(x, centroids)
            small = int(np.abs(x).max(initial=0)) * int(n.sum()) < 2**62
            for j in np.unique(near):
                mine = near == j
                count[j] += int(n[mine].sum())
                total[j] += (x[mine] * n[mine, None]).sum(axis=0) if small else (x[mine].astype(object) * n[mine, None].astype(object)).sum(axis=0)
        used = [j for j in range(k) if count[j]]
        sums = [[Decimal(int(v)) for v in total[j]] for j in used]
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array([count[j] for j in used], pa.int64()), pa.array(sums, pa.list_(pa.decimal128(38, 0)))], ["j", "n", "sums"])

    got = distinct.mapInArrow(run, "j int, n long, sums array<decimal(38,0)>").select("j", "n", F.posexplode("sums").alias("i", "s"))
    rows = got.groupBy("j", "i").agg(F.sum("n"), F.sum("s")).collect()  # k * dim at most
    out = centroids.copy()
    for j, i, n, s in rows:
        out[j, i] = int(s) // n
    return out


def first_centroids(keyed: DataFrame, k: int, seed: int, dim: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = keyed.orderBy(order.asc_nulls_last(), "key").limit(k).select("key").collect()
    return unpack([bytes(r[0]) for r in rows], dim)


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = 3, dim: int = DIM) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that is kept."""
    spark = vectors.sparkSession
    keyed = written(quantised(vectors, dim))
    distinct = written(keyed.groupBy("key").agg(F.count("*").alias("copies")))
    centroids = first_centroids(keyed, k, seed, dim)
    for _ in range(rounds if len(centroids) else 0):
        now = step(distinct, centroids)
        if (now == centroids).all():
            break
        centroids = now

    def last(batches):
        import pyarrow as pa

        for part, x, n in _blocks(batches, dim):
            near, d = assign(x, centroids)
            exact = [Decimal(int(v)) * int(m) for v, m in zip(d, n, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(near, pa.int32()), pa.array(_long(d), pa.int64()), pa.array(exact, pa.decimal128(38, 0))], ["key", "copies", "cluster", "distance", "weighted"]
            )

    done = written(distinct.mapInArrow(last, "key binary, copies long, cluster int, distance long, weighted decimal(38,0)"))
    sums = {r[0]: (int(r[1]), r[2]) for r in done.groupBy("cluster").agg(F.sum("weighted"), F.sum("copies")).collect()}  # k at most
    whole, rows = sum(s for s, _ in sums.values()), sum(n for _, n in sums.values())
    facts = [(j, *_long((s, whole)), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, (s, _) in sorted(sums.items())]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    hot = fresh(done, "hot")
    found = done.select("key", "cluster", "distance", (F.col("copies") > rows * HOT).alias(hot))
    often = F.broadcast(found.where(hot).drop(hot))  # fewer than 1 / HOT vectors
    rare = found.where(~F.col(hot)).drop(hot)
    back = keyed.join(often, "key").union(keyed.join(often.select("key"), "key", "left_anti").join(rare, "key"))
    out = back.join(F.broadcast(facts), "cluster")  # k rows
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def centroid_clusters(spark, sf_dir: str) -> DataFrame:
    """The query over all of ``embeddings``."""
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """All rounds written out: a row is a vector or centroid as a list of integers."""
    near = """a{r} AS (SELECT q.vec_id, q.v, arg_min(c.j, ROW(dist(q.v, c.v), c.j)) AS j FROM q, c{r} c GROUP BY q.rid, q.vec_id, q.v)"""
    dist = "CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    parts = [
        "e AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        "q AS (SELECT * FROM e)",
        "c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS INT) AS j, v FROM q QUALIFY j < 8)",
    ]
    for r in range(ROUNDS + 1):
        parts.append(near.format(r=r).replace("dist(q.v, c.v)", dist))
        if r < ROUNDS:
            parts.append(f"s{r} AS (SELECT j, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY j, i)")
            parts.append(f"m{r} AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{r} GROUP BY j)")
            parts.append(f"c{r + 1} AS (SELECT c.j, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON c.j = m.j)")
    parts.append(f"f AS (SELECT q.vec_id, q.j AS cluster, {dist} AS distance, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{ROUNDS} q JOIN c{ROUNDS} c ON q.j = c.j)")
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,"
        " CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM f"
    )


CENTROID_CLUSTERS_SQL = _sql()
