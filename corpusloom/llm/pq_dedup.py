"""Near-duplicate embeddings through product quantisation.

Equal vectors are collapsed first.  A coarse quantiser and, for residuals, one
codebook a subspace are fitted on a bounded sample (``SAMPLE`` rows); every
vector is then put into its inverted list with its codes and the exact length
of its quantisation error.  There are as many lists as the table asks for, but
fewer where vectors would probe more than ``PROBES`` of them on average, so what
is sent to lists grows with the table and no faster.  A vector probes each list
that can hold a partner: if its distance to the bisector between its own
centroid and another one exceeds the linking radius, the other list cannot.
Lists have an order, and a vector probes only its own and later ones, so each
pair is met once.  Within a list,
asymmetric distances from lookup tables, widened by the stored error, drop pairs
that cannot link; the survivors are ranked by the exact cosine in double
precision.  Both bounds are triangle inequalities, so no link is lost, whatever
the sample looks like.

Long lists are cut into blocks of visitors and members that are compared block
by block, and a block returns counts and a spanning forest, not its pairs.  That
is why vectors travel to the lists, in the precision of the table: survivors of
a large group of near copies would be all its pairs.

Defined cases: vectors that are null, zero, or hold null or non-finite
components, and vectors with a null label or ``vec_id``, link with nothing;
vectors of different lengths do not link; rows that repeat a vector are linked
copies; a null ``vec_id`` has a null class and is not kept; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import cut
from corpusloom.llm.graph import components

COSINE = 0.98
SAMPLE = 20_000
LIST_ROWS = 400  # wanted length of an inverted list
#: Lists grow with the table up to here: 6.5 million vectors, 16 MB of centroids of 128 components.
MOST_LISTS = 16_384
#: Lists that a vector may probe on average; where it would be more, there are fewer lists.
PROBES = 8
#: Lists beyond which centroids are fitted in two levels.
FLAT_LISTS = 1024
#: Share of a block's pairs beyond which exact cosines are taken as one product.
DENSE = 1 / 8
#: A vector with more than this share of all rows is joined by broadcast; there are fewer than its inverse.
HOT = 1 / 2000
SUBSPACES = 8
CODES = 64
BLOCK = 4096
_SLACK = 1e-6  # for rounding in the bounds


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    r = np.random.default_rng(seed)
    c = x[r.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmin(half - x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def _centroids(x: np.ndarray, k: int) -> np.ndarray:
    """``k`` centroids; many of them as those of the parts around a first few."""
    if k <= FLAT_LISTS:
        return _kmeans(x, min(k, len(x)))
    top = _kmeans(x, int(np.sqrt(k)))
    near = _nearest(x, top)
    share = np.ceil(k * np.bincount(near, minlength=len(top)) / len(x)).astype(int)
    return np.concatenate([_kmeans(x[near == i], min(n, int((near == i).sum()))) for i, n in enumerate(share) if n])[:k]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    scale = np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass
class Quantiser:
    """Coarse centroids and residual codebooks for unit vectors of one length."""

    coarse: np.ndarray
    books: list[np.ndarray]
    splits: np.ndarray

    @staticmethod
    def single(dim: int) -> Quantiser:
        """One list for few vectors: nothing is fitted, the error is the whole length."""
        return Quantiser(np.zeros((1, dim)), [np.zeros((1, dim))], np.array([0, dim]))

    @staticmethod
    def fit(x: np.ndarray, lists: int, radius: float) -> Quantiser:
        """At most ``lists`` lists, fewer where vectors without clusters would probe too many of them."""
        x = _unit(x)
        lists = max(1, min(lists, len(x)))
        coarse = _centroids(x, lists)
        some = x[:2000]
        while lists > 1 and np.mean([len(p) for p in Quantiser(coarse, [], np.zeros(0)).probes(some, _nearest(some, coarse), radius)]) > PROBES:
            lists //= 2
            coarse = _centroids(x, lists)
        rest = x - coarse[_nearest(x, coarse)]
        splits = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
        books = [_kmeans(rest[:, a:b], min(CODES, len(x))) for a, b in zip(splits, splits[1:], strict=False)]
        return Quantiser(coarse, books, splits)

    def _parts(self):
        return zip(self.books, self.splits, self.splits[1:], strict=False)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of unit vectors: own list, codes, and the length of the quantisation error."""
        own = _nearest(x, self.coarse)
        rest = x - self.coarse[own]
        codes = np.stack([_nearest(rest[:, a:b], book) for book, a, b in self._parts()], axis=1)
        back = np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)
        return own, codes.astype(np.uint8), np.sqrt(((rest - back) ** 2).sum(axis=1))

    def probes(self, x: np.ndarray, own: np.ndarray, radius: float) -> list[np.ndarray]:
        """The lists, from the own one on, that a partner within ``radius`` can be in."""
        c = self.coarse
        out = []
        for i in range(0, len(x), 1024):
            q, o = x[i : i + 1024], own[i : i + 1024]
            d = np.maximum((q * q).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * q @ c.T, 0)
            first = d[np.arange(len(q)), o]
            apart = np.sqrt(np.maximum((c[o] ** 2).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * c[o] @ c.T, 0))
            hit = d - first[:, None] <= 2 * apart * (radius + _SLACK) + _SLACK
            hit[np.arange(len(q)), o] = True
            hit &= np.arange(len(c)) >= o[:, None]
            out += [np.flatnonzero(h) for h in hit]
        return out

    def distances(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances between queries and coded members of a list."""
        rest = q - self.coarse[cell]
        total = np.zeros((len(q), len(codes)))
        for i, (book, a, b) in enumerate(self._parts()):
            part = rest[:, a:b]
            table = (part * part).sum(axis=1)[:, None] + (book * book).sum(axis=1) - 2 * part @ book.T
            total += table[:, codes[:, i]]
        return np.maximum(total, 0)


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _cosines(x: np.ndarray, y: np.ndarray, near: np.ndarray, least: float) -> np.ndarray:
    """Which of the pairs ``near`` (a mask) of unit vectors have at least this cosine."""
    a, b = np.nonzero(near)
    if len(a) > DENSE * near.size:
        return near & (x @ y.T >= least)
    out = np.zeros_like(near)
    good = np.einsum("ij,ij->i", x[a], y[b]) >= least
    out[a[good], b[good]] = True
    return out


def _forest(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The least position that each of ``size`` positions is joined to by pairs (a, b)."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


_USABLE = (
    "label is not null and vec_id is not null and embedding is not null and size(embedding) > 0 "
    "and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) "
    "and exists(embedding, x -> x <> 0)"
)


def _usable(nodes: DataFrame) -> DataFrame:
    return nodes.where(_USABLE)


def _rows(vectors: DataFrame) -> tuple[DataFrame, str]:
    """(vec_id, embedding, label), and the component type in which a vector is exact."""
    kind = vectors.schema["embedding"].dataType
    exact = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{exact}>").alias("embedding"), "label"), exact


def links(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, list_rows: int = LIST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Of (vec_id, embedding, label): a row per distinct vector (label, embedding,
    id, copies, n_links) and edges (a, b) between ids that hold every class together."""
    spark = vectors.sparkSession
    narrow, exact = _rows(vectors)
    nodes = _usable(narrow).groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("id"))
    nodes = cut(nodes.withColumn("dim", F.size("embedding")))
    sizes = {r[0]: r[1] for r in nodes.groupBy("dim").count().where(F.col("count") > list_rows).collect()}  # lengths with more than one list
    radius = float(np.sqrt(2 - 2 * cosine))
    models: dict[int, Quantiser] = {}
    for dim, n in sizes.items():
        rows = nodes.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").toArrow()
        models[dim] = Quantiser.fit(_matrix(rows.column(0)), min(MOST_LISTS, -(-n // list_rows)), radius)
    shared = spark.sparkContext.broadcast(models)  # bounded by MOST_LISTS, CODES and the vector length

    def model(dim: int) -> Quantiser:
        return shared.value.get(dim) or Quantiser.single(dim)

    def put(batches):
        import pyarrow as pa

        for b in batches:
            dims = b.column(3).to_numpy()
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                x, q = _unit(_matrix(part.column(0))), model(int(dim))
                own, codes, error = q.encode(x)
                more = [
                    pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error),
                    pa.array([p.astype(np.int32) for p in q.probes(x, own, radius)], pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "own", "codes", "error", "probes"])

    placed = nodes.select("embedding", "id", "copies", "dim", F.xxhash64("label").alias("grp"))
    placed = cut(placed.mapInArrow(put, f"embedding array<{exact}>, id long, copies long, dim int, grp long, own int, codes binary, error double, probes array<int>"))
    where = ["grp", "dim", "cell"]
    member = placed.withColumnRenamed("own", "cell").drop("probes")
    visitor = placed.drop("codes", "error").withColumn("cell", F.explode("probes")).drop("probes")
    size = member.groupBy(*where).agg(F.ceil(F.count("*") / BLOCK).alias("mbs"))
    size = size.join(visitor.groupBy(*where).agg(F.ceil(F.count("*") / BLOCK).alias("vbs")), where)
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    salt = lambda n: F.pmod(F.xxhash64("id", F.lit(n)), F.col(n))
    cols = [*where, "mb", "vb", "id", "copies", "embedding", "own", "codes", "error"]
    left = visitor.join(size, where).withColumns({"vb": salt("vbs"), "mb": spread("mbs"), "codes": F.lit(None).cast("binary"), "error": F.lit(None).cast("double")})
    right = member.withColumn("own", F.col("cell")).join(size, where).withColumns({"mb": salt("mbs"), "vb": spread("vbs")})
    both = left.select(*cols).union(right.select(*cols))

    def compare(table):
        import pyarrow as pa

        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        x = _unit(_matrix(table.column("embedding")))
        q = model(x.shape[1])
        cell = table.column("cell")[0].as_py()
        at_home = table.column("own").to_numpy() == cell
        is_member = table.column("codes").is_valid().to_numpy()
        v, m = np.flatnonzero(~is_member), np.flatnonzero(is_member)
        codes = np.frombuffer(b"".join(table.column("codes").filter(pa.array(is_member)).to_pylist()), np.uint8).reshape(len(m), -1)
        error = table.column("error").to_numpy()[m]
        count = np.zeros(len(x), dtype=np.int64)
        pa_, pb_ = [], []
        for i in range(0, len(v), 128) if len(m) else ():
            w = v[i : i + 128]
            near = np.sqrt(q.distances(x[w], cell, codes)) <= radius + error + _SLACK
            near &= ~at_home[w][:, None] | (ids[w][:, None] < ids[m])  # within a list from the lesser id only
            if not near.any():
                continue
            near = _cosines(x[w], x[m], near, cosine)
            a, b = np.nonzero(near)
            count[w] += near @ copies[m]
            count[m] += copies[w] @ near
            pa_.append(w[a])
            pb_.append(m[b])
        out = np.flatnonzero(count)
        roots = np.arange(len(x))
        if pa_:
            order = np.argsort(ids, kind="stable")
            rank = np.empty(len(x), dtype=np.int64)
            rank[order] = np.arange(len(x))
            roots = order[_forest(rank[np.concatenate(pa_)], rank[np.concatenate(pb_)], len(x))[rank]]
            out = np.flatnonzero((count > 0) | (roots != np.arange(len(x))))
        return pa.table({"id": ids[out], "links": count[out], "root": ids[roots[out]]})

    met = cut(both.groupBy(*where, "mb", "vb").applyInArrow(compare, "id long, links long, root long"))
    edges = met.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct()
    found = met.groupBy("id").agg(F.sum("links").alias("links"))
    linked = nodes.join(found, "id", "left").select("label", "embedding", "id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return linked, edges


def classes(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, list_rows: int = LIST_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors``."""
    linked, edges = links(vectors, cosine, sample, list_rows)
    roots = components(edges).withColumnRenamed("node", "id")
    lookup = linked.join(roots, "id", "left").select("label", "embedding", "copies", "n_links", F.coalesce("root", "id").alias("component"))
    lookup = cut(lookup)
    least = lookup.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0] * HOT
    rows, _ = _rows(vectors)
    key = ["label", "embedding"]
    usable = _usable(rows)
    hot = F.broadcast(lookup.where(F.col("copies") > least))  # fewer than 1 / HOT vectors
    cold = usable.join(hot.select(*key), key, "left_anti").join(lookup.where(F.col("copies") <= least), key)
    alone = rows.where(f"not coalesce({_USABLE}, false)")
    parts = [usable.join(hot, key), cold, alone.withColumns({"n_links": F.lit(0).cast("long"), "component": F.col("vec_id")})]
    columns = ["vec_id", "n_links", F.col("component").alias("component_id")]
    out = parts[0].select(*columns).union(parts[1].select(*columns)).union(parts[2].select(*columns))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """The query over all of ``embeddings``."""
    return classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
