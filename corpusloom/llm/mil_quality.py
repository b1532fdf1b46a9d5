"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages.  Every passage is encoded as hashed byte
trigrams and shares of character classes; a gated attention layer, learned from
document labels alone, weighs the passages; the weighted passage representation
is scored by a logistic layer.  The network is small and is fitted on the
driver over a bounded sample of labelled documents (``PER_CLASS`` of each
label, ``SAMPLE_PASSAGES`` of each document: longer ones have neighbouring
passages averaged for fitting); scoring is one pass over all texts in Arrow batches.

Defined cases: a null text counts as empty and has one blank passage; a null
``doc_id`` is scored and is not held out; repeated rows get equal scores; an
empty table gives an empty result; if the sample has one label only, that
label's share decides; without any labels every score is 0.5; columns other
than ``doc_id`` and ``text`` are not read.  All passages of a text are used,
however long it is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import fold
from corpusloom.llm.sampling import labelled_sample

PASSAGE = 512  # bytes
BUCKETS = 256
PER_CLASS = 1500
SAMPLE_PASSAGES = 256
HELD_OUT = (3, 1)  # modulus, remainder
_SLAB = 1 << 22  # bytes encoded at once


def _classes() -> np.ndarray:
    kind = np.full(256, 7, dtype=np.int64)  # continuation and leading bytes of other scripts
    kind[:128] = 6  # symbols
    kind[[9, 10, 11, 12, 13, 32]] = 0
    kind[ord("a") : ord("z") + 1] = 1
    kind[ord("A") : ord("Z") + 1] = 2
    kind[ord("0") : ord("9") + 1] = 3
    kind[[ord(c) for c in ".,;:'\"-?"]] = 4
    kind[[ord(c) for c in "!|"]] = 5
    return kind


_KIND = _classes()
WIDTH = BUCKETS + 10


def encode_passages(text: str) -> np.ndarray:
    """One row per passage of a text: trigram buckets, class shares, line share, length."""
    raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    n = max(1, -(-len(raw) // PASSAGE))
    out = np.zeros((n, WIDTH), dtype=np.float32)
    step = _SLAB // PASSAGE
    for at in range(0, n, step):
        part = raw[at * PASSAGE : (at + step) * PASSAGE + 2].astype(np.uint32)
        own = min(len(part), step * PASSAGE)
        k = min(step, n - at)
        spot = np.arange(own) // PASSAGE
        if len(part) > 2:
            h = (part[:-2] * 0x9E3779B1 + part[1:-1] * 0x85EBCA77 + part[2:] * 0xC2B2AE3D).astype(np.uint32) >> 24
            m = min(own, len(h))
            grams = np.bincount(spot[:m] * BUCKETS + h[:m], minlength=k * BUCKETS).reshape(k, BUCKETS)
            grams = np.log1p(grams)
            out[at : at + k, :BUCKETS] = grams / np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-6)
        if own:
            kinds = np.bincount(spot * 8 + _KIND[part[:own]], minlength=k * 8).reshape(k, 8)
            total = np.maximum(kinds.sum(axis=1, keepdims=True), 1)
            out[at : at + k, BUCKETS : BUCKETS + 8] = 2 * np.sqrt(kinds / total)
            out[at : at + k, BUCKETS + 8] = np.sqrt(np.bincount(spot, weights=part[:own] == 10, minlength=k) / total[:, 0])
            out[at : at + k, BUCKETS + 9] = np.log1p(total[:, 0]) / 8
    return out


def pooled(x: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` rows: runs of neighbours, of equal length but for one, averaged."""
    if len(x) <= most:
        return x
    starts = np.unique(np.arange(most) * len(x) // most)
    return np.add.reduceat(x, starts) / np.diff(np.append(starts, len(x)))[:, None].astype(x.dtype)


@dataclass
class GatedAttention:
    """Weights of the encoder, the gate and the scorer."""

    w: list[np.ndarray]

    @staticmethod
    def blank(width: int = WIDTH, hidden: int = 24, gate: int = 12, seed: int = 7) -> GatedAttention:
        r = np.random.default_rng(seed)
        shapes = [(width, hidden), (hidden,), (hidden, gate), (hidden, gate), (gate,), (hidden,), ()]
        return GatedAttention([r.normal(0, 0.7 / np.sqrt(s[0]) if len(s) > 1 else 0.1, s) * (len(s) > 0) for s in shapes])

    def forward(self, x: np.ndarray, starts: np.ndarray):
        """``starts``: the first row of each bag.  Returns logits and what the gradient needs."""
        w1, b1, v, u, a, c, b = self.w
        h = np.tanh(x @ w1 + b1)
        t, s = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        e = (t * s) @ a
        sizes = np.diff(np.append(starts, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        weight = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(h * weight[:, None], starts)
        return z @ c + b, (h, t, s, weight, z, sizes)

    def gradient(self, x, starts, y):
        logit, (h, t, s, weight, z, sizes) = self.forward(x, starts)
        w1, b1, v, u, a, c, b = self.w
        d = (1 / (1 + np.exp(-logit)) - y) / len(y)
        dz = np.repeat(d[:, None] * c, sizes, axis=0)
        dw = (dz * h).sum(axis=1)
        mean = np.add.reduceat(weight * dw, starts)
        de = weight * (dw - np.repeat(mean, sizes))
        dt, ds = de[:, None] * a * s * (1 - t * t), de[:, None] * a * t * s * (1 - s)
        dh = (dz * weight[:, None] + dt @ v.T + ds @ u.T) * (1 - h * h)
        return [x.T @ dh, dh.sum(axis=0), h.T @ dt, h.T @ ds, (t * s).T @ de, z.T @ d, d.sum()]

    def score(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x, starts)[0], -40, 40)))


def fit(bags: list[np.ndarray], y: np.ndarray, prior: float | None = None, epochs: int = 25, batch: int = 64, seed: int = 7) -> GatedAttention:
    """Adam over mini-batches of bags.  ``prior``: the share of label 1 at large,
    to which the intercept is moved back after training on a balanced sample."""
    net, r = GatedAttention.blank(seed=seed), np.random.default_rng(seed)
    if not len(y):
        net.w = [np.zeros_like(w) for w in net.w]
        return net
    m, q, step = [np.zeros_like(w) for w in net.w], [np.zeros_like(w) for w in net.w], 0
    if y.min() == y.max():
        net.w = [np.zeros_like(w) for w in net.w]
        net.w[-1] = np.float64(4 if y[0] else -4)
        return net
    for epoch in range(epochs):
        order = r.permutation(len(y))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            x = np.concatenate([bags[i] for i in own]).astype(np.float64)
            starts = np.cumsum([0, *(len(bags[i]) for i in own[:-1])])
            grads = net.gradient(x, starts, y[own])
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 0.0005
            for k, g in enumerate(grads):
                g = g + 1e-4 * net.w[k]
                m[k], q[k] = 0.9 * m[k] + 0.1 * g, 0.999 * q[k] + 0.001 * g * g
                net.w[k] = net.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(q[k] / (1 - 0.999**step)) + 1e-8)
    if prior is not None and 0 < prior < 1:
        share = y.mean()
        net.w[-1] = net.w[-1] + np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return net


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> GatedAttention:
    """Fit on the labelled documents outside the held-out fold."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cells = [pooled(encode_passages(t or ""), SAMPLE_PASSAGES).astype(np.float16).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cells, pa.binary()), b.column(2)], ["doc_id", "x", "y"])

    sample = labelled_sample(docs, labels, "quality", *HELD_OUT, per_class)
    rows = sample.mapInArrow(run, "doc_id long, x binary, y int").groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r")).select("doc_id", "r.*").collect()  # of texts that share an id, always the same one
    rows.sort(key=lambda r: r[0])
    bags = [np.frombuffer(r[1], dtype=np.float16).reshape(-1, WIDTH).astype(np.float32) for r in rows]
    known = labels.where((fold(HELD_OUT[0]) != HELD_OUT[1]) & F.col("quality").isNotNull())
    prior = known.agg(F.avg("quality")).first()[0]
    return fit(bags, np.array([r[2] for r in rows], dtype=np.float64), prior)


def score(docs: DataFrame, net: GatedAttention, name: str = "score") -> DataFrame:
    """``docs`` with one more column, the score in [0, 1]."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for t in b.column(at):
                x = encode_passages(t.as_py() or "")
                out.append(float(net.score(x, np.zeros(1, dtype=np.int64))[0]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def mil_quality(spark, sf_dir: str) -> DataFrame:
    """The query over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(fold(HELD_OUT[0]) == HELD_OUT[1], F.lit(False))
    return score(docs, net).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
