"""Toxicity with noisy-channel deobfuscation.

Writers hide words by leetspeak (``1d10t``), spacing (``i d i o t``) and
repetition (``stuuupid``).  A disguised stretch of text is read as a lattice of
what each character may stand for, and Viterbi search picks the reading that a
character trigram model and the channel's costs make likeliest.  The model is
counted over all documents.  The restored text is then scored by a logistic
model over hashed words and word beginnings that labelled documents select.

Counting and scoring are one pass each; what leaves the executors is bounded by
the alphabet (counts) and by ``PER_CLASS`` documents of ``SAMPLE_BINS`` features
(the labelled sample; of more features those with the least hashes are fitted on).

Defined cases: a null text counts as empty; an empty text gets the score of a
text without any known feature; a null ``doc_id`` is scored and not held out;
repeated rows get equal scores; an empty table gives an empty result; a sample
with one label only gives that label's share; without labels every score is
0.5; columns other than ``doc_id`` and ``text`` are not read.  Texts are used
whole, however long.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import fold
from corpusloom.llm.sampling import labelled_sample

PER_CLASS = 2000
SAMPLE_BINS = 1 << 14
HELD_OUT = (5, 0)  # modulus, remainder
FEATURES = 2048
BINS = 1 << 20
_SLAB = 1 << 20  # characters looked at at once

#: What a sign may stand for.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c",
}
SEPARATORS = " .-_*"
#: These part the words of a list as often as the letters of one.
LISTING = ",/"
#: What it costs to leave a run of a sign at the edge of a word as it is; three or more of one sign are emphasis.
PLAIN = {c: 5.0 if c.isdigit() or c in "@$" else 2.5 for c in LEET} | {"(": 0.5}

# ------------------------------------------------------------ the alphabet

_LATIN = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
_OTHER, _DIGIT = len(_LATIN) + 1, len(_LATIN) + 2
SIZE = _DIGIT + 1


def _codes() -> np.ndarray:
    table = np.zeros(0x3000, dtype=np.uint8)  # 0: whatever is between words
    for c in range(0x250, 0x3000):
        if chr(c).isalpha():
            table[c] = _OTHER
    for c in range(0x80, 0x250):
        if chr(c).isalpha():
            table[c] = _OTHER
    for k, c in enumerate(_LATIN):
        table[ord(c)] = k + 1
    table[ord("0") : ord("9") + 1] = _DIGIT
    return table


_CODE = _codes()
#: Of a byte of lower-cased text: 1 in letters, 2 a sign that may stand for one.
_BYTE = np.zeros(256, dtype=np.uint8)
_BYTE[97:123] = 1
_BYTE[128:] = 1
_BYTE[[ord(c) for c in LEET]] = 2


def points(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le"), dtype="<u4"), 0x2FFF)


def count_trigrams(text: str, into: np.ndarray) -> None:
    """Add the character trigrams of a lower-cased text, blanks at either end."""
    low = f" {text.lower()} "
    for at in range(0, len(low) - 2, _SLAB):
        c = _CODE[points(low[at : at + _SLAB + 2])].astype(np.int64)
        into += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)


@dataclass
class CharModel:
    """Interpolated trigram log-probabilities."""

    logp: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> CharModel:
        c3 = counts.reshape(SIZE, SIZE, SIZE).astype(np.float64)
        c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
        p1 = (c1 + 1) / (c1.sum() + SIZE)
        p2 = (c2 + 5 * p1) / (c2.sum(axis=1, keepdims=True) + 5)
        p3 = (c3 + 2 * p2) / (c3.sum(axis=2, keepdims=True) + 2)
        return CharModel(np.log(p3).astype(np.float32))


def count_model(docs: DataFrame) -> CharModel:
    """The character model of all texts; at most ``SIZE ** 3`` sums reach the driver."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(SIZE**3, dtype=np.int64)
        for b in batches:
            block, size = [], 0
            for t in b.column(0).to_pylist():
                block.append(t or "")
                size += len(block[-1])
                if size >= _SLAB:
                    count_trigrams(" ".join(block), total)
                    block, size = [], 0
            count_trigrams(" ".join(block), total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    rows = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SIZE**3, dtype=np.int64)
    counts[rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    return CharModel.of(counts)


# ------------------------------------------------------------ the channel

_L = r"[^\W\d_]"
_S = "[" + re.escape("".join(LEET)) + "]"
_R = rf"(?:{_L}|{_S})"
_I = "[a-z" + re.escape("".join(LEET)) + "]"
_BETWEEN = "[" + re.escape(SEPARATORS + LISTING) + "]"
_DISGUISED = re.compile(
    rf"(?P<spaced>(?:(?<!\S)|(?<=[(\[\"'])){_I}(?:{_BETWEEN}++{_I}){{2,}}(?![\w@$+|]))"  # s p 4 c e d
    rf"|(?P<signs>(?<!{_L})(?<!{_S})(?:{_S}++{_L}|{_L}++{_S}){_R}*+)"  # l33t
    rf"|(?<!{_L}){_L}*?({_L})\3\3{_L}*+"  # repeeeated
)
_LETTER = re.compile("[a-z]")


def looks_disguised(text: str) -> bool:
    """A quick look, on UTF-8 bytes, at whether any reading but the plain one can exist."""
    raw = np.frombuffer(f" {text} ".encode(), dtype=np.uint8)
    for at in range(0, len(raw), _SLAB):
        p = raw[max(0, at - 8) : at + _SLAB + 8]
        kind = _BYTE[p]
        letter = kind == 1
        if ((kind[1:-1] == 2) & (letter[:-2] | letter[2:])).any():
            return True
        if len(p) > 6:
            for n in (1, 2, 3):  # bytes of a letter
                same = p[n:] == p[:-n]
                run = same[n:] & same[:-n]
                for k in range(1, n):
                    run = run[: len(run) - 1] & run[1:]
                if (run & (letter if n == 1 else p >= 0xA0 + 0x20 * (n - 1))[: len(run)]).any():
                    return True
    own = np.zeros(0, dtype=np.int64)
    for at in range(0, len(raw), _SLAB):  # three letters or signs in a row, each by itself
        own = np.append(own[-3:], np.flatnonzero(_BYTE[raw[at : at + _SLAB]]) + at)
        if len(own) > 2:
            gap = np.diff(own) > 1
            lone = np.append(True, gap) & np.append(gap, True)
            letter = _BYTE[raw[own]] == 1
            if (lone[:-2] & lone[1:-1] & lone[2:] & (letter[:-2] | letter[1:-1] | letter[2:])).any():
                return True
    return False


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of a character: (what it may stand for, cost)."""
    out = []
    for m in re.finditer(r"(.)\1*", token, re.DOTALL):
        c, r = m.group(1), len(m.group())
        if c in LEET:
            ways = [(x, 0.3) for x in LEET[c]] + [(x * 2, 0.6) for x in LEET[c] if r > 1]
            out.append(ways + ([(c, 4.0)] if c.isdigit() else [("", 3.0), (c, 4.0)]))
        elif c in LISTING:
            out.append([("", 1.2), (c, 0.5)])
        elif c in SEPARATORS:
            out.append([("", 0.2), (" ", 2.0)])
        elif r == 1:
            out.append([(c, 0.0)])
        else:
            out.append([(c, 0.5 if r > 2 else 1.0), (c * 2, 0.5 if r > 2 else 0.0)])
    return out


@functools.lru_cache(maxsize=1 << 14)
def _code(c: str) -> int:
    p = ord(c)
    return int(_CODE[min(p, 0x2FFF)])


#: Runs after which paths are compared; what all of them share is written out, so that a path stays short.
_SETTLE = 1 << 14


def _words(chain: tuple | None) -> list[str]:
    out = []
    while chain:
        chain, emit = chain
        out.append(emit)
    out.reverse()
    return out


def _settle(chains: list[tuple | None], out: list[str]) -> list[tuple | None]:
    """Move the beginning that all chains share to ``out``; returns the chains without it."""
    lists = [_words(c) for c in chains]
    least, n = lists[0], min(map(len, lists))
    same = next((i for i in range(n) if any(x[i] != least[i] for x in lists)), n)
    out.append("".join(least[:same]))
    rest = []
    for x in lists:
        chain = None
        for emit in x[same:]:
            chain = (chain, emit)
        rest.append(chain)
    return rest


@dataclass
class Restorer:
    """Viterbi decoding with a memory of stretches already read, bounded in characters."""

    model: CharModel
    seen: dict[str, str] = field(default_factory=dict)
    most: int = 16_000_000
    held: int = 0

    def __post_init__(self) -> None:
        self.logp = self.model.logp.tolist()

    def _keep(self, token: str, got: str) -> str:
        size = len(token) + len(got)
        if size <= self.most // 1000:  # long stretches hardly come twice
            if self.held + size > self.most:
                self.seen.clear()
                self.held = 0
            self.seen[token] = got
            self.held += size
        return got

    def _step(self, state: tuple[int, int], value: float, emit: str) -> tuple[tuple[int, int], float]:
        i, j = state
        for c in emit:
            k = _code(c)
            value += self.logp[i][j][k]
            i, j = j, k
        return (i, j), value

    def decode(self, token: str) -> str:
        if (known := self.seen.get(token)) is not None:
            return known
        step, out = self._step, []
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for n, ways in enumerate(lattice(token), 1):
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for state, (value, chain) in paths.items():
                for emit, cost in ways:
                    at, v = step(state, value - cost, emit)
                    if at not in after or v > after[at][0]:
                        after[at] = (v, (chain, emit))
            paths = after
            if n % _SETTLE == 0:
                chains = _settle([c for _, c in paths.values()], out)
                paths = {at: (v, c) for (at, (v, _)), c in zip(paths.items(), chains, strict=True)}
        ends = [(value + self.logp[i][j][0], chain) for (i, j), (value, chain) in paths.items()]
        best = max(v for v, _ in ends)
        return self._keep(token, "".join(out) + max("".join(_words(c)) for v, c in ends if v == best))

    def read(self, token: str) -> str:
        """The likeliest reading of letters and signs, where signs at either edge may also be punctuation.

        A path may begin after any leading run and end before any trailing one,
        at the cost of the runs left out; if all are, the token stays as it is.
        """
        if (known := self.seen.get(token)) is not None:
            return known
        logp, step, out = self.logp, self._step, []
        runs = [m.group() for m in re.finditer(r"(.)\1*", token, re.DOTALL)]
        plain = [0.0 if c[0] not in LEET or (len(c) > 2 and not c[0].isdigit()) else PLAIN[c[0]] for c in runs]
        first = next(i for i, c in enumerate(runs) if c[0] not in LEET)
        last = len(runs) - next(i for i, c in enumerate(reversed(runs)) if c[0] not in LEET)
        left, right = 0.0, sum(plain[last:])
        paths: dict[tuple[int, int], tuple[float, int, tuple | None]] = {}  # value, first run, chain of emissions
        best: tuple = (-np.inf, 0, 0, None)
        for k, ways in enumerate([*lattice(token), None]):
            if k <= first and ((0, 0) not in paths or -left > paths[0, 0][0]):
                paths[0, 0] = (-left, k, None)
            if k >= last:
                for (i, j), (value, start, chain) in paths.items():
                    if (v := value + logp[i][j][0] - right) > best[0]:
                        best = (v, start, k, chain)
            if ways is None:
                break
            if k < first:
                left += plain[k]
            if k >= last:
                right -= plain[k]
            after: dict[tuple[int, int], tuple[float, int, tuple | None]] = {}
            for state, (value, start, chain) in paths.items():
                for emit, cost in ways:
                    at, v = step(state, value - cost, emit)
                    if at not in after or v > after[at][0]:
                        after[at] = (v, start, (chain, emit))
            paths = after
            if first < k < last and k % _SETTLE == 0:
                chains = _settle([c for _, _, c in paths.values()], out)
                paths = {at: (v, start, c) for (at, (v, start, _)), c in zip(paths.items(), chains, strict=True)}
        _, start, stop, chain = best
        got = "".join([*runs[:start], *out, *_words(chain), *runs[stop:]])
        if start == first and stop == last and not any(c[0] in LEET or len(c) > 2 for c in runs[first:last]):
            got = token
        return self._keep(token, got)

    def _one(self, m: re.Match) -> str:
        token = m.group()
        if m["spaced"]:
            return self.decode(token) if _LETTER.search(token) else token
        return self.read(token) if m["signs"] else self.decode(token)

    def restore(self, text: str) -> str:
        low = text.lower()
        if not looks_disguised(low):
            return low
        return "\n".join(_DISGUISED.sub(self._one, x) if looks_disguised(x) else x for x in low.split("\n"))


# ------------------------------------------------------------ the score

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LENGTHS = (3, 4, 5, 6)
#: Letters above which a word counts as run together.
LONG_WORD = 24
#: Blocks of scripts that are written without blanks between words.
_UNSPACED = ((0x0E00, 0x0F00), (0x0F00, 0x10A0), (0x1780, 0x1800), (0x1950, 0x1AB0), (0x2E80, 0xA000), (0xA9E0, 0xAA80), (0xF900, 0xFB00), (0xFF66, 0xFFA0), (0x1B000, 0x1B300), (0x20000, 0x33480))


@functools.cache
def _letters() -> np.ndarray:
    """Of every code point: 0 between words, 1 a letter or mark, 2 one of a script without blanks."""
    table = np.zeros(0x110000, dtype=np.uint8)
    table[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] in "LM"]] = 1
    for low, high in _UNSPACED:
        table[low:high] *= 2
    return table


def _parts(text: str) -> Iterator[str]:
    """A text in parts of about ``_SLAB`` characters that no word crosses."""
    at = 0
    while at < len(text):
        end = at + _SLAB
        while end < len(text):
            gaps = np.flatnonzero(_letters()[np.frombuffer(text[max(at, end - _SLAB) : end].encode("utf-32-le", "surrogatepass"), dtype="<u4")] == 0)
            if len(gaps):
                end = max(at, end - _SLAB) + int(gaps[-1]) + 1
                break
            end += _SLAB
        yield text[at:end]
        at = end


def features(text: str) -> np.ndarray:
    """Distinct bins of the whole words and of word beginnings of a restored text.

    Words end at code points that are no letters.  Run-together words, and all
    in scripts without blanks, give the n-grams at every place too, under the
    hashes of word beginnings.
    """
    found = [np.zeros(0, dtype=np.uint32)]
    for part in _parts(text):
        p = np.frombuffer(f" {part} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
        kind = _letters()[p]
        letter = kind > 0
        edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        start, stop = edge[::2], edge[1::2]
        if not len(start):
            continue
        value = (p.astype(np.uint64) + np.uint64(1)) * _P
        value ^= value >> np.uint64(31)
        power, back = np.full(len(p), _P), np.full(len(p), _P_INVERSE)
        power[0] = back[0] = 1
        back = np.cumprod(back)
        total = np.append(np.uint64(0), np.cumsum(value * np.cumprod(power)))

        def add(begin, end, n, total=total, back=back):
            h = (total[end] - total[begin]) * back[begin]  # the same wherever the letters stand
            h = (h ^ (h >> np.uint64(29)) ^ np.uint64(n)) * _P
            h = (h ^ (h >> np.uint64(32))) * _P
            h = h >> np.uint64(64 - 20)
            found.append(np.unique(h).astype(np.uint32) if len(h) > _SLAB else h.astype(np.uint32))

        size = stop - start
        add(start, stop, 99)
        for n in _LENGTHS:
            own = start[size >= n]
            add(own, own + n, n)
        unspaced = np.add.reduceat((kind == 2).astype(np.int64), edge)[::2] > 0
        long = (size > LONG_WORD) | unspaced
        if long.any():
            sizes, ends = size[long], stop[long]
            at = np.arange(sizes.sum()) + np.repeat(start[long] - np.cumsum(sizes) + sizes, sizes)
            rest = np.repeat(ends, sizes) - at
            pairs = at[(rest >= 2) & np.repeat(unspaced[long], sizes)]
            add(pairs, pairs + 2, 2)
            for n in _LENGTHS:
                own = at[rest >= n]
                add(own, own + n, n)
    return np.unique(np.concatenate(found))


@dataclass
class Linear:
    bins: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def score(self, found: np.ndarray) -> float:
        at = np.searchsorted(self.bins, found)
        at = np.minimum(at, max(len(self.bins) - 1, 0))
        z = self.bias + (float(self.weights[at[self.bins[at] == found]].sum()) if len(self.bins) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(bags: list[np.ndarray], y: np.ndarray, prior: float | None, most: int = FEATURES) -> Linear:
    """Logistic regression on the bins that tell the labels apart best."""
    none = np.zeros(0, dtype=np.uint32)
    if not len(y) or y.min() == y.max():
        return Linear(none, np.zeros(0), 0.0 if not len(y) else (4.0 if y[0] else -4.0))
    pos, neg = max(y.sum(), 1), max((1 - y).sum(), 1)
    df = np.zeros((2, BINS))
    for bag, label in zip(bags, y, strict=True):
        df[int(label), bag] += 1
    p, q = (df[1] + 0.5) / (pos + 1), (df[0] + 0.5) / (neg + 1)
    z = (np.log(p / q)) / np.sqrt(1 / (df[1] + 0.5) + 1 / (df[0] + 0.5))
    z[df.sum(axis=0) < 5] = 0
    bins = np.sort(np.argsort(-np.abs(z), kind="stable")[:most])
    bins = bins[z[bins] != 0].astype(np.uint32)
    x = np.zeros((len(y), len(bins)), dtype=np.float32)
    for row, bag in zip(x, bags, strict=True):
        row[np.isin(bins, bag, assume_unique=True)] = 1
    w, b = np.zeros(len(bins), dtype=np.float32), np.float32(0)
    y = y.astype(np.float32)
    m = np.zeros(len(bins) + 1, dtype=np.float32)
    q2 = np.zeros(len(bins) + 1, dtype=np.float32)
    for step in range(1, 301):  # full-batch Adam
        d = 1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40))) - y
        g = np.append(d @ x / np.float32(len(y)) + np.float32(1e-4) * w, d.mean()).astype(np.float32)
        m, q2 = 0.9 * m + 0.1 * g, 0.999 * q2 + 0.001 * g * g
        move = (0.05 * (m / (1 - 0.9**step)) / (np.sqrt(q2 / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        w, b = w - move[:-1], b - move[-1]
    if prior is not None and 0 < prior < 1:  # the sample is balanced, the corpus is not
        b += np.log(prior / (1 - prior)) - np.log(pos / neg)
    return Linear(bins, w.astype(np.float64), float(b))


@dataclass
class Scorer:
    restorer: Restorer
    linear: Linear

    def score(self, text: str) -> float:
        return self.linear.score(features(self.restorer.restore(text)))


def some(bins: np.ndarray) -> np.ndarray:
    """At most ``SAMPLE_BINS`` of a document's bins, the same ones in all documents."""
    if len(bins) <= SAMPLE_BINS:
        return bins
    order = np.argsort(bins * np.uint32(0x9E3779B1), kind="stable")  # a hash of a hash
    return np.sort(bins[order[:SAMPLE_BINS]])


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Scorer:
    """Count the character model over all of ``docs``, then fit on labelled ones
    outside the held-out fold."""
    model = count_model(docs)

    def run(batches):
        import pyarrow as pa

        restorer = Restorer(model)
        for b in batches:
            cells = [some(features(restorer.restore(t or ""))).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cells, pa.binary()), b.column(2)], ["doc_id", "x", "y"])

    sample = labelled_sample(docs, labels, "toxic", *HELD_OUT, per_class)
    rows = sample.mapInArrow(run, "doc_id long, x binary, y int").groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r")).select("doc_id", "r.*").collect()
    rows.sort(key=lambda r: r[0])  # of texts that share an id, always the same one
    known = labels.where((fold(HELD_OUT[0]) != HELD_OUT[1]) & F.col("toxic").isNotNull())
    prior = known.agg(F.avg("toxic")).first()[0]
    bags = [np.frombuffer(r[1], dtype=np.uint32) for r in rows]
    return Scorer(Restorer(model), fit(bags, np.array([r[2] for r in rows], dtype=np.float64), prior))


def score(docs: DataFrame, scorer: Scorer, name: str = "score") -> DataFrame:
    """``docs`` with one more column, the score in [0, 1]."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = [scorer.score(t.as_py() or "") for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def toxicity(spark, sf_dir: str) -> DataFrame:
    """The query over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scorer = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(fold(HELD_OUT[0]) == HELD_OUT[1], F.lit(False))
    return score(docs, scorer).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
