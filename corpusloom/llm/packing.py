"""Best-fit packing of token sequences with Martello-Toth dominance reduction.

Packing depends on lengths only, and there are at most ``capacity`` different
ones, so the instance is a histogram of bounded size.  The driver plans on it:
sets of up to three lengths that provably dominate every alternative are fixed
for good, as often as the counts allow; what is left is packed best-fit
decreasing, a whole run of equal bins at a time.  The plan is a list of runs
(length, first rank, number of pieces, first sequence ...).  Every piece then
takes its place from its rank among the pieces of its length; ranks come from
salted windows with a prefix sum, so no length meets in one task.

Defined cases: a null text counts as empty and still has its end token; the
strings of special tokens in a text stand for their ids, as in the tokenizers
library; repeated rows are packed as often as they occur; a null ``doc_id`` is
an id like any other; an empty table gives an empty result; columns other than
``doc_id`` and ``text`` are not read; texts of any length are cut into pieces.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.bpe_index import byte_alphabet
from corpusloom.llm.common import cut

CAPACITY = 2048
END_ID = 0
#: Rows that a rank window holds on average at most.
WINDOW_ROWS = 1000
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Blanks in a row from which they are cut off by rule, for the pattern backtracks over each of them.
LONG_BLANK = 100_000
_BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_BLANKS = re.compile(rf"(?<!{_BLANK}){_BLANK}{{{LONG_BLANK},}}+")  # tried once a run

# ---------------------------------------------------------------- tokens


class ByteBpe:
    """A byte-level vocabulary file, run by the merge loop of tiktoken."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_alphabet())}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t in self.special:
            ranks.pop(t.encode(), None)
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.bpe = tiktoken.Encoding("file", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> np.ndarray:
        """Ids of a text without special tokens; of a long run of blanks all but the one before a word form a pretoken."""
        if len(text) < LONG_BLANK:
            return self.bpe.encode_to_numpy(text)
        got, at = [], 0
        for m in _BLANKS.finditer(text):
            stop = m.end() - (m.end() < len(text))
            got += [self.bpe.encode_to_numpy(text[at : m.start()]), np.array(self.bpe._encode_single_piece(text[m.start() : stop]), "<u4")]
            at = stop
        return np.concatenate([*got, self.bpe.encode_to_numpy(text[at:])])

    def encode(self, text: str) -> np.ndarray:
        if self.cut_special is None or not self.cut_special.search(text):
            return self._plain(text).astype("<u4")
        parts = self.cut_special.split(text)
        got = [np.array([self.special[p]], "<u4") if i % 2 else self._plain(p) for i, p in enumerate(parts)]
        return np.concatenate(got).astype("<u4")


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be short."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches):
        import pyarrow as pa

        bpe = load(path)
        end = np.array([end_id], "<u4")
        for batch in batches:
            out: list[list] = [[] for _ in range(5 + with_ids)]
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate((bpe.encode(t.as_py() or ""), end))
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    part = ids[start : start + length]
                    row = (d, k, start, length, zlib.crc32(part.tobytes()))
                    for c, v in zip(out, (*row, part.astype(np.int64)) if with_ids else row, strict=True):
                        c.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names[: len(out)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


# ---------------------------------------------------------------- the plan


@dataclass(frozen=True)
class Run:
    """Pieces ``first .. first + n`` of one length: ``per`` in each of the
    sequences from ``sequence`` on, the first of them at ``offset``."""

    length: int
    first: int
    n: int
    sequence: int
    per: int
    offset: int


class _Plan:
    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.sizes = sorted(self.left)
        self.used = dict.fromkeys(self.left, 0)
        self.runs: list[Run] = []
        self.sequences = 0

    def take(self, length: int, n: int, sequence: int, per: int, offset: int) -> None:
        self.runs.append(Run(length, self.used[length], n, sequence, per, offset))
        self.used[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.sizes.remove(length)

    def fix(self, members: list[int], times: int) -> None:
        """``times`` new sequences that each hold these lengths."""
        offset = 0
        for length in dict.fromkeys(members):
            per = members.count(length)
            self.take(length, times * per, self.sequences, per, offset)
            offset += per * length
        self.sequences += times

    def dominating(self, top: int) -> list[int] | None:
        """A set with ``top`` that dominates all sets with ``top``, if one of at most three is known to."""
        room = self.capacity - top
        free = [s for s in self.sizes[: bisect.bisect_right(self.sizes, room)] if s != top or self.left[top] > 1]
        if not free:
            return [top]
        best = free[-1]
        if best == room:
            return [top, best]  # fills the rest exactly: whatever else fits adds up to no more
        two = self._smallest(top, 2)
        if two is None or sum(two) > room:
            return [top, best]  # only one more fits, and this is the largest
        three = self._smallest(top, 3)
        if three is not None and sum(three) <= room:
            return None  # sets of four are not compared
        pair = self._best_pair(top, free, room)
        if pair is None or sum(pair) <= best:
            return [top, best]
        if max(pair) == best:
            return [top, *pair]  # the larger holds any single, both together any pair
        return None

    def _spare(self, top: int, size: int) -> int:
        return self.left[size] - (size == top)

    def _smallest(self, top: int, k: int) -> list[int] | None:
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(k - len(out), self._spare(top, s))
            if len(out) == k:
                return out
        return None

    def _best_pair(self, top: int, free: list[int], room: int) -> tuple[int, int] | None:
        """The pair with the largest sum that fits; of equal sums the one with the larger member."""
        best, low, high = None, 0, len(free) - 1
        while low <= high:
            a, b = free[low], free[high]
            if a + b > room or (a == b and self._spare(top, a) < 2):
                high -= 1
            else:
                if best is None or a + b > sum(best):
                    best = (a, b)
                low += 1
        return best

    def reduce(self) -> None:
        """Fix dominating sets from the largest length down."""
        for top in sorted(self.left, reverse=True):
            while self.left.get(top):
                members = self.dominating(top)
                if members is None:
                    break
                self.fix(members, min(self.left[s] // members.count(s) for s in set(members)))

    def best_fit(self) -> None:
        """Best-fit decreasing; bins of equal room are filled a run at a time."""
        rooms: list[int] = []
        bins: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, how many)

        def put(room: int, first: int, n: int) -> None:
            if n and room:
                if room not in bins:
                    bisect.insort(rooms, room)
                    bins[room] = []
                bins[room].append((first, n))

        for length in sorted(self.left, reverse=True):
            while n := self.left.get(length, 0):
                k = bisect.bisect_left(rooms, length)
                if k < len(rooms):
                    room = rooms[k]
                    first, there = bins[room].pop()
                    if not bins[room]:
                        del bins[room]
                        rooms.pop(k)
                else:
                    room, first = self.capacity, self.sequences
                    there = -(-n // (room // length))
                    self.sequences += there
                per = room // length
                full = min(there, n // per)
                if full:
                    self.take(length, full * per, first, per, self.capacity - room)
                    put(room - per * length, first, full)
                rest = min(n - full * per, per) if full < there else 0
                if rest:
                    self.take(length, rest, first + full, rest, self.capacity - room)
                    put(room - rest * length, first + full, 1)
                put(room, first + full + (rest > 0), there - full - (rest > 0))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """Runs for a histogram of lengths, and the number of sequences."""
    p = _Plan(counts, capacity)
    p.reduce()
    p.best_fit()
    return p.runs, p.sequences


# ---------------------------------------------------------------- placing


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (doc_id, piece, start, length, ids_crc32; a written table) with sequence_id and offset."""
    counts = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}  # at most `capacity` rows
    runs, _ = plan(counts, capacity)
    # windows of a length by its number of pieces; the row's place takes part, so that a repeated row is spread too
    salts = F.array(*[F.lit(max(1, -(-counts.get(n, 0) // WINDOW_ROWS))) for n in range(capacity + 1)])
    row = F.monotonically_increasing_id()  # the same each time, for ``parts`` is a table that was written
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", row), F.element_at(salts, F.col("length").cast("int") + 1)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("turn", F.row_number().over(order) - 1).join(base, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("turn")).cast("long").alias("rank"))

    runs = sorted(runs, key=lambda r: (r.length, r.first))
    cols = np.array([(r.length, r.first, r.sequence, r.per, r.offset) for r in runs], dtype=np.int64).reshape(-1, 5)

    def run(batches):
        import pyarrow as pa

        starts = np.searchsorted(cols[:, 0], np.arange(capacity + 2))
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.empty(len(length), dtype=np.int64)
            for n in np.unique(length):
                own = length == n
                lo, hi = starts[n], starts[n + 1]
                at[own] = lo + np.searchsorted(cols[lo:hi, 1], rank[own], side="right") - 1
            r = cols[at]
            k = rank - r[:, 1] if len(at) else rank
            sequence, offset = r[:, 2] + k // r[:, 3], r[:, 4] + (k % r[:, 3]) * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"]
            )

    return ranked.mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Where every piece of every document goes."""
    return place(cut(pieces(docs, path, capacity, end_id)), capacity)


def sequences(docs: DataFrame, placed: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The packed ids themselves: sequence_id, doc_ids and at most ``capacity`` ids.

    ``doc_id`` must be unique here, for it links pieces to their places.
    """
    full = pieces(docs, path, capacity, end_id, with_ids=True).select("doc_id", "piece", "ids")
    both = placed.join(full, ["doc_id", "piece"])
    rows = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))  # no more than a sequence holds
    return both.groupBy("sequence_id").agg(rows.alias("r")).select(
        "sequence_id", F.col("r.doc_id").alias("doc_ids"), F.flatten("r.ids").alias("ids")
    )


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def best_fit_packing(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """The query over all of ``documents``."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), path or default_path())
