"""BPE encoding and decoding with a pair occurrence index.

A worker gathers the distinct unseen words of a block of its partition, lays
their symbols out in one array, and maps every mergeable pair to all positions
where it stands.  Active ranks are taken in ascending order from a heap; one
rank is applied to all its positions at once, and only the lists of pairs that
the merge touched are updated.  Finished words go to a bounded cache.  Words
are found by a pattern of our own; texts with characters on which Unicode
versions may differ are split by the library's normaliser and pattern.

Defined cases: a null text counts as empty (no tokens, empty decoded text); the
strings of special tokens stand for their ids wherever they occur in a text,
as in the tokenizers library; a null ``doc_id`` is passed through; repeated
rows give repeated results; an empty table gives an empty result; columns
other than ``doc_id`` and ``text`` are not read.  Texts of any length are cut at
white space into chunks for memory only, which changes no token.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

#: White space as the Unicode property has it; Python's own \s has four more.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: All but common characters.  Unicode versions differ on the class and the lower
#: case of some of these, so the library's own normaliser and pattern split such texts.
_RARE = re.compile("[^\x00-\u0557\u2010-\u2027\u20a0-\u20bf\u3001-\u303f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e]")
#: Characters that the library splits at once; it keeps several words of memory for each.
_RARE_CHARS = 1 << 16
#: Characters of text that a worker lays out at once, and words it remembers.
BLOCK_CHARS = 4_000_000
CACHE_CHARS = 8_000_000
#: Where a text may be cut besides blanks: words and signs never share a pretoken, and nothing composes across.
_BREAK = re.compile("[,;:.!?)}\\]](?=[A-Za-z0-9])|[\u3001\u3002\uff0c\uff01\uff1f\uff1b\uff1a](?=[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3])")
_NONE = np.int64(1 << 40)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class PairIndexBpe:
    """A word-level BPE vocabulary file with an end-of-word suffix."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.normal = Tokenizer.from_file(path).normalizer
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.rare_words = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = (self.left << 24) | self.right
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of]
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WS}\p{{L}}\p{{N}}]+")
        self.ascii_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
        self.cache: dict[str, tuple[bytes, str]] = {}
        self.cached = 0  # characters of its words

    def split(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_words.findall(text.lower())
        if _RARE.search(text):
            parts = (self.normal.normalize_str(part) for part in chunks(text, _RARE_CHARS))
            return [w for part in parts for w, _ in self.rare_words.pre_tokenize_str(part)]
        return self.words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 24) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], _NONE)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Token ids of each word, all merged together by ascending rank."""
        raw = [w.encode("utf-8") for w in words]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)))
        n = len(data)
        sym = np.empty(n + 1, dtype=np.int64)
        sym[:n] = self.inner[data]
        sym[ends - 1] = self.final[data[ends - 1]]
        sym[n] = -1  # stands for "no neighbour"
        after = np.arange(1, n + 2, dtype=np.int64)
        before = np.arange(-1, n, dtype=np.int64)
        after[ends - 1] = n
        before[0] = n
        before[ends[:-1]] = n
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            rank = self._ranks(sym[at], sym[after[at]])
            use = rank < _NONE
            at, rank = at[use], rank[use]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            starts = np.flatnonzero(np.diff(rank, prepend=-1))
            for r, part in zip(rank[starts].tolist(), np.split(at, starts[1:]), strict=False):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        enter(np.arange(n, dtype=np.int64))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            at = at[(sym[at] == a) & (sym[after[at]] == b)]
            if a == b and len(at) > 1:  # in a run the leftmost pair wins
                keep, gone = [], -1
                for p in np.sort(at).tolist():
                    if p != gone:
                        keep.append(p)
                        gone = int(after[p])
                at = np.array(keep, dtype=np.int64)
            if not len(at):
                continue
            eaten = after[at]
            beyond = after[eaten]
            sym[at] = self.made[r]
            sym[eaten] = -2
            after[at] = beyond
            before[beyond] = at
            touched = np.unique(np.concatenate((before[at], at)))
            enter(touched[touched < n])
        live = sym[:n] >= 0
        upto = np.cumsum(live)[ends - 1]
        return np.split(sym[:n][live], upto[:-1]) if len(words) else []

    def learn(self, words: set[str]) -> None:
        """Put words into the cache: their ids as bytes and their decoded text."""
        todo = [w for w in words if w not in self.cache]
        if not todo:
            return
        size = sum(map(len, todo))
        if self.cached + size > CACHE_CHARS:
            self.cache.clear()
            todo = list(words)
            size, self.cached = sum(map(len, todo)), 0
        self.cached += size
        tokens = self.tokens
        for w, ids in zip(todo, self.encode_words(todo), strict=True):
            self.cache[w] = (ids.astype("<u4").tobytes(), " ".join([tokens[i] for i in ids.tolist()]))

    def pieces(self, texts: list[str]) -> Iterator[tuple[int, list[bytes], list[str]]]:
        """(text number, ids as bytes, decoded parts) for chunk after chunk."""
        block: list[tuple[int, str]] = []
        size = 0
        for k, text in enumerate(texts):
            for chunk in chunks(text, BLOCK_CHARS):
                block.append((k, chunk))
                size += len(chunk)
                if size >= BLOCK_CHARS:
                    yield from self._block(block)
                    block, size = [], 0
        yield from self._block(block)

    def _block(self, block):
        split = []
        for k, text in block:
            parts = self.cut_special.split(text) if self.cut_special else [text]
            for i, part in enumerate(parts):
                split.append((k, part if i % 2 else None, [] if i % 2 else self.split(part)))
        self.learn(set().union(*(w for _, _, w in split)))
        for k, special, words in split:
            if special is not None:
                yield k, [self.special[special].to_bytes(4, "little")], [special]
            elif words:
                got = [self.cache[w] for w in words]
                yield k, [x[0] for x in got], [x[1] for x in got]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(b for _, ids, _ in self.pieces([text]) for b in ids), dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces: these vocabularies name no decoder."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def chunks(text: str, most: int) -> Iterator[str]:
    """Cut a text before an ASCII blank, where no word can continue, or else behind a sign before a letter."""
    at = 0
    while len(text) - at > most:
        end = max(text.rfind(" ", at + 1, at + most), text.rfind("\n", at + 1, at + most))
        if end < 0 and (m := _BREAK.search(text, at + most // 2, at + most)):
            end = m.end()
        if end < 0:
            end = min((x for x in (text.find(" ", at + most), text.find("\n", at + most)) if x >= 0), default=len(text))
            if m := _BREAK.search(text, at + most, end):
                end = m.end()
        yield text[at:end]
        at = end
    yield text[at:]


@functools.lru_cache(maxsize=2)
def load(path: str) -> PairIndexBpe:
    return PairIndexBpe(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<long> and decoded text for every row."""

    def run(batches):
        import pyarrow as pa

        bpe = load(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            ids, decoded = [[] for _ in texts], [[] for _ in texts]
            for k, b, d in bpe.pieces(texts):
                ids[k].extend(b)
                decoded[k].extend(d)
            rows = [np.frombuffer(b"".join(x), dtype="<u4").astype(np.int64) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.int64())), pa.array([" ".join(d) for d in decoded])],
                ["doc_id", "ids", "decoded"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<long>, decoded string")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text."""

    def run(batches):
        import pyarrow as pa

        bpe = load(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            count = [0] * len(texts)
            ids = [hashlib.sha256() for _ in texts]
            decoded = [hashlib.sha256() for _ in texts]
            for k, b, d in bpe.pieces(texts):
                joined = b"".join(b)
                ids[k].update(joined)
                decoded[k].update((" " if count[k] else "").encode() + " ".join(d).encode("utf-8"))
                count[k] += len(joined) // 4
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(count, pa.int64()),
                    pa.array([h.hexdigest() for h in ids]),
                    pa.array([h.hexdigest() for h in decoded]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def bpe_codec(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """The query over all of ``documents``."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
