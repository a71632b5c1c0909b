"""Token counts by rank-synchronous array merging.

Pre-tokens that a worker hasn't met yet are held together as one ragged numpy
array of symbols.  In each round every sequence applies its own lowest-rank
pair at all places where it occurs, and all sequences do so at once; sequences
without a mergeable pair leave.  A count is the number of symbols that remain.
A sequence longer than LONG keeps its pairs by rank in a heap and applies all
places of the lowest rank together, which costs L log L instead of one pass
over the whole sequence for each round.

Defined results: null counts as the empty text (0 bytes, 0 tokens); rows that
repeat are counted each; any other columns of the input are ignored unless
they're asked for in `keep`.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from pagelattice.session import small_batches

LONG = 512
CACHE_ENTRIES = 800_000

#: The byte-level pre-tokeniser's pattern.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files of byte-level BPE."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class MergeTable:
    """Ranks of pairs of symbol ids, found in a two-slot hash table of arrays."""

    SLOT_BITS = 22
    MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

    def __init__(self, definition: str):
        spec = json.loads(definition)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.span = len(vocab) + len(spec["added_tokens"]) + 1
        key = np.array([vocab[a] * self.span + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.made = made
        self.keys = np.append(key, -1)
        # two hash slots for each pair; a pair that finds both taken gets neither
        self.slots = np.full((2, 1 << self.SLOT_BITS), len(key), np.int64)
        rest = np.arange(len(key))
        for k in range(2):
            at = self._slot(key[rest], k)
            self.slots[k, at[::-1]] = rest[::-1]
            rest = rest[self.slots[k, at] != rest]
        if len(rest):
            raise ValueError("pairs without a slot: raise SLOT_BITS")
        self.of_byte = np.zeros(256, np.int64)
        for shown, byte in byte_symbols().items():
            self.of_byte[byte] = vocab[shown]
        self.none = len(pairs)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.index = dict(zip(key.tolist(), range(len(pairs))))

    def _slot(self, key: np.ndarray, k: int) -> np.ndarray:
        return ((key.astype(np.uint64) * self.MULTIPLIERS[k]) >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.span + right
        out = np.full(len(key), self.none, np.int64)
        for k in range(2):
            at = self.slots[k, self._slot(key, k)]
            out = np.where(self.keys[at] == key, at, out)
        return out

    def count_ragged(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word after all merges."""
        sizes = np.array([len(w) for w in words], np.int64)
        left = sizes.copy()
        symbol = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        while len(symbol):
            rank = np.full(len(symbol), self.none, np.int64)
            inner = owner[:-1] == owner[1:]
            rank[:-1][inner] = self.rank(symbol[:-1][inner], symbol[1:][inner])
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            lowest = np.minimum.reduceat(rank, starts)
            runs = np.diff(np.append(starts, len(owner)))
            live = np.repeat(lowest < self.none, runs)
            hit = (rank == np.repeat(lowest, runs)) & live
            # of places that overlap (a a a), the first, third and so on merge
            change = np.diff(hit.astype(np.int8), prepend=0)
            run_start = np.maximum.accumulate(np.where(change == 1, np.arange(len(hit)), 0))
            hit &= (np.arange(len(hit)) - run_start) % 2 == 0
            symbol = np.where(hit, self.made[np.minimum(rank, self.none - 1)], symbol)
            drop = np.zeros(len(hit), bool)
            drop[1:] = hit[:-1]
            left -= np.bincount(owner[drop], minlength=len(left))
            keep = live & ~drop
            symbol, owner = symbol[keep], owner[keep]
        return left

    def count_long(self, word: bytes) -> int:
        """The same for one long word: places are kept by rank."""
        symbol = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[int, list[int]] = {}
        queue: list[int] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < n:
                r = self.index.get(symbol[k] * self.span + symbol[after[k]])
                if r is not None:
                    if r not in places:
                        places[r] = []
                        heapq.heappush(queue, r)
                    places[r].append(k)

        for k in range(n - 1):
            offer(k)
        alive = n
        while queue:
            rank = heapq.heappop(queue)
            made = int(self.made[rank])
            for k in sorted(places.pop(rank)):
                if symbol[k] < 0 or after[k] >= n or self.index.get(symbol[k] * self.span + symbol[after[k]]) != rank:
                    continue
                gone = after[k]
                symbol[k], symbol[gone] = made, -1
                after[k] = after[gone]
                if after[k] < n:
                    before[after[k]] = k
                alive -= 1
                offer(before[k])
                offer(k)
        return alive


@lru_cache(maxsize=2)
def table_of(definition: str) -> MergeTable:
    return MergeTable(definition)


class Counter:
    """Counts the tokens of texts; a bounded cache holds the counts of pieces met before.

    A single space between two characters that aren't white space always begins
    a pre-token, so texts without longer white space are cut there first.
    """

    def __init__(self, table: MergeTable):
        self.table = table
        self.pattern = regex.compile(PRETOKEN)
        self.wide = re.compile(r" \s|\s ")
        self.special = re.compile("|".join(map(re.escape, table.special))) if table.special else None
        self.cache: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        if self.wide.search(text):
            return self.pattern.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]

    def learn(self, new: list[str]) -> None:
        split = [self.pattern.findall(piece) for piece in new]
        known = dict.fromkeys(pre for own in split for pre in own)
        short: list[str] = []
        coded: list[bytes] = []
        for pre in known:
            raw = pre.encode("utf-8", "surrogatepass")
            if len(raw) > LONG:
                known[pre] = self.table.count_long(raw)
            else:
                short.append(pre)
                coded.append(raw)
        for at in range(0, len(short), 20_000):
            known.update(zip(short[at : at + 20_000], self.table.count_ragged(coded[at : at + 20_000]).tolist()))
        counts = [sum(map(known.__getitem__, own)) for own in split]
        self.cache.update(zip(new, counts))

    def count(self, texts: list[str | None]) -> list[int]:
        out, held, size = [], [], 0
        for own, group in groupby(texts, key=lambda t: len(t or "") > 1 << 20):
            for text in group:
                held.append(text or "")
                size += len(held[-1])
                if size > 1 << 21 or own:
                    out += self._count(held)
                    held, size = [], 0
        return out + self._count(held)

    def _count(self, texts: list[str]) -> list[int]:
        cut, added = [], []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            added.append(len(parts) - 1)
            cut.append([p for part in parts if part for p in self.pieces(part)])
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        new = set().union(*cut).difference(self.cache) if cut else set()
        self.learn(list(new))
        known = self.cache.__getitem__
        out = [n + sum(map(known, own)) for n, own in zip(added, cut)]
        for piece in [p for p in new if len(p) > 64]:
            del self.cache[piece]
        return out


def read_definition(path: str) -> str:
    """The tokenizer file, read once on the driver; its size doesn't depend on the data."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each row's whole text."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    definition = spark.sparkContext.broadcast(read_definition(tokenizer_path))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(table_of(definition.value))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = counter.count(texts)
            size = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
