"""Benchmark decontamination: a prefix-filtered set join, verified by windows.

A window of an item is WINDOW consecutive words (a shorter item is one window).
As a set of SHINGLE-word shingles it must be contained whole, so the prefix that
a match can't avoid is one token: the window's rarest shingle, by counts over
all documents.  Documents' shingles are joined with those tokens; a pair passes
on if the window, laid at the token's position, lies inside the document
(length and positional bounds), and then word by word comparison verifies it.

Benchmarks are taken in blocks of at most `block_windows` windows; only one
block at a time is sent to the executors, and rows pass one block after
another, so a benchmark of any size stays in bounded memory.  An item of more
windows than a block is cut into parts that share WINDOW - 1 words.

Defined results: null or empty texts have no words; items without a word have
no window; equal item ids count as one item; a null item id is named `null`;
rows that repeat are judged each; find_contamination ignores extra columns, and
drop_contaminated returns the columns of its input, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.textkernel import ALNUM, combine, mix, words_of
from pagelattice.session import small_batches

WINDOW, SHINGLE = 10, 4
BLOCK_WINDOWS = 500_000
_BITS = np.uint64((1 << 22) - 1)


@dataclass
class Windows:
    """Distinct windows: words (padded), length, and their items as a ragged list."""

    words: np.ndarray
    sizes: np.ndarray
    items: list[list[str]]

    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shingle, window, offset) of all shingles; a window of few words is one shingle."""
        shingle, window, offset = [], [], []
        for m in np.unique(self.sizes):
            rows = np.flatnonzero(self.sizes == m)
            s = min(SHINGLE, int(m))
            for k in range(int(m) - s + 1):
                part = np.zeros(len(rows), np.uint64)
                for j in range(s):
                    part = part * np.uint64(0xD6E8FEB86659FD93) + self.words[rows, k + j]
                shingle.append(mix(part + np.uint64(s)))
                window.append(rows)
                offset.append(np.full(len(rows), k))
        if not shingle:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(shingle), np.concatenate(window), np.concatenate(offset)

    def lengths(self) -> list[int]:
        return sorted({min(SHINGLE, int(m)) for m in self.sizes})


class Lookup:
    """Positions of a sorted token among others, with a bit table before the search."""

    def __init__(self, tokens: np.ndarray):
        self.tokens = tokens
        self.bits = np.zeros(int(_BITS) + 1, bool)
        self.bits[(tokens & _BITS).astype(np.int64)] = True

    def find(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, first, end) of the shingles that are tokens."""
        at = np.flatnonzero(self.bits[(shingles & _BITS).astype(np.int64)])
        first = np.searchsorted(self.tokens, shingles[at], "left")
        end = np.searchsorted(self.tokens, shingles[at], "right")
        some = end > first
        return at[some], first[some], end[some]


class Matcher:
    """Finds all occurrences of windows in texts."""

    def __init__(self, windows: Windows, counts: dict[int, int]):
        self.windows = windows
        shingle, window, offset = windows.tokens()
        rarity = np.array([counts.get(x, 0) for x in shingle.astype(np.int64).tolist()], np.int64)
        order = np.lexsort((offset, shingle, rarity, window))
        prefix = order[np.diff(window[order], prepend=-1) != 0]
        prefix = prefix[np.argsort(shingle[prefix], kind="stable")]
        self.lookup = Lookup(shingle[prefix])
        self.window, self.offset = window[prefix], offset[prefix]
        self.names = sorted({i for own in windows.items for i in own})
        number = {x: k for k, x in enumerate(self.names)}
        self.items = [np.array([number[i] for i in own]) for own in windows.items]

    def match(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
        """(hit words as a mask over all texts' words, border of each text's words, items of each text)."""
        hashes, border = words_of(texts, ALNUM)
        owner_of = lambda at: np.searchsorted(border, at, "right") - 1
        change = np.zeros(len(hashes) + 1, np.int32)
        found: set[tuple[int, int]] = set()
        for s in self.windows.lengths():
            at, first, end = self.lookup.find(combine(hashes, s))
            while len(at):
                some = first < end
                at, first, end = at[some], first[some], end[some]
                if not len(at):
                    break
                window = self.window[first]
                start, size = at - self.offset[first], self.windows.sizes[window]
                owner = owner_of(at)
                fits = (start >= border[owner]) & (start + size <= border[owner + 1]) & (np.minimum(SHINGLE, size) == s)
                w, b, z, o = window[fits], start[fits], size[fits], owner[fits]
                same = np.ones(len(w), bool)
                for k in range(WINDOW):
                    inner = k < z
                    same &= ~inner | (hashes[np.minimum(b + k, len(hashes) - 1)] == self.windows.words[w, k])
                np.add.at(change, b[same], 1)
                np.add.at(change, b[same] + z[same], -1)
                found.update(zip(o[same].tolist(), w[same].tolist()))
                first = first + 1
        items: list[set[str]] = [set() for _ in texts]
        for o, w in found:
            items[o].update(self.names[i] for i in self.items[w])
        return np.cumsum(change[:-1]) > 0, border, items


def windows_of(rows: list[tuple[object, str | None]]) -> Windows:
    """The distinct windows of items."""
    hashes, border = words_of([t for _, t in rows], ALNUM)
    known: dict[bytes, int] = {}
    items: list[list[str]] = []
    for k, (item, _) in enumerate(rows):
        own = hashes[border[k] : border[k + 1]]
        m = min(WINDOW, len(own))
        for at in range(len(own) - m + 1 if m else 0):
            place = known.setdefault(own[at : at + m].tobytes(), len(known))
            if place == len(items):
                items.append([])
            name = "null" if item is None else str(item)
            if name not in items[place]:
                items[place].append(name)
    words = np.zeros((len(known), WINDOW), np.uint64)
    sizes = np.zeros(len(known), np.int64)
    for raw, k in known.items():
        own = np.frombuffer(raw, np.uint64)
        words[k, : len(own)], sizes[k] = own, len(own)
    return Windows(words, sizes, items)


#: A word of a text that isn't lower-cased yet.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def item_parts(text: str, most: int) -> Iterator[tuple[str, int]]:
    """The text and its windows, at most; a text of more than `most` in parts, each window in one of them."""
    if len(text) // 2 + 1 <= most:
        yield text, len(text) // 2 + 1
        return
    spans = [m.span() for m in WORD.finditer(text)]
    windows = max(1, len(spans) - WINDOW + 1)
    for at in range(0, windows if spans else 0, most):
        end = min(len(spans), at + most + WINDOW - 1)
        yield text[spans[at][0] : spans[end - 1][1]], min(most, windows - at)


def item_blocks(benchmark: DataFrame, block_windows: int) -> Iterator[Windows]:
    """Windows of the benchmark, block by block; the driver holds one block."""
    rows: list[tuple[object, str | None]] = []
    size = 0
    for row in benchmark.select("item_id", "text").filter("text is not null").toLocalIterator():
        for text, windows in item_parts(row["text"], block_windows):
            if rows and size + windows > block_windows:
                yield windows_of(rows)
                rows, size = [], 0
            rows.append((row["item_id"], text))
            size += windows
    yield windows_of(rows)


def rarity_of(docs: DataFrame, windows: Windows) -> dict[int, int]:
    """How often each shingle of the windows occurs in all documents."""
    lookup = Lookup(np.unique(windows.tokens()[0]))
    lengths = windows.lengths()
    shared = docs.sparkSession.sparkContext.broadcast(lookup)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.tokens) + 1, np.int64)
        for batch in batches:
            hashes, border = words_of(batch.column(0).to_pylist(), ALNUM)
            for s in lengths:
                at, first, _ = shared.value.find(combine(hashes, s))
                inside = at + s <= border[np.searchsorted(border, at, "right")]
                total[:-1] += np.bincount(first[inside], minlength=len(total) - 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(shared.value.tokens[some].astype(np.int64)), pa.array(total[some])], names=["token", "n"])

    rows = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(rows["token"].to_pylist(), rows["n"].to_pylist()))


def matchers(docs: DataFrame, benchmark: DataFrame, block_windows: int) -> Iterator[Broadcast]:
    """A matcher for each block of the benchmark."""
    for windows in item_blocks(benchmark, block_windows):
        yield docs.sparkSession.sparkContext.broadcast(Matcher(windows, rarity_of(docs, windows)))


def find_contamination(docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as strings) of each row."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    for number, shared in enumerate(matchers(docs, benchmark, block_windows)):

        def run(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mask, border, items = shared.value.match(batch.column(1).to_pylist())
                hits = [mask[a:b] for a, b in zip(border[:-1], border[1:])]
                if number:
                    hits = [h | np.unpackbits(np.frombuffer(o, np.uint8), count=len(h)).astype(bool) if o else h for h, o in zip(hits, batch.column(3).to_pylist())]
                    items = [i | set(o or ()) for i, o in zip(items, batch.column(4).to_pylist())]
                packed = [np.packbits(h).tobytes() if h.any() else None for h in hits]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(np.diff(border), pa.int64()), pa.array(packed, pa.binary()), pa.array([sorted(i) for i in items], pa.list_(pa.string()))],
                    names=["doc_id", "text", "n_words", "hits", "items"],
                )

        rows = rows.mapInArrow(run, f"doc_id {kind}, text string, n_words long, hits binary, items array<string>")
    return rows.select("doc_id", "n_words", _bit_total("hits").cast("long").alias("n_hit"), "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows that hold no window of the benchmark, as they are."""
    small_batches(docs.sparkSession)
    at_text = docs.columns.index("text")
    rows = docs
    for shared in matchers(docs, benchmark, block_windows):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mask, border, _ = shared.value.match(batch.column(at_text).to_pylist())
                before = np.append(0, np.cumsum(mask))
                yield batch.filter(pa.array(before[border[1:]] == before[border[:-1]]))

        rows = rows.mapInArrow(run, docs.schema)
    return rows


def _bit_total(column: str):
    """Set bits of a binary column: counts the ones of its hex digits; null has none."""
    digits = F.hex(column)
    total = F.lit(0)
    for ones, kinds in ((1, "1248"), (2, "3569AC"), (3, "7BDE"), (4, "F")):
        total = total + F.lit(ones) * F.length(F.regexp_replace(digits, f"[^{kinds}]", ""))
    return F.coalesce(total, F.lit(0))


def contamination_digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def digest(items: list[str]) -> str:
    """The same digest in Python, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
