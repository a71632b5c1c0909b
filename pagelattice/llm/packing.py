"""Variable-capacity best-fit packing.

Documents are cut into pieces of at most the largest capacity.  Piece lengths
are small integers, so the plan is made over their histogram, whose size
doesn't grow with the data.  Each step opens a bin for the longest piece left:
for every permitted capacity a best-fit filling (always the longest piece that
still fits) is priced at (capacity + overhead) a token held, the cheapest is
opened as many times as the counts allow, and each bin is finally downsized to
the smallest capacity that holds its contents.

Pieces find their place by rank among the pieces of their length.  Ranks come
from counts by length and salt, so a length that a third of the pieces share is
numbered by many tasks.

Defined results: a null or empty text has one row with 0 tokens and no bin;
rows that repeat are packed each; ties rank by id and piece; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelattice.llm.textkernel import count_words
from pagelattice.session import cut, small_batches

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 8
SALT_ROWS = 20_000


@dataclass
class Plan:
    """By length: first rank of each segment, its copies a bin, first bin, place in the bin, capacity."""

    segments: dict[int, np.ndarray]
    bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bin, capacity, offset in the bin) of pieces."""
        out = np.zeros((3, len(length)), np.int64)
        for n in np.unique(length):
            rows = np.flatnonzero(length == n)
            own = self.segments[int(n)]
            at = own[np.searchsorted(own[:, 0], rank[rows], "right") - 1]
            inner = rank[rows] - at[:, 0]
            out[0, rows] = at[:, 2] + inner // at[:, 1]
            out[1, rows] = at[:, 4]
            out[2, rows] = at[:, 3] + inner % at[:, 1] * n
        return out[0], out[1], out[2]


def fill(lengths: list[int], left: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """Best-fit contents of one bin that begins with the longest length: (length, copies)."""
    held: list[tuple[int, int]] = []
    room, end = capacity, len(lengths)
    while room > 0:
        end = bisect_right(lengths, room, 0, end) - 1
        if end < 0:
            break
        copies = min(room // lengths[end], left[lengths[end]])
        held.append((lengths[end], copies))
        room -= copies * lengths[end]
    return held


def make_plan(histogram: dict[int, int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> Plan:
    """Lengths from 1 to the largest capacity, with their counts."""
    left = {n: c for n, c in sorted(histogram.items()) if n > 0 and c > 0}
    lengths, sizes = list(left), sorted(capacities)
    used = dict.fromkeys(left, 0)
    segments: dict[int, list[tuple[int, ...]]] = {n: [] for n in left}
    bins = 0
    while lengths:
        options = []
        for capacity in sizes[bisect_right(sizes, lengths[-1] - 1) :]:
            held = fill(lengths, left, capacity)
            tokens = sum(n * k for n, k in held)
            fitting = next(c for c in sizes if c >= tokens)
            options.append(((fitting + overhead) / tokens, -tokens, fitting, held))
        _, _, capacity, held = min(options)
        times = min(left[n] // k for n, k in held)
        place = 0
        for n, k in held:
            segments[n].append((used[n], k, bins, place, capacity))
            place += n * k
            used[n] += k * times
            left[n] -= k * times
            if not left[n]:
                del lengths[bisect_right(lengths, n) - 1]
        bins += times
    return Plan({n: np.array(s, np.int64) for n, s in segments.items()}, bins)


def word_lengths(docs: DataFrame) -> DataFrame:
    """doc_id and n_tokens, the white-space words of each row's whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count_words(batch.column(1).to_pylist()), pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long")


def pack(lengths: DataFrame, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, piece, doc_offset, n_tokens, bin_id, capacity and bin_offset of each piece of (doc_id, n_tokens)."""
    most = max(capacities)
    pieces = cut(
        lengths.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("whole"))
        .select("doc_id", "whole", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("whole") - 1) / most), F.lit(0).cast("long")))).alias("piece"))
        .select("doc_id", "piece", F.least(F.lit(most), F.col("whole") - F.col("piece") * most).cast("long").alias("n_tokens"))
    )
    salts = max(16, pieces.count() // SALT_ROWS)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    tally = salted.groupBy("n_tokens", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = tally.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    histogram = {r["n_tokens"]: r["n"] for r in tally.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}
    shared = lengths.sparkSession.sparkContext.broadcast(make_plan(histogram, capacities, overhead))
    own = Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece")
    ranked = (
        salted.withColumn("rank", F.row_number().over(own))
        .join(starts.select("n_tokens", "salt", "start"), ["n_tokens", "salt"])
        .select("doc_id", "piece", (F.col("piece") * most).alias("doc_offset"), "n_tokens", (F.col("rank") - 1 + F.col("start")).alias("rank"))
    )
    kind = lengths.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            some = n > 0
            found = np.zeros((3, len(n)), np.int64)
            found[:, some] = shared.value.place(n[some], rank[some])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(x, mask=~some) for x in found)], names=["doc_id", "piece", "doc_offset", "n_tokens", "bin_id", "capacity", "bin_offset"])

    return ranked.mapInArrow(run, f"doc_id {kind}, piece long, doc_offset long, n_tokens long, bin_id long, capacity long, bin_offset long")


def pack_documents(docs: DataFrame, capacities: Sequence[int] = CAPACITIES) -> DataFrame:
    """Packs whole texts, measured in white-space words."""
    return pack(word_lengths(docs), capacities)
