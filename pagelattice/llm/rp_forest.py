"""Approximate nearest neighbours: a forest of random-projection trees.

Distinct rows are dealt by a hash to shards of about `shard_rows` rows.  Each
shard's task builds `trees` trees over all its rows; a tree splits a node at the
median of the rows' projections on a random direction, down to `leaf_rows`.
Every query visits every shard.  There one priority queue, shared by all trees,
hands out the branch whose missed margins are smallest until the leaves
gathered hold `search` of the shard's rows; those candidates are ranked by their
exact cosine in double precision.  The shards' best are merged by query.

A task holds one shard; the queries pass by in batches, so nothing grows with
the table but the number of shards.  Every row is indexed; `search` sets the
recall (measured against brute force in the tests and the README).

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part; vectors of different lengths aren't neighbours; rows
equal in id and vector count once; of rows that share an id but not the vector,
the nearest counts, for each of the query's vectors; a row isn't its own
neighbour (same id); ties go to the smaller id; with few candidates all are
returned.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARD_ROWS, SHARDS = 8192, 8
TREES, LEAF_ROWS, SEARCH = 8, 24, 0.55


class Forest:
    """Trees over the rows of one shard, as arrays: direction, cut and children of each node."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = 0):
        self.exact, self.ids = vectors, ids
        #: Rows that one id has at most: so many may stand for one neighbour.
        self.alike = int(np.unique(ids, return_counts=True)[1].max())
        self.norms = np.sqrt((vectors * vectors).sum(1))
        self.unit = vectors / self.norms[:, None]
        self.random = np.random.default_rng(seed)
        self.leaf_rows = leaf_rows
        self.directions: list[np.ndarray] = []
        self.cuts: list[float] = []
        self.children: list[tuple[int, int]] = []
        self.leaves: list[np.ndarray] = []
        self.roots = [self._grow(np.arange(len(ids))) for _ in range(trees)]
        self.plane = np.array(self.directions).reshape(-1, vectors.shape[1])
        self.offset = np.array(self.cuts)

    def _grow(self, rows: np.ndarray) -> int:
        """Number of a node; leaves count from -1 downwards."""
        if len(rows) > self.leaf_rows:
            for _ in range(3):
                a, b = self.random.choice(len(rows), 2, replace=False)
                way = self.unit[rows[a]] - self.unit[rows[b]] + self.random.normal(0, 1e-3, self.unit.shape[1])
                way /= np.sqrt((way * way).sum())
                x = self.unit[rows] @ way
                cut = float(np.median(x))
                right = x > cut
                if right.any() and not right.all():
                    node = len(self.cuts)
                    self.directions.append(way)
                    self.cuts.append(cut)
                    self.children.append((0, 0))
                    self.children[node] = (self._grow(rows[~right]), self._grow(rows[right]))
                    return node
        self.leaves.append(rows)
        return -len(self.leaves)

    def search(self, query: np.ndarray, query_id: int, k: int, search: float) -> list[tuple[int, float]]:
        """The k best candidates, (id, cosine), best first."""
        size = float(np.sqrt((query * query).sum()))
        margins = (self.plane @ (query / size) - self.offset).tolist() if len(self.offset) else []
        queue = [(0.0, root) for root in self.roots]
        heapq.heapify(queue)
        found = np.zeros(len(self.ids), bool)
        want, have = max(16 * k * self.alike, int(np.ceil(search * len(self.ids)))), 0
        while queue and have < want:
            missed, node = heapq.heappop(queue)
            while node >= 0:
                m = margins[node]
                left, right = self.children[node]
                near, far = (right, left) if m > 0 else (left, right)
                heapq.heappush(queue, (missed + m * m, far))
                node = near
            rows = self.leaves[-node - 1]
            have += int(len(rows) - found[rows].sum())
            found[rows] = True
        rows = np.flatnonzero(found & (self.ids != query_id))
        score = self.exact[rows] @ query / (self.norms[rows] * size)
        keep = min(len(rows), 2 * k * self.alike)
        if len(rows) > 4 * k * self.alike:
            edge = np.partition(score, len(rows) - keep)[len(rows) - keep] - 1e-12
            rows, score = rows[score >= edge], score[score >= edge]
        score = np.array([float(np.dot(self.exact[r], query)) for r in rows]) / (self.norms[rows] * size)
        order = np.lexsort((self.ids[rows], -score))
        _, first = np.unique(self.ids[rows][order], return_index=True)
        best = order[np.sort(first)[:k]]
        return [(int(self.ids[rows[b]]), min(1.0, max(-1.0, float(score[b])))) for b in best]


def usable(vector: Column) -> Column:
    """Not null or empty, without null or non-finite components, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, search: float = SEARCH, shard_rows: int = SHARD_ROWS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose id is divisible by `every`."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v"))).distinct()
    shards = max(SHARDS, -(-rows.count() // shard_rows))
    own = rows.withColumns({"shard": F.pmod(F.xxhash64("id", "v"), F.lit(shards)), "ask": F.lit(False)})
    asked = rows.filter(F.pmod("id", F.lit(every)) == 0).withColumns({"shard": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))), "ask": F.lit(True)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[bytes, tuple[int, np.ndarray]]] = defaultdict(dict)
        forests: dict[int, Forest] = {}
        at = None
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for shard, ask, row, values in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3)):
                if shard != at:
                    at, forests = shard, {}
                    held.clear()
                v = values.values.to_numpy(zero_copy_only=False)
                if not ask:
                    held[len(v)].setdefault(row.to_bytes(8, "big", signed=True) + v.tobytes(), (row, v))
                    continue
                if held:
                    forests = {n: Forest(np.array([x for _, x in own.values()]), np.array([i for i, _ in own.values()]), seed=shard) for n, own in held.items()}
                    held.clear()
                if len(v) in forests:
                    for other, score in forests[len(v)].search(v, row, k, search):
                        for column, x in zip(out, (row, other, score)):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    # one shard, one task: hashes of the shards' numbers would meet in some tasks and miss others
    dealt = own.union(asked.select(own.columns)).select("shard", "ask", "id", "v").repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "ask", "id")
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
