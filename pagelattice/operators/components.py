"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.session import cut

MOST_ROUNDS = 60
#: Edges that one task takes whole; more go in rounds of joins.
FEW = 1 << 18


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the node's smallest neighbour (or itself)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (smallest node reachable) for every node of an edge.

    Self-loops are nodes without neighbours.  Up to FEW edges between whole
    numbers are solved by one task, as rounds would write more files than rows.
    Else the rounds grow with the logarithm of the number of nodes; each ends in
    the shared checkpoint folder, so a lost executor costs one round at most.
    No node's neighbours are gathered: the hubs are handled by joins, which may
    be split.
    """
    pairs = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    kinds = {f.dataType.simpleString() for f in pairs.schema}
    if len(kinds) == 1 and kinds <= {"int", "bigint"} and pairs.count() <= FEW:
        return cut(_in_one_task(pairs, *kinds))
    nodes = pairs.filter("a = b").select(F.col("a").alias("node"))
    stars = pairs.filter("a <> b")
    seen = None
    for _ in range(MOST_ROUNDS):
        stars = cut(_small_star(_large_star(stars)))
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("the components didn't settle")
    found = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = found.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
    known = found.union(roots)
    return known.union(nodes.join(known.select("node"), "node", "left_anti").withColumn("component", F.col("node")))


def _in_one_task(pairs: DataFrame, kind: str) -> DataFrame:
    """node, component of an edge table that one task can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches if batch.num_rows]
        if held:
            a, b = (np.concatenate(x) for x in zip(*held))
            names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = names[labels_of(at[: len(a)], at[len(a) :], len(names))]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(root)], names=["node", "component"])

    return pairs.filter("a is not null and b is not null").coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def labels_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node reachable from each of n nodes over edges (a, b)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _spanned(key: pa.Array, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """group, root, node for every node of an edge; groups are told apart by their place among the keys."""
    group = key.dictionary_encode()
    code = group.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names, inner = np.unique(np.concatenate([a, b]), return_inverse=True)
    both, at = np.unique(np.tile(code, 2) * len(names) + inner, return_inverse=True)
    root = both[labels_of(at[: len(a)], at[len(a) :], len(both))]
    return pa.RecordBatch.from_arrays([group.dictionary.take(pa.array(both // len(names))), pa.array(names[root % len(names)]), pa.array(names[both % len(names)])], names=["key", "root", "node"])


def components_within(edges: DataFrame, key: str, a: str, b: str, distance: str | None = None, eps: float = 0.0) -> DataFrame:
    """key, node, component (smallest node reachable) where no edge leaves its key's group.

    Each task first turns its own edges, those with a distance of at most eps
    if there's one, into a forest, whose size is bound by the nodes; only
    forests are shuffled, and a group's forests meet in one task as numbers.
    """
    kind = edges.schema[key].dataType.simpleString()
    columns = [F.col(key).alias("key"), F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"), *([F.col(distance).cast("double").alias("d")] if distance else [])]

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if distance:
                batch = batch.filter(pc.less_equal(batch.column(3), eps))
            if batch.num_rows:
                yield _spanned(batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy())

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = pc.equal(batch.column(0), batch.column(0)[-1])
            done = batch.filter(pc.invert(last))
            if held and (done.num_rows or held[-1].column(0)[0] != batch.column(0)[0]):
                yield from closed([*held, done])
                held = []
            elif done.num_rows:
                yield from closed([done])
            held.append(batch.filter(last))
        if held:
            yield from closed(held)

    def closed(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(parts).combine_chunks()
        for batch in whole.to_batches():
            yield _spanned(batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy())

    schema = f"key {kind}, root long, node long"
    small = edges.select(*columns).mapInArrow(forests, schema)
    found = small.repartition("key").sortWithinPartitions("key").mapInArrow(merged, schema)
    return found.select(F.col("key").alias(key), "node", F.col("root").alias("component"))
