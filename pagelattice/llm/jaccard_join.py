"""N-gram Jaccard join by T-occurrence search (DivideSkip), down to components.

A document is the set of its distinct n-word shingles.  Two link when
`per` * |intersection| >= `share` * |union|.  A record of n shingles must meet
T = ceil(share * n / per) of them in any partner, so of its inverted lists the
T - 1 longest can't decide alone: they're the long lists, and the rest, the
n - T + 1 shortest, are the short lists.  List lengths come from a table of
hashed counts over all documents, of fixed size; any counts give a valid order,
better counts only give shorter lists.

1. Documents with equal sets are one class, found by a digest of the set.
2. Short lists are dealt out by shingle.  Every list proposes its members to
   the one with the smallest doc_id, most often the text that the others were
   copied from (a star, linear in the list); proposals that the binary probes
   confirm make the first components.
3. Lists that still hold several components are turned over: each entry names
   the members of other components that can reach the required overlap by size
   and by the shingles before and behind.  So a pair that links is named by
   each short list that holds both, and not only by the first ones, as all are
   counted.  A link inside a component changes no component.  A list of over
   BLOCK rows is dealt out in pairs of blocks, so no task holds it whole.
4. A record's short lists come together and are heap-merged.  The occurrences
   counted in the merge decide: with the number of long lists they must reach
   the required overlap.  A record with very many entries is merged in parts,
   by ranges of the candidates.
5. Candidates left are verified exactly: the long lists are answered by binary
   probes of one record's sorted shingles in the other's.

So no pair of classes in different components goes unchecked, and none within a
component is spelled out.  Nothing is collected but the count table.

Defined results: texts that are null or without a word are empty, linked with
nothing and their own component; fewer than n words make one shingle; rows that
repeat a doc_id are one row each; rows without a doc_id link like others; a
component is named by its smallest doc_id, null if none of its rows has one;
extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.textkernel import shingle_sets
from pagelattice.operators.components import connected_components
from pagelattice.session import cut, small_batches, unused

WORDS, SHARE, PER = 4, 85, 100
COUNT_BITS, CHUNKS = 22, 64
#: Rows of a list that one task compares with as many others; entries that one merge holds.
BLOCK, MERGED = 4096, 4_000_000


@dataclass(frozen=True)
class Rule:
    """Link iff per * |intersection| >= share * |union|."""

    share: int = SHARE
    per: int = PER

    def required(self, a, b):
        """Least intersection of sets of a and b elements."""
        return -(-(self.share * (a + b)) // (self.per + self.share))

    def short_lists(self, n: int) -> int:
        return n - (-(-self.share * n // self.per)) + 1

    def sizes_fit(self, a, b):
        return (self.per * a >= self.share * b) & (self.per * b >= self.share * a)


def digest(own: np.ndarray) -> int:
    """The same for equal sets; 0 is kept for the empty set."""
    if not len(own):
        return 0
    total = int((own ^ (own >> np.uint64(31))).sum(dtype=np.uint64))
    folded = int(np.bitwise_xor.reduce(own * np.uint64(0x9E3779B97F4A7C15) ^ (own >> np.uint64(29))))
    out = ((total * 0xA24BAED4963EE407 ^ folded) + len(own) * 0x9FB21C651E98DF25) % (1 << 64) - (1 << 63)
    return out or 1


def _records(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    for k, own in enumerate(shingle_sets(batch.column(1).to_pylist(), words)):
        yield k, own


def class_rows(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, rid of each row; behind each partition's rows, chunks of the shingle counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    cells = 1 << COUNT_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, np.uint32)
        for batch in batches:
            n, rid = [], []
            for _, own in _records(batch, words):
                n.append(len(own))
                rid.append(digest(own))
                np.add.at(counts, (own & np.uint64(cells - 1)).astype(np.int64), np.uint32(1))
            size = len(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(rid, pa.int64()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], names=["doc_id", "n", "rid", "chunk", "counts"])
        if counts.any():
            parts = [zlib.compress(x.tobytes(), 1) for x in counts.reshape(CHUNKS, -1)]
            none = pa.nulls(CHUNKS, batch.column(0).type), pa.nulls(CHUNKS, pa.int32()), pa.nulls(CHUNKS, pa.int64())
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names=["doc_id", "n", "rid", "chunk", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n int, rid long, chunk int, counts binary")


def shingle_counts(rows: DataFrame) -> np.ndarray:
    """The summed count table: CHUNKS rows reach the driver, 16 MB in all."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for chunk, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(zlib.decompress(part), np.uint32)
                if chunk == at:
                    total = total + own
                    continue
                if at is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "counts"])
                at, total = chunk, own
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "counts"])

    parts = rows.filter("chunk is not null").select("chunk", "counts").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(add, "chunk int, counts binary").toArrow()
    out = np.zeros((CHUNKS, (1 << COUNT_BITS) // CHUNKS), np.uint32)
    for chunk, part in zip(parts["chunk"].to_pylist(), parts["counts"].to_pylist()):
        out[chunk] = np.frombuffer(part, np.uint32)
    return out.reshape(-1)


def short_list_rows(docs: DataFrame, words: int, rule: Rule, shared: Broadcast) -> DataFrame:
    """token, rid, n, place, doc: each class's rarest shingles, in the order of rarity by the shared counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        mask = np.uint64(len(shared.value) - 1)
        for batch in batches:
            token, rid, n, place, row = [], [], [], [], []
            for k, own in _records(batch, words):
                name = digest(own)
                if not name or name in seen:
                    continue
                seen.add(name)
                take = rule.short_lists(len(own))
                rarest = np.lexsort((own, shared.value[(own & mask).astype(np.int64)]))[:take]
                token.append(own[rarest].astype(np.int64))
                rid.append(np.full(take, name, np.int64))
                n.append(np.full(take, len(own), np.int32))
                place.append(np.arange(take, dtype=np.int32))
                row.append(np.full(take, k, np.int32))
            if len(seen) > 1_000_000:
                seen.clear()
            if token:
                doc = batch.column(0).take(pa.array(np.concatenate(row)))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in (token, rid, n, place)), doc], names=["token", "rid", "n", "place", "doc"])

    return docs.select("doc_id", "text").mapInArrow(run, f"token long, rid long, n int, place int, doc {kind}")


def shared_lists(rows: DataFrame, rule: Rule) -> DataFrame:
    """Lists of more than one class, each row with the class that its list proposes as partner.

    The proposed partner is the list's member with the smallest doc_id; a member
    whose size can't fit it proposes itself, that is, nothing.  The state is one
    row, however long a list is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: list[np.ndarray] | None = None  # first row of the list at hand
        alone = True
        for batch in batches:
            if not batch.num_rows:
                continue
            # the row of the list at hand goes before the batch, so a list goes on as if it weren't cut
            rows = [np.concatenate([h, c.to_numpy()]) if head else c.to_numpy() for h, c in zip(head or batch.columns, batch.columns)]
            token, rid, n, _ = rows
            start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            first = np.repeat(start, np.diff(np.append(start, len(token))))
            other = rid != rid[first]
            kinds = np.add.reduceat(other, start) > 0
            keep = other.copy()
            keep[start] = kinds
            if head and not alone:
                keep[0] = False
            fits = rule.sizes_fit(n.astype(np.int64), n[first].astype(np.int64))
            partner = np.where(fits, rid[first], rid)
            at = np.flatnonzero(keep)
            if len(at):
                yield pa.RecordBatch.from_arrays([*(pa.array(x[at]) for x in rows), pa.array(partner[at])], names=["token", "rid", "n", "place", "head"])
            alone = not kinds[-1] and (alone or len(start) > 1 or not head)
            head = [x[start[-1] : start[-1] + 1] for x in rows]

    dealt = rows.repartition("token").sortWithinPartitions("token", F.col("doc").asc_nulls_last(), "rid")
    return dealt.select("token", "rid", "n", "place").mapInArrow(run, "token long, rid long, n int, place int, head long")


class Entries:
    """Rows of whole lists, sorted by list and class, each class once a list."""

    def __init__(self, rows: list[np.ndarray], rule: Rule):
        token, p, q, rid, n, place, component, side = rows
        new = np.append(True, (token[1:] != token[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]))
        run = np.cumsum(new)
        order = np.lexsort((rid, run))
        order = order[np.append(True, (np.diff(run[order]) != 0) | (np.diff(rid[order]) != 0))]
        run = run[order]
        self.rid, self.n, self.component, self.side, self.rule = rid[order], n[order].astype(np.int64), component[order], side[order], rule
        self.rest, self.across = self.n - place[order].astype(np.int64), (p != q)[order]
        start = np.flatnonzero(np.append(True, np.diff(run) != 0))
        self.start, self.end = start, np.append(start[1:], len(run))
        self.place = np.arange(len(run)) - np.repeat(start, self.end - start)

    def meet(self, k: np.ndarray, j: np.ndarray, first: bool) -> np.ndarray:
        """Whether entries of one list are of different components and can reach the required overlap; in a pair of blocks, only across.

        If it's the first list that holds both, the overlap starts there; else
        all shingles before it may be shared, too.
        """
        n, m = self.n[k], self.n[j]
        fits = (self.component[k] != self.component[j]) & self.rule.sizes_fit(n, m)
        reach = np.minimum(self.rest[k], self.rest[j])
        if not first:
            reach += np.minimum(n - self.rest[k], m - self.rest[j])
        fits &= reach >= self.rule.required(n, m)
        return fits & (~self.across[k] | (self.side[k] != self.side[j]))

    def partners(self, few: int = 64, first: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (entry, earlier entry of its list) that meet, sorted; lists of few entries take one step for each distance between two of them.

        With `first`, lists that can be the first to hold both of a pair that
        links; without, all that can hold both, as a count of them needs.
        """
        size = self.end - self.start
        short = np.repeat(size <= few, size)
        found = []
        for step in range(1, int(size[size <= few].max(initial=0))):
            k = np.flatnonzero(short & (self.place >= step))
            k = k[self.meet(k, k - step, first)]
            found.append((k, k - step))
        for start, end in zip(self.start[size > few].tolist(), self.end[size > few].tolist()):
            step = max(1, 1_000_000 // (end - start))
            for low in range(start, end, step):
                k = np.arange(low, min(end, low + step))[:, None]
                j = np.arange(start, end)[None, :]
                row, at = np.nonzero((j < k) & self.meet(k, j, first))
                found.append((row + low, at + start))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k, j = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((j, k))
        return k[order], j[order]


def turned_lists(lists: DataFrame, components: DataFrame, rule: Rule) -> DataFrame:
    """rid, n, others and their sizes: one row for each record and list that holds partners of other components, by ascending class.

    The larger class of a pair names the smaller one, so that a pair's
    occurrences in all lists fall to one record.
    """
    named = lists.select("token", "rid", "n", "place").join(components.select(F.col("node").alias("rid"), "component"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    mixed = named.groupBy("token").agg(F.count("*").alias("rows"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    blocks = F.ceil(F.col("rows") / BLOCK)
    # cut, so that the join stands alone and Spark can split a very common shingle
    mixed = cut(mixed.select("token", blocks.alias("blocks")))
    placed = named.join(mixed, "token").withColumn("own", F.pmod(F.xxhash64("rid"), F.col("blocks")))
    met = placed.withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("token", F.least("own", "met").alias("p"), F.greatest("own", "met").alias("q"), "rid", "n", "place", "component", (F.col("own") < F.col("met")).alias("side"), (F.col("own") == F.col("met")).alias("same"))
    met = met.withColumn("side", F.when(F.col("same"), F.lit(False)).otherwise(F.col("side"))).drop("same")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in closed_runs(batches, 3):
            entries = Entries(rows, rule)
            k, j = entries.partners(first=False)
            first = np.flatnonzero(np.append(len(k) > 0, np.diff(k) != 0))
            border = np.append(first, len(k)).astype(np.int32)
            own = k[first]
            lists = [pa.ListArray.from_arrays(border, pa.array(x[j].astype(t))) for x, t in ((entries.rid, np.int64), (entries.n, np.int32))]
            whole = pa.RecordBatch.from_arrays([pa.array(entries.rid[own]), pa.array(entries.n[own].astype(np.int32)), *lists], names=["rid", "n", "others", "sizes"])
            for at in range(0, len(own), 2048):
                yield whole.slice(at, 2048)

    return spread(met, "token", "p", "q").sortWithinPartitions("token", "p", "q").mapInArrow(run, "rid long, n int, others array<long>, sizes array<int>")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Deals rows out to as many tasks as the session has shuffle partitions: their work is more than their size shows, so they aren't put together."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def closed_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Batches as arrays, cut so that rows of equal leading columns, which come together, stay together."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        rows = [np.concatenate(x) for x in zip(held, rows)] if held else rows
        if not len(rows[0]):
            continue
        last = np.ones(len(rows[0]), bool)
        for c in rows[:keys]:
            last &= c == c[-1]
        cut_at = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut_at:
            yield [c[:cut_at] for c in rows]
        held = [c[cut_at:] for c in rows]
    if held:
        yield held


def runs_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The rows of equal leading columns, which come together, as arrays; one run is held."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        change = np.zeros(len(rows[0]), bool)
        for c in rows[:keys]:
            change[1:] |= c[1:] != c[:-1]
        change[0] = bool(held) and any(c[0] != h[-1] for c, h in zip(rows[:keys], held[-1]))
        border = [0, *np.flatnonzero(change).tolist(), len(change)]
        for k, (a, b) in enumerate(zip(border[:-1], border[1:])):
            if k and held:
                yield [np.concatenate(x) for x in zip(*held)]
                held = []
            if b > a:
                held.append([c[a:b] for c in rows])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def merged(lists: list[np.ndarray], sizes: list[np.ndarray], n: int, rule: Rule) -> list[int]:
    """The candidates that occur often enough in a record's short lists, by a heap merge of the sorted lists.

    The lists must name a candidate wherever both occur: what isn't counted is
    taken for a long list of the larger one, of which there are T - 1.
    """
    known, at = np.unique(np.concatenate(lists), return_index=True)
    times = np.array([sum(1 for _ in run) for _, run in groupby(heapq.merge(*(x.tolist() for x in lists)))], np.int64)
    other = np.concatenate(sizes)[at].astype(np.int64)
    long_lists = np.maximum(n, other)
    long_lists = -(-rule.share * long_lists // rule.per) - 1
    return known[times + long_lists >= rule.required(other, n)].tolist()


def cross_candidates(lists: DataFrame, components: DataFrame, rule: Rule) -> DataFrame:
    """a, b: pairs of classes in different components whose occurrences in short lists can reach the required overlap."""
    turned = cut(turned_lists(lists, components, rule))
    most = turned.groupBy("rid").agg(F.sum(F.size("others")).alias("entries")).agg(F.max("entries")).first()[0] or 0
    parts = -(-most // MERGED)
    if parts > 1:
        part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
        both = F.filter(F.arrays_zip("others", "sizes"), lambda x: F.pmod(F.shiftright(x["others"], 48), F.lit(parts)) == F.col("part"))
        turned = turned.withColumn("part", part).withColumn("both", both).filter(F.size("both") > 0).select("rid", "part", "n", F.col("both.others").alias("others"), F.col("both.sizes").alias("sizes"))
    else:
        turned = turned.select("rid", F.lit(0).alias("part"), "n", "others", "sizes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rid, _, n, others, sizes in runs_of(batches, 2):
            found = merged(list(others), list(sizes), int(n[0]), rule)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([int(rid[0])] * len(found), pa.int64())], names=["a", "b"])

    return spread(turned, "rid", "part").sortWithinPartitions("rid", "part").mapInArrow(run, "a long, b long")


def often_enough(pairs: DataFrame, lists: DataFrame, rule: Rule) -> DataFrame:
    """Pairs that meet in enough short lists, given that all long lists of the larger record might hold both."""
    own = lists.groupBy("rid").agg(F.max("n").cast("long").alias("n"), F.collect_set("token").alias("tokens"))
    a, b = (own.select(F.col("rid").alias(k), F.col("n").alias(f"n{k}"), F.col("tokens").alias(f"t{k}")) for k in "ab")
    required = F.expr(f"({rule.share} * (na + nb) + {rule.per + rule.share - 1}) div {rule.per + rule.share}")
    long_lists = F.expr(f"({rule.share} * greatest(na, nb) + {rule.per - 1}) div {rule.per} - 1")
    met = F.size(F.array_intersect("ta", "tb"))
    return cut(pairs.join(a, "a").join(b, "b").filter(met + long_lists >= required).select("a", "b"))


def probe(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the shorter sorted array's elements the longer one holds, by binary search."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def verified(pairs: DataFrame, docs: DataFrame, owners: DataFrame, words: int, rule: Rule) -> DataFrame:
    """The pairs (a, b) of classes that link.

    Shingles are made again, only for documents that stand for a class in a
    pair: a bit table of fixed size picks them before the words are hashed.
    What it lets through in error finds no pair; once it's so full that this
    would be much, a join with the exact ids drops it.  A class whose rows all
    lack an id is found by its digest among the rows without one.
    """
    needed = cut(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct().join(owners, "rid").select("rid", "owner"))
    count, nameless = needed.agg(F.count("*"), F.count_if(F.col("owner").isNull())).first()
    bits = 1 << 23
    cell = F.pmod(F.xxhash64("owner"), F.lit(bits))
    marked = needed.filter("owner is not null").select(cell.alias("at")).groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[marked["word"].to_numpy()] = marked["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table.view(np.uint8))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            rows = np.flatnonzero((at < 0) | ((shared.value[np.maximum(at, 0) >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0))
            if not len(rows):
                continue
            sets = shingle_sets(batch.column(1).take(pa.array(rows)).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([digest(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["owner", "rid", "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    known = docs.select(F.col("doc_id").alias("owner"), "text").withColumn("cell", F.when(F.col("owner").isNull(), F.lit(-1).cast("long")).otherwise(cell))
    made = lambda rows: rows.mapInArrow(sets_of, f"owner {kind}, rid long, tokens binary")
    sets = made(known.filter("cell >= 0"))
    if count > bits // 8:
        sets = sets.join(needed, ["rid", "owner"], "left_semi")
    sets = sets.select("rid", "tokens")
    if nameless:
        unnamed = made(known.filter("cell < 0")).join(needed.filter("owner is null"), "rid", "left_semi")
        sets = sets.union(unnamed.groupBy("rid").agg(F.min("tokens").alias("tokens")))
    sets = cut(sets)
    shared.destroy()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if probe(x, y) >= rule.required(len(x), len(y)):
                    links.append((a, b))
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    both = pairs.join(sets.select(F.col("rid").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("rid").alias("b"), F.col("tokens").alias("y")), "b")
    return cut(both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long").distinct())


def class_components(docs: DataFrame, words: int = WORDS, share: int = SHARE, per: int = PER) -> tuple[DataFrame, DataFrame]:
    """doc_id, n and rid of each row; rid and component of each class that isn't empty."""
    small_batches(docs.sparkSession)
    rule = Rule(share, per)
    rows = cut(class_rows(docs, words))
    records = rows.filter("chunk is null").select("doc_id", "n", "rid")
    owners = records.filter("n > 0").groupBy("rid").agg(F.min("doc_id").alias("owner"))
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(rows))
    lists = cut(shared_lists(short_list_rows(docs, words, rule, counts), rule))
    counts.destroy()
    stars = lists.filter("head <> rid").select(F.least("head", "rid").alias("a"), F.greatest("head", "rid").alias("b")).distinct()
    links = verified(often_enough(stars, lists, rule), docs, owners, words, rule)
    found = connected_components(links)
    more = verified(cut(cross_candidates(lists, found, rule)), docs, owners, words, rule)
    if not more.isEmpty():
        found = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    named = owners.join(found, owners["rid"] == found["node"], "left").select("rid", "owner", F.coalesce("component", "rid").alias("component"))
    return records, cut(named)


def with_class(docs: DataFrame, words: int, name: str) -> DataFrame:
    """The rows with their class in the column `name`, 0 without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(batch.schema.get_field_index("text")).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([digest(own) for own in sets], pa.int64())], names=[*batch.schema.names, name])

    small_batches(docs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, `{name}` long")


def jaccard_components(docs: DataFrame, words: int = WORDS, share: int = SHARE, per: int = PER) -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    records, named = class_components(docs, words, share, per)
    # cut, so that the join stands alone and Spark can split a large component
    least = cut(named.groupBy("component").agg(F.min("owner").alias("component_id")))
    named = named.join(least, "component").select("rid", "component_id")
    size = F.col("n").cast("long").alias("n_shingles")
    linked = records.filter("n > 0").join(named, "rid").select("doc_id", size, "component_id")
    return linked.union(records.filter("n = 0").select("doc_id", size, F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, words: int = WORDS, share: int = SHARE, per: int = PER) -> DataFrame:
    """The documents with one row of each component: that with the smallest id.

    Rows are told apart by their id and set of shingles: of texts that share an
    id only those go that are copies, and of rows with the same id and set the
    smallest by text, then by the other columns, stays.  A null id is larger
    than any other.  Texts without a word all stay.
    """
    records, named = class_components(docs, words, share, per)
    # cut, so that the join with the first of each stands alone and Spark can split a large component
    tally = cut(records.filter("n > 0").groupBy("doc_id", "rid").count().join(named.select("rid", "component"), "rid"))
    first = cut(tally.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("first")))
    own, at_id, at_class = (unused(x, docs.columns) for x in ("own_class", "at_id", "at_class"))
    judged = tally.join(first, "component").withColumn("stays", F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.rid") == F.col("rid")))
    judged = cut(judged.filter("not stays or count > 1").select(F.col("doc_id").alias(at_id), F.col("rid").alias(at_class), "stays"))
    rows = with_class(docs, words, own)
    same = rows["doc_id"].eqNullSafe(F.col(at_id)) & (rows[own] == F.col(at_class))
    gone, twice = judged.select(at_id, at_class), judged.filter("stays").select(at_id, at_class)
    kept = rows.join(gone, same, "left_anti").select(*docs.columns)
    if twice.isEmpty():
        return kept
    whole = F.struct("text", *[c for c in docs.columns if c != "text"])
    ordered = not any(f.dataType.typeName() in ("map", "variant") for f in docs.schema)
    least = F.min(whole) if ordered else F.min_by(whole, "text")
    repeated = rows.join(twice, same, "left_semi").groupBy("doc_id", own).agg(least.alias(unused("row", docs.columns)))
    return kept.unionByName(repeated.select(f"{unused('row', docs.columns)}.*").select(*docs.columns))
