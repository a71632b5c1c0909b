"""Line dedup by a log-template tree.

A line is parsed at fixed depth: by its number of words, then by its leading
LEADING words; words that hold a digit are one wildcard.  Two lines of a leaf
are alike if they have the same words, none with a digit, at SIMILARITY of
their places or more.  In the order of the smallest document that holds it, a
line that is like no line kept in a document with a smaller id is kept, and is
a template for what follows; any other is a variant and goes from all
documents.  What is kept stays in the smallest document and goes from the
others.  So each line that goes is like one that stays, no two lines that stay
in different documents are alike, and neither the leaf's size nor the order of
rows matters.  A line with too few words without digits is like none, and is
compared with its digits as they are.

A line of fewer than `least_words` words recurs by chance, so it counts with
its neighbours only: it goes if it lies in a passage of whole lines that holds
`least_words` words or more, starts or ends with a short line, has no line to
spare, and is word by word in a document with a smaller id.  Lines without a
word are no neighbours and stay.  A text of over a block's bytes is cut between
two lines, and no passage reaches over that cut.

With `copies`, a document that is a copy as a whole keeps its lines for a join
of near duplicates to judge.  Without that, such a join would see what is left
of a copy and not the copy.  Two documents' words are taken without the lines
that go for a third one's sake: if that share of all stands in lines of both,
they're copies; from LIKELY on, if they're near in size, they are if their texts
have that share of their shingles in common.

Defined results: a null text stays null and an empty one empty; a row with a
null doc_id stays as it is; lines repeated inside one document only are kept;
rows that share a doc_id count as one document; n_chars, if there, is counted
anew; all columns of the input are returned, but a column n_dropped of the
input is replaced if the operator's own is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.textkernel import line_blocks, mix, run_hashes, shingle_sets
from pagelattice.session import cut, small_batches, unused

LEADING, LEAST_WORDS, SIMILARITY = 3, 8, 0.7
#: Words of a shingle, and the share of lines from which shingles are compared.
SHINGLE, LIKELY = 5, 0.1
#: The leaf of all passages of short lines, and the line number of rows that hold a document's words.
PASSAGE, WHOLE = 0, -1
WHITE = " \t\n\v\f\r"
_WILD = np.uint64(0x5851F42D4C957F2D)
_PLACE = np.uint64(0x9FB21C651E98DF25)


def parsed_lines(texts: list[str | None], least_words: int, words: bool, similarity: float = SIMILARITY) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of (text, line, words, leaf, line hash[, words' hashes with their positions and 0 for those with a digit, border of each line's])."""
    for block in bordered_lines(texts):
        yield long_lines(block, least_words, words, similarity)


def bordered_lines(texts: list[str | None]) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of (word hash, word has a digit, first word and end of each line that has words, its number, its text)."""
    for hashes, digit, line, owner in line_blocks(texts):
        if len(hashes):
            first = np.flatnonzero((np.diff(line, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
            yield hashes, digit, first, np.append(first[1:], len(hashes)), line[first], owner[first]


def long_lines(block: tuple[np.ndarray, ...], least_words: int, words: bool, similarity: float) -> tuple[np.ndarray, ...]:
    exact, digit, first, end, line, owner = block
    hashes = np.where(digit, _WILD, exact)
    digits = np.append(0, np.cumsum(digit))
    long = end - first >= least_words
    first, end, line, owner = first[long], end[long], line[long], owner[long]
    size = end - first
    leaf = run_hashes(hashes, first, np.minimum(end, first + LEADING)) ^ mix(size.astype(np.uint64))
    plain = size - (digits[end] - digits[first])
    whole = np.where(plain >= similarity * size, run_hashes(hashes, first, end), run_hashes(exact, first, end))
    out = [owner, line, size, leaf.astype(np.int64), whole.astype(np.int64)]
    if words:
        inside = np.zeros(len(hashes) + 1, np.int64)
        inside[first] += 1
        inside[end] -= 1
        chosen = np.cumsum(inside[:-1]) > 0
        place = (np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)).astype(np.uint64)
        keys = mix(hashes[chosen] + (place + np.uint64(1)) * _PLACE).astype(np.int64)
        out += [np.where(digit[chosen], 0, keys), np.append(0, np.cumsum(size))]
    return tuple(out)


def short_passages(block: tuple[np.ndarray, ...], least_words: int) -> tuple[np.ndarray, ...]:
    """(text, line, mask, passage hash, words a line): bit j of the mask is set if line + j is a short line of the passage; one of over 64 lines takes several rows."""
    hashes, _, first, end, line, owner = block
    short = np.flatnonzero(end - first < least_words)
    last = np.searchsorted(end, first[short] + least_words)
    start = np.searchsorted(first, end[short] - least_words, "right") - 1
    on, back = last < len(end), start >= 0
    pairs = np.concatenate([np.stack([short[on], last[on]], 1), np.stack([start[back], short[back]], 1)])
    pairs = np.unique(pairs[owner[pairs[:, 0]] == owner[pairs[:, 1]]], axis=0)
    start, last = pairs[:, 0], pairs[:, 1]
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    whole = mix(run_hashes(hashes, first[start], end[last]) + (end[last] - first[start]).astype(np.uint64))
    held = last - start + 1
    passage = np.repeat(np.arange(len(start)), held)
    member = start[passage] + np.arange(int(held.sum())) - np.repeat(np.cumsum(held) - held, held)
    few = (end - first)[member] < least_words
    passage, member = passage[few], member[few]
    offset = line[member] - line[start[passage]]
    edge = np.flatnonzero((np.diff(passage, prepend=-1) != 0) | (np.diff(offset // 64, prepend=-1) != 0))
    mask = np.bitwise_or.reduceat(np.uint64(1) << (offset % 64).astype(np.uint64), edge)
    at = passage[edge]
    size = np.add.reduceat((end - first)[member], edge) / np.diff(np.append(edge, len(member)))
    return owner[start[at]], line[start[at]] + offset[edge] // 64 * 64, mask.astype(np.int64), whole[at].astype(np.int64), size


class Kept:
    """The lines kept of one leaf, by runs of places: lines with at most d places that differ agree in one of d + 1 runs."""

    def __init__(self, size: int, similarity: float) -> None:
        self.least = size * similarity
        runs = size - int(np.ceil(self.least)) + 1
        border = np.linspace(LEADING, size, runs + 1).astype(int).tolist() if size - LEADING >= runs else [0, 0]
        self.runs = list(zip(border[:-1], border[1:]))
        self.rows, self.n = np.zeros((4, size), np.int64), 0
        self.index: dict[tuple[int, bytes], list[int]] = {}

    def keys(self, words: np.ndarray) -> Iterator[tuple[int, bytes]]:
        for a, b in self.runs:
            if words[a:b].all():
                yield a, words[a:b].tobytes()

    def first_like(self, words: np.ndarray) -> int | None:
        """Number of the first kept line that is like this one."""
        found = None
        for key in self.keys(words):
            at = self.index.get(key)
            if at:
                alike = ((self.rows[at] == words) & (words != 0)).sum(1) >= self.least
                if alike.any():
                    k = at[int(alike.argmax())]
                    found = k if found is None else min(found, k)
        return found

    def add(self, words: np.ndarray) -> None:
        if self.n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.n] = words
        for key in self.keys(words):
            self.index.setdefault(key, []).append(self.n)
        self.n += 1


def variants_of(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """leaf, whole of the variants and lo of the line they're like, among rows of (leaf, whole, lo, words) that come by leaf and lo; only the kept lines of one leaf are held."""
    state, lo, kept, owners, waiting = None, None, Kept(0, similarity), [], []
    for batch in batches:
        leaf, whole, least, words = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist(), batch.column(3)
        border = words.offsets.to_numpy() - words.offsets[0].as_py()
        words, gone, like = words.flatten().to_numpy(), [], []
        for k in range(len(leaf)):
            own = words[border[k] : border[k + 1]]
            if state != (leaf[k], len(own)):
                state, lo, kept, owners, waiting = (leaf[k], len(own)), least[k], Kept(len(own), similarity), [], []
            if lo != least[k]:
                for x in waiting:
                    kept.add(x)
                owners += [lo] * len(waiting)
                lo, waiting = least[k], []
            found = kept.first_like(own)
            if found is not None:
                gone.append(k)
                like.append(owners[found])
            else:
                waiting.append(own.copy())
        yield pa.RecordBatch.from_arrays([pa.array(leaf[gone]), pa.array(whole[gone]), pa.array(like, batch.column(2).type)], names=["leaf", "whole", "like"])


def repeated_rows(docs: DataFrame, least_words: int = LEAST_WORDS, similarity: float = SIMILARITY, lines: bool = True, passages: bool = True, counted: bool = False) -> tuple[DataFrame, DataFrame]:
    """doc_id, line, lo (whose line stays) and size of the lines that go, some of them twice; if counted, n_words of each doc_id."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.filter("doc_id is not null and text is not null").select("doc_id", "text")

    def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in bordered_lines(batch.column(1).to_pylist()):
                _, _, first, end, _, owner = block
                found = []
                if counted:
                    words = np.bincount(owner, end - first).astype(np.int64)
                    some = np.flatnonzero(words)
                    found.append((some, np.full(len(some), WHOLE), words[some], *np.zeros((3, len(some)))))
                if lines:
                    text, line, size, leaf, whole = long_lines(block, least_words, False, similarity)
                    found.append((text, line, np.ones(len(text)), leaf, whole, size))
                if passages:
                    text, line, mask, whole, size = short_passages(block, least_words)
                    found.append((text, line, mask, np.full(len(text), PASSAGE), whole, size))
                for text, line, mask, leaf, whole, size in found:
                    columns = ((line, np.int32), (mask, np.int64), (leaf, np.int64), (whole, np.int64), (size, np.float32))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), *(pa.array(x.astype(t)) for x, t in columns)], names=["doc_id", "line", "mask", "leaf", "whole", "size"])

    all_rows = cut(texts.mapInArrow(lines_of, f"doc_id {kind}, line int, mask long, leaf long, whole long, size float"))
    words = all_rows.filter(F.col("line") == WHOLE).groupBy("doc_id").agg(F.sum("mask").alias("n_words"))
    rows = all_rows.filter(F.col("line") != WHOLE)
    exact = cut(rows.groupBy("leaf", "whole").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")))
    bit = "case when mask = 1 then array(line) else transform(filter(sequence(0, 63), j -> bit_get(mask, j) = 1), j -> line + j) end"
    out = [F.col("doc_id"), F.explode(F.expr(bit)).alias("line"), F.col("lo"), F.col("size")]
    if not lines:
        return rows.join(exact.filter("lo <> hi"), ["leaf", "whole"]).filter("doc_id > lo").select(*out), words
    leaves = exact.filter(F.col("leaf") != PASSAGE).groupBy("leaf").agg(F.count("*").alias("kinds"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("kinds > 1 and lo <> hi").select("leaf")

    bits = 1 << 23
    marked = leaves.select(F.pmod("leaf", F.lit(bits)).alias("at")).groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[marked["word"].to_numpy()] = marked["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table.view(np.uint8))

    def words_of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, size, leaf, whole, words, border in parsed_lines(batch.column(0).to_pylist(), least_words, True, similarity):
                plain = np.add.reduceat(words != 0, border[:-1]) if len(size) else size
                cell = leaf % bits
                maybe = (shared.value[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1
                rows = [k for k in np.flatnonzero(maybe & (plain >= similarity * size)) if int(whole[k]) not in seen and not seen.add(int(whole[k]))]
                if len(seen) > 2_000_000:
                    seen.clear()
                keys = pa.array([words[border[k] : border[k + 1]] for k in rows], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(leaf[rows]), pa.array(whole[rows]), keys], names=["leaf", "whole", "words"])

    worded = texts.select("text").mapInArrow(words_of_lines, "leaf long, whole long, words array<long>").dropDuplicates(["leaf", "whole"])
    worded = worded.join(exact.join(leaves, "leaf", "left_semi").select("leaf", "whole", "lo"), ["leaf", "whole"]).select("leaf", "whole", "lo", "words")
    variants = worded.repartition("leaf").sortWithinPartitions("leaf", "lo").mapInArrow(lambda batches: variants_of(batches, similarity), f"leaf long, whole long, like {kind}")
    # cut here, so that the join of all rows stands alone and Spark can split a very common line
    found = cut(exact.join(variants, ["leaf", "whole"], "left").filter("like is not null or lo <> hi").select("leaf", "whole", "lo", "like"))
    shared.destroy()
    gone = rows.join(found, ["leaf", "whole"]).filter("like is not null or doc_id > lo")
    return gone.withColumn("lo", F.coalesce("like", "lo")).select(*out), words


def find_repeats(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, line: the variants and recurring lines, and the short lines of recurring passages, that a document with a smaller id keeps; a line may come twice."""
    return repeated_rows(docs, **settings)[0].select("doc_id", "line")


def without_copies(docs: DataFrame, gone: DataFrame, words: DataFrame, copies: float) -> DataFrame:
    """The lines that go, but for those by which a document is a copy of the one that keeps them."""
    # cut before each join, so that it stands alone and Spark can split what meets at one document
    gone = cut(gone.groupBy("doc_id", "line").agg(F.min("lo").alias("lo"), F.max("size").alias("size")))
    lost = gone.groupBy("doc_id").agg(F.sum("size").alias("lost"))
    rest = cut(words.join(lost, "doc_id", "left").select("doc_id", (F.col("n_words") - F.coalesce("lost", F.lit(0.0))).alias("kept")))
    common = gone.groupBy("doc_id", "lo").agg(F.sum("size").alias("common"))
    likely = cut(common.join(rest, "doc_id").filter(F.col("common") >= LIKELY * F.col("kept")))
    pairs = likely.join(rest.select(F.col("doc_id").alias("lo"), F.col("kept").alias("lo_kept")), "lo")
    own, other = F.col("kept") + F.col("common"), F.col("lo_kept")
    share = F.col("common") / F.greatest(F.col("kept") + other, F.lit(1e-9))
    near = F.least(own, other) >= 0.9 * copies * F.greatest(own, other)
    pairs = cut(pairs.select("doc_id", "lo", share.alias("share"), near.alias("near")).filter(F.col("share") >= LIKELY))
    by_lines, unsure = (pairs.filter(c).select("doc_id", "lo") for c in (F.col("share") >= copies, (F.col("share") < copies) & F.col("near")))
    return gone.join(by_lines.union(alike(docs, unsure, copies)), ["doc_id", "lo"], "left_anti")


def alike(docs: DataFrame, pairs: DataFrame, share: float) -> DataFrame:
    """The pairs (doc_id, lo) whose texts have that share of their shingles in common; of rows with one id the first by its shingles counts."""
    needed = pairs.select(F.explode(F.array("doc_id", "lo")).alias("owner")).distinct()
    some, _ = touched(docs.select("doc_id", "text"), needed, "owner")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [own.tobytes() for own in shingle_sets(batch.column(1).to_pylist(), SHINGLE)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["owner", "tokens"])

    made = some.mapInArrow(sets_of, f"owner {kind}, tokens binary").join(needed, "owner", "left_semi")
    sets = cut(made.groupBy("owner").agg(F.min("tokens").alias("tokens")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= share * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["doc_id", "lo"])

    one, two = sets.select(F.col("owner").alias("doc_id"), F.col("tokens").alias("x")), sets.select(F.col("owner").alias("lo"), F.col("tokens").alias("y"))
    return cut(pairs.join(one, "doc_id").join(two, "lo").select("doc_id", "lo", "x", "y").mapInArrow(compare, f"doc_id {kind}, lo {kind}"))


def touched(docs: DataFrame, gone: DataFrame, key: str, bits: int = 1 << 23) -> tuple[DataFrame, DataFrame]:
    """The rows whose id may be in gone, and those whose id isn't, so that only the former are dealt out.

    A bit table of fixed size tells them apart, broadcast as at most bits / 64
    rows; an id that it lets through in error finds nothing.
    """
    word, held = unused("own_word", docs.columns), unused("own_bits", docs.columns)
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    marked = gone.select(cell(key).alias("at")).groupBy(F.shiftright("at", 6).alias(word)).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias(held))
    told = docs.join(F.broadcast(marked), F.shiftright(cell("doc_id"), 6) == F.col(word), "left")
    inside = F.coalesce(F.bit_get(held, (cell("doc_id") % 64).cast("int")) == 1, F.lit(False)) & F.col("doc_id").isNotNull()
    return told.filter(inside).drop(word, held), told.filter(~inside).drop(word, held)


def drop_repeats(docs: DataFrame, counted: bool = True, emptied: bool = True, copies: float | None = None, **settings) -> DataFrame:
    """The documents without their repeated lines.

    counted: n_dropped counts the lines of each row that went; emptied: rows
    stay of whose words none is left; copies: see above.
    """
    found, words = repeated_rows(docs, counted=copies is not None, **settings)
    if copies is not None:
        found = without_copies(docs, found, words, copies)
    names = [n for n in docs.columns if not (counted and n == "n_dropped")]
    own_id, own_lines = unused("gone_id", names), unused("gone_lines", names)
    gone = cut(found.groupBy(F.col("doc_id").alias(own_id)).agg(F.collect_set("line").alias(own_lines)))
    some, others = touched(docs, gone, own_id)
    columns = lambda rows, lines: rows.select(*[F.col(f"`{n}`") for n in names], lines)
    joined = columns(some.join(gone, some["doc_id"] == gone[own_id], "left"), F.col(own_lines)).union(columns(others, F.lit(None).cast("array<int>").alias(own_lines)))
    at_text = names.index("text")
    at_chars = names.index("n_chars") if "n_chars" in names else None

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at_text).to_pylist()
            dropped = []
            for k, lines in enumerate(batch.column(len(names)).to_pylist()):
                dropped.append(len(lines or ()))
                if lines:
                    out = set(lines)
                    texts[k] = "\n".join(x for n, x in enumerate(texts[k].split("\n")) if n not in out) if texts[k] is not None else None
            columns = list(batch.columns[: len(names)])
            columns[at_text] = pa.array(texts, pa.string())
            if at_chars is not None:
                new = [len(t) if n and t is not None else c for t, n, c in zip(texts, dropped, columns[at_chars].to_pylist())]
                columns[at_chars] = pa.array(new, columns[at_chars].type)
            made = pa.RecordBatch.from_arrays([*columns, *([pa.array(dropped, pa.int64())] if counted else [])], names=[*names, *(["n_dropped"] if counted else [])])
            yield made if emptied else made.filter(pa.array([not n or t is None or bool(t.strip(WHITE)) for n, t in zip(dropped, texts)]))

    small_batches(docs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)
    return joined.mapInArrow(rewrite, fields + (", n_dropped long" if counted else ""))
