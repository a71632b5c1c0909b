"""Toxicity: a factorization machine over hashed terms.

Terms are a text's words and the first 4 and 5 bytes of its words, each hashed
to 32 bits and present or not.  score = sigmoid(bias + sum of weights + sum over
pairs of terms of the products of their factors), so that a pair such as an
insult with a group mention counts for more, or less, than its parts.

The model is fitted on a bounded sample of labelled rows of the learning folds:
at most `positives` and `negatives` rows, chosen by a hash of the id.  Texts
that are copies of each other count once.  Everything else reads all rows.  The
sample is fitted in one task, so the driver holds the model only.

The machine has a weight and factors for at most VOCABULARY terms.  A term gets
its place by its own log-odds (LEAST_ROWS rows of the sample and a z of LEAST_Z
or more), or by a pair: of the PAIR_TERMS terms that divide the sample most
evenly, the PAIRS pairs whose covariance differs most between the labels (a z
of PAIR_Z or more, and PAIR_ROWS rows that hold both or would by chance) bring
both their terms in, however neutral each is alone.

Defined results: null and empty texts have no terms, so they get the score of
the bias; with no label of one kind every score is that kind's constant 0 or 1
(0 without any label); where an id has several labels the larger one holds;
rows that repeat are scored each; extra columns are ignored; drop_toxic returns
the columns of its input, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.folds import held_out, learns, share
from pagelattice.llm.textkernel import ALNUM, word_blocks
from pagelattice.session import small_batches

POSITIVES, NEGATIVES = 3000, 6000
VOCABULARY, LEAST_ROWS, LEAST_Z = 4096, 4, 3.0
PAIR_TERMS, PAIRS, PAIR_Z, PAIR_ROWS = 2048, 512, 10.0, 10
PREFIXES = (4, 5)
FACTORS = 4
#: A text of this score or more is toxic.
LIMIT = 0.5


def term_blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (term ids, number of their text); a term may come more than once."""
    for hashes, owner in word_blocks([(t or "").lower() for t in texts], ALNUM, False, PREFIXES):
        yield np.concatenate(hashes).astype(np.uint32), np.tile(owner, len(hashes))


@dataclass
class ToxicModel:
    terms: np.ndarray  # sorted
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.terms & np.uint32((1 << 20) - 1)] = True

    def features(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(position in terms, number of the text), each pair once."""
        found = []
        for ids, owner in term_blocks(texts):
            maybe = self.seen[ids & np.uint32((1 << 20) - 1)]
            ids, owner = ids[maybe], owner[maybe]
            at = np.minimum(np.searchsorted(self.terms, ids), max(0, len(self.terms) - 1))
            hit = self.terms[at] == ids if len(self.terms) else np.zeros(len(ids), bool)
            found.append(np.unique(owner[hit] * np.int64(1 << 20) + at[hit]))
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return both & ((1 << 20) - 1), both >> 20

    def score(self, texts: list[str | None]) -> np.ndarray:
        at, owner = self.features(texts)
        total = self.bias + np.bincount(owner, self.weights[at], minlength=len(texts))
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f]
            total = total + 0.5 * (np.bincount(owner, v, minlength=len(texts)) ** 2 - np.bincount(owner, v * v, minlength=len(texts)))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_machine(rows: list[np.ndarray], y: np.ndarray, size: int, epochs: int = 12, rate: float = 0.1, ridge: float = 1e-4) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by adaptive gradient steps; the order of rows is fixed."""
    random = np.random.default_rng(7)
    bias, w, v = 0.0, np.zeros(size), random.normal(0, 0.02, (size, FACTORS))
    seen_b, seen_w, seen_v = 1e-6, np.full(size, 1e-6), np.full((size, FACTORS), 1e-6)
    for _ in range(epochs):
        for k in random.permutation(len(rows)):
            at = rows[k]
            own = v[at]
            total = own.sum(0)
            x = bias + w[at].sum() + 0.5 * float((total * total - (own * own).sum(0)).sum())
            g = 1 / (1 + np.exp(-np.clip(x, -30, 30))) - y[k]
            seen_b += g * g
            bias -= rate * g / np.sqrt(seen_b)
            gw, gv = g + ridge * w[at], g * (total - own) + ridge * own
            seen_w[at] += gw * gw
            w[at] -= rate * gw / np.sqrt(seen_w[at])
            seen_v[at] += gv * gv
            v[at] -= 0.3 * rate * gv / np.sqrt(seen_v[at])
    return bias, w, v


def places(sets: list[np.ndarray], terms: np.ndarray) -> list[np.ndarray]:
    """Positions in the sorted terms of each set's members."""
    out = []
    for own in sets:
        at = np.searchsorted(terms, own)
        inside = at < len(terms)
        at, own = at[inside], own[inside]
        out.append(at[terms[at] == own])
    return out


def own_signal(sets: list[np.ndarray], y: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Each term's z of its log-odds; 0 in too few rows."""
    n = [int((y == k).sum()) for k in (0, 1)]
    held = [np.zeros(len(terms)), np.zeros(len(terms))]
    for own, label in zip(sets, y):
        held[label][np.searchsorted(terms, own)] += 1
    odds = [np.log((h + 0.5) / (m - h + 0.5)) for h, m in zip(held, n)]
    z = np.abs(odds[1] - odds[0]) / np.sqrt(1 / (held[1] + 0.5) + 1 / (held[0] + 0.5))
    return np.where(held[0] + held[1] < LEAST_ROWS, 0, z)


def pair_signal(sets: list[np.ndarray], y: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Each pair's z of the difference between its covariances in the two labels."""
    inner, size = places(sets, terms), len(terms)
    cov, spread, held, chance = [], [], 0, 0
    for label in (0, 1):
        rows = [r for r, k in zip(inner, y) if k == label]
        met, one = np.zeros((size, size), np.float32), np.zeros(size)
        for at in range(0, len(rows), 512):
            x = np.zeros((min(512, len(rows) - at), size), np.float32)
            for k, r in enumerate(rows[at : at + 512]):
                x[k, r] = 1
            met += x.T @ x
            one += x.sum(0)
        p = (one / len(rows)).astype(np.float32)
        held, chance = held + met, chance + np.outer(p, p) * np.float32(len(rows))
        cov.append(met / np.float32(len(rows)) - np.outer(p, p))
        spread.append(p * (1 - p) + np.float32(0.5 / len(rows)))
        spread[-1] = np.outer(spread[-1], spread[-1]) / np.float32(len(rows))
    z = np.abs(cov[1] - cov[0]) / np.sqrt(spread[0] + spread[1])
    return np.triu(np.where(np.maximum(held, chance) >= PAIR_ROWS, z, np.float32(0)), 1)


def choose_terms(sets: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The terms of the machine, sorted."""
    terms, rows = np.unique(np.concatenate(sets), return_counts=True)
    z = own_signal(sets, y, terms)
    z[z < LEAST_Z] = 0
    even = np.minimum(rows, len(sets) - rows)
    split = np.sort(np.argsort(-even, kind="stable")[:PAIR_TERMS])
    split = split[even[split] >= LEAST_ROWS]
    if len(split):
        pairs = pair_signal(sets, y, terms[split])
        known = z[split] > 0
        pairs[np.outer(known, known)] = 0
        best = np.argsort(-pairs, axis=None, kind="stable")[:PAIRS]
        best = best[pairs.reshape(-1)[best] >= PAIR_Z]
        for at in (best // len(split), best % len(split)):
            np.maximum.at(z, split[at], pairs.reshape(-1)[best])
    return terms[np.sort(np.argsort(-z, kind="stable")[: min(VOCABULARY, int((z > 0).sum()))])]


def fit(rows: list[tuple[int, np.ndarray]]) -> ToxicModel:
    """The model of a sample of (label, terms); the order of the rows doesn't matter."""
    known = {(hash_of(own), label): own for label, own in rows}
    order = sorted(known)
    y, sets = np.array([label for _, label in order], np.int64), [known[k] for k in order]
    if not y.any() or y.all():
        return constant(bool(len(y)) and bool(y.all()))
    terms = choose_terms(sets, y)
    bias, w, v = fit_machine(places(sets, terms), y.astype(float), len(terms))
    return ToxicModel(terms, bias - float(np.log(y.sum() / (len(y) - y.sum()))), w, v)


def constant(toxic: bool) -> ToxicModel:
    return ToxicModel(np.zeros(0, np.uint32), 30.0 if toxic else -30.0, np.zeros(0), np.zeros((0, FACTORS)))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> ToxicModel:
    spark = docs.sparkSession
    known = labels.filter(F.col("toxic").isNotNull() & learns()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return constant(bool(n.get(1)))
    ids = [r for kind, most in ((1, positives), (0, negatives)) for r in known.filter(F.col("toxic") == kind).orderBy(share(), "doc_id").limit(most).collect()]
    chosen = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in ids], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, y = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            own = [np.zeros(0, np.uint32)] * len(texts)
            for ids, owner in term_blocks(texts):
                order = np.argsort(owner, kind="stable")
                ids, owner = ids[order], owner[order]
                for k in np.unique(owner):
                    a, b = np.searchsorted(owner, [k, k + 1])
                    own[k] = np.unique(np.append(own[k], ids[a:b]))
            yield pa.RecordBatch.from_arrays([pa.array([hash_of(x) for x in own], pa.int64()), pa.array(y, pa.int32()), pa.array([x.tobytes() for x in own], pa.binary())], names=["h", "toxic", "terms"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(y, np.frombuffer(x, np.uint32)) for batch in batches for y, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], names=["model"])

    texts = sample.select("text", "toxic").mapInArrow(terms, "h long, toxic int, terms binary").dropDuplicates(["h", "toxic"])
    made = texts.select("toxic", "terms").repartition(1).mapInArrow(fitted, "model binary").collect()
    if not made:
        return constant(False)
    model: ToxicModel = pickle.loads(made[0]["model"])
    model.bias += float(np.log(n[1] / n[0]))
    return model


def hash_of(ids: np.ndarray) -> int:
    """The same for equal sets of terms."""
    return int((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (ids.astype(np.uint64) << np.uint64(29))).sum(dtype=np.uint64).astype(np.int64))


def score_toxicity(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, positives, negatives))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= LIMIT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """The rows whose score is under LIMIT, as they are."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, positives, negatives))
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(batch.column(at_text).to_pylist()) < LIMIT))

    return docs.mapInArrow(run, docs.schema)
