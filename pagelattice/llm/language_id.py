"""Language identification: sparse multinomial logistic regression on TF-IDF.

Features are character 1- to 3-grams of the lower-cased text with runs of
non-letters as one blank, hashed to SIZE cells; their weights are
(1 + log count) x idf, scaled to length 1.  The weights of the model are
trained by follow-the-regularised-leader with an elastic net, so most are
exactly 0; a temperature fitted on rows kept out of the training calibrates
the probabilities.

The document frequencies are counted over all rows of the learning folds; the
classifier is fitted on a bounded sample of them: of each language's distinct
texts the `per_language` first by a hash of the text, and fewer of each if the
languages share `most_rows`, but LEAST_EACH at least.  Every language with a
labelled text is learnt; the weights on the driver grow with the number of
languages, not with the rows.  The sample, and with it every prediction, depends
on the rows alone and not on their order or partitions.

Defined results: a null text, or one without a letter, is `und` with score 0;
without any labelled row every text is `und`; rows that repeat are predicted
each; languages that tie go to the first by name; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.folds import held_out, learns
from pagelattice.session import small_batches

SIZE = 1 << 15
PER_LANGUAGE, MOST_ROWS, LEAST_EACH = 1000, 4000, 5
PIECE = 1 << 20
LETTER = regex.compile(r"\p{L}")
_letters = np.array([chr(c).isalpha() for c in range(0xD800)] + [False] * 0x800 + [chr(c).isalpha() for c in range(0xE000, 0x10000)] + [True])


def cells(text: str) -> Iterator[np.ndarray]:
    """Cells of the text's character n-grams; each n-gram counts in the piece of PIECE characters in which it ends."""
    last, inside = np.zeros(0, np.uint64), True
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters[np.minimum(codes, 0x10000)]
        kept = letter | np.append(inside, letter[:-1])
        inside = bool(letter[-1])
        codes = np.append(last, np.where(letter, codes, 32)[kept].astype(np.uint64))
        old = len(last)
        gram = np.zeros(len(codes), np.uint64)
        for n in range(1, 4):
            if len(codes) < n:
                break
            gram = gram[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
            spread = (gram[max(0, old - n + 1) :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            yield (spread >> np.uint64(49)).astype(np.int64)
        last = codes[-2:]


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The cells of the text's n-grams, sorted, and how often each occurs."""
    if 3 * len(text) < SIZE:
        return np.unique(np.concatenate([np.zeros(0, np.int64), *cells(text)]), return_counts=True)
    total = np.zeros(SIZE, np.int64)
    for cell in cells(text):
        total += np.bincount(cell, minlength=SIZE)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # cell x language
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (1 + np.log(n)) * self.idf[at]
        return at, x / max(np.sqrt((x * x).sum()), 1e-12)

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        at, x = self.vector(at, n)
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not LETTER.search(text):
            return "und", 0.0
        p = softmax(self.logits(*counts(text)) / self.temperature)
        return self.languages[int(p.argmax())], float(p.max())


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_leader(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, kinds: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, lasso: float = 0.02, ridge: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by FTRL-proximal steps with an elastic net; the biases go without penalty."""
    z, n = np.zeros((SIZE + 1, kinds)), np.zeros((SIZE + 1, kinds))
    penalty = np.full((SIZE + 1, 1), lasso)
    penalty[SIZE] = 0

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        return np.where(np.abs(own) <= penalty[at], 0.0, -(own - np.sign(own) * penalty[at]) / ((beta + np.sqrt(n[at])) / alpha + ridge))

    random = np.random.default_rng(11)
    for _ in range(epochs):
        for k in random.permutation(len(rows)):
            at, x = np.append(rows[k][0], SIZE), np.append(rows[k][1], 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[y[k]] -= 1
            g = np.outer(x, p)
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(np.arange(SIZE + 1))
    return w[:SIZE], w[SIZE]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log-loss, from a fixed grid."""
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 80))
    return float(min(grid, key=lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).sum()))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS) -> LanguageModel:
    learnt = docs.select("doc_id", "text", "lang").filter(learns() & F.col("lang").isNotNull())
    tally = learnt.filter("text is not null").groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in tally)
    if not languages:
        return LanguageModel([], np.ones(SIZE), np.zeros((SIZE, 0)), np.zeros(0))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros(SIZE, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held[counts(text)[0]] += 1
                rows += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(held[at], rows))], names=["cell", "n"])

    found = learnt.filter("text is not null").select("text").mapInArrow(frequencies, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(SIZE + 1)
    frequency[found["cell"].to_numpy()] = found["n"].to_numpy()
    idf = np.log((1 + frequency[SIZE]) / (1 + frequency[:SIZE])) + 1

    each = max(LEAST_EACH, min(per_language, most_rows // len(languages)))
    # a threshold on the hash lets up to half as much again through, so that no language is sorted whole; the driver leaves out what is over
    part = docs.sparkSession.createDataFrame([(r["lang"], min(1_000_000, 1 + 1_500_000 * each // r["count"])) for r in tally], "lang string, part long")
    marked = learnt.filter("text is not null").select("text", "lang", F.xxhash64("text").alias("share"))
    chosen = marked.join(F.broadcast(part), "lang").filter(F.pmod("share", F.lit(1_000_000)) < F.col("part")).select("text", "lang", "share")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [counts(t) for t in batch.column(0).to_pylist()]
            packed = [pa.array([x[k].astype(kind).tobytes() for x in own], pa.binary()) for k, kind in ((0, np.uint16), (1, np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *packed], names=["lang", "share", "at", "n"])

    rows = chosen.mapInArrow(featured, "lang string, share long, at binary, n binary").dropDuplicates(["lang", "share"]).toArrow().sort_by([("share", "ascending"), ("lang", "ascending")])
    left = dict.fromkeys(languages, each)
    kept = []
    for k, lang in enumerate(rows["lang"].to_pylist()):
        left[lang] -= 1
        if left[lang] >= 0:
            kept.append(k)
    rows = rows.take(pa.array(kept, pa.int64()))
    model = LanguageModel(languages, idf, np.zeros((SIZE, len(languages))), np.zeros(len(languages)))
    vectors = [model.vector(np.frombuffer(at, np.uint16).astype(np.int64), np.frombuffer(n, np.int64)) for at, n in zip(rows["at"].to_pylist(), rows["n"].to_pylist())]
    y = np.array([languages.index(x) for x in rows["lang"].to_pylist()], np.int64)
    if not len(y):
        return LanguageModel([], idf, model.weights, model.bias)
    # every fifth text of a language calibrates, so that a language of few texts is learnt all the same
    place = np.zeros(len(y), np.int64)
    for k in range(len(languages)):
        place[y == k] = np.arange(int((y == k).sum()))
    kept = place % 5 == 4
    learn = [v for v, k in zip(vectors, kept) if not k]
    model.weights, model.bias = fit_leader(learn, y[~kept], len(languages))
    if kept.any():
        model.temperature = fit_temperature(np.array([x @ model.weights[at] + model.bias for (at, x), k in zip(vectors, kept) if k]), y[kept])
    return model


def identify_languages(docs: DataFrame, per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row's whole text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, per_language, most_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
