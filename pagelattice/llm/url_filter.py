"""URL filter: host and path rules first, then a ratio of two character models.

Two smoothed variable-order Markov models are counted, one over the URLs that
rules allow and one over those they block.  A URL that no rule fits is judged
by its log-likelihood difference divided by its length, on a scale that is
calibrated on labelled URLs kept out of the counts.  All labelled URLs take
part, in the counts or in the calibration.  Runs of up to EXACT characters have
a cell of their own, longer ones share 2^HASHED_BITS cells by a hash, so what
the driver and the executors hold is bounded; once those cells fill up, the
highest orders tell less (README: how full they are).

Defined results: a URL that is null or has no `://` has an empty host and path
and fits no rule; its score is 0 before calibration.  With no labelled URL of
one kind, URLs without a rule are allowed.  URLs that repeat are judged each.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Host, path and verdict of each rule.
RULES: tuple[tuple[str, str, str], ...] = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
ORDER = 4
EXACT, HASHED_BITS = 3, 20
PRIOR = 2.0
BIN = 0.01
BINS = 2000
_KNOWN = string.ascii_lowercase + string.digits + "./-_?=&#%:+~@,;!"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule, as host and path, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own, start, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(start))
        name, verdict = F.when(fits, F.lit(own + start)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def coded(urls: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character classes of all URLs with ORDER blanks before each; positions of characters; their URL."""
    table = np.full(256, 63, np.uint64)
    for k, c in enumerate(_KNOWN):
        table[ord(c)] = k + 1
    table[0] = 0
    raw = [(u or "").lower().split("://", 1)[-1].encode("utf-8", "surrogatepass") for u in urls]
    pad = b"\0" * ORDER
    joined = np.frombuffer(b"".join(pad + r for r in raw), np.uint8)
    sizes = np.array([len(r) for r in raw], np.int64)
    owner = np.repeat(np.arange(len(raw)), sizes)
    return table[joined], np.arange(len(owner)) + (owner + 1) * ORDER, owner


def sizes_of() -> list[int]:
    """Cells of the contexts of each order, then of the contexts with their character."""
    return [1 << (6 * n if n <= EXACT else HASHED_BITS) for n in (*range(ORDER + 1), *range(1, ORDER + 2))]


#: Where each of those begins, and all of them.
STARTS = np.cumsum([0, *sizes_of()])
CELLS = int(STARTS[-1])


def cells_of(codes: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """By order: the cell of the context, and of context with character."""

    def cell(run: np.ndarray, n: int, start: int) -> np.ndarray:
        if n > EXACT:
            run = (run + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            run = (run ^ (run >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - HASHED_BITS)
        return run.astype(np.int64) + start

    contexts, whole = [], []
    context = np.zeros(len(at), np.uint64)
    for k in range(ORDER + 1):
        if k:
            context = context + (codes[at - k] << np.uint64(6 * (k - 1)))
        contexts.append(cell(context, k, int(STARTS[k])))
        whole.append(cell(context + (codes[at] << np.uint64(6 * k)), k + 1, int(STARTS[ORDER + 1 + k])))
    return contexts, whole


@dataclass
class UrlModel:
    """Counts by verdict (0 allow, 1 block) and cell; scale and offset of the calibration."""

    counts: np.ndarray
    scale: float = 1.0
    offset: float = 0.0
    trained: bool = True

    def __getstate__(self) -> dict:
        """Most cells are blank until there are very many URLs, so the counts travel compressed."""
        return {**self.__dict__, "counts": zlib.compress(self.counts.tobytes(), 1)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, counts=np.frombuffer(zlib.decompress(state["counts"]), np.float32).reshape(2, CELLS))

    def score(self, urls: Sequence[str | None]) -> np.ndarray:
        """Log-likelihood difference by character: above 0 reads like a blocked URL."""
        codes, at, owner = coded(urls)
        contexts, whole = cells_of(codes, at)
        logs = []
        for side in self.counts:
            p = np.full(len(at), 1 / 64)
            for k in range(ORDER + 1):
                p = (side[whole[k]] + PRIOR * p) / (side[contexts[k]] + PRIOR)
            logs.append(np.log(np.minimum(p, 1.0)))
        total = np.bincount(owner, logs[1] - logs[0], minlength=len(urls))
        return total / np.maximum(1, np.bincount(owner, minlength=len(urls)))

    def block_probability(self, urls: Sequence[str | None]) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(urls))
        return 1 / (1 + np.exp(-np.clip(self.scale * self.score(urls) + self.offset, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Scale and offset of a logistic curve, by damped Newton steps with a weak prior."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (p - y) * x).sum() + 1e-2 * (a - 1), (weight * (p - y)).sum() + 1e-2 * b])
        w = weight * p * (1 - p)
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        step = np.clip(np.linalg.solve(h, g), -5, 5)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def train(labelled: DataFrame, url: str = "url", verdict: str = "rule_verdict") -> UrlModel:
    """Counts on four fifths of the labelled URLs; calibration on the others."""
    folds = labelled.select(F.col(url).alias("url"), (F.col(verdict) == "block").cast("int").alias("side"), F.pmod(F.crc32(F.col(url)), F.lit(5)).alias("fold"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, CELLS), np.int64)
        for batch in batches:
            sides = np.array(batch.column(1).to_pylist(), np.int64)
            urls = batch.column(0).to_pylist()
            for side in (0, 1):
                codes, at, _ = coded([u for u, s in zip(urls, sides) if s == side])
                for cells in cells_of(codes, at):
                    for cell in cells:
                        np.add.at(held[side], cell, 1)
        flat = held.reshape(-1)
        some = np.flatnonzero(flat)
        for at in range(0, len(some), 50_000):
            part = some[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(flat[part])], names=["cell", "n"])

    rows = folds.filter("fold <> 0").select("url", "side").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(2 * CELLS, np.float32)
    counts[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    model = UrlModel(counts.reshape(2, CELLS))
    model.trained = bool((model.counts[:, 0] > 0).all())
    if not model.trained:
        return model
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = shared.value.score(batch.column(0).to_pylist())
            bins = np.clip(np.floor(x / BIN), -BINS, BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(1)], names=["bin", "side"])

    kept = folds.filter("fold = 0").select("url", "side").mapInArrow(scores, "bin long, side int").groupBy("bin", "side").count().toArrow()
    shared.destroy()
    if kept.num_rows:
        model.scale, model.offset = fit_logistic((kept["bin"].to_numpy() + 0.5) * BIN, kept["side"].to_numpy().astype(float), kept["count"].to_numpy().astype(float))
    return model


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict and block_probability of each row's URL."""
    parsed = pages.select(F.col(key), F.col(url).alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    name, says = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": name, "rule_verdict": says})
    model = train(parsed.filter("rule is not null"))
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kind = pages.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.block_probability(batch.column(1).to_pylist())
            verdict = [says or ("block" if q >= 0.5 else "allow") for says, q in zip(batch.column(5).to_pylist(), p)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(4), pa.array(verdict, pa.string()), pa.array(p, pa.float64())], names=[key, "host", "path", "rule", "verdict", "block_probability"])

    return parsed.mapInArrow(judge, f"`{key}` {kind}, host string, path string, rule string, verdict string, block_probability double")
