"""Affinity propagation of each page's elements, the alternative to clustering by distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def exemplars(similarity: np.ndarray, damping: float = 0.5, rounds: int = 200, steady: int = 15) -> np.ndarray:
    """The exemplar of each element by responsibilities and availabilities; the preference is the median similarity."""
    n = len(similarity)
    s = similarity.astype(float).copy()
    off = ~np.eye(n, dtype=bool)
    np.fill_diagonal(s, np.median(s[off]) if n > 1 else 0.0)
    # equal similarities would never settle; the shift depends on the place alone
    s += 1e-12 * np.arange(n * n).reshape(n, n) / max(1, n * n)
    r, a = np.zeros((n, n)), np.zeros((n, n))
    last, same = np.full(n, -1), 0
    for _ in range(rounds):
        total = a + s
        first = total.argmax(1)
        top = total[np.arange(n), first]
        total[np.arange(n), first] = -np.inf
        new = s - top[:, None]
        new[np.arange(n), first] = s[np.arange(n), first] - total.max(1)
        r = damping * r + (1 - damping) * new
        kept = np.maximum(r, 0)
        np.fill_diagonal(kept, np.diag(r))
        new = kept.sum(0)[None, :] - kept
        own = np.diag(new).copy()
        new = np.minimum(new, 0)
        np.fill_diagonal(new, own)
        a = damping * a + (1 - damping) * new
        chosen = np.flatnonzero(np.diag(r) + np.diag(a) > 0)
        if not len(chosen):
            continue
        found = chosen[s[:, chosen].argmax(1)]
        found[chosen] = chosen
        same = same + 1 if (found == last).all() else 0
        last = found
        if same >= steady:
            break
    return last if (last >= 0).all() else np.arange(n)


def propagated(distances: DataFrame, key: str = "page_id", distance: str = "dist") -> DataFrame:
    """key, idx, exemplar: a page's pairs meet in one task, as its messages go between all of them."""
    kind = distances.schema[key].dataType.simpleString()

    def page(rows: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.concatenate([rows["i"], rows["j"]]), return_inverse=True)
        i, j = at[: len(rows)], at[len(rows) :]
        s = np.zeros((len(names), len(names)))
        s[i, j] = s[j, i] = -rows[distance].to_numpy()
        return pd.DataFrame({key: rows[key].iloc[0], "idx": names, "exemplar": names[exemplars(s)]})

    return distances.select(key, "i", "j", distance).groupBy(key).applyInPandas(page, f"`{key}` {kind}, idx long, exemplar long")
