"""Linear support vector machines by dual coordinate descent, and the sampling of rows to learn from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: Column) -> Column:
    """Whether the crc32 of the key as text leaves 2 modulo 4; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def may_learn(key: Column) -> Column:
    """Rows to learn from: not held out, and with a key."""
    return key.isNotNull() & ~held_out(key)


def sample_by(rows: DataFrame, label: str, key: str, most: int, salt: int = 7) -> DataFrame:
    """About ``most`` rows of ``rows``, as many of each label as there are, up to an equal share.

    Rows are chosen by a hash of the key against a rate for their label, without sorting or gathering. One row
    per label is counted on the driver.
    """
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return rows
    share = max(most // len(counts), 1)
    steps = 1 << 20
    rate = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(steps, -(-share * steps // n)))])
    return rows.where(F.pmod(F.xxhash64(F.lit(salt), key), F.lit(steps)) < rate[F.col(label)])


def train_svm(x: np.ndarray, positive: np.ndarray, cost: float = 1.0, rounds: int = 30, seed: int = 0) -> np.ndarray:
    """Weights, the last for the constant, of a linear SVM with squared hinge loss; labels weigh alike in sum."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    y = np.where(positive, 1.0, -1.0)
    share = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / max((~positive).sum(), 1)) * len(x)
    diagonal = 0.5 / (cost * share)
    norm = (x * x).sum(1) + diagonal
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    draw = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in draw.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1 + diagonal[i] * alpha[i]
            new = max(alpha[i] - gradient / norm[i], 0.0)
            step = new - alpha[i]
            if step:
                w += step * y[i] * x[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w
