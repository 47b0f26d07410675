"""Small linear learners over sparse rows, for bounded labelled samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_bytes: int = 20_000, text: str = "text", key: str = "doc_id") -> Iterator[tuple[str, int]]:
    """Different texts, with labels, of at most ``per_class`` documents of each class, drawn by a hash of the id.

    Bounded by its parameters: ids are drawn from ``labels`` first, so text is read once and joined with a list of at most
    twice ``per_class``, and of the texts that rows with one id hold the first is taken; documents over ``most_bytes``
    aren't used to learn from. A text with both labels counts as 1.
    """
    ids = [labels.where(F.col(label) == y).where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y")).orderBy(F.xxhash64("k", F.lit(11)), "k").limit(per_class) for y in (0, 1)]
    drawn = ids[0].unionByName(ids[1])
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull() & (F.octet_length("t") <= most_bytes)).join(F.broadcast(drawn), "k")
    found = rows.groupBy("k").agg(F.min("t").alias("t"), F.max("y").alias("y")).groupBy("t").agg(F.min("k").alias("k"), F.max("y").cast("int").alias("y")).orderBy("k").select("t", "y").toArrow()
    for b in found.to_batches(max_chunksize=100):
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)


class Rows:
    """Sparse rows: flat feature numbers and values, with the row of each."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], dim: int) -> None:
        self.n, self.dim = len(rows), dim
        self.row = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
        self.ix = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, int)
        self.x = np.concatenate([x for _, x in rows]) if rows else np.zeros(0)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.x * w[self.ix], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.ix, self.x * g[self.row], self.dim)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic(rows: Rows, y: np.ndarray, l2: float = 1e-3, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic regression, classes weighted alike, by accelerated gradients."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, b = np.zeros(rows.dim), 0.0
    v, c, step = w.copy(), b, 1.0 / (0.25 * max(1e-9, np.bincount(rows.row, rows.x**2, rows.n).max() + 1) + l2)
    for t in range(rounds):
        g = weight * (sigmoid(rows.dot(v) + c) - y)
        w2, b2 = v - step * (rows.back(g) + l2 * v), c - step * g.sum()
        k = t / (t + 3)
        v, c = w2 + k * (w2 - w), b2 + k * (b2 - b)
        w, b = w2, b2
    return w, b


def platt(z: np.ndarray, y: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Slopes of scores (a column or more) and an offset that make probabilities of them, by Newton steps on smoothed targets."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([z, np.ones(len(y))])
    ridge = np.array([1e-6] * x.shape[1])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        d = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(ridge), x.T @ (p - t) + ridge * w)
        w = w - np.clip(d, -5, 5)
        if np.abs(d).max() < 1e-8:
            break
    return w
