"""Small dense models fitted with numpy on bounded samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def adam(gradient, start: np.ndarray, steps: int = 400, rate: float = 0.05) -> np.ndarray:
    """Minimises by Adam with full gradients; deterministic."""
    w, m, v = start.astype(float).copy(), np.zeros(len(start)), np.zeros(len(start))
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3) -> np.ndarray:
    """Weights and, last, the intercept of a logistic regression."""
    weight = np.ones(len(y)) if weight is None else weight
    weight = weight / max(weight.sum(), 1e-9)

    def gradient(w: np.ndarray) -> np.ndarray:
        error = weight * (sigmoid(x @ w[:-1] + w[-1]) - y)
        return np.append(x.T @ error + l2 * w[:-1], error.sum())

    return adam(gradient, np.zeros(x.shape[1] + 1))


def sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, the same in every run: those of the smallest hashes of ``key``.

    A bound on the hash that about twice as many rows pass goes first, so that tasks send few rows on
    however many tasks there are.
    """
    order: Column = F.shiftrightunsigned(F.xxhash64(key, F.lit("sample")), 24)
    n = rows.select(key).count()
    bound = (1 << 40) if n <= 2 * most else (1 << 40) * 2 * most // n
    return rows.where(order < bound).orderBy(order, key).limit(most)


def carrying(docs: DataFrame, kept: DataFrame, text_col: str, *more: Column) -> DataFrame:
    """``kept`` (struct of its columns), ``text`` unless it is among them, and ``more``: whole texts travel once."""
    text = [] if text_col in kept.columns else [F.col(text_col).alias("text")]
    return docs.select(F.struct(*kept.columns).alias("kept"), *text, *more)


def text_place(kept: DataFrame, text_col: str) -> int | None:
    """Where ``carrying`` puts the text: its place in the struct, None for a column of its own."""
    return kept.columns.index(text_col) if text_col in kept.columns else None


def texts(part: pa.RecordBatch, place: int | None) -> list[str | None]:
    """The texts of a batch of ``carrying``'s rows."""
    return (part.column(1) if place is None else part.column(0).field(place)).to_pylist()
