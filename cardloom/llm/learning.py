"""Bounded labelled samples for the classifiers, and small numpy learners."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str = "doc_id", n: int = 3) -> Column:
    """crc32 of doc_id as text, mod n; null for a null doc_id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def remainder_of(doc_id, n: int) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text, y of at most ``most`` labelled documents, picked by a hash of doc_id; never held-out rows.

    ``most`` is the documented bound of the sample that classifiers are fitted on. Rows with null ids or labels are
    left out; a doc_id labelled or stored twice counts once (its greatest label, its least text).
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y is not null")
    own = own.filter(remainder() != 1).groupBy("doc_id").agg(F.max("y").alias("y"))
    picked = F.broadcast(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))  # at most `most` rows of 12 bytes
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(picked, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 60, prior: np.ndarray | None = None) -> np.ndarray:
    """Weights with the bias last, by Newton's method; constant labels give a constant score.

    Weights are drawn to prior (else 0), where those stay of which the rows say nothing.
    """
    x = np.c_[x, np.ones(len(x))] if len(x) else np.zeros((0, x.shape[1] + 1))
    to = np.zeros(x.shape[1]) if prior is None else np.r_[prior, 0.0]
    w = np.zeros(x.shape[1])
    if not len(x) or y.min() == y.max():
        w[-1] = 0.0 if not len(x) else (8.0 if y[0] else -8.0)
        return w
    w = to.copy()
    ridge = np.full(len(w), l2 * len(x))
    ridge[-1] = 1e-6 * len(x)
    for _ in range(rounds):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) + ridge * (w - to)
        hess = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(hess, grad)
        w -= move * min(1.0, 5.0 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-7:
            break
    return w
