"""What the two classifiers share: label samples, folds, bag sums and the Adam update."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def label_sample(labels: DataFrame, label_col: str, training: Column, rows: int) -> DataFrame:
    """doc_id and label (0 or 1) of at most ``rows`` labelled ids, those with the smallest hash.

    Null labels and ids are left out. An id with several labels gets the largest.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & training)
    return (known.groupBy("doc_id").agg(F.max(F.col(label_col).cast("int")).alias("label"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def bag_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over the bags ``first[b]:first[b + 1]``, none of which is empty."""
    return np.add.reduceat(values, first[:-1], axis=0)


class Adam:
    def __init__(self, parameters: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = parameters, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in parameters.items()}
        self.v = {k: np.zeros_like(v) for k, v in parameters.items()}

    def step(self, gradient: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in gradient.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            m, v = self.m[k] / (1 - 0.9 ** self.t), self.v[k] / (1 - 0.999 ** self.t)
            self.p[k] -= self.rate * m / (np.sqrt(v) + 1e-8)
