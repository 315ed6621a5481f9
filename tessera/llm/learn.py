"""Bounded labelled samples and a small logistic model, for the classifiers."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fold_of

#: Labelled rows of each class that a classifier learns from at most, and bytes of the longest.
ROWS_PER_CLASS, LONGEST = 5000, 120_000


class Sample(NamedTuple):
    """Texts with their labels, weights and ids."""

    texts: list[str]
    y: np.ndarray
    weight: np.ndarray
    ids: list


def clear_labels(labels: DataFrame, label: str, held_out: int = 0) -> DataFrame:
    """``doc_id, y`` outside the held-out fold; ids with a null label or with two different labels are left out."""
    return (
        labels.where(F.col(label).isin(0, 1) & (fold_of(F.col("doc_id")) != held_out))
        .groupBy("doc_id")
        .agg(F.min(label).alias("low"), F.max(label).alias("y"))
        .where("low = y")
        .select("doc_id", F.col("y").cast("int").alias("y"))
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: int = 0, per_class: int = ROWS_PER_CLASS, longest: int = LONGEST) -> Sample:
    """A bounded sample of the rows outside the held-out fold.

    The rows of each class come in the order of a hash of their id, at most ``per_class`` of them
    and none longer than ``longest`` bytes, so the sample has a proven bound and is the same on
    every run. The weights restore the classes' shares among all labels. Ids with a null label or
    with two different labels are left out; where an id has several texts, the least of them counts.
    """
    of = clear_labels(labels, label, held_out)
    share = {r["y"]: r["count"] for r in of.groupBy("y").count().collect()}
    order = [F.xxhash64(F.lit(label), "doc_id"), F.col("doc_id")]
    picked = of.where("y = 0").orderBy(*order).limit(per_class).unionByName(of.where("y = 1").orderBy(*order).limit(per_class))
    rows = (
        docs.select("doc_id", "text")
        .where(F.col("text").isNotNull() & (F.octet_length("text") <= longest))
        .join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id", "y")
        .agg(F.min("text").alias("text"))
        .orderBy(*order)
        .toPandas()
    )
    y = rows["y"].to_numpy(int)
    total = max(1, sum(share.values()))
    weight = np.array([share.get(c, 0) / total / max(1, (y == c).sum()) for c in y])
    return Sample(rows["text"].tolist(), y, weight * len(y), rows["doc_id"].tolist())


class Logistic:
    """Ridge logistic regression on standardised features, by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z, self.w = self._z(x), np.zeros(x.shape[1] + 1)
        penalty = ridge * len(y) * np.eye(len(self.w))
        penalty[-1, -1] = 1e-6
        for _ in range(rounds):
            p = self._sigmoid(z @ self.w)
            step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (weight * (p - y)) + penalty @ self.w)
            self.w -= np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-9:
                break

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.c_[(x - self.mean) / self.scale, np.ones(len(x))]

    @staticmethod
    def _sigmoid(v: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(v, -40, 40)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._sigmoid(self._z(x) @ self.w)
