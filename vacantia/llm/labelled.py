"""Labelled rows for classifiers: the training split and bounded samples of it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier learns from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """``doc_id, label`` (0 or 1) of the rows to learn from; of repeated ids the larger label."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    rows = rows.where(~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))


def sampled_labels(training: DataFrame, per_class: int) -> DataFrame:
    """Up to ``per_class`` rows of each label, chosen by a hash of the id, with ``weight``.

    ``weight`` is the number of training rows that one sampled row stands for.
    """
    parts = []
    sizes = {row.label: row["count"] for row in training.groupBy("label").count().collect()}  # two rows at most
    for label in (0, 1):
        part = training.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        weight = sizes.get(label, 0) / max(1, min(per_class, sizes.get(label, 0)))
        parts.append(part.withColumn("weight", F.lit(float(weight))))
    return parts[0].unionByName(parts[1])


def sampled_docs(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """``doc_id, text, label, weight`` of the sample; at most ``2 * per_class`` ids are broadcast."""
    sample = sampled_labels(training_labels(labels, label), per_class)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights and intercept (last) of a logistic model, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    weight = weight / max(weight.sum(), 1e-9) * max(1, len(y))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge * w
        curvature = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w += step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
