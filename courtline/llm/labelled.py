"""Learning from labelled documents: folds, bounded samples, and logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

FOLDS = 5


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text modulo 5; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int]) -> DataFrame:
    """doc_id, text, y and fold of up to most[y] labelled documents of each label y outside fold 0.

    Documents are taken in the order of a hash of doc_id, from the labels alone, so the sample is
    bounded before texts are read. Of several labels of a document the largest counts.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in most.items()]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # bounded by most
    return saved(rows.withColumn("fold", fold(F.col("doc_id")).cast("int")), "labelled")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of 1 and the columns of x, by Newton's method with a small ridge; rows weigh the same."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def probability(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
