"""Bounded samples of labelled documents, and small fits on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgaudit.llm.exprs import fold, narrow
from kgaudit.session import checkpointed


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, each: int, id_col: str = "doc_id", text_col: str = "text", parts: int = 24,
) -> DataFrame:
    """text, label of at most ``each`` documents of either label outside the held-out fold. Stored.

    A label's rows are taken in the order of a hash of their id, so the sample doesn't depend on
    how the tables are stored. Rows with a null id or label are left out; of several labels
    of one id the largest counts.
    """
    own = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label"))
    own = own.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("doc_id"), folds) != held))
    order = F.xxhash64("doc_id")
    picked = None
    for value in (0, 1):
        some = own.groupBy("doc_id").agg(F.max("label").alias("label")).filter(F.col("label") == value).orderBy(order, "doc_id").limit(each)
        picked = some if picked is None else picked.union(some)
    rows = narrow(docs, id_col, text_col).join(checkpointed(picked), "doc_id")
    return checkpointed(rows.dropDuplicates(["doc_id"]).select("doc_id", "text", "label").repartition(parts, "doc_id"))


def with_fold(scored: DataFrame, folds: int, held: int, cut: float) -> DataFrame:
    """``scored`` (doc_id, score) with held_out and predicted."""
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"),
    )


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights (the last one a bias) of a ridge logistic regression, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.eye(x.shape[1]) * ridge * len(x)
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w
