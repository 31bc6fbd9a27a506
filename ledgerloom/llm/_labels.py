"""Bounded samples of labelled rows, and logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class that a model is fitted on, at most.
SAMPLE_ROWS = 4000
#: Bytes of their texts, at most for each class; a row that would exceed it isn't taken.
SAMPLE_BYTES = 40 << 20
FOLDS = 5


def held_out(id_col: Column, folds: int = FOLDS) -> Column:
    """Whether crc32 of the id as text is 0 modulo folds. A null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, n_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of rows that aren't held out, in the order of a hash of the id.

    Rows without a label or an id aren't taken; of several labels of an id the largest
    counts, and of several texts of an id the one that sorts last.
    """
    own = F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))
    known = labels.where(own).groupBy(F.col(id_col).alias("__id")).agg(F.max(label).cast("int").alias("__label"))
    sizes = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("__bytes")).groupBy("__id").agg(F.max("__bytes").alias("__bytes"))
    joined = known.join(sizes, "__id")
    chosen: dict = {}
    for value in (0, 1):
        room = n_bytes
        for row in joined.where(F.col("__label") == value).orderBy(F.xxhash64("__id"), "__id").limit(rows).collect():
            if row["__bytes"] <= room:
                room -= row["__bytes"]
                chosen[row["__id"]] = value
    if not chosen:
        return [], np.zeros(0)
    ids = docs.sparkSession.createDataFrame([(k,) for k in chosen], f"__id {docs.schema[id_col].dataType.simpleString()}")
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("binary").alias("__text")).join(F.broadcast(ids), "__id").toLocalIterator()
    found: dict = {}
    for i, t in texts:
        found[i] = max(found.get(i, b""), bytes(t or b""))
    order = [i for i in chosen if i in found]
    return [found[i] for i in order], np.array([chosen[i] for i in order], dtype=float)


class Logistic:
    """Ridge logistic regression on standardised features; balanced: with weights that
    make both classes count alike. With one class or no rows at all the score is the
    share of label 1, one half without rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, balanced: bool = False):
        self.constant = None
        if len(y) == 0 or len(set(y)) < 2:
            self.constant = float((np.sum(y) + 0.5) / (len(y) + 1))
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) if balanced else np.ones(len(y))
        w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * (z.shape[1] - 1) + [1e-6])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (weight * (y - p)) - penalty @ w)
            size = np.abs(step).max()
            w = w + step * min(1.0, 4.0 / size if size else 1.0)
            if size < 1e-6:
                break
        self.w = w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(z @ self.w[:-1] + self.w[-1], -30, 30)))
