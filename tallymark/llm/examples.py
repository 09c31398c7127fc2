"""A bounded sample of labelled documents to fit a classifier on, and its calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tallymark.llm.common import fold, saved


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int, folds: int = 5, key: str = "doc_id",
             text: str = "text") -> DataFrame:
    """At most ``bound`` rows (id, y, text) with a label outside fold 0, in the order of a hash of the id.

    Null ids, labels and texts teach nothing. An id with several labels has the greatest, one with several texts the
    least text.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (fold(key, folds) != 0))
    known = known.groupBy(F.col(key).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    known = known.join(docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id")).distinct(), "id", "left_semi")
    chosen = saved(known.orderBy(F.xxhash64("id"), "id").limit(bound))
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    return saved(texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text")))


def monotone(values: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing curve closest to ``y`` over ``values`` (pool adjacent violators), kept inside (0, 1)."""
    order = np.argsort(values, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first value, last value
    for v, t in zip(values[order].tolist(), y[order].tolist(), strict=True):
        if blocks and blocks[-1][3] == v:
            blocks[-1][0] += t
            blocks[-1][1] += 1
        else:
            blocks.append([t, 1, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, end = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = end
    x = np.array([v for b in blocks for v in (b[2], b[3])], float)
    p = np.array([(b[0] + 0.5) / (b[1] + 1.0) for b in blocks for _ in range(2)], float)
    return x, np.maximum.accumulate(p)
