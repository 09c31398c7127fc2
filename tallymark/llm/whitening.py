"""Whitening of vectors by principal components, fitted on counted distinct vectors.

Components become integers, so copies are exactly equal. Equal vectors are grouped once and carry their count; the fit
weighs each distinct vector with it (or with one, where copies should not count). The sums are exact integers; the
covariance is one weighted product of centred distinct vectors, added up in each task and then over tasks. Each distinct
vector is whitened once and joined back to its rows, by a SHA-256 digest of its integers; vectors that hold a large share
of all rows are broadcast for that.

Only sums and the covariance (dimensions x dimensions) reach the driver.

Defined results: vectors that are null, empty, or hold null or non-finite components are dropped, and so are those with a
component of 2^30 or more in size. Vectors of different lengths are fitted apart. Fewer dimensions than ``components``
give as many rows as dimensions. A component along which nothing varies has whitened 0 and explained 0 and is left out of
``identity_error`` (0 where nothing varies at all). ``deviation`` is null where it passes a long. Ids may repeat or be
null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallymark.llm.common import finite_vectors, saved, spread_join

SCALE, SHIFT = 1024.0, 100_000
COMPONENTS = 8
LIMIT = 2.0 ** 30
#: Eigenvalues below this share of their sum are rounding, not variance.
FLAT = 1e-13


def distinct(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Rows (key, digest, x) and distinct vectors (digest, x, size: how many rows have it)."""
    whole = F.transform("v", lambda c: F.floor(F.lit(SCALE) * c) + SHIFT)
    rows = finite_vectors(vectors, key, vector, LIMIT).select("key", whole.alias("x"))
    digest = F.unhex(F.sha2(F.array_join(F.col("x").cast("array<string>"), ","), 256))
    rows = saved(rows.withColumn("digest", digest))
    return rows, saved(rows.groupBy("digest", "x").agg(F.count("*").alias("size")))


def _open(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("x").flatten().to_numpy().reshape(-1, size), batch.column("weight").to_numpy()


def sums(points: DataFrame, size: int) -> tuple[int, list[int]]:
    """Total weight and exact weighted sums of the dimensions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, w = _open(batch, size)
                high, low = x >> 20, x & 0xFFFFF  # halves, so that no sum of a batch passes a long
                yield pa.record_batch([
                    pa.array([int(w.sum())], pa.int64()), pa.array([(w @ high).tolist()], pa.list_(pa.int64())),
                    pa.array([(w @ low).tolist()], pa.list_(pa.int64()))], names=["n", "high", "low"])

    partial = points.mapInArrow(run, "n bigint, high array<bigint>, low array<bigint>")
    wide = partial.select("n", F.posexplode(F.arrays_zip("high", "low")).alias("at", "s"))
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c[2:])
    found = {r.at: r for r in wide.groupBy("at").agg(F.sum("n").alias("n"), exact("s.high"), exact("s.low")).collect()}
    return found[0].n, [(int(found[k].high) << 20) + int(found[k].low) for k in range(size)]


def scaled(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - S, exact: longs, or Python's integers where a long could overflow."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, total)) < 2 ** 62:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def squares(apart: np.ndarray) -> list[int | None]:
    """Exact sums of squares; None where one passes a long."""
    if apart.dtype != object and apart.shape[1] * int(np.abs(apart).max(initial=0)) ** 2 < 2 ** 63:
        return np.square(apart).sum(axis=1).tolist()
    return [s if s < 2 ** 63 else None for s in np.square(apart.astype(object)).sum(axis=1)]


def covariance(points: DataFrame, size: int, n: int, total: list[int]) -> np.ndarray:
    """Weighted product of the centred vectors over n; a task sends one matrix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                x, w = _open(batch, size)
                y = scaled(x, n, total).astype(float) / n
                matrix += (y * w[:, None]).T @ y
        yield pa.record_batch([pa.array(range(size), pa.int32()), pa.array(list(matrix), pa.list_(pa.float64()))], names=["row", "x"])

    added = points.mapInArrow(run, "row int, x array<double>").select("row", F.posexplode("x").alias("at", "x"))
    matrix = np.zeros((size, size))
    for r in added.groupBy("row", "at").agg(F.sum("x").alias("x")).collect():  # size * size numbers
        matrix[r.row, r.at] = r.x / n
    return matrix


def identity_error(white: DataFrame, live: list[int], n: int) -> float:
    """Largest difference of the whitened vectors' weighted covariance from the identity, over the components that vary."""
    if not live:
        return 0.0
    z, w = F.col("z"), F.col("weight")
    means = white.agg(*[(F.sum(w * z[k]) / n).alias(f"m{k}") for k in live]).first()
    pairs = [(a, b) for a in live for b in live if a <= b]
    found = white.agg(*[
        (F.sum(w * (z[a] - means[f"m{a}"]) * (z[b] - means[f"m{b}"])) / n).alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max(abs(found[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
           weights: str = "counts") -> DataFrame:
    """``key``, component, n, deviation, whitened, explained and identity_error; ``weights``: counts of copies, or one."""
    if weights not in ("counts", "one"):
        raise ValueError("weights: counts or one")
    rows, points = distinct(vectors, key, vector)
    points = points.withColumn("weight", F.col("size") if weights == "counts" else F.lit(1).cast("long"))
    out = None
    for size in sorted(r[0] for r in points.groupBy(F.size("x")).agg(F.count("*")).collect()):  # a table has few lengths
        own = points.where(F.size("x") == size)
        fit = own.select("x", "weight")
        n, total = sums(fit, size)
        values, axes = np.linalg.eigh(covariance(fit, size, n, total))
        values, axes = np.clip(values[::-1], 0, None), axes[:, ::-1]
        trace, kept = float(values.sum()), min(components, size)
        live = [k for k in range(kept) if values[k] > FLAT * trace]
        turn = np.zeros((size, kept))
        turn[:, live] = axes[:, live] / np.sqrt(values[live])

        def run(batches, size=size, n=n, total=total, turn=turn):
            for batch in batches:
                x, w = _open(batch, size)
                apart = scaled(x, n, total)
                z = (apart.astype(float) / n) @ turn
                yield pa.record_batch([
                    batch.column("digest"), batch.column("size"), pa.array(w), pa.array(squares(apart), pa.int64()),
                    pa.array(list(z), pa.list_(pa.float64()))], names=["digest", "size", "weight", "deviation", "z"])

        white = saved(own.mapInArrow(run, "digest binary, size bigint, weight bigint, deviation bigint, z array<double>"))
        error = identity_error(white, live, n)
        share = F.array(*[F.lit(float(values[k] / trace) if k in live else 0.0) for k in range(kept)])
        whole = spread_join(rows.where(F.size("x") == size).select("key", "digest"), white.drop("weight"), "digest", "size")
        one = whole.select("key", "deviation", F.posexplode("z").alias("at", "whitened")).select(
            F.col("key").alias(key), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
            share[F.col("at")].alias("explained"), F.lit(float(error)).alias("identity_error"))
        out = one if out is None else out.unionAll(one)
    if out is None:
        kinds = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}
        out = rows.select(F.col("key").alias(key), *[F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()]).limit(0)
    return out
