"""Co-moments of many columns at once, from Arrow batches as matrices.

A batch of rows is a matrix X of values, nulls being zero, beside a mask M of what is there. The counts, sums, sums of
squares and sums of products of every pair of columns over the rows where both are present are then four products of
matrices: M'M, X'M, (X²)'M and X'X. A task adds up its batches and Spark adds up the tasks, so all pairs of any number of
columns take one scan. Values are shifted and scaled by a sample's mean and spread first, which changes no coefficient
and keeps the sums well conditioned; a pair whose rest still is close to rounding is left to be computed by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.values import quoted

#: Rows that the shift and scale are taken from; any rows do, they only keep the sums well conditioned.
PILOT_ROWS = 1000
#: A variance below this share of the mean square may be rounding.
UNSURE = 1e-9
PAIRS_AT_ONCE = 1024
PIECE_ROWS = 500
#: Cells that a task holds before it takes the rows they complete.
HELD_CELLS = 500_000


def as_arrays(numbers: DataFrame, columns: list[str], *extra) -> DataFrame:
    """The columns as one array ``x`` of doubles."""
    return numbers.select(*extra, F.array(*[F.col(quoted(c)).cast("double") for c in columns]).alias("x"))


def matrix_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """Rows of ``x``; a null is NaN."""
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def summed(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], names: list[str], size: int,
           width: int) -> dict[str, np.ndarray]:
    """Matrices ``size`` x ``width`` added up over all tasks; each task sends them once, as rows."""
    parts = df.mapInArrow(run, "row int, " + ", ".join(f"{n} array<double>" for n in names))
    cells = parts.select("row", F.posexplode(F.arrays_zip(*names)).alias("at", "v")).groupBy("row", "at").agg(
        *[F.sum(F.col("v")[n]).alias(n) for n in names])
    out = {n: np.zeros((size, width)) for n in names}
    for r in cells.collect():  # size * width records, whatever the rows
        for n in names:
            out[n][r.row, r.at] = r[n]
    return out


def matrix_rows(matrices: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A task's sums as ``summed`` takes them: one record a row of the matrices."""
    size = len(next(iter(matrices.values())))
    return pa.record_batch(
        [pa.array(range(size), pa.int32()), *[pa.array(list(m), pa.list_(pa.float64())) for m in matrices.values()]],
        names=["row", *matrices])


def pearson_matrix(numbers: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of complete pairs, coefficients (NaN where there is none), and which coefficients are unsure."""
    width = len(columns)
    pilot = numbers.limit(PILOT_ROWS).agg(*[f(F.col(quoted(c)).cast("double")).alias(f"{n}{k}") for k, c in enumerate(columns)
                                            for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    shift = np.array([pilot[f"m{k}"] or 0.0 for k in range(width)])
    scale = np.array([pilot[f"s{k}"] or 1.0 for k in range(width)])

    def run(batches):
        n, s, q, c = (np.zeros((width, width)) for _ in range(4))
        for batch in batches:
            if batch.num_rows:
                x = (matrix_of(batch, width) - shift) / scale
                m = ~np.isnan(x)
                x[~m] = 0.0
                m = m.astype(float)
                n += m.T @ m
                s += x.T @ m
                q += (x * x).T @ m
                c += x.T @ x
        yield matrix_rows({"n": n, "s": s, "q": q, "c": c})

    t = summed(as_arrays(numbers, columns), run, ["n", "s", "q", "c"], width, width)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = t["s"] / t["n"]
        variance = t["q"] / t["n"] - mean ** 2
        r = (t["c"] / t["n"] - mean * mean.T) / (np.sqrt(variance) * np.sqrt(variance.T))
        unsure = (variance <= UNSURE * t["q"] / t["n"]) | (variance.T <= UNSURE * t["q"].T / t["n"])
    return t["n"].astype(np.int64), np.where(t["n"] > 0, np.clip(r, -1.0, 1.0), np.nan), unsure & (t["n"] > 0)


def dense_of(piece: pa.RecordBatch, width: int) -> np.ndarray:
    """Rows of ``x``, or of lists ``cells`` with zero where a key is lacking."""
    if "x" in piece.schema.names:
        return matrix_of(piece, width)
    lists = piece.column("cells")
    cells, dense = lists.flatten(), np.zeros((piece.num_rows, width))
    size = np.diff(lists.offsets.to_numpy())
    dense[np.repeat(np.arange(piece.num_rows), size), cells.field("key").to_numpy()] = cells.field("z").to_numpy()
    return dense


def dense_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """Whole rows, at most ``PIECE_ROWS`` at once, of cells ``id, key, z`` that come in order of their row."""
    held, size = [], 0

    def pieces(ids, keys, z):
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        edges = [*starts[::PIECE_ROWS], len(ids)]
        for a, b in zip(edges, edges[1:]):
            at = np.cumsum(np.concatenate([[0], ids[a + 1:b] != ids[a:b - 1]]))
            dense = np.zeros((at[-1] + 1, width))
            dense[at, keys[a:b]] = z[a:b]
            yield dense

    for batch in batches:
        if batch.num_rows:
            held.append([batch.column(n).to_numpy() for n in ("id", "key", "z")])
            size += batch.num_rows
        if size >= HELD_CELLS:
            cells = [np.concatenate(c) for c in zip(*held)]
            last = np.searchsorted(cells[0], cells[0][-1])  # the last row may go on in the next batch
            if last:
                yield from pieces(*[c[:last] for c in cells])
            held = [[c[last:].copy() for c in cells]]
            size = len(held[0][0])
    if size:
        yield from pieces(*[np.concatenate(c) for c in zip(*held)])


def product_sums(rows: DataFrame, left: list[int], right: list[int], width: int) -> dict[str, np.ndarray]:
    """For each pair (left, right) of keys the sums of products and of squares, over cells ``id, key, z`` (a row's together and
    in order of ``id``), rows of (key, z) lists ``cells``, or arrays ``x`` of all keys.

    A key that a row lacks counts as zero there. Rows are taken in pieces, so memory does not follow the size of a batch; a
    batch of single cells is small however many keys there are.
    """
    a, b, single = np.array(left, np.int64), np.array(right, np.int64), "id" in rows.columns

    def run(batches):
        sums = {n: np.zeros((1, len(a))) for n in ("ab", "aa", "bb")}
        for dense in dense_rows(batches, width) if single else (
                dense_of(batch.slice(start, PIECE_ROWS), width) for batch in batches for start in range(0, batch.num_rows, PIECE_ROWS)):
            for at in range(0, len(a), PAIRS_AT_ONCE):
                part = slice(at, at + PAIRS_AT_ONCE)
                x, y = dense[:, a[part]], dense[:, b[part]]
                sums["ab"][0, part] += np.einsum("ij,ij->j", x, y)
                sums["aa"][0, part] += np.einsum("ij,ij->j", x, x)
                sums["bb"][0, part] += np.einsum("ij,ij->j", y, y)
        yield matrix_rows(sums)

    return {n: m[0] for n, m in summed(rows, run, ["ab", "aa", "bb"], 1, len(a)).items()}
