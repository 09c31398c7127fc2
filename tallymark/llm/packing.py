"""Packing token pieces into sequences by length patterns and non-negative least squares.

Only the histogram of piece lengths steers the packing, and it has as many bins as a sequence has places, whatever the
data. All patterns of up to three lengths that fill a sequence exactly are enumerated; how often each is used is fitted
to the histogram by non-negative least squares; the fit is rounded within what the histogram has, and what that leaves
is fitted again while it shrinks; the rest is packed best fit, longest first, by counts of gaps. Of the roundings the one
with the fewest sequences is taken. Pieces then find their places by (length, rank): ranks within a
length come from counts per written part, so no task sees all pieces of a length. Pieces that fill a sequence alone
need no rank.

Defined results: a null or empty text is the end token alone; texts longer than a sequence are cut from their end, so
that only the first piece may be shorter; repeated rows are packed as often as they come, null keys stay null; an empty
table gives none. Sequence numbers are unique, not consecutive.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tallymark.llm.common import saved
from tallymark.llm.tokenizer import parse, read

STEPS = 300
#: What rounding leaves is fitted again until a round leaves more than this share of the pieces.
FITTED_AGAIN = 0.9
PIECE = StructType([
    StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()),
    StructField("ids_crc32", LongType()), StructField("_part", LongType()), StructField("_at", LongType())])


def patterns(present: np.ndarray, size: int) -> np.ndarray:
    """Rows of three lengths, longest first and padded with 0, that sum to ``size`` and all occur."""
    a = np.arange(size + 1)
    long, mid = np.meshgrid(a, a, indexing="ij")
    short = size - long - mid
    fits = (long >= mid) & (mid >= short) & (short >= 0) & (long > 0)
    rows = np.stack([long[fits], mid[fits], short[fits]], 1)
    there = np.concatenate([[True], present[1:] > 0])
    return rows[there[rows].all(1)]


def fit(rows: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that bring the lengths used by the patterns closest to the histogram (accelerated descent)."""
    size = len(histogram)
    used = rows > 0

    def lengths(x):
        out = np.zeros(size)
        for k in range(3):
            out += np.bincount(rows[:, k], np.where(used[:, k], x, 0.0), size)
        return out

    def back(r):
        return sum(np.where(used[:, k], r[rows[:, k]], 0.0) for k in range(3))

    target = histogram.astype(float)
    x = look = np.zeros(len(rows))
    step = 1.0 / max(1.0, 3.0 * np.bincount(rows.ravel(), minlength=size)[1:].max())  # row sums times column sums
    momentum = 1.0
    for _ in range(steps):
        new = np.maximum(look - step * back(lengths(look) - target), 0.0)
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        look = new + (momentum - 1) / following * (new - x)
        x, momentum = new, following
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """How often each pattern is used: ``histogram[n]`` pieces of every length n are placed exactly."""
    left = histogram.astype(np.int64).copy()
    size = len(left) - 1
    out: list[tuple[tuple[int, ...], int]] = []
    best = None
    while True:
        before, rows = int(left.sum()), patterns(left, size)
        if len(rows):
            x = fit(rows, left)
            times = np.floor(x + 1e-6).astype(np.int64)
            for share in (times, np.ceil(x - 0.5).astype(np.int64) - times):  # whole repeats, then the rounded rest
                out += _take(rows, share, x, left)
                whole = out + best_fit(left)
                best = min(best or whole, whole, key=lambda used: sum(n for _, n in used))
        if left.sum() > before * FITTED_AGAIN or not len(rows):
            return best or best_fit(left)


def _take(rows: np.ndarray, share: np.ndarray, x: np.ndarray, left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Use the patterns as often as asked and as the histogram still allows, the most used first."""
    out = []
    for k in np.argsort(-x, kind="stable"):
        if share[k] > 0:
            row = [n for n in rows[k].tolist() if n]
            n = int(min(share[k], *[left[v] // row.count(v) for v in row]))
            if n > 0:
                out.append((tuple(row), n))
                for v in row:
                    left[v] -= n
    return out


def best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Pack what is left, longest first, each into the smallest gap that takes it; equal gaps are handled together."""
    size = len(left) - 1
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {size: []}
    for length in range(size, 0, -1):
        count = int(left[length])
        while count:
            gap = min((g for g, held in open_.items() if g >= length and held), default=None)
            held, there = open_[gap].pop() if gap is not None else ((), count)
            now = min(count, there)
            if there > now:
                open_[gap].append((held, there - now))
            rest = (gap if gap is not None else size) - length
            open_.setdefault(rest, []).append(((*held, length), now))
            count -= now
    return [x for held in open_.values() for x in held]


def places(used: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """For every length the stretches of ranks that share a place: (key of the first, first sequence, offset)."""
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for row, count in used:
        offset = 0
        for length in row:
            first = ranks.get(length, 0)
            out.append(((length << 40) + first, sequence, offset))
            ranks[length] = first + count
            offset += length
        sequence += count
    return np.array(sorted(out), np.int64).reshape(-1, 3)


def cut(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: all but the first are whole."""
    first = total if total <= size else total % size or size
    return [(0, first), *((at, size) for at in range(first, total, size))]


def pieces(docs: DataFrame, tokenizer: str, key: str, text: str, size: int, end_id: int, with_ids: bool) -> DataFrame:
    content = docs.sparkSession.sparkContext.broadcast(read(tokenizer))
    fields = [StructField(key, docs.schema[key].dataType), *PIECE.fields]
    if with_ids:
        fields.append(StructField("ids", ArrayType(IntegerType())))
    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_text"),
                       F.spark_partition_id().cast("long").alias("_part"))

    def run(batches):
        bpe, at = parse(content.value), 0
        for big in batches:
            for batch in (big.slice(k, 1000) for k in range(0, big.num_rows, 1000)):
                out, tokens = [], []
                keys = batch.column(0)
                for row, (value, part) in enumerate(
                        zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    ids = np.array([*bpe.encode(value or ""), end_id], "<u4")
                    for n, (start, length) in enumerate(cut(len(ids), size)):
                        piece = ids[start: start + length]
                        out.append((row, n, start, length, zlib.crc32(piece.tobytes()), part, at))
                        at += 1
                        if with_ids:
                            tokens.append(piece.astype(np.int32))
                columns = list(zip(*out, strict=True)) or [()] * 7
                arrays = [keys.take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()),
                          *[pa.array(c, pa.int64()) for c in columns[2:]]]
                if with_ids:
                    arrays.append(pa.array(tokens, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    return rows.mapInArrow(run, StructType(fields))


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = 1024, end_id: int = 2,
         with_ids: bool = False) -> DataFrame:
    """One row per piece with its sequence and its place there; ``with_ids`` adds the token ids themselves."""
    made = saved(pieces(docs, tokenizer, key, text, size, end_id, with_ids))
    short = made.where(F.col("length") < size)
    by_length = Window.partitionBy("length")
    counts = short.groupBy("_part", "length").agg(F.count("*").alias("n")).select(
        "_part", "length", "n",
        F.coalesce(F.sum("n").over(by_length.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before"))
    histogram = np.zeros(size + 1, np.int64)
    for length, n in short.groupBy("length").agg(F.count("*")).collect():  # at most ``size`` rows
        histogram[length] = n
    table = places(plan(histogram))
    where = docs.sparkSession.sparkContext.broadcast(table)
    ranked = short.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_part", "length").orderBy("_at")) - 1).join(
        counts.drop("n"), ["_part", "length"])

    def place(batches):
        for frame in batches:
            keys = (frame["length"].to_numpy(np.int64) << 40) + frame.pop("_rank").to_numpy(np.int64) \
                + frame.pop("_before").to_numpy(np.int64)
            at = np.searchsorted(where.value[:, 0], keys, side="right") - 1
            frame["sequence_id"] = 2 * (where.value[at, 1] + keys - where.value[at, 0])
            frame["offset"] = where.value[at, 2]
            yield frame[names]

    names = [*[f.name for f in made.schema], "sequence_id", "offset"]
    schema = StructType([*made.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    packed = ranked.mapInPandas(place, schema)
    whole = made.where(F.col("length") == size).select(
        "*", (2 * (F.shiftleft("_part", 36) + F.col("_at")) + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(packed).drop("_part", "_at")
