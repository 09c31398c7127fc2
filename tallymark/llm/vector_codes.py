"""Vectors as short codes: each part of a vector is named by the nearest entry of the part position's codebook.

Components become integers, so every distance is exact. A stretch of vectors is kept as a per-dimension dictionary of its
distinct integers and the place of each vector's integer in it. A round tabulates, for each dimension, the squared
differences of every distinct integer to that dimension's component of all entries; the distances of all parts to all
entries are then gathers from these tables by the dictionary places, added over the dimensions of the part. The
dictionaries belong to a stretch (one Arrow batch), so memory is bounded whatever the range of the integers. Entries move
to the floor of their parts' mean, from counts of (entry, dictionary place) that each task adds up before anything moves.

Only codebooks (parts x entries x components of a part) reach the driver; stretches are written once and read by every
round.

Defined results: vectors that are null, empty, or hold null or non-finite components are dropped, and so are those with a
component of 2^19 or more in size, whose errors would not fit a long. Vectors of different lengths have codebooks of their
own. Components that do not divide into equal parts leave the first parts one longer; parts beyond the vector's length
are empty and have code 00. Of rows with one id any may start an entry, the least vector first; null ids start last.
Fewer vectors than entries make smaller codebooks. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallymark.llm.common import finite_vectors, saved, spread_join

SCALE = 256.0
PARTS = 16
ENTRIES = 64
ROUNDS = 2
LIMIT = 2.0 ** 19

Books = list[np.ndarray]  # for each part: entries x components, int64


def cut(size: int, parts: int) -> list[range]:
    """The components of each part."""
    ends = [0, *np.cumsum([size // parts + (k < size % parts) for k in range(parts)]).tolist()]
    return [range(a, b) for a, b in zip(ends, ends[1:])]


def stretches(rows: DataFrame, size: int) -> DataFrame:
    """key, label: lists; values: the dictionaries one after the other, sizes: their lengths; places: size x n integers."""
    schema = rows.schema
    kinds = pa.schema([
        ("key", pa.list_(to_arrow_type(schema["key"].dataType))), ("label", pa.list_(to_arrow_type(schema["more0"].dataType))),
        ("values", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("places", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                x = batch.column("x").flatten().to_numpy().reshape(n, size)
                values, places = zip(*[np.unique(x[:, k], return_inverse=True) for k in range(size)])
                ends = pa.array([0, n], pa.int32())
                yield pa.record_batch([
                    pa.ListArray.from_arrays(ends, batch.column("key")), pa.ListArray.from_arrays(ends, batch.column("more0")),
                    pa.array([np.concatenate(values)], pa.list_(pa.int64())),
                    pa.array([[len(v) for v in values]], pa.list_(pa.int32())),
                    pa.array([np.stack(places).astype(np.uint32).tobytes()], pa.binary())], schema=kinds)

    key, label = schema["key"].dataType.simpleString(), schema["more0"].dataType.simpleString()
    return rows.mapInArrow(run, f"key array<{key}>, label array<{label}>, values array<bigint>, sizes array<int>, places binary")


def opened(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """row of the batch, dictionaries and places of each stretch."""
    for k in range(batch.num_rows):
        sizes = batch.column("sizes")[k].values.to_numpy()
        values = np.split(batch.column("values")[k].values.to_numpy(), np.cumsum(sizes)[:-1])
        yield k, values, np.frombuffer(batch.column("places")[k].as_buffer(), np.uint32).reshape(len(sizes), -1)


def nearest(values: list[np.ndarray], places: np.ndarray, books: Books, parts: list[range]) -> tuple[np.ndarray, np.ndarray]:
    """For each part and vector the nearest entry (the first of equals) and its squared distance."""
    n = places.shape[1]
    code, error = np.zeros((len(parts), n), np.int64), np.zeros((len(parts), n), np.int64)
    for p, dims in enumerate(parts):
        far = np.zeros((n, len(books[p])), np.int64)
        for at, d in enumerate(dims):
            table = np.square(values[d][:, None] - books[p][None, :, at])
            far += table[places[d]]
        code[p] = far.argmin(axis=1)
        error[p] = far[np.arange(n), code[p]]
    return code, error


def moved(chunks: DataFrame, books: Books, parts: list[range]) -> Books:
    """Each entry at the floor of the mean of its parts; an entry without parts stays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            for _, values, places in opened(batch):
                code, _ = nearest(values, places, books, parts)
                for p, dims in enumerate(parts):
                    entries = len(books[p])
                    counts[p] += np.bincount(code[p], minlength=entries)
                    for at, d in enumerate(dims):
                        met = np.bincount(code[p] * len(values[d]) + places[d], minlength=entries * len(values[d]))
                        sums[p][:, at] += met.reshape(entries, -1) @ values[d]
        found = [(p, e, int(counts[p][e]), sums[p][e].tolist()) for p in range(len(parts)) for e in np.flatnonzero(counts[p]).tolist()]
        columns = list(zip(*found)) or [[], [], [], []]
        yield pa.record_batch([
            pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()),
            pa.array(columns[3], pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    partial = chunks.select("values", "sizes", "places").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    whole = partial.select("part", "entry", "n", F.posexplode_outer("sums").alias("at", "total")).groupBy("part", "entry", "at").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    new = [b.copy() for b in books]
    for r in whole.where("at is not null").collect():  # one row for each component of an entry
        new[r.part][r.entry, r.at] = int(r.total) // r.n
    return new


def coded(chunks: DataFrame, books: Books, parts: list[range]) -> DataFrame:
    """key, label, code and error of every vector."""
    kinds = {f.name: f.dataType.elementType for f in chunks.schema.fields[:2]}
    text = ", ".join(f"{name} {kind.simpleString()}" for name, kind in kinds.items())
    arrow = [to_arrow_type(kind) for kind in kinds.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, values, places in opened(batch):
                code, error = nearest(values, places, books, parts)
                hexes = code.astype(np.uint8).T.copy()
                yield pa.record_batch([
                    batch.column("key")[k].values.cast(arrow[0]), batch.column("label")[k].values.cast(arrow[1]),
                    pa.array([row.tobytes().hex() for row in hexes]), pa.array(error.sum(axis=0))],
                    names=["key", "label", "code", "error"])

    return chunks.mapInArrow(run, f"{text}, code string, error bigint")


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``key``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of every kept vector; at most 256 entries."""
    whole = F.transform("v", lambda x: F.floor(F.lit(SCALE) * x))
    rows = saved(finite_vectors(vectors, key, vector, LIMIT, label).withColumn("x", whole).drop("v"))
    out = None
    for size in sorted(r[0] for r in rows.groupBy(F.size("x")).agg(F.count("*")).collect()):  # a table has few lengths
        of_size = rows.where(F.size("x") == size)
        start = np.array([r.x for r in of_size.orderBy(F.asc_nulls_last("key"), "x").select("x").limit(entries).collect()], np.int64)
        ranges = cut(size, parts)
        books = [np.ascontiguousarray(start[:, r.start:r.stop]) for r in ranges]
        chunks = saved(stretches(of_size, size))
        for _ in range(rounds):
            books = moved(chunks, books, ranges)
        digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
        one = coded(chunks, books, ranges).withColumn("codebooks_sha256", F.lit(digest))
        out = one if out is None else out.unionAll(one)
    if out is None:
        out = rows.select("key", F.col("more0").alias("label"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                          F.lit("").alias("codebooks_sha256"))
    out = saved(out)
    by_label = saved(out.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("size")))
    return spread_join(out, by_label, "label", "size").select(
        F.col("key").alias(key), "code", "error", "label_error", "codebooks_sha256")
