"""Documents linked by the Jaccard similarity of their word shingles, exactly.

Shingles are 58-bit hashes behind five bits for how common their hash bucket is, so that their order puts rare ones
first (the counts of the buckets have a fixed size and cover all documents). Equal sets are one class. Two sets can only
be linked if they share one of their first n - ceil(0.9 n) + 1 shingles, so those are listed. A list is kept in blocks
ordered by set size, with the position of the shingle in each set: blocks and entries whose sizes or positions leave too
little room for an overlap are skipped.

Sets that share a list are mostly copies of each other, so answers are derived from answers: first the sets of a list
are compared with one leader of their size range only, the one with the fewest rare shingles. Sets that are linked with it are in its component, and no
pair inside a component needs a look. The pairs of a list that still lie in different components are compared then,
unless their distances to a set both were compared with already rule a link out (Jaccard distance is a metric). Every
pair is first bounded by its listed shingles and by how many shingles of each set fall into each of a few cells (two
sets cannot share more of a cell than the smaller count), and what is left is counted on the whole sets.

Defined results: null, empty and blank texts have no shingles and link with nothing; fewer words than a shingle are one
shingle; ids may be null (their own component, null) or repeated (one node with all its texts); an empty table gives
none; other columns are not read. Nothing is cut off: long lists and large groups are only split into blocks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tallymark.llm.common import saved
from tallymark.llm.components import components

SHINGLE = 3
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 90
BUCKETS = 1 << 22
BLOCK = 512
#: The most bits (a power of two) of the marks that are shared with tasks.
MARKS = 1 << 28
#: A cell with this many keys or more; the largest byte.
FULL = 255


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts end to end, repeats included, and how many each text has.

    All bytes are handled side by side: a word's hash is the mixed sum of byte value times place in the word.
    """
    parts = [(t or "").encode() for t in texts]
    raw = np.frombuffer(b" ".join([*parts, b""]).lower(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(parts), np.int64)
    solid = ~_SPACE[raw]
    edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = stop - start
    begins = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(begins, size)
    weight = _mixed(np.arange(1, (int(size.max()) if len(size) else 0) + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
    word = np.add.reduceat(_BYTES[raw[solid]] * weight[place], begins) if len(size) else np.zeros(0, np.uint64)
    word = _mixed(word + size.astype(np.uint64) * _STEP)

    until = np.searchsorted(start, np.cumsum([len(p) + 1 for p in parts]))
    n = np.diff(np.concatenate([[0], until]))
    first = until - n
    counts = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    at = np.arange(int(counts.sum())) + np.repeat(first - (np.cumsum(counts) - counts), counts)
    length = np.repeat(np.minimum(n, SHINGLE), counts)
    out = length.astype(np.uint64)
    for k in range(SHINGLE):
        one = _mixed(out * _STEP + word[np.minimum(at + k, len(word) - 1)]) if len(word) else out
        out = np.where(k < length, one, out)
    return out, counts


def keys(texts: list[str | None], common: np.ndarray) -> list[np.ndarray]:
    """The distinct shingles of each text, rare ones first: ``common`` has the class of every bucket."""
    h, counts = hashes(texts)
    bucket = (h & np.uint64(BUCKETS - 1)).astype(np.int64)
    key = (common[bucket].astype(np.int64) << 58) | (h >> np.uint64(6)).astype(np.int64)
    ends = np.cumsum(counts)
    return [np.unique(key[e - c: e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]


def _slices(frames: Iterator[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for at in range(0, len(frame), rows):
            yield frame.iloc[at: at + rows]


def bucket_classes(texts: DataFrame) -> np.ndarray:
    """log2 of the number of shingles in each bucket, over all rows of the column ``text``."""
    chunk = 1 << 16

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for frame in _slices(batches):
            np.add.at(total, (hashes(frame["text"].tolist())[0] & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
        if total.any():
            yield pd.DataFrame({"chunk": range(0, BUCKETS, chunk),
                                "n": [zlib.compress(total[k: k + chunk].astype(np.uint32).tobytes(), 1) for k in range(0, BUCKETS, chunk)]})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for frame in batches:
            for k, n in zip(frame["chunk"].tolist(), frame["n"], strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(n), np.uint32).astype(np.int64)
        yield pd.DataFrame({"chunk": list(sums), "n": [_classes(x).tobytes() for x in sums.values()]})

    def _classes(n):
        return np.minimum(np.floor(np.log2(np.maximum(n, 1))), 31).astype(np.uint8)

    schema = "chunk int, n binary"
    out = np.zeros(BUCKETS, np.uint8)
    for k, n in texts.mapInPandas(count, schema).repartition(16, "chunk").mapInPandas(add, schema).collect():
        out[k: k + chunk] = np.frombuffer(n, np.uint8)  # one byte a bucket, whatever the data
    return out


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1 if n else 0


def needed(n1, n2):
    """The least overlap of two linked sets: 100 x >= PERCENT (n1 + n2 - x)."""
    return -(-PERCENT * (n1 + n2) // (100 + PERCENT))


def _bit(ids: np.ndarray, bits: int) -> np.ndarray:
    return (_mixed(ids.astype(np.uint64) * _STEP) & np.uint64(bits - 1)).astype(np.int64)


def marks(ids: DataFrame) -> np.ndarray:
    """One bit for each id of the column ``id``, at its hash: 16 to 32 bits an id, at most ``MARKS``, eight to a byte.

    Beyond ``MARKS`` / 16 ids more other ids fall on a set bit; none of the given ones is ever missed.
    """
    chunk = 1 << 16
    bits = min(MARKS, max(chunk, 1 << (16 * ids.count()).bit_length()))

    def place(batches):
        for frame in batches:
            yield pd.DataFrame({"bit": _bit(frame["id"].to_numpy(np.int64), bits)})

    def gather(batches):
        found: dict[int, np.ndarray] = {}
        for frame in batches:
            at = frame["bit"].to_numpy(np.int64)
            for k in np.unique(at // chunk).tolist():
                found.setdefault(k, np.zeros(chunk, bool))[at[at // chunk == k] % chunk] = True
        if found:
            yield pd.DataFrame({"chunk": list(found), "bits": [np.packbits(x).tobytes() for x in found.values()]})

    out = np.zeros(bits // 8, np.uint8)
    placed = ids.mapInPandas(place, "bit long").distinct().repartition(16, F.expr(f"bit div {chunk}"))
    for k, found in placed.mapInPandas(gather, "chunk long, bits binary").collect():
        out[k * chunk // 8: (k + 1) * chunk // 8] = np.frombuffer(found, np.uint8)  # MARKS / 8 bytes at most
    return out


def cell_counts(found: np.ndarray) -> bytes:
    """How many of a set's keys fall into each cell, one byte each; there are a power of two of cells, four keys a cell or fewer."""
    cells = 1 << (len(found) // 4).bit_length()
    return np.minimum(np.bincount(found & (cells - 1), minlength=cells), FULL).astype(np.uint8).tobytes()


def most_shared(one: bytes, two: bytes) -> int:
    """The most keys that two sets with these cell counts can share; a full byte stands for any number."""
    x, y = (np.frombuffer(c, np.uint8).astype(np.int64) for c in (one, two))
    cells = min(len(x), len(y))
    x, y = (np.where(v == FULL, 1 << 40, v).reshape(-1, cells).sum(0) for v in (x, y))
    return int(np.minimum(x, y).sum())


def sets(docs: DataFrame, common, whole: bool, marked=None) -> DataFrame:
    """id, n, digest, cell counts and the listed keys (``whole``: all keys) of every row of (id, text).

    With ``marked`` (see ``marks``) only rows whose id falls on a set bit: texts are left where they lie, and few sets
    that nobody asked for are made.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def asked(batches):
        for frame in batches:
            at = _bit(frame["id"].to_numpy(np.int64), 8 * len(marked.value))
            yield frame[(marked.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)]

    def run(batches):
        for frame in _slices(batches if marked is None else asked(batches)):
            rows = []
            for found in keys(frame["text"].tolist(), common.value):
                digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                rows.append((len(found), digest, cell_counts(found), found if whole else found[: prefix_length(len(found))]))
            yield pd.DataFrame({"id": frame["id"], "n": [r[0] for r in rows], "digest": [r[1] for r in rows],
                                "cells": [r[2] for r in rows], "keys": [r[3].tobytes() for r in rows]})

    return docs.mapInPandas(run, f"id {kind}, n long, digest binary, cells binary, keys binary")


def _in_order(frames: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The sorted rows of each key in turn, in pieces of at most ``BLOCK``; a key's pieces follow each other."""
    key, held = None, [np.zeros(0, np.int64)] * len(columns)
    for frame in frames:
        keys = frame["key"].to_numpy(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        values = [frame[c].to_numpy(np.int64) for c in columns]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi == lo:
                continue
            if key is not None and keys[lo] != key:
                if len(held[0]):
                    yield key, held
                held = [h[:0] for h in held]
            key = int(keys[lo])
            held = [np.concatenate([h, v[lo:hi]]) for h, v in zip(held, values, strict=True)]
            while len(held[0]) >= BLOCK:
                yield key, [h[:BLOCK] for h in held]
                held = [h[BLOCK:] for h in held]
    if key is not None and len(held[0]):
        yield key, held


def _shared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Without the rows whose key stands alone; the first and last rows of a frame stay, their keys may go on elsewhere."""
    for frame in frames:
        keys = frame["key"].to_numpy(np.int64)
        alike = np.concatenate([[True], keys[1:] == keys[:-1], [True]])
        yield frame[alike[1:] | alike[:-1]]


def _gathered(pieces: Iterator[list], columns: list[str], rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """Frames of about ``rows`` rows from pieces (one array for each column)."""
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += len(piece[-1])
        if size >= rows:
            yield pd.DataFrame({c: np.concatenate([h[k] for h in held]) for k, c in enumerate(columns)})
            held, size = [], 0
    if held:
        yield pd.DataFrame({c: np.concatenate([h[k] for h in held]) for k, c in enumerate(columns)})


def with_leaders(entries: DataFrame) -> DataFrame:
    """The entries (key, id, n, pos) of lists with two or more sets, each with a leader of its size range.

    The leader is the set with the fewest shingles before the list's: it has the fewest rare ones, so it is the one most
    like what the sets of the list have in common.
    """
    def led(frames):
        now, leader, size, ahead = None, None, 0, 0
        for key, (ids, n, pos) in _in_order(_shared(frames), ["id", "n", "pos"]):
            if key != now:
                now, size = key, -1
                if len(ids) == 1:
                    continue  # a piece is short only at the end of its list
            leaders = np.zeros_like(ids)
            at = 0
            while at < len(ids):
                fresh = 100 * size < PERCENT * n[at]
                if fresh:
                    size = n[at]
                end = at + int(np.searchsorted(n[at:], 100 * size // PERCENT, side="right"))
                best = at + int(np.argmin(pos[at:end]))
                if fresh or pos[best] < ahead:
                    leader, ahead = ids[best], pos[best]
                leaders[at:end] = leader
                at = end
            yield [np.full(len(ids), key), ids, n, pos, leaders]

    def run(frames):
        yield from _gathered(led(frames), ["key", "id", "n", "pos", "leader"])

    width = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = entries.repartition(width, "key").sortWithinPartitions("key", "n", "id")
    return ordered.mapInPandas(run, "key long, id long, n long, pos long, leader long")


def listed_pairs(entries: DataFrame, compared: DataFrame) -> DataFrame:
    """Pairs of entries (key, id, n, pos, component) of different components that size and position allow.

    ``compared`` has (id, leader, distance): pairs whose distances to one leader differ by more than a link allows are
    skipped.
    """
    def cut_up(frames):
        number, now = 0, None
        for key, (ids, n, pos, component, leader, distance) in _in_order(
                frames, ["id", "n", "pos", "component", "leader", "distance"]):
            number = number + 1 if key == now else 0
            now = key
            rows = np.empty(1, object)
            rows[0] = np.stack([ids, n, pos, component, leader, distance]).tobytes()
            yield [[key], [number], [n[0]], [n[-1]], rows]

    def blocks(frames):
        yield from _gathered(cut_up(frames), ["key", "block", "low", "high", "rows"], 2000)

    near = compared.groupBy("id", "leader").agg(F.max("distance").alias("distance"))
    entries = entries.join(near, ["id", "leader"], "left").fillna({"distance": -1})
    width = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["key", "id", "n", "pos", "component", "leader", "distance"]
    cut = saved(entries.select(columns).repartition(width, "key").sortWithinPartitions("key", "n", "id").mapInPandas(
        blocks, "key long, block long, low long, high long, rows binary"))
    other = cut.select("key", *[F.col(c).alias(f"{c}2") for c in ("block", "low", "high", "rows")])
    both = cut.join(other, "key").where((F.col("block") <= F.col("block2")) & (100 * F.col("high") >= PERCENT * F.col("low2")))

    def compared_blocks(frames):
        for frame in frames:
            for one, two, same in zip(frame["rows"], frame["rows2"], frame["block"] == frame["block2"], strict=True):
                a, b = (np.frombuffer(x, np.int64).reshape(6, -1)[:, :, None] for x in (one, two))
                b = b.transpose(0, 2, 1)
                least = needed(a[1], b[1])
                ok = (a[3] != b[3]) & (np.minimum(a[1] - a[2], b[1] - b[2]) >= least) & (np.minimum(a[1], b[1]) >= least)
                known = (a[4] == b[4]) & (a[5] >= 0) & (b[5] >= 0)
                ok &= ~(known & (np.abs(a[5] - b[5]) > DISTANT))
                if same:
                    ok = np.triu(ok, 1)
                i, k = np.nonzero(ok)
                x, y = a[0][i, 0], b[0][0, k]
                if len(x):
                    yield [np.minimum(x, y), np.maximum(x, y)]

    def pairs(frames):
        yield from _gathered(compared_blocks(frames), ["a", "b"])

    return both.select("block", "block2", "rows", "rows2").mapInPandas(pairs, "a long, b long").distinct()


#: Distances are kept as whole numbers of this fraction; two sets further apart than this are no link, rounding included.
SCALE = 1 << 40
DISTANT = int((1 - PERCENT / 100) * SCALE) + 4


def verify(pairs: DataFrame, listed: DataFrame, docs: DataFrame, common) -> DataFrame:
    """(a, b, linked, distance) of the pairs that their listed keys and cell counts do not rule out already."""
    def bounded(frames):
        for frame in frames:
            keep = []
            for n1, k1, c1, n2, k2, c2 in zip(*[frame[c] for c in ("n1", "k1", "c1", "n2", "k2", "c2")], strict=True):
                x, y = np.frombuffer(k1, np.int64), np.frombuffer(k2, np.int64)
                end = min(x[-1], y[-1])
                in_x, in_y = (int(np.searchsorted(v, end, side="right")) for v in (x, y))
                shared = len(np.intersect1d(x[:in_x], y[:in_y], assume_unique=True))
                least = needed(n1, n2)
                keep.append(shared + min(n1 - in_x, n2 - in_y) >= least and most_shared(c1, c2) >= least)
            yield frame.loc[np.array(keep, bool), ["a", "b"]]

    def sided(source: DataFrame, side: str, number: int) -> DataFrame:
        cells = [F.col("cells").alias(f"c{number}")] if "cells" in source.columns else []
        return source.select(F.col("id").alias(side), F.col("n").alias(f"n{number}"), F.col("keys").alias(f"k{number}"), *cells)

    left = saved(pairs.join(sided(listed, "a", 1), "a").join(sided(listed, "b", 2), "b").mapInPandas(
        bounded, "a long, b long"))
    wanted = left.select(F.col("a").alias("id")).unionAll(left.select(F.col("b").alias("id"))).distinct()
    wanted = saved(listed.select("id", "least", "digest").join(wanted, "id", "left_semi"))
    marked = docs.sparkSession.sparkContext.broadcast(marks(wanted.select(F.col("least").alias("id"))))
    asked = sets(docs.where("id is not null"), common, whole=True, marked=marked).drop("cells")
    asked = asked.withColumnRenamed("id", "least")
    whole = saved(asked.join(wanted, ["least", "digest"]).select("id", "n", "keys").dropDuplicates(["id"]))

    def counted(frames):
        for frame in frames:
            linked, distance = [], []
            for n1, k1, n2, k2 in zip(frame["n1"], frame["k1"], frame["n2"], frame["k2"], strict=True):
                x, y = np.frombuffer(k1, np.int64), np.frombuffer(k2, np.int64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * shared >= PERCENT * (n1 + n2 - shared))
                distance.append(SCALE - SCALE * shared // (n1 + n2 - shared))
            yield pd.DataFrame({"a": frame["a"], "b": frame["b"], "linked": linked, "distance": distance})

    return saved(left.join(sided(whole, "a", 1), "a").join(sided(whole, "b", 2), "b").mapInPandas(
        counted, "a long, b long, linked boolean, distance long"))


def numbered(listed: DataFrame) -> DataFrame:
    """``listed`` with ``id``, which is different for each set: its ``least`` id, or a number beyond all ids."""
    named = listed.groupBy("least").agg(F.min(F.struct("n", "digest")).alias("one"), F.count("*").alias("sets"))
    top = listed.agg(F.max("least")).first()[0] or 0
    others = listed.select("least", "n", "digest").join(named.where("sets > 1").select("least", "one"), "least").where(
        F.col("one") != F.struct("n", "digest"))
    others = saved(others.select("least", "digest", (F.lit(top) + 1 + F.monotonically_increasing_id()).alias("other")))
    return listed.join(others, ["least", "digest"], "left").withColumn("id", F.coalesce("other", "least")).drop("other")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` of every row."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(bucket_classes(rows.select("text")))
    made = saved(sets(rows, common, whole=False))
    some = made.where("n > 0 and id is not null")
    # One row for each different set. Rows of one set have the same keys, so any row's do, and they are reduced to one
    # before they move. A set is named by its least id or, where an id with several texts is the least of several sets,
    # all but one of these by numbers beyond all ids.
    listed = numbered(saved(some.groupBy("n", "digest").agg(
        F.min("id").alias("least"), F.first("cells").alias("cells"), F.first("keys").alias("keys"))))
    first = listed.select("n", "digest", F.col("id").alias("rep"))
    copies = some.select("n", "digest", "id").join(first, ["n", "digest"]).select(
        F.col("rep").alias("a"), F.col("id").alias("b")).where("a <> b")

    def exploded(frames):
        for frame in frames:
            lists = [np.frombuffer(k, np.int64) for k in frame["keys"]]
            sizes = [len(k) for k in lists]
            yield pd.DataFrame({
                "key": np.concatenate(lists) if lists else np.zeros(0, np.int64), "id": np.repeat(frame["id"].to_numpy(), sizes),
                "n": np.repeat(frame["n"].to_numpy(), sizes),
                "pos": np.concatenate([np.arange(s) for s in sizes]) if lists else np.zeros(0, np.int64)})

    entries = listed.select("id", "n", "keys").mapInPandas(exploded, "key long, id long, n long, pos long")
    lists = saved(with_leaders(entries))
    led = lists.select(F.col("leader").alias("a"), F.col("id").alias("b")).where("a <> b").distinct()
    answers = verify(led, listed, rows, common)
    links = answers.where("linked").select("a", "b")
    reached = components(links)
    apart = lists.join(reached.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", F.col("id")))
    mixed = apart.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    apart = apart.join(mixed.select("key"), "key", "left_semi")
    rest = listed_pairs(apart, answers.select(F.col("b").alias("id"), F.col("a").alias("leader"), "distance"))
    more = verify(rest, listed, rows, common).where("linked").select("a", "b")
    found = components(links.unionAll(more).unionAll(copies))
    return made.join(found.withColumnRenamed("node", "id"), "id", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", F.col("id")).alias("component_id"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, that with the least id, with the columns it came with.

    Rows with one id are one node: of those with a text that links, equal rows are reduced to one. Null ids all stay.
    """
    found = classes(docs, key, text)
    gone = found.where(F.col("component_id") < F.col(key)).select(F.col(key).alias("_gone")).distinct()
    left = docs.join(gone, docs[key] == gone["_gone"], "left_anti")
    again = left.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).where(F.col(key).isNotNull())
    twice = again.select(F.col(key).alias("_twice"))
    single = left.join(twice, left[key] == twice["_twice"], "left_anti")
    return single.unionByName(left.join(twice, left[key] == twice["_twice"], "left_semi").dropDuplicates([key, text]))
