"""Near-duplicate vectors by cosine, as an epsilon grid order join.

Unit vectors with a cosine of at least c lie within e = sqrt(2 - 2 c) of each other. The leading principal directions
come from one sum of outer products over all vectors; projections on them are never longer than distances. Vectors are
sorted by the cells of side e that their leading projections fall in, and the sequence is cut into blocks with a box of
projections and a ball each. The sequence is joined with itself by intervals: a pair of intervals whose boxes or balls
are provably further apart than e is dropped, one whose ball lies wholly within e needs no look inside, any other is
split into the pairs of its parts, level by level, down to blocks, whose vectors are compared in double precision.

Equal vectors are one point with a weight. Inside a pair of blocks only counts of links, and links enough to span what
hangs together, leave the task; so a group of copies of any size costs no pairs beyond its blocks.

Defined results: vectors that are null, empty, zero or hold null or non-finite parts link with nothing;
vectors of different lengths are compared with those of their own length only; ids may repeat (each row counts as a
vector, rows with one id are one node), a null id links with nothing; ties at the threshold link; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tallymark.llm.common import saved
from tallymark.llm.components import components

COSINE = 0.95
DIRECTIONS = 12
BLOCK = 512
FAN = 4  # parts an interval is split into
#: Vectors of one group of blocks that a task holds, in bytes.
GROUP_BYTES = 32 << 20
#: Allowance for rounding wherever a bound decides without a look.
SLACK = 1e-6


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v (as doubles) of the vectors that can link."""
    v = F.col("v")
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False))).where("id is not null")


def principal(points: DataFrame, size: int) -> np.ndarray:
    """Leading directions from the sum of outer products of all unit vectors; a task sends one matrix."""
    def run(frames):
        total = np.zeros((size, size))
        for frame in frames:
            x = _unit(np.stack(frame["v"].to_list()))
            total += x.T @ x
        yield pd.DataFrame({"row": range(size), "x": list(total)})

    sums = points.select("v").mapInPandas(run, "row int, x array<double>").select(
        "row", F.posexplode("x")).groupBy("row", "pos").agg(F.sum("col").alias("x")).collect()  # size * size numbers
    matrix = np.zeros((size, size))
    for r in sums:
        matrix[r.row, r.pos] = r.x
    return np.linalg.eigh(matrix)[1][:, ::-1][:, : min(DIRECTIONS, size)]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def blocks(points: DataFrame, directions: np.ndarray, reach: float) -> DataFrame:
    """block, ids, weights, matrix, box and ball of stretches of the grid order; block numbers follow the order."""
    axes = points.sparkSession.sparkContext.broadcast(directions)
    kinds = "id long, weight long, v array<double>"

    def placed(frames):
        for frame in frames:
            if len(frame):
                at = np.floor(_unit(np.stack(frame["v"].to_list())) @ axes.value / reach).astype(np.int32)
                yield frame.assign(cell=list(at))

    ordered = points.mapInPandas(placed, f"{kinds}, cell array<int>")
    width = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(width, "cell", "id").sortWithinPartitions("cell", "id")

    def cut(frames):
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            while len(held) >= BLOCK:
                yield block(held.iloc[:BLOCK])
                held = held.iloc[BLOCK:]
        if held is not None and len(held):
            yield block(held)

    def block(part):
        x = _unit(np.stack(part["v"].to_list()))
        seen = x @ axes.value
        centre = x.mean(0)
        return pd.DataFrame({
            "ids": [part["id"].to_numpy(np.int64).tobytes()], "weights": [part["weight"].to_numpy(np.int64).tobytes()],
            "x": [x.tobytes()], "low": [seen.min(0)], "high": [seen.max(0)], "centre": [centre],
            "radius": [float(np.linalg.norm(x - centre, axis=1).max())], "total": [int(part["weight"].sum())]})

    made = ordered.mapInPandas(cut, "ids binary, weights binary, x binary, low array<double>, high array<double>, "
                                    "centre array<double>, radius double, total long")
    made = saved(made.withColumn("place", F.monotonically_increasing_id()))
    # Consecutive numbers: places grow with the partitions, whose block counts are one row each.
    part = F.shiftright("place", 33)
    counts = {r.part: r.n for r in made.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for k in sorted(counts):
        offsets.append((k, before))
        before += counts[k]
    table = points.sparkSession.createDataFrame(offsets or [(0, 0)], "part long, first long")
    return made.withColumn("part", part).join(F.broadcast(table), "part").withColumn(
        "block", F.col("first") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("part", "first", "place")


def _apart(a: str, b: str):
    """Lower bounds of the distance of two intervals, by their boxes and by their balls."""
    gap = F.aggregate(
        F.zip_with(F.zip_with(f"{b}low", f"{a}high", lambda x, y: x - y), F.zip_with(f"{a}low", f"{b}high", lambda x, y: x - y),
                   lambda p, q: F.pow(F.greatest(p, q, F.lit(0.0)), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    centres = F.sqrt(F.aggregate(
        F.zip_with(f"{a}centre", f"{b}centre", lambda x, y: F.pow(x - y, F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))
    balls = F.col(f"{a}radius") + F.col(f"{b}radius")
    return F.sqrt(gap), centres - balls


def candidates(made: DataFrame, reach: float) -> DataFrame:
    """Pairs of blocks (a <= b) that may hold links, from the whole sequence down, level by level."""
    bounds = made.select("block", "low", "high", "centre", "radius")
    levels = [bounds.withColumnRenamed("block", "node")]
    count = made.agg(F.coalesce(F.max("block"), F.lit(-1))).first()[0] + 1
    size = len(made.select("low").first()[0]) if count else 0
    while FAN ** (len(levels) - 1) < count:
        below = levels[-1].withColumn("up", F.floor(F.col("node") / FAN).cast("long"))
        dims = made.select(F.size("centre")).first()[0]
        mean = [F.avg(F.col("centre")[k]).alias(f"c{k}") for k in range(dims)]
        box = [F.min(F.col("low")[k]).alias(f"l{k}") for k in range(size)] + [F.max(F.col("high")[k]).alias(f"h{k}") for k in range(size)]
        centres = below.groupBy("up").agg(*mean, *box).select(
            F.col("up"), F.array(*[f"c{k}" for k in range(dims)]).alias("middle"),
            F.array(*[f"l{k}" for k in range(size)]).alias("blow"), F.array(*[f"h{k}" for k in range(size)]).alias("bhigh"))
        away = F.sqrt(F.aggregate(F.zip_with("centre", "middle", lambda x, y: F.pow(x - y, F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))
        radius = below.join(centres.select("up", "middle"), "up").groupBy("up").agg(F.max(away + F.col("radius")).alias("radius"))
        levels.append(saved(centres.join(radius, "up").select(
            F.col("up").alias("node"), F.col("blow").alias("low"), F.col("bhigh").alias("high"),
            F.col("middle").alias("centre"), "radius")))
    pairs = made.sparkSession.createDataFrame([(0, 0)] if count else [], "a long, b long")
    parts = F.array(*[
        F.struct((F.col("a") * FAN + i).alias("a"), (F.col("b") * FAN + k).alias("b"))
        for i in range(FAN) for k in range(FAN)])
    box, near = _apart("a", "b")
    close = (F.col("a") == F.col("b")) | ((box <= reach + SLACK) & (near <= reach + SLACK))
    for node in reversed(levels[:-1]):
        pairs = pairs.select(F.explode(parts).alias("p")).select("p.*").where("a <= b")
        sides = [node.select(*[F.col(c).alias(s if c == "node" else s + c) for c in node.columns]) for s in ("a", "b")]
        pairs = saved(pairs.join(sides[0], "a").join(sides[1], "b").where(close).select("a", "b"))
    return pairs


def compare(pairs: DataFrame, made: DataFrame, cosine: float, reach: float) -> DataFrame:
    """(id, n, other): how many vectors a point links with in the pair of blocks, and points spanning its links there.

    Blocks are taken in groups of neighbours: a task gets the blocks of two groups once and all their pairs to compare, so
    a block is sent once for each group it meets and not for each block.
    """
    count, dims = made.agg(F.count("*"), F.max(F.size("centre"))).first()
    width = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = GROUP_BYTES // (BLOCK * 8 * max(dims or 1, 1))
    group = int(max(1, min(most, count / (8 * width) ** 0.5)))  # several pairs of groups for each partition
    near = [F.floor(F.col(c) / group).cast("long").alias(f"g{c}") for c in ("a", "b")]
    todo = saved(pairs.select("a", "b", *near).groupBy("ga", "gb").agg(F.collect_list(F.struct("a", "b")).alias("todo")))
    whole = made.select(F.floor(F.col("block") / group).cast("long").alias("g"), "block", "ids", "weights", "x", "centre", "radius")
    sides = todo.select("ga", "gb", F.explode(F.array_distinct(F.array("ga", "gb"))).alias("g"))
    sent = sides.join(whole, "g").drop("g")
    asked = todo.withColumn("block", F.lit(-1).cast("long"))  # comes first of its pair of groups
    rows = sent.unionByName(asked, allowMissingColumns=True).repartition("ga", "gb").sortWithinPartitions("ga", "gb", "block")

    def run(frames):
        asked_now, held = [], {}
        for frame in frames:
            for r in frame.itertuples(index=False):
                if r.block >= 0:
                    held[r.block] = r
                    continue
                yield from compared(asked_now, held)
                asked_now, held = r.todo, {}
        yield from compared(asked_now, held)

    def compared(asked_now, held):
        for p in asked_now:
            out = linked(held[p["a"]], held[p["b"]])
            if out is not None:
                yield out

    def linked(one, two):
        ids_a, ids_b = np.frombuffer(one.ids, np.int64), np.frombuffer(two.ids, np.int64)
        w_a, w_b = np.frombuffer(one.weights, np.int64), np.frombuffer(two.weights, np.int64)
        same = one.block == two.block
        apart = float(np.linalg.norm(np.asarray(one.centre) - np.asarray(two.centre))) + one.radius + two.radius
        if apart < reach - SLACK:  # every vector of one links with every one of the other
            n_a, n_b = np.full(len(ids_a), w_b.sum()), np.full(len(ids_b), w_a.sum())
            other_a, other_b = np.full(len(ids_a), ids_b[0]), np.full(len(ids_b), ids_a[0])
            spans = [(ids_a, other_a), (ids_b, other_b)]
        else:
            x, y = (np.frombuffer(v, float).reshape(len(i), -1) for v, i in ((one.x, ids_a), (two.x, ids_b)))
            ok = x.astype(np.float32) @ y.astype(np.float32).T >= cosine - 1e-4
            if not ok.any():
                return None
            i, k = np.nonzero(ok)
            exact = np.einsum("ij,ij->i", x[i], y[k]) >= cosine
            ok[i[~exact], k[~exact]] = False
            n_a, n_b = ok @ w_b, w_a @ ok
            spans = list(spanning(ok, ids_a, ids_b))
        if same:
            n_a, n_b = n_a - 1, n_b * 0  # not itself
        parts = [pd.DataFrame({"id": ids_a, "n": n_a}), *([] if same else [pd.DataFrame({"id": ids_b, "n": n_b})])]
        counts = pd.concat(parts)
        counts = counts[counts["n"] > 0].assign(other=-1, link=False)
        edges = [pd.DataFrame({"id": p, "n": 0, "other": q, "link": True})[p != q] for p, q in spans]
        return pd.concat([counts, *edges])

    def spanning(ok, ids_a, ids_b):
        """Links that join what the block of links joins: one for a point, and one for each two stars that meet."""
        first_b = np.argmax(ok, axis=1)
        has_a = ok.any(axis=1)
        yield ids_a[has_a], ids_b[first_b[has_a]]
        leader = np.full(len(ids_a), -1)
        leader[has_a] = first_b[has_a]
        for k in np.flatnonzero(ok.any(axis=0)):
            rows = np.flatnonzero(ok[:, k])
            _, at = np.unique(leader[rows], return_index=True)
            yield ids_a[rows[at]], np.full(len(at), ids_b[k])

    return rows.mapInPandas(run, "id long, n long, other long, link boolean")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """``key``, ``n_links``, ``component_id`` and ``kept`` of every row."""
    reach = float(np.sqrt(2 - 2 * cosine))
    rows = saved(usable(vectors, key, vector))
    sizes = [r[0] for r in rows.groupBy(F.size("v")).agg(F.count("*")).collect()]  # a table has few lengths
    counts = links = None
    for size in sizes:
        one = rows.where(F.size("v") == size)
        points = saved(one.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("weight")))
        copies = one.join(points.select("v", F.col("id").alias("point"), "weight"), "v").select("id", "point", "weight")
        made = saved(blocks(points.select("id", "weight", "v"), principal(points, size), reach))
        found = saved(compare(candidates(made, reach), made, cosine, reach))
        near = found.groupBy("id").agg(F.sum("n").alias("near")).withColumnRenamed("id", "point")
        n = copies.join(near, "point", "left").select("id", (F.coalesce("near", F.col("weight") - 1)).alias("n"))
        edges = found.where("link").select(F.col("id").alias("a"), F.col("other").alias("b")).unionAll(
            copies.select(F.col("id").alias("a"), F.col("point").alias("b")).where("a <> b"))
        counts, links = (n, edges) if counts is None else (counts.unionAll(n), links.unionAll(edges))
    ids = vectors.select(F.col(f"`{key}`").cast("long").alias("id"))
    if counts is None:
        out = ids.withColumn("n", F.lit(0).cast("long")).withColumn("component", F.col("id"))
    else:
        by_id = counts.groupBy("id").agg(F.max("n").alias("n"))
        out = ids.join(by_id, "id", "left").join(components(links).withColumnRenamed("node", "id"), "id", "left")
    return out.select(
        F.col("id").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", F.col("id")).alias("component_id")).withColumn("kept", F.col(key) == F.col("component_id"))
