"""Pairwise correlation of numeric columns, and the shapes that plot a pair."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import values as V
from ..session import durable, shuffle_width
from .comoments import as_arrays, matrix_of, pearson_matrix, product_sums
from .profile import Profile
from .ranks import attach_ranks, running_before
from .table import Table, chunks

# --- fixed values -----------------------------------------------------------
MIN_PAIRS = 3
SMALL_SAMPLE = 12
MIN_REPORTED = 0.3
METHOD_GAP = 0.2
MAX_REPORTED = 10
LOW_COVERAGE = 60
SCATTER_POINTS = 500
GRID_CELLS = 20
MATRIX_COLUMNS = 8
# ----------------------------------------------------------------------------
PAIRS_PER_SCAN = 40
# Rows of so few columns meet their ranks column by column; of more, each cell meets its rank by itself.
FEW_COLUMNS = 6
# So few pairs are aggregated by themselves; more are products of matrices.
FEW_PAIRS = 6
# A column with at most so many distinct values has its ranks broadcast.
FEW_VALUES = 10_000


def column_pairs(columns: list[str]) -> list[tuple[str, str]]:
    return list(combinations(columns, 2))


def pearson_of(x: Column, y: Column) -> Column:
    """Centred moments, each root taken before the product; null for a constant side."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(a) * F.stddev_pop(b))
    return V.clamp(r, -1.0, 1.0)


def _q(c: str) -> Column:
    return F.col(V.quoted(c))


def _exact_moments(numbers: DataFrame, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], float | None]:
    """Coefficients by centred aggregates, a few pairs a scan: for pairs whose sums lie close to rounding."""
    found = {}
    for part in chunks(pairs, PAIRS_PER_SCAN):
        row = numbers.agg(*[pearson_of(_q(a), _q(b)).alias(f"r{i}") for i, (a, b) in enumerate(part)]).first()
        found |= {pair: row[f"r{i}"] for i, pair in enumerate(part)}
    return found


def _moments(numbers: DataFrame, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], tuple[int, float | None]]:
    """Complete rows and Pearson coefficient of each pair, all pairs in one scan."""
    if len(pairs) <= FEW_PAIRS:
        both = [F.count(F.when(_q(b).isNotNull(), _q(a))) for a, b in pairs]
        row = numbers.agg(*both, *[pearson_of(_q(a).cast("double"), _q(b).cast("double")) for a, b in pairs]).first()
        return dict(zip(pairs, zip(row[:len(pairs)], row[len(pairs):])))
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    n, r, unsure = pearson_matrix(numbers, columns)
    at = {c: k for k, c in enumerate(columns)}
    exact = _exact_moments(numbers, [p for p in pairs if unsure[at[p[0]], at[p[1]]]])
    out = {}
    for pair in pairs:
        i, k = at[pair[0]], at[pair[1]]
        value = exact[pair] if pair in exact else (None if np.isnan(r[i, k]) else float(r[i, k]))
        out[pair] = (int(n[i, k]), value)
    return out


def _in_place(rows: DataFrame, width: int, own: np.ndarray, other: np.ndarray, sizes: list[int]) -> DataFrame:
    """``k0, k1, ...``: the centred rank of each row under each key, 0 where the row is not ranked.

    Values are counted under all keys of their column at once. Rows then meet the ranks of one column after the other: the
    ranks of a column with few values, and of values that hold a large share of the rows, are broadcast; for the others
    rows are dealt by value, and rows that need none of those are dealt evenly.
    """
    slots = [np.flatnonzero(own == c) for c in range(width)]
    x = F.col("x")
    cells = F.array(*[F.struct(F.lit(c).alias("col"), (x[c] + 0.0).alias("value"), *[
        (x[int(other[slots[c][j]])].isNotNull() if j < len(slots[c]) else F.lit(False)).cast("long").alias(f"n{j}")
        for j in range(max(map(len, slots)))]) for c in range(width)])
    names = [f"n{j}" for j in range(max(map(len, slots)))]
    seen = rows.select(F.inline(cells)).filter("value IS NOT NULL").groupBy("col", "value").agg(*[F.sum(n).alias(n) for n in names])
    ranked = durable(running_before(seen, ["col"], ["value"], names))
    most = F.greatest(*map(F.col, names)) if len(names) > 1 else F.col(names[0])
    heavy = max(sizes) // (4 * shuffle_width(rows.sparkSession)) + 1
    found = {r["col"]: r.n for r in ranked.groupBy("col").agg(F.count(F.lit(1)).alias("n")).collect()}
    for c in range(width):
        if not len(slots[c]):
            continue
        z = F.array(*[F.col(f"n{j}_before") + (F.col(f"n{j}") + 1) / 2 - F.lit((sizes[k] + 1) / 2) for j, k in enumerate(slots[c])])
        table, value = ranked.filter(F.col("col") == c), F.col("x")[c] + 0.0
        hot = table if found.get(c, 0) <= FEW_VALUES else table.filter(most >= heavy)
        rows = rows.join(F.broadcast(hot.select(F.col("value").alias("_v"), z.alias(f"z{c}"))), value == F.col("_v"), "left").drop("_v")
        if found.get(c, 0) > FEW_VALUES:
            spread = F.col(f"z{c}").isNotNull() | value.isNull()
            rows = rows.withColumn("_s", F.when(spread, F.col("id")).otherwise(F.lit(-1))).withColumn("_w", F.when(~spread, value).otherwise(0.0))
            mild = table.filter(most < heavy).select(F.lit(-1).cast("long").alias("_s"), F.col("value").alias("_w"), z.alias("_z"))
            rows = rows.join(mild, ["_s", "_w"], "left").withColumn(f"z{c}", F.coalesce(f"z{c}", "_z")).drop("_s", "_w", "_z")
    at = {int(k): j for c in range(width) for j, k in enumerate(slots[c])}
    return rows.select(*[
        F.coalesce(F.when(x[int(other[k])].isNotNull(), F.col(f"z{own[k]}")[at[k]]), F.lit(0.0)).alias(f"k{k}") for k in range(len(own))])


def _sums_in_place(rows: DataFrame, wanted: list[tuple[int, int]]) -> dict[str, list[float]]:
    """Sums of products and squares of the columns ``k<key>``, as ``product_sums`` has them."""
    squares = sorted({k for pair in wanted for k in pair})
    row = rows.agg(*[F.sum(F.col(f"k{a}") * F.col(f"k{b}")) for a, b in wanted],
                   *[F.sum(F.col(f"k{k}") * F.col(f"k{k}")) for k in squares]).first()
    ab, own = [x or 0.0 for x in row[:len(wanted)]], dict(zip(squares, (x or 0.0 for x in row[len(wanted):])))
    return {"ab": ab, "aa": [own[a] for a, _ in wanted], "bb": [own[b] for _, b in wanted]}


def _ranked(numbers: DataFrame, counts: dict[tuple[str, str], int]) -> dict[tuple[str, str], float | None]:
    """Pearson coefficients of the ranks, ranked over each pair's complete rows, all pairs in one pass.

    A column is ranked once for all pairs that keep all its rows, and once more for each pair with gaps. Every such
    ranking is a key; all keys are counted and ranked together, and rows meet again with all their ranks.
    """
    columns = list(dict.fromkeys(c for pair in counts for c in pair))
    at, width = {c: k for k, c in enumerate(columns)}, len(columns)
    rows = durable(as_arrays(numbers, columns, F.monotonically_increasing_id().alias("id")))
    totals = rows.agg(F.array(*[F.count(F.col("x")[k]) for k in range(width)])).first()[0]
    keys: dict[tuple[int, int], int] = {}
    sizes: list[int] = []

    def key(own: int, other: int, n: int) -> int:
        name = (own, own if totals[own] == n else other)
        if name not in keys:
            keys[name] = len(keys)
            sizes.append(n)
        return keys[name]

    wanted = [(key(at[a], at[b], n), key(at[b], at[a], n)) for (a, b), n in counts.items()]
    own, other = (np.array(x) for x in zip(*keys))

    def cells(batches):
        for batch in batches:
            x = matrix_of(batch, width)
            ids, there = batch.column("id").to_numpy(), ~np.isnan(x)
            for k, (c, partner) in enumerate(zip(own, other)):
                both = there[:, c] & there[:, partner]
                yield pa.record_batch([pa.array(ids[both]), pa.array(np.full(int(both.sum()), k, np.int32)), pa.array(x[both, c] + 0.0)],
                                      names=["id", "key", "value"])

    if width <= FEW_COLUMNS:
        t = _sums_in_place(_in_place(rows, width, own, other, sizes), wanted)
    else:
        # Written once, as they are counted, and joined in two ways.
        ranked = attach_ranks(durable(rows.mapInArrow(cells, "id long, key int, value double")), ["key"], "value")
        middle = F.element_at(F.array(*[F.lit((n + 1) / 2) for n in sizes]), F.col("key") + 1)
        # Cells go on one by one: as a list, a row of many keys would fill a Python worker's batch with megabytes.
        whole = ranked.select("id", "key", (F.col("rank") - middle).alias("z")).repartition("id").sortWithinPartitions("id")
        t = product_sums(whole, [a for a, _ in wanted], [b for _, b in wanted], len(keys))
    out = {}
    for i, pair in enumerate(counts):
        spread = math.sqrt(t["aa"][i]) * math.sqrt(t["bb"][i])
        out[pair] = max(-1.0, min(1.0, float(t["ab"][i]) / spread)) if spread > 0 else None
    return out


def pair_moments(numbers: DataFrame, pairs: list[tuple[str, str]], name: str = "pearson") -> DataFrame:
    """``a, b, n, <name>`` for each pair; one record a pair comes from the driver."""
    found = _moments(numbers, pairs)
    return numbers.sparkSession.createDataFrame(
        [(a, b, n, r) for (a, b), (n, r) in found.items()], f"a string, b string, n long, `{name}` double")


def spearman(table: Table, pairs: list[tuple[str, str]]) -> DataFrame:
    """``a, b, n, spearman``: Pearson of the ranks, ranked over each pair's complete rows."""
    counts = {pair: n for pair, (n, _) in _moments(table.readings, pairs).items()}
    found = _ranked(table.readings, counts)
    return table.spark.createDataFrame([(a, b, counts[a, b], r) for (a, b), r in found.items()], "a string, b string, n long, spearman double")


def coefficients(table: Table, pairs: list[tuple[str, str]], ranks: bool = True) -> DataFrame:
    """``a, b, n, pearson, spearman`` for each pair, unrounded; the number of scans does not depend on the number of pairs."""
    moments = _moments(table.readings, pairs)
    ranked = _ranked(table.readings, {pair: n for pair, (n, _) in moments.items()}) if ranks else {}
    return table.spark.createDataFrame(
        [(a, b, n, r, ranked.get((a, b))) for (a, b), (n, r) in moments.items()],
        "a string, b string, n long, pearson double, spearman double")


def correlate(
    table: Table, columns: list[str], *, min_reported: float = MIN_REPORTED, limit: int = MAX_REPORTED,
    touching: str | None = None, method: str = "both",
) -> DataFrame:
    """Reported pairs, strongest first, each with both coefficients, n, coverage and caveat.

    ``touching`` keeps only pairs with that column, after the reporting limit.
    """
    pairs = column_pairs(columns)
    schema = ("a string, b string, method string, coefficient double, pearson double, spearman double, n long, "
              "coverage double, rows_considered long, strength string, small_sample boolean, caveat string")
    if not pairs:
        return table.spark.createDataFrame([], schema)
    found = coefficients(table, pairs, ranks=method != "pearson")
    p, s = F.col("pearson"), F.col("spearman")
    by_rank = p.isNull() | (s.isNotNull() & (F.abs(s) - F.abs(p) >= METHOD_GAP))
    coefficient = F.when(by_rank, s).otherwise(p)
    coverage = V.coverage_pct(F.col("n"), F.col("rows_considered"))
    caveat = F.concat_ws(
        "; ",
        F.when(F.col("n") <= SMALL_SAMPLE, F.concat(F.lit("only "), F.col("n"), F.lit(" paired observations"))),
        F.when(coverage < LOW_COVERAGE, F.concat(V.number_text(coverage), F.lit("% of rows had both values"))),
        F.when(F.abs(F.abs(s) - F.abs(p)) >= METHOD_GAP, F.lit(
            "Pearson and Spearman disagree, suggesting a non-linear or outlier-driven pattern")))
    reported = (
        found.filter(F.col("n") >= MIN_PAIRS).withColumn("rows_considered", F.lit(table.row_count))
        .withColumn("c", coefficient).filter(F.abs("c") >= min_reported)
        .select(
            "a", "b", F.when(by_rank, "spearman").otherwise("pearson").alias("method"),
            V.round_sig(F.col("c")).alias("coefficient"), V.round_sig(p).alias("pearson"),
            V.round_sig(s).alias("spearman"), "n", coverage.alias("coverage"), "rows_considered",
            V.correlation_strength(F.col("c")).alias("strength"),
            (F.col("n") <= SMALL_SAMPLE).alias("small_sample"),
            F.nullif(caveat, F.lit("")).alias("caveat"))
        .orderBy(F.desc(F.abs("coefficient")), F.collate("a", "UNICODE"), F.collate("b", "UNICODE"))
    )
    if limit is not None:
        reported = reported.limit(limit)
    if touching is not None:
        reported = reported.filter((F.col("a") == touching) | (F.col("b") == touching))
    return reported


def paired_values(table: Table, a: str, b: str, *extra: Column) -> DataFrame:
    """``x, y`` of the rows where both read as numbers."""
    both = table.df.select(*extra, table.number(a).alias("x"), table.number(b).alias("y"))
    return both.filter("x IS NOT NULL AND y IS NOT NULL")


def scatter_points(table: Table, a: str, b: str) -> DataFrame:
    """Every complete pair with its row; ``scatter`` draws a grid instead above ``SCATTER_POINTS`` pairs."""
    rows = paired_values(table, a, b, table.order_column().alias("row"))
    return rows.select(
        "row", V.round_sig(F.col("x")).alias("x"), V.round_sig(F.col("y")).alias("y"))


def density_grid(table: Table, a: str, b: str, cells: int = GRID_CELLS) -> DataFrame:
    """Every complete pair in exactly one cell of an even grid; only filled cells, in order."""
    rows = paired_values(table, a, b)
    ends = rows.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if ends[0] is None:
        return table.spark.createDataFrame([], "x_cell int, y_cell int, count long")

    def cell(c: str, low: float, high: float) -> Column:
        at = F.floor((F.col(c) - F.lit(low)) / F.lit((high - low) or 1.0) * cells)
        return F.least(F.lit(cells - 1), at).cast("int")

    return (
        rows.groupBy(cell("x", ends[0], ends[1]).alias("x_cell"), cell("y", ends[2], ends[3]).alias("y_cell"))
        .agg(F.count(F.lit(1)).alias("count")).orderBy("x_cell", "y_cell")
    )


def scatter(table: Table, a: str, b: str) -> DataFrame:
    """Points where they fit, else the grid; ``kind`` says which."""
    small = paired_values(table, a, b).limit(SCATTER_POINTS + 1).count() <= SCATTER_POINTS
    if small:
        return scatter_points(table, a, b).withColumn("kind", F.lit("points"))
    return density_grid(table, a, b).withColumn("kind", F.lit("grid"))


def correlation_matrix(profile: Profile, reported: DataFrame | None = None, shown_columns: int | None = MATRIX_COLUMNS) -> DataFrame:
    """Symmetric grid over the leading numeric columns; an unreported pair is null, never 0."""
    shown = profile.numeric[:shown_columns]
    if reported is None:
        reported = correlate(profile.table, profile.numeric)
    sides = reported.select("a", "b", "coefficient").unionByName(
        reported.select(F.col("b").alias("a"), F.col("a").alias("b"), "coefficient"))
    names = profile.table.spark.createDataFrame([(c,) for c in shown], "a string")
    grid = sides.filter(F.col("a").isin(shown)).groupBy("a").pivot("b", shown).agg(F.first("coefficient"))
    return names.join(F.broadcast(grid), "a", "left").withColumnRenamed("a", "column")


