"""Order at scale: running counts, positions, and exact order statistics.

A window without a partition puts the whole table in one task. Here order is
cut into range slices whose numbers are written down once, each slice is
numbered on its own, and the slice totals (one row per slice and key) carry the
running count across. For a handful of order statistics no sort is needed at
all: a bracket around each one is narrowed until it holds few rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.values import quoted
from ..session import durable, shuffle_width
from .table import chunks

# Values one search may gather at its end.
GATHERED_VALUES = 100_000
# Distinct values the in-memory exact percentile may keep per column.
PERCENTILE_DISTINCT = 250_000
BROADCAST_KEYS = 100_000
_SKETCH = 10_000


def in_slices(df: DataFrame, order: list[str]) -> DataFrame:
    """Range partitions over ``order`` with their number fixed in a written column."""
    n = shuffle_width(df.sparkSession)
    return durable(df.repartitionByRange(n, *order).withColumn("_slice", F.spark_partition_id()))


def running_before(df: DataFrame, keys: list[str], order: list[str], measures: list[str]) -> DataFrame:
    """Adds ``<measure>_before``: the sum over strictly earlier rows of the same key. ``order`` must be unique within a key."""
    sliced = in_slices(df, [*keys, *order])
    inner = W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    outer = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy("_slice")
    outer = outer.rowsBetween(W.unboundedPreceding, -1)
    totals = sliced.groupBy(*keys, "_slice").agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    carried = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_slice").alias("_s"),
        *[F.coalesce(F.sum(f"_{m}").over(outer), F.lit(0)).alias(f"_{m}_carried") for m in measures],
    )
    joined = sliced.select(
        "*", *[F.coalesce(F.sum(m).over(inner), F.lit(0)).alias(f"{m}_before") for m in measures]
    ).join(
        carried if keys else F.broadcast(carried),  # without keys one row a slice
        on=[F.col("_slice") == F.col("_s"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]],
    )
    return joined.select(
        *df.columns,
        *[(F.col(f"{m}_before") + F.col(f"_{m}_carried")).alias(f"{m}_before") for m in measures],
    )


def with_position(df: DataFrame, order: list[str], *, name: str = "position") -> DataFrame:
    """0-based place of each row in the order."""
    ones = running_before(df.withColumn("_one", F.lit(1)), [], order, ["_one"])
    return ones.withColumnRenamed("_one_before", name).drop("_one")


def average_ranks(counts: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    """Adds ``rank`` to value counts: 1-based, ties share the mean of the places they cover."""
    ranked = running_before(counts, keys, [value], [n])
    return ranked.withColumn("rank", F.col(f"{n}_before") + (F.col(n) + 1) / 2).drop(f"{n}_before")


def rank_average(df: DataFrame, column: Column) -> DataFrame:
    """``value, n, rank`` over the non-null values of a column."""
    counts = df.select(column.alias("value")).filter("value IS NOT NULL").groupBy("value").agg(
        F.count(F.lit(1)).alias("n"))
    return average_ranks(counts, [], "value", "n")


def attach_ranks(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` with the average ``rank`` of their value among the rows of their key; rows without a value are dropped.

    Values are counted and ranked; each row then meets its value. A value that holds a large share of all rows is
    broadcast, of which there can only be a few for each partition, so its rows stay where they are.
    """
    on = [*keys, value]
    rows = rows.filter(F.col(value).isNotNull())
    ranked = durable(average_ranks(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")), keys, value, "_n"))
    heavy = (ranked.agg(F.sum("_n")).first()[0] or 0) // (4 * shuffle_width(rows.sparkSession)) + 1
    hot = F.broadcast(ranked.filter(F.col("_n") >= heavy).drop("_n"))
    mild = ranked.filter(F.col("_n") < heavy).drop("_n")
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(mild, on))


def beside_totals(rows: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Joins one row per key to many. Few keys are broadcast after they are counted, so a key with
    most of the rows stays spread; beyond that the join is by key and skew is split at run time."""
    if not keys:
        return rows.join(F.broadcast(totals))
    totals = durable(totals)
    small = totals.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(totals) if small else totals, keys)


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group, with no group held in one task.

    Values are counted first, so a group of any size only ever moves as value
    counts, and the wanted places are read off the running counts.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_before(counts, keys, [value], ["_n"])
    totals = placed.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    at = beside_totals(placed, totals, keys)

    def value_at(place: Column) -> Column:
        here = (F.col("_n_before") <= place) & (place < F.col("_n_before") + F.col("_n"))
        return F.max(F.when(here, F.col(value)))

    aggregates = []
    for name, q in probs.items():
        place = (F.col("_total") - 1) * q
        aggregates += [
            value_at(F.floor(place)).alias(f"_lo_{name}"),
            value_at(F.ceil(place)).alias(f"_hi_{name}"),
        ]
    found = at.groupBy(*keys, "_total").agg(*aggregates)
    out = []
    for name, q in probs.items():
        place = (F.col("_total") - 1) * q
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (place - F.floor(place)) * (high - low)).alias(name))
    return found.select(*keys, F.col("_total").alias("n"), *out)


# -- a few order statistics of many expressions -----------------------------------

class _Hunt:
    """One wanted place: the open interval known to hold it, and its place inside."""

    def __init__(self, name, place, inside):
        self.name, self.asked, self.place, self.inside = name, place, place, inside
        self.low = self.high = self.value = None

    def within(self) -> Column:
        c = F.col(quoted(self.name))
        keep = c.isNotNull()
        if self.low is not None:
            keep &= c > F.lit(self.low)
        if self.high is not None:
            keep &= c < F.lit(self.high)
        return F.when(keep, c)


def _collect_small(df: DataFrame, hunts: list[_Hunt]) -> None:
    """Brackets of at most GATHERED_VALUES rows are sorted outright, a bounded number at a time."""
    for part in chunks(hunts, 8):
        row = df.agg(*[
            F.try_element_at(F.sort_array(F.collect_list(h.within())), F.lit(h.place + 1)).alias(f"v{i}")
            for i, h in enumerate(part)
        ]).first()
        for i, h in enumerate(part):
            h.value = row[f"v{i}"]


def _narrow(df: DataFrame, hunts: list[_Hunt]) -> None:
    """Two scans: sketch a tighter bracket, then count exactly on, below and between its ends.

    The ends are counted apart from the inside, so a value held by a third of all
    rows drops out of the bracket as soon as it is one of its ends.
    """
    for part in chunks(hunts, 40):
        # Places sought in the same bracket of the same column share one sketch.
        shared: dict[tuple, list[_Hunt]] = {}
        for h in part:
            shared.setdefault((h.name, h.low, h.high), []).append(h)
        sketched = []
        for i, group in enumerate(shared.values()):
            at = [h.place / max(1, h.inside - 1) for h in group]
            fractions = [f for q in at for f in (max(0.0, q - 2 / _SKETCH), min(1.0, q + 2 / _SKETCH))]
            sketched.append(F.percentile_approx(group[0].within(), fractions, _SKETCH).alias(f"s{i}"))
        row = df.agg(*sketched).first()
        sketch = {}
        for i, group in enumerate(shared.values()):
            for j, h in enumerate(group):
                sketch[id(h)] = row[f"s{i}"][2 * j:2 * j + 2]
        counts = []
        for i, h in enumerate(part):
            a, b = sketch[id(h)]
            c = h.within()
            counts += [
                F.count_if(c < F.lit(a)).alias(f"below{i}"), F.count_if(c == F.lit(a)).alias(f"low{i}"),
                F.count_if((c > F.lit(a)) & (c < F.lit(b))).alias(f"mid{i}"),
                F.count_if(c == F.lit(b)).alias(f"high{i}"),
            ]
        seen = df.agg(*counts).first()
        for i, h in enumerate(part):
            a, b = sketch[id(h)]
            below, low, mid, high = (seen[f"{k}{i}"] for k in ("below", "low", "mid", "high"))
            place = h.place
            if place < below:
                h.high, h.inside = a, below
            elif place < below + low:
                h.value = a
            elif place < below + low + mid:
                h.low, h.high, h.place, h.inside = a, b, place - below - low, mid
            elif a != b and place < below + low + mid + high:
                h.value = b
            else:
                # Beyond the upper end; b == a means the upper end was counted as ``low``.
                passed = below + low + mid + (high if a != b else 0)
                h.low, h.place, h.inside = b, place - passed, h.inside - passed


def order_statistics(df: DataFrame, wanted: dict[str, tuple[int, list[int]]]) -> dict[str, dict[int, object]]:
    """Exact k-th smallest values of columns of ``df``.

    ``wanted`` maps a column to (its non-null count, 0-based places). What returns to
    the driver is one value per place asked for.
    """
    hunts = [
        _Hunt(name, place, n) for name, (n, places) in wanted.items() for place in sorted(set(places))
        if 0 <= place < n
    ]
    open_hunts = list(hunts)
    while open_hunts:
        small = [h for h in open_hunts if h.inside <= GATHERED_VALUES]
        _collect_small(df, small)
        open_hunts = [h for h in open_hunts if h.inside > GATHERED_VALUES]
        if open_hunts:
            _narrow(df, open_hunts)
            open_hunts = [h for h in open_hunts if h.value is None]
    out: dict[str, dict[int, object]] = {name: {} for name in wanted}
    for h in hunts:
        out[h.name][h.asked] = h.value
    return out


def quantiles(
    df: DataFrame, counts: dict[str, int], distinct: dict[str, int], probs: dict[str, float]
) -> dict[str, dict[str, float]]:
    """Exact interpolated quantiles of double columns, one record per column.

    Few distinct values: Spark's exact ``percentile`` (its state is one entry per
    distinct value). Many: the narrowing search, which holds no value map at all.
    """
    out: dict[str, dict[str, float]] = {}
    small = [c for c in counts if counts[c] and distinct[c] <= PERCENTILE_DISTINCT]
    for part in chunks(small, 60):
        row = df.agg(*[
            F.percentile(F.col(quoted(c)), list(probs.values())).alias(f"q{i}") for i, c in enumerate(part)
        ]).first()
        for i, c in enumerate(part):
            out[c] = dict(zip(probs, row[f"q{i}"]))
    large = {c: n for c, n in counts.items() if n and c not in out}
    if large:
        places = {
            c: (n, [f((n - 1) * q) for q in probs.values() for f in (math.floor, math.ceil)])
            for c, n in large.items()
        }
        found = order_statistics(df, places)
        for c, n in large.items():
            out[c] = {}
            for name, q in probs.items():
                at = (n - 1) * q
                low, high = found[c][math.floor(at)], found[c][math.ceil(at)]
                out[c][name] = low + (at - math.floor(at)) * (high - low)
    return out
