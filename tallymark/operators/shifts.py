"""Level shift in an ordered series: the split whose two sides differ most.

Scoring every split needs the median of every prefix and suffix. Instead of a
running median over the whole series in one task, splits are searched in blocks:
a fixed-size grid of counts (segment of the series x slot of the value range)
bounds the medians of every split in a block, a block whose best possible score
is below a score already certain is dropped, and the rest are cut finer. The
search ends only when one split is certain, so the answer is the one a scan of
all splits gives.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import dates as D, values as V
from ..session import durable
from .infer import welch
from .ranks import quantiles, with_position
from .table import Table

# --- fixed values -----------------------------------------------------------
MIN_SEGMENT = 5
MIN_SERIES = 12
MIN_EFFECT = 0.5
MAD_TO_STD = 1.4826
# ----------------------------------------------------------------------------
# The grid that returns to the driver has at most this many cells, at any scale.
BOUNDARIES, EDGES, STRETCHES = 2048, 1024, 512
# A task of the grid adds up its cells after so many rows, as each addition passes over the whole grid.
TALLIED_ROWS = 1_000_000


def ordered_series(table: Table, date_column: str, target: str) -> DataFrame:
    """``position, at, row, value`` in time order, equal times in row order."""
    rows = table.df.select(
        D.micros(table.moment(date_column)).alias("at"), table.order_column().cast("long").alias("row"),
        table.number(target).alias("value")).filter("at IS NOT NULL AND value IS NOT NULL")
    return durable(with_position(rows, ["at", "row"]))


def mad(df: DataFrame, value: str = "value") -> dict[str, float]:
    """Median and median absolute deviation of a double column, with count and spread."""
    one = df.select(F.col(value).alias("value")).filter("value IS NOT NULL")
    basic = one.agg(
        F.count("value").alias("n"), F.approx_count_distinct("value").alias("d"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")).first()
    if not basic.n:
        return {"n": 0, "median": None, "mad": None, "std": None, "min": None, "max": None}
    center = quantiles(one, {"value": basic.n}, {"value": basic.d}, {"m": 0.5})["value"]["m"]
    away = one.select(F.abs(F.col("value") - F.lit(center)).alias("value"))
    spread = quantiles(away, {"value": basic.n}, {"value": basic.d}, {"m": 0.5})["value"]["m"]
    return {"n": basic.n, "median": center, "mad": spread, "std": basic.std, "min": basic.min, "max": basic.max}


@dataclass
class _Grid:
    """Cumulative counts: prefix[i, j] is how many of the first bounds[i] values lie in slots up to j.

    Odd slots hold exactly one edge value, even slots the open range between two edges.
    """

    bounds: np.ndarray
    low: np.ndarray
    high: np.ndarray
    prefix: np.ndarray

    def of(self, side: str, split: np.ndarray) -> np.ndarray:
        rows = self.prefix[np.searchsorted(self.bounds, split)]
        return rows if side == "before" else self.prefix[-1] - rows

    def ranked(self, counts: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds on the rank-th smallest (1-based) of each row's multiset."""
        slot = (counts < rank[:, None]).sum(axis=1)
        slot = np.minimum(slot, counts.shape[1] - 1)
        return self.low[slot], self.high[slot]


def _count_grid(series: DataFrame, bounds: np.ndarray, edges: np.ndarray, ends: tuple[float, float], n: int) -> _Grid:
    slots, segments = 2 * len(edges) + 1, len(bounds)

    def tally(batches):
        total = np.zeros((segments + 1) * slots, dtype=np.int64)
        held, rows = [], 0
        for batch in batches:
            value, position = batch["value"].to_numpy(), batch["position"].to_numpy()
            left = np.searchsorted(edges, value, "left")
            slot = 2 * left + (edges[np.minimum(left, len(edges) - 1)] == value)
            held.append(np.searchsorted(bounds, position, "right") * slots + slot)
            rows += len(value)
            if rows >= TALLIED_ROWS:
                total += np.bincount(np.concatenate(held), minlength=len(total))
                held, rows = [], 0
        if rows:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        filled = np.flatnonzero(total)
        yield pd.DataFrame({"cell": filled, "n": total[filled]})

    cells = (
        series.select("position", "value").mapInPandas(tally, "cell long, n long")
        .groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    )
    grid = np.zeros((segments + 1) * slots, dtype=np.int64)
    grid[cells["cell"].to_numpy(dtype=np.int64)] = cells["n"].to_numpy(dtype=np.int64)
    grid = grid.reshape(segments + 1, slots)
    prefix = grid.cumsum(axis=0).cumsum(axis=1)
    low, high = np.empty(slots), np.empty(slots)
    low[1::2] = high[1::2] = edges
    low[0::2] = np.concatenate([[ends[0]], edges])
    high[0::2] = np.concatenate([edges, [ends[1]]])
    return _Grid(np.append(bounds, n), low, high, prefix)


def _middle_ranges(grid: _Grid, side: str, small_at, large_at, least, most, top: float):
    """Where the two middle values of a side can lie while its size runs from ``least`` to ``most``.

    The side always holds the values up to one bound and is held by those up to another.
    """
    inner, outer = grid.of(side, small_at), grid.of(side, large_at)
    columns = []
    for low_rank, high_rank in (((least + 1) // 2, (most + 1) // 2), (least // 2 + 1, most // 2 + 1)):
        columns.append(grid.ranked(outer, low_rank)[0])
        high = grid.ranked(inner, np.minimum(high_rank, least))[1]
        columns.append(np.where(high_rank <= least, high, top))
    return np.stack(columns, axis=1)


def _ranges(grid: _Grid, a: np.ndarray, b: np.ndarray, n: int, top: float) -> np.ndarray:
    """Eight columns: low and high of the lower and upper middle value, before and then after."""
    before = _middle_ranges(grid, "before", a, b, a, b, top)
    after = _middle_ranges(grid, "after", b, a, n - b, n - a, top)
    return np.concatenate([before, after], axis=1)


def _medians(ranges: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lowest and highest median before, lowest and highest median after."""
    return tuple((ranges[:, i] + ranges[:, i + 2]) / 2 for i in (0, 1, 4, 5))


def _certain(ranges: np.ndarray, at: np.ndarray, n: int, scale: float) -> np.ndarray:
    b_low, b_high, a_low, a_high = _medians(ranges)
    apart = np.maximum(np.maximum(a_low - b_high, b_low - a_high), 0)
    return apart / scale * np.sqrt(np.minimum(at, n - at) / n)


def _widest(ranges: np.ndarray) -> np.ndarray:
    b_low, b_high, a_low, a_high = _medians(ranges)
    return np.maximum(np.maximum(a_high - b_low, b_high - a_low), 0)


def _highest(ranges: np.ndarray, a: np.ndarray, b: np.ndarray, n: int, scale: float) -> np.ndarray:
    ends = np.maximum(np.minimum(a, n - a), np.minimum(b, n - b))
    balance = np.where((a <= n // 2) & (n // 2 <= b), n // 2, ends)
    return _widest(ranges) / scale * np.sqrt(balance / n)


def _cut(blocks: np.ndarray, known: np.ndarray, pieces: int) -> tuple[np.ndarray, np.ndarray]:
    out, owner = [blocks[:0]], []
    for i, (a, b) in enumerate(blocks):
        starts = np.unique(np.linspace(a, b + 1, min(pieces, b - a + 1) + 1).astype(np.int64))
        out.append(np.stack([starts[:-1], starts[1:] - 1], axis=1))
        owner += [i] * (len(starts) - 1)
    return np.concatenate(out), known[owner]


def _first_blocks(n: int, segment: int) -> np.ndarray:
    """Blocks that widen with the distance from either end, as bounds there need finer cuts."""
    last = n - segment
    if last - segment + 1 <= BOUNDARIES // 2:
        starts = np.arange(segment, last + 1)
    else:
        reach = np.geomspace(1, (last - segment) / 2, 256)
        starts = np.unique(np.concatenate([segment + reach - 1, last - reach + 1]).astype(np.int64))
    return np.stack([starts, np.append(starts[1:] - 1, last)], axis=1)


def _open_stretches(ranges: np.ndarray) -> np.ndarray:
    """Disjoint value stretches, in order, where a middle value is still unsettled.

    Should there be too many, those of the most promising blocks go first.
    """
    found = _merged(ranges)
    return found if len(found) <= STRETCHES else _merged(ranges[: STRETCHES // 4])


def _merged(ranges: np.ndarray) -> np.ndarray:
    pairs = ranges.reshape(-1, 2)
    pairs = np.unique(pairs[pairs[:, 0] < pairs[:, 1]], axis=0)
    if not len(pairs):
        return pairs
    reach = np.maximum.accumulate(pairs[:, 1])
    starts = np.concatenate([[True], pairs[1:, 0] >= reach[:-1]])
    lasts = np.append(np.flatnonzero(starts)[1:] - 1, len(pairs) - 1)
    return np.stack([pairs[starts, 0], reach[lasts]], axis=1)


def _edges(series: DataFrame, stretches: np.ndarray, turn: int) -> np.ndarray:
    """The ends of the stretches and values inside: all of them once they are few, else an even-handed sample.

    Which values are sampled steers the search, never its answer.
    """
    lows, highs = stretches[:, 0], stretches[:, 1]

    def inside(batches):
        for batch in batches:
            value = batch["value"].to_numpy()
            at = np.maximum(np.searchsorted(lows, value, "left") - 1, 0)
            yield batch[(value > lows[at]) & (value < highs[at])]

    rows = series.select("value", "position")
    if len(stretches) > 1:
        rows = rows.mapInPandas(inside, rows.schema)
    else:
        rows = rows.filter((F.col("value") > F.lit(float(lows[0]))) & (F.col("value") < F.lit(float(highs[0]))))
    sample = rows.orderBy(F.xxhash64("position", F.lit(turn))).limit(EDGES).select("value").toPandas()
    return np.unique(np.concatenate([sample["value"].to_numpy(dtype=np.float64), stretches.ravel()]))


def find_split(
    series: DataFrame, n: int, scale: float, ends: tuple[float, float], segment: int = MIN_SEGMENT,
    least_effect: float = 0.0,
) -> int | None:
    """The earliest split with the highest score, certain among all splits.

    None as soon as that split is certain to lie in a block whose medians are less than ``least_effect`` scales apart.
    """
    enough = least_effect * scale * (1 - 1e-9)
    blocks = _first_blocks(n, segment)
    # What is known of a block only ever narrows: its pieces inherit its median ranges.
    ends = (np.nextafter(ends[0], -np.inf), np.nextafter(ends[1], np.inf))
    known = np.tile(np.array(ends * 4, dtype=np.float64), (len(blocks), 1))
    best, settled, turn = 0.0, [], 0
    waiting, waiting_known = blocks[:0], known[:0]
    while len(blocks):
        a, b = blocks[:, 0], blocks[:, 1]
        stretches, turn = _open_stretches(known), turn + 1
        edges = _edges(series, stretches, turn) if len(stretches) else np.array(ends)
        grid = _count_grid(series, np.unique(blocks), edges, ends, n)
        seen = _ranges(grid, a, b, n, ends[1])
        known[:, 0::2] = np.maximum(known[:, 0::2], seen[:, 0::2])
        known[:, 1::2] = np.minimum(known[:, 1::2], seen[:, 1::2])
        certain = np.where(a == b, _certain(known, a, n, scale), 0)
        for at in (a, b):
            certain = np.maximum(certain, _certain(_ranges(grid, at, at, n, ends[1]), at, n, scale))
        best = max(best, certain.max())
        exact = (a == b) & np.all(known[:, 0::2] == known[:, 1::2], axis=1)
        settled += list(zip(_certain(known[exact], a[exact], n, scale), a[exact], _widest(known[exact])))
        blocks = np.concatenate([blocks[~exact], waiting])
        known = np.concatenate([known[~exact], waiting_known])
        upper = _highest(known, blocks[:, 0], blocks[:, 1], n, scale)
        kept = np.flatnonzero(upper >= best)
        kept = kept[np.lexsort((blocks[kept, 0], -upper[kept]))]
        blocks, known = blocks[kept], known[kept]
        if enough and np.all(_widest(known) < enough) and all(apart < enough for score, _, apart in settled if score >= best):
            return None
        budget = BOUNDARIES // 4
        waiting, waiting_known = blocks[budget:], known[budget:]
        blocks, known = _cut(blocks[:budget], known[:budget], max(2, budget // max(1, min(len(blocks), budget))))
    top = max(score for score, *_ in settled)
    return int(min(at for score, at, _ in settled if score == top))


def level_shift(series: DataFrame, segment: int = MIN_SEGMENT) -> DataFrame:
    """One row describing the best split, or none where the series is short, flat or the shift is small.

    ``series`` holds ``position`` (0-based, unique), ``at`` (microseconds) and ``value``.
    """
    spark = series.sparkSession
    schema = (
        "split_index long, n long, boundary_at long, before_median double, after_median double, scale double, "
        "n1 long, m1 double, v1 double, n2 long, m2 double, v2 double")
    facts = mad(series)
    n = facts["n"]
    scale = facts["mad"] * MAD_TO_STD if n and facts["mad"] else facts["std"]
    record = []
    if n >= max(MIN_SERIES, 2 * segment) and scale and np.isfinite(scale):
        split = find_split(series, n, scale, (facts["min"], facts["max"]), segment, MIN_EFFECT)
    else:
        split = None
    if split is not None:
        first = F.col("position") < split
        sides = series.select(
            F.when(first, F.col("value")).alias("before"), F.when(~first, F.col("value")).alias("after"),
            F.when(F.col("position") == split, F.col("at")).alias("at"))
        row = sides.agg(
            F.count("before").alias("n1"), F.avg("before").alias("m1"), F.var_samp("before").alias("v1"),
            F.count("after").alias("n2"), F.avg("after").alias("m2"), F.var_samp("after").alias("v2"),
            F.max("at").alias("at"), F.approx_count_distinct("before").alias("d1"),
            F.approx_count_distinct("after").alias("d2")).first()
        medians = quantiles(
            sides, {"before": row.n1, "after": row.n2}, {"before": row.d1, "after": row.d2}, {"m": 0.5})
        before, after = medians["before"]["m"], medians["after"]["m"]
        if abs((after - before) / scale) >= MIN_EFFECT:
            record = [(split, n, row["at"], before, after, float(scale),
                       row.n1, row.m1, row.v1, row.n2, row.m2, row.v2)]
    found = spark.createDataFrame(record, schema)
    effect = (F.col("after_median") - F.col("before_median")) / F.col("scale")
    balance = F.sqrt(F.least("n1", "n2") / F.col("n"))
    return found.select(
        "split_index", "n", D.day_text(F.timestamp_micros("boundary_at").cast("timestamp_ntz")).alias("boundary"),
        V.round_sig(F.col("before_median")).alias("baseline_median"),
        V.round_sig(F.col("after_median")).alias("current_median"),
        V.round_sig(F.col("after_median") - F.col("before_median")).alias("median_difference"),
        V.round_sig(effect).alias("robust_effect"), V.round_sig(F.abs(effect) * balance).alias("score"),
        welch(*[F.col(c) for c in ("n1", "m1", "v1", "n2", "m2", "v2")]).alias("inference"),
        F.lit(True).alias("exploratory"))
