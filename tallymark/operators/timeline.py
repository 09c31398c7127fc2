"""Date columns: range, periods, trend, change, gaps and spacing."""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import dates as D, values as V
from .ranks import in_slices, order_statistics
from .table import Table

# --- fixed values -----------------------------------------------------------
SHOWN_PERIODS = 60
SHOWN_GAPS = 20
TREND_CHANGE = 0.15
IRREGULAR_STEP = 5
DAY_SECONDS = 86_400
# ----------------------------------------------------------------------------


class Timeline:
    """The timeline of one date column.

    The grain is fixed by the range, so there are at most 93 day periods, 37 month
    periods or one per calendar year: period frames are small whatever the table holds.
    """

    def __init__(self, table: Table, column: str):
        self.table, self.column = table, column

    @property
    def facts(self):
        return self.table.facts[self.column]

    @property
    def range_days(self) -> int | None:
        f = self.facts
        if not f.dates:
            return None
        return math.floor((f.latest - f.earliest).total_seconds() / DAY_SECONDS + 0.5)

    @property
    def grain(self) -> str | None:
        days = self.range_days
        if days is None:
            return None
        return "day" if days <= D.DAY_GRAIN_DAYS else "month" if days <= D.MONTH_GRAIN_DAYS else "year"

    def _moments(self) -> DataFrame:
        return self.table.df.select(self.table.moment(self.column).alias("ts")).filter("ts IS NOT NULL")

    def summary(self) -> DataFrame:
        """Valid, missing, invalid, coverage, first and last day, range and grain, as one row."""
        f = self.facts
        frame = self.table.spark.createDataFrame(
            [(self.column, f.row_count, f.dates, f.missing, f.present - f.dates, f.earliest, f.latest)],
            "column string, row_count long, valid long, missing long, invalid long, first timestamp_ntz, last timestamp_ntz")
        seconds = (D.micros(F.col("last")) - D.micros(F.col("first"))) / 1e6
        days = F.floor(seconds / DAY_SECONDS + 0.5)
        return frame.select(
            "column", "valid", "missing", "invalid", V.coverage_pct(F.col("valid"), F.col("row_count")).alias("coverage"),
            D.day_text(F.col("first")).alias("earliest"), D.day_text(F.col("last")).alias("latest"),
            days.alias("range_days"), F.when(days.isNotNull(), D.choose_granularity(days)).alias("granularity"))

    def period_counts(self, limit: int | None = None) -> DataFrame:
        """``period, count`` of the populated periods in order."""
        counts = self._moments().groupBy(D.period_key(F.col("ts"), self.grain or "day").alias("period")).agg(
            F.count(F.lit(1)).alias("count"))
        return counts if limit is None else counts.orderBy("period").limit(limit)

    @cached_property
    def periods(self) -> list[tuple[str, int]]:
        return [(r["period"], r["count"]) for r in self.period_counts().orderBy("period").collect()]

    def period_frame(self) -> DataFrame:
        return self.table.spark.createDataFrame(self.periods, "period string, count long")

    def trend(self) -> DataFrame:
        """Mean count of the first third of periods against the last third, as one row."""
        order = W.partitionBy(F.lit(0)).orderBy("period")
        placed = self.period_frame().select(
            "count", F.row_number().over(order).alias("place"),
            F.count(F.lit(1)).over(W.partitionBy(F.lit(0))).alias("periods"))
        third = F.greatest(F.lit(1), F.floor(F.col("periods") / 3))
        means = placed.agg(
            F.max("periods").alias("periods"),
            F.avg(F.when(F.col("place") <= third, F.col("count"))).alias("first_mean"),
            F.avg(F.when(F.col("place") > F.col("periods") - third, F.col("count"))).alias("last_mean"))
        change = F.try_divide(F.col("last_mean") - F.col("first_mean"), F.col("first_mean"))
        direction = (
            F.when(change >= TREND_CHANGE, "increasing").when(change <= -TREND_CHANGE, "decreasing").otherwise("flat"))
        return means.select(
            "periods", "first_mean", "last_mean",
            F.when(F.col("periods") >= 3, direction).alias("trend"))

    def period_over_period(self) -> DataFrame:
        """The last two populated periods, as one row; none under two periods."""
        order = W.partitionBy(F.lit(0)).orderBy("period")
        pairs = self.period_frame().select(
            F.col("period").alias("current"), F.col("count").alias("current_count"),
            F.lag("period").over(order).alias("previous"), F.lag("count").over(order).alias("previous_count"))
        change = F.col("current_count") - F.col("previous_count")
        return pairs.filter("previous IS NOT NULL").orderBy(F.desc("current")).limit(1).select(
            F.lit(self.grain).alias("granularity"), "current", "current_count", "previous", "previous_count",
            change.alias("delta"), F.round(F.try_divide(change, "previous_count") * 100, 1).alias("change_pct"))

    def calendar(self) -> DataFrame:
        """Every day or month between the ends, calendar-correct; none for the year grain."""
        f, grain = self.facts, self.grain
        if grain in (None, "year"):
            return self.table.spark.createDataFrame([], "period string")
        start, end = (F.to_date(F.lit(t.strftime("%Y-%m-%d"))) for t in (f.earliest, f.latest))
        if grain == "month":
            start, end = F.trunc(start, "month"), F.trunc(end, "month")
        step = F.make_ym_interval(F.lit(0), F.lit(1)) if grain == "month" else F.make_dt_interval(F.lit(1))
        days = self.table.spark.range(1).select(F.explode(F.sequence(start, end, step)).alias("d"))
        return days.select(F.date_format("d", D.GRAIN_FORMAT[grain]).alias("period"))

    def gaps(self, limit: int | None = SHOWN_GAPS) -> DataFrame:
        """Empty periods between the first and last populated one."""
        empty = self.calendar().join(F.broadcast(self.period_frame()), "period", "left_anti")
        return empty if limit is None else empty.orderBy("period").limit(limit)

    def gap_filled(self, shown_periods: int | None = None, shown_gaps: int | None = None) -> DataFrame:
        """The timeline with its empty periods restored as zero counts."""
        periods = self.period_frame()
        if shown_periods is not None:
            periods = periods.orderBy("period").limit(shown_periods)
        return periods.unionByName(self.gaps(shown_gaps).withColumn("count", F.lit(0).cast("long")))

    def steps(self) -> DataFrame:
        """Positive steps between consecutive distinct moments, in microseconds."""
        distinct = self._moments().groupBy("ts").agg(F.count(F.lit(1)).alias("n")).select(
            D.micros(F.col("ts")).alias("at"), "n")
        sliced = in_slices(distinct, ["at"])
        # One row per slice: where the nearest earlier slice ended.
        ends = sliced.groupBy("_slice").agg(F.max("at").alias("end"))
        before = ends.select(
            F.col("_slice").alias("_s"), F.lag("end").over(W.partitionBy(F.lit(0)).orderBy("_slice")).alias("carried"))
        inner = W.partitionBy("_slice").orderBy("at")
        joined = sliced.withColumn("prev", F.lag("at").over(inner)).join(
            F.broadcast(before), F.col("_slice") == F.col("_s"), "left")
        return joined.select("n", (F.col("at") - F.coalesce("prev", "carried")).alias("step"))

    def irregular_intervals(self) -> DataFrame:
        """Whether the widest step exceeds five upper-median steps, as one row.

        Equal moments are steps of zero; they are counted, not listed.
        """
        steps = self.steps()
        seen = steps.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("moments"), F.count("step").alias("positive"),
            F.max("step").alias("widest")).first()
        middle = None
        if seen.moments >= 4:
            place = (seen.moments - 1) // 2 - (seen.moments - 1 - seen.positive)
            middle = 0 if place < 0 else order_statistics(
                steps.select("step"), {"step": (seen.positive, [place])})["step"][place]
        irregular = bool(middle and seen.widest > IRREGULAR_STEP * middle)
        return self.table.spark.createDataFrame(
            [(self.column, seen.moments, seen.widest, middle, irregular)],
            "column string, moments long, widest_step long, median_step long, irregular boolean")


def date_columns(table: Table) -> DataFrame:
    """Which columns read as dates, and the share of present cells that do."""
    return table.column_facts().select(
        "column", "present", "dates",
        ((F.col("present") > 0) & (F.col("dates") >= 0.8 * F.col("present"))).alias("is_date"))


