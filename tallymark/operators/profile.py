"""What each column holds: numeric summaries, fences, histograms, levels, roles."""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions import distributions as S, values as V
from .ranks import quantiles
from .table import Table

# --- fixed values -----------------------------------------------------------
QUANTILES = {"p05": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95}
TOP_LEVELS = 8
OUTLIER_MIN_VALUES = 8
FENCE_REACH = 1.5
OUTLIER_ROWS = 200
MAX_BINS = 10
IDENTIFIER_RATIO, IDENTIFIER_MIN = 0.9, 10
CATEGORY_LEVELS, CATEGORY_RATIO = 25, 0.5
# ----------------------------------------------------------------------------
# Types whose level text is that of a double.
DOUBLES = (T.FloatType(), T.DoubleType())


def _n(column: str) -> Column:
    return F.col(V.quoted(column))


def by_level(direction: str = "asc") -> Column:
    """Level text in dictionary order rather than byte order."""
    c = F.collate(F.col("level"), "UNICODE")
    return c.asc() if direction == "asc" else c.desc()


def level_counts(table: Table, columns: list[str]) -> DataFrame:
    """``column, level, n`` for present cells, all columns in one scan."""
    parts = [F.struct(
        F.lit(c).alias("column"), (table.number(c) if table.types[c] in DOUBLES else F.lit(None).cast("double")).alias("x"),
        (F.lit(None).cast("string") if table.types[c] in DOUBLES else table.level(c)).alias("level")) for c in columns]
    cells = table.df.select(F.inline(F.array(*parts))).filter("x IS NOT NULL OR level IS NOT NULL")
    counts = cells.groupBy("column", "x", "level").agg(F.count(F.lit(1)).alias("n"))
    if not any(table.types[c] in DOUBLES for c in columns):
        return counts.drop("x")
    # Numbers are counted as such and written as text once a value; two values may share a text.
    return counts.groupBy("column", F.coalesce("level", V.number_text(F.col("x"))).alias("level")).agg(F.sum("n").alias("n"))


def top_levels(counts: DataFrame, limit: int = TOP_LEVELS) -> DataFrame:
    """The leading levels per column; Spark keeps only ``limit`` per task before it shuffles."""
    w = W.partitionBy("column").orderBy(F.desc("n"), by_level())
    return counts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def frequency_table(table: Table, columns: list[str], limit: int = TOP_LEVELS) -> DataFrame:
    """Leading levels with their share, and how many levels and values the column has."""
    counts = level_counts(table, columns)
    totals = counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique"), F.sum("n").alias("valid"))
    return (
        top_levels(counts, limit).join(totals, "column")
        .select("column", "place", F.col("level").alias("value"), F.col("n").alias("count"),
                V.coverage_pct(F.col("n"), F.col("valid")).alias("percentage"), "unique", "valid")
    )


def categorical_role(unique: Column, valid: Column) -> Column:
    ratio = F.try_divide(unique, valid)
    return (
        F.when(valid == 0, "empty")
        .when((unique == valid) & (valid > 1), "identifier")
        .when((ratio >= IDENTIFIER_RATIO) & (valid >= IDENTIFIER_MIN), "identifier")
        .when((unique <= CATEGORY_LEVELS) & (ratio <= CATEGORY_RATIO), "category")
        .otherwise("high-cardinality text")
    )


def categorical_summary(table: Table, columns: list[str]) -> DataFrame:
    """valid, unique, role and the leading levels of each column, one row per column."""
    counts = level_counts(table, columns)
    totals = counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique"), F.sum("n").alias("valid"))
    top = top_levels(counts).groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("place", F.col("level").alias("value"), F.col("n").alias("count"))))
        .alias("top"))
    out = totals.join(top, "column")
    return out.select(
        "column", "valid", "unique", categorical_role(F.col("unique"), F.col("valid")).alias("role"),
        F.transform("top", lambda t: F.struct(
            t.value.alias("value"), t["count"].alias("count"),
            V.coverage_pct(t["count"], F.col("valid")).alias("percentage"))).alias("top"),
    )


class Profile:
    """Column facts of one table, each kind computed once and kept as one record per column."""

    def __init__(self, table: Table):
        self.table = table

    @cached_property
    def numeric(self) -> list[str]:
        return self.table.of_type("numeric")

    # -- numeric facts ------------------------------------------------------

    @cached_property
    def quantiles(self) -> dict[str, dict[str, float]]:
        facts = self.table.facts
        return quantiles(
            self.table.readings,
            {c: facts[c].numbers for c in self.numeric},
            {c: self.table.distinct_bound(c) for c in self.numeric},
            QUANTILES,
        )

    def fences(self, column: str) -> tuple[float, float] | None:
        """The exact IQR fences, or None where the check does not apply."""
        q = self.quantiles.get(column)
        if q is None or self.table.facts[column].numbers < OUTLIER_MIN_VALUES or q["q3"] == q["q1"]:
            return None
        reach = FENCE_REACH * (q["q3"] - q["q1"])
        return q["q1"] - reach, q["q3"] + reach

    def unchecked_reason(self, column: str) -> str | None:
        if self.fences(column) is not None:
            return None
        few = self.table.facts[column].numbers < OUTLIER_MIN_VALUES
        return f"needs {OUTLIER_MIN_VALUES} values" if few else "zero interquartile range"

    @cached_property
    def tails(self) -> dict[str, dict]:
        """Counts beyond the fences and the range between them, one scan for all columns."""
        checked = [c for c in self.numeric if self.fences(c)]
        if not checked:
            return {}
        aggregates = []
        for i, c in enumerate(checked):
            low, high = (F.lit(f) for f in self.fences(c))
            inside = F.when((_n(c) >= low) & (_n(c) <= high), _n(c))
            aggregates += [
                F.count_if(_n(c) < low).alias(f"below{i}"), F.count_if(_n(c) > high).alias(f"above{i}"),
                F.min(inside).alias(f"min{i}"), F.max(inside).alias(f"max{i}"), F.count(inside).alias(f"n{i}"),
            ]
        row = self.table.readings.agg(*aggregates).first()
        return {
            c: {k: row[f"{k}{i}"] for k in ("below", "above", "min", "max", "n")} for i, c in enumerate(checked)
        }

    def outlier_count(self, column: str) -> int:
        tail = self.tails.get(column)
        return tail["below"] + tail["above"] if tail else 0

    def _numeric_records(self) -> DataFrame:
        rows = []
        for c in self.numeric:
            f, q, fence = self.table.facts[c], self.quantiles[c], self.fences(c)
            rows.append((
                f.position, c, f.row_count, f.missing, f.present - f.numbers, f.numbers,
                f.min, f.max, f.mean, f.std_pop, f.var_samp, *[q[k] for k in QUANTILES],
                fence[0] if fence else None, fence[1] if fence else None, fence is not None,
                self.unchecked_reason(c), self.outlier_count(c), list(f.formats),
            ))
        names = ["min", "max", "mean", "std_pop", "var_samp", *QUANTILES, "low", "high"]
        schema = (
            "position int, column string, row_count long, missing long, invalid long, valid long, "
            + ", ".join(f"{n} double" for n in names)
            + ", outliers_applied boolean, outliers_reason string, outliers long, formats array<string>"
        )
        return self.table.spark.createDataFrame(rows, schema)

    def numeric_summary(self) -> DataFrame:
        """Count, coverage, range, mean, population std, quantiles, fences and interval per column."""
        rounded = ["min", "max", "mean", *QUANTILES]
        records = self._numeric_records()
        return records.select(
            "position", "column", "row_count", "valid", "missing", "invalid",
            V.coverage_pct(F.col("valid"), F.col("row_count")).alias("coverage"),
            *[V.round_sig(F.col(c)).alias(c) for c in rounded],
            V.round_sig(F.col("std_pop")).alias("std"),
            V.round_sig(F.col("low")).alias("lower_fence"), V.round_sig(F.col("high")).alias("upper_fence"),
            "outliers_applied", "outliers_reason", "outliers", "formats",
            mean_interval(F.col("valid"), F.col("mean"), F.col("var_samp")).alias("mean_ci"),
        )

    def outlier_rows(self, columns: list[str] | None = None, limit: int = OUTLIER_ROWS) -> DataFrame:
        """The flagged rows, farthest beyond the fence first, ties by row."""
        order = self.table.order_column()
        flagged = []
        for c in columns or self.numeric:
            if self.fences(c):
                low, high = (F.lit(f) for f in self.fences(c))
                x = _n(c)
                beyond = F.when(x < low, low - x).when(x > high, x - high)
                flagged.append(F.struct(
                    F.lit(c).alias("column"), x.alias("value"), F.when(x < low, "below").otherwise("above").alias("side"),
                    V.round_sig(beyond).alias("beyond"), beyond.isNotNull().alias("flagged")))
        if not flagged:
            return self.table.spark.createDataFrame(
                [], "column string, row long, value double, side string, beyond double, place int")
        rows = self.table.numbers(columns or self.numeric, order.cast("long").alias("_row"))
        long = rows.select(F.col("_row").alias("row"), F.inline(F.filter(F.array(*flagged), lambda f: f.flagged)))
        w = W.partitionBy("column").orderBy(F.desc("beyond"), "row")
        return long.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).select(
            "column", "row", "value", "side", "beyond", "place")

    # -- histograms ---------------------------------------------------------

    def _bin_plan(self, column: str, tail_aware: bool) -> dict:
        f, tail = self.table.facts[column], self.tails.get(column)
        aware = bool(tail_aware and tail and tail["below"] + tail["above"] > 0)
        low, high, n = (tail["min"], tail["max"], tail["n"]) if aware else (f.min, f.max, f.numbers)
        bins = 1 if low == high else min(MAX_BINS, max(2, math.ceil(math.sqrt(n))))
        fence = self.fences(column) if aware else None
        if aware and low == high:
            fence = (low, high)
        return {"aware": aware, "low": low, "high": high, "bins": bins, "fence": fence, "tail": tail}

    def histogram(self, columns: list[str] | None = None, tail_aware: bool = True) -> DataFrame:
        """Equal-width bins; where outliers exist, bins inside the fences and one bin per tail."""
        columns = self.numeric if columns is None else columns
        indexed, frame = [], []
        for c in columns:
            plan = self._bin_plan(c, tail_aware)
            x, bins, low = _n(c), plan["bins"], plan["low"]
            width = (plan["high"] - low) / bins
            place = (F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1)) if width
                     else F.lit(0)).cast("int")
            method = "iqr-tail-aware" if plan["aware"] else "equal-width"
            if plan["aware"]:
                below, above = plan["fence"]
                place = F.when(x < F.lit(below), -1).when(x > F.lit(above), bins).otherwise(place)
                if plan["tail"]["below"]:
                    frame.append((c, -1, method, "low-tail", None, below))
                if plan["tail"]["above"]:
                    frame.append((c, bins, method, "high-tail", above, None))
            for i in range(bins):
                end = plan["high"] if i == bins - 1 else low + (i + 1) * width
                frame.append((c, i, method, "center", low + i * width, end))
            indexed.append(F.struct(F.lit(c).alias("column"), F.when(x.isNotNull(), place).alias("bin")))
        counts = (
            self.table.readings.select(F.inline(F.array(*indexed))).filter("bin IS NOT NULL")
            .groupBy("column", "bin").agg(F.count(F.lit(1)).alias("count"))
        )
        bins = self.table.spark.createDataFrame(
            frame, "column string, bin int, method string, kind string, start double, end double")
        # At most twelve bins per column on either side of this join.
        return bins.join(F.broadcast(counts), ["column", "bin"], "left").select(
            "column", "bin", "method", "kind", V.round_sig(F.col("start")).alias("start"),
            V.round_sig(F.col("end")).alias("end"), F.coalesce("count", F.lit(0)).alias("count"))

    # -- categorical facts --------------------------------------------------

    @cached_property
    def levels(self) -> dict:
        columns = self.table.of_type("categorical")
        if not columns:
            return {}
        return {row["column"]: row for row in categorical_summary(self.table, columns).collect()}

    def categories(self, at_least: int = 1) -> list[str]:
        """Columns whose role is category, in table order."""
        return [c for c in self.table.columns if c in self.levels
                and self.levels[c].role == "category" and self.levels[c].unique >= at_least]


def mean_interval(n: Column, mean: Column, variance: Column, confidence: float = 0.95) -> Column:
    """Student t interval for a mean from its count and sample variance; null under two values."""
    error = F.sqrt(variance / n)
    margin = S.student_critical(n - 1, confidence) * error
    return F.when(n >= 2, F.struct(
        F.lit(confidence).alias("confidence"), V.round_sig(mean - margin).alias("lower"),
        V.round_sig(mean + margin).alias("upper"), V.round_sig(margin).alias("margin"),
        V.round_sig(error).alias("standard_error"), (n - 1).alias("degrees_freedom"),
    ))


def compute_stats(profile: Profile) -> DataFrame:
    """Every column in table order with the facts its type calls for."""
    table = profile.table
    spark = table.spark
    base = spark.createDataFrame(
        [(f.position, c, f.stat_type, f.row_count, f.missing, f.present, f.numbers, f.dates)
         for c, f in table.facts.items()],
        "position int, column string, type string, row_count long, missing long, present long, numbers long, dates long")
    valid = (F.when(F.col("type") == "numeric", F.col("numbers")).when(F.col("type") == "date", F.col("dates"))
             .otherwise(F.col("present")))
    base = base.select(
        "position", "column", "type", "row_count", valid.alias("valid"), "missing",
        (F.col("present") - valid).alias("invalid"), V.coverage_pct(valid, F.col("row_count")).alias("coverage"))
    numeric = profile.numeric_summary().select(
        "column", "min", "max", "mean", "std", *QUANTILES, "lower_fence", "upper_fence", "outliers", "formats")
    levels = spark.createDataFrame(
        [(c, r.unique, r.role, r.top[0].value, r.top[0]["count"]) for c, r in profile.levels.items()],
        "column string, unique long, role string, leading_level string, leading_count long")
    dated = spark.createDataFrame(
        [(c, table.facts[c].earliest, table.facts[c].latest) for c in table.of_type("date")],
        "column string, earliest timestamp_ntz, latest timestamp_ntz")
    out = base
    for part in (numeric, levels, dated):
        out = out.join(F.broadcast(part), "column", "left")
    return out
