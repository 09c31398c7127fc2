"""Baseline against current: schema, column deltas, tests, and ranked findings."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import values as V
from .infer import ks_two_sample, welch
from .profile import QUANTILES, Profile
from .quality import Quality
from .table import settle

# --- fixed values -----------------------------------------------------------
ROW_CHANGE, HEALTH_CHANGE, HEALTH_HIGH, COMPLETENESS_CHANGE = 10, 5, 15, 5
MEAN_CHANGE, MEAN_MIN_VALUES = 10, 3
KS_MATERIAL = 0.2
SHIFT_STRIPS = 6
SEVERITIES = ("high", "medium", "low", "neutral")
FINDING = "severity string, title string, detail string, metric string, columns array<string>"
# ----------------------------------------------------------------------------


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _num(c: Column) -> Column:
    return V.number_text(c.cast("double"))


class Comparison:
    def __init__(self, baseline: Profile, current: Profile):
        self.baseline, self.current = baseline, current
        self.spark = baseline.table.spark

    @property
    def shared(self) -> list[str]:
        return [c for c in self.baseline.table.columns if c in self.current.table.columns]

    def _same_type(self, stat_type: str) -> list[str]:
        a, b = self.baseline.table.facts, self.current.table.facts
        return [c for c in self.shared if a[c].stat_type == b[c].stat_type == stat_type]

    def schema_diff(self) -> DataFrame:
        """Every column of either side: shared, added or removed, and both types."""
        def side(profile: Profile, name: str) -> DataFrame:
            facts = profile.table.facts
            return self.spark.createDataFrame(
                [(c, f.position, f.stat_type) for c, f in facts.items()],
                f"column string, {name}_position int, {name}_type string")

        both = side(self.baseline, "baseline").join(side(self.current, "current"), "column", "full")
        b, c = F.col("baseline_type"), F.col("current_type")
        return both.select(
            "column", "baseline_position", "current_position", "baseline_type", "current_type",
            F.when(b.isNull(), "added").when(c.isNull(), "removed").otherwise("shared").alias("status"),
            F.coalesce(b != c, F.lit(False)).alias("type_changed"))

    # -- per column ---------------------------------------------------------

    def _numeric_records(self) -> DataFrame:
        columns = self._same_type("numeric")
        rows = []
        for i, c in enumerate(columns):
            a, b = self.baseline.table.facts[c], self.current.table.facts[c]
            rows.append((i, c, a.numbers, a.row_count, a.mean, a.var_samp, self.baseline.quantiles[c]["median"],
                         b.numbers, b.row_count, b.mean, b.var_samp, self.current.quantiles[c]["median"]))
        side = "{0}_valid long, {0}_rows long, {0}_mean double, {0}_var double, {0}_median double"
        return self.spark.createDataFrame(
            rows, f"place int, column string, {side.format('baseline')}, {side.format('current')}")

    def mean_shift(self) -> DataFrame:
        """Welch test per shared numeric column, from the moments both profiles already hold."""
        test = welch(*[F.col(f"{s}_{m}") for s in ("baseline", "current") for m in ("valid", "mean", "var")])
        return self._numeric_records().select("place", "column", test.alias("welch"))

    @cached_property
    def shifts(self) -> DataFrame:
        return settle(self.distribution_shift())

    def distribution_shift(self) -> DataFrame:
        """Two-sample KS per shared numeric column, all columns in one pass over both tables."""
        columns = self._same_type("numeric")
        if not columns:
            return self.spark.createDataFrame(
                [], "column string, baseline_n long, current_n long, statistic double, p_value double, "
                    "significant boolean, method string")

        def values(profile: Profile, current: bool) -> DataFrame:
            numbers = profile.table.readings
            cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(V.quoted(c)).alias("value")) for c in columns])
            return numbers.select(F.inline(cells)).withColumn("current", F.lit(current))

        both = values(self.baseline, False).unionByName(values(self.current, True))
        return ks_two_sample(both, ["column"])

    def numeric_deltas(self) -> DataFrame:
        r = self._numeric_records()
        mean = [V.round_sig(F.col(f"{s}_mean")) for s in ("current", "baseline")]
        median = [V.round_sig(F.col(f"{s}_median")) for s in ("current", "baseline")]
        cover = [V.coverage_pct(F.col(f"{s}_valid"), F.col(f"{s}_rows")) for s in ("current", "baseline")]
        return r.select(
            "place", "column", "baseline_valid", "current_valid", mean[1].alias("baseline_mean"),
            mean[0].alias("current_mean"), V.delta(*cover).alias("coverage_delta"), V.delta(*mean).alias("mean_delta"),
            V.delta_pct(*mean).alias("mean_pct"), V.delta(*median).alias("median_delta"))

    def categorical_deltas(self) -> DataFrame:
        rows = []
        for i, c in enumerate(self._same_type("categorical")):
            a, b = self.baseline.levels[c], self.current.levels[c]
            rows.append((
                i, c, a.valid, self.baseline.table.facts[c].row_count, a.unique, a.top[0].value, a.top[0].percentage,
                b.valid, self.current.table.facts[c].row_count, b.unique, b.top[0].value, b.top[0].percentage))
        side = "{0}_valid long, {0}_rows long, {0}_unique long, {0}_leader string, {0}_share double"
        frame = self.spark.createDataFrame(
            rows, f"place int, column string, {side.format('baseline')}, {side.format('current')}")
        same = F.col("baseline_leader") == F.col("current_leader")
        cover = [V.coverage_pct(F.col(f"{s}_valid"), F.col(f"{s}_rows")) for s in ("current", "baseline")]
        return frame.select(
            "place", "column", V.delta(*cover).alias("coverage_delta"),
            (F.col("current_unique") - F.col("baseline_unique")).alias("unique_delta"),
            F.when(same, V.delta(F.col("current_share"), F.col("baseline_share"))).alias("top_share_delta"),
            (~same).alias("dominant_changed"), "baseline_leader", "baseline_share", "current_leader", "current_share")

    def column_delta(self) -> DataFrame:
        """Coverage, mean, median, unique and leading-share deltas of shared columns of one type."""
        null = F.lit(None)
        numeric = self.numeric_deltas().select(
            "column", F.lit("numeric").alias("type"), "coverage_delta", "mean_delta", "mean_pct", "median_delta",
            null.cast("long").alias("unique_delta"), null.cast("double").alias("top_share_delta"),
            null.cast("boolean").alias("dominant_changed"))
        levels = self.categorical_deltas().select(
            "column", F.lit("categorical").alias("type"), "coverage_delta",
            *[null.cast("double").alias(c) for c in ("mean_delta", "mean_pct", "median_delta")],
            "unique_delta", "top_share_delta", "dominant_changed")
        return numeric.unionByName(levels)

    # -- whole tables -------------------------------------------------------

    @cached_property
    def _summaries(self):
        return tuple(Quality(p).summary().first() for p in (self.baseline, self.current))

    def summary(self) -> DataFrame:
        """Rows, health and completeness of both sides with their deltas, as one row."""
        a, b = self._summaries
        frame = self.spark.createDataFrame(
            [(a.row_count, b.row_count, a.health_score, b.health_score, a.completeness, b.completeness,
              a.duplicate_rows, b.duplicate_rows, a.column_count, b.column_count, len(self.shared))],
            "baseline_rows long, current_rows long, baseline_health int, current_health int, "
            "baseline_completeness double, current_completeness double, baseline_duplicates long, "
            "current_duplicates long, baseline_columns long, current_columns long, shared_columns int")
        pair = {k: (F.col(f"current_{k}"), F.col(f"baseline_{k}"))
                for k in ("rows", "health", "completeness", "duplicates", "columns")}
        return frame.select(
            "*", (pair["rows"][0] - pair["rows"][1]).alias("row_delta"), V.delta_pct(*pair["rows"]).alias("row_pct"),
            (pair["health"][0] - pair["health"][1]).alias("health_delta"),
            V.delta(*pair["completeness"]).alias("completeness_delta"),
            (pair["duplicates"][0] - pair["duplicates"][1]).alias("duplicate_delta"),
            (pair["columns"][0] - pair["columns"][1]).alias("column_delta"))

    def findings(self) -> DataFrame:
        """What changed past its threshold, by severity and title; a neutral record if nothing did."""
        spark = self.spark

        def found(df, condition, severity, title, detail, metric, columns=None):
            return df.filter(condition).select(
                (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"),
                title.alias("title"), detail.alias("detail"), F.lit(metric).alias("metric"),
                (F.array(columns) if columns is not None else F.array().cast("array<string>")).alias("columns"))

        schema = settle(self.schema_diff())

        def listed(condition, order, each, metric, severity, word):
            names = schema.filter(condition).agg(
                F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("column"), each.alias("e")))).alias("s"))
            n = F.size("s")
            title = _text(n.cast("string"), *word(n))
            return names.filter(n > 0).select(
                F.lit(severity).alias("severity"), title.alias("title"),
                F.array_join(F.transform("s", lambda s: s.e), "; " if metric == "schema.type" else ", ").alias("detail"),
                F.lit(metric).alias("metric"), F.transform("s", lambda s: s.column).alias("columns"))

        change = _text(F.col("column"), ": ", F.col("baseline_type"), " to ", F.col("current_type"))
        plural = lambda one, many: lambda n: (F.when(n == 1, one).otherwise(many),)
        parts = [
            listed(F.col("type_changed"), "baseline_position", change, "schema.type", "high",
                   plural(" shared column changed type", " shared columns changed type")),
            listed(F.col("status") == "added", "current_position", F.col("column"), "schema.added", "medium",
                   plural(" column added", " columns added")),
            listed(F.col("status") == "removed", "baseline_position", F.col("column"), "schema.removed", "medium",
                   plural(" column removed", " columns removed")),
        ]
        s, pct = settle(self.summary()), F.col("row_pct")
        moved = lambda c, up, down: F.when(c > 0, up).otherwise(down)
        health, complete = F.col("health_delta"), F.col("completeness_delta")
        parts += [
            found(s, F.abs(pct) >= ROW_CHANGE, "medium",
                  _text("Row count ", moved(pct, "increased", "decreased"), " ", _num(F.abs(pct)), "%"),
                  _text(F.col("baseline_rows"), " to ", F.col("current_rows"), " rows."), "rows"),
            found(s, F.abs(health) >= HEALTH_CHANGE, F.when(F.abs(health) >= HEALTH_HIGH, "high").otherwise("medium"),
                  _text("Data health ", moved(health, "improved", "declined"), " ", F.abs(health), " points"),
                  _text(F.col("baseline_health"), "/100 to ", F.col("current_health"), "/100."), "quality.health"),
            found(s, F.abs(complete) >= COMPLETENESS_CHANGE, "medium",
                  _text("Completeness ", moved(complete, "improved", "declined"), " ", _num(F.abs(complete)), " points"),
                  _text(_num(F.col("baseline_completeness")), "% to ", _num(F.col("current_completeness")), "%."),
                  "quality.completeness"),
        ]
        c = F.col("column")
        # One row per shared numeric column.
        numeric = settle(self.numeric_deltas().join(F.broadcast(self.mean_shift().drop("place")), "column"))
        w, mean_pct = F.col("welch"), F.col("mean_pct")
        significant = F.coalesce(w.significant, F.lit(False))
        both = _text(_num(F.col("baseline_mean")), " to ", _num(F.col("current_mean")))
        parts += [
            found(numeric, significant, "medium", _text(c, " mean difference excludes zero at 95% confidence"),
                  _text(both, "; difference ", _num(w.difference), ", 95% CI ", _num(w.ci_lower), " to ",
                        _num(w.ci_upper), ", p=", _num(w.p_value), ". Exploratory and unadjusted across columns."),
                  "numeric.mean_shift", c),
            found(numeric, ~significant & (F.abs(mean_pct) >= MEAN_CHANGE)
                  & (F.col("baseline_valid") >= MEAN_MIN_VALUES) & (F.col("current_valid") >= MEAN_MIN_VALUES), "low",
                  _text(c, " mean ", moved(mean_pct, "increased", "decreased"), " ", _num(F.abs(mean_pct)), "%"),
                  _text(both, "; descriptive change, before significance testing."), "numeric.mean", c),
            found(self.shifts, F.col("significant") & (F.col("statistic") >= KS_MATERIAL), "medium",
                  _text(c, " distribution shifted"),
                  _text("Two-sample KS D=", _num(F.col("statistic")), ", p=", _num(F.col("p_value")),
                        ". This tests the full distribution and is exploratory and unadjusted across columns."),
                  "numeric.distribution_shift", c),
            found(settle(self.categorical_deltas()), F.col("dominant_changed"), "low",
                  _text(c, " has a new leading category"),
                  _text(F.col("baseline_leader"), " (", _num(F.col("baseline_share")), "%) to ",
                        F.col("current_leader"), " (", _num(F.col("current_share")), "%)."),
                  "categorical.dominant", c),
        ]
        every = settle(reduce(DataFrame.unionByName, parts))
        stable = spark.createDataFrame(
            [("neutral", "No material descriptive changes detected",
              "Schema, quality, and shared-column summaries stayed within the reporting thresholds.", "stable", [])],
            FINDING)
        any_found = every.agg(F.count(F.lit(1)).alias("n"))
        neutral = stable.join(F.broadcast(any_found)).filter("n = 0").drop("n")
        rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
        return every.unionByName(neutral).orderBy(rank, F.collate("title", "UNICODE"))

    def shift_strips(self, limit: int = SHIFT_STRIPS) -> DataFrame:
        """Quantiles of both sides as 0-100 places on one shared scale, strongest shifts first."""
        columns = self._same_type("numeric")
        rows = []
        for i, c in enumerate(columns):
            a, b = self.baseline.table.facts[c], self.current.table.facts[c]
            qa, qb = self.baseline.quantiles[c], self.current.quantiles[c]
            rows.append((i, c, a.min, a.max, b.min, b.max, *[qa[k] for k in QUANTILES], *[qb[k] for k in QUANTILES]))
        names = [f"{s}_{k}" for s in ("baseline", "current") for k in QUANTILES]
        frame = self.spark.createDataFrame(
            rows, "place int, column string, a_min double, a_max double, b_min double, b_max double, "
                  + ", ".join(f"{n} double" for n in names))
        low = F.least(V.round_sig(F.col("a_min")), V.round_sig(F.col("b_min")))
        high = F.greatest(V.round_sig(F.col("a_max")), V.round_sig(F.col("b_max")))
        frame = frame.withColumn("low", low).withColumn("high", high)

        def at(name: str) -> Column:
            share = F.try_divide(V.round_sig(F.col(name)) - F.col("low"), F.col("high") - F.col("low")) * 100
            return V.clamp(share, 0.0, 100.0)

        # One row per shared numeric column on both sides.
        joined = frame.join(
            F.broadcast(self.shifts.select("column", "statistic", "significant")), "column", "left")
        return joined.orderBy(
            F.coalesce(F.col("significant"), F.lit(False)).desc(), F.coalesce("statistic", F.lit(0.0)).desc(), "place"
        ).limit(limit).select("column", "low", "high", "statistic", "significant", *[at(n).alias(n) for n in names])
