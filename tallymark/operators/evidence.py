"""Ranked evidence: what a table shows, each record with its n, coverage, strength and caveat.

Each family is one DataFrame with the same columns; the list is their union, ordered
by strength, size and claim.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import values as V
from .correlate import MIN_PAIRS, MIN_REPORTED, METHOD_GAP, SMALL_SAMPLE, correlate, pearson_of
from .ranks import average_ranks
from .infer import categorical_association, welch
from .profile import Profile
from .shifts import level_shift, ordered_series
from .table import settle
from .timeline import SHOWN_GAPS, SHOWN_PERIODS, Timeline

# --- fixed values -----------------------------------------------------------
MAX_EVIDENCE = 20
TARGET_MIN_REPORTED, TARGET_LIMIT = 0.1, 30
MIN_GROUP, MAX_GROUPS, SMALL_GROUP = 3, 6, 8
MIN_GROUP_EFFECT, MIN_MISSING_EFFECT = 0.2, 0.3
ASSOCIATION_COLUMNS, MIN_ASSOCIATION = 12, 0.1
SHARE_MIN_VALUES, SHARE_MIN_COVERAGE, SHARE_MIN = 8, 25, 20
DATED_MIN = 6
OUTLIER_COLUMNS, OUTLIER_SHARE = 3, 0.05
SCHEMA = (
    "claim string, metric string, value double, value_text string, columns array<string>, method string, "
    "sample_size long, coverage double, strength string, caveat string, statistics map<string,double>, "
    "context array<string>, grain string"
)
UNADJUSTED = "exploratory pairwise test; p-value is not adjusted for multiple comparisons"
SHIFT_CAVEAT = (
    "exploratory candidate selected after scanning possible splits; the reported Welch interval and "
    "p-value are unadjusted and require confirmation"
)
# ----------------------------------------------------------------------------


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _num(c: Column) -> Column:
    return V.number_text(c.cast("double"))


def _signed(c: Column) -> Column:
    return F.concat(F.when(c >= 0, "+").otherwise(""), _num(c))


def _stats(**values: Column) -> Column:
    pairs = [x for name, c in values.items() for x in (F.lit(name), c.cast("double"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def evidence_record(
    df: DataFrame, *, claim, metric, columns, method, sample_size, coverage, strength, value=None, value_text=None,
    caveat=None, statistics=None, context=None, grain=None,
) -> DataFrame:
    """One evidence row per row of ``df``, in the common shape."""
    def c(x, cast):
        return (F.lit(x) if x is None or isinstance(x, str) else x).cast(cast)

    named = F.array(*[F.lit(x) if isinstance(x, str) else x for x in columns])
    return df.select(
        c(claim, "string").alias("claim"), c(metric, "string").alias("metric"), c(value, "double").alias("value"),
        c(value_text, "string").alias("value_text"), named.alias("columns"), c(method, "string").alias("method"),
        c(sample_size, "long").alias("sample_size"), c(coverage, "double").alias("coverage"),
        c(strength, "string").alias("strength"), c(caveat, "string").alias("caveat"),
        c(statistics, "map<string,double>").alias("statistics"), c(context, "array<string>").alias("context"),
        c(grain, "string").alias("grain"))


def rank_evidence(evidence: DataFrame, limit: int | None = MAX_EVIDENCE) -> DataFrame:
    """Strength, then size (records without a number last), then claim."""
    ranked = evidence.orderBy(
        V.strength_rank(F.col("strength")), F.abs("value").desc_nulls_last(), F.collate("claim", "UNICODE"))
    return ranked if limit is None else ranked.limit(limit)


def pooled_effect(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> Column:
    """Standardised difference over pooled population variance; null without spread."""
    pooled = F.sqrt((n1 * v1 + n2 * v2) / (n1 + n2))
    return F.when(pooled != 0, (m1 - m2) / pooled)


@dataclass(frozen=True)
class Limits:
    """What a report shows; None shows all. Everything is computed either way, and cut only where it is reported."""

    groups: int | None = MAX_GROUPS
    association_columns: int | None = ASSOCIATION_COLUMNS
    outlier_columns: int | None = OUTLIER_COLUMNS
    evidence: int | None = MAX_EVIDENCE


ALL = Limits(None, None, None, None)


class Evidence:
    def __init__(self, profile: Profile, target: str | None = None, limits: Limits = Limits()):
        self.profile, self.table, self.target, self.limits = profile, profile.table, target, limits
        self.spark, self.row_count = self.table.spark, self.table.row_count

    def none(self) -> DataFrame:
        return self.spark.createDataFrame([], SCHEMA)

    @property
    def numeric_target(self) -> bool:
        return self.target in self.profile.numeric

    def _coverage(self, n: Column) -> Column:
        return V.coverage_pct(n, F.lit(self.row_count))

    # -- correlations -------------------------------------------------------

    def correlations(self) -> DataFrame:
        options = {"min_reported": TARGET_MIN_REPORTED, "limit": TARGET_LIMIT} if self.target else {}
        found = correlate(self.table, self.profile.numeric, touching=self.target, **options)
        r = F.col("coefficient")
        return evidence_record(
            found,
            claim=_text(F.col("a"), " and ", F.col("b"), " ",
                        F.when(r > 0, "rise together").otherwise("move in opposite directions"),
                        " (", F.col("method"), " ", _signed(r), ")"),
            metric=F.when(F.col("method") == "pearson", "pearson_r").otherwise("spearman_rho"),
            value=r, columns=[F.col("a"), F.col("b")],
            method=_text(F.col("method"), " correlation, pairwise-complete observations"),
            sample_size=F.col("n"), coverage=F.col("coverage"), strength=F.col("strength"), caveat=F.col("caveat"))

    # -- target by group and by missingness ---------------------------------

    def group_stats(self) -> DataFrame:
        """Count, mean and both variances of the target for every level of each category, and the level's place by rows."""
        columns = [c for c in self.profile.categories() if c != self.target]
        cells = F.array(*[F.struct(F.lit(c).alias("column"), self.table.level(c).alias("level")) for c in columns])
        rows = self.table.df.select(self.table.number(self.target).alias("y"), F.inline(cells)).filter("level IS NOT NULL")
        stats = rows.groupBy("column", "level").agg(
            F.count(F.lit(1)).alias("rows"), F.count("y").alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("var_pop"),
            F.var_samp("y").alias("var_samp"))
        # A category has at most 25 levels.
        w = W.partitionBy("column").orderBy(F.desc("rows"), F.collate("level", "UNICODE"))
        return stats.withColumn("level_place", F.row_number().over(w)).filter(F.col("n") >= MIN_GROUP)

    def group_differences(self) -> DataFrame:
        columns = [c for c in self.profile.categories() if c != self.target]
        if not self.numeric_target or not columns:
            return self.none()
        w = W.partitionBy("column").orderBy(F.desc("mean"), F.collate("level", "UNICODE"))
        group = F.struct("level", "n", "mean", "var_pop", "var_samp")
        shown = self.group_stats()
        if self.limits.groups is not None:
            shown = shown.filter(F.col("level_place") <= self.limits.groups)
        ends = (
            shown.withColumn("place", F.row_number().over(w)).groupBy("column").agg(
                F.min_by(group, "place").alias("top"), F.max_by(group, "place").alias("bottom"),
                F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"),
                F.transform(F.array_sort(F.collect_list(F.struct("place", "level"))), lambda x: x.level).alias("levels"))
            .filter("groups >= 2")
        )
        top, bottom = F.col("top"), F.col("bottom")
        d = pooled_effect(top.n, top["mean"], top.var_pop, bottom.n, bottom["mean"], bottom.var_pop)
        found = ends.withColumn("d", d).filter(F.abs("d") >= MIN_GROUP_EFFECT).withColumn(
            "w", welch(bottom.n, bottom["mean"], bottom.var_samp, top.n, top["mean"], top.var_samp))
        small = (top.n <= SMALL_GROUP) | (bottom.n <= SMALL_GROUP)
        t, c = self.target, F.col("column")
        return evidence_record(
            found,
            claim=_text(f"{t} averages ", _num(V.round_sig(top["mean"], 2)), " for ", c, "=", top.level, " vs ",
                        _num(V.round_sig(bottom["mean"], 2)), " for ", c, "=", bottom.level),
            metric="group_mean_difference", value=V.round_sig(F.col("d"), 3), columns=[t, c],
            method=_text("group means over ", F.col("groups"),
                         " levels, standardized difference (Cohen's d) between extremes"),
            sample_size=F.col("n"), coverage=self._coverage(F.col("n")), strength=V.effect_strength(F.col("d")),
            caveat=F.when(small, _text("small groups (", bottom.n, " and ", top.n, " observations)")),
            statistics=_stats(
                effect_size=V.round_sig(F.col("d")), difference=F.col("w.difference"), t=F.col("w.t"),
                degrees_freedom=F.col("w.degrees_freedom"), p_value=F.col("w.p_value"),
                ci_lower=F.col("w.ci_lower"), ci_upper=F.col("w.ci_upper")),
            context=F.col("levels"))

    def missingness_stats(self) -> DataFrame:
        """Target moments where each other column is missing against present, one scan."""
        structs = []
        for c in self.table.columns:
            if c == self.target:
                continue
            gone, there = (F.when(m, F.col("_y")) for m in (F.col(V.quoted(c)), ~F.col(V.quoted(c))))
            structs.append(F.struct(
                F.lit(c).alias("column"),
                F.count(gone).alias("n1"), F.avg(gone).alias("m1"), F.var_pop(gone).alias("v1"),
                F.count(there).alias("n2"), F.avg(there).alias("m2"), F.var_pop(there).alias("v2")))
        flags = self.table.df.select(
            self.table.number(self.target).alias("_y"),
            *[self.table.missing(c).alias(c) for c in self.table.columns if c != self.target])
        return flags.agg(F.array(*structs).alias("s")).select(F.inline("s"))

    def missingness_impact(self) -> DataFrame:
        gaps = any(f.missing >= MIN_GROUP for c, f in self.table.facts.items() if c != self.target)
        if not self.numeric_target or not gaps:
            return self.none()
        n1, n2 = F.col("n1"), F.col("n2")
        found = (
            self.missingness_stats().filter((n1 >= MIN_GROUP) & (n2 >= MIN_GROUP))
            .withColumn("d", pooled_effect(n1, F.col("m1"), F.col("v1"), n2, F.col("m2"), F.col("v2")))
            .filter(F.abs("d") >= MIN_MISSING_EFFECT)
        )
        c = F.col("column")
        return evidence_record(
            found,
            claim=_text("rows missing ", c, " average ", _num(V.round_sig(F.col("m1"), 2)), f" {self.target}, vs ",
                        _num(V.round_sig(F.col("m2"), 2)), " when ", c, " is present"),
            metric="missingness_mean_difference", value=V.round_sig(F.col("d"), 3), columns=[self.target, c],
            method="mean comparison between missing/present partitions, standardized difference",
            sample_size=n1 + n2, coverage=self._coverage(n1 + n2), strength=V.effect_strength(F.col("d")),
            caveat=_text("missingness may be structural rather than causal; ", n1, " rows lack ", c))

    # -- categories ---------------------------------------------------------

    def association_pairs(self) -> list[tuple[str, str]]:
        columns = self.profile.categories(at_least=2)
        if self.target in columns:
            columns = [self.target, *[c for c in columns if c != self.target]]
        return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]
                if self.target is None or self.target in (a, b)]

    def associations(self) -> DataFrame:
        pairs = self.association_pairs()
        if not pairs:
            return self.none()
        columns = list(dict.fromkeys(c for pair in pairs for c in pair))[: self.limits.association_columns]
        found = categorical_association(self.table, pairs).filter(
            (F.col("cramers_v") >= MIN_ASSOCIATION) & F.col("a").isin(columns) & F.col("b").isin(columns))
        v = F.col("cramers_v")
        strength = V.association_strength(v)
        caveat = F.concat_ws(
            "; ", F.lit(UNADJUSTED),
            F.when(F.col("sparse"), _text("sparse contingency table (minimum expected count ",
                                          _num(F.col("expected_min")), ")")),
            F.when(F.col("p_value") >= 0.05, F.lit(
                "not statistically distinguishable from independence at the 5% level")))
        return evidence_record(
            found,
            claim=_text(F.col("a"), " and ", F.col("b"), " have ", strength,
                        " categorical association (Cramér's V ", _num(v), ")"),
            metric="cramers_v", value=v, columns=[F.col("a"), F.col("b")],
            method="chi-square contingency test with Cramér's V effect size", sample_size=F.col("n"),
            coverage=self._coverage(F.col("n")), strength=strength, caveat=caveat,
            statistics=_stats(**{k: F.col(k) for k in ("chi_square", "degrees_freedom", "p_value", "cramers_v",
                                                       "expected_min", "row_levels", "column_levels")}))

    def category_shares(self) -> DataFrame:
        columns = [self.target] if self.target else self.table.columns
        rows = []
        for c in columns:
            if c in self.profile.categories():
                r = self.profile.levels[c]
                rows.append((c, r.top[0].value, r.top[0].percentage, r.valid, r.unique, self.table.facts[c].missing))
        found = self.spark.createDataFrame(
            rows, "column string, level string, share double, valid long, unique long, missing long")
        share, coverage = F.col("share"), self._coverage(F.col("valid"))
        found = found.filter(
            (F.col("valid") >= SHARE_MIN_VALUES) & (coverage >= SHARE_MIN_COVERAGE) & (share >= SHARE_MIN))
        base = F.when(share >= 60, "strong").when(share >= 35, "moderate").otherwise("weak")
        steps = F.when(coverage < 50, 2).when(coverage < 80, 1).otherwise(0)
        c, valid = F.col("column"), F.col("valid")
        return evidence_record(
            found,
            claim=_text(c, ' is dominated by "', F.col("level"), '" (', _num(share), "% of ", valid, " values across ",
                        F.col("unique"), " level", F.when(F.col("unique") == 1, "").otherwise("s"), ")"),
            metric="category_share", value=share, columns=[c], method="frequency count over non-missing values",
            sample_size=valid, coverage=coverage, strength=V.weaken(base, steps),
            caveat=F.when(F.col("missing") > 0, _text(
                F.col("missing"), f" of {self.row_count} rows have no ", c, ", so this describes ", _num(coverage),
                "% of the data")))

    # -- time ---------------------------------------------------------------

    @cached_property
    def date_column(self) -> str | None:
        facts = self.table.facts
        return next((c for c in self.table.of_type("date") if facts[c].dates >= DATED_MIN), None)

    @cached_property
    def timeline(self) -> Timeline:
        return Timeline(self.table, self.date_column)

    def volume_trend(self) -> DataFrame:
        if self.date_column is None:
            return self.none()
        line = self.timeline
        facts = line.summary().join(F.broadcast(line.trend()))
        gaps = line.gaps().agg(F.count(F.lit(1)).alias("gaps"))
        found = facts.join(F.broadcast(gaps)).filter(F.col("trend").isin("increasing", "decreasing"))
        grain = F.col("granularity")
        return evidence_record(
            found,
            claim=_text(f"activity by {self.date_column} is ", F.col("trend"), " across ",
                        F.least(F.col("periods"), F.lit(SHOWN_PERIODS)), " ", grain, " periods (",
                        F.col("earliest"), " to ", F.col("latest"), ")"),
            metric="period_volume_trend", value_text=F.col("trend"), columns=[self.date_column],
            method=_text("row counts bucketed by ", grain, ", first-third vs last-third comparison"),
            sample_size=F.col("valid"), coverage=F.col("coverage"), strength="moderate",
            caveat=F.when(F.col("gaps") > 0, _text(
                F.least("gaps", F.lit(SHOWN_GAPS)), " empty ", grain, " period(s) in the range")))

    def period_change(self) -> DataFrame:
        if self.date_column is None:
            return self.none()
        found = self.timeline.period_over_period().filter("change_pct IS NOT NULL")
        pct, both = F.col("change_pct"), F.col("current_count") + F.col("previous_count")
        return evidence_record(
            found,
            claim=_text(F.col("current"), " has ", F.col("current_count"), " rows vs ", F.col("previous_count"), " in ",
                        F.col("previous"), " (", _signed(pct), "%)"),
            metric="period_over_period_change", value=pct, columns=[self.date_column],
            method=_text("row counts for the two most recent ", F.col("granularity"), " periods"),
            sample_size=both, coverage=self._coverage(both),
            strength=F.when(F.abs(pct) >= 50, "strong").when(F.abs(pct) >= 20, "moderate").otherwise("weak"),
            caveat="the latest period may be incomplete",
            context=F.array("previous", "current"), grain=F.col("granularity"))

    @cached_property
    def series(self) -> DataFrame | None:
        """The target in time order, or None where there are too few dated values."""
        if self.date_column is None or not self.numeric_target:
            return None
        series = ordered_series(self.table, self.date_column, self.target)
        return series if series.limit(DATED_MIN).count() >= DATED_MIN else None

    def time_trend(self) -> DataFrame:
        if self.series is None:
            return self.none()
        place, value = F.col("position"), F.col("value")
        pairs = self.series.select("position", "value")
        found = pairs.agg(F.count(F.lit(1)).alias("n"), pearson_of(place.cast("double"), value).alias("p")).first()
        # Rows of one value share its rank, so the sum of their places is all that their products need.
        middle = (found.n - 1) / 2
        ranked = average_ranks(pairs.groupBy("value").agg(
            F.count(F.lit(1)).alias("n"), F.sum(place - F.lit(middle)).alias("places")), [], "value", "n")
        rank = F.col("rank") - F.lit((found.n + 1) / 2)
        spread = F.sqrt(F.sum(F.col("n") * rank * rank)) * math.sqrt(found.n * (found.n ** 2 - 1) / 12)
        found = ranked.agg(V.clamp(F.try_divide(F.sum(rank * F.col("places")), spread), -1.0, 1.0).alias("s")).select(
            F.lit(found.n).alias("n"), F.lit(found.p).cast("double").alias("p"), "s")
        p, s = F.col("p"), F.col("s")
        by_rank = p.isNull() | (s.isNotNull() & (F.abs(s) - F.abs(p) >= METHOD_GAP))
        r = F.when(by_rank, s).otherwise(p)
        method = F.when(by_rank, "spearman").otherwise("pearson")
        found = found.withColumn("r", r).withColumn("method", method).filter(
            (F.abs("r") >= MIN_REPORTED) & (F.col("n") >= MIN_PAIRS))
        caveat = F.nullif(F.concat_ws(
            "; ", F.when(F.col("n") <= SMALL_SAMPLE, _text("only ", F.col("n"), " paired observations")),
            F.when(F.abs(F.abs(s) - F.abs(p)) >= METHOD_GAP, F.lit(
                "Pearson and Spearman disagree, suggesting a non-linear or outlier-driven pattern"))), F.lit(""))
        shown = V.round_sig(F.col("r"))
        return evidence_record(
            found,
            claim=_text(f"{self.target} ", F.when(F.col("r") > 0, "increases").otherwise("decreases"),
                        f" over {self.date_column} (", F.col("method"), " ", _signed(shown), ")"),
            metric="target_time_trend", value=shown, columns=[self.target, self.date_column],
            method=_text(F.col("method"), f" correlation of {self.target} against chronological order"),
            sample_size=F.col("n"), coverage=self._coverage(F.col("n")),
            strength=V.correlation_strength(F.col("r")), caveat=caveat)

    def candidate_shift(self) -> DataFrame:
        if self.series is None:
            return self.none()
        found = level_shift(self.series)
        effect = F.col("robust_effect")
        return evidence_record(
            found,
            claim=_text(f"{self.target} has a candidate level shift near ", F.col("boundary"), " (median ",
                        _num(F.col("baseline_median")), " to ", _num(F.col("current_median")), ")"),
            metric="candidate_level_shift", value=effect, columns=[self.target, self.date_column],
            method="robust split scan using segment medians and global median absolute deviation",
            sample_size=F.col("n"), coverage=self._coverage(F.col("n")), strength=V.effect_strength(effect),
            caveat=SHIFT_CAVEAT,
            statistics=_stats(
                split_index=F.col("split_index"), score=F.col("score"), median_difference=F.col("median_difference"),
                p_value=F.col("inference.p_value"), t=F.col("inference.t"),
                ci_lower=F.col("inference.ci_lower"), ci_upper=F.col("inference.ci_upper")))

    # -- outliers -----------------------------------------------------------

    def outliers(self) -> DataFrame:
        order = list(self.table.columns)
        if self.target:
            order = [self.target, *[c for c in order if c != self.target]]
        rows = [
            (c, *self.profile.fences(c), self.profile.outlier_count(c), self.table.facts[c].numbers)
            for c in order if c in self.profile.numeric and self.profile.outlier_count(c)
        ][: self.limits.outlier_columns]
        found = self.spark.createDataFrame(rows, "column string, low double, high double, n long, valid long")
        c, n, valid = F.col("column"), F.col("n"), F.col("valid")
        return evidence_record(
            found,
            claim=_text(c, " has ", n, " value(s) outside the IQR fences (",
                        _num(V.round_sig(V.round_sig(F.col("low")), 2)), " to ",
                        _num(V.round_sig(V.round_sig(F.col("high")), 2)), ")"),
            metric="iqr_outliers", value=n, columns=[c], method="interquartile-range fences at 1.5×IQR",
            sample_size=valid, coverage=self._coverage(valid),
            strength=F.when(n / valid >= OUTLIER_SHARE, "moderate").otherwise("weak"),
            caveat="outliers may be data errors or genuine extremes; inspect before removing")

    # -- all together -------------------------------------------------------

    FAMILIES = (
        "correlations", "group_differences", "missingness_impact", "associations", "category_shares",
        "volume_trend", "period_change", "time_trend", "candidate_shift", "outliers",
    )

    def build(self) -> DataFrame:
        # Each family is at most a few dozen records by now.
        parts = [settle(getattr(self, family)()) for family in self.FAMILIES]
        return rank_evidence(reduce(DataFrame.unionByName, parts), self.limits.evidence)
