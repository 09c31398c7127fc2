"""Which rows stand behind each evidence record, and which were left out and why."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, functions as F

from ..functions import values as V
from .profile import Profile
from .ranks import order_statistics
from .table import (
    Table, date_reason, level_reason, numeric_reason, period_reason, present_reason,
)

# --- fixed values -----------------------------------------------------------
SOURCE_ROWS = 10
FORMULAS = {
    "pearson_r": "r = covariance(x, y) / (standard deviation(x) × standard deviation(y))",
    "spearman_rho": "ρ = Pearson correlation of the paired value ranks",
    "group_mean_difference": "d = (mean of highest group − mean of lowest group) / pooled standard deviation",
    "missingness_mean_difference":
        "d = (mean where comparison field is missing − mean where present) / pooled standard deviation",
    "category_share": "share = count of leading category / count of non-missing values × 100",
    "period_volume_trend": "compare mean row count in the first third of periods with the last third",
    "period_over_period_change":
        "change % = (current period count − previous period count) / previous period count × 100",
    "target_time_trend": "ρ = rank correlation between the numeric target and chronological row order",
    "iqr_outliers": "outlier when value < Q1 − 1.5 × IQR or value > Q3 + 1.5 × IQR",
    "cramers_v": "V = √(χ² / (n × min(rows − 1, columns − 1)))",
    "candidate_level_shift":
        "scan valid splits; compare segment medians and scale their difference by the global median absolute deviation",
}
#: What a row must be to stand behind a record: metric, whether only with a context, the rule, checks of columns by number.
RULES = (
    ("pearson_r", False, "Rows where {0} and {1} are both finite numbers", "numeric 0, numeric 1"),
    ("spearman_rho", False, "Rows where {0} and {1} are both finite numbers", "numeric 0, numeric 1"),
    ("cramers_v", False, "Rows where {0} and {1} are both non-missing", "present 0, present 1"),
    ("group_mean_difference", True, "Rows with a finite {0} in one of {size} retained {1} groups", "numeric 0, levels 1"),
    ("group_mean_difference", False, "Rows with a finite {0} and a non-missing {1} group", "numeric 0, present 1"),
    ("missingness_mean_difference", False,
     "Rows with a finite {0}; {1} is retained to define missing and present partitions", "numeric 0"),
    ("category_share", False, "Rows where {0} is non-missing", "present 0"),
    ("period_volume_trend", False, "Rows with a valid {0} date", "date 0"),
    ("period_over_period_change", True, "Rows in the two compared {grain} periods ({kept})", "date 0, periods 0"),
    ("period_over_period_change", False, "Rows with a valid {0} date", "date 0"),
    ("target_time_trend", False, "Rows with a finite {0} and valid {1} date", "numeric 0, date 1"),
    ("candidate_level_shift", False, "Rows with a finite {0} and valid {1} date", "numeric 0, date 1"),
    ("iqr_outliers", False, "Rows where {0} is a finite number; fences are computed over all included values", "numeric 0"),
)
ANY_OTHER = "Rows with non-missing values for {all}"
#: Reasons that a check can give.
REASONS = {
    "numeric": ("missing {0}", "non-numeric {0}"), "date": ("missing {0}", "invalid date {0}"), "present": ("missing {0}",),
    "levels": ("missing {0}", "{0} outside retained groups"), "periods": ("invalid date {0}", "{0} outside compared periods"),
}
# ----------------------------------------------------------------------------

# A check: its name, its column, the reasons it can give, and the reason column.
Check = tuple[tuple, list[str], Column]
_REASON_COLUMNS = {
    "numeric": lambda t, c, item: numeric_reason(t, c), "date": lambda t, c, item: date_reason(t, c),
    "present": lambda t, c, item: present_reason(t, c), "levels": lambda t, c, item: level_reason(t, c, list(item.context)),
    "periods": lambda t, c, item: period_reason(t, c, list(item.context), item.grain),
}


def requirement(table: Table, item: Row) -> tuple[str, list[Check]]:
    """The inclusion rule in words, and the checks a row must pass, as the first fitting row of ``RULES`` has them."""
    columns, context = list(item.columns), list(item.context or [])
    fitting = [(rule, names) for metric, with_context, rule, names in RULES
               if metric == item.metric and (context or not with_context)]
    rule, names = fitting[0] if fitting else (ANY_OTHER, ", ".join(f"present {k}" for k in range(len(columns))))
    words = {"size": len(context), "grain": item.grain, "kept": " and ".join(context), "all": " and ".join(columns)}
    checks = []
    for name, at in (one.split(" ") for one in names.split(", ")):
        column = columns[int(at)]
        key = (name, column, *(context if name in ("levels", "periods") else ()))
        checks.append((key, [r.format(column) for r in REASONS[name]], _REASON_COLUMNS[name](table, column, item)))
    return rule.format(columns[0], columns[-1], **words), checks


class Provenance:
    """Row accounting for a ranked list of evidence (at most twenty records)."""

    def __init__(self, profile: Profile, evidence: DataFrame):
        self.profile, self.table = profile, profile.table
        self.items = evidence.collect()
        self.rules = [requirement(self.table, item) for item in self.items]

    def _reasons(self, *extra: Column) -> DataFrame:
        """One reason column per distinct check, each evaluated once per row."""
        checks = {key: column for _, made in self.rules for key, _, column in made}
        self._names = {key: f"_r{i}" for i, key in enumerate(checks)}
        return self.table.df.select(*extra, *[c.alias(self._names[key]) for key, c in checks.items()])

    def _included(self, index: int) -> Column:
        keep = F.lit(True)
        for key, _, _ in self.rules[index][1]:
            keep &= F.col(self._names[key]).isNull()
        return keep

    def summary(self) -> DataFrame:
        """Rule, formula, row counts and reason counts per record, all from one scan.

        A row may count under several reasons, but once under each.
        """
        if not self.items:
            return self.table.spark.createDataFrame(
                [], "place int, claim string, metric string, formula string, inclusion_rule string, input_rows long, "
                    "included_rows long, excluded_rows long, exclusion_reasons array<struct<reason:string,count:long>>, "
                    "source_rows_policy string")
        reasons = self._reasons()
        structs = []
        for i, (item, (rule, made)) in enumerate(zip(self.items, self.rules)):
            texts = dict.fromkeys(text for _, found, _ in made for text in found)
            counted = []
            for text in texts:
                hit = F.lit(False)
                for key, found, _ in made:
                    if text in found:
                        hit |= F.coalesce(F.col(self._names[key]) == text, F.lit(False))
                counted.append(F.struct((-F.count_if(hit)).alias("order"), F.lit(text).alias("reason"),
                                        F.count_if(hit).alias("count")))
            listed = F.transform(
                F.filter(F.array_sort(F.array(*counted)), lambda r: r["count"] > 0),
                lambda r: F.struct(r.reason.alias("reason"), r["count"].alias("count")))
            flagged = item.metric == "iqr_outliers"
            structs.append(F.struct(
                F.lit(i + 1).alias("place"), F.lit(item.claim).alias("claim"), F.lit(item.metric).alias("metric"),
                F.lit(FORMULAS.get(item.metric, item.method)).alias("formula"), F.lit(rule).alias("inclusion_rule"),
                F.count(F.lit(1)).alias("input_rows"), F.count_if(self._included(i)).alias("included_rows"),
                F.count_if(~self._included(i)).alias("excluded_rows"), listed.alias("exclusion_reasons"),
                F.lit("Flagged outlier rows, capped at 10" if flagged else "Up to 10 evenly spaced included rows")
                .alias("source_rows_policy")))
        return reasons.agg(F.array(*structs).alias("s")).select(F.inline("s"))

    def source_rows(self, limit: int = SOURCE_ROWS) -> DataFrame:
        """Up to ten evenly spaced included rows per record, as cell texts; flagged rows for outliers.

        The places are found as order statistics of the row id, so nothing is sorted.
        """
        out_schema = "place int, row long, column string, value string"
        if not self.items:
            return self.table.spark.createDataFrame([], out_schema)
        order = self.table.order_column().cast("long")
        far = {}
        for item in self.items:
            if item.metric == "iqr_outliers":
                column, (low, high) = item.columns[0], self.profile.fences(item.columns[0])
                x = self.table.number(column)
                far[column] = ((x < F.lit(low)) | (x > F.lit(high))).alias(f"_far_{len(far)}")
        rows = self._reasons(order.alias("_row"), *far.values())
        far_name = {c: f"_far_{i}" for i, c in enumerate(far)}
        # Records that keep the same rows share one search.
        keeps: dict[tuple, tuple[str, Column]] = {}
        used = []
        for i, item in enumerate(self.items):
            keep = self._included(i)
            key = tuple(k for k, _, _ in self.rules[i][1])
            if item.metric == "iqr_outliers":
                keep &= F.col(far_name[item.columns[0]])
                key += ("far",)
            keeps.setdefault(key, (f"k{len(keeps)}", keep))
            used.append(keeps[key][0])
        kept = rows.select(*[F.when(keep, F.col("_row")).alias(name) for name, keep in keeps.values()])
        sizes = kept.agg(*[F.count(name).alias(name) for name, _ in keeps.values()]).first()
        places = {}
        for name, _ in keeps.values():
            n = sizes[name]
            spread = range(n) if n <= limit else [math.floor(i * (n - 1) / (limit - 1) + 0.5) for i in range(limit)]
            places[name] = (n, list(spread))
        found = order_statistics(kept, places)
        wanted = [
            (i + 1, int(row), column) for i, item in enumerate(self.items) for row in found[used[i]].values()
            for column in item.columns
        ]
        # At most ten rows and two columns per record.
        picked = self.table.spark.createDataFrame(wanted, "place int, row long, column string")
        columns = list(dict.fromkeys(c for item in self.items for c in item.columns))
        cells = F.array(*[
            F.struct(F.lit(c).alias("column"),
                     V.safe_cell(V.text_of(self.table.raw(c), self.table.types[c])).alias("value")) for c in columns
        ])
        ids = sorted({row for _, row, _ in wanted})
        source = self.table.df.filter(order.isin(ids)).select(order.alias("row"), F.inline(cells))
        return picked.join(F.broadcast(source), ["row", "column"]).select("place", "row", "column", "value")
