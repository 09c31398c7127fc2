"""Two-sample tests, associations and level shifts.

Nothing here is corrected for multiple tests; results say so where they are reported.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import distributions as S, values as V
from ..session import durable
from .comoments import matrix_rows, summed
from .ranks import beside_totals, running_before
from .table import Table

# --- fixed values -----------------------------------------------------------
KS_MIN = 4
CONTINGENCY_MIN = 4
SPARSE_EXPECTED = 5
KS_METHOD = "two-sample KS, asymptotic p-value"
WELCH_METHOD = "Welch two-sample t test"
# ----------------------------------------------------------------------------
# Levels of all coded columns together: a task holds a square of them.
CODED_LEVELS = 1000


def sample_summary(df: DataFrame, value: Column, *keys: str) -> DataFrame:
    """n, mean, sample variance and its root; the variance of one value is 0."""
    n = F.count(value)
    variance = F.when(n > 1, F.var_samp(value)).when(n == 1, 0.0)
    return df.groupBy(*keys).agg(
        n.alias("n"), F.avg(value).alias("mean"), variance.alias("variance"), F.sqrt(variance).alias("std"))


def welch(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column, confidence: float = 0.95) -> Column:
    """Welch comparison from counts, means and sample variances; second minus first.

    Null under two values a side; without any spread the record says it is untestable.
    """
    a, b = v1 / n1, v2 / n2
    error = F.sqrt(a + b)
    spread = error > 0
    df = F.when(spread, (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1))).otherwise(n1 + n2 - 2)
    difference = m2 - m1
    t = F.when(spread, F.try_divide(difference, error))
    p = F.when(spread, S.student_tail(t, df))
    margin = F.when(spread, S.student_critical(df, confidence) * error)
    return F.when((n1 >= 2) & (n2 >= 2), F.struct(
        n1.alias("baseline_n"), n2.alias("current_n"),
        V.round_sig(m1).alias("baseline_mean"), V.round_sig(m2).alias("current_mean"),
        V.round_sig(difference).alias("difference"), V.round_sig(error).alias("standard_error"),
        V.round_sig(t).alias("t"), V.round_sig(df.cast("double"), 2).alias("degrees_freedom"),
        V.round_sig(p, 6).alias("p_value"),
        V.round_sig(difference - margin).alias("ci_lower"), V.round_sig(difference + margin).alias("ci_upper"),
        F.coalesce(p < 1 - confidence, F.lit(False)).alias("significant"), spread.alias("testable"),
        F.lit(WELCH_METHOD).alias("method"),
    ))


def welch_test(df: DataFrame, value: Column, side: Column, *keys: str) -> DataFrame:
    """Welch test of ``value`` where ``side`` is true (current) against false (baseline)."""
    before, after = F.when(~side, value), F.when(side, value)
    moments = df.groupBy(*keys).agg(
        F.count(before).alias("n1"), F.avg(before).alias("m1"), F.var_samp(before).alias("v1"),
        F.count(after).alias("n2"), F.avg(after).alias("m2"), F.var_samp(after).alias("v2"))
    return moments.select(*keys, welch(*[F.col(c) for c in ("n1", "m1", "v1", "n2", "m2", "v2")]).alias("welch"))


def contingency(table: Table, pairs: list[tuple[str, str]]) -> DataFrame:
    """``a, b, left, right, n``: joint counts of all pairs in one scan.

    Columns with few levels are coded as unit vectors, and one product of matrices a batch holds the joint counts of all
    their pairs, so nothing moves but the sums of the tasks. Pairs with a column of many levels are counted by level.
    """
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    levels = _few_levels(table, columns)
    coded = [p for p in pairs if p[0] in levels and p[1] in levels]
    rest = [p for p in pairs if p not in set(coded)]
    parts = ([_coded_counts(table, coded, levels)] if coded else []) + ([_listed_counts(table, rest)] if rest else [])
    return reduce(DataFrame.unionByName, parts)


def _few_levels(table: Table, columns: list[str]) -> dict[str, list[str]]:
    """The levels of the columns with the fewest, while all of them together are at most ``CODED_LEVELS``."""
    distinct = durable(table.df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), table.level(c).alias("level")) for c in columns]))).filter("level IS NOT NULL").distinct())
    sizes = distinct.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()  # one record a column
    kept, total = [], 0
    for r in sorted(sizes, key=lambda r: (r.n, r.column)):
        total += r.n
        if total <= CODED_LEVELS:
            kept.append(r.column)
    found = distinct.filter(F.col("column").isin(kept)).groupBy("column").agg(F.sort_array(F.collect_set("level")).alias("levels"))
    out = {c: [] for c in columns if c not in {r.column for r in sizes}}
    return out | {r.column: r.levels for r in found.collect()}


def _coded_counts(table: Table, pairs: list[tuple[str, str]], levels: dict[str, list[str]]) -> DataFrame:
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    starts, names = {}, []
    for c in columns:
        starts[c] = len(names)
        names += levels[c]
    size = len(names)
    schema = "a string, b string, left string, right string, n long"
    if not size:
        return table.spark.createDataFrame([], schema)
    sets = [pa.array(levels[c], pa.string()) for c in columns]

    def run(batches):
        counts = np.zeros((size, size))
        for batch in batches:
            units = np.zeros((batch.num_rows, size))
            for k, c in enumerate(columns):
                at = pc.index_in(batch.column(k), value_set=sets[k]).fill_null(-1).to_numpy(zero_copy_only=False)
                rows = np.flatnonzero(at >= 0)
                units[rows, starts[c] + at[rows]] = 1.0
            counts += units.T @ units
        yield matrix_rows({"n": counts})

    n = summed(table.df.select(*[table.level(c).alias(f"l{k}") for k, c in enumerate(columns)]), run, ["n"], size, size)["n"]
    found = []
    for a, b in pairs:
        joint = n[starts[a]: starts[a] + len(levels[a]), starts[b]: starts[b] + len(levels[b])]
        found += [(a, b, levels[a][i], levels[b][k], int(joint[i, k])) for i, k in zip(*np.nonzero(joint))]
    return table.spark.createDataFrame(found, schema)


def _listed_counts(table: Table, pairs: list[tuple[str, str]]) -> DataFrame:
    cells = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), table.level(a).alias("left"), table.level(b).alias("right"))
        for a, b in pairs
    ])
    rows = table.df.select(F.inline(cells)).filter("left IS NOT NULL AND right IS NOT NULL")
    return rows.groupBy("a", "b", "left", "right").agg(F.count(F.lit(1)).alias("n"))


def chi_square(joint: DataFrame) -> DataFrame:
    """Chi-square, Cramér's V and the smallest expected count per pair, from joint counts.

    Summing over filled cells alone is exact: chi2 = n (sum o^2 / (row * column) - 1).
    """
    rows = joint.groupBy("a", "b", "left").agg(F.sum("n").alias("row_n"))
    columns = joint.groupBy("a", "b", "right").agg(F.sum("n").alias("column_n"))
    row_side = rows.groupBy("a", "b").agg(
        F.sum("row_n").alias("n"), F.count(F.lit(1)).alias("row_levels"), F.min("row_n").alias("min_row"))
    column_side = columns.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("column_levels"), F.min("column_n").alias("min_column"))
    ratio = joint.join(rows, ["a", "b", "left"]).join(columns, ["a", "b", "right"]).groupBy("a", "b").agg(
        F.sum(F.col("n").cast("double") * F.col("n") / (F.col("row_n").cast("double") * F.col("column_n"))).alias("ratio"))
    n, r, c = F.col("n"), F.col("row_levels"), F.col("column_levels")
    chi2 = F.greatest(F.lit(0.0), n * (F.col("ratio") - 1))
    df = (r - 1) * (c - 1)
    least = F.col("min_row").cast("double") * F.col("min_column") / n
    found = row_side.join(column_side, ["a", "b"]).join(ratio, ["a", "b"])
    return found.filter((n >= CONTINGENCY_MIN) & (r >= 2) & (c >= 2)).select(
        "a", "b", "n", r.alias("row_levels"), c.alias("column_levels"),
        V.round_sig(chi2).alias("chi_square"), df.alias("degrees_freedom"),
        V.round_sig(S.chi_square_tail(chi2, df), 6).alias("p_value"),
        V.round_sig(F.sqrt(chi2 / (n * F.least(r - 1, c - 1)))).alias("cramers_v"),
        V.round_sig(least).alias("expected_min"), (least < SPARSE_EXPECTED).alias("sparse"))


def categorical_association(table: Table, pairs: list[tuple[str, str]]) -> DataFrame:
    return chi_square(contingency(table, pairs))


def ks_two_sample(values: DataFrame, keys: list[str]) -> DataFrame:
    """Largest gap between the two running shares, per key.

    ``values`` holds ``keys, value, current`` (a boolean). Equal values are counted
    together first, so ties step both sides at once and a hot value is one row.
    """
    steps = values.filter("value IS NOT NULL").groupBy(*keys, "value").agg(
        F.count_if(~F.col("current")).alias("n_base"), F.count_if(F.col("current")).alias("n_cur"))
    run = running_before(steps, keys, ["value"], ["n_base", "n_cur"])
    totals = steps.groupBy(*keys).agg(F.sum("n_base").alias("baseline_n"), F.sum("n_cur").alias("current_n"))
    share = [
        (F.col(f"{s}_before") + F.col(s)) / F.col(t) for s, t in (("n_base", "baseline_n"), ("n_cur", "current_n"))
    ]
    enough = totals.filter((F.col("baseline_n") >= KS_MIN) & (F.col("current_n") >= KS_MIN))
    gap = beside_totals(run, enough, keys).groupBy(*keys, "baseline_n", "current_n").agg(F.max(F.abs(share[0] - share[1])).alias("d"))
    p = S.ks_tail(F.col("d"), F.col("baseline_n").cast("double"), F.col("current_n").cast("double"))
    return gap.select(
        *keys, "baseline_n", "current_n", V.round_sig(F.col("d")).alias("statistic"),
        V.round_sig(p, 6).alias("p_value"), ((p < 0.05) & (F.col("d") > 0)).alias("significant"),
        F.lit(KS_METHOD).alias("method"))
