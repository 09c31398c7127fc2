"""A small set of rows that characterise a table, each with the reasons it was picked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import dates as D
from ..session import durable
from .profile import Profile
from .ranks import order_statistics

# --- fixed values -----------------------------------------------------------
SAMPLE_ROWS = 14
MISSING_ROWS, OUTLIER_ROWS, LEVEL_ROWS, BLANKS_NAMED = 2, 2, 3, 3
#: Reasons in the order in which a row tells them.
ORDER = ("ends", "central", "missing", "outlier", "level", "date", "spread")
# ----------------------------------------------------------------------------
_CANDIDATES = "row long, reason string, kind int, place int"


@dataclass(frozen=True)
class Pick:
    """A reason that one row has: the row with the least ``key`` that is not null, the lowest of equals."""

    kind: str
    reason: str
    key: Column


def _rounded(x: float) -> float:
    fixed = round(x, 4)
    return fixed if fixed or not x else float(f"{x:.3e}")


def row_id(table) -> Column:
    return table.order_column().cast("long").alias("_row")


def _picks(profile: Profile) -> list[Pick]:
    """The reasons that the facts of the table call for; their keys read the table's own columns."""
    table, facts, row = profile.table, profile.table.facts, profile.table.order_column().cast("long")
    n = table.row_count
    picks = [Pick("ends", "first row", row)] + ([Pick("ends", "last row", -row)] if n > 1 else [])
    covered = [(-round(100 * facts[c].numbers / n, 1), k, c) for k, c in enumerate(table.columns)
               if c in profile.numeric and facts[c].numbers]
    if covered:
        best = min(covered)[2]
        q, x = profile.quantiles[best], table.number(best)
        central = (("median", q["median"]), ("lower quartile", q["q1"]), ("upper quartile", q["q3"]),
                   ("minimum", facts[best].min), ("maximum", facts[best].max))
        picks += [Pick("central", f"{name} {best}", F.abs(x - F.lit(_rounded(value)))) for name, value in central]
    for c in [c for c in profile.numeric if profile.outlier_count(c)][:OUTLIER_ROWS]:
        low, high = profile.fences(c)
        picks.append(Pick("outlier", f"outlier in {c}", F.when(~table.number(c).between(low, high), row)))
    for c in list(profile.categories())[:1]:
        picks += [Pick("level", f"{c} = {level.value}", F.when(table.level(c) == level.value, row))
                  for level in profile.levels[c].top[:LEVEL_ROWS]]
    for c in [c for c in table.of_type("date") if facts[c].dates][:1]:
        at = D.micros(table.moment(c))
        picks += [Pick("date", f"earliest {c}", at), Pick("date", f"latest {c}", -at)]
    return picks


def candidates(profile: Profile) -> DataFrame:
    """``row, reason, kind, place``: one row a reason, all found by one bounded aggregate, and the rows with blanks."""
    table = profile.table
    picks = _picks(profile)
    keyed = table.df.select(row_id(table), *[p.key.alias(f"k{i}") for i, p in enumerate(picks)])
    best = [F.min_by("_row", F.when(F.col(f"k{i}").isNotNull(), F.struct(f"k{i}", "_row"))) for i in range(len(picks))]
    found = keyed.agg(*[b.alias(f"r{i}") for i, b in enumerate(best)]).select(F.inline(F.array(*[
        F.struct(F.col(f"r{i}").alias("row"), F.lit(p.reason).alias("reason"), F.lit(ORDER.index(p.kind)).alias("kind"),
                 F.lit(i).alias("place")) for i, p in enumerate(picks)])))
    gaps = [c for c in table.columns if table.facts[c].missing]
    if gaps:
        names = F.filter(F.array(*[F.when(table.missing(c), F.lit(c)) for c in gaps]), lambda c: c.isNotNull())
        blank = table.df.select(row_id(table), names.alias("blanks")).filter(F.size("blanks") > 0).orderBy("_row").limit(MISSING_ROWS)
        reason = F.concat(F.lit("missing "), F.array_join(F.slice("blanks", 1, BLANKS_NAMED), ", "))
        found = found.unionByName(blank.select(
            F.col("_row").alias("row"), reason.alias("reason"), F.lit(ORDER.index("missing")).alias("kind"), F.lit(0).alias("place")))
    return found.filter("row IS NOT NULL")


def _spread(profile: Profile, limit: int, taken: int) -> DataFrame:
    """Evenly spaced rows as further candidates, more than can be needed; the rows are order statistics of the row id."""
    table, n = profile.table, profile.table.row_count
    step = max(1, n // (limit + 1))
    places = list(range(step, n, step))[: limit + taken]
    ids = order_statistics(table.df.select(row_id(table)), {"_row": (n, places)})["_row"]
    rows = [(int(ids[p]), "spread sample", ORDER.index("spread"), k) for k, p in enumerate(places)]
    return table.spark.createDataFrame(rows, _CANDIDATES)


def representative_sample(profile: Profile, limit: int = SAMPLE_ROWS) -> DataFrame:
    """``row, reasons`` in row order: ends, central values, blanks, outliers, levels, first and last dates, then evenly
    spaced rows while there is room. Ties go to the lowest row. The list is cut after sorting by row.

    Candidates are a small table; what a row was picked for, and which evenly spaced rows still fit, is told by grouping it.
    """
    table = profile.table
    if not table.row_count:
        return table.spark.createDataFrame([], "row long, reasons array<string>")
    found = durable(candidates(profile))
    taken = found.select("row").distinct().count()
    if taken < min(limit, table.row_count):
        # A spread row is new unless a reason or an earlier spread row has it; it is left out once the sample is full.
        more = _spread(profile, limit, taken).join(F.broadcast(found.select("row").distinct().withColumn("old", F.lit(True))), "row", "left")
        new = F.coalesce(F.sum(F.when(F.col("old").isNull(), 1).otherwise(0)).over(
            W.orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        found = found.unionByName(more.withColumn("_new", new).filter(F.col("_new") + taken < limit).select(*found.columns))
    told = F.array_sort(F.collect_set(F.struct("kind", "place", "reason")))
    picked = found.groupBy("row").agg(F.array_distinct(F.transform(told, lambda r: r.reason)).alias("reasons"))
    return picked.orderBy("row").limit(limit)


def sample_rows(profile: Profile, limit: int = SAMPLE_ROWS) -> DataFrame:
    """The sampled rows themselves with their reasons."""
    table = profile.table
    picked = durable(representative_sample(profile, limit))
    rows = table.df.withColumn("row", table.order_column().cast("long"))
    return rows.join(F.broadcast(picked), "row").orderBy("row")


def preview_rows(table, limit: int = 100) -> DataFrame:
    """The first rows in row order."""
    return table.df.orderBy(table.order_column()).limit(limit)
