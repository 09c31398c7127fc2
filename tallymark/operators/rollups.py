"""Counts over finished facts, and the small aggregates that charts draw."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import values as V
from .correlate import column_pairs, correlate
from .evidence import DATED_MIN, Evidence
from .profile import QUANTILES, Profile, by_level
from .timeline import SHOWN_GAPS, SHOWN_PERIODS, Timeline

# --- fixed values -----------------------------------------------------------
SPREAD_COLUMNS = 12
CHART_BINS, CHART_LEVELS, PIE_LEVELS, LINE_POINTS, SCATTER_POINTS = 10, 12, 8, 100, 200
FAMILIES = (
    ("Correlations", ("pearson_r", "spearman_rho"), "two numeric columns"),
    ("Group differences", ("group_mean_difference", "missingness_mean_difference"), "a numeric target column"),
    ("Associations", ("cramers_v",), "two category columns"),
    ("Dominant levels", ("category_share",), "a category column"),
    ("Time patterns", ("period_volume_trend", "period_over_period_change", "target_time_trend"),
     "a date column with six dated rows"),
    ("Level shifts", ("candidate_level_shift",), "a date column and a numeric target"),
    ("Outliers", ("iqr_outliers",), "a numeric column"),
)
# ----------------------------------------------------------------------------


def _type_frame(profile: Profile) -> DataFrame:
    """One row per column: both types, invalid cells, and whether its outlier check ran."""
    facts = profile.table.facts
    rows = [
        (f.position, c, f.stat_type, f.quality_type, f.type_consistency, f.present, f.numbers, f.dates,
         c in profile.numeric and profile.fences(c) is not None,
         profile.unchecked_reason(c) if c in profile.numeric else None)
        for c, f in facts.items()
    ]
    return profile.table.spark.createDataFrame(
        rows, "position int, column string, stat_type string, quality_type string, consistency double, present long, "
              "numbers long, dates long, checked boolean, reason string")


def _irregular(profile: Profile) -> DataFrame:
    lines = [Timeline(profile.table, c).irregular_intervals() for c in profile.table.of_type("date")]
    if not lines:
        return profile.table.spark.createDataFrame([], "column string, irregular boolean")
    return reduce(DataFrame.unionByName, lines).select("column", "irregular")


def kind_counts(profile: Profile) -> DataFrame:
    return _type_frame(profile).groupBy(F.col("quality_type").alias("type")).agg(F.count(F.lit(1)).alias("columns"))


def _pair_counts(profile: Profile, reported: DataFrame) -> DataFrame:
    pairs = len(column_pairs(profile.numeric))
    return reported.agg(F.count(F.lit(1)).alias("settled")).withColumn("pairs", F.lit(pairs).cast("long"))


def read_ledger(profile: Profile, reported: DataFrame | None = None, structure: DataFrame | None = None) -> DataFrame:
    """Settled against open counts for each kind of read.

    ``structure`` is one structure report, where the table came from a raw sheet.
    """
    if reported is None:
        reported = correlate(profile.table, profile.numeric)
    types = _type_frame(profile)

    def row(label, df, open_when, where=None):
        df = df if where is None else df.filter(where)
        return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(open_when).alias("open")).filter("n > 0").select(
            F.lit(label).alias("label"), (F.col("n") - F.col("open")).alias("settled"), "open")

    parts = []
    if structure is not None:
        parts.append(row("File shape", structure, F.col("confidence") == "uncertain"))
    parts += [
        row("Column types", types, F.col("quality_type") == "mixed"),
        row("Outlier checks", types, ~F.col("checked"), F.col("stat_type") == "numeric"),
    ]
    if len(profile.numeric) >= 2:
        counts = _pair_counts(profile, reported)
        parts.append(counts.select(
            F.lit("Numeric pairs").alias("label"), "settled", (F.col("pairs") - F.col("settled")).alias("open")))
    parts.append(row("Date spacing", _irregular(profile), F.col("irregular")))
    return reduce(DataFrame.unionByName, parts)


def unsettled_reads(profile: Profile, reported: DataFrame | None = None) -> DataFrame:
    """Everything that could not be settled, as text with its count."""
    if reported is None:
        reported = correlate(profile.table, profile.numeric)
    types = _type_frame(profile)
    numeric = F.col("stat_type") == "numeric"
    lost = F.col("present") - F.col("numbers")

    def item(df, n: Column, text, order: int):
        return df.agg(n.alias("n")).filter("n > 0").select(
            F.lit(order).alias("place"), text(F.col("n")).alias("text"), F.col("n").cast("long").alias("n"))

    def plural(n):
        return F.when(n == 1, "").otherwise("s")

    parts = [
        item(types, F.count_if(F.col("quality_type") == "mixed"),
             lambda n: F.concat(n, F.lit(" column"), plural(n), F.lit(" could not be typed")), 1),
        item(types, F.sum(F.when(numeric, lost).otherwise(0)),
             lambda n: F.concat(n, F.lit(" cell"), plural(n), F.lit(" could not be read as numbers")), 2),
        item(types, F.count_if(numeric & ~F.col("checked")),
             lambda n: F.concat(F.lit("Outlier check did not run for "), n, F.lit(" column"), plural(n)), 3),
    ]
    if len(profile.numeric) >= 2:
        counts = _pair_counts(profile, reported).withColumn("n", F.col("pairs") - F.col("settled"))
        parts.append(counts.filter("n > 0").select(
            F.lit(4).alias("place"),
            F.concat("settled", F.lit(" of "), "pairs", F.lit(" numeric pair"), plural(F.col("pairs")),
                     F.lit(" cleared the reporting bar")).alias("text"), "n"))
    parts.append(_irregular(profile).filter("irregular").select(
        F.lit(5).alias("place"),
        F.concat(F.lit("Dates in "), "column", F.lit(" arrive at irregular intervals")).alias("text"),
        F.lit(1).cast("long").alias("n")))
    return reduce(DataFrame.unionByName, parts)


def family_coverage(evidence: Evidence, found: DataFrame | None = None) -> DataFrame:
    """Each evidence family: whether it applied, how much it found, and what it needs."""
    profile, table = evidence.profile, evidence.table
    if found is None:
        found = evidence.build()
    categories = len(profile.categories(at_least=2))
    dated = any(table.facts[c].dates >= DATED_MIN for c in table.of_type("date"))
    target = evidence.numeric_target
    applies = (
        len(profile.numeric) >= 2, target and len(table.columns) >= 2, categories >= 2, categories >= 1, dated,
        dated and target, len(profile.numeric) >= 1,
    )
    rows = [(i, label, ok, needs, m) for i, ((label, metrics, needs), ok) in enumerate(zip(FAMILIES, applies))
            for m in metrics]
    families = table.spark.createDataFrame(
        rows, "place int, family string, applicable boolean, needs string, metric string")
    # At most twenty evidence records on one side and ten metrics on the other.
    joined = families.join(F.broadcast(found.select("metric", "claim")), "metric", "left")
    return joined.groupBy("place", "family", "applicable", "needs").agg(F.count("claim").alias("found"))


def finding_vitals(found: DataFrame) -> DataFrame:
    """Sample size, effect and first available p-value of each evidence record."""
    value = V.number_text(F.col("value"))
    m = F.col("metric")
    effect = (
        F.when(m == "pearson_r", F.concat(F.lit("r="), value))
        .when(m.isin("spearman_rho", "target_time_trend"), F.concat(F.lit("rho="), value))
        .when(m == "cramers_v", F.concat(F.lit("V="), value))
        .when(m == "group_mean_difference", F.concat(F.lit("d="), F.coalesce(
            V.number_text(F.try_element_at("statistics", F.lit("effect_size"))), value)))
        .when(m == "missingness_mean_difference", F.concat(F.lit("d="), value))
        .when(m == "category_share", F.concat(value, F.lit("% share")))
        .when(m == "iqr_outliers", F.concat(value, F.lit(" outside fences")))
        .when(m == "period_over_period_change",
              F.concat(F.when(F.col("value") >= 0, "+").otherwise(""), value, F.lit("%")))
        .when(m == "candidate_level_shift", F.concat(F.lit("robust d="), value))
    )
    return found.select(
        "claim", "metric", F.col("sample_size").alias("n"), effect.alias("effect"),
        F.try_element_at("statistics", F.lit("p_value")).alias("p_value"))


def spread_strip(profile: Profile, limit: int = SPREAD_COLUMNS) -> DataFrame:
    """Each numeric column's summary as 0-100 places between its own ends; the first twelve columns."""
    summary = profile.numeric_summary().orderBy("position").limit(limit)
    low, width = F.col("min"), F.col("max") - F.col("min")

    def at(c: Column) -> Column:
        return V.clamp(F.try_divide(c - low, width) * 100, 0.0, 100.0)

    bites = F.col("outliers") > 0
    return summary.select(
        "column", "min", "max", (width == 0).alias("constant"), *[at(F.col(q)).alias(f"{q}_at") for q in QUANTILES],
        at(F.col("mean")).alias("mean_at"),
        at(F.col("mean_ci.lower")).alias("ci_lower_at"), at(F.col("mean_ci.upper")).alias("ci_upper_at"),
        F.when(bites, at(F.col("lower_fence"))).alias("lower_fence_at"),
        F.when(bites, at(F.col("upper_fence"))).alias("upper_fence_at"))


def completeness_track(profile: Profile) -> DataFrame:
    """Valid, missing and invalid cells of each column as percentages with two decimals."""
    facts = profile.table.facts
    valid = lambda f: {"numeric": f.numbers, "date": f.dates}.get(f.stat_type, f.present)
    rows = [(c, f.row_count, valid(f), f.missing, f.present - valid(f)) for c, f in facts.items()]
    frame = profile.table.spark.createDataFrame(
        rows, "column string, row_count long, valid long, missing long, invalid long")
    total = F.greatest(F.lit(1), F.col("row_count"))
    return frame.select("column", *[
        F.round(F.col(c) / total * 100, 2).alias(f"{c}_pct") for c in ("valid", "missing", "invalid")])


# -- chart aggregates over the whole table --------------------------------------

def chart_bin_mean(profile: Profile, x: str, y: str, bins: int = CHART_BINS) -> DataFrame:
    """Mean of y in equal-width bins of x, over rows where both read as numbers."""
    table = profile.table
    pairs = table.df.select(table.number(x).alias("x"), table.number(y).alias("y")).filter(
        "x IS NOT NULL AND y IS NOT NULL")
    ends = pairs.agg(F.min("x").alias("low"), F.max("x").alias("high")).first()
    step = (ends.high - ends.low) / bins if ends.low is not None else 0.0
    place = F.least(F.floor((F.col("x") - F.lit(ends.low)) / F.lit(step)), F.lit(bins - 1)) if step else F.lit(0)
    return pairs.groupBy(place.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.round(F.avg("y"), 2).alias("mean")).withColumn(
        "start", F.round(F.lit(ends.low) + F.col("bin") * F.lit(step), 1))


def chart_category_sum(profile: Profile, x: str, y: str | None = None, limit: int = CHART_LEVELS) -> DataFrame:
    """Sum of y by level, where a zero or unread y counts 1; without y the count."""
    table = profile.table
    amount = F.lit(1.0)
    if y is not None:
        number = table.number(y)
        amount = F.when(number.isNull() | (number == 0), 1.0).otherwise(number)
    level = F.coalesce(table.level(x), F.lit("null"))
    sums = table.df.groupBy(level.alias("level")).agg(F.sum(amount).alias("total"))
    return sums.orderBy(F.desc("total"), by_level()).limit(limit)


def chart_line(profile: Profile, x: str, y: str, limit: int = LINE_POINTS) -> DataFrame:
    """The first hundred points by date text where x is dated, else by row."""
    table = profile.table
    dated = table.facts[x].stat_type == "date"
    label = F.date_format(table.moment(x), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if dated else None
    rows = table.df.select(
        table.order_column().cast("long").alias("row"), (label if dated else F.lit(None).cast("string")).alias("label"),
        table.number(y).alias("y")).filter("y IS NOT NULL")
    if dated:
        rows = rows.filter("label IS NOT NULL")
    return rows.orderBy(*(["label"] if dated else []), "row").limit(limit)


def chart_pie(profile: Profile, x: str, limit: int = PIE_LEVELS) -> DataFrame:
    """Counts of the first eight levels in order of appearance."""
    table = profile.table
    level = F.coalesce(table.level(x), F.lit("null"))
    seen = table.df.groupBy(level.alias("level")).agg(
        F.count(F.lit(1)).alias("count"), F.min(table.order_column().cast("long")).alias("first_row"))
    return seen.orderBy("first_row").limit(limit)


def chart_scatter(profile: Profile, x: str, y: str, limit: int = SCATTER_POINTS) -> DataFrame:
    """The first two hundred rows where both read as numbers."""
    table = profile.table
    rows = table.df.select(
        table.order_column().cast("long").alias("row"), table.number(x).alias("x"), table.number(y).alias("y"))
    return rows.filter("x IS NOT NULL AND y IS NOT NULL").orderBy("row").limit(limit)


def chart_catalogue(profile: Profile, target: str | None = None) -> DataFrame:
    """One record per column worth a chart: histogram, gap-filled trend or level counts; target first."""
    table = profile.table
    order = {c: i + 1 for i, c in enumerate(table.columns)}
    if target in order:
        order[target] = 0
    place = table.spark.createDataFrame(list(order.items()), "column string, place int")

    def record(df: DataFrame, kind: str, label: Column, sort) -> DataFrame:
        point = F.struct(F.col(sort).alias("sort") if isinstance(sort, str) else sort.alias("sort"),
                         label.alias("label"), F.col("count").cast("long").alias("value"))
        return df.groupBy("column").agg(F.transform(
            F.array_sort(F.collect_list(point)),
            lambda p: F.struct(p.label.alias("label"), p.value.alias("value"))).alias("points")).select(
            "column", F.lit(kind).alias("kind"), "points")

    parts = []
    if profile.numeric:
        bins = profile.histogram()
        ends = F.concat(F.coalesce(V.number_text(F.col("start")), F.lit("below")), F.lit(" to "),
                        F.coalesce(V.number_text(F.col("end")), F.lit("above")))
        parts.append(record(bins, "histogram", ends, "bin"))
    for c in table.of_type("date"):
        line = Timeline(table, c)
        if len(line.periods) > 1:
            filled = line.gap_filled(SHOWN_PERIODS, SHOWN_GAPS).withColumn("column", F.lit(c))
            parts.append(record(filled, "trend", F.col("period"), "period"))
    charted = [c for c in profile.categories() if len(profile.levels[c].top) > 1]
    if charted:
        rows = [(c, i, t.value, t["count"]) for c in charted for i, t in enumerate(profile.levels[c].top)]
        top = table.spark.createDataFrame(rows, "column string, at int, level string, count long")
        parts.append(record(top, "category", F.col("level"), "at"))
    if not parts:
        return table.spark.createDataFrame(
            [], "place int, column string, kind string, points array<struct<label:string,value:long>>")
    return reduce(DataFrame.unionByName, parts).join(F.broadcast(place), "column").select(
        "place", "column", "kind", "points")


