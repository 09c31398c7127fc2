"""Whole analyses: one table, two tables, or many tables with one failure kept from stopping the rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.values import quoted
from ..operators.compare import Comparison
from ..operators.correlate import correlate
from ..operators.evidence import Evidence
from ..operators.profile import Profile, compute_stats
from ..operators.provenance import Provenance
from ..operators.quality import Quality
from ..operators.sample import representative_sample
from ..operators.table import Table, resolve_target, select_columns
from ..session import durable


def analyze(
    df: DataFrame, *, row_id: str, target: str | None = None, columns: list[str] | None = None, strict: bool = True,
) -> dict[str, DataFrame]:
    """Every fact family of one table, each as its own DataFrame.

    The ranked evidence is written once, because provenance reads it again.
    """
    body = df.drop(row_id)
    kept, excluded = select_columns(body, columns)
    target = resolve_target(target, kept.columns, strict=strict)
    profile = Profile(Table(df.select(quoted(row_id), *[quoted(c) for c in kept.columns]), kept.columns, row_id))
    quality = Quality(profile)
    evidence = durable(Evidence(profile, target).build())
    provenance = Provenance(profile, evidence)
    spark = df.sparkSession
    return {
        "stats": compute_stats(profile),
        "correlations": correlate(profile.table, profile.numeric),
        "quality": quality.columns(),
        "quality_summary": quality.summary().drop("_dup"),
        "issues": quality.issues(),
        "evidence": evidence,
        "provenance": provenance.summary(),
        "source_rows": provenance.source_rows(),
        "sample": representative_sample(profile),
        "excluded_columns": spark.createDataFrame([(c,) for c in excluded], "column string"),
    }


def compare(baseline: DataFrame, current: DataFrame) -> Comparison:
    return Comparison(Profile(Table(baseline)), Profile(Table(current)))


def analyze_many(
    spark: SparkSession, tables: dict[str, Callable[[], DataFrame]], *, row_id: str, target: str | None = None,
) -> tuple[dict[str, dict[str, DataFrame]], DataFrame]:
    """Each table on its own; a table that cannot be read is a status row. The target is used where present."""
    done, status = {}, []
    for name, load in tables.items():
        try:
            done[name] = analyze(load(), row_id=row_id, target=target, strict=False)
            status.append((name, "ok", None))
        except Exception as error:  # noqa: BLE001 - any failure of one table is reported, not raised
            status.append((name, "error", str(error).splitlines()[0][:200]))
    return done, spark.createDataFrame(status, "dataset string, status string, error string")


def profile_many(cells: DataFrame) -> DataFrame:
    """Per ``dataset, column`` facts of many tables in one job, from long cells ``dataset, column, text``.

    Groups are never held whole: counts are partial aggregates and quantiles come from value counts.
    """
    from ..operators.profile import QUANTILES
    from ..operators.ranks import grouped_quantiles
    from ..operators.table import read_text

    read = read_text(cells)
    n, k = F.col("number"), F.col("kind")
    keys = ["dataset", "column"]
    counts = read.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(k == "missing").alias("missing"), F.count(n).alias("numbers"),
        F.count("moment").alias("dates"), F.min(n).alias("min"), F.max(n).alias("max"), F.avg(n).alias("mean"))
    places = grouped_quantiles(read, keys, "number", QUANTILES)
    return counts.join(places.drop("n"), keys, "left")
