"""Data quality: kinds, missing and unique shares, duplicates, score and issues."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import values as V
from ..session import durable
from .profile import Profile, level_counts
from .table import Table, settle

# --- fixed values -----------------------------------------------------------
MISSING_PENALTY, SHAPE_PENALTY, DUPLICATE_PENALTY, OUTLIER_PENALTY = 0.8, 0.25, 0.4, 0.5
MISSING_ISSUE, MISSING_HIGH, DUPLICATE_HIGH = 10, 40, 5
MAX_ISSUES = 12
SUMMARY_CHARS = 4000
# ----------------------------------------------------------------------------
# The most bits of the filter of repeated rows (32 MB); a piece of it that one task puts together; bits a hash sets.
BLOOM_BITS, BLOOM_PIECE, HASHES = 1 << 28, 1 << 16, 4


def unique_counts(table: Table, columns: list[str] | None = None) -> DataFrame:
    """Distinct present texts per column."""
    return level_counts(table, columns or table.columns).groupBy("column").agg(F.count(F.lit(1)).alias("unique"))


def _row_key(table: Table):
    """Each cell as grouping sees it: not-a-number reads as null, containers as JSON."""
    out = []
    for c in table.columns:
        dtype, raw = table.types[c], table.raw(c)
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            raw = F.when(~table.missing(c), raw)
        elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
            raw = F.to_json(raw)
        out.append(raw.alias(c))
    return out


def duplicate_rows(table: Table) -> DataFrame:
    """Rows beyond the first with the same full tuple, as one row.

    One plan for every size: eight-byte hashes are counted, rows whose hash repeats are compared in full. A Bloom filter
    of the repeated hashes, of a size that follows their number up to a bound, is applied where the rows lie; what it lets
    through by mistake only adds groups of one. Equal rows are counted before they move, so no group is large.
    """
    rows = table.df.select(*_row_key(table))
    names = [V.quoted(c) for c in table.columns]
    hashed = rows.withColumn("_h", F.xxhash64(*names))
    repeated = durable(hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_h"))
    n = repeated.count()
    if not n:
        return table.spark.createDataFrame([(0,)], "duplicate_rows long")
    marked = table.spark.sparkContext.broadcast(_bloom(repeated, n))

    @F.pandas_udf("boolean")
    def met(h: pd.Series) -> pd.Series:
        return pd.Series(_in_bloom(marked.value, h.to_numpy()))

    maybe = hashed.filter(met("_h")).drop("_h")
    groups = maybe.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Where a hash sets its bits: four of them, from its two halves."""
    a, b = h.view(np.uint64) >> np.uint64(32), h.view(np.uint64) & np.uint64(0xFFFFFFFF)
    return [((a + np.uint64(k) * b) & np.uint64(bits - 1)).astype(np.int64) for k in range(HASHES)]


def _bloom(hashes: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the column, made in pieces by tasks and put together on the driver; ``BLOOM_BITS`` at most."""
    bits = min(BLOOM_BITS, max(BLOOM_PIECE, 1 << (12 * n).bit_length()))

    def place(batches):
        for batch in batches:
            h = batch.column("_h").to_numpy()
            at = np.unique(np.concatenate(_places(h, bits)))
            yield pa.record_batch([pa.array(at), pa.array((at // BLOOM_PIECE).astype(np.int32))], names=["bit", "piece"])

    def gather(batches):
        pieces: dict[int, np.ndarray] = {}
        for batch in batches:
            at, piece = batch.column("bit").to_numpy(), batch.column("piece").to_numpy()
            for k in np.unique(piece).tolist():
                pieces.setdefault(k, np.zeros(BLOOM_PIECE, bool))[at[piece == k] % BLOOM_PIECE] = True
        if pieces:
            yield pa.record_batch([pa.array(list(pieces), pa.int32()), pa.array([np.packbits(x).tobytes() for x in pieces.values()])],
                                  names=["piece", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    placed = hashes.mapInArrow(place, "bit long, piece int").distinct().repartition("piece")
    for r in placed.mapInArrow(gather, "piece int, bits binary").collect():  # BLOOM_BITS / 8 bytes at most
        out[r.piece * BLOOM_PIECE // 8: (r.piece + 1) * BLOOM_PIECE // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def _in_bloom(marks: np.ndarray, h: np.ndarray) -> np.ndarray:
    found = np.ones(len(h), bool)
    for at in _places(h, 8 * len(marks)):
        found &= (marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return found


class Quality:
    def __init__(self, profile: Profile):
        self.profile, self.table = profile, profile.table

    @cached_property
    def uniques(self) -> dict[str, int]:
        return {r["column"]: r["unique"] for r in unique_counts(self.table).collect()}

    @cached_property
    def duplicates(self) -> int:
        return duplicate_rows(self.table).first().duplicate_rows

    @cached_property
    def _columns(self) -> DataFrame:
        return settle(self.columns())

    @cached_property
    def _summary(self) -> DataFrame:
        return settle(self.summary())

    def columns(self) -> DataFrame:
        """Type, consistency, missing, unique and outliers per column."""
        rows = []
        for c, f in self.table.facts.items():
            outliers = self.profile.outlier_count(c) if f.quality_type == "numeric" else 0
            rows.append((f.position, c, f.row_count, f.present, f.quality_type, f.type_consistency, f.missing,
                         self.uniques.get(c, 0), outliers))
        frame = self.table.spark.createDataFrame(
            rows, "position int, column string, row_count long, present long, type string, type_consistency double, "
                  "missing long, unique long, outliers long")
        return frame.select(
            "position", "column", "row_count", "type", "type_consistency", "missing",
            V.coverage_pct(F.col("missing"), F.col("row_count")).alias("missing_pct"), "unique",
            V.coverage_pct(F.col("unique"), F.col("present")).alias("unique_pct"), "outliers")

    def summary(self) -> DataFrame:
        """Rows, duplicates, completeness, health score and grade, as one row."""
        columns = self._columns
        size = F.greatest(F.col("column_count"), F.lit(1))
        totals = columns.agg(
            F.max("row_count").alias("row_count"), F.count(F.lit(1)).alias("column_count"),
            F.coalesce(F.avg("missing_pct"), F.lit(0.0)).alias("avg_missing"),
            F.count_if(F.col("type").isin("mixed", "empty")).alias("shapeless"),
            F.sum("outliers").alias("outliers"))
        totals = totals.withColumn("duplicate_rows", F.lit(self.duplicates))
        duplicate_share = F.coalesce(F.try_divide("duplicate_rows", "row_count"), F.lit(0.0)) * 100
        outlier_share = F.coalesce(F.try_divide(F.col("outliers"), F.col("row_count") * size), F.lit(0.0)) * 100
        score = (
            100 - F.col("avg_missing") * MISSING_PENALTY
            - F.col("shapeless") / size * 100 * SHAPE_PENALTY
            - duplicate_share * DUPLICATE_PENALTY - outlier_share * OUTLIER_PENALTY
        )
        scored = totals.select(
            "row_count", "column_count", "duplicate_rows", F.round(duplicate_share, 1).alias("duplicate_pct"),
            F.round(100 - F.col("avg_missing"), 1).alias("completeness"),
            F.greatest(F.lit(0), F.round(score)).cast("int").alias("health_score"),
            duplicate_share.alias("_dup"))
        return scored.withColumn("health_grade", V.health_grade(F.col("health_score")))

    def issues(self, limit: int | None = MAX_ISSUES) -> DataFrame:
        """Issues by severity, then in column order; the first ``limit`` of them."""
        columns = self._columns

        def found(condition, severity, message, step):
            return columns.filter(condition).select(
                severity.alias("severity"), message.alias("message"), F.col("position").alias("at"),
                F.lit(step).alias("step"))

        name = F.concat(F.lit('"'), F.col("column"), F.lit('"'))
        share = V.number_text(F.col("missing_pct"))
        plural = F.when(F.col("outliers") == 1, "").otherwise("s")
        parts = [
            found(F.col("missing_pct") >= MISSING_ISSUE,
                  F.when(F.col("missing_pct") >= MISSING_HIGH, "high").otherwise("medium"),
                  F.concat(name, F.lit(" is missing "), share, F.lit("% of its values")), 0),
            found(F.col("type") == "mixed", F.lit("high"),
                  F.concat(name, F.lit(" mixes value types (only "),
                           F.round(F.col("type_consistency") * 100).cast("int"), F.lit("% consistent)")), 1),
            found(F.col("type") == "empty", F.lit("medium"), F.concat(name, F.lit(" is completely empty")), 2),
            found(F.col("outliers") > 0, F.lit("low"),
                  F.concat(name, F.lit(" has "), F.col("outliers"), F.lit(" statistical outlier"), plural), 3),
        ]
        duplicates = self._summary.filter("duplicate_rows > 0").select(
            F.when(F.col("_dup") >= DUPLICATE_HIGH, "high").otherwise("medium").alias("severity"),
            F.concat(F.col("duplicate_rows"), F.lit(" duplicate row"),
                     F.when(F.col("duplicate_rows") == 1, "").otherwise("s"), F.lit(" ("),
                     V.number_text(F.col("duplicate_pct")), F.lit("%)")).alias("message"),
            F.lit(1 << 30).alias("at"), F.lit(0).alias("step"))
        out = duplicates
        for part in parts:
            out = out.unionByName(part)
        rank = F.array_position(F.array(*map(F.lit, ("high", "medium", "low"))), F.col("severity"))
        ordered = out.orderBy(rank, "at", "step").select("severity", "message")
        return ordered if limit is None else ordered.limit(limit)

    def summary_line(self) -> DataFrame:
        """The whole profile in one line of text, at most 4,000 characters."""
        share = F.when(F.col("missing_pct") > 0, F.concat(F.lit(", "), V.number_text(F.col("missing_pct")), F.lit("% missing")))
        far = F.when(F.col("outliers") > 0, F.concat(F.lit(", "), F.col("outliers"), F.lit(" outliers")))
        part = F.concat(F.col("column"), F.lit(": "), F.col("type"), F.coalesce(share, F.lit("")), F.coalesce(far, F.lit("")))
        listed = self._columns.agg(F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("position", part.alias("text")))), lambda s: s.text),
            " | ").alias("columns"))
        # At most twelve issues and one summary row.
        issues = self.issues().agg(F.array_join(F.collect_list("message"), "; ").alias("issues"))
        line = F.concat(
            F.lit("Health "), F.col("health_grade"), F.lit(" ("), F.col("health_score"), F.lit("/100), "),
            F.col("row_count"), F.lit(" rows, "), F.col("duplicate_rows"), F.lit(" duplicate rows. Columns — "),
            F.col("columns"), F.lit(". Issues — "),
            F.when(F.col("issues") == "", "none").otherwise(F.col("issues")), F.lit("."))
        one = self._summary.withColumn("_k", F.lit(1))
        for other in (listed, issues):
            one = one.join(F.broadcast(other.withColumn("_k", F.lit(1))), "_k")
        return one.select(F.substring(line, 1, SUMMARY_CHARS).alias("summary"))
