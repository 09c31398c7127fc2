"""What the operators of this subpackage share: words, folds, tables cut from their lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallymark.session import ensure_checkpoint_dir

#: Words are runs of anything but space and the controls tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def lower_words(text: str | None) -> list[bytes]:
    """The words in UTF-8 with A-Z lower-cased; ``bytes`` knows just the six spaces of the contract and no others."""
    return text.encode().lower().split() if text else []


def words(text: Column) -> Column:
    """The same words as an array column; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def fold(key: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    column = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and go on from what was written."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def finite_vectors(vectors: DataFrame, key: str, vector: str, limit: float, *more: str) -> DataFrame:
    """``key``, v (as doubles) and the columns ``more`` of rows whose vector has parts, all finite and below ``limit``."""
    v = F.col("v")
    rows = vectors.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v"),
        *[F.col(f"`{name}`").alias(f"more{i}") for i, name in enumerate(more)])
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return rows.where(v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)))


def spread_join(rows: DataFrame, keyed: DataFrame, on: str, size: str, share: int = 200) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row for each key and in ``size`` how many rows carry it; null is a key.

    Besides the key no column may be in both.

    Keys that hold at least one in ``share`` of all rows are at most ``share`` and are broadcast, so their rows stay where
    they lie; the others meet by a shuffle in which no key is larger than that.
    """
    least = (keyed.agg(F.sum(size)).first()[0] or 0) / share
    keyed = keyed.withColumnRenamed(on, "_on")
    hot, mild = F.broadcast(keyed.where(F.col(size) >= least)), keyed.where(F.col(size) < least)
    same = F.col(on).eqNullSafe(F.col("_on"))
    rest = rows.join(hot.select("_on"), same, "left_anti")
    return rows.join(hot, same).unionAll(rest.join(mild, same)).drop("_on")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
