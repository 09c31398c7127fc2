"""Saved analyses: a parquet table partitioned by creation date, so that expiry drops folders and reads skip files.

Files are sorted by session and id and carry bloom filters on both, so a point read opens the row group that holds the
id and few others. Deleting rewrites the partitions that hold a row to delete, by dynamic partition overwrite; partitions
that hold nothing else are removed whole. One writer at a time is assumed, as appends made during a rewrite are lost.
"""

from __future__ import annotations

import datetime as dt
import math
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import durable

# --- fixed values -----------------------------------------------------------
LISTED = 20
FIELDS = "id string, created_at timestamp_ntz, session_id string, kind string, filename string, file_type string, " \
         "model string, question string, payload string"
# ----------------------------------------------------------------------------
#: How the partition date is made from the moment of creation.
GRAINS = ("day", "month", "year")


def retention_cutoff(days: float | str | None, now: dt.datetime) -> dt.datetime | None:
    """The oldest moment still kept; no expiry for a window that is not a positive number."""
    try:
        window = float(days)
    except (TypeError, ValueError):
        return None
    if not math.isfinite(window) or window <= 0:
        return None
    return now - dt.timedelta(days=window)


def inside_retention(created_at: Column, cutoff: dt.datetime | None) -> Column:
    return F.lit(True) if cutoff is None else created_at >= F.lit(cutoff).cast("timestamp_ntz")


def grain_start(moment: dt.datetime, grain: str) -> dt.date:
    """The first day of the partition that holds the moment."""
    return dt.date(moment.year, 1 if grain == "year" else moment.month, moment.day if grain == "day" else 1)


def list_saved(saved: DataFrame, session_id: str, cutoff: dt.datetime | None, limit: int | None = LISTED) -> DataFrame:
    """A session's analyses inside retention, newest first, without payloads."""
    rows = saved.filter((F.col("session_id") == session_id) & inside_retention(F.col("created_at"), cutoff)).drop(
        "payload", "session_id", "created_date").orderBy(F.desc("created_at"), "id")
    return rows if limit is None else rows.limit(limit)


def get_saved(saved: DataFrame, ids: str | Iterable[str] | DataFrame, cutoff: dt.datetime | None) -> DataFrame:
    """The analyses with these ids that are inside retention; an expired one is as good as none.

    Few ids come as texts and are looked up by the filters of the files; any number of them as the column ``id`` of a
    table, which is joined and never passes the driver.
    """
    kept = saved.filter(inside_retention(F.col("created_at"), cutoff))
    if isinstance(ids, DataFrame):
        return kept.join(ids.select("id"), "id", "left_semi")
    return kept.filter(F.col("id").isin([ids] if isinstance(ids, str) else list(ids)))


class AnalysisStore:
    def __init__(self, spark: SparkSession, path: str, grain: str = "day"):
        if grain not in GRAINS:
            raise ValueError(f"grain: one of {', '.join(GRAINS)}")
        self.spark, self.grain, self.rows = spark, grain, f"{path}/analyses"

    def _folder(self, path: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), jpath

    def saved(self, since: dt.datetime | None = None) -> DataFrame:
        """All rows, or those in partitions that can hold rows from ``since`` on: other partitions are not listed."""
        schema = f"{FIELDS}, created_date date"
        system, path = self._folder(self.rows)
        if not system.exists(path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(self.rows)
        return rows if since is None else rows.filter(F.col("created_date") >= F.lit(grain_start(since, self.grain)))

    def _write(self, rows: DataFrame, mode: str) -> None:
        ordered = rows.repartitionByRange("created_date", "session_id", "id").sortWithinPartitions("created_date", "session_id", "id")
        writer = ordered.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("created_date")
        for column in ("id", "session_id"):
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", True)
        writer.parquet(self.rows)

    def append(self, rows: DataFrame) -> None:
        """Many results at once, in the columns of the table without the partition date."""
        self._write(rows.withColumn("created_date", F.to_date(F.date_trunc(self.grain, "created_at"))), "append")

    def save(self, payload: DataFrame, *, session_id: str, kind: str, filename: str, file_type: str, model: str | None = None,
             question: str | None = None, now: dt.datetime) -> str:
        """Appends one result (a one-row DataFrame) as JSON text; returns its id."""
        new_id = str(uuid.uuid4())
        known = {"id": new_id, "session_id": session_id, "kind": kind, "filename": filename, "file_type": file_type,
                 "model": model, "question": question or None}
        self.append(payload.select(
            *[F.lit(v).cast("string").alias(k) for k, v in known.items()],
            F.lit(now).cast("timestamp_ntz").alias("created_at"), F.to_json(F.struct("*")).alias("payload")))
        return new_id

    def list(self, session_id: str, cutoff: dt.datetime | None, limit: int | None = LISTED) -> DataFrame:
        return list_saved(self.saved(cutoff), session_id, cutoff, limit)

    def get(self, ids: str | Iterable[str] | DataFrame, cutoff: dt.datetime | None) -> DataFrame:
        return get_saved(self.saved(cutoff), ids, cutoff)

    def _rewrite(self, marked: DataFrame) -> int:
        """Takes the rows whose column ``gone`` is true out of the files of their partitions; returns how many there were."""
        gone = F.coalesce("gone", F.lit(False))
        counts = marked.groupBy("created_date").agg(
            F.count_if(gone).alias("gone"), F.count_if(~gone).alias("kept")).filter("gone > 0").collect()  # one row a partition
        if any(c.kept for c in counts):
            # A partition cannot be overwritten while it is read, so what stays is written aside first.
            held = durable(marked.filter(F.col("created_date").isin([c.created_date for c in counts if c.kept]) & ~gone).drop("gone"))
            self._write(held, "overwrite")
        for c in counts:
            if not c.kept:
                system, path = self._folder(f"{self.rows}/created_date={c.created_date}")
                system.delete(path, True)
        self.spark.catalog.refreshByPath(self.rows)
        return sum(c.gone for c in counts)

    def sweep_expired(self, session_id: str | None, cutoff: dt.datetime | None) -> int:
        """Removes the expired rows of a session, or of all sessions, from the files; returns how many."""
        if cutoff is None:
            return 0
        old = self.saved().filter(F.col("created_date") <= F.lit(grain_start(cutoff, self.grain)))
        gone = ~inside_retention(F.col("created_at"), cutoff)
        return self._rewrite(old.withColumn("gone", gone if session_id is None else gone & (F.col("session_id") == session_id)))

    def delete(self, ids: str | Iterable[str] | DataFrame, session_id: str) -> int:
        """Removes analyses of their own session from the files; zero means not found.

        Few ids come as texts; any number of them as the column ``id`` of a table, which meets the rows of the session
        alone and never passes the driver.
        """
        saved, own = self.saved(), F.col("session_id") == session_id
        if isinstance(ids, DataFrame):
            # Every step must see the same ids, also when they are read from the rows that go.
            wanted = durable(ids.select("id").distinct()).withColumn("gone", F.lit(True))
            others = saved.filter(~F.coalesce(own, F.lit(False))).withColumn("gone", F.lit(False))
            marked = saved.filter(own).join(wanted, "id", "left").unionByName(others)
        else:
            marked = saved.withColumn("gone", F.col("id").isin([ids] if isinstance(ids, str) else list(ids)) & own)
        dates = [r.created_date for r in marked.filter("gone").select("created_date").distinct().collect()]
        return self._rewrite(marked.filter(F.col("created_date").isin(dates))) if dates else 0

    def compact(self) -> None:
        """Every partition as few sorted files, after many small saves."""
        self._write(durable(self.saved()), "overwrite")


def export_result(result: DataFrame, path: str, now: dt.datetime) -> None:
    """A result as JSON lines, each stamped with the time of export."""
    result.withColumn("exported_at", F.lit(now).cast("timestamp_ntz")).write.mode("overwrite").json(path)
