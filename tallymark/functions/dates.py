"""Reading dates from cells, and naming the period a date falls in."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from .values import DATE_START, is_time_type, trimmed

# --- fixed values -----------------------------------------------------------
_MONTH = "(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
ISO_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}([T ].*)?$"
NUMERIC_SHAPES = (
    # Month/day/year; two-digit years up to 49 are 20xx, later ones 19xx.
    (r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{3,4})$", "$3-$1-$2"),
    (r"^(\d{1,2})[/\-.](\d{1,2})[/\-.]([0-4]\d)$", "20$3-$1-$2"),
    (r"^(\d{1,2})[/\-.](\d{1,2})[/\-.]([5-9]\d)$", "19$3-$1-$2"),
)
NAMED_SHAPES = (
    (rf"^({_MONTH})[a-zA-Z]*\.?\s+(\d{{1,2}}),?\s+(\d{{4}})$", "$3-$1-$2"),
    (rf"^(\d{{1,2}})\s+({_MONTH})[a-zA-Z]*\.?\s+(\d{{4}})$", "$3-$2-$1"),
)
HALF_DAY_SHAPE = r"^(\d{4}-\d{1,2}-\d{1,2})[T ]\s*(\d{1,2}:\d{2}(?::\d{2})?)\s*([AP]M)$"
DAY_GRAIN_DAYS = 92
MONTH_GRAIN_DAYS = 1100
GRAIN_FORMAT = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}
# ----------------------------------------------------------------------------


def to_date(c: Column, dtype: T.DataType) -> Column:
    """The wall clock a cell names, or null. Numbers are never dates.

    Every shape is first rewritten as year-month-day text, so one cast reads it. A
    zone names an instant and moves the clock to UTC; the session zone is UTC, so
    text without one keeps the clock it was written with. An impossible day is null.
    """
    if is_time_type(dtype):
        return c.cast("timestamp_ntz")
    if not isinstance(dtype, T.StringType):
        return F.lit(None).cast("timestamp_ntz")
    t = trimmed(c)
    return F.when(t.rlike(DATE_START), date_from(t))


def date_from(t: Column) -> Column:
    """The wall clock in trimmed text."""
    dashed, named = t, t
    for shape, rewritten in NUMERIC_SHAPES:
        dashed = F.regexp_replace(dashed, shape, rewritten)
    for shape, rewritten in NAMED_SHAPES:
        named = F.regexp_replace(named, shape, rewritten)
    halves = F.regexp_replace(F.upper(t), HALF_DAY_SHAPE, "$1 $2 $3")
    return (
        F.when(F.upper(t).rlike(HALF_DAY_SHAPE), F.coalesce(*[
            F.try_to_timestamp(halves, F.lit(f"yyyy-M-d {clock} a")) for clock in ("h:mm", "h:mm:ss")]))
        .when(dashed.rlike(ISO_SHAPE), dashed.try_cast("timestamp"))
        .when(named.rlike(r"^\d{4}-[a-zA-Z]{3}-"), F.try_to_timestamp(named, F.lit("yyyy-MMM-d")))
        .cast("timestamp_ntz")
    )


def choose_granularity(days: Column) -> Column:
    return F.when(days <= DAY_GRAIN_DAYS, "day").when(days <= MONTH_GRAIN_DAYS, "month").otherwise("year")


def period_key(ts: Column, grain: str | Column) -> Column:
    """The day, month or year a wall clock falls in, as text."""
    if isinstance(grain, str):
        return F.date_format(ts, GRAIN_FORMAT[grain])
    return (
        F.when(grain == "day", F.date_format(ts, GRAIN_FORMAT["day"]))
        .when(grain == "month", F.date_format(ts, GRAIN_FORMAT["month"]))
        .otherwise(F.date_format(ts, GRAIN_FORMAT["year"]))
    )


def normalize_date_cell(ts: Column) -> Column:
    """``yyyy-MM-dd``, with ``HH:mm`` only where the clock is not midnight to the microsecond."""
    midnight = F.date_trunc("day", ts) == ts
    return F.when(midnight, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm"))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch for a wall clock read in UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")
