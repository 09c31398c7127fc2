"""How one cell is read: missing, number, text, kind, and the text of a number.

Every function takes a Column and, where the rule depends on it, the Spark type
of that column, and returns a Column. Nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# --- fixed values -----------------------------------------------------------
# White space trimmed from text: ASCII blanks, every Unicode space or line
# separator, and the byte-order mark.
BLANKS = (
    "\t\n\x0b\x0c\r              "
    "    　﻿"
)
PLAIN_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
RADIX_NUMBER = r"^0(?:[xX][0-9a-fA-F]+|[oO][0-7]+|[bB][01]+)$"
# Digits group in threes only; a currency mark on one side; brackets come in
# pairs and hold no sign.
_DIGITS = r"(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?"
_MARKED = rf"(?:\p{{Sc}}\s*{_DIGITS}\s*%?|{_DIGITS}\s*%?\s*\p{{Sc}}?)"
FORMATTED_NUMBER = rf"^(?:\(\s*{_MARKED}\s*\)|(?:[+-]\s*)?{_MARKED})$"
# What a number or a date can start with; anything else needs no further look.
NUMBER_START = r"^[0-9.+\-(\p{Sc}]"
DATE_START = r"^(?:[0-9]|(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))"
NUMBER_FORMATS = ("negated parentheses", "currency", "percent", "thousands")
MONTHS = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
KIND_DATE_SHAPES = (
    r"^\d{4}-\d{2}-\d{2}([T ].*)?$",
    r"^\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}$",
    rf"(?i)^{MONTHS}[a-z]* \d{{1,2}},? \d{{4}}$",
)
KINDS = ("numeric", "date", "boolean", "text")
STRENGTHS = ("very strong", "strong", "moderate", "weak", "negligible")
CORRELATION_STEPS = (0.9, 0.7, 0.5, 0.3)
EFFECT_STEPS = (1.2, 0.8, 0.5, 0.2)
ASSOCIATION_STEPS = (("strong", 0.5), ("moderate", 0.3), ("weak", 0.1))
GRADES = (("A", 90), ("B", 80), ("C", 70), ("D", 60))
CELL_CHARS = 160
# ----------------------------------------------------------------------------

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_numeric_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC)


def is_time_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, TIMES)


def trimmed(text: Column) -> Column:
    """Trims BLANKS; text whose first and last characters are plain ASCII is passed through untouched."""
    first, last = F.ascii(text), F.ascii(F.right(text, F.lit(1)))
    edged = (first <= 32) | (first >= 128) | (last <= 32) | (last >= 128)
    return F.when(edged, F.btrim(text, F.lit(BLANKS))).otherwise(text)


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def is_missing(c: Column, dtype: T.DataType) -> Column:
    """Null, a number that is not finite, or blank text."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return _finite(c.cast("double")).isNull()
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return F.coalesce(trimmed(c) == "", F.lit(True))
    return c.isNull()


def _bounded(x: Column) -> Column:
    """Text past the range of a double reads as infinite, which is not an observation."""
    inf = float("inf")
    return F.nullif(F.nullif(x, F.lit(inf)), F.lit(-inf))


def _digits(t: Column) -> Column:
    return F.concat(F.when(t.rlike("^[(-]"), "-").otherwise(""), F.regexp_replace(t, "[^0-9.]", ""))


def parse_formatted(t: Column) -> Column:
    """``$48,000`` is 48000, ``12.5%`` is 12.5 and ``(1,200)`` is -1200; takes trimmed text."""
    return _bounded(F.when(t.rlike(FORMATTED_NUMBER), _digits(t)).try_cast("double"))


def to_number(c: Column, dtype: T.DataType) -> Column:
    """A finite double or null. Booleans and dates are never numbers."""
    if is_numeric_type(dtype):
        x = c.cast("double")
        return _finite(x) if isinstance(dtype, (T.FloatType, T.DoubleType)) else x
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return number_trimmed(trimmed(c))
    return F.lit(None).cast("double")


def number_trimmed(t: Column) -> Column:
    """The number in trimmed text; what cannot start one is not looked at further."""
    return F.when(t.rlike(NUMBER_START), number_from(t))


def _folded(digits: Column, base: int) -> Column:
    """The double that digits of a base spell, however many there are."""
    each = F.filter(F.split(F.lower(digits), ""), lambda d: d != "")
    return F.aggregate(each, F.lit(0.0), lambda x, d: x * base + F.position(d, F.lit("0123456789abcdef")) - 1)


def number_from(t: Column) -> Column:
    """The number in trimmed text: plain, formatted, or with a radix prefix.

    Gated by pattern, as a bare cast would also take ``1d`` and ``Infinity``.
    """
    rest = F.substring(t, 3, 1 << 30)
    radix = (F.when(t.rlike("^0[xX]"), _folded(rest, 16)).when(t.rlike("^0[oO]"), _folded(rest, 8))
             .otherwise(_folded(rest, 2)))
    plain = F.when(t.rlike(PLAIN_NUMBER), t).when(t.rlike(FORMATTED_NUMBER), _digits(t))
    return _bounded(F.when(t.rlike(RADIX_NUMBER), radix).otherwise(plain.try_cast("double")))


def format_marks(t: Column) -> list[Column]:
    return [t.startswith("("), t.rlike(r"\p{Sc}"), t.contains("%"), t.contains(",")]


def format_flags(c: Column, dtype: T.DataType) -> list[Column]:
    """For one cell, which notations were read through, in the order of NUMBER_FORMATS."""
    if not isinstance(dtype, T.StringType):
        return [F.lit(False)] * len(NUMBER_FORMATS)
    t = trimmed(c)
    read_through = F.coalesce(t.rlike(FORMATTED_NUMBER) & ~t.rlike(PLAIN_NUMBER), F.lit(False))
    return [read_through & mark for mark in format_marks(t)]


def number_formats(c: Column, dtype: T.DataType) -> Column:
    """Aggregate: the notations a column used, in fixed order."""
    flags = format_flags(c, dtype)
    named = [F.when(F.bool_or(flag), F.lit(name)) for name, flag in zip(NUMBER_FORMATS, flags)]
    return F.filter(F.array(*named), lambda name: name.isNotNull())


def number_text(x: Column) -> Column:
    """A double as people write it: ``48000`` and ``0.000012``, not ``48000.0`` or ``1.2E-5``."""
    size = F.abs(x)
    decimal = F.regexp_replace(x.cast("decimal(38,16)").cast("string"), r"\.?0+$", "")
    exponent = F.regexp_replace(F.regexp_replace(x.cast("string"), r"\.0E|E", "e"), r"e(\d)", "e+$1")
    return (
        F.when((x == F.floor(x)) & (size < 1e15), x.cast("long").cast("string"))
        .when((size >= 1e-3) & (size < 1e7), x.cast("string"))
        .when((size >= 1e-6) & (size < 1e21), decimal)
        .otherwise(exponent)
    )


def iso_instant(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def text_of(c: Column, dtype: T.DataType) -> Column:
    """The level text of a present cell."""
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return number_text(c.cast("double"))
    if is_time_type(dtype):
        return iso_instant(c)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def level_of(c: Column, dtype: T.DataType) -> Column:
    """Level text, null where the cell is missing."""
    return F.when(~is_missing(c, dtype), text_of(c, dtype))


def classify_value(c: Column, dtype: T.DataType) -> Column:
    """missing / numeric / date / boolean / text."""
    missing = F.when(is_missing(c, dtype), F.lit("missing"))
    if is_numeric_type(dtype):
        return missing.otherwise("numeric")
    if is_time_type(dtype):
        return missing.otherwise("date")
    if isinstance(dtype, T.BooleanType):
        return missing.otherwise("boolean")
    if isinstance(dtype, T.StringType):
        t = trimmed(c)
        dated = t.rlike(KIND_DATE_SHAPES[0]) | t.rlike(KIND_DATE_SHAPES[1]) | t.rlike(KIND_DATE_SHAPES[2])
        return missing.when(to_number(c, dtype).isNotNull(), "numeric").when(dated, "date").otherwise("text")
    return missing.otherwise("text")


def clamp(x: Column, low: float, high: float) -> Column:
    """``x`` kept inside its range; null stays null, which ``greatest`` and ``least`` alone would skip."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def coverage_pct(part: Column, whole: Column) -> Column:
    """100 part/whole with one decimal, 0 where there is nothing to cover."""
    return F.when(whole > 0, F.round(part / whole * 100, 1)).otherwise(F.lit(0.0))


def round_sig(x: Column, digits: int = 4) -> Column:
    """``digits`` decimals, or that many significant digits where those would erase the value."""
    fixed = F.round(x, digits)
    kept = F.format_string(f"%.{digits - 1}e", x).try_cast("double")
    return F.when(_finite(x).isNull(), F.lit(None).cast("double")).when((fixed == 0) & (x != 0), kept).otherwise(fixed)


def _ladder(size: Column, steps) -> Column:
    out = None
    for name, floor in steps:
        out = (F if out is None else out).when(size >= floor, F.lit(name))
    return out


def correlation_strength(r: Column) -> Column:
    return _ladder(F.abs(r), zip(STRENGTHS, CORRELATION_STEPS)).otherwise(STRENGTHS[-1])


def effect_strength(d: Column) -> Column:
    return _ladder(F.abs(d), zip(STRENGTHS, EFFECT_STEPS)).otherwise(STRENGTHS[-1])


def association_strength(v: Column) -> Column:
    return _ladder(v, ASSOCIATION_STEPS).otherwise(STRENGTHS[-1])


def strength_rank(strength: Column) -> Column:
    """0 for the strongest; unknown words come last."""
    at = F.array_position(F.array(*map(F.lit, STRENGTHS)), strength)
    return F.when(at > 0, at - 1).otherwise(len(STRENGTHS))


def weaken(strength: Column, steps: Column) -> Column:
    """Move down the ladder; the lowest rung and unknown words stay."""
    at = strength_rank(strength)
    names = F.array(*map(F.lit, STRENGTHS))
    moved = F.try_element_at(names, F.least(at + 1 + steps, F.lit(len(STRENGTHS))).cast("int"))
    return F.when((at == len(STRENGTHS)) | (steps <= 0), strength).otherwise(moved)


def delta(current: Column, baseline: Column) -> Column:
    return round_sig(current - baseline)


def delta_pct(current: Column, baseline: Column) -> Column:
    return round_sig(F.try_divide(current - baseline, F.abs(baseline)) * 100, 1)


def health_grade(score: Column) -> Column:
    return _ladder(score, GRADES).otherwise("F")


def safe_cell(text: Column) -> Column:
    """Display text, at most 160 characters with an ellipsis."""
    cut = F.concat(F.substring(text, 1, CELL_CHARS - 1), F.lit("…"))
    return F.when(F.length(text) > CELL_CHARS, cut).otherwise(text)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
