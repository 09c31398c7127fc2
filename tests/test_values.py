import pytest
from pyspark.sql import functions as F, types as T

from tallymark.functions import dates as D, distributions as S, values as V

TEXT = T.StringType()


def read(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_numbers_as_written(spark):
    cases = {
        "$48,000": 48000, "12.5%": 12.5, "(1,200)": -1200, "-1,200.5": -1200.5, "+5": 5, "($5)": -5, "5€": 5, ".5": 0.5,
        "1.": 1, "1e3": 1000, "0x1F": 31, "0b101": 5, "0o17": 15, " 7 ": 7, "€ 1,234.50": 1234.5, "0": 0, "0.00": 0,
        "(5": None, "-(5)": None, "(-5)": None, "$5€": None, "$-5": None, "1d": None, "Infinity": None, "1e309": None,
        "1_000": None, "1,23": None, "1.234,56": None, "": None, "  ": None, "abc": None, "true": None, "NaN": None,
    }
    assert read(spark, list(cases), lambda c: V.to_number(c, TEXT)) == list(cases.values())


def test_missing_never_becomes_a_number(spark):
    blanks = [None, "", "  ", " ", "﻿", "\t\n"]
    assert read(spark, blanks, lambda c: V.is_missing(c, TEXT)) == [True] * 6
    assert read(spark, blanks, lambda c: V.to_number(c, TEXT)) == [None] * 6
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (0.0,)], "x double")
    assert [r.m for r in odd.select(V.is_missing(F.col("x"), T.DoubleType()).alias("m")).collect()] == [True, True, False]


def test_dates_in_one_frame(spark):
    cases = {
        "2024-01-31": "2024-01-31 00:00", "2024-1-5": "2024-01-05 00:00", "2024-03-01T00:30": "2024-03-01 00:30",
        "2024-03-01T00:30:00Z": "2024-03-01 00:30", "2024-03-01T00:30:00+04:00": "2024-02-29 20:30",
        "12/31/2024": "2024-12-31 00:00", "3.1.24": "2024-03-01 00:00", "12-31-75": "1975-12-31 00:00",
        "Jan 5, 2024": "2024-01-05 00:00", "january 5 2024": "2024-01-05 00:00", "5 Sep 2024": "2024-09-05 00:00",
        "2024-02-30": None, "13/13/2024": None, "7": None, "2024": None, "5 Foo 2024": None,
    }
    got = read(spark, list(cases), lambda c: F.date_format(D.to_date(c, TEXT), "yyyy-MM-dd HH:mm"))
    assert got == list(cases.values())


def test_tiny_values_keep_their_digits(spark):
    df = spark.createDataFrame([(0.000012345,), (1.23456,), (0.0,), (-0.00001,)], "x double")
    assert [r.y for r in df.select(V.round_sig(F.col("x")).alias("y")).collect()] == [1.235e-05, 1.2346, 0.0, -1e-05]


def test_numbers_print_as_people_write_them(spark):
    df = spark.createDataFrame([(48000.0,), (0.5,), (1e-5,), (12345678.25,), (1e21,), (1.25e-7,)], "x double")
    assert [r.y for r in df.select(V.number_text(F.col("x")).alias("y")).collect()] == [
        "48000", "0.5", "0.00001", "12345678.25", "1e+21", "1.25e-7"]


def test_weaken_stops_at_the_lowest_rung(spark):
    assert read(spark, ["strong", "weak", "odd"], lambda c: V.weaken(c, F.lit(2))) == ["weak", "negligible", "odd"]


@pytest.mark.parametrize("n,confidence,expected", [
    (2, 0.95, 12.706), (6, 0.95, 2.571), (31, 0.95, 2.042), (2, 0.99, 63.657), (3, 0.99, 9.925)])
def test_t_table(spark, n, confidence, expected):
    row = spark.range(1).select(S.student_critical(F.lit(float(n - 1)), confidence).alias("t")).first()
    assert row.t == pytest.approx(expected, abs=5e-4)


def test_tails(spark):
    row = spark.range(1).select(
        S.chi_square_tail(F.lit(3.841458821), F.lit(1)).alias("c"), S.student_tail(F.lit(0.0), F.lit(5.0)).alias("z"),
        S.ks_tail(F.lit(0.0), F.lit(5.0), F.lit(5.0)).alias("k")).first()
    assert row.c == pytest.approx(0.05, abs=1e-9) and row.z == pytest.approx(1.0) and row.k == 1.0


def test_long_radix_cells_are_numbers(spark):
    cells = ["0x" + "f" * 40, "0b" + "1" * 70, "0o17", "0x1F", "0xg", "0x" + "f" * 400]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "k int, c string")
    found = {r.k: r.x for r in df.select("k", V.to_number(F.col("c"), TEXT).alias("x")).collect()}
    assert [found[k] for k in range(6)] == [float(16 ** 40), float(2 ** 70), 15.0, 31.0, None, None]


def test_half_day_clocks_are_dates(spark):
    cells = ["2024-03-01 10:00 PM", "2024-03-01 12:05 am", "2024-3-1T9:30:15 AM", "2024-02-30 10:00 PM", "2024-03-01 22:00"]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "k int, c string")
    found = {r.k: str(r.d) for r in df.select("k", D.to_date(F.col("c"), TEXT).alias("d")).collect()}
    assert [found[k] for k in range(5)] == [
        "2024-03-01 22:00:00", "2024-03-01 00:05:00", "2024-03-01 09:30:15", "None", "2024-03-01 22:00:00"]


def test_only_midnight_itself_drops_the_clock(spark):
    cells = ["2024-01-05 00:00:00", "2024-01-05 00:00:00.25", "2024-01-05 00:00:00.000001", "2024-01-05 00:00:07", "2024-01-05 13:30:00", None]
    got = read(spark, cells, lambda c: D.normalize_date_cell(c.cast("timestamp_ntz")))
    assert got == ["2024-01-05", "2024-01-05 00:00", "2024-01-05 00:00", "2024-01-05 00:00", "2024-01-05 13:30", None]
