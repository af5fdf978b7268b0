"""Worked examples of the row expressions."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.amounts import achievement, convert, is_zero_actual_lower, is_zero_target, to_amount
from tallyloom.functions.identity import row_digest, surrogate_key
from tallyloom.functions.periods import (
    date_header_period, month_name_header_period, month_number_header, parse_period, period_key, period_unparsed,
)
from tallyloom.functions.text import fill_sentinel, repair_ocr_digits, squeeze, title_case


def apply(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v"))).collect()]


def test_ocr(spark):
    values = ["1O2o", "N/O", "O", " 1,O00.5", None, "", "-o"]
    assert apply(spark, values, repair_ocr_digits) == ["1020", "N/O", "0", " 1,000.5", None, "", "-0"]


def test_periods(spark):
    values = ["2024-01", "2024/01", "January 2024", "01-2024", "Feb 2024", "may 2024", " 2024-03 ",
              "Q1 FY", "2024-13", "13-2024", "Foo 2024", None, "2024-1", "Sept 2024"]
    assert apply(spark, values, parse_period) == [
        "2024-01", "2024-01", "2024-01", "2024-01", "2024-02", "2024-05", "2024-03",
        "Q1 FY", "2024-13", "13-2024", "Foo 2024", None, "2024-1", "Sept 2024"]


def test_unparsed_period_is_reported(spark):
    failed = apply(spark, ["Q1", None, "2024-02", "Feb 2024"], lambda c: period_unparsed(c, parse_period(c)))
    assert failed == [True, True, False, False]


def test_header_periods(spark):
    assert date_header_period("31/01/2024") == "2024-01"
    assert [month_name_header_period(h) for h in ("Jan-24", "dec-24")] == ["2024-01", "2024-12"]
    assert [month_number_header(h) for h in ("M3", "M12")] == ["03", "12"]
    assert apply(spark, ["2024-03", "Q1", None], period_key) == [202403, None, None]


def test_title_case_matches_python(spark):
    names = ["o'brien", "anne-marie smith", "3m", "customer#000000001", "café bar", "a1b2c3", "x", "",
             "viet nam co.,ltd", "ông hoà", "don't stop"]
    assert apply(spark, names, title_case) == [n.title() for n in names]


def test_text(spark):
    assert apply(spark, ["  a \t b  ", None, ""], squeeze) == ["a b", None, ""]
    assert apply(spark, [" ", None, "x "], lambda c: fill_sentinel(c, "N/A")) == ["N/A", "N/A", "x"]


def test_amounts(spark):
    values = ["12.345678", " 7 ", "1,000", "12O", None, "-3.5", ""]
    assert apply(spark, values, to_amount) == [
        Decimal("12.3457"), Decimal("7.0000"), None, None, None, Decimal("-3.5000"), None]


@pytest.mark.parametrize(
    "actual, target, direction, expected",
    [
        ("0.09", "0.12", "LOWER", "1.333333"), ("0.15", "0.12", "LOWER", "0.800000"), ("0", "0.12", "LOWER", None),
        ("0.90", "0.85", "HIGHER", "1.058824"), ("0.75", "0.85", "HIGHER", "0.882353"),
        ("1500000", "1200000", "HIGHER", "1.250000"), ("900000", "1200000", "HIGHER", "0.750000"),
        ("3", "0", "LOWER", None), ("3", "0", "HIGHER", None), ("3", "4", "SIDEWAYS", None), (None, "4", "HIGHER", None),
    ],
)
def test_achievement(spark, actual, target, direction, expected):
    row = spark.range(1).select(
        achievement(F.lit(actual).cast("decimal(18,4)"), F.lit(target).cast("decimal(18,4)"), F.lit(direction)).alias("a"),
        is_zero_target(F.lit(target).cast("decimal(18,4)")).alias("z"),
        is_zero_actual_lower(F.lit(actual).cast("decimal(18,4)"), F.lit(target).cast("decimal(18,4)"), F.lit(direction)).alias("l"),
    ).first()
    assert row["a"] == (None if expected is None else Decimal(expected))
    assert row["z"] == (target == "0")
    assert row["l"] == (actual == "0" and target != "0")


def test_convert_rounds_half_up(spark):
    got = spark.range(1).select(
        convert(F.lit("10.0005").cast("decimal(18,4)"), F.lit("1.0").cast("decimal(18,6)")),
        convert(F.lit("0.0050").cast("decimal(18,4)"), F.lit("1.0").cast("decimal(18,6)")),
        convert(F.lit("99999999999999").cast("decimal(18,4)"), F.lit("999999").cast("decimal(18,6)")),
    ).first()
    assert list(got) == [Decimal("10.0000"), Decimal("0.0100"), None]


def test_digest_treats_null_as_empty(spark):
    df = spark.createDataFrame([(None, "b"), ("", "b"), ("b", None)], "x string, y string")
    first, second, third = [r[0] for r in df.select(row_digest(["x", "y"])).collect()]
    assert first == second != third
    assert all(0 <= r[0] < 2**60 for r in df.select(surrogate_key("x", "y")).collect())
