"""Exact decimal arithmetic: amounts, rates, conversion and achievement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT = "decimal(18,4)"
RATE = "decimal(18,6)"
RATIO = "decimal(18,6)"


def to_amount(text: Column) -> Column:
    """Text to decimal, NULL when it is no plain number (a thousands comma is not)."""
    return F.trim(text).try_cast(AMOUNT)


def to_rate(text: Column) -> Column:
    return F.trim(text.cast("string")).try_cast(RATE)


def convert(amount: Column, rate: Column) -> Column:
    """Amount in the base currency, rounded half up to two places."""
    return F.round(amount * rate, 2).try_cast(AMOUNT)


def achievement(actual: Column, target: Column, direction: Column) -> Column:
    """Actual against target as a ratio where above one is good.

    A zero target, a zero actual of a lower-is-better KPI and an unknown
    direction have no ratio.
    """
    aim = F.upper(F.trim(direction))
    ratio = (
        F.when(aim == "LOWER", F.try_divide(target, actual))
        .when(aim == "HIGHER", F.try_divide(actual, target))
    )
    return F.when(target != 0, ratio).try_cast(RATIO)


def is_zero_target(target: Column) -> Column:
    return F.coalesce(target == 0, F.lit(False))


def is_zero_actual_lower(actual: Column, target: Column, direction: Column) -> Column:
    """A lower-is-better KPI that reached zero: undefined ratio, for review."""
    return F.coalesce((F.upper(F.trim(direction)) == "LOWER") & (actual == 0) & (target != 0), F.lit(False))
