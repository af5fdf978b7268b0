"""Periods are ``yyyy-MM`` strings; these expressions build and take them apart."""

from __future__ import annotations

import calendar

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted spellings of a month are 2024-01, 2024/01, 01-2024,
# January 2024 and Jan 2024.
YEAR_FIRST = r"^\d{4}[-/](0[1-9]|1[0-2])$"
MONTH_FIRST = r"^(0[1-9]|1[0-2])-\d{4}$"
NAMED_MONTH = r"^[A-Za-z]{3,9} \d{4}$"
MONTH_NAMES = {
    name.lower(): f"{i:02d}" for names in (calendar.month_name, calendar.month_abbr) for i, name in enumerate(names) if name
}
CANONICAL_PERIOD = r"^\d{4}-\d{2}$"
OPEN_END = "9999-12"


def parse_period(value: Column) -> Column:
    """Any accepted spelling to ``yyyy-MM``; anything else is returned unchanged.

    The shape decides how the parts are cut out, so no date is parsed and no
    failed attempt is paid for.
    """
    text = F.trim(value)
    names = F.create_map(*[F.lit(part) for pair in MONTH_NAMES.items() for part in pair])
    named = names[F.lower(F.substring_index(text, " ", 1))]
    parsed = (
        F.when(text.rlike(YEAR_FIRST), F.concat(F.substring(text, 1, 4), F.lit("-"), F.substring(text, 6, 2)))
        .when(text.rlike(MONTH_FIRST), F.concat(F.substring(text, 4, 4), F.lit("-"), F.substring(text, 1, 2)))
        .when(text.rlike(NAMED_MONTH), F.concat(F.substring(text, -4, 4), F.lit("-"), named))
    )
    return F.coalesce(parsed, value)


def period_unparsed(raw: Column, parsed: Column) -> Column:
    """True where parsing left a non-canonical value, NULL included."""
    return F.coalesce(parsed.eqNullSafe(raw) & ~parsed.rlike(CANONICAL_PERIOD), F.lit(True))


def date_header_period(header: str) -> str:
    """Column header ``31/01/2024`` to ``2024-01``; headers are known while a plan is made, so no row is parsed."""
    _, month, year = header.split("/")
    return f"{year}-{month}"


def month_name_header_period(header: str) -> str:
    """Column header ``Jan-24`` to ``2024-01``: two-digit years mean 20xx."""
    name, year = header.split("-")
    return f"20{year}-{MONTH_NAMES[name.lower()]}"


def month_number_header(header: str) -> str:
    """Column header ``M3`` to ``03``."""
    return f"{int(header[1:]):02d}"


def period_start(period: Column) -> Column:
    """First day of the month, NULL when the period is not canonical."""
    return F.when(period.rlike(CANONICAL_PERIOD), F.try_to_date(period, "yyyy-MM"))


def period_key(period: Column) -> Column:
    """``2024-03`` to the integer 202403, NULL when not canonical."""
    return F.when(period.rlike(CANONICAL_PERIOD), F.replace(period, F.lit("-"), F.lit("")).try_cast("int"))


def period_year(period: Column) -> Column:
    return F.when(period.rlike(CANONICAL_PERIOD), F.substring(period, 1, 4).try_cast("int"))


def period_month(period: Column) -> Column:
    return F.when(period.rlike(CANONICAL_PERIOD), F.substring(period, 6, 2).try_cast("int"))
