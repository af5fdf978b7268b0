"""Wide layouts to one row per month, field mapping and schema-tolerant union."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.periods import date_header_period, month_name_header_period, month_number_header

# Header patterns of the month columns.
DATE_HEADER = r"\d{2}/\d{2}/\d{4}"
MONTH_NUMBER_HEADER = r"M([1-9]|1[0-2])"
MONTH_NAME_HEADER = r"[A-Za-z]{3}-\d{2}"


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    """Columns whose whole name matches the pattern, in schema order."""
    return [c for c in df.columns if re.fullmatch(pattern, c)]


def _unpivot(df: DataFrame, pattern: str, period: str, value: str, to_period: Callable[[str], str]) -> DataFrame:
    """Month columns are renamed to their period first, so the period column is the renamed header."""
    months = columns_like(df, pattern)
    if not months:
        raise ValueError(f"no column matches {pattern!r}")
    ids = [F.col(f"`{c}`") for c in df.columns if c not in months]
    named = df.select(*ids, *[F.col(f"`{c}`").alias(to_period(c)) for c in months])
    return named.unpivot(ids, [F.col(f"`{to_period(c)}`") for c in months], period, value)


def unpivot_dates(df: DataFrame, period: str = "period", value: str = "amount") -> DataFrame:
    """``dd/MM/yyyy`` columns to rows; empty cells are dropped (the layout is sparse).

    Only given cells become rows: a row is not expanded to all of its months first. Cells are exploded, not inlined:
    of an explode Spark knows that it makes no rows of none, so a source that a filter leaves out goes from the plan.
    """
    months = columns_like(df, DATE_HEADER)
    if not months:
        raise ValueError(f"no column matches {DATE_HEADER!r}")
    ids = [F.col(f"`{c}`") for c in df.columns if c not in months]
    cells = [F.when(F.col(f"`{c}`").isNotNull(), F.struct(F.lit(date_header_period(c)).alias(period), F.col(f"`{c}`").alias(value))) for c in months]
    given = df.select(*ids, F.explode(F.array_compact(F.array(*cells))).alias("_cell"))
    return given.select(*ids, *[F.col("_cell").getField(c).alias(c) for c in (period, value)])


def unpivot_month_names(df: DataFrame, period: str = "PERIOD", value: str = "actual_value") -> DataFrame:
    """``Jan-24`` columns to rows; empty cells stay as missing months."""
    return _unpivot(df, MONTH_NAME_HEADER, period, value, month_name_header_period)


def unpivot_month_numbers(
    df: DataFrame, year: int | str, period: str = "PERIOD", value: str = "actual_value"
) -> DataFrame:
    """``M1..M12`` columns to rows; ``year`` is one year, or the column that has it. Empty cells stay as missing months."""
    tall = _unpivot(df, MONTH_NUMBER_HEADER, period, value, month_number_header)
    of = F.col(year).cast("string") if isinstance(year, str) else F.lit(str(year))
    tall = tall.withColumn(period, F.concat_ws("-", F.lpad(of, 4, "0"), F.col(period)))
    return tall.drop(year) if isinstance(year, str) else tall


def map_fields(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Source field to business name; a source field that is absent gives NULL."""
    return df.select(
        *[
            (F.col(source) if source in df.columns else F.lit(None).cast("string")).alias(target)
            for source, target in mapping.items()
        ]
    )


def union_sources(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union by name; a column missing on one side is NULL there."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
