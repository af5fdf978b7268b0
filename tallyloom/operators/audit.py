"""Change and issue logs.

A cleaning step keeps the value it replaced next to the new one. The log is
then one pass over that frame: an array of candidate changes per row, filtered
and exploded, instead of one scan and union per column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import blank_if_null


@dataclass(frozen=True)
class Change:
    """One column to compare: its name in the log, the two values, the log type."""

    column: str
    before: Column
    after: Column
    log_type: str


def is_changed(before: Column, after: Column) -> Column:
    """NULL and empty text count as equal."""
    return blank_if_null(before) != blank_if_null(after)


def change_log(df: DataFrame, keep: Sequence[str], changes: Sequence[Change], run_ts: str) -> DataFrame:
    """One row per changed cell."""
    entries = F.array(
        *[
            F.struct(
                F.lit(c.column).alias("COLUMN_NAME"),
                c.before.cast("string").alias("ORIGINAL_VALUE"),
                c.after.cast("string").alias("CORRECTED_VALUE"),
                F.lit(c.log_type).alias("LOG_TYPE"),
            )
            for c in changes
        ]
    )
    changed = F.filter(entries, lambda e: is_changed(e["ORIGINAL_VALUE"], e["CORRECTED_VALUE"]))
    return df.select(*keep, F.inline(changed)).withColumn("LOGGED_AT", F.lit(run_ts).cast("timestamp"))


@dataclass(frozen=True)
class Issue:
    """A row-level finding: when it holds, its type, the offending value and the reason."""

    when: Column
    log_type: str
    value: Column
    details: str


def issue_log(df: DataFrame, keep: Sequence[str], issues: Sequence[Issue], run_ts: str) -> DataFrame:
    """One row per finding, all findings of a row from the same pass."""
    entries = F.array(
        *[
            F.when(
                i.when,
                F.struct(
                    F.lit(i.log_type).alias("LOG_TYPE"),
                    i.value.cast("string").alias("ORIGINAL_VALUE"),
                    F.lit(None).cast("string").alias("CORRECTED_VALUE"),
                    F.lit(i.details).alias("DETAILS"),
                ),
            )
            for i in issues
        ]
    )
    return df.select(*keep, F.inline(F.array_compact(entries))).withColumn(
        "LOGGED_AT", F.lit(run_ts).cast("timestamp")
    )
