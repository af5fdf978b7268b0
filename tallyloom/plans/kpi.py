"""KPI actuals, Bronze to Silver."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.amounts import to_amount
from tallyloom.functions.identity import row_digest
from tallyloom.functions.text import repair_ocr_digits, squeeze
from tallyloom.operators.audit import Change, Issue, change_log, issue_log
from tallyloom.operators.dedup import flag_repeats, keep_first_equal, repeat_log, summary_of_keys
from tallyloom.operators.lookup import match_master
from tallyloom.operators.reconcile import KPI_KEY, fill_kpi_sentinels, reconcile_drops, reconcile_sources
from tallyloom.operators.reshape import (
    MONTH_NAME_HEADER, MONTH_NUMBER_HEADER, columns_like, unpivot_month_names, unpivot_month_numbers,
)
from tallyloom.session import staged
from tallyloom.sources.tables import with_source

# Names of the two deliveries.
LONG_SOURCE = "kpi_actual_long.csv"
WIDE_SOURCE = "kpi_actual_wide.csv"

YEAR = "Year"

# The casing rule per column; columns not named keep their case.
CASING = {"Pillar": F.upper}

# The columns whose change makes a Silver row a different one.
HASH_COLUMNS = (
    "PILLAR_ID", "SP_ID", "UA_ID", "Pillar", "Sub_Pillar", "Department", "KPI_Name", "Sub_KPI_Type", "Unit",
    "PERIOD", "actual_value",
)


def value_columns(df: DataFrame) -> list[str]:
    """Month columns of either layout, and the target where there is one."""
    months = columns_like(df, MONTH_NUMBER_HEADER) + columns_like(df, MONTH_NAME_HEADER)
    return months + [c for c in ("Target",) if c in df.columns]


def year_columns(df: DataFrame) -> list[str]:
    """The year of a delivery with numbered months, if it has several."""
    return [c for c in (YEAR,) if c in df.columns]


def normalise(column: str, casing: Mapping[str, Callable[[Column], Column]] = CASING) -> Column:
    text = squeeze(F.col(column))
    return casing[column](text) if column in casing else text


def _raw(column: str) -> str:
    return f"_raw_{column}"


def clean(
    delivered: DataFrame, source: str, casing: Mapping[str, Callable[[Column], Column]] = CASING
) -> DataFrame:
    """Row id, repaired values and normalised key columns in one projection.

    The row id is taken before cleaning. Delivered values stay in ``_raw_*``.
    ``casing`` maps key columns to ``F.upper``, ``F.lower`` or ``F.initcap``.
    """
    values = value_columns(delivered)
    keys = [c for c in KPI_KEY if c in delivered.columns]
    rest = [c for c in delivered.columns if c not in values and c not in keys]
    return with_source(
        delivered.select(
            row_digest([*KPI_KEY, *year_columns(delivered)]).alias("ROW_ID"),
            *[F.col(f"`{c}`") for c in rest],
            *[normalise(c, casing).alias(c) for c in keys],
            *[repair_ocr_digits(F.col(f"`{c}`")).alias(c) for c in values],
            *[F.col(f"`{c}`").alias(_raw(c)) for c in (*keys, *values)],
        ),
        source,
    )


def cleaning_log(cleaned: DataFrame, run_ts: str) -> DataFrame:
    """Every changed cell, repaired numbers and normalised text alike."""
    numbers = [Change(c, F.col(f"`{_raw(c)}`"), F.col(f"`{c}`"), "OCR_FIX") for c in value_columns(cleaned)]
    texts = [Change(c, F.col(_raw(c)), F.col(c), "NORMALISE") for c in KPI_KEY if c in cleaned.columns]
    return change_log(cleaned, ["ROW_ID", "SOURCE_FILE"], [*numbers, *texts], run_ts)


def _without_raw(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_raw_")])


def compared_columns(df: DataFrame) -> list[str]:
    return [*KPI_KEY, *year_columns(df), *value_columns(df)]


def deduplicate(cleaned: DataFrame) -> DataFrame:
    """One of each set of equal rows. Equal rows differ at most in how they were spelled."""
    columns = compared_columns(cleaned)
    return keep_first_equal(_without_raw(cleaned), columns, ["ROW_ID"]).withColumn("IS_DUPLICATE", F.lit(False))


def duplicate_log(cleaned: DataFrame, sequence: list[str] | None, run_ts: str) -> DataFrame:
    columns = compared_columns(cleaned)
    flagged = flag_repeats(cleaned, columns, sequence)
    return repeat_log(flagged, ["ROW_ID", "SOURCE_FILE"], columns, run_ts)


def duplicate_summary(cleaned: DataFrame) -> DataFrame:
    return summary_of_keys(cleaned, compared_columns(cleaned))


def typed(tall: DataFrame) -> DataFrame:
    """Values and targets as decimals. A value that is no number keeps its text and a flag."""
    text = F.trim(F.col("actual_value"))
    kept = tall.select(
        *[c for c in tall.columns if c != "actual_value"],
        to_amount(text).alias("actual_value"),
        F.when((text != "") & to_amount(text).isNull(), text).alias("unparsed_text"),
    )
    kept = kept.withColumn("IS_VALUE_UNPARSEABLE", F.col("unparsed_text").isNotNull())
    if "Target" not in kept.columns:
        return kept.withColumn("Target", F.lit(None).cast("decimal(18,4)"))
    return kept.withColumn("Target", to_amount(F.col("Target")))


def at_month_grain(long: DataFrame, wide: DataFrame, year: int | str) -> list[DataFrame]:
    """Both deliveries as typed rows of one month each, the leading one first."""
    return [typed(unpivot_month_numbers(deduplicate(long), year)), typed(unpivot_month_names(deduplicate(wide)))]


def unify(long: DataFrame, wide: DataFrame, year: int | str) -> DataFrame:
    """Both deliveries at month grain, settled against each other; the long one leads."""
    return reconcile_sources(at_month_grain(long, wide, year), text="unparsed_text").select(
        *KPI_KEY, "Target", "SOURCE_FILE", "actual_value", "unparsed_text", "PERIOD", "IS_DUPLICATE", "IS_CONFLICT", "IS_VALUE_UNPARSEABLE"
    )


def value_issues(tall: DataFrame, run_ts: str) -> DataFrame:
    """One row per delivered value that is no number."""
    issue = Issue(F.col("IS_VALUE_UNPARSEABLE"), "VALUE_NOT_NUMERIC", F.col("unparsed_text"), "no number after repair")
    return issue_log(fill_kpi_sentinels(tall), [*KPI_KEY, "PERIOD", "SOURCE_FILE"], [issue], run_ts)


def dropped_between_sources(long: DataFrame, wide: DataFrame, year: int | str, run_ts: str) -> DataFrame:
    """Rows that the other delivery, or an equal row, made superfluous."""
    return reconcile_drops(at_month_grain(long, wide, year), run_ts, text="unparsed_text").select(
        *KPI_KEY, "PERIOD", "SOURCE_FILE", "Target", "actual_value", "LOG_TYPE", "LOGGED_AT"
    )


@dataclass(frozen=True)
class KpiSilver:
    table: DataFrame
    changes: DataFrame
    duplicates: DataFrame
    issues: DataFrame
    dropped: DataFrame


def conform(long: DataFrame, wide: DataFrame, master: DataFrame, year: int | str, in_force: bool = True) -> DataFrame:
    """Reconcile cleaned deliveries, match them to the master version in force, hash."""
    matched = match_master(unify(long, wide, year), fill_kpi_sentinels(master), "PERIOD" if in_force else None)
    return matched.withColumn("ROW_HASH", row_digest([c for c in HASH_COLUMNS if c in matched.columns]))


def silver_kpi_table(long: DataFrame, wide: DataFrame, master: DataFrame, year: int | str) -> DataFrame:
    """The Silver table alone, straight from the deliveries."""
    return conform(clean(long, LONG_SOURCE), clean(wide, WIDE_SOURCE), master, year)


def silver_kpi(
    long: DataFrame, wide: DataFrame, master: DataFrame, year: int | str, run_ts: str, sequence: list[str] | None = None
) -> KpiSilver:
    """The Silver table with its change log and the log of dropped repeats.

    ``sequence`` names an input sequence, if the deliveries have one. Three outputs read the cleaned rows, so these are written once.
    """
    cleaned = [staged(clean(long, LONG_SOURCE), "kpi-long"), staged(clean(wide, WIDE_SOURCE), "kpi-wide")]
    changes = [cleaning_log(c, run_ts) for c in cleaned]
    repeats = [duplicate_log(c, sequence, run_ts) for c in cleaned]
    return KpiSilver(
        conform(*cleaned, master, year),
        changes[0].unionByName(changes[1]),
        repeats[0].unionByName(repeats[1]),
        _both_issues(cleaned, year, run_ts),
        dropped_between_sources(*cleaned, year, run_ts),
    )


def _both_issues(cleaned: list[DataFrame], year: int | str, run_ts: str) -> DataFrame:
    long, wide = at_month_grain(*cleaned, year)
    return value_issues(long, run_ts).unionByName(value_issues(wide, run_ts))
