"""Financial costs, Bronze to Silver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.amounts import to_amount
from tallyloom.functions.periods import parse_period, period_unparsed
from tallyloom.functions.text import flag, repair_ocr_digits, squeeze
from tallyloom.operators.audit import Change, Issue, change_log, issue_log
from tallyloom.operators.dedup import flag_not_highest, keep_highest
from tallyloom.operators.lookup import (
    canonical_customers, convert_amounts, customer_mapping, flag_orphans, latest_rates, with_base_rate,
)
from tallyloom.operators.reshape import union_sources, unpivot_dates
from tallyloom.session import staged
from tallyloom.sources.tables import with_source

# Names of the two deliveries.
LONG_SOURCE = "financial_long_format.csv"
WIDE_SOURCE = "financial_wide_format.csv"
GRAIN = ("order_no", "category", "period")


def combine(long: DataFrame, wide: DataFrame) -> DataFrame:
    """Both layouts as one table, each row with its origin."""
    return union_sources(with_source(long, LONG_SOURCE), with_source(unpivot_dates(wide), WIDE_SOURCE))


def clean(combined: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Repair, normalise and type every row; values as delivered stay in ``*_raw``.

    All steps but the small mapping lookup are row expressions in one projection.
    """
    repaired = combined.select(
        *[c for c in combined.columns if c not in ("amount", "period", "category")],
        F.col("amount").alias("amount_raw"),
        repair_ocr_digits(F.col("amount")).alias("amount_repaired"),
        F.col("period").alias("period_raw"),
        parse_period(F.col("period")).alias("period"),
        F.initcap(squeeze(F.col("category"))).alias("category"),
        F.col("customer_name").alias("customer_name_raw"),
    )
    amount = F.trim(F.col("amount_repaired"))
    typed = repaired.withColumn("amount", amount).withColumn("amount_numeric", to_amount(F.col("amount")))
    typed = typed.withColumn(
        "IS_AMOUNT_UNPARSEABLE", flag(F.col("amount").isNotNull() & F.col("amount_numeric").isNull())
    )
    return canonical_customers(typed, mapping if mapping is not None else customer_mapping(combined.sparkSession))


def cleaning_log(cleaned: DataFrame, run_ts: str) -> DataFrame:
    """What the repair changed."""
    changes = [
        Change("amount", F.col("amount_raw"), F.col("amount_repaired"), "OCR_FIX"),
        Change("customer_name", F.col("customer_name_raw"), F.col("customer_name"), "CUSTOMER_NORM"),
    ]
    return change_log(cleaned, ["order_no", "SOURCE_FILE"], changes, run_ts)


def cleaning_issues(cleaned: DataFrame, run_ts: str) -> DataFrame:
    """What could not be cleaned."""
    issues = [
        Issue(
            period_unparsed(F.col("period_raw"), F.col("period")), "PERIOD_PARSE_FAIL", F.col("period_raw"),
            "not a known month format",
        ),
        Issue(F.col("IS_AMOUNT_UNPARSEABLE"), "AMOUNT_NOT_NUMERIC", F.col("amount"), "no number after repair"),
    ]
    return issue_log(cleaned, ["order_no", "category", "period", "SOURCE_FILE"], issues, run_ts)


def duplicate_log(cleaned: DataFrame, tiebreak: list[str] | None, run_ts: str) -> DataFrame:
    """The rows the deduplication leaves out."""
    flagged = flag_not_highest(cleaned, GRAIN, "amount_numeric", tiebreak)
    issues = [
        Issue(F.col("IS_DUPLICATE"), "DUPLICATE_DROP", F.col("amount"), "kept the row with the highest amount")
    ]
    return issue_log(flagged, ["order_no", "category", "period", "customer_name", "SOURCE_FILE"], issues, run_ts)


def conversion_log(silver: DataFrame, run_ts: str) -> DataFrame:
    issues = [
        Issue(
            F.col("IS_FX_CONVERSION_FAILED"), "FX_CONVERSION_FAILED", F.col("amount"),
            "no rate for the currency, or no amount",
        )
    ]
    return issue_log(silver, ["order_no", "category", "period", "currency", "SOURCE_FILE"], issues, run_ts)


# The columns of the Silver table.
SILVER_COLUMNS = (
    "order_no", "customer_name", "category", "period", "amount", "currency", "amount_numeric",
    "IS_AMOUNT_UNPARSEABLE", "IS_ORPHANED_ORDER", "IS_DUPLICATE", "converted_amount_vnd",
    "IS_FX_CONVERSION_FAILED", "SOURCE_FILE", "INGESTION_TS",
)


def conform(
    cleaned: DataFrame, orders: DataFrame, rates: DataFrame, tiebreak: list[str] | None, run_ts: str
) -> DataFrame:
    """Deduplicate, flag orphans, convert and stamp.

    Deduplication comes first: it shrinks a hot order to its few category
    months before the order join sees it.
    """
    single = keep_highest(cleaned, GRAIN, "amount_numeric", tiebreak or cleaned.columns).withColumn("IS_DUPLICATE", F.lit(False))
    flagged = flag_orphans(single, orders)
    converted = convert_amounts(flagged, latest_rates(with_base_rate(rates)))
    return converted.withColumn("INGESTION_TS", F.lit(run_ts).cast("timestamp"))


@dataclass(frozen=True)
class FinancialSilver:
    table: DataFrame
    changes: DataFrame
    issues: DataFrame


def silver_financial(
    long: DataFrame, wide: DataFrame, orders: DataFrame, rates: DataFrame, run_ts: str, tiebreak: list[str] | None = None
) -> FinancialSilver:
    """The Silver table with its change and issue logs.

    ``tiebreak`` names an input sequence, if the deliveries have one. Four
    outputs read the cleaned rows, so these are written once.
    """
    cleaned = staged(clean(combine(long, wide)), "financial-cleaned")
    conformed = conform(cleaned, orders, rates, tiebreak, run_ts)
    issue_columns = ["order_no", "SOURCE_FILE", "LOG_TYPE", "ORIGINAL_VALUE", "CORRECTED_VALUE", "DETAILS", "LOGGED_AT"]
    issues = union_sources(
        cleaning_issues(cleaned, run_ts).select(*issue_columns),
        duplicate_log(cleaned, tiebreak, run_ts).select(*issue_columns),
        conversion_log(conformed, run_ts).select(*issue_columns),
    )
    return FinancialSilver(conformed.select(*SILVER_COLUMNS), cleaning_log(cleaned, run_ts), issues)


def summary_counts() -> dict[str, Column]:
    """What a run reports of its Silver table, as aggregates."""
    return {
        "total_rows": F.count(F.lit(1)),
        "orphaned_orders": F.count_if("IS_ORPHANED_ORDER"),
        "fx_failed": F.count_if("IS_FX_CONVERSION_FAILED"),
        "unparseable_amounts": F.count_if("IS_AMOUNT_UNPARSEABLE"),
    }


def run_summary(silver: DataFrame) -> DataFrame:
    """Totals of the run in one aggregate."""
    return silver.agg(*[c.alias(name) for name, c in summary_counts().items()])
