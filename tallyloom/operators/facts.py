"""Fact tables at their declared grain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.amounts import AMOUNT
from tallyloom.functions.identity import UNKNOWN_KEY, surrogate_key
from tallyloom.functions.periods import period_key, period_month, period_year
from tallyloom.operators.dims import lookup_key, unknown_keys
from tallyloom.operators.spread import keep_first


def fact_order_cost(silver: DataFrame, dates: DataFrame, currencies: DataFrame) -> DataFrame:
    """One row per order, cost category and month, with dimension keys.

    The customer dimension is built from the same names, so its key, a function of the name, needs no lookup.
    """
    keyed = lookup_key(silver, dates, "period", "period_label", "date_sk")
    keyed = lookup_key(keyed, currencies, "currency", "currency_code", "currency_sk")
    customer = F.when(F.col("customer_name").isNull(), F.lit(UNKNOWN_KEY).cast("bigint")).otherwise(surrogate_key("customer_name"))
    keyed = keyed.withColumn("customer_sk", customer)
    keyed = unknown_keys(keyed, ["season_sk", "drop_sk", "fabric_type_sk"])
    return keyed.select(
        surrogate_key("order_no", "category", "period").alias("fact_sk"),
        "order_no",
        "category",
        "date_sk",
        "customer_sk",
        "currency_sk",
        "season_sk",
        "drop_sk",
        "fabric_type_sk",
        F.col("amount_numeric").alias("amount_original"),
        "converted_amount_vnd",
        F.col("IS_ORPHANED_ORDER").alias("is_orphaned"),
        F.col("INGESTION_TS").alias("ingestion_ts"),
        period_year(F.col("period")).alias("year"),
        period_month(F.col("period")).alias("month"),
    )


def fact_kpi_actual(silver: DataFrame, source_order: list[str]) -> DataFrame:
    """One row per KPI, month and unit of the matched Silver rows.

    Where sources conflict, Silver keeps all of them; the fact takes a row with a number before one without,
    then the first source of ``source_order``, and carries the conflict flag. A month whose only value is no
    number is not missing: it is flagged.
    """
    rank = F.coalesce(*[F.when(F.col("SOURCE_FILE") == s, F.lit(i)) for i, s in enumerate(source_order)], F.lit(len(source_order)))
    matched = silver.filter(~F.col("IS_ORPHANED")).withColumn("_rank", rank)
    one = keep_first(matched, ["UA_ID", "PERIOD", "Unit"], [F.col("actual_value").isNull(), F.col("_rank"), F.col("ROW_HASH")])
    return one.select(
        surrogate_key("UA_ID", "PERIOD", "Unit").alias("fact_sk"),
        surrogate_key("UA_ID", "Valid_From").alias("kpi_sk"),
        period_key(F.col("PERIOD")).alias("date_sk"),
        "UA_ID",
        F.col("PERIOD"),
        F.col("Unit").alias("unit"),
        F.col("Aggregation_Method").alias("aggregation_method"),
        F.col("actual_value").cast(AMOUNT).alias("actual_value"),
        F.col("Target").cast(AMOUNT).alias("row_target"),
        (F.col("actual_value").isNull() & ~F.col("IS_VALUE_UNPARSEABLE")).alias("is_missing_actual"),
        F.col("IS_VALUE_UNPARSEABLE").alias("is_value_unparseable"),
        F.col("IS_CONFLICT").alias("is_conflict"),
        "ROW_HASH",
        period_year(F.col("PERIOD")).alias("year"),
        period_month(F.col("PERIOD")).alias("month"),
    )
