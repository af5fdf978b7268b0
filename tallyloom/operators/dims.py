"""Conformed dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.identity import UNKNOWN_KEY, surrogate_key
from tallyloom.operators.lookup import latest_rates, with_base_rate


def dim_date(bounds: DataFrame, start: str = "first_month", end: str = "last_month") -> DataFrame:
    """One row per calendar month between the two dates of a one-row frame."""
    months = bounds.select(
        F.explode(
            F.sequence(F.trunc(F.col(start), "month"), F.trunc(F.col(end), "month"), F.expr("interval 1 month"))
        ).alias("_m")
    )
    return months.select(
        F.date_format("_m", "yyyyMM").cast("int").alias("date_sk"),
        F.date_format("_m", "yyyy-MM").alias("period_label"),
        F.month("_m").alias("month"),
        F.quarter("_m").alias("quarter"),
        F.year("_m").alias("year"),
    )


def month_bounds(df: DataFrame, date: str) -> DataFrame:
    return df.agg(F.min(F.to_date(date)).alias("first_month"), F.max(F.to_date(date)).alias("last_month"))


def dim_customer(customers: DataFrame, raw: str = "customer_name_raw") -> DataFrame:
    """One row per canonical customer.

    Spellings are reduced to distinct pairs first; a dimension row then states
    how many it has, the first of them, and the rule that matched. The full
    list of spellings is ``customer_spellings``, one row each.
    """
    pairs = customer_spellings(customers, raw)
    return pairs.groupBy("customer_name").agg(
        F.min("customer_name_raw").alias("customer_name_raw"),
        F.count("customer_name_raw").alias("spelling_count"),
        F.min("normalization_status").alias("normalization_status"),
        F.min("mapping_rule_id").alias("mapping_rule_id"),
    ).withColumn("customer_sk", surrogate_key("customer_name"))


def customer_spellings(customers: DataFrame, raw: str = "customer_name_raw") -> DataFrame:
    """Every raw spelling with its canonical name; the bridge under ``dim_customer``."""
    return customers.select(
        "customer_name", F.col(raw).alias("customer_name_raw"), "normalization_status", "mapping_rule_id"
    ).distinct()


def code_dim(df: DataFrame, code: str, name: str) -> DataFrame:
    """A code list (season, drop, fabric type, department) with surrogate keys."""
    return (
        df.select(F.trim(F.col(code)).alias(f"{name}_code"))
        .filter(F.coalesce(F.col(f"{name}_code"), F.lit("")) != "")
        .distinct()
        .withColumn(f"{name}_sk", surrogate_key(f"{name}_code"))
    )


def dim_currency(rates: DataFrame) -> DataFrame:
    """Currency reference with its current rate to the base currency."""
    complete = with_base_rate(rates)
    names = complete.groupBy("currency_code").agg(F.max("currency").alias("currency_name")) if (
        "currency" in complete.columns
    ) else complete.select("currency_code", F.lit(None).cast("string").alias("currency_name")).distinct()
    return latest_rates(complete).join(names, "currency_code", "left").select(
        surrogate_key("currency_code").alias("currency_sk"),
        "currency_code",
        "currency_name",
        F.col("rate_to_vnd").alias("exchange_rate_to_vnd"),
    )


def lookup_key(df: DataFrame, dim: DataFrame, on: str, natural: str, sk: str) -> DataFrame:
    """Foreign key by natural key; no partner means the Unknown member."""
    side = dim.select(F.col(natural).alias("_natural"), F.col(sk).alias("_sk"))
    return (
        df.join(side, F.col(on) == F.col("_natural"), "left")
        .withColumn(sk, F.coalesce(F.col("_sk"), F.lit(UNKNOWN_KEY).cast(dim.schema[sk].dataType)))
        .drop("_natural", "_sk")
    )


def unknown_keys(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keys of dimensions whose source column does not exist yet."""
    return df.withColumns({n: F.lit(UNKNOWN_KEY).cast("bigint") for n in names if n not in df.columns})
