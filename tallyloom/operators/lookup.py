"""Joins against reference data.

None of these force a broadcast. Spark broadcasts a side whose size, from file
statistics or measured at run time, is under the threshold, and otherwise sorts
and merges with skewed partitions split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.amounts import convert, to_rate
from tallyloom.functions.periods import period_start
from tallyloom.functions.text import squeeze, title_case
from tallyloom.operators.reshape import union_sources
from tallyloom.operators.spread import keep_first
from tallyloom.sources.tables import small_table

BASE_CURRENCY = "VND"

# Confirmed spellings of one customer.
CUSTOMER_NAMES = {
    "sunrise apparel": "Sunrise Apparel",
    "sunrise apparel inc.": "Sunrise Apparel",
    "sunrise garments": "Sunrise Apparel",
}


# ---- currency ------------------------------------------------------------

def with_base_rate(rates: DataFrame, base: str = BASE_CURRENCY) -> DataFrame:
    """Add the base currency at rate 1 when the reference lacks it."""
    row = small_table(
        rates.sparkSession,
        {"currency_code": [base], "currency": ["Vietnamese Dong"], "rate_to_vnd": ["1.0"], "rate_type": ["FIXED"]},
    )
    row = row.select(*[c for c in row.columns if c in rates.columns])
    missing = row.join(rates.select("currency_code"), "currency_code", "left_anti")
    return rates.unionByName(missing, allowMissingColumns=True)


def latest_rates(rates: DataFrame) -> DataFrame:
    """One rate per currency, the newest, so a join cannot multiply rows."""
    typed = rates.select(
        "currency_code",
        to_rate(F.col("rate_to_vnd")).alias("rate_to_vnd"),
        F.col("effective_date").try_cast("date").alias("effective_date"),
    )
    return keep_first(
        typed, ["currency_code"], [F.col("effective_date").desc_nulls_last(), F.col("rate_to_vnd").desc_nulls_last()]
    ).drop("effective_date")


def convert_amounts(df: DataFrame, rates: DataFrame, amount: str = "amount_numeric") -> DataFrame:
    """Amount in the base currency; rows without rate or amount stay and are flagged."""
    joined = df.join(rates, df["currency"] == rates["currency_code"], "left")
    return joined.withColumn("converted_amount_vnd", convert(F.col(amount), F.col("rate_to_vnd"))).withColumn(
        "IS_FX_CONVERSION_FAILED", F.col("converted_amount_vnd").isNull()
    ).drop("currency_code", "rate_to_vnd")


def nearest_month_rates(rates: DataFrame) -> DataFrame:
    """Rate history to one rate per currency and month, nearest by date, ties to the earlier.

    Covers every month from the first rate to the month after the last. Outside
    that span the nearest rate is the one of the border month, so callers clamp.
    """
    dated = (
        rates.select(
            "currency_code",
            to_rate(F.col("rate_to_vnd")).alias("rate_to_vnd"),
            F.col("effective_date").try_cast("date").alias("effective_date"),
        )
        .filter("effective_date is not null and rate_to_vnd is not null")
        .groupBy("currency_code", "effective_date")
        .agg(F.min("rate_to_vnd").alias("rate_to_vnd"))
    )
    spine = (
        dated.groupBy("currency_code")
        .agg(
            F.trunc(F.min("effective_date"), "month").alias("_lo"),
            F.add_months(F.trunc(F.max("effective_date"), "month"), 1).alias("_hi"),
        )
        .withColumn("_month", F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 month"))))
    )
    # rates and month starts on one time line: the last rate before and the first after each month
    line = union_sources(
        dated.withColumn("_at", F.col("effective_date")), spine.withColumn("_at", F.col("_month"))
    )
    seen = F.when(F.col("rate_to_vnd").isNotNull(), F.struct("effective_date", "rate_to_vnd"))
    rates_first = F.col("rate_to_vnd").isNull()
    forward = Window.partitionBy("currency_code").orderBy("_at", rates_first)
    backward = Window.partitionBy("currency_code").orderBy(F.col("_at").desc(), rates_first)
    near = line.withColumns(
        {
            "_before": F.last(seen, ignorenulls=True).over(forward.rowsBetween(Window.unboundedPreceding, 0)),
            "_after": F.last(seen, ignorenulls=True).over(backward.rowsBetween(Window.unboundedPreceding, 0)),
        }
    ).filter("_month is not null")
    gap_before = F.datediff("_month", "_before.effective_date")
    gap_after = F.datediff("_after.effective_date", "_month")
    nearest = F.when(
        F.col("_after").isNull() | (F.col("_before").isNotNull() & (gap_before <= gap_after)), F.col("_before")
    ).otherwise(F.col("_after"))
    return near.select("currency_code", "_lo", "_hi", "_month", nearest.alias("_n")).select(
        "currency_code", "_lo", "_hi", "_month", "_n.rate_to_vnd", "_n.effective_date"
    )


def asof_rates(df: DataFrame, rates: DataFrame, currency: str = "currency", period: str = "period") -> DataFrame:
    """Attach the rate whose date is nearest to the first day of the row's month.

    The month table has one row per currency and month, so facts take part in
    two plain equi joins on a small table and are never compared with the whole
    history. Base currency rows have rate 1.
    """
    table = nearest_month_rates(rates)
    span = table.select(
        F.col("currency_code").alias("_span_code"), F.col("_lo"), F.col("_hi")
    ).distinct()
    monthly = table.select(
        F.col("currency_code").alias("_rate_code"),
        F.col("_month").alias("_rate_month"),
        "rate_to_vnd",
        "effective_date",
    )
    start = period_start(F.col(period))
    clamped = F.when(start.isNotNull(), F.greatest(F.col("_lo"), F.least(F.col("_hi"), start)))
    joined = (
        df.join(span, F.col(currency) == F.col("_span_code"), "left")
        .withColumn("_wanted", clamped)
        .join(monthly, (F.col("_span_code") == F.col("_rate_code")) & (F.col("_wanted") == F.col("_rate_month")), "left")
    )
    rate = F.coalesce(
        F.col("rate_to_vnd"), F.when((F.col(currency) == BASE_CURRENCY) & F.col("_span_code").isNull(), F.lit(1).cast("decimal(18,6)"))
    )
    return joined.withColumn("rate_to_vnd", rate).drop(
        "_span_code", "_lo", "_hi", "_wanted", "_rate_code", "_rate_month"
    )


# ---- customers -----------------------------------------------------------

def customer_mapping(spark) -> DataFrame:
    """The confirmed mapping as a table, each rule with an id."""
    return small_table(
        spark,
        {
            "variant": list(CUSTOMER_NAMES),
            "canonical_name": list(CUSTOMER_NAMES.values()),
            "mapping_rule_id": [f"MAP-{i + 1:03d}" for i in range(len(CUSTOMER_NAMES))],
        },
    )


def canonical_customers(df: DataFrame, mapping: DataFrame, column: str = "customer_name") -> DataFrame:
    """Mapped name where the mapping knows it, title case otherwise.

    Adds ``normalization_status`` and ``mapping_rule_id``; a blank name is for review.
    """
    cleaned = df.withColumn("_variant", F.lower(squeeze(F.col(column))))
    joined = cleaned.join(mapping, F.col("_variant") == F.col("variant"), "left")
    status = (
        F.when(F.col("canonical_name").isNotNull(), "MATCHED")
        .when(F.coalesce(F.col("_variant"), F.lit("")) == "", "REVIEW")
        .otherwise("UNMATCHED")
    )
    return joined.withColumns(
        {
            column: F.coalesce(F.col("canonical_name"), title_case(F.col("_variant"))),
            "normalization_status": status,
        }
    ).drop("_variant", "variant", "canonical_name")


# ---- orphans -------------------------------------------------------------

def flag_orphans(
    df: DataFrame, known: DataFrame, key: str = "order_no", name: str = "IS_ORPHANED_ORDER"
) -> DataFrame:
    """Rows without a partner in ``known`` are kept and flagged."""
    partners = known.select(F.col(key).alias("_known")).filter("_known is not null").distinct()
    return df.join(partners, F.col(key) == F.col("_known"), "left").withColumn(
        name, F.col("_known").isNull()
    ).drop("_known")


def quarantine_orphans(df: DataFrame, known: DataFrame, key: str = "order_no") -> DataFrame:
    """Only the rows without a partner, for review."""
    return df.join(known.select(key).filter(F.col(key).isNotNull()), key, "left_anti")


# ---- KPI master ----------------------------------------------------------

# The natural key of a KPI and the attributes of its master row.
MASTER_KEYS = ("Pillar", "Sub_Pillar", "Department", "KPI_Name", "Sub_KPI_Type")
MASTER_ATTRIBUTES = (
    "PILLAR_ID", "SP_ID", "UA_ID", "Yearly_Target", "Aggregation_Method", "direction",
    "Is_Active", "Valid_From", "Valid_To", "Source_Version",
)


def match_master(df: DataFrame, master: DataFrame, in_force: str | None = None) -> DataFrame:
    """Left join on the five-part natural key to the active master rows.

    With ``in_force`` (a period column) only the version valid in that period
    matches, which keeps one row per input row when the master has history.
    """
    attributes = [c for c in MASTER_ATTRIBUTES if c in master.columns]
    active = master.filter(F.col("Is_Active") == "Y").select(
        *[F.col(k).alias(f"_m_{k}") for k in MASTER_KEYS], *attributes
    )
    condition = F.lit(True)
    for k in MASTER_KEYS:
        condition = condition & (F.col(k) == F.col(f"_m_{k}"))
    if in_force:
        condition = condition & (F.col(in_force) >= F.col("Valid_From")) & (F.col(in_force) < F.col("Valid_To"))
    return (
        df.join(active, condition, "left")
        .withColumn("IS_ORPHANED", F.col("UA_ID").isNull())
        .drop(*[f"_m_{k}" for k in MASTER_KEYS])
    )


def point_in_time(
    facts: DataFrame, versions: DataFrame, key: str, period: str, valid_from: str = "Valid_From", valid_to: str = "Valid_To"
) -> DataFrame:
    """Attach the version in force, ``valid_from <= period < valid_to``.

    Versions start on period borders, so a key has at most one per period.
    """
    right = versions.withColumnRenamed(key, "_version_key")
    on = (
        (F.col(key) == F.col("_version_key"))
        & (F.col(period) >= F.col(valid_from))
        & (F.col(period) < F.col(valid_to))
    )
    return facts.join(right, on, "left").drop("_version_key")


def as_of(
    facts: DataFrame, versions: DataFrame, key: str, at: str, bucket: Callable[[Column], Column], valid_from: str = "Valid_From", valid_to: str = "Valid_To"
) -> DataFrame:
    """``point_in_time`` for histories of any length: each fact meets one version, not all versions of its key.

    Facts and version starts lie on one time line per key, cut into buckets (a coarse time step of ``at``); the last
    version is carried forward inside a bucket, and from bucket to bucket over one row per key and bucket. No
    task holds more of a key than a bucket or its buckets' edges. A version that starts with the fact counts, one
    that has ended does not; versions of one key do not overlap. NULL keys and times find nothing.
    """
    attributes = [c for c in versions.columns if c != key]
    version = F.struct(*[F.col(c) for c in attributes])
    starts = versions.filter(F.col(key).isNotNull() & F.col(valid_from).isNotNull())
    line = starts.select(F.col(key).alias("_key"), F.col(valid_from).alias("_at"), F.lit(0).alias("_is_fact"), version.alias("_version"))
    own = facts.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_is_fact"), F.struct(*[F.col(f"`{c}`") for c in facts.columns]).alias("_fact"))
    line = line.unionByName(own, allowMissingColumns=True).withColumn("_step", bucket(F.col("_at")))
    edges = line.groupBy("_key", "_step").agg(F.max_by("_version", F.when(F.col("_version").isNotNull(), F.col("_at"))).alias("_last"))
    before = Window.partitionBy("_key").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select("_key", "_step", F.last("_last", ignorenulls=True).over(before).alias("_carried")).filter("_carried is not null")
    inside = Window.partitionBy("_key", "_step").orderBy("_at", "_is_fact").rowsBetween(Window.unboundedPreceding, 0)
    met = line.withColumn("_here", F.last("_version", ignorenulls=True).over(inside)).filter("_is_fact = 1").drop("_version")
    joined = met.join(carried, ["_key", "_step"], "left").withColumn("_found", F.coalesce("_here", "_carried"))
    in_force = F.when(F.col("_at") < F.col("_found").getField(valid_to), F.col("_found"))
    return joined.select("_fact.*", in_force.alias("_found")).select(*[F.col(f"`{c}`") for c in facts.columns], *[F.col("_found").getField(c).alias(c) for c in attributes])
