"""KPI aggregation driven by the method of each KPI, and the month spine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.amounts import AMOUNT
from tallyloom.functions.periods import period_key


def by_method(method: Column, total: Column, mean: Column, last: Column) -> Column:
    """Flow KPIs add up, ratios average, snapshots take the latest; others have no rule."""
    kind = F.upper(F.trim(method))
    return F.when(kind == "SUM", total).when(kind == "AVERAGE", mean).when(kind == "LAST", last)


def with_stretches(df: DataFrame, kpi: Sequence[str], unit: str, period: str, name: str = "unit_stretch") -> DataFrame:
    """Number the stretches of months in which a KPI keeps a unit: a unit that returns after another one starts a new stretch.

    Between two months of a unit lies a barrier if a month between them has another unit; months that have both
    are none. Meant for rows at KPI, month and unit, where a KPI has as many rows as months.
    """
    month = period_key(F.col(period))
    months = (F.floor(month / 100) * 12 + month % 100).cast("int")
    numbered = df.withColumn("_month", months)
    all_units = Window.partitionBy(*kpi).orderBy("_month")
    one_unit = Window.partitionBy(*kpi, unit).orderBy("_month")
    until, until_before = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
    count = F.count(F.lit(1))
    others = numbered.withColumns({
        "_others": count.over(all_units.rangeBetween(*until)) - count.over(one_unit.rangeBetween(*until)),
        "_others_before": count.over(all_units.rangeBetween(*until_before)) - count.over(one_unit.rangeBetween(*until_before)),
    })
    barrier = F.coalesce(F.col("_others_before") > F.lag("_others").over(one_unit), F.lit(False))
    marked = others.withColumn("_barrier", barrier.cast("int"))
    return marked.withColumn(name, F.sum("_barrier").over(one_unit.rangeBetween(*until))).drop("_month", "_others", "_others_before", "_barrier")


def aggregate_kpis(
    df: DataFrame, key: Sequence[str], method: str = "Aggregation_Method", value: str = "actual_value", period: str = "PERIOD"
) -> DataFrame:
    """One value per key by the KPI's own method, missing months left out.

    The method is part of the grouping key, and so should be the unit: values
    before and after a unit change do not mix. Months are compared as integers,
    which keeps the aggregate a hash aggregate.
    """
    valid = F.col(value).isNotNull()
    last = F.max_by(F.when(valid, F.col(value)), F.when(valid, period_key(F.col(period))))
    grouped = df.groupBy(*key, method).agg(
        F.sum(value).alias("_total"),
        F.count(value).alias("valid_months"),
        last.alias("_last"),
    )
    mean = F.try_divide(F.col("_total"), F.col("valid_months"))
    return grouped.withColumn(
        "aggregated_value",
        by_method(
            F.col(method), F.col("_total").cast("decimal(28,4)"), mean.cast("decimal(28,4)"), F.col("_last").cast("decimal(28,4)")
        ),
    ).drop("_total", "_last")


def year_to_date(
    df: DataFrame, key: Sequence[str], method: str = "aggregation_method", value: str = "actual_value", period: str = "period"
) -> DataFrame:
    """Running value within the year by method, over months that have a value.

    ``key`` must contain KPI, year, unit and method; at monthly grain a group
    then holds at most twelve rows.
    """
    run = Window.partitionBy(*key).orderBy(period).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total, months = F.sum(value).over(run), F.count(value).over(run)
    return df.filter(F.col(value).isNotNull()).withColumn(
        "ytd_actual",
        by_method(
            F.col(method),
            total.cast("decimal(28,4)"),
            F.try_divide(total, months).cast("decimal(28,4)"),
            F.col(value).cast("decimal(28,4)"),
        ),
    )


def month_spine(versions: DataFrame, first: str, last: str) -> DataFrame:
    """One row per KPI version and month in which it is in force, within ``[first, last]``.

    Intervals are half-open and disjoint, so a KPI has one row per month and
    the target of that month's version.
    """
    start = F.greatest(F.col("Valid_From"), F.lit(first))
    begin = F.try_to_date(start, "yyyy-MM")
    # the month before Valid_To, or the last month asked for
    stop = F.least(
        F.add_months(F.try_to_date(F.least(F.col("Valid_To"), F.lit("9000-01")), "yyyy-MM"), -1),
        F.try_to_date(F.lit(last), "yyyy-MM"),
    )
    return (
        versions.withColumns({"_begin": begin, "_stop": stop})
        .filter("_begin <= _stop")
        .withColumn("_month", F.explode(F.sequence("_begin", "_stop", F.expr("interval 1 month"))))
        .withColumn("PERIOD", F.date_format("_month", "yyyy-MM"))
        .drop("_begin", "_stop", "_month")
    )


def with_missing_months(
    spine: DataFrame, actuals: DataFrame, key: Sequence[str], value: str = "actual_value", extra: Sequence[str] = (),
    unparseable: str | None = None,
) -> DataFrame:
    """Every spine month, with its value or flagged as missing by design; ``unparseable`` flags values that are there but no number."""
    there = F.coalesce(F.col(unparseable), F.lit(False)) if unparseable else F.lit(False)
    return (
        spine.join(actuals.select(*key, value, *extra), list(key), "left")
        .withColumn("is_missing_actual", F.col(value).isNull() & ~there)
        .withColumn(value, F.col(value).cast(AMOUNT))
    )
