"""Bringing two deliveries of the same facts together, and comparing two sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import fill_sentinel, flag, squeeze
from tallyloom.operators.reshape import union_sources
from tallyloom.operators.spread import keep_first, mark_copies

# The key columns of a KPI delivery.
KPI_KEY = ("Pillar", "Sub_Pillar", "Department", "KPI_Name", "Sub_KPI_Type", "Unit")


def fill_kpi_sentinels(df: DataFrame) -> DataFrame:
    """Absent Sub Pillar and Sub KPI Type get their named values, so keys compare."""
    return df.withColumns(
        {
            "Sub_Pillar": fill_sentinel(squeeze(F.col("Sub_Pillar")), "UNKNOWN"),
            "Sub_KPI_Type": fill_sentinel(F.col("Sub_KPI_Type"), "N/A"),
        }
    )


def _stated(ranked: Sequence[DataFrame], value: str, text: str | None) -> DataFrame:
    """Deliveries one below the other, with their rank and what each row states: its value, or its text if that is no number."""
    tagged = [fill_kpi_sentinels(df).withColumn("_source_rank", F.lit(i)) for i, df in enumerate(ranked)]
    unified = union_sources(*tagged)
    return unified.withColumn("_stated", F.coalesce(F.col(value).cast("string"), F.col(text)) if text else F.col(value))


def _total_order(df: DataFrame, key: Sequence[str]) -> list[Column]:
    """Best source first, then all other columns, so that no choice depends on how rows arrive."""
    others = [c for c in df.columns if c not in (*key, "_stated", "_source_rank")]
    return [F.col("_source_rank"), *[F.col(c).asc_nulls_last() for c in others]]


def reconcile_sources(
    ranked: Sequence[DataFrame], key: Sequence[str] = (*KPI_KEY, "PERIOD"), value: str = "actual_value", text: str | None = None
) -> DataFrame:
    """Union deliveries, best source first, and settle what they say about each key.

    * same value twice: the row of the best source stays, the first of its rows by all their columns
    * different values: all stay, ``IS_CONFLICT`` on each
    * a missing value next to a given one: the given one stays
    * a text that is no number (column ``text``) is neither missing nor settled: it counts as a value of its own
    """
    unified = _stated(ranked, value, text)
    distinct = keep_first(unified, [*key, "_stated"], _total_order(unified, key))
    return with_conflicts(distinct, key, "_stated").drop("_source_rank", "_stated")


def reconcile_drops(
    ranked: Sequence[DataFrame], run_ts: str, key: Sequence[str] = (*KPI_KEY, "PERIOD"), value: str = "actual_value", text: str | None = None
) -> DataFrame:
    """The rows that ``reconcile_sources`` leaves out, each with its reason."""
    unified = _stated(ranked, value, text)
    marked = mark_copies(unified, [*key, "_stated"], _total_order(unified, key), "_repeat")
    given = unified.filter(F.col("_stated").isNotNull()).select(*[F.col(k).alias(f"_g_{k}") for k in key]).distinct()
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    empty = marked.filter(~F.col("_repeat") & F.col("_stated").isNull()).join(given, same, "left_semi").withColumn("LOG_TYPE", F.lit("EMPTY_BESIDE_VALUE"))
    repeats = marked.filter("_repeat").withColumn("LOG_TYPE", F.lit("SAME_VALUE_DROP"))
    return repeats.unionByName(empty).drop("_repeat", "_stated", "_source_rank").withColumn("LOGGED_AT", F.lit(run_ts).cast("timestamp"))


def with_conflicts(distinct: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Flag keys with several values; drop the empty row of a key that has a value.

    Expects each value once per key, so a key is in conflict as soon as it has a
    second given row. A slice with two rows knows that by itself; every slice
    sends one row to a common group, where the rest is found out. No task holds
    a whole key group, and the input is read once.
    """
    slices = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = F.col(value).isNotNull()
    in_slice = Window.partitionBy(*key, "_slice")
    sliced = distinct.withColumn(
        "_slice", F.when(given, F.pmod(F.xxhash64(value), F.lit(slices))).otherwise(F.lit(-2))
    ).withColumns(
        {
            "_several": F.count(F.lit(1)).over(in_slice) > 1,
            "_sent": F.row_number().over(in_slice.orderBy(value)) == 1,
        }
    )
    common = Window.partitionBy(*key, F.when(F.col("_sent"), F.lit(-1)).otherwise(F.col("_slice")))
    return (
        sliced.withColumn("_given", F.when(F.col("_sent"), F.count(value).over(common)))
        .filter(given | (F.col("_given") == 0))
        .withColumn("IS_CONFLICT", given & (F.col("_several") | flag(F.col("_given") > 1)))
        .drop("_slice", "_several", "_sent", "_given")
    )


def _both(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    return left.select(*columns, F.lit(True).alias("_left")).unionByName(
        right.select(*columns, F.lit(False).alias("_left"))
    )


def key_differences(
    left: DataFrame, right: DataFrame, key: Sequence[str], fields: Sequence[str], measures: Sequence[str] = ()
) -> DataFrame:
    """One row per key: its rows on each side, and for each field whether the sides hold the same values as often.

    ``row_differs`` tells whether whole rows differ, also where each field by itself agrees. Rows are counted
    with a sign: +1 on the left, -1 on the right. Equal rows of both sides cancel out, so NULL and repeated
    keys are compared without pairing their rows. Counts combine before each shuffle.
    """
    sign = F.when(F.col("_left"), 1).otherwise(-1)
    side = [F.sum(F.when(F.col("_left") == on, F.col(m))).alias(f"_{name}_{m}") for m in measures for on, name in ((True, "l"), (False, "r"))]
    rows = _both(left, right, list(dict.fromkeys([*key, *fields, *measures]))).groupBy(*key, *fields).agg(
        F.sum(sign).alias("_net"), F.count_if("_left").alias("_l"), F.count_if(~F.col("_left")).alias("_r"), *side
    )
    # A field agrees if its signed counts add up to 0 for each of its values: compared by two sums of independent digests.
    def spread(f):
        return [F.sum(F.xxhash64(F.lit(seed), F.col(f).isNull(), F.col(f)).cast("decimal(20,0)") * F.col("_net")).alias(f"_{f}_{seed}") for seed in (1, 2)]

    grouped = rows.groupBy(*key).agg(
        F.sum("_l").alias("left_rows"), F.sum("_r").alias("right_rows"), F.max(F.col("_net") != 0).alias("row_differs"),
        *[c for f in fields for c in spread(f)],
        *[F.sum(f"_{name}_{m}").alias(f"_{name}_{m}") for m in measures for name in ("l", "r")],
    )
    shared = (F.col("left_rows") > 0) & (F.col("right_rows") > 0)
    return grouped.select(
        *key, "left_rows", "right_rows", *[(shared & ((F.col(f"_{f}_1") != 0) | (F.col(f"_{f}_2") != 0))).alias(f"{f}_differs") for f in fields],
        (shared & F.col("row_differs")).alias("row_differs"), *[f"_{name}_{m}" for m in measures for name in ("l", "r")],
    )


def source_diff(
    left: DataFrame, right: DataFrame, key: Sequence[str], fields: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """Parallel-run report, one row per check: row counts, key coverage, field values, sums. Each side is read once."""
    per_key = key_differences(left, right, key, fields, measures)
    only_left, only_right = F.col("right_rows") == 0, F.col("left_rows") == 0
    counts = per_key.agg(
        F.coalesce(F.sum("left_rows"), F.lit(0)).alias("l_rows"),
        F.coalesce(F.sum("right_rows"), F.lit(0)).alias("r_rows"),
        F.count_if(only_left).alias("l_only"),
        F.count_if(only_right).alias("r_only"),
        F.count_if(F.col("left_rows") > 1).alias("l_repeated"),
        F.count_if(F.col("right_rows") > 1).alias("r_repeated"),
        *[F.count_if(f"{f}_differs").alias(f"d_{f}") for f in (*fields, "row")],
        *[F.sum(f"_{name}_{m}").alias(f"{name}_{m}") for m in measures for name in ("l", "r")],
    )

    def line(check, left_value, right_value):
        return F.struct(
            F.lit(check).alias("check_name"),
            left_value.cast("decimal(38,4)").alias("left_value"),
            right_value.cast("decimal(38,4)").alias("right_value"),
        )

    lines = [
        line("row_count", F.col("l_rows"), F.col("r_rows")),
        line("only_here", F.col("l_only"), F.col("r_only")),
        line("repeated_keys", F.col("l_repeated"), F.col("r_repeated")),
        *[line(f"differs:{f}", F.col(f"d_{f}"), F.col(f"d_{f}")) for f in (*fields, "row")],
        *[line(f"sum:{m}", F.col(f"l_{m}"), F.col(f"r_{m}")) for m in measures],
    ]
    full = counts.select(F.inline(F.array(*lines)))
    agrees = F.when(
        F.col("check_name").startswith("differs:") | F.col("check_name").isin("only_here", "repeated_keys"),
        (F.col("left_value") == 0) & (F.col("right_value") == 0),
    ).otherwise(F.col("left_value").eqNullSafe(F.col("right_value")))
    return full.withColumn("matches", agrees)
