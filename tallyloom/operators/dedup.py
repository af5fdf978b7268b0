"""Deduplication: keep the highest amount, or the first of equal rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyloom.operators.spread import keep_first, mark_copies, mark_not_first


def highest_amount_order(amount: str, tiebreak: Sequence[str]) -> list[Column]:
    """Highest first, missing amounts last, then a total order."""
    return [F.col(amount).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in tiebreak]]


def keep_highest(df: DataFrame, key: Sequence[str], amount: str, tiebreak: Sequence[str]) -> DataFrame:
    """One row per key, the one with the highest amount."""
    return keep_first(df, key, highest_amount_order(amount, tiebreak))


def flag_not_highest(
    df: DataFrame, key: Sequence[str], amount: str, tiebreak: Sequence[str] | None, name: str = "IS_DUPLICATE"
) -> DataFrame:
    """All rows, flagged; the frame behind both the kept rows and the drop log.

    ``tiebreak`` must tell the rows of a key apart; without one the content does.
    """
    if tiebreak is None:
        return mark_copies(df, key, highest_amount_order(amount, ()), name)
    return mark_not_first(df, key, highest_amount_order(amount, tiebreak), tiebreak, name)


def _equal_rows(columns: Sequence[str]) -> list[Column]:
    return [F.expr(f"coalesce(cast(`{c}` as string), '')") for c in columns]


def keep_first_equal(df: DataFrame, columns: Sequence[str], sequence: Sequence[str]) -> DataFrame:
    """One of the rows that agree on all columns (NULL as empty text), first in input order."""
    return keep_first(df, _equal_rows(columns), [F.col(c).asc_nulls_last() for c in sequence])


def flag_repeats(
    df: DataFrame, columns: Sequence[str], sequence: Sequence[str] | None, name: str = "IS_DUPLICATE"
) -> DataFrame:
    """All rows, every repeat of an earlier equal row flagged; earlier by ``sequence``, else by content."""
    if sequence is None:
        return mark_copies(df, _equal_rows(columns), (), name)
    return mark_not_first(
        df, _equal_rows(columns), [F.col(c).asc_nulls_last() for c in sequence], sequence, name
    )


def repeat_log(flagged: DataFrame, keep: Sequence[str], columns: Sequence[str], run_ts: str) -> DataFrame:
    """The dropped rows with the key they repeated."""
    return flagged.filter("IS_DUPLICATE").select(
        F.lit("DUPLICATE_DROP").alias("LOG_TYPE"),
        *keep,
        F.lit("ROW_LEVEL").alias("COLUMN_NAME"),
        F.lit(None).cast("string").alias("ORIGINAL_VALUE"),
        F.concat_ws(" || ", *_equal_rows(columns)).alias("CORRECTED_VALUE"),
        F.lit("repeats an earlier row after repair and normalisation").alias("DETAILS"),
        F.lit(run_ts).cast("timestamp").alias("LOGGED_AT"),
    )


def dedup_summary(flagged: DataFrame, source: str = "SOURCE_FILE") -> DataFrame:
    """Dropped and kept rows per source in one aggregate."""
    return flagged.groupBy(source).agg(
        F.count_if("IS_DUPLICATE").alias("DROPPED_COUNT"),
        F.count_if(~F.col("IS_DUPLICATE")).alias("KEPT_COUNT"),
    ).withColumn("LOG_TYPE", F.lit("DUPLICATE_SUMMARY"))


def first_source_summary(
    df: DataFrame, columns: Sequence[str], sequence: Sequence[str], source: str = "SOURCE_FILE"
) -> DataFrame:
    """``dedup_summary`` of ``flag_repeats`` without flagging: for every set of equal rows, the rows of each
    source and which source holds the first. Both aggregates combine before the shuffle.

    Sets are told apart by the first column as it is, if it is text, so that rows which lie together by it are not
    moved. Only NULL and empty text, which are equal, may then be two sets; those meet in a second step, where all
    other sets are one row per source and task.
    """
    keys = [k.alias(f"_k{i}") for i, k in enumerate(_equal_rows(columns))]
    order = F.struct(*[c for s in sequence for c in (F.col(s).isNull().alias(f"_no_{s}"), F.col(s))])
    names = [f"_k{i}" for i in range(len(keys))]
    blank = F.lit(False)
    if df.schema[columns[0]].dataType == StringType():
        keys[0], blank = F.col(columns[0]).alias("_k0"), F.coalesce(F.col("_k0"), F.lit("")) == ""
    per_source = df.groupBy(*keys, source).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    sets = per_source.groupBy(*names).agg(
        F.min(F.struct("_first", source)).alias("_kept"), F.collect_list(F.struct(source, "_n")).alias("_sources")
    )
    whole = F.when(blank, F.struct(F.lit(True).alias("_blank"), *names[1:]))
    rows = sets.select(whole.alias("_set"), F.when(blank, F.col("_kept")).alias("_open"), F.col(f"_kept.{source}").alias("_keeper"), F.inline("_sources"))
    counted = rows.groupBy("_set", source).agg(
        F.sum("_n").alias("_n"), F.count_if(F.col(source) == F.col("_keeper")).alias("_kept"), F.collect_list("_open").alias("_open")
    )
    met = counted.groupBy("_set").agg(F.min(F.array_min("_open")).alias("_open"), F.collect_list(F.struct(source, "_n", "_kept")).alias("_sources"))
    settled = met.select(F.col("_set").isNull().alias("_settled"), F.col(f"_open.{source}").alias("_keeper"), F.inline("_sources"))
    kept = F.sum(F.when(F.col("_settled"), F.col("_kept")).when(F.col(source) == F.col("_keeper"), 1).otherwise(0))
    return settled.groupBy(source).agg((F.sum("_n") - kept).alias("DROPPED_COUNT"), kept.alias("KEPT_COUNT")).withColumn(
        "LOG_TYPE", F.lit("DUPLICATE_SUMMARY")
    )


def summary_of_keys(df: DataFrame, columns: Sequence[str], source: str = "SOURCE_FILE") -> DataFrame:
    """The same summary when no row-level log is wanted: counts only, no window."""
    groups = df.groupBy(source, *[k.alias(f"_k{i}") for i, k in enumerate(_equal_rows(columns))]).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return groups.groupBy(source).agg(
        (F.sum("_n") - F.count(F.lit(1))).alias("DROPPED_COUNT"), F.count(F.lit(1)).alias("KEPT_COUNT")
    ).withColumn("LOG_TYPE", F.lit("DUPLICATE_SUMMARY"))
