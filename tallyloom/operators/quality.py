"""Data-quality checks over a Silver table, their log and the gate before Gold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyloom.functions.amounts import AMOUNT

PASSED, WARNING, FAILED = "PASSED", "WARNING", "FAILED"


@dataclass(frozen=True)
class Expectations:
    """What one Silver table has to satisfy."""

    table: str
    key: Sequence[str]
    mandatory: Sequence[str]
    numeric: Mapping[str, str | None] = field(default_factory=dict)  # text column to the flag of values that are no number
    orphan_flag: str = "IS_ORPHANED"
    ratio: tuple[str, str] | None = None  # (unit column, value column)


def _line(check: str, result: Column, details: Column) -> Column:
    return F.struct(F.lit(check).alias("check_name"), result.alias("result"), details.alias("details"))


def _listed(findings: Sequence[Column]) -> Column:
    """The findings that apply, as one text."""
    return F.array_join(F.array_compact(F.array(F.lit(None).cast("string"), *findings)), "; ")


def _counters(columns: set[str], expect: Expectations) -> dict[str, Column]:
    """What the checks count of the rows, but for repeated keys."""
    counters: dict[str, Column] = {"_rows": F.count(F.lit(1))}
    counters |= {f"_given_{c}": F.count(F.col(c)) for c in expect.mandatory if c in columns}
    for c, flag in expect.numeric.items():
        if c not in columns:
            continue
        no_number = F.col(c).isNotNull() & F.trim(F.col(c).cast("string")).try_cast(AMOUNT).isNull()
        known = F.coalesce(F.col(flag), F.lit(False)) if flag in columns else F.lit(False)
        counters |= {f"_lost_{c}": F.count_if(no_number & ~known), f"_noted_{c}": F.count_if(no_number & known)}
    if expect.orphan_flag in columns:
        counters["_orphans"] = F.count_if(expect.orphan_flag)
    if expect.ratio:
        unit, value = expect.ratio
        counters["_over_one"] = F.count_if((F.col(unit) == "%") & (F.col(value).try_cast(AMOUNT) > 1))
    return counters


def quality_log(df: DataFrame, expect: Expectations) -> DataFrame:
    """One row per check. The table is read once.

    All counters are first taken per key, which also yields the number of rows
    in repeated keys, and then added up. Both steps combine before the shuffle.
    """
    counters = _counters(set(df.columns), expect)
    per_key = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(expect.key)]).agg(
        *[c.alias(n) for n, c in counters.items()]
    )
    totals = per_key.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counters],
        F.coalesce(F.sum(F.when(F.col("_rows") > 1, F.col("_rows"))), F.lit(0)).alias("_repeated"),
    )
    return _log_of(totals, set(df.columns), expect)


@dataclass(frozen=True)
class ObservedWrite:
    """A written table, the log of its checks and further counts, both taken while it was written."""

    table: DataFrame
    log: DataFrame
    counts: Mapping[str, int]


def write_observed(
    df: DataFrame, path: str, expect: Expectations, counts: Mapping[str, Column] | None = None, unique: bool = False
) -> ObservedWrite:
    """Write a table and check it in the same pass: the counters ride on the write, nothing is scanned for them.

    ``counts`` are further aggregates to take along. ``unique`` says that the key cannot repeat, as after
    ``keep_highest`` on it; otherwise the key columns alone are read back and counted.
    """
    spark, columns = df.sparkSession, set(df.columns)
    wanted = _counters(columns, expect) | dict(counts or {})
    seen = Observation("write")
    df.observe(seen, *[c.alias(n) for n, c in wanted.items()]).write.mode("overwrite").parquet(path)
    found = {n: int(v) for n, v in seen.get.items()}
    table = spark.read.schema(df.schema).parquet(path)
    if unique:
        repeated = spark.range(1).select(F.lit(0).cast("bigint").alias("_repeated"))
    else:
        per_key = table.groupBy(*expect.key).agg(F.count(F.lit(1)).alias("_rows"))
        repeated = per_key.agg(F.coalesce(F.sum(F.when(F.col("_rows") > 1, F.col("_rows"))), F.lit(0)).alias("_repeated"))
    totals = repeated.select("_repeated", *[F.lit(found[n]).cast("bigint").alias(n) for n in _counters(columns, expect)])
    return ObservedWrite(table, _log_of(totals, columns, expect), {n: found[n] for n in counts or {}})


def _log_of(totals: DataFrame, columns: set[str], expect: Expectations) -> DataFrame:
    """The log from one row of counters."""
    present = [c for c in expect.mandatory if c in columns]
    numeric = [c for c in expect.numeric if c in columns]
    has_flag = expect.orphan_flag in columns

    def status(bad: Column, level: str) -> Column:
        return F.when(bad, level).otherwise(PASSED)

    missing = [F.lit(f"{c} is missing") for c in expect.mandatory if c not in columns]
    empty = [F.when(F.col(f"_given_{c}") == 0, F.lit(f"{c} has no value")) for c in present]
    mandatory = _listed([*missing, *empty])
    lost = _listed(
        [
            F.when(F.col(f"_lost_{c}") > 0, F.concat(F.lit(f"{c}: "), F.col(f"_lost_{c}").cast("string")))
            for c in numeric
        ]
    )
    noted = _listed(
        [
            F.when(F.col(f"_noted_{c}") > 0, F.concat(F.lit(f"{c}: "), F.col(f"_noted_{c}").cast("string"), F.lit(" flagged")))
            for c in numeric
        ]
    )
    lines = [
        _line("silver_not_empty", status(F.col("_rows") == 0, FAILED), F.lit("")),
        _line("mandatory_columns", status(mandatory != "", FAILED), mandatory),
        _line(
            "orphaned_flagged",
            status(F.col("_orphans") > 0, WARNING) if has_flag else F.lit(FAILED),
            F.concat(F.lit("orphaned rows: "), F.col("_orphans").cast("string"))
            if has_flag
            else F.lit(f"{expect.orphan_flag} is missing"),
        ),
        _line(
            "no_duplicates",
            status(F.col("_repeated") > 0, FAILED),
            F.concat(F.lit("rows in repeated keys: "), F.col("_repeated").cast("string")),
        ),
        # a text that is no number fails the check, unless the row says so itself
        _line(
            "no_ocr_typos",
            F.when(lost != "", FAILED).when(noted != "", WARNING).otherwise(PASSED),
            F.concat_ws("; ", F.when(lost != "", lost), F.when(noted != "", noted)),
        ),
    ]
    if expect.ratio:
        lines.append(
            _line(
                "ratio_range",
                status(F.col("_over_one") > 0, WARNING),
                F.concat(F.lit("ratios above one: "), F.col("_over_one").cast("string")),
            )
        )
    return totals.select(F.col("_rows").alias("row_count"), F.inline(F.array(*lines))).select(
        "check_name", F.lit(expect.table).alias("table_name"), "result", "row_count", "details"
    )


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column with its empty and given cells, all columns in one aggregate."""
    totals = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"_n{i}") for i, c in enumerate(df.columns)])
    lines = [
        F.struct(
            F.lit(c).alias("column_name"),
            (F.col("_rows") - F.col(f"_n{i}")).alias("null_count"),
            F.col(f"_n{i}").alias("non_null_count"),
        )
        for i, c in enumerate(df.columns)
    ]
    return totals.select(F.inline(F.array(*lines)))


def achievement_findings(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose achievement cannot be computed, with the reason."""
    reason = F.when(F.col("zero_target_kpi"), "ZERO_TARGET").when(F.col("zero_actual_lower"), "ZERO_ACTUAL_LOWER_BETTER")
    return df.withColumn("finding", reason).filter("finding is not null").select(*key, "finding")


def quality_gate(log: DataFrame) -> DataFrame:
    """One verdict row: any FAILED check stops Gold, warnings let it through."""
    return log.agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(F.col("result") == FAILED).alias("failed"),
        F.count_if(F.col("result") == WARNING).alias("warnings"),
    ).withColumn("can_proceed", F.col("failed") == 0)


class QualityGateError(RuntimeError):
    """Raised when Gold must not be built."""


def require_gate(log: DataFrame) -> None:
    """Stop the load when the gate is closed. The log has a handful of rows per table."""
    verdict = quality_gate(log).first()
    if not verdict["can_proceed"]:
        raise QualityGateError(f"{verdict['failed']} of {verdict['checks']} checks failed")
