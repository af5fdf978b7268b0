"""Dimension history: type 1 attributes overwrite, type 2 attributes open versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.identity import row_digest, surrogate_key
from tallyloom.operators.spread import with_next, with_previous
from tallyloom.session import staging
from tallyloom.sources.landing import replace_groups


def build_history(
    snapshots: DataFrame,
    key: str,
    at: str,
    tracked: Sequence[str],
    overwrite: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
    unit: str | None = None,
    bucket: Column | None = None,
    far_end: Column | None = None,
) -> DataFrame:
    """Version chain per key with half-open intervals ``[Valid_From, Valid_To)``.

    Of several snapshots at one instant the last by ``tiebreak`` counts. A new
    version starts only when a tracked column changes. ``overwrite`` columns
    carry their latest value on every version. ``unit_changed`` marks a version
    whose ``unit`` differs from the one before it.

    Pass ``bucket`` (a coarse time step of ``at``) where one key may own a large
    share of the rows; without it each key is ordered in one task, which suits
    master data with few versions per key.
    """
    spread = F.lit(0) if bucket is None else bucket
    order = [at, *tiebreak]
    rows = snapshots.filter(F.col(at).isNotNull()).withColumns(
        {"_state": row_digest(tracked), "_step": spread}
    )
    inside = Window.partitionBy(key, "_step").orderBy(*order)
    rows = rows.withColumn("_next_at", F.lead(at).over(inside)).filter(
        F.col("_next_at").isNull() | (F.col("_next_at") != F.col(at))
    ).drop("_next_at")

    before = {"_previous": "_state", **({"_previous_unit": unit} if unit else {})}
    if bucket is None:
        plain = Window.partitionBy(key, "_step").orderBy(*order)
        rows = rows.withColumns({new: F.lag(old).over(plain) for new, old in before.items()})
    else:
        rows = with_previous(rows, [key], order, F.col("_step"), before)
    changes = rows.filter(F.col("_previous").isNull() | (F.col("_previous") != F.col("_state")))

    if bucket is None:
        plain = Window.partitionBy(key, "_step").orderBy(*order)
        versions = changes.withColumn("_until", F.lead(at).over(plain))
    else:
        versions = with_next(changes, [key], order, F.col("_step"), {"_until": at})

    end = far_end if far_end is not None else F.lit("9999-12-31 00:00:00").cast(snapshots.schema[at].dataType)
    versions = versions.select(
        surrogate_key(key, at).alias("version_sk"),
        key,
        *tracked,
        F.col(at).alias("Valid_From"),
        F.coalesce(F.col("_until"), end).alias("Valid_To"),
        F.col("_until").isNull().alias("is_current"),
        *(
            [(F.col("_previous").isNotNull() & ~F.col("_previous_unit").eqNullSafe(F.col(unit))).alias("unit_changed")]
            if unit
            else []
        ),
    )
    if not overwrite:
        return versions
    latest = (
        snapshots.filter(F.col(at).isNotNull())
        .groupBy(F.col(key).alias("_latest_key"))
        .agg(F.max_by(F.struct(*overwrite), F.struct(*order)).alias("_latest"))
    )
    return versions.join(latest, F.col(key).eqNullSafe(F.col("_latest_key")), "left").select(
        versions["*"], *[F.col(f"_latest.{c}").alias(c) for c in overwrite]
    )


# Folders that a history and its observations are cut into by key; a snapshot reads those of the keys it changes.
KEY_BUCKETS = 64


def _table(spark: SparkSession, path: str, buckets: list[int]) -> DataFrame | None:
    """The given folders of a table cut by key, or None before its first write."""
    try:
        return spark.read.parquet(path).filter(F.col("key_bucket").isin(buckets))
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None


def apply_snapshot(
    spark: SparkSession,
    snapshot: DataFrame,
    path: str,
    key: str,
    at: str,
    tracked: Sequence[str],
    overwrite: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
    unit: str | None = None,
    bucket: Column | None = None,
    far_end: Column | None = None,
    buckets: int = KEY_BUCKETS,
) -> None:
    """Bring the history at ``path`` up to date with one snapshot, in whatever order snapshots come.

    ``path/history`` holds the version chains as ``build_history`` gives them, ``path/observed`` every row that was
    ever delivered. A row that says what the version in force at its time says changes no chain; it is only
    observed, since a later snapshot may fall before it. The chains of all other keys are built anew from what
    was observed of them: a new state closes the open version, and a late one splits the version around it, up
    to the next observation. Chains of other keys are neither read nor written, but for the folders they share.

    A snapshot that is applied again, or again after a run that stopped half way, leaves the same history.
    """
    with staging(spark) as stage:
        number = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        arrived = stage(snapshot.filter(F.col(at).isNotNull()).withColumn("key_bucket", number), "snapshot")
        # At most as many numbers as there are folders.
        history = _table(spark, f"{path}/history", _numbers(arrived))
        changed = arrived if history is None else _changed_rows(arrived, history, key, at, [*tracked, *overwrite])
        touched = stage(changed.select(key, "key_bucket").distinct(), "touched-keys")
        arrived.hint("rebalance", "key_bucket").write.mode("append").partitionBy("key_bucket").parquet(f"{path}/observed")
        observed = _table(spark, f"{path}/observed", _numbers(touched))
        own = touched.select(F.col(key).alias("_t"))
        chains = observed.join(own, F.col(key).eqNullSafe(F.col("_t")), "left_semi").drop("key_bucket")
        versions = build_history(chains, key, at, tracked, overwrite, tiebreak, unit, bucket, far_end)
        replace_groups(spark, versions.withColumn("key_bucket", number), touched, f"{path}/history", [key], ["key_bucket"])


def _numbers(rows: DataFrame) -> list[int]:
    return [r[0] for r in rows.select("key_bucket").distinct().collect()]


def _changed_rows(arrived: DataFrame, history: DataFrame, key: str, at: str, columns: Sequence[str]) -> DataFrame:
    """Arrived rows that differ from the version in force at their time, or have none."""
    versions = history.select(
        F.col(key).alias("_v_key"), F.col("Valid_From").alias("_v_from"), F.col("Valid_To").alias("_v_to"), *[F.col(c).alias(f"_v_{c}") for c in columns]
    )
    same = F.col(key).eqNullSafe(F.col("_v_key")) & (F.col(at) >= F.col("_v_from")) & (F.col(at) < F.col("_v_to"))
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_v_{c}"))
    return arrived.join(versions, same, "left_anti")
