"""With a third of the rows on one key, no task gets much more than its share."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators.dedup import flag_not_highest, flag_repeats, keep_highest
from tallyloom.operators.reconcile import with_conflicts
from tallyloom.operators.spread import with_next, with_previous

ROWS, PARTITIONS = 48_000, 16


@pytest.fixture()
def hot(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(PARTITIONS))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark.range(ROWS, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("k"),
        F.col("id").alias("seq"),
        (F.col("id") % 97).cast("decimal(18,4)").alias("amount"),
    )
    for k, v in before.items():
        spark.conf.set(k, v)


def largest_task(df):
    # the hash keeps every column, and with them the windows, in the plan
    counted = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.max(F.xxhash64(*df.columns)).alias("h"))
    return max(r["n"] for r in counted.collect())


LIMIT = 2 * ROWS // PARTITIONS


def test_flagging_duplicates_is_spread(hot):
    assert largest_task(flag_not_highest(hot, ["k"], "amount", ["seq"])) < LIMIT
    assert largest_task(flag_repeats(hot, ["k"], ["seq"])) < LIMIT


def test_equal_copies_are_spread(spark, hot):
    copies = hot.select(F.when(F.col("k") == "HOT", F.lit("HOT")).otherwise(F.col("seq").cast("string")).alias("k"))
    flagged = flag_repeats(copies, ["k"], None)
    assert largest_task(flagged) < 2 * LIMIT
    assert flagged.filter("k = 'HOT' and IS_DUPLICATE").count() == ROWS // 3 - 1


def test_keeping_one_row_moves_one_row_per_task(hot):
    kept = keep_highest(hot, ["k"], "amount", ["seq"])
    assert kept.count() == kept.select("k").distinct().count()
    assert largest_task(kept) < LIMIT


def test_conflict_flags_are_spread(hot):
    distinct = hot.select("k", F.col("seq").alias("v"))
    flagged = with_conflicts(distinct, ["k"], "v")
    assert largest_task(flagged) < LIMIT
    assert flagged.filter("k = 'HOT' and not IS_CONFLICT").count() == 0


def test_neighbours_are_spread(hot):
    bucket = F.floor(F.col("seq") / 200)
    rows = with_next(with_previous(hot, ["k"], ["seq"], bucket, {"p": "seq"}), ["k"], ["seq"], bucket, {"n": "seq"})
    assert largest_task(rows) < LIMIT
    assert rows.filter("k = 'HOT' and (n - seq <> 3 or seq - p <> 3)").count() == 0


def test_a_plain_window_would_not_be(hot):
    plain = Window.partitionBy("k").orderBy("seq")
    assert largest_task(hot.withColumn("n", F.row_number().over(plain))) > LIMIT
