"""Silver tables bucketed by the order key, so that joins and upserts on it leave the large side where it is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.spread import keep_first

# The key as text that is never NULL: a NULL key is '', all others begin with '='.
BUCKET_KEY = "bucket_key"


def bucket_key(key: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` as table ``name`` with its files at ``path``, in ``buckets`` buckets by ``key`` and sorted in them.

    Rows are spread by the bucket key first, so a bucket is one file. A bucket holds all rows of its keys: choose
    their number such that the largest key fits; keys that own much of a table are better left in a plain one.
    """
    keyed = df.withColumn(BUCKET_KEY, bucket_key(key))
    (
        keyed.repartition(buckets, BUCKET_KEY)
        .write.mode("overwrite").format("parquet").option("path", path)
        .bucketBy(buckets, BUCKET_KEY).sortBy(BUCKET_KEY).saveAsTable(name)
    )
    return df.sparkSession.table(name)


def flag_orphans_bucketed(facts: DataFrame, known: DataFrame, name: str = "IS_ORPHANED_ORDER") -> DataFrame:
    """``flag_orphans`` on two bucketed tables: no row of either is shuffled, also where neither side is small."""
    partners = known.select(F.col(BUCKET_KEY).alias("_known")).filter("_known <> ''").distinct()
    return facts.join(partners, F.col(BUCKET_KEY) == F.col("_known"), "left").withColumn(name, F.col("_known").isNull()).drop("_known")


def merge_bucketed(spark: SparkSession, name: str, updates: DataFrame, key: str, newest_first: Sequence[Column]) -> DataFrame:
    """The bucketed table with the newest update per key in place of its rows; only the updates are shuffled to the buckets.

    A NULL key is a key like others. The result is a frame, to be written as a new table that then takes the name.
    """
    target = spark.table(name)
    # The updates go to as many partitions as there are buckets; with more of them Spark would move the target instead.
    buckets = int(next(r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect() if r["col_name"] == "Num Buckets"))
    placed = updates.withColumn(BUCKET_KEY, bucket_key(key)).repartition(buckets, BUCKET_KEY)
    newest = keep_first(placed, [BUCKET_KEY], newest_first)
    changed = newest.select(F.col(BUCKET_KEY).alias("_changed"))
    kept = target.join(changed, F.col(BUCKET_KEY) == F.col("_changed"), "left_anti")
    return kept.unionByName(newest.select(*target.columns))
