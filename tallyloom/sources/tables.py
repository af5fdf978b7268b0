"""Reading delivered files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def small_table(spark: SparkSession, columns: Mapping[str, Sequence[str | None]]) -> DataFrame:
    """A few text rows written in code.

    Handed over as Arrow they become a local relation of known size, which the
    optimizer broadcasts; a list of Python rows has no size and would make it
    shuffle the other side of the join.
    """
    return spark.createDataFrame(pa.table({k: pa.array(v, pa.string()) for k, v in columns.items()}))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header row, every column text; types are decided later, where a failure can be flagged."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def read_csv_with_origin(spark: SparkSession, path: str) -> DataFrame:
    """The same, with the delivering file in ``SOURCE_FILE``."""
    return read_csv(spark, path).select("*", F.col("_metadata.file_name").alias("SOURCE_FILE"))


def with_source(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("SOURCE_FILE", F.lit(source))


def with_run_time(df: DataFrame, run_ts: str, column: str = "ingestion_timestamp") -> DataFrame:
    """The one timestamp of this run on every record."""
    return df.withColumn(column, F.lit(run_ts).cast("timestamp"))


def parquet_copy(spark: SparkSession, csv_path: str, parquet_path: str) -> DataFrame:
    """Keep the raw file and a columnar copy beside it."""
    read_csv(spark, csv_path).write.mode("overwrite").parquet(parquet_path)
    return spark.read.parquet(parquet_path)
