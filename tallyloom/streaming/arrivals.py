"""Bronze append and Silver upsert of new files only, as bounded streams.

The checkpoint remembers which files were taken, so each scheduled run appends
just the arrivals since the last one, and a failed run resumes without loss or
repetition. This is the batch load of one arrival, not a continuous job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom.sources.landing import upsert_batch


def append_new_files(
    spark: SparkSession, landing: str, schema: StructType | str, target: str, checkpoint: str, run_ts: str
) -> None:
    """Take every CSV file not seen before into the Bronze table at ``target``."""
    arrivals = spark.readStream.option("header", True).schema(schema).csv(landing)
    stamped = arrivals.select(
        "*",
        F.col("_metadata.file_name").alias("SOURCE_FILE"),
        F.lit(run_ts).cast("timestamp").alias("ingestion_timestamp"),
        F.lit(run_ts[:10]).alias("ingestion_date"),
    )
    query = (
        stamped.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .partitionBy("ingestion_date")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def upsert_new_files(
    spark: SparkSession, landing: str, schema: StructType | str, target: str, checkpoint: str, key: Sequence[str], newest_first: Sequence[Column],
    prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows, partitions: Sequence[str] = ("year", "month"), fmt: str = "csv",
) -> None:
    """Take every file not seen before into the Silver table at ``target``, each row once whatever is run again.

    ``prepare`` cleans the rows of one batch. The checkpoint numbers the batches; a run that stops between the
    table's write and the checkpoint's takes its batch again under the same number, and the table, which keeps
    that number on every row, ends as if it had been taken once. Files that arrive together are one batch; of
    rows with one key the first by ``newest_first`` counts.
    """
    arrivals = spark.readStream.schema(schema).option("header", True).format(fmt).load(landing)

    def take(rows: DataFrame, batch: int) -> None:
        upsert_batch(rows.sparkSession, prepare(rows), target, key, newest_first, batch, partitions)

    query = arrivals.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
