"""Helpers of all operators: tables, staged tables in the shared folder, words, worker state."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# What is not part of an alphanumeric word, upper case counted as letters (fixed values of the contract).
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; the session removes it when its JVM ends."""
    path = f"{shared_root(spark)}/llm-{label}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(hadoop)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, rows are computed once."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.staged_at = path
    return back


def drop_staged(*frames: DataFrame) -> None:
    """Remove staged tables that no later plan reads."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other letter as it is. Pure ASCII takes the cheaper way to the same."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def row_tag(text: Column) -> Column:
    """Tells rows of one doc_id apart by their text; equal rows share it, and so their result."""
    return F.xxhash64(text, F.octet_length(text))


def small_batches(docs: DataFrame) -> DataFrame:
    """Arrow batches cut by bytes, so that long texts do not pile up in one."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return docs


def worker_state(key: str, build: Callable[[], object]) -> object:
    """An object built once in each Python worker process and kept for its later tasks, until another one is asked for."""
    held = sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state")).__dict__
    if held.get("key") != key:
        held["value"] = None
        held["key"], held["value"] = key, build()
    return held["value"]


def release_memory() -> None:
    """Give freed memory back to the system: workers live on after a task, and what they hold counts for their executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
