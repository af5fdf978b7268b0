"""Facts whose parent comes later: kept as orphans, promoted when the parent arrives.

Three Parquet tables under one path, each in folders by arrival number:

* ``matched``: facts whose parent was known when they came
* ``orphans``: facts still without one
* ``promoted``: facts that were orphans since ``orphaned_in`` and found their parent in a later arrival

All facts are the union of the three.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.lookup import flag_orphans
from tallyloom.session import staging
from tallyloom.sources.landing import replace_groups, write_partitions

TABLES = ("matched", "orphans", "promoted")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if not any(kind in str(missing) for kind in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
            raise
        return None


def settle_arrival(spark: SparkSession, facts: DataFrame, known: DataFrame, arrived: DataFrame, path: str, key: str, arrival: int) -> None:
    """Take one arrival of facts and of parents.

    ``known`` are all parents so far, those of this arrival included; ``arrived`` only the latter. Old facts are
    looked at from the side of ``arrived`` alone: orphans are read, matched facts never. Orphans of a key are
    promoted together, with all their repeated rows. A NULL key has no parent and stays an orphan.

    Safe to repeat: an arrival that runs again, also after later ones or after a stop between two steps, leaves
    the tables as they are. Promotions are written before the orphans go, and a key that is promoted already is
    not taken again.
    """
    number = F.lit(arrival).cast("bigint")
    with staging(spark) as stage:
        parents = stage(arrived.select(F.col(key).alias("_parent")).filter("_parent is not null").distinct(), "arrived-parents")
        promoted, orphans = _read(spark, f"{path}/promoted"), _read(spark, f"{path}/orphans")

        flagged = flag_orphans(facts, known, key, "_orphaned")
        if promoted is not None:
            # Facts of this arrival that a later one promoted when this one ran before.
            gone = promoted.filter(F.col("orphaned_in") == number).select(F.col(key).alias("_gone")).distinct()
            flagged = flagged.join(gone, F.col(key) == F.col("_gone"), "left_anti")
        split = stage(flagged.withColumn("arrival", number), "arrival-facts")

        if orphans is not None:
            found = orphans.filter(F.col("arrival") != number).withColumnRenamed("arrival", "orphaned_in")
            found = found.join(parents, F.col(key) == F.col("_parent"), "left_semi").withColumn("arrival", number)
            if promoted is not None:
                # Of a promotion that stopped before its orphans went.
                before = promoted.select(F.col(key).alias("_k"), F.col("orphaned_in").alias("_in")).distinct()
                found = found.join(before, (F.col(key) == F.col("_k")) & (F.col("orphaned_in") == F.col("_in")), "left_anti")
                found = found.unionByName(promoted.filter(F.col("arrival") == number).select(*found.columns))
            write_partitions(stage(found, "promotions"), f"{path}/promoted", ["arrival"], single=True)

        write_partitions(split.filter("not _orphaned").drop("_orphaned"), f"{path}/matched", ["arrival"], single=True)
        write_partitions(split.filter("_orphaned").drop("_orphaned"), f"{path}/orphans", ["arrival"], single=True)
        if orphans is not None:
            # Rewrites the arrivals that held promoted orphans, no others.
            done = parents.select(F.col("_parent").alias(key))
            replace_groups(spark, spark.read.parquet(f"{path}/orphans").limit(0), done, f"{path}/orphans", [key], ["arrival"])


def settled_facts(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """All facts with their state: MATCHED, ORPHANED or PROMOTED, and the arrivals that brought and promoted them."""
    parts = []
    for name, state in zip(TABLES, ("MATCHED", "ORPHANED", "PROMOTED")):
        rows = _read(spark, f"{path}/{name}")
        if rows is None:
            continue
        came = F.col("orphaned_in") if state == "PROMOTED" else F.col("arrival").cast("bigint")
        until = F.col("arrival").cast("bigint") if state == "PROMOTED" else F.lit(None).cast("bigint")
        parts.append(rows.select(*columns, F.lit(state).alias("state"), came.alias("arrived_in"), until.alias("promoted_in")))
    return functools.reduce(DataFrame.unionByName, parts)
