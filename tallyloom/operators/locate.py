"""Finding the rows in which two large sources differ, by digests of key ranges.

A source is summed up as two levels of digests: one per leaf, which is a range of keys, and one per group of
``FAN`` neighbouring leaves. Two sources are compared from the top; only leaves whose digests differ are gone
down to, so the only shuffle of rows is that of those leaves. Digests of a source that has not changed since
the last comparison are read from where they were written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Leaves under one node of the upper level, and leaves that a comparison may name in a broadcast (8 bytes each).
FAN = 64
BROADCAST_LEAVES = 1 << 20
LEAF_SCHEMA = "leaf bigint, rows bigint, d1 decimal(38,0), d2 decimal(38,0), node int"


def hashed_leaf(key: Sequence[str], leaves: int = 1 << 16) -> Column:
    """A leaf for keys without ranges of their own: an equal share of their hashes."""
    return F.pmod(F.xxhash64(*key), F.lit(leaves))


def range_leaf(key: str, width: int) -> Column:
    """A leaf for a numeric key: ``width`` neighbouring values; NULL keys have a leaf of their own."""
    return F.coalesce(F.floor(F.col(key) / width), F.lit(-(1 << 40)))


def _digest(columns: Sequence[str], seed: int) -> Column:
    marked = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.sum(F.xxhash64(F.lit(seed), *marked).cast("decimal(20,0)")).cast("decimal(38,0)")


def write_digests(df: DataFrame, columns: Sequence[str], leaf: Column, path: str) -> None:
    """Digests of all leaves under ``path/leaves``, in one folder per node, and of the nodes under ``path/nodes``.

    A digest is the row count and two sums of independent 64-bit hashes of the compared columns, so repeated
    rows count and the order of rows does not. Counts and sums combine before the shuffle.
    """
    leaves = df.groupBy(leaf.cast("bigint").alias("leaf")).agg(
        F.count(F.lit(1)).alias("rows"), _digest(columns, 1).alias("d1"), _digest(columns, 2).alias("d2")
    )
    # Nodes are folders: their number is kept below FAN as well, whatever the number of leaves.
    placed = leaves.withColumn("node", F.pmod(F.floor(F.col("leaf") / FAN), F.lit(FAN)).cast("int"))
    placed.hint("rebalance", "node").write.mode("overwrite").partitionBy("node").parquet(f"{path}/leaves")
    written = df.sparkSession.read.schema(LEAF_SCHEMA).parquet(f"{path}/leaves")
    sums = [F.sum(c).cast("decimal(38,0)").alias(c) for c in ("d1", "d2")]
    nodes = written.groupBy("node").agg(F.sum("rows").alias("rows"), *sums)
    nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")


def _unequal(left: DataFrame, right: DataFrame, place: Sequence[str]) -> DataFrame:
    both = left.select(*place, "rows", "d1", "d2").unionByName(right.select(*place, *[(-F.col(c)).alias(c) for c in ("rows", "d1", "d2")]))
    summed = both.groupBy(*place).agg(*[F.sum(c).alias(c) for c in ("rows", "d1", "d2")])
    return summed.filter("rows <> 0 or d1 <> 0 or d2 <> 0").select(*place)


def unequal_leaves(spark: SparkSession, left: str, right: str) -> DataFrame:
    """Leaves whose digests differ, or that only one side has; leaf digests are read below unequal nodes alone."""
    sides = (left, right)
    # At most FAN nodes, so their numbers may go to the driver and become a partition filter.
    nodes = [r.node for r in _unequal(*[spark.read.parquet(f"{p}/nodes") for p in sides], ["node"]).collect()]
    return _unequal(*[spark.read.schema(LEAF_SCHEMA).parquet(f"{p}/leaves").filter(F.col("node").isin(nodes)) for p in sides], ["leaf"])


def rows_that_differ(left: DataFrame, right: DataFrame, columns: Sequence[str], leaf: Column, unequal: DataFrame) -> DataFrame:
    """The rows of unequal leaves that one side holds more often: ``side`` is LEFT or RIGHT, ``copies`` by how many.

    Each side is read once and cut down to the unequal leaves before its rows are shuffled. Equal rows cancel
    out in signed counts; NULL equals NULL, and no rows are paired, so repeated keys cost nothing extra.
    """
    wanted = unequal.select(F.col("leaf").alias("_leaf"))
    if wanted.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES:
        wanted = F.broadcast(wanted)

    def side(df: DataFrame, sign: int) -> DataFrame:
        here = df.select(*columns).withColumn("_at", leaf.cast("bigint"))
        return here.join(wanted, F.col("_at") == F.col("_leaf"), "left_semi").select(*columns, F.lit(sign).alias("_sign"))

    net = side(left, 1).unionByName(side(right, -1)).groupBy(*columns).agg(F.sum("_sign").alias("_net"))
    return net.filter("_net <> 0").select(
        *columns, F.when(F.col("_net") > 0, "LEFT").otherwise("RIGHT").alias("side"), F.abs("_net").alias("copies")
    )


def locate_differences(
    left: DataFrame, right: DataFrame, columns: Sequence[str], leaf: Column, left_digests: str, right_digests: str
) -> DataFrame:
    """Write the digests of both sides, compare them from the top and give the rows that differ."""
    spark = left.sparkSession
    write_digests(left, columns, leaf, left_digests)
    write_digests(right, columns, leaf, right_digests)
    return rows_that_differ(left, right, columns, leaf, unequal_leaves(spark, left_digests, right_digests))
