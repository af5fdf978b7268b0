"""Connected components over an edge table, for operators that link rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import drop_staged, stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in `edges` (a long, b long).

    Each round points every vertex at its smallest neighbour, follows the pointers twice, and goes on with
    edges between what they point at, which are ever fewer; the smallest id of a component only ever points at
    itself. Rounds are staged in the shared folder, which cuts the lineage and survives a lost executor. The
    neighbours are combined before the shuffle, and joins on a hub are split by the skew join.
    """
    left = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while left.limit(1).count():
        both = left.select("a", "b").union(left.select("b", "a"))
        point = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("to"))
        for _ in range(2):
            point = stage(_follow(point, point), "pointers")
        rounds.append(point)
        to = lambda end: point.select(F.col("id").alias(end), F.col("to").alias(f"{end}_to"))  # noqa: E731, B023
        moved = left.join(to("a"), "a").join(to("b"), "b").where("a_to <> b_to")
        smaller = stage(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "edges")
        drop_staged(left)
        left = smaller
    if not rounds:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    labels = rounds[0]
    for later in rounds[1:]:
        labels = _follow(labels, later)
    return stage(labels.select("id", F.col("to").alias("component")), "labels")


def _follow(labels: DataFrame, later: DataFrame) -> DataFrame:
    """Where the targets of `labels` point in `later`; a target that is not there stays."""
    step = later.select(F.col("id").alias("to"), F.col("to").alias("further"))
    return labels.join(step, "to", "left").select("id", F.coalesce("further", "to").alias("to"))
