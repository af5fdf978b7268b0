"""Candidates for names that the mapping does not know: near names of a reference, found by shared q-grams."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Characters of a gram, and characters of the shorter name for each edit that is allowed.
Q = 3
CHARS_PER_EDIT = 4
# Grams that near names must share to meet.
SHARED = 3


def _grams(name: Column) -> Column:
    """Distinct grams of the name, padded at both ends so that its first and last characters count as others do."""
    pad = "\u0001" * (Q - 1)
    padded = F.concat(F.lit(pad), name, F.lit(pad))
    places = F.sequence(F.lit(1), F.char_length(name) + Q - 1)
    return F.array_distinct(F.transform(places, lambda i: F.substring(padded, i, Q)))


def _meeting_grams(names: DataFrame, reference: DataFrame, name: str, other: str, most: int) -> DataFrame:
    """Spellings of both sides (``side`` n or r) with their rarest ``most * Q + SHARED`` grams in ``grams``; ``few`` tells that they have no more than that."""
    def spellings(df: DataFrame, column: str) -> DataFrame:
        return df.select(F.col(column).alias("name")).filter(F.char_length("name") >= CHARS_PER_EDIT).distinct()

    tagged = spellings(names, name).withColumn("side", F.lit("n")).unionByName(spellings(reference, other).withColumn("side", F.lit("r")))
    grams = tagged.withColumn("gram", F.explode(_grams(F.col("name"))))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("held_by"))
    # The size of exploded rows is estimated without the explode, so Spark would broadcast far more than its threshold.
    ordered = grams.join(counts.hint("merge"), "gram").groupBy("side", "name").agg(F.sort_array(F.collect_list(F.struct("held_by", "gram"))).alias("_all"))
    return ordered.select(
        "side", "name", F.slice("_all.gram", 1, most * Q + SHARED).alias("grams"), (F.size("_all") < most * Q + SHARED).alias("few")
    )


def _signatures(most: int) -> Column:
    """Hashes of every ``SHARED`` of the grams, and of each gram alone where there are few of them."""
    places = F.array(*[F.array(*[F.lit(i) for i in c]) for c in itertools.combinations(range(most * Q + SHARED), SHARED)])
    within = F.filter(places, lambda c: c[SHARED - 1] < F.size("grams"))
    several = F.transform(within, lambda c: F.xxhash64(*[F.get(F.col("grams"), c[i]) for i in range(SHARED)]))
    alone = F.transform("grams", lambda g: F.xxhash64(g))
    return F.when(F.col("few"), F.concat(several, alone)).otherwise(several)


def meeting_names(names: DataFrame, reference: DataFrame, name: str, other: str, most: int = 2) -> DataFrame:
    """Pairs (name, candidate) of different spellings that share a signature; every pair within ``most`` edits is one of them."""
    signed = _meeting_grams(names, reference, name, other, most).select("side", "name", F.explode(_signatures(most)).alias("signature"))
    left = signed.filter("side = 'n'").select("name", "signature")
    right = signed.filter("side = 'r'").select(F.col("name").alias("candidate"), "signature")
    gap = F.abs(F.char_length("name") - F.char_length("candidate"))
    return left.join(right.hint("merge"), "signature").filter((gap <= most) & (F.col("name") != F.col("candidate"))).select("name", "candidate").distinct()


def near_names(names: DataFrame, reference: DataFrame, name: str, other: str, most: int = 2) -> DataFrame:
    """Pairs (name, candidate, edits) of different spellings at an edit distance up to ``most``.

    A name of fewer than ``CHARS_PER_EDIT`` characters per edit allows fewer edits, below that none, as the
    shorter of the two has it. Names that are NULL or empty have no candidates.

    No pair is lost and there is no cap: one edit destroys at most Q grams, so two near names of which one has
    ``most * Q + SHARED`` grams share at least ``SHARED``, and the first ``SHARED`` of those, in one common order, are
    among the first ``most * Q + SHARED`` grams of each. Names meet in a hash of so many grams together: single grams are
    too few to tell many names apart. Two names with fewer grams meet in single ones as well. The order is
    rarest first; grams are counted over both sides. Each spelling is compared once, however often it is
    delivered, and pairs that meet several times are joined into one before the distance is computed.
    """
    met = meeting_names(names, reference, name, other, most)
    allowed = F.least(F.lit(most), F.floor(F.least(F.char_length("name"), F.char_length("candidate")) / CHARS_PER_EDIT))
    edits = F.levenshtein("name", "candidate", most)
    return met.withColumn("edits", edits).filter((F.col("edits") >= 0) & (F.col("edits") <= allowed))


def review_candidates(names: DataFrame, reference: DataFrame, name: str, other: str, most: int = 2) -> DataFrame:
    """One row per unmatched spelling: its nearest candidate (ties to the smaller text), its edits and how many there are.

    Spellings that the reference holds are matched and left out; one without a candidate has NULL and 0.
    """
    wanted = names.select(F.col(name).alias("name")).filter("name is not null and name <> ''").distinct()
    open_names = wanted.join(reference.select(F.col(other).alias("_known")).distinct(), F.col("name") == F.col("_known"), "left_anti")
    pairs = near_names(open_names, reference, "name", other, most)
    best = pairs.groupBy("name").agg(F.min(F.struct("edits", "candidate")).alias("_best"), F.count(F.lit(1)).alias("candidates"))
    return open_names.join(best, "name", "left").select(
        "name", F.col("_best.candidate").alias("candidate"), F.col("_best.edits").alias("edits"), F.coalesce("candidates", F.lit(0)).cast("bigint").alias("candidates")
    )
