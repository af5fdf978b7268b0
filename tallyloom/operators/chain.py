"""Is a paged feed whole? Each landed page names the next one; gaps, loops, repeats and stray pages become rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import staged, staging


def follow_chain(links: DataFrame) -> DataFrame:
    """For each distinct ``page`` the end of its chain and the steps to it, by doubling: NULL for pages that never end.

    ``links`` holds one row per page with ``next_page``; a chain ends at a page without a next one, or whose next one is
    not there. Each round joins the pages that are under way with where their target got to, so a chain of
    n pages takes about log2(n) rounds; a page that has arrived takes no part any more. Pages that are under way when
    none arrives any more are in a loop, or lead into one.
    """
    spark = links.sparkSession
    there = links.select(F.col("page").alias("_there"))
    first = links.join(there, F.col("next_page") == F.col("_there"), "left").select(
        "page", F.coalesce("_there", "page").alias("at"), F.when(F.col("_there").isNotNull(), 1).otherwise(0).cast("bigint").alias("steps"),
        F.col("_there").isNull().alias("ended"),
    )
    state = staged(first, "chain")
    before, under_way = state.count(), state.filter("not ended").count()
    with staging(spark) as stage:
        # Distances on a chain have no gaps: where no page arrives in a round, the rest is in loops.
        while 0 < under_way < before:
            target = state.select(F.col("page").alias("_page"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("ended").alias("_ended"))
            moved = state.filter("not ended").join(target, F.col("at") == F.col("_page")).select(
                "page", F.col("_at").alias("at"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_ended").alias("ended")
            )
            state = stage(state.filter("ended").unionByName(moved), "chain")
            before, under_way = under_way, state.filter("not ended").count()
        return staged(state.select("page", *[F.when(F.col("ended"), F.col(c)).alias(c) for c in ("at", "steps")]), "chain-ends")


def check_chain(landed: DataFrame, start: str) -> DataFrame:
    """One row per landed page of a feed that begins at page ``start``, with what is wrong there.

    ``landed`` has ``page`` and ``next_page``, one row per landing; rows without a page name are left out. ``findings``,
    joined by commas, empty where all is well:

    * ``REPEATED``: landed more than once; ``DISAGREES``: with different next pages, of which the smallest counts
    * ``GAP``: its next page was never landed
    * ``LOOP``: the chain from here never ends
    * ``SHARED``: several pages name it as their next one
    * ``STRAY``: no page names it and it is not the start

    ``end_page`` and ``steps_to_end`` tell where its chain ends; both are NULL in a loop. A feed is whole when no
    page has a finding and the start is there.
    """
    named = landed.filter(F.col("page").isNotNull())
    once = staged(
        named.groupBy("page").agg(
            F.min("next_page").alias("next_page"), F.count(F.lit(1)).alias("copies"),
            # NULL counts as one more answer.
            (F.min("next_page").isNull() != F.max(F.col("next_page").isNull())).alias("_some_null"),
            (F.min("next_page") != F.max("next_page")).alias("_several"),
        ),
        "chain-pages",
    )
    named_by = once.filter("next_page is not null").groupBy(F.col("next_page").alias("_named")).agg(F.count(F.lit(1)).alias("named_by"))
    ends = follow_chain(once.select("page", "next_page")).withColumnRenamed("page", "_page")
    full = once.join(named_by, F.col("page") == F.col("_named"), "left").join(ends, F.col("page") == F.col("_page"), "left")
    incoming = F.coalesce("named_by", F.lit(0)).cast("bigint")
    findings = F.array(
        F.when(F.col("copies") > 1, "REPEATED"),
        F.when(F.coalesce(F.col("_some_null"), F.lit(False)) | F.coalesce(F.col("_several"), F.lit(False)), "DISAGREES"),
        F.when(F.col("next_page").isNotNull() & (F.col("steps") == 0), "GAP"),
        F.when(F.col("steps").isNull(), "LOOP"),
        F.when(incoming > 1, "SHARED"),
        F.when((incoming == 0) & (F.col("page") != start), "STRAY"),
    )
    return full.select(
        "page", "next_page", "copies", incoming.alias("named_by"), F.col("at").alias("end_page"), F.col("steps").alias("steps_to_end"),
        F.array_join(F.array_compact(findings), ",").alias("findings"),
    )
