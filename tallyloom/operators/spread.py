"""Window patterns that stay parallel when one key holds a large share of the rows.

A plain window sorts a whole key group in one task. Both helpers below first
work on slices of the group and then look only at the slice edges together, so
the largest task holds one slice, or one row (two) per slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of every key group.

    Spark limits each group to one row before the exchange
    (``WindowGroupLimit``), so a hot key arrives as one row per map task.
    """
    window = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def mark_not_first(
    df: DataFrame,
    key: Sequence[str | Column],
    order: Sequence[Column],
    spread_by: Sequence[str | Column],
    name: str,
) -> DataFrame:
    """Keep every row and flag those that are not the first of their group.

    ``spread_by`` holds columns that differ inside a group (an input sequence);
    their hash cuts the group into slices. Only slice winners meet again.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(k) if isinstance(k, str) else k for k in key]
    within = df.withColumn("_slice", F.pmod(F.xxhash64(*spread_by), F.lit(slices)))
    within = within.withColumn(
        "_in_slice", F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order))
    )
    winner = F.col("_in_slice") == 1
    final = Window.partitionBy(*keys, F.when(winner, F.lit(-1)).otherwise(F.col("_slice"))).orderBy(*order)
    return (
        within.withColumn("_among", F.row_number().over(final))
        .withColumn(name, ~(winner & (F.col("_among") == 1)))
        .drop("_slice", "_in_slice", "_among")
    )


def mark_copies(df: DataFrame, key: Sequence[str | Column], order: Sequence[Column], name: str) -> DataFrame:
    """``mark_not_first`` for rows that carry no input sequence.

    Fully equal rows are counted first, which combines before the shuffle, so
    any number of copies travels as one row. What remains is distinct and can be
    ordered and sliced by content; at the end every row comes back as often as
    it was delivered.
    """
    columns = df.columns
    counted = df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias("_copies"))
    total = [*order, *[F.col(f"`{c}`").asc_nulls_last() for c in columns]]
    marked = mark_not_first(counted, key, total, [F.col(f"`{c}`") for c in columns], "_not_first")
    kept = F.when(F.col("_not_first"), F.lit(0)).otherwise(F.lit(1)).cast("bigint")
    shares = F.array(
        F.struct(F.lit(False).alias(name), kept.alias("_share")),
        F.struct(F.lit(True).alias(name), (F.col("_copies") - kept).alias("_share")),
    )
    return repeat_rows(marked.select(*[F.col(f"`{c}`") for c in columns], F.inline(shares)), "_share")


def repeat_rows(df: DataFrame, times: str, chunk: int = 10_000) -> DataFrame:
    """Each row as often as the column ``times`` says; many repeats are made by many tasks."""
    columns = [c for c in df.columns if c != times]
    cut = df.filter(F.col(times) > 0).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / chunk)))
    )
    sized = cut.withColumn("_size", F.least(F.lit(chunk), F.col(times) - F.col("_chunk") * chunk).cast("int"))
    spread = sized.repartition("_chunk", *[F.col(f"`{c}`") for c in columns])
    return spread.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_size")))).select(
        *[F.col(f"`{c}`") for c in columns]
    )


def with_previous(
    df: DataFrame, key: Sequence[str], order: Sequence[str], bucket: Column, columns: dict[str, str]
) -> DataFrame:
    """``lag`` by one row inside each key, for keys of any size."""
    return _neighbour(df, key, order, bucket, columns, F.lag)


def with_next(
    df: DataFrame, key: Sequence[str], order: Sequence[str], bucket: Column, columns: dict[str, str]
) -> DataFrame:
    """``lead`` by one row inside each key, for keys of any size."""
    return _neighbour(df, key, order, bucket, columns, F.lead)


def _neighbour(df, key, order, bucket, columns, step):
    """Neighbour inside a time bucket, else the nearest edge row of another bucket.

    ``bucket`` must grow with ``order``. The first and last row of every bucket
    form one group per key; between two adjacent buckets the neighbours are
    exactly such edge rows.
    """
    bucketed = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*key, "_bucket").orderBy(*order)
    bucketed = bucketed.withColumns(
        {
            "_head": F.lag(F.lit(1)).over(inside).isNull(),
            "_tail": F.lead(F.lit(1)).over(inside).isNull(),
            **{f"_in_{new}": step(F.col(old)).over(inside) for new, old in columns.items()},
        }
    )
    edge = F.col("_head") | F.col("_tail")
    border = F.col("_head") if step is F.lag else F.col("_tail")
    across = Window.partitionBy(*key, edge, F.when(~edge, F.col("_bucket"))).orderBy(*order)
    joined = bucketed.withColumns(
        {
            new: F.when(border, step(F.col(old)).over(across)).otherwise(F.col(f"_in_{new}"))
            for new, old in columns.items()
        }
    )
    return joined.drop("_bucket", "_head", "_tail", *[f"_in_{new}" for new in columns])
