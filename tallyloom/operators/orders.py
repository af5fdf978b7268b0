"""Orders with their lines as one nested record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Delivered field to business name.
HEADER_FIELDS = {"id": "order_id", "userId": "customer_id", "title": "order_code", "body": "order_notes"}
LINE_FIELDS = {
    "id": "line_id", "postId": "order_id", "name": "line_description", "email": "buyer_contact", "body": "line_notes",
}


def nest_lines(
    headers: DataFrame,
    lines: DataFrame,
    key: str = "order_id",
    order: Sequence[str] = ("line_id",),
    part_lines: int = 10_000,
) -> DataFrame:
    """Headers with an array ``line_items``; the grain is (order, ``line_part``).

    One row cannot hold an array of any length, so every order is cut the same way: part ``p`` holds the
    lines whose number, the first column of ``order``, lies in ``[p * part_lines, (p + 1) * part_lines)``. A
    line without a number is in part 0, and so is the empty array of an order without lines. Lines are sorted
    inside a part, and parts by their number. A NULL key meets a NULL key; lines without header are left out;
    repeated headers each get the lines.
    """
    fields = [*order, *[c for c in lines.columns if c != key and c not in order]]
    part = F.coalesce(F.floor(F.col(order[0]) / part_lines), F.lit(0)).cast("bigint")
    nested = lines.groupBy(F.col(key).alias("_line_key"), part.alias("line_part")).agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("line_items")
    )
    joined = headers.join(nested, F.col(key).eqNullSafe(F.col("_line_key")), "left").drop("_line_key")
    item = nested.schema["line_items"].dataType.simpleString()
    return joined.withColumns(
        {
            "line_items": F.coalesce(F.col("line_items"), F.array().cast(item)),
            "line_part": F.coalesce(F.col("line_part"), F.lit(0)),
        }
    )
