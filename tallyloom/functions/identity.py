"""Row identity: digests over natural keys and surrogate keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the separator between the fields of a digest.
SEPARATOR = "||"

UNKNOWN_KEY = -1


def row_digest(columns: Iterable[str]) -> Column:
    """SHA-256 over the named columns, NULL as empty text (``concat_ws`` would skip it)."""
    parts = ", ".join(f"coalesce(cast(`{c}` as string), '')" for c in columns)
    return F.expr(f"sha2(concat_ws('{SEPARATOR}', {parts}), 256)")


def surrogate_key(*columns: str) -> Column:
    """A stable 60-bit key from the natural key.

    It needs no numbering pass over the dimension, so it is computed row by
    row, survives rebuilds and agrees between dimension and fact.
    """
    return F.conv(F.substring(row_digest(columns), 1, 15), 16, 10).cast("bigint")
