"""String repair and normalisation, all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a cell may hold to count as a mistyped number.
NUMBER_LIKE = r"^[0-9Oo\.\,\-\s]+$"


def repair_ocr_digits(value: Column) -> Column:
    """Letter O read for digit zero; cells that do not look numeric stay as they are.

    A cell of only O's counts as numeric-looking and becomes zeros.
    """
    return F.when(value.rlike(NUMBER_LIKE), F.translate(value, "Oo", "00")).otherwise(value)


def squeeze(value: Column) -> Column:
    """Runs of white space become one blank, outer blanks go."""
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def title_case(value: Column) -> Column:
    """Every run of letters starts with a capital, as in ``O'Brien-Smith``.

    ``initcap`` alone only looks at blanks.
    """
    text = F.lower(value)
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    # only a letter right behind another sign needs the cut into runs
    return F.when(text.rlike(r"[^\p{L}\s]\p{L}"), F.array_join(F.transform(runs, F.initcap), "")).otherwise(
        F.initcap(text)
    )


def fill_sentinel(value: Column, sentinel: str) -> Column:
    """NULL and blank become a named 'absent by design' value."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(sentinel))


def blank_if_null(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def flag(predicate: Column) -> Column:
    """A boolean that is never NULL: unknown counts as false."""
    return F.coalesce(predicate, F.lit(False))
