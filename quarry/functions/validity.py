"""Which values count as present."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the form of a valid number as text.
NUMBER_TEXT = r"^\d+\.(:?\d+)?$"


def valid_text(c: Column) -> Column:
    """Text in the form of NUMBER_TEXT; null is not."""
    return F.coalesce(c.rlike(NUMBER_TEXT), F.lit(False))


def valid_number(c: Column) -> Column:
    """Doubles whose plain decimal text is valid: not null or NaN, finite, no sign
    (so no -0.0), and zero or within [1e-4, 1e16)."""
    plain_zero = (c == 0) & ~c.cast("string").startswith("-")  # only text tells 0.0 from -0.0
    return F.coalesce(~F.isnan(c) & (plain_zero | ((c >= 1e-4) & (c < 1e16))), F.lit(False))


def missing(c: Column) -> Column:
    return c.isNull() | F.isnan(c)


def null_if_nan(c: Column) -> Column:
    return F.nullif(c, F.lit(float("nan")))


def all_valid(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [valid_number(F.col(c)) for c in columns], F.lit(True))


def value(c: str) -> Column:
    """The column where it is valid, else null."""
    return F.when(valid_number(F.col(c)), F.col(c))
