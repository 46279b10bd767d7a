"""Dates in two notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL, DAY_MONTH = "M/d/yyyy", "d-MMM"


def full_date(text: Column) -> Column:
    return F.try_to_date(text, FULL)


def mixed_date(text: Column, year: Column) -> Column:
    """`m/d/yyyy`, or `d-Mon` in the given year; null for anything else."""
    short = F.try_to_date(F.concat_ws("-", text, year.cast("string")), f"{DAY_MONTH}-yyyy")
    return F.coalesce(full_date(text), short)
