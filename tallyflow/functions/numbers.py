"""Ratios and lenient casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """Division in double precision; NULL when the divisor is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * 100


def per_thousand(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * 1000


def lenient_int(text: Column) -> Column:
    """Whole number at the head of a decimal text ("4.7" gives 4); NULL when it is no number."""
    # the pattern is only tried where the plain cast fails
    whole = F.regexp_extract(F.trim(text), r"^([+-]?[0-9]+)\.[0-9]*$", 1)
    return F.coalesce(text.try_cast("int"), whole.try_cast("int"))
