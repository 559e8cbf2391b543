"""Data checks on raw text columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyflow.functions.text import is_blank


def null_blank_counts(raw: DataFrame) -> DataFrame:
    """Number of NULL or blank cells of every column, in one pass."""
    return raw.agg(*[F.count_if(is_blank(F.col(c))).alias(c) for c in raw.columns])


def all_filled(columns: Sequence[str]) -> Column:
    """True where none of the columns is NULL or blank."""
    return reduce(and_, [~is_blank(F.col(c)) for c in columns])


def require_filled(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows with a NULL or blank value in one of the columns."""
    return raw.filter(all_filled(columns))


def dropped_rows(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Raw, kept and dropped row counts of ``require_filled``, in one pass."""
    kept = F.count_if(all_filled(columns))
    return raw.agg(
        F.count("*").alias("raw_rows"), kept.alias("kept_rows"), (F.count("*") - kept).alias("dropped_rows")
    )


class Watched:
    """Null, blank and dropped counts of the rows that pass through a job, without a scan of their own.

    ``rows(raw)`` are the same rows; once a job has read them all, ``counts()`` has the cells that are NULL
    or blank by column, and the raw, kept and dropped rows of ``require_filled``. A job that runs the rows
    more than once, as without a cache, counts its first run.
    """

    def __init__(self, critical: Sequence[str]):
        self.critical, self.seen = critical, Observation()

    def rows(self, raw: DataFrame) -> DataFrame:
        empty = [F.count_if(is_blank(F.col(c))).alias(f"empty_{c}") for c in raw.columns]
        return raw.observe(self.seen, F.count("*").alias("raw_rows"), F.count_if(all_filled(self.critical)).alias("kept_rows"), *empty)

    def counts(self) -> dict[str, int]:
        found = self.seen.get
        return {**found, "dropped_rows": found["raw_rows"] - found["kept_rows"]}
