"""Keyed loads: first row wins, last row wins, upsert, surrogate ids.

Copies of one key may be a large share of the input, so every collapse is an
aggregate: each map task keeps one row per key before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# three hex digits of the key's digest
ID_BUCKETS = 16 ** 3


def _one_per_key(df: DataFrame, key: Sequence[str], pick, order: Sequence[str]) -> DataFrame:
    rest = list(order) + [c for c in df.columns if c not in key and c not in order]
    if not rest:
        return df.select(*key).distinct()
    chosen = df.groupBy(*key).agg(pick(F.struct(*rest)).alias("_row"))
    return chosen.select(*[F.col(c) if c in key else F.col("_row")[c].alias(c) for c in df.columns])


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the smallest by ``order``, then by the other columns from left to right."""
    return _one_per_key(df, key, F.min, order)


def last_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the largest by ``order``, then by the other columns from left to right."""
    return _one_per_key(df, key, F.max, order)


def insert_ignore(
    incoming: DataFrame,
    key: Sequence[str],
    parents: Sequence[tuple[DataFrame, str, str]] = (),
    existing: DataFrame | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """The rows an insert that ignores errors would add.

    Rows without a key, rows whose foreign key has no parent and keys the
    target already holds are skipped; of several rows with one key the first
    by ``order`` stays. ``parents`` lists (parent table, foreign key column,
    parent key column).
    """
    rows = incoming
    for column in key:
        rows = rows.filter(F.col(column).isNotNull())
    for parent, column, parent_key in parents:
        ids = parent.select(F.col(parent_key).alias(column))
        rows = rows.join(ids, column, "left_semi").select(*incoming.columns)
    if existing is not None:
        rows = rows.join(existing.select(*key), list(key), "left_anti").select(*incoming.columns)
    return first_per_key(rows, key, order)


def upsert(target: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """``target`` with the rows of ``new`` added; on equal keys the new row replaces the old ones."""
    kept = target.join(new.select(*key).distinct(), list(key), "left_anti").select(*target.columns)
    return kept.unionByName(new)


def newest_version(df: DataFrame, key: Sequence[str], version: str = "version") -> DataFrame:
    """Of each key, the rows written by the newest version (a document may span several rows)."""
    newest = df.groupBy(*key).agg(F.max(version).alias(version))
    return df.join(newest, [*key, version], "left_semi").select(*df.columns)


def newest_row(df: DataFrame, key: Sequence[str], version: str = "version") -> DataFrame:
    """The same where a version holds a key once: rows move once, and each key has as many as it has versions."""
    for column in key:
        df = df.filter(F.col(column).isNotNull())
    place = F.rank().over(Window.partitionBy(*key).orderBy(F.desc(version)))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; empty when the key is unique."""
    return df.groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1")


def surrogate_ids(values: DataFrame, column: str, id_name: str, existing: DataFrame | None = None) -> DataFrame:
    """Distinct values of ``column`` numbered without gaps, continuing after ``existing``.

    Values are spread over a fixed number of digest buckets and numbered inside
    their bucket; only the bucket sizes (at most ``ID_BUCKETS`` rows) meet in
    one place. The numbering depends on the values alone, not on partitioning.
    """
    fresh = values.select(column).dropna().distinct()
    if existing is not None:
        fresh = fresh.join(existing.select(column), column, "left_anti")
    fresh = fresh.withColumn("_digest", F.md5(column)).withColumn("_bucket", F.substring("_digest", 1, 3))
    before = F.sum("_size").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = (
        fresh.groupBy("_bucket").agg(F.count("*").alias("_size"))
        .select("_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    )
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_digest", column))
    # offsets has one row per bucket: ID_BUCKETS rows at most
    numbered = fresh.withColumn("_place", place).join(F.broadcast(offsets), "_bucket")
    number = F.col("_before") + F.col("_place")
    if existing is not None:
        number = number + existing.select(F.coalesce(F.max(id_name), F.lit(0))).scalar()
    return numbered.select(number.cast("int").alias(id_name), column)
