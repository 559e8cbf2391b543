"""Month counts rolled up to 2, 4, 8 ... months, so that a range of months reads few rows.

A block of level k is 2^k months long and begins at a multiple of that. Any range of months is made of at
most two blocks of each level. A row keeps the earliest month in which its id was seen; the earliest of
several blocks is the smallest, so ties are broken as over the months themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.plans.reviews import _largest, _month

LEVELS = 8


def month_number(text: Column) -> Column:
    """Months since the year 0 of a ``yyyy-MM`` text."""
    return F.substring(text, 1, 4).cast("int") * 12 + F.substring(text, 6, 2).cast("int") - 1


def roll_up(months: DataFrame, id_name: str, levels: int = LEVELS) -> DataFrame:
    """(level, block, id, review_count, seen) of a month table; each level is made from the one below."""
    rows = [months.groupBy(F.lit(0).alias("level"), month_number(F.col("year_month")).alias("block"), F.col(id_name).alias("id")).agg(
        F.sum("review_count").alias("review_count"), F.min("year_month").alias("seen"))]
    for level in range(1, levels):
        below = rows[-1].withColumns({"level": F.lit(level), "block": F.floor(F.col("block") / 2).cast("int")})
        rows.append(below.groupBy("level", "block", "id").agg(F.sum("review_count").alias("review_count"), F.min("seen").alias("seen")))
    return reduce(DataFrame.unionByName, rows)


def write_rollup(months: DataFrame, id_name: str, path: str, levels: int = LEVELS) -> None:
    """Store the roll-ups of a month table, a folder for each block."""
    roll_up(months, id_name, levels).repartition("level", "block").write.mode("overwrite").partitionBy("level", "block").parquet(path)


def cover(start: str, end: str, levels: int = LEVELS) -> list[tuple[int, int]]:
    """The blocks (level, block) that make up the months ``start`` to ``end``, none for a start after the end.

    At most two of each level, but for the highest, which has as many as it takes.
    """
    def number(text: str) -> int:
        return int(text[:4]) * 12 + int(text[5:]) - 1

    first, after, blocks = number(_month(start)), number(_month(end)) + 1, []
    for level in range(levels):
        if first >= after:
            break
        if level == levels - 1:
            blocks += [(level, b) for b in range(first, after)]
            break
        if first % 2:
            blocks.append((level, first))
            first += 1
        if after % 2 and first < after:
            after -= 1
            blocks.append((level, after))
        first, after = first // 2, after // 2
    return blocks


def top_of_rollup(spark: SparkSession, path: str, start: str, end: str, n: int = 10, levels: int = LEVELS) -> DataFrame:
    """The rows of ``top_of_months``, from the folders of the blocks that make up the range."""
    rows = spark.read.schema("id string, review_count long, seen string, level int, block int").parquet(path)
    chosen = [(F.col("level") == level) & (F.col("block") == block) for level, block in cover(start, end, levels)]
    rows = rows.filter(reduce(lambda a, b: a | b, chosen, F.lit(False)))
    return _largest(rows.groupBy("id").agg(F.sum("review_count").alias("review_count"), F.min("seen").alias("seen")), n)
