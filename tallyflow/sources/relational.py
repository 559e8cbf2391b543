"""Relational and document stores, read in parallel through their connectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tallyflow.plans.star import Star
from tallyflow.sinks.star_tables import read_star_table


def jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    columns: Sequence[str],
    partition: tuple[str, int, int, int] | None = None,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """Columns of a table over JDBC; needs the driver on the cluster.

    ``partition`` is (numeric column, lower bound, upper bound, partitions);
    the bounds only place the cuts, all rows are read.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**(properties or {}))
    if partition:
        column, lower, upper, count = partition
        reader = (
            reader.option("partitionColumn", column).option("lowerBound", lower)
            .option("upperBound", upper).option("numPartitions", count)
        )
    return reader.load().select(*columns)


def star_from_folder(spark: SparkSession, root: str, by_user: bool = False) -> Star:
    """The star tables as written by ``write_star``, finished loads only; impressions come with their clicks, joined by the load.

    ``by_user`` takes the layout for questions about one user.
    """
    names = ("advertisers", "users", "campaigns", "shown_by_user" if by_user else "shown", "clicks")
    return Star(*[read_star_table(spark, root, name) for name in names])


def star_from_catalog(spark: SparkSession, database: str) -> Star:
    """The star tables of a catalog database."""
    names = ("advertisers", "users", "campaigns", "impressions", "clicks")
    return Star(*[spark.table(f"{database}.{name}") for name in names])
