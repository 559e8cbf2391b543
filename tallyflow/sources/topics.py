"""Message topics: a Kafka topic, or a folder of text files with one message per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyflow.schemas import MESSAGE


def kafka_topic(
    spark: SparkSession, servers: str, topic: str, starting: str = "latest", max_per_trigger: int | None = None
) -> DataFrame:
    """Messages of a topic as a stream of ``value``; needs the Kafka package on the cluster.

    ``starting="earliest"`` reads a topic from its beginning; afterwards the
    checkpoint of the query remembers the offsets.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
    )
    if max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return reader.load().select("value")


def folder_topic(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """The same as a stream over files, one message per line."""
    reader = spark.readStream.schema(MESSAGE)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(folder)


def stored_topic(spark: SparkSession, folder: str) -> DataFrame:
    """All messages of a folder topic as a batch."""
    return spark.read.schema(MESSAGE).text(folder)
