"""Message sinks: a Kafka topic, or a folder of text files with one message per line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter


def to_kafka(messages: DataFrame, servers: str, topic: str, checkpoint: str) -> DataStreamWriter:
    """Append the ``value`` of each row to a topic; needs the Kafka package on the cluster."""
    return (
        messages.select("value").writeStream.outputMode("append").format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
    )


def to_folder(messages: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Append to a folder topic; each micro-batch appears once, also after a restart."""
    return (
        messages.select("value").writeStream.outputMode("append").format("text")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
    )


def publish(messages: DataFrame, servers: str, topic: str) -> None:
    """Send a batch of messages to a Kafka topic."""
    messages.select("value").write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def store(messages: DataFrame, folder: str) -> None:
    """Append a batch of messages to a folder topic."""
    messages.select("value").write.mode("append").text(folder)
