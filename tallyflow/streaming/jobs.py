"""The stream jobs: the batch transforms between a source and a checkpointed sink.

No row is ever late: a row goes to its own minute or key whenever it arrives, and
``once`` counts from arrival. The checkpoint must be on durable shared storage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tallyflow.plans.page_events import (
    ALLOWED_DOMAINS,
    PAGE_KEY,
    page_create_filter,
    page_creations,
    page_rows,
    sse_payloads,
)
from tallyflow.plans.tweets import as_messages, build_tweets, tweet_rows
from tallyflow.sinks.levels import add_load, query_name
from tallyflow.sinks.minutes import stream_minutes
from tallyflow.sinks.topics import to_folder, to_kafka


def tweet_messages(reviews: DataFrame, now: str | None = None) -> DataFrame:
    """Reviews as tweet messages, created at the time of their micro-batch."""
    return as_messages(build_tweets(reviews, now))


def raw_messages(chunks: DataFrame) -> DataFrame:
    """Captured server-sent-event text as raw page events, each on one line whatever lines it came in."""
    return sse_payloads(chunks).select(F.to_json(F.try_parse_json("value")).alias("value"))


def page_messages(events: DataFrame, domains: Sequence[str] = tuple(ALLOWED_DOMAINS)) -> DataFrame:
    """Raw page events as processed messages."""
    return as_messages(page_create_filter(events, domains))


def to_topic(messages: DataFrame, topic: str, checkpoint: str, servers: str | None = None) -> DataStreamWriter:
    """Writer to the Kafka topic on ``servers``, or without them to the folder ``topic``."""
    return to_kafka(messages, servers, topic, checkpoint) if servers else to_folder(messages, topic, checkpoint)


def minute_files(messages: DataFrame, folder: str, checkpoint: str, now: str | None = None) -> DataStreamWriter:
    """Tweet messages to minute files."""
    return stream_minutes(tweet_rows(messages, now), folder, checkpoint)


def once(messages: DataFrame, within: str, key: Sequence[str] = ("value",)) -> DataFrame:
    """A stream without the messages that came before, as repeats do when a producer sends again.

    A message is a repeat if one with its key arrived less than ``within`` before; the state holds the keys
    of that time. It counts from the arrival, so a message is dropped as a repeat only, however old its
    content is. The checkpoint keeps the state over restarts.
    """
    return messages.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", within).dropDuplicatesWithinWatermark(
        list(key)).drop("_arrived")


def page_table(processed: DataFrame, table: str, checkpoint: str) -> DataStreamWriter:
    """Processed messages to the keyed page table, read by ``levels.read_table``.

    Each micro-batch is a load of its own, named by the query and the batch, so
    a batch repeated after a failure changes nothing, and a stream with a new
    checkpoint adds to what is there; a message sent twice meets its earlier
    row on the key when the table is read.
    """
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            add_load(page_creations(batch), table, PAGE_KEY, (query_name(batch.sparkSession, checkpoint), batch_id))

    return (
        page_rows(processed).writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write_batch)
    )
