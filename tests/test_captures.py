"""Captured event text by byte ranges, and Bloom filters of stored tables."""

import os
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyflow.plans.page_events import sse_payloads
from tallyflow.sinks.tables import blooms, overwrite
from tallyflow.sources import captures
from tallyflow.streaming import jobs
from tallyflow.sources.topics import stored_topic


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb:", "\n", "\r", "\r\n", "\n\n", "\r\r", "\r\n\r\n", " ", "é", "data: {}"]), max_size=40),
       st.integers(1, 30), st.sampled_from([1, 2, 3, 7, 1 << 20]))
def test_every_event_is_in_one_range(parts, size, block):
    """Ranges of any size give the text between blank lines once, in order, and cut at blank lines only."""
    raw = "".join(parts).encode()
    old, captures.BLOCK_BYTES = captures.BLOCK_BYTES, block
    try:
        file = pa.BufferReader(raw)
        runs = [text for begin in range(0, len(raw), size)
                for text in captures.events(file, len(raw), begin, min(len(raw), begin + size), limit=5)]
        assert "".join(runs).encode() == raw
        whole = [line for _, line in captures.lines(file, 0, len(raw))]
        ends, at = set(), 0
        for line in whole:
            at += len(line)
            if not line.strip():
                ends.add(at)
    finally:
        captures.BLOCK_BYTES = old
    at = 0
    for text in runs[:-1]:
        at += len(text.encode())
        assert at in ends


def capture(seed, count):
    pick, out = random.Random(seed), []
    for k in range(count):
        end = pick.choice(["\n", "\r", "\r\n"])
        lines = [": comment", f'data: {{"n": {k},', f'data: "t": "{"x" * pick.randint(0, 300)}"}}', ""]
        out.append(end.join(lines) + end)
    return "".join(out)


@pytest.mark.parametrize("size", [50, 999, 1 << 20])
def test_captures_split_over_tasks(spark, rows, folder, size):
    text = capture(size, 60)
    with open(f"{folder}/one.sse", "w", newline="") as file:
        file.write(text)
    found = captures.read_captures(spark, folder, size)
    whole = sse_payloads(spark.createDataFrame([(text,)], "value string"))
    assert rows(sse_payloads(found)) == rows(whole) and whole.count() == 60
    assert found.select("value").count() >= min(20, len(text) // size)


def test_capture_streams_restart_without_loss(spark, folder):
    def arrive(name, seed):
        with open(f"{folder}/in/{name}", "w", newline="") as file:
            file.write(capture(seed, 10))

    def run():
        chunks = captures.stream_captures(spark, f"{folder}/in", 1, 500)
        jobs.to_topic(jobs.raw_messages(chunks), f"{folder}/out", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
        return stored_topic(spark, f"{folder}/out").count()

    os.mkdir(f"{folder}/in")
    arrive("a", 1)
    arrive("b", 2)
    assert run() == 20
    arrive("c", 3)
    assert run() == 30 and run() == 30


def rows_scanned(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_bloom_filters_skip_row_groups(spark, folder):
    """A lookup by a column that is not the order of the table reads the row groups that may hold the value."""
    table = spark.range(0, 40_000, 1, 4).selectExpr("id AS place", "md5(CAST(id AS STRING)) AS review_id")
    small = {"parquet.block.size": "100000", "parquet.enable.dictionary": "false"}
    overwrite(table, f"{folder}/plain", **small)
    overwrite(table, f"{folder}/bloom", **small, **blooms("review_id"))
    wanted = table.filter("place = 12345").first().review_id
    plain, bloom = (spark.read.parquet(f"{folder}/{name}").filter(f"review_id = '{wanted}'") for name in ("plain", "bloom"))
    assert bloom.first().place == 12345
    assert rows_scanned(bloom) < rows_scanned(plain) / 2
