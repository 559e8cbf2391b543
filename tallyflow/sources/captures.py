"""Captured server-sent-event text with any line ends, read by byte ranges in batch and stream.

Spark lists the files, and in a stream remembers which it has read; their content is not loaded by that.
Each file becomes rows of byte ranges, which are dealt to tasks; a task opens the file at its range through
Arrow's file systems. An event belongs to the range in which the blank line before it begins, so that a
range knows its events by looking around its own borders, whatever line ends (``\\n``, ``\\r``, ``\\r\\n``,
mixed) the capture has.

Files must be whole when they appear. Stores that Arrow cannot open are read by ``files.read_sse``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_BYTES = 64 << 20
BLOCK_BYTES = 1 << 20

FILES = "path string, modificationTime timestamp, length long, content binary"
LINE = re.compile(rb"[^\r\n]*(?:\r\n|\n|\r)")


def lines(file: pa.NativeFile, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(start, line with its end) from a position on; the last line may have no end."""
    held, start = b"", at
    while True:
        block = file.read_at(min(BLOCK_BYTES, size - at), at) if at < size else b""
        at += len(block)
        held += block
        done, last = 0, not block
        for found in LINE.finditer(held):
            # a carriage return at the end of what is read may be half of a line end
            if found.end() == len(held) and held.endswith(b"\r") and not last:
                break
            yield start + done, found.group()
            done = found.end()
        held, start = held[done:], start + done
        if last:
            if held:
                yield start, held
            return


def events(file: pa.NativeFile, size: int, begin: int, end: int, limit: int = BLOCK_BYTES) -> Iterator[str]:
    """The events of one byte range, as text in runs of whole events of about ``limit`` bytes."""
    started, run, length = begin == 0, [], 0
    found = lines(file, begin, size)
    if begin:
        before, first = file.read_at(2, begin - 1)[:1], file.read_at(1, begin)
        if not (before == b"\n" or (before == b"\r" and first != b"\n")):
            next(found, None)
    for at, line in found:
        blank = not line.decode("utf-8", "replace").strip()
        if not started:
            if at >= end:
                return
            started = blank
            continue
        run.append(line)
        length += len(line)
        if blank and (at >= end or length >= limit):
            yield b"".join(run).decode("utf-8", "replace")
            run, length = [], 0
            if at >= end:
                return
    if run:
        yield b"".join(run).decode("utf-8", "replace")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            uri = re.sub("^file:/+", "file:///", row["path"])
            system, path = fs.FileSystem.from_uri(uri)
            with system.open_input_file(path) as file:
                for text in events(file, row["length"], row["begin"], row["end"]):
                    yield pa.RecordBatch.from_arrays([pa.array([text], pa.string())], ["value"])


def event_chunks(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Chunks of whole events out of files (path, length), for ``page_events.sse_payloads``."""
    step = F.lit(range_bytes).cast("long")
    begins = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, step)
    ranges = files.filter("length > 0").select("path", "length", F.explode(begins).alias("begin"))
    ranges = ranges.withColumn("end", F.least(F.col("begin") + step, F.col("length")))
    return ranges.repartition("path", "begin").select("path", "length", "begin", "end").mapInArrow(_read, "value string")


def read_captures(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All events of the captures at a path, as chunks."""
    return event_chunks(spark.read.format("binaryFile").load(path).select("path", "length"), range_bytes)


def stream_captures(spark: SparkSession, folder: str, max_files: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The same for captures that arrive in a folder, as a stream; its checkpoint knows the files that were read."""
    reader = spark.readStream.format("binaryFile").schema(FILES)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return event_chunks(reader.load(folder).select("path", "length"), range_bytes)
