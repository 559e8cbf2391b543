"""CSV files whose quoted fields may hold line ends, read by many tasks.

A byte range can't tell by itself whether it begins inside a quoted field. So the files are read twice as
plain lines, by the ranges Spark cuts them into:

1. Each range counts its quotes, odd or even; the sum over all ranges before it says how it begins.
2. Knowing that, each range joins its lines to records. Only what lies across a border of ranges (at most
   two pieces of a record a range) is put together in a shuffle; all other rows stay where they were read.

Quotes must be balanced as CSV has it: around a field, or doubled inside one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyflow.session import scratch_folder

#: Byte ranges, at some hundred bytes each, that are broadcast; of more, lines meet their range in a shuffle.
MOST_RANGES = 200_000

PIECES = "range string, kind int, leading boolean, text string"
#: Kinds of pieces: a record as a whole, the end of one, the begin of one, and neither.
WHOLE, END, BEGIN, MIDDLE = range(4)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (range, begins inside quotes, line), ranges in one run each, to records and pieces at the borders."""
    kind = _Range()
    for batch in batches:
        ranges = batch.column(0).dictionary_encode()
        numbers = ranges.indices.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            name = ranges.dictionary[int(numbers[a])].as_py()
            if name != kind.name:
                yield from kind.finish()
                kind = _Range(name, bool(batch.column(1)[a].as_py()))
            yield from kind.add(batch.column(2).slice(a, b - a))
    yield from kind.finish()


class _Range:
    """The lines of one byte range in order; holds those of the record that is not complete yet."""

    def __init__(self, name: str | None = None, inside: bool = False):
        self.name, self.inside = name, inside
        self.headless, self.first = inside, True
        self.held = pa.array([], pa.string())

    def _rows(self, texts: pa.Array, kind: int) -> Iterator[pa.RecordBatch]:
        n = len(texts)
        if n:
            leading = np.zeros(n, bool)
            leading[0], self.first = self.first and kind in (WHOLE, BEGIN), self.first and kind not in (WHOLE, BEGIN)
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.name] * n, pa.string()), pa.array(np.full(n, kind, np.int32)), pa.array(leading), texts],
                ["range", "kind", "leading", "text"])

    def add(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        odd = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False) & 1
        after = (int(self.inside) + np.cumsum(odd)) & 1
        # places after which a record is complete
        ends = np.flatnonzero(after == 0) + 1 + len(self.held)
        lines = pa.concat_arrays([self.held, lines])
        self.inside = bool(after[-1])
        if len(ends):
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            texts = pc.binary_join(pa.ListArray.from_arrays(offsets, lines), "\n")
            if self.headless:
                yield from self._rows(texts.slice(0, 1), END)
                texts, self.headless = texts.slice(1), False
            yield from self._rows(texts, WHOLE)
            lines = lines.slice(int(ends[-1]))
        self.held = lines

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.name is not None and len(self.held):
            whole = pa.ListArray.from_arrays(pa.array([0, len(self.held)], pa.int32()), self.held)
            yield from self._rows(pc.binary_join(whole, "\n"), MIDDLE if self.headless else BEGIN)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(text, leading): the records of CSV files as text, and whether a record is the first of its file.

    Lines end with a line feed, in files whose first line has a carriage return before it with both.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), "value")
    name = F.concat_ws(" ", F.col("begin").cast("string"), F.col("file"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    # a range is read by one task in order, so the first value of the first range is the file's first line
    ranges = lines.groupBy("file", "begin").agg(
        F.sum(quotes).alias("quotes"), F.first(F.col("value").endswith("\r")).alias("returns"))
    of_file = Window.partitionBy("file").orderBy("begin")
    earlier = of_file.rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        "file", "begin", (F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1).alias("inside"),
        F.first("returns").over(of_file).alias("returns"))
    kept, path_of = ranges.schema, scratch_folder(spark, "ranges")
    ranges.write.parquet(path_of)
    ranges = spark.read.schema(kept).parquet(path_of)
    if ranges.count() <= MOST_RANGES:
        known = lines.join(F.broadcast(ranges), ["file", "begin"])
    else:
        placed = lines.withColumn("place", F.monotonically_increasing_id())
        known = placed.join(ranges.hint("shuffle_hash"), ["file", "begin"]).sortWithinPartitions("file", "begin", "place")
    # where lines end with a carriage return too, it is part of the line end inside fields as well
    value = F.when(F.col("returns"), F.regexp_replace("value", "\r$", "")).otherwise(F.col("value")).alias("value")
    pieces = known.select(name.alias("range"), "inside", value).mapInArrow(_records, PIECES)
    pieces = pieces.withColumns({"begin": F.substring_index("range", " ", 1).cast("long"),
                                 "file": F.expr("substr(range, instr(range, ' ') + 1)")})
    whole = pieces.filter(F.col("kind") == WHOLE).select("text", (F.col("leading") & (F.col("begin") == 0)).alias("leading"))
    # the pieces of a record have the range in which it begins in common
    parts = pieces.filter(F.col("kind") != WHOLE)
    # of one range the end of a record comes before the begin of another
    order = F.when(F.col("kind") == BEGIN, 2).otherwise(1)
    upto = Window.partitionBy("file").orderBy("begin", order).rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("order", order).withColumn(
        "since", F.last(F.when(F.col("kind") == BEGIN, F.col("begin")), ignorenulls=True).over(upto))
    joined = parts.groupBy("file", "since").agg(
        F.array_sort(F.collect_list(F.struct("begin", "order", "text"))).alias("parts"), F.max("leading").alias("leading"))
    joined = joined.select(F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"),
                           (F.col("leading") & (F.col("since") == 0)).alias("leading"))
    return whole.unionByName(joined)


def read_quoted_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """CSV files with a header, quoted by ``"`` and escaped by doubling it, as rows of ``schema`` by position.

    The rows that Spark's ``multiLine`` gives, but a file is read by as many tasks as it has byte ranges.
    """
    records = csv_records(spark, path).filter("NOT leading AND text <> ''")
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "lineSep": "\n"}
    return records.select(F.from_csv("text", schema, options).alias("row")).select("row.*")
