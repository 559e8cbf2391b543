"""Minute files: one CSV file with one header for each minute, ``tweets_dd_MM_yyyy_HH_MM.csv``.

A micro-batch first stores its rows as parts by hour, in a folder named by the query and the batch, and
marks the folder as complete. Then it writes each minute it touched anew, from all complete parts, aside,
and renames it over the older file. Late rows so join their minute's file; a batch that is repeated finds
its parts and gives the same files; a reader sees the older or the newer file.

A minute's rows pass through one task, as they become one file. On a local or mounted file system tasks
write the lines, which Spark made, as plain files, and rename them after all are whole: Hadoop starts
processes of its own for each file that it creates there. Elsewhere Spark's writer makes the files.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tallyflow.plans.tweets import MINUTE_FILE, minute_rows
from tallyflow.sinks import commits
from tallyflow.sinks.levels import query_name

COLUMNS = ["author_id", "created_at", "text"]
ROW_SCHEMA = "author_id string, created_at string, text string"
PART_SCHEMA = f"{ROW_SCHEMA}, minute string, batch int"
CSV = {"header": "true", "escape": '"', "emptyValue": ""}
#: Files written aside are read by nobody yet, so each task moves its own into place.
BY_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
#: Leading characters of a minute that name its hour.
HOUR = len("dd_MM_yyyy_HH")
#: Minute files that one task writes, of many.
MINUTES_A_TASK = 200
#: Files renamed at a time.
RENAMES = 16
#: Files beyond which tasks rename those that tasks wrote.
RENAMES_HERE = 1_000
#: Scan tasks of many small files that are read as one.
SCANS = 16


def add_rows(rows: DataFrame, folder: str, batch: str) -> None:
    """Add rows (of ``minute_rows``) to the minute files; a batch that was added before changes nothing."""
    spark, parts = rows.sparkSession, f"{folder}/_parts"
    complete = {p.split("/")[-2] for p in commits.paths(spark, f"{parts}/*/_SUCCESS")}
    if batch not in complete:
        stamped = rows.withColumns({"batch": F.lit(len(complete)), "of": F.substring("minute", 1, HOUR)})
        stamped.repartition("of").sortWithinPartitions("of", "minute").write.mode("overwrite").partitionBy("of").parquet(
            f"{parts}/{batch}")
        complete.add(batch)
    own = [n.removeprefix("of=") for n in commits.names(spark, f"{parts}/{batch}/of=*")]
    if not own:
        return
    hours = set(own)
    touched = [p for p in commits.paths(spark, f"{parts}/*/of=*")
               if p.split("/")[-2] in complete and p.split("/")[-1].removeprefix("of=")[:HOUR] in hours]
    minutes = _parts(spark, [f"{parts}/{batch}/of={hour}" for hour in own]).select("minute").distinct()
    number = minutes.count()
    # a minute's older rows come first
    whole = _parts(spark, touched).select("minute", "batch", *COLUMNS).alias("p").join(
        minutes.alias("m"), F.col("p.minute").eqNullSafe(F.col("m.minute")), "left_semi")
    # files are many and small, so their number decides about the tasks
    tasks = [] if number < MINUTES_A_TASK else [max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-number // MINUTES_A_TASK))]
    aside = f"{folder}/_aside/{uuid.uuid4().hex}"
    laid = whole.repartition(*tasks, "minute").sortWithinPartitions("minute", "batch", *COLUMNS).drop("batch")
    (_put_local if commits.is_local(spark, folder) else _put)(laid, folder, aside)
    commits.remove(spark, aside)


def _put(laid: DataFrame, folder: str, aside: str) -> None:
    """The minute files of rows that lie minute by minute, through Spark's writer."""
    spark = laid.sparkSession
    laid.write.partitionBy("minute").options(**CSV, **BY_TASKS).csv(aside)
    prefix, suffix = MINUTE_FILE.split("{minute}")

    def put(path: str) -> None:
        minute = path.split("/")[-2].removeprefix("minute=")
        commits.replace(spark, path, f"{folder}/{prefix}{minute}{suffix}")

    with ThreadPoolExecutor(RENAMES) as pool:
        list(pool.map(put, commits.paths(spark, f"{aside}/minute=*/part-*")))


def _put_local(laid: DataFrame, folder: str, aside: str) -> None:
    """The same as plain files: each task writes into a folder of its own, and those of finished tasks are renamed."""
    line = F.to_csv(F.struct(*COLUMNS), {k: v for k, v in CSV.items() if k != "header"})
    lines = laid.select("minute", line.alias("line"))
    places = {r.place: r.files for r in lines.mapInArrow(_writer(commits.plain_path(aside)), "place string, files int").collect()}
    if sum(places.values()) > RENAMES_HERE:
        laid.sparkSession.sparkContext.parallelize(list(places), len(places)).foreach(_renamer(commits.plain_path(folder)))
        return
    names = [(place, name) for place in places for name in os.listdir(place)]
    with ThreadPoolExecutor(RENAMES) as pool:
        list(pool.map(lambda n: commits.replace(laid.sparkSession, "/".join(n), f"{folder}/{n[1]}"), names))


def _writer(aside: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines (minute, line), minutes in one run each, to a file for each minute; gives the folder of the files and their number."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, files, current, file = f"{aside}/{uuid.uuid4().hex}", 0, None, None
        try:
            for batch in batches:
                minutes = batch.column(0).dictionary_encode()
                numbers = minutes.indices.to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a == b:
                        continue
                    minute = minutes.dictionary[int(numbers[a])].as_py()
                    if minute != current:
                        if file:
                            file.close()
                        else:
                            os.makedirs(place)
                        files += 1
                        current, file = minute, open(f"{place}/{MINUTE_FILE.format(minute=minute)}", "w", encoding="utf-8", newline="")
                        file.write(",".join(COLUMNS) + "\n")
                    file.write("\n".join([*batch.column(1).slice(a, b - a).to_pylist(), ""]))
        finally:
            if file:
                file.close()
        if file:
            yield pa.RecordBatch.from_pydict({"place": [place], "files": pa.array([files], pa.int32())})

    return write


def _renamer(folder: str) -> Callable[[str], None]:
    def rename(place: str) -> None:
        for name in os.listdir(place):
            commits.replace_local(f"{place}/{name}", f"{folder}/{name}")

    return rename


def _parts(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.schema(PART_SCHEMA).option("recursiveFileLookup", "true").parquet(*folders)


def stream_minutes(rows: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Each micro-batch of rows to the minute files."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        add_rows(batch, folder, f"{query_name(batch.sparkSession, checkpoint)}-{batch_id}")

    return minute_rows(rows).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write_batch)


def read_minutes(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of the minute files, with their minute; empty cells are empty texts."""
    prefix, suffix = MINUTE_FILE.split("{minute}")
    rows = spark.read.schema(ROW_SCHEMA).options(
        header="true", escape='"', pathGlobFilter=f"{prefix}*{suffix}").csv(folder)
    name = F.regexp_extract(F.col("_metadata.file_name"), f"{prefix}(.*){suffix.replace('.', '[.]')}", 1)
    rows = rows.withColumn("minute", name).fillna("", subset=["author_id", "text"])
    # files are many and small
    scans, usual = rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.coalesce(max(usual, scans // SCANS)) if scans > usual else rows
