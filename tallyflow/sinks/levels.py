"""Keyed tables that stay small to read: loads fold into levels, and every change is one commit.

A load adds a folder at level 0. When a level holds ``FAN`` folders, they are merged into one of the next
level, newest rows of each key only. So a table of n loads has at most ``FAN`` folders on each of about
log(n) levels, and each row is rewritten about log(n) times. A load and the merges it causes are committed
together (see ``commits``): readers see the state before or after, never between.

Folders that merges replaced stay for ``KEPT`` commits, for readers that began before.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.operators.keyed import newest_version
from tallyflow.sinks import commits

FAN = 8
KEPT = 10


def _rows(spark: SparkSession, path: str, runs: Sequence[dict], key: Sequence[str]) -> DataFrame:
    """Of each key the rows of its newest run; a single run is read as it is."""
    frames = [spark.read.parquet(f"{path}/{run['folder']}") for run in runs]
    if len(frames) == 1:
        return frames[0]
    stamped = [frame.withColumn("_run", F.lit(i)) for i, frame in enumerate(frames)]
    return newest_version(reduce(DataFrame.unionByName, stamped), key, "_run").drop("_run")


def add_load(df: DataFrame, path: str, key: Sequence[str], name: tuple[str, int] | None = None, fan: int = FAN, **more: object) -> bool:
    """Add a load whose rows replace older ones of their keys; False if it was there.

    ``name`` is (source, number): of a source only numbers beyond its last one are new, so a repeated
    micro-batch changes nothing. ``more`` is kept in the commit.
    """
    spark = df.sparkSession
    number, state = commits.latest(spark, path)
    seen = state.get("seen", {})
    if name and seen.get(name[0], -1) >= name[1]:
        return False
    runs, retired = list(state.get("runs", [])), list(state.get("retired", []))
    folder = commits.new_folder(number + 1)
    df.write.parquet(f"{path}/{folder}")
    runs.append({"folder": folder, "level": 0})
    while len(last := [r for r in runs if r["level"] == runs[-1]["level"]]) >= fan:
        folder = commits.new_folder(number + 1)
        _rows(spark, path, last, key).write.parquet(f"{path}/{folder}")
        retired += [{"folder": r["folder"], "since": number + 1} for r in last]
        runs = [*runs[: -len(last)], {"folder": folder, "level": last[0]["level"] + 1}]
    gone = [r for r in retired if r["since"] <= number + 1 - KEPT]
    commits.commit(spark, path, number + 1, {
        **{k: v for k, v in state.items() if k not in ("runs", "seen", "retired")}, **more, "runs": runs,
        "seen": {**seen, **({name[0]: name[1]} if name else {})}, "retired": [r for r in retired if r not in gone]})
    for r in gone:
        commits.remove(spark, f"{path}/{r['folder']}")
    if number >= KEPT:
        commits.remove(spark, f"{path}/{commits.FOLDER}/{number - KEPT:08d}")
    return True


def read_table(spark: SparkSession, path: str, key: Sequence[str]) -> DataFrame:
    """The current rows of a table; filters on the key reach its folders."""
    _, state = commits.latest(spark, path)
    if not state:
        raise FileNotFoundError(f"{path} holds no finished load")
    return _rows(spark, path, state["runs"], key)


def folders(spark: SparkSession, path: str) -> list[dict]:
    """The folders that make up a table now, oldest first, with their level."""
    return commits.latest(spark, path)[1].get("runs", [])


def query_name(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint gives its query; a new checkpoint is another query."""
    return json.loads(commits.read_text(spark, f"{checkpoint}/metadata"))["id"]
