"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``virtual_nodes`` points of a ring of 64-bit positions. A row belongs to the shard
whose point follows its position clockwise. Shards have a capacity; rows that would overflow a full
shard continue clockwise to the next point of a shard with room. With n rows, ``n mod shards`` shards
hold one row more than the others, so counts differ by one at most, and a row moves only if its own
shard is full.

Which rows overflow is decided by counts: arcs of the ring are counted in Spark, the walk around the
ring sees one number for each arc (shards x virtual_nodes of them, a parameter and not the data), and
rows find the shard of their rank by a join with the resulting rank intervals.
"""

from __future__ import annotations

import bisect
import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyflow.llm.common import needed, stored

#: Rows of an arc are numbered in this many parts, so that no part is much larger than the others.
CELLS = 16

SEGMENT = "array<struct<arc:int,first:bigint,last:bigint,shard:int,slot:bigint>>"


def ring_points(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node in clockwise order; depends on the names of shards alone."""
    points = []
    for shard in range(shards):
        for node in range(virtual_nodes):
            digest = hashlib.blake2b(f"shard {shard} node {node}".encode(), digest_size=8).digest()
            points.append((int.from_bytes(digest, "big", signed=True), shard))
    return sorted(points)


def arc_of(position: Column, points: list[tuple[int, int]], bits: int = 16) -> Column:
    """Number of the virtual node that follows a position clockwise.

    The top bits look up the first node that can follow, then the few nodes within that part of the
    ring are compared.
    """
    starts = [p for p, _ in points]
    width = 1 << (64 - bits)
    first = [bisect.bisect_left(starts, -(1 << 63) + k * width) for k in range((1 << bits) + 1)]
    inside = max(b - a for a, b in zip(first, first[1:], strict=False))
    part = F.shiftright(position, 64 - bits).cast("int") + F.lit(1 << (bits - 1))
    base = F.element_at(_literal(first[:-1], "int"), part + 1)
    places, arc = _literal(starts, "bigint"), base
    for k in range(inside):
        passed = F.coalesce(F.get(places, base + k) < position, F.lit(False))
        arc = arc + F.when(passed, 1).otherwise(0)
    return F.pmod(arc, F.lit(len(points)))


def _literal(values: list[int], kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def walk(counts: list[int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Rank intervals (arc, first, last, shard, slot of the first) that place every row of every arc.

    Rows stay at home as far as their shard has room; the others go clockwise in the order in which
    they come, filling the room that is left.
    """
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    placed, over = [], []
    for arc, (n, shard) in enumerate(zip(counts, owners, strict=True)):
        home = min(n, room[shard] - used[shard])
        if home:
            placed.append((arc, 1, home, shard, used[shard]))
            used[shard] += home
        over.append((home + 1, n))
    waiting: list[list[int]] = []
    for step in range(2 * len(owners)):
        arc, shard = step % len(owners), owners[step % len(owners)]
        if step < len(owners) and over[arc][0] <= over[arc][1]:
            waiting.append([arc, *over[arc]])
        while waiting and used[shard] < room[shard]:
            origin, first, last = waiting[0]
            n = min(last - first + 1, room[shard] - used[shard])
            placed.append((origin, first, first + n - 1, shard, used[shard]))
            used[shard] += n
            waiting[0][1] += n
            if waiting[0][1] > last:
                waiting.pop(0)
    return placed


def _inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    names = [f.split(":")[0] for f in schema[len("array<struct<"):-2].split(",")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), schema)))


def shard_rows(docs: DataFrame, shards: int = 40, virtual_nodes: int = 64) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``. ``size`` is the UTF-8 bytes of the text (none for null) plus 16. Rows sit on
    the ring by a hash of doc_id and text checksum, so rows without doc_id spread too; copies of one
    row are numbered apart. ``home_shard`` is the shard on the ring before bounds, ``moved`` tells
    whether the row went on. ``grown_shard`` is null: it belongs to another law. No rows give no rows;
    further columns are ignored.
    """
    spark, points = docs.sparkSession, ring_points(shards, virtual_nodes)
    owners = [s for _, s in points]
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = needed(docs, ["doc_id", "text"]).select(
        "doc_id",
        (F.octet_length(raw) + 16).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.spark_partition_id().alias("source"),
    )
    rows = rows.withColumn("position", F.xxhash64("doc_id", "text_crc32"))
    rows = rows.withColumn("arc", arc_of(F.col("position"), points))
    # parts of an arc are cut across its positions and, for repeated rows, across input partitions
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("position", "source"), F.lit(CELLS)).cast("int")).drop("source")
    rows = stored(rows, "ring")
    cells = rows.groupBy("arc", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = stored(cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "cells")
    counts = [0] * len(points)
    # one row for each virtual node at most
    for arc, n in cells.groupBy("arc").agg(F.sum("n").alias("n")).collect():
        counts[arc] = n
    segments = _inline(spark, walk(counts, owners, shards), SEGMENT)
    rank = F.row_number().over(Window.partitionBy("arc", "cell").orderBy("position", "doc_id", "text_crc32", "size"))
    # both broadcast tables have a size set by the ring: virtual nodes x cells, virtual nodes + shards x virtual nodes
    ranked = rows.withColumn("rank", rank).join(
        F.broadcast(cells.select("arc", "cell", "before")), ["arc", "cell"]).withColumn("rank", F.col("rank") + F.col("before"))
    homes = F.element_at(_literal(owners, "int"), F.col("r.arc") + 1)
    inside = F.col("rank").between(F.col("s.first"), F.col("s.last"))
    return ranked.alias("r").join(F.broadcast(segments.alias("s")), (F.col("r.arc") == F.col("s.arc")) & inside).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("s.slot") + F.col("rank") - F.col("s.first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        homes.alias("home_shard"),
        (homes != F.col("shard")).alias("moved"),
    )
