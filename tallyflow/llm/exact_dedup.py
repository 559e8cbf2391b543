"""Exact deduplication by counting quotient filters.

1. Each input partition builds filters over the fingerprints of its texts, one for each block.
2. Filters of a block merge losslessly by their sorted remainders. A row is one filter, so copies
   of a text meet as one count for each partition, however many there are.
3. Only texts whose fingerprint counts more than one travel. They are grouped by their bytes, copies
   being collapsed before the exchange; equal fingerprints of different texts part here.
4. Rows find their group by (fingerprint, sha256); a hot group is split by the skew join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.llm import quotient
from tallyflow.llm.common import needed, ready, stored

FILTER_SCHEMA = "block int, occupied binary, run_ends binary, remainders binary, counts binary"
REPEATED_SCHEMA = "fingerprint long, copies long"


def build_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filters of one partition's fingerprints, a row for each block."""
    seen, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        new = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        seen, counts = quotient.summed(
            np.concatenate([seen, new]), np.concatenate([counts, np.ones(len(new), np.int64)]))
    blocks = quotient.block_of(seen)
    cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(seen)]
    if len(seen):
        rows = [
            {"block": int(blocks[a]), **quotient.encode(seen[a:b], counts[a:b])}
            for a, b in zip(cuts, cuts[1:], strict=False)
        ]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([
            ("block", pa.int32()), *((c, pa.binary()) for c in ("occupied", "run_ends", "remainders", "counts"))]))


def merge_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints that count more than one, from filters sorted by block; holds one block at a time."""
    block, parts = None, []

    def repeats() -> pa.RecordBatch:
        seen, counts = quotient.summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        more = counts > 1
        return pa.RecordBatch.from_arrays(
            [pa.array(seen[more].view(np.int64)), pa.array(counts[more])], ["fingerprint", "copies"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["block"] != block and parts:
                yield repeats()
                parts = []
            block = row["block"]
            parts.append(quotient.decode(**row))
    if parts:
        yield repeats()


def repeated_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """(fingerprint, copies) of a one-column frame of 64-bit fingerprints, where copies > 1."""
    filters = fingerprints.mapInArrow(build_filters, FILTER_SCHEMA)
    return filters.repartition("block").sortWithinPartitions("block").mapInArrow(merge_filters, REPEATED_SCHEMA)


def exact_classes(docs: DataFrame, fingerprint: Column | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty, so null and empty texts are
    one group. Of equal texts the row with the largest doc_id stays; a null doc_id counts as smaller
    than any other. If rows repeat with one doc_id, each of them has ``kept`` (a doc_id stays or
    goes as a whole; ``exact_dedup`` leaves one of them). An empty table gives no rows; further
    columns are ignored. ``fingerprint`` replaces the 64-bit hash of ``text`` (tests force collisions).
    """
    ready(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = F.xxhash64("text") if fingerprint is None else fingerprint
    rows = needed(docs, ["doc_id", "text"]).withColumn("text", text).withColumn("fingerprint", hashed.cast("long"))
    repeats = stored(repeated_fingerprints(rows.select("fingerprint")), "repeats")
    suspects = rows.join(repeats.select("fingerprint"), "fingerprint", "left_semi")
    # the grouping itself compares bytes
    groups = suspects.groupBy("fingerprint", "text").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.select(
        "fingerprint", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    groups = stored(groups, "groups")
    narrow = rows.select("doc_id", "fingerprint", F.sha2("text", 256).alias("text_sha256"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return narrow.join(groups, ["fingerprint", "text_sha256"], "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, with the columns they came with.

    Of rows that repeat with one doc_id and one text, one stays.
    """
    columns = docs.columns
    classes = exact_classes(docs)
    going = stored(classes.filter("NOT kept").select("doc_id", "text_sha256"), "going").distinct()
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    # most corpora drop more than could be broadcast; the same plan on every size
    same = docs.withColumn("_sha", sha).alias("d").join(
        going.hint("merge").alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d._sha") == F.col("g.text_sha256")),
        "left_anti")
    twice = stored(
        classes.filter("kept AND group_size > 1").groupBy("doc_id", "text_sha256").count().filter("count > 1"), "twice")
    if twice.isEmpty():
        return same.select(*[F.col(f"d.`{c}`") for c in columns])
    on = F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("d._sha") == F.col("t.text_sha256"))
    single = same.join(twice.alias("t"), on, "left_anti").select(*[F.col(f"d.`{c}`") for c in columns])
    several = same.join(twice.alias("t"), on, "left_semi")
    one = several.groupBy("doc_id", "_sha").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in columns]), F.to_json(
        F.struct(*[F.col(f"`{c}`") for c in columns if c != "text"]))).alias("r"))
    return single.unionByName(one.select(*[F.col(f"r.`{c}`") for c in columns]))
