"""SimHash near-duplicates by covering locality-sensitive hashing.

Each bit position of the fingerprint gets a nonzero vector of radius + 1 bits; a mask for every
nonzero vector v keeps the positions whose vector is orthogonal to v. Positions in which two
fingerprints differ span at most ``radius`` dimensions, so some v is orthogonal to all of them, and the
mask of the complement hides every difference: every pair within the radius meets in some table,
without fail.

Copies of a fingerprint collapse first. Buckets of up to COMPARED distinct fingerprints compare them
in their task. A larger bucket is not compared: each of its fingerprints is spread over all values within
half the radius of it, where two within the radius always meet, at a cost linear in the bucket; such a
meeting place holds no more fingerprints than there are values around it. Tasks give links that span
what is linked, never all pairs. Components follow by alternating star operations in Spark.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import needed, ready, slices, stored

BITS = 64
SEED = 42
#: A bucket with more distinct fingerprints than this is linked through neighbours instead of comparisons.
COMPARED = 4096
LINKS = "low long, high long"
#: Shingles hashed at a time.
HASHED = 8192


def fingerprint(norm: bytes, ends: np.ndarray, shingle: int) -> int:
    """SimHash of words laid end to end with one space between; ``ends`` are the words' end positions."""
    n = len(ends)
    if n == 0:
        return 0
    count = max(1, n - shingle + 1)
    starts = np.concatenate([[0], ends[: count - 1] + 1])
    stops = ends[min(n, shingle) - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, count, HASHED):
        pieces = zip(starts[at : at + HASHED].tolist(), stops[at : at + HASHED].tolist(), strict=True)
        hashes = np.array([digest(norm[a:b], SEED) for a, b in pieces], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    value = 0
    for bit in np.flatnonzero(2 * ones > count).tolist():
        value |= 1 << bit
    return value


def words_end_to_end(text: str) -> tuple[bytes, np.ndarray]:
    """The words of a text in lower case (A-Z) with one space between, and where each ends."""
    signs = np.frombuffer(text.encode().lower(), np.uint8)
    blank = (signs == 32) | ((signs >= 9) & (signs <= 13))
    last = np.flatnonzero(~blank)[-1:] + 1
    signs, blank = signs[: last.sum()], blank[: last.sum()]
    # of blanks the first after a word stays
    kept = ~blank
    kept[1:] |= ~blank[:-1]
    norm = np.where(blank, np.uint8(32), signs)[kept]
    ends = np.flatnonzero(norm == 32)
    return norm.tobytes(), np.append(ends, len(norm)) if len(norm) else ends


def fingerprints(texts: pa.Array, shingle: int) -> np.ndarray:
    """Fingerprints of whole texts as signed 64-bit numbers."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    out = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        value = text.as_py()
        if not value:
            continue
        out[i] = np.uint64(fingerprint(*words_end_to_end(value), shingle)).view(np.int64)
    return out


def covering_masks(radius: int, bits: int = BITS, seed: int = 8) -> list[int]:
    """The 2 ** (radius + 1) - 1 masks of the tables: any ``radius`` bit positions are hidden by one of them."""
    size = 1 << (radius + 1)
    # every nonzero vector is used about equally often
    vectors = np.random.default_rng(seed).permutation(np.resize(np.arange(1, size), bits)).tolist()
    masks = []
    for v in range(1, size):
        masks.append(sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2))
    return masks


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def spanning(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of ``size`` members, given links."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def near_pairs(buckets: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs within the radius in one bucket; rows are sorted by bucket."""
    lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    unsigned, left, step = values.view(np.uint64), np.arange(len(values)), 1
    while len(left):
        left = left[left + step < len(values)]
        left = left[buckets[left] == buckets[left + step]]
        near = np.bitwise_count(unsigned[left] ^ unsigned[left + step]) <= radius
        lefts.append(left[near])
        rights.append(left[near] + step)
        step += 1
    return np.concatenate(lefts), np.concatenate(rights)


def bucket_links(radius: int):
    """Reads rows (place, key, value) sorted by place and key; gives links that span what is within the radius."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)

        def links(rows: np.ndarray) -> pa.RecordBatch:
            change = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
            buckets = np.concatenate([[0], np.cumsum(change)])
            left, right = near_pairs(buckets, rows[2], radius)
            distinct, back = np.unique(rows[2], return_inverse=True)
            root = spanning(len(distinct), back[left], back[right])
            other = np.flatnonzero(root != np.arange(len(distinct)))
            return pa.RecordBatch.from_arrays(
                [pa.array(distinct[root[other]]), pa.array(distinct[other])], ["low", "high"])

        for batch in batches:
            rows = np.concatenate(
                [held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])], axis=1)
            if not rows.shape[1]:
                continue
            # the last bucket may go on in the next batch
            last = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])
            start = int(np.argmax(last))
            if start:
                yield links(rows[:, :start])
            held = rows[:, start:]
        if held.shape[1]:
            yield links(held)

    return run


def _crowded(rows: DataFrame) -> DataFrame:
    """(place, key, n) of buckets with more than one fingerprint."""
    return stored(rows.groupBy("place", "key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")


def _links(rows: DataFrame, radius: int) -> DataFrame:
    laid = rows.select("place", "key", "value").repartition("place", "key").sortWithinPartitions("place", "key")
    return laid.mapInArrow(bucket_links(radius), LINKS)


def links(values: DataFrame, radius: int, compared: int = COMPARED) -> DataFrame:
    """Links (low, high) that connect all distinct ``value``s within ``radius`` bits of each other."""
    masks = [signed(m) for m in covering_masks(radius)]
    value = F.col("value")
    tables = F.array(*[
        F.struct(F.lit(t).alias("place"), value.bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])
    rows = values.select(F.explode(tables).alias("t"), "value").select("t.place", "t.key", "value")
    crowded = _crowded(rows)
    meeting = rows.join(crowded, ["place", "key"])
    found = _links(meeting.filter(F.col("n") <= compared), radius)
    if crowded.filter(F.col("n") > compared).isEmpty():
        return found
    turns = [0]
    for n in range(1, (radius + 1) // 2 + 1):
        turns += [signed(sum(1 << b for b in chosen)) for chosen in itertools.combinations(range(BITS), n)]
    hot = stored(meeting.filter(F.col("n") > compared).select("value").distinct(), "hot")
    turned = F.transform(F.from_json(F.lit(str(turns)), "array<bigint>"), lambda t: value.bitwiseXOR(t))
    around = hot.select(F.lit(-1).alias("place"), F.explode(turned).alias("key"), "value")
    return found.unionByName(_links(around.join(_crowded(around).drop("n"), ["place", "key"]), radius))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of a graph: root is the smallest node it is connected to.

    Alternating star operations: every node's larger neighbours move to its smallest one, then every
    node's smaller neighbours do, until nothing changes. Minima are combined before they are shuffled
    and edges meet them in a join whose hot keys are split, so a star of any size is no hot task.
    """
    def stars(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.greatest("low", "high").alias("a"), F.least("low", "high").alias("b"))
        if large:
            both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        met = both.join(least, "a")
        if large:
            moved = met.filter("b > a").select(F.col("m").alias("low"), F.col("b").alias("high"))
        else:
            moved = met.select(F.col("m").alias("low"), F.explode(F.array("a", "b")).alias("high"))
        return moved.filter("low <> high").distinct()

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.select(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first())

    current = stored(edges.distinct(), "edges")
    seen = mark(current)
    while True:
        current = stored(stars(stored(stars(current, True), "stars"), False), "edges")
        now = mark(current)
        if now == seen:
            return current.select(F.col("high").alias("node"), F.col("low").alias("root"))
        seen = now


def fingerprinted(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, value) of whole texts, stored."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(fingerprints(batch.column(1), shingle)), batch.column(2)],
                    ["doc_id", "value", "text_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = needed(docs, ["doc_id", "text"]).withColumn("text_sha256", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    return stored(rows.mapInArrow(run, f"doc_id {kind}, value long, text_sha256 string"), "fingerprints")


def rooted(rows: DataFrame, radius: int) -> DataFrame:
    """(value, root) of every distinct fingerprint: root is the smallest fingerprint it is linked to."""
    values = stored(rows.select("value").distinct(), "values")
    roots = components(links(values, radius)).withColumnRenamed("node", "value")
    return stored(values.join(roots, "value", "left").withColumn("root", F.coalesce("root", "value")), "rooted")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    The text in lower case (A-Z only) is cut at ASCII white space; shingles of ``shingle`` words, repeats
    included, are hashed, a shorter text as a whole; a null or blank text has fingerprint zero and is
    linked like any other. Documents link at ``radius`` or fewer differing bits; component_id is the
    smallest doc_id that can be reached, the own one included (null if none of them has an id). Rows that
    repeat are rows of their own; no rows give no rows; further columns are ignored.
    """
    rows = fingerprinted(docs, shingle)
    roots = rooted(rows, radius)
    # the smallest id of a fingerprint, then of a component: both combined before they are shuffled
    first = rows.groupBy("value").agg(F.min("doc_id").alias("first")).join(roots, "value")
    least = first.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(roots.join(least, "root").select("value", "component_id"), "named")
    return rows.join(named, "value").select(
        "doc_id", F.lower(F.lpad(F.hex("value"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """One document of each group of ``near_duplicates``, with the columns they came with.

    The smallest doc_id stays, rows without an id last; of those with one id the text of the smallest
    sha256. Rows that repeat an id and a text stay or go together (exact deduplication tells them apart).
    """
    rows = fingerprinted(docs, shingle)
    grouped = stored(rows.join(rooted(rows, radius), "value"), "grouped")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_sha256")
    sizes = grouped.groupBy("root").agg(F.min(order).alias("best"), F.count("*").alias("n")).filter("n > 1")
    best = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_sha256") == F.col("best.text_sha256"))
    going = stored(grouped.join(sizes, "root").filter(~best).select("doc_id", "text_sha256"), "going").distinct()
    sha = F.sha2(F.coalesce(F.col("d.text"), F.lit("")), 256)
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (sha == F.col("g.text_sha256"))
    # most corpora drop more than could be broadcast; the same plan on every size
    return docs.alias("d").join(going.hint("merge").alias("g"), same, "left_anti")
