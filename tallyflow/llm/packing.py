"""Sequence packing by non-negative least squares on the length histogram.

1. Documents are encoded and cut into pieces: full windows, and the rest. Pieces are counted by length.
2. Shallow combinations (up to three bins of lengths that fill the window) are enumerated; non-negative
   least squares finds how often to repeat each to use up the histogram; repeats are rounded down to what
   the histogram holds.
3. What is left, and what rounding left free, is packed greedily by true lengths and counts: longest
   first, each time the longest that still fits.
4. Pieces are numbered within their length in Spark and find their sequence and offset by their number.

The solver sees one number for each length (the window is a parameter), whatever the number of documents.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.llm.bpe import DEFAULT_VOCABULARY, WordBpe
from tallyflow.llm.common import needed, ready, slices, stored

WINDOW = 4096
#: Least squares sees lengths rounded up to multiples of this.
GRAIN = 16
END_ID = 2
#: Pieces of a length are numbered in this many parts, so that a hot length is no hot task.
CELLS = 32


class LibraryBpe(WordBpe):
    """Texts are cut and remembered as in ``bpe``, new words go to the tokenizer library's own merging."""

    def encode_words(self, words: list[str]) -> list[list[int]]:
        model = self.library.model
        return [[token.id for token in model.tokenize(word)] for word in words]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> LibraryBpe:
    """The vocabulary at ``path``, read once in each worker."""
    return LibraryBpe(path)


def combinations(bins: int, depth: int = 3) -> np.ndarray:
    """Rows of up to ``depth`` bin numbers (1 to ``bins``, zero for none) that add up to ``bins``."""
    found = [(bins, 0, 0)]
    if depth > 1:
        found += [(a, bins - a, 0) for a in range((bins + 1) // 2, bins)]
    if depth > 2:
        found += [
            (a, b, bins - a - b)
            for a in range(1, bins - 1) for b in range((bins - a + 1) // 2, min(a, bins - a - 1) + 1)
        ]
    return np.array(found, np.int64)


def nonnegative_least_squares(matrix: np.ndarray, target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that makes matrix @ x close to target, by accelerated projected gradients."""
    vector = np.ones(matrix.shape[1])
    for _ in range(30):
        vector = matrix.T @ (matrix @ vector)
        vector /= np.linalg.norm(vector)
    step = 1.0 / (1.05 * np.linalg.norm(matrix.T @ (matrix @ vector)))
    x = y = np.zeros(matrix.shape[1])
    momentum = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * (matrix.T @ (matrix @ y - target)))
        after = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
        if np.dot(y - new, new - x) > 0:  # overshoot: start the acceleration anew
            after = 1.0
        y, x, momentum = new + (momentum - 1) / after * (new - x), new, after
    return x


def _coarse(left: np.ndarray, grain: int, depth: int) -> list[tuple[int, list[int]]]:
    """(repeats, bins of a sequence) that use up the pieces counted in bins of ``grain`` ids, by least squares."""
    bins = (len(left) - 1) // grain
    counts = np.zeros(bins + 1, np.int64)
    np.add.at(counts, -(-np.arange(len(left)) // grain), left)
    options = combinations(bins, depth)
    options = options[(counts[options] > 0)[:, 0] & ((counts[options] > 0) | (options == 0)).all(axis=1)]
    if not len(options):
        return []
    matrix = np.zeros((bins + 1, len(options)))
    np.add.at(matrix, (options.ravel(), np.repeat(np.arange(len(options)), options.shape[1])), 1.0)
    matrix = matrix[1:]
    scale = float(counts.max())
    repeats = np.rint(nonnegative_least_squares(matrix, counts[1:] / scale) * scale)
    chosen = []
    for k in np.argsort(-repeats, kind="stable"):
        used = options[k][options[k] > 0]
        kinds, each = np.unique(used, return_counts=True)
        n = int(min(repeats[k], (counts[kinds] // each).min()))
        if n > 0:
            counts[kinds] -= n * each
            chosen.append((n, used.tolist()))
    return chosen


class _Lengths:
    """Pieces that are left, by length; the longest that fits is found through a table of the lengths in use."""

    def __init__(self, histogram: np.ndarray):
        self.left = histogram.astype(np.int64).tolist()
        # the longest length in use up to each length; entries only ever point too high and are mended when met
        self.below = np.maximum.accumulate(np.where(histogram > 0, np.arange(len(histogram)), 0)).tolist()

    def longest(self, room: int) -> int:
        """The longest length of at most ``room`` that is left, 0 if there is none."""
        path, at = [], room
        while at > 0 and not self.left[found := self.below[at]]:
            path.append(at)
            if not found:
                at = 0
                break
            at = found - 1
        else:
            at = self.below[at] if at > 0 else 0
        for p in path:
            self.below[p] = at
        return at

    def fill(self, room: int, repeats: int, members: list[tuple[int, int]]) -> tuple[int, list[tuple[int, int]]]:
        """Fill ``repeats`` equal sequences with ``room`` left, the longest that fits first, as long as they stay equal."""
        taken, limit = {}, room
        while (length := self.longest(min(room, limit))):
            have = self.left[length] - taken.get(length, 0) * repeats
            each = min(room // length, have // repeats)
            if not each:
                # fewer than one each: as many sequences as there are pieces, the others wait
                if have <= 0 or members or taken:
                    limit = length - 1
                    continue
                repeats, each = have, 1
            taken[length] = taken.get(length, 0) + each
            room -= each * length
            limit = length - 1 if each * repeats >= have else room
        for length, each in taken.items():
            self.left[length] -= each * repeats
        return repeats, members + list(taken.items())


def plan(histogram: np.ndarray, grain: int = GRAIN, depth: int = 3) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repeats, [(length, how many of it)]) of the sequences that use up a histogram.

    ``histogram[l]`` counts pieces of l ids, up to the window. Least squares sees bins of ``grain`` ids;
    a bin's pieces go into its combinations longest first, and what rounding leaves free is filled by
    true lengths, as are all further sequences.
    """
    window, lengths = len(histogram) - 1, _Lengths(histogram)
    left, chosen = lengths.left, []
    for n, bins in _coarse(np.array(left), grain, depth):
        while n:
            # the longest pieces of each bin, for as many sequences as they last
            members: dict[int, int] = {}
            for number in bins:
                length = next((k for k in range(min(window, number * grain), (number - 1) * grain, -1)
                               if left[k] > members.get(k, 0)), 0)
                if not length:
                    break
                members[length] = members.get(length, 0) + 1
            else:
                same = min([n, *(left[k] // each for k, each in members.items())])
                for k, each in members.items():
                    left[k] -= each * same
                repeats, full = lengths.fill(window - sum(k * each for k, each in members.items()), same, list(members.items()))
                chosen.append((repeats, full))
                n -= same
                continue
            break
    while (length := lengths.longest(window)):
        each = min(window // length, left[length])
        repeats = left[length] // each
        left[length] -= each * repeats
        chosen.append(lengths.fill(window - each * length, repeats, [(length, each)]))
    return chosen


def pieces(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Documents as pieces of at most ``window`` ids: doc_id, start, length, ids_crc32, doc_tokens."""
    ready(docs.sparkSession)
    path = path or public_tokenizers.path(DEFAULT_VOCABULARY)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for whole in batches:
            for batch in slices(whole, limit=16 << 20):
                offsets, codes, ids = bpe.encode_batch(batch.column(1))
                rows = []
                for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    own = b"".join([*[ids[c] for c in codes[a:b].tolist()], end])
                    for at in range(0, len(own), 4 * window):
                        part = own[at : at + 4 * window]
                        rows.append((k, at // 4, len(part) // 4, zlib.crc32(part), len(own) // 4))
                which, *values = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(which, pa.int64())), *(pa.array(v, pa.int64()) for v in values)],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return needed(docs, ["doc_id", "text"]).mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, grain: int = GRAIN, depth: int = 3) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of a document, its end id included, lies in one piece; pieces of a sequence lie end to
    end from offset 0. A null or empty text is a piece of the end id alone. Rows that repeat are
    packed each; no rows give no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    cut = pieces(docs, path, window)
    cut = cut.withColumn("cell", F.pmod(F.xxhash64("doc_id", "start", F.spark_partition_id()), F.lit(CELLS)).cast("int"))
    cut = stored(cut, "pieces")
    cells = cut.groupBy("length", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = stored(cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "cells")
    histogram = np.zeros(window + 1, np.int64)
    # one row for each length
    for number, n in cells.groupBy("length").agg(F.sum("n")).collect():
        histogram[number] = n
    # which numbers of a length go to which sequences, how many to each, and from which offset
    used, intervals, sequence = np.zeros(window + 1, np.int64), [], 0
    for repeats, members in plan(histogram, grain, depth):
        offset = 0
        for number, each in members:
            first = int(used[number])
            used[number] += repeats * each
            intervals.append({"length": number, "first": first, "last": int(used[number]) - 1, "base": sequence,
                              "each": each, "at": offset})
            offset += number * each
        sequence += repeats
    schema = "array<struct<length:bigint,first:bigint,last:bigint,base:bigint,each:int,at:int>>"
    intervals = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(intervals)), schema)))
    order = Window.partitionBy("length", "cell").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    # both broadcast tables have a size set by the window: lengths x cells, and the combinations in use
    numbered = cut.withColumn("number", F.row_number().over(order)).join(
        F.broadcast(cells.select("length", "cell", "before")), ["length", "cell"]
    ).withColumn("number", F.col("number") + F.col("before") - 1)
    on = (F.col("p.length") == F.col("i.length")) & F.col("number").between(F.col("first"), F.col("last"))
    place = F.col("number") - F.col("first")
    return numbered.alias("p").join(F.broadcast(intervals.alias("i")), on).select(
        "doc_id", "start", "p.length", "ids_crc32", "doc_tokens",
        (F.col("base") + F.floor(place / F.col("each"))).alias("sequence_id"),
        (F.col("at") + F.pmod(place, F.col("each")) * F.col("p.length")).cast("long").alias("offset"))
