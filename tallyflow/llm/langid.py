"""Language identification by language-bitmask n-gram filters.

Character trigrams of all learning texts are counted for each language; a language has a trigram if it
was seen a few times and its share there is a set part of the largest share any language gives it. The
sets go into one bit-sliced Bloom filter: a slot holds a bit for each language, and the conjunction of
a trigram's slots is the mask of all languages that have it. A text's score for a language is the
count of its trigrams in the language, corrected for those the filter takes in falsely; the largest
wins.

The filter is built in the executors and grows with the trigrams up to ``MOST_BYTES``; no trigram is left
out beyond that, the filter only takes in more foreign ones, for which the counts are corrected.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.llm.common import chunks, fold, needed, ready, slices, stored

#: A trigram is typical of a language if it was seen this often in it, whatever the size of the corpus.
LEAST_SEEN = 2
#: ... and from this part of the largest share that any language gives it.
LEAST_OF_LARGEST = 0.2
#: Slots of the filter for each trigram, and slots read for one.
SLOTS_EACH, PROBES = 16, 4
#: Size of the filter at most; it is sent to every executor.
MOST_BYTES = 64 << 20
#: Names in ``lang`` that are learned at most: those with the most learning texts. More are noise in the column.
MOST_LANGUAGES = 1024
#: Bytes of the filter that travel as one row.
SEGMENT = 1 << 20
UNDECIDED = "und"
MASKS = {8: np.uint8, 16: np.uint16, 32: np.uint32, 64: np.uint64}


@functools.cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every bit of a number over all."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return values ^ (values >> np.uint64(33))


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigrams, the word each is from, whether each word has a letter) of words in lower case.

    A trigram is three code points, of which the middle one is a letter and others that are none count
    as blank, so that runs of letters have their borders in it.
    """
    text = "\n" + "\n".join(words) + "\n"
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.cumsum(points == 10) - 1
    letter = letters()[points]
    shown = np.where(letter, points, 32).astype(np.uint64)
    middle = np.flatnonzero(letter)
    grams = (shown[middle - 1] << np.uint64(42)) | (shown[middle] << np.uint64(21)) | shown[middle + 1]
    has = np.zeros(len(words), bool)
    has[word[middle]] = True
    return grams, word[middle], has


def count_trigrams(languages: list[str]):
    """Counts (language, trigram) of a partition's rows (lang, text)."""
    number = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                offsets, codes, words = chunks(batch.column(1))
                lang = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
                size = len(words)
                per_token = np.repeat(lang, np.diff(offsets))
                grams, word, _ = trigrams(words.to_pylist())
                distinct, back = np.unique(grams, return_inverse=True)
                for i in np.unique(lang).tolist():
                    times = np.bincount(codes[per_token == i], minlength=size)
                    sums = np.bincount(back, weights=times[word], minlength=len(distinct)).astype(np.int64)
                    some = sums > 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(int(some.sum()), i, np.int32)), pa.array(distinct[some].view(np.int64)), pa.array(sums[some])],
                        ["language", "gram", "n"])

    return run


def slot_kind(languages: int) -> tuple[type, int]:
    """Number type and how many of it a slot needs for a bit of each language."""
    return next(((t, 1) for bits, t in MASKS.items() if bits >= languages), (np.uint64, -(-languages // 64)))


def slots_for(grams: int, languages: int) -> int:
    """Slots of a filter of so many trigrams."""
    kind, words = slot_kind(languages)
    return max(64, min(SLOTS_EACH * grams, MOST_BYTES // (np.dtype(kind).itemsize * words)))


@dataclass
class LanguageFilter:
    """The bit-sliced Bloom filter and the languages of its bits; ``slots`` has a row of numbers for each slot.

    ``coverage`` is the share of each language's own learning trigrams that are typical of it without
    counting themselves, which is what other texts of the language can be expected to reach.
    """

    languages: list[str]
    slots: np.ndarray
    coverage: np.ndarray

    @classmethod
    def of(cls, languages: list[str], grams: np.ndarray, own: np.ndarray, size: int | None = None) -> LanguageFilter:
        """``own[i]`` is the number of a language that has ``grams[i]``."""
        kind, words = slot_kind(len(languages))
        slots = np.zeros((size or slots_for(len(grams), len(languages)), words), kind)
        bits = np.ones(len(grams), kind) << (own % (64 if words > 1 else 8 * slots.itemsize)).astype(kind)
        for places in cls._places(grams, len(slots)):
            np.bitwise_or.at(slots, (places, own // 64), bits)
        return cls(languages, slots, np.ones(len(languages)))

    @staticmethod
    def _places(grams: np.ndarray, size: int) -> Iterator[np.ndarray]:
        first, step = _mix(grams.astype(np.uint64)), _mix(grams.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
        for probe in range(PROBES):
            yield ((first + np.uint64(probe) * step) % np.uint64(size)).astype(np.int64)

    def lookup(self, grams: np.ndarray) -> np.ndarray:
        """The masks of all languages that contain each trigram (falsely sometimes, never too few)."""
        found = np.full((len(grams), self.slots.shape[1]), np.iinfo(self.slots.dtype).max, self.slots.dtype)
        for places in self._places(grams, len(self.slots)):
            found &= self.slots[places]
        return found

    def has(self, masks: np.ndarray, language: int) -> np.ndarray:
        """The bit of a language in masks or slots."""
        return (masks[:, language // 64] >> masks.dtype.type(language % 64)) & masks.dtype.type(1)

    @functools.cached_property
    def false_rates(self) -> np.ndarray:
        """Of each language the share of foreign trigrams that the filter takes in."""
        filled = [np.count_nonzero(self.has(self.slots, i)) / len(self.slots) for i in range(len(self.languages))]
        return np.array(filled) ** PROBES

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and relative score of each text.

        The score is the share of its trigrams that the language has; the relative one compares it with
        the share in the language's own learning texts.
        """
        offsets, codes, words = chunks(texts)
        n, size = len(offsets) - 1, len(words)
        grams, word, has = trigrams(words.to_pylist())
        masks = self.lookup(grams)
        token_text = np.repeat(np.arange(n), np.diff(offsets))

        def per_text(per_word: np.ndarray) -> np.ndarray:
            return np.bincount(token_text, weights=per_word[codes], minlength=n)

        total = per_text(np.bincount(word, minlength=size).astype(np.float64))
        true = np.zeros((n, len(self.languages)))
        for i, rate in enumerate(self.false_rates):
            hits = per_text(np.bincount(word, weights=self.has(masks, i), minlength=size))
            true[:, i] = (hits - total * rate) / max(1e-9, 1 - rate)
        best = true.argmax(1) if len(self.languages) else np.zeros(n, np.int64)
        lettered = total > 0
        share = np.zeros(n)
        if len(self.languages):
            share[lettered] = np.clip(true[np.arange(n), best][lettered] / total[lettered], 0, 1)
        names = [self.languages[b] if ok and self.languages else UNDECIDED for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
        coverage = self.coverage[best] if len(self.languages) else np.ones(n)
        return names, share, share / np.maximum(coverage, 1e-9)


SEGMENTS = pa.schema([("segment", pa.int32()), ("slots", pa.binary())])


def _segments(languages: list[str], size: int):
    """A partition's trigrams (gram, language) as a filter, in rows (segment, slots)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = None
        for batch in batches:
            grams, own = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().astype(np.int64)
            part = LanguageFilter.of(languages, grams, own, size).slots
            slots = part if slots is None else np.bitwise_or(slots, part, out=slots)
        raw = b"" if slots is None else slots.tobytes()
        for at in range(0, len(raw), SEGMENT):
            if any(piece := raw[at : at + SEGMENT]):
                yield pa.RecordBatch.from_pylist([{"segment": at // SEGMENT, "slots": piece}], SEGMENTS)

    return run


def _united(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of several partitions as one."""
    out = None
    for batch in parts:
        for piece in batch.column("slots"):
            own = np.frombuffer(piece.as_py(), np.uint8)
            out = own.copy() if out is None else np.bitwise_or(out, own, out=out)
    yield pa.RecordBatch.from_pylist([{"segment": key[0].as_py(), "slots": out.tobytes()}], SEGMENTS)


def learn(
    docs: DataFrame, least_seen: int = LEAST_SEEN, least_of_largest: float = LEAST_OF_LARGEST, most_languages: int = MOST_LANGUAGES,
) -> LanguageFilter:
    """The filter of all rows (lang, text) with a lang; the smallest names come first and win ties.

    Names beyond the ``most_languages`` with the most rows are not learned (of equally frequent ones
    the larger names). What comes to the driver is bounded: the names, and ``MOST_BYTES`` of filter.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    named = rows.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(most_languages)
    languages = sorted(r["lang"] for r in named.collect())
    if not languages:
        return LanguageFilter.of([], np.zeros(0, np.uint64), np.zeros(0, np.int64))
    counts = rows.filter(F.col("lang").isin(languages)).mapInArrow(count_trigrams(languages), "language int, gram long, n long")
    counts = stored(counts.groupBy("language", "gram").agg(F.sum("n").alias("n")), "trigrams")
    totals = counts.groupBy("language").agg(F.sum("n").alias("total"))
    # a row for each language
    shares = counts.join(F.broadcast(totals), "language").withColumn("share", F.col("n") / F.col("total"))
    # a trigram has at most one row for each language
    largest = F.max("share").over(Window.partitionBy("gram"))
    typical = shares.withColumn("largest", largest).filter(
        (F.col("n") >= least_seen) & (F.col("share") >= least_of_largest * F.col("largest")))
    # an occurrence that would be known without itself, as those of other texts must be
    again = F.when(F.col("n") > least_seen, F.col("share")).otherwise(0.0)
    typical = stored(typical.select("gram", "language", again.alias("again")), "typical")
    found = typical.groupBy("language").agg(F.count("*").alias("grams"), F.sum("again").alias("share")).collect()
    coverage = np.zeros(len(languages))
    for r in found:
        coverage[r["language"]] = r["share"]
    size = slots_for(sum(r["grams"] for r in found), len(languages))
    segments = typical.select("gram", "language").mapInArrow(_segments(languages, size), "segment int, slots binary")
    united = segments.groupBy("segment").applyInArrow(_united, "segment int, slots binary").collect()
    empty = LanguageFilter.of(languages, np.zeros(0, np.uint64), np.zeros(0, np.int64), size)
    raw = bytearray(empty.slots.nbytes)
    for r in united:
        raw[r["segment"] * SEGMENT : r["segment"] * SEGMENT + len(r["slots"])] = r["slots"]
    slots = np.frombuffer(bytes(raw), empty.slots.dtype).reshape(empty.slots.shape)
    return LanguageFilter(languages, slots, coverage)


def identify(docs: DataFrame, folds: int = 3, held_fold: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learns from text and lang of the documents whose fold is not ``held_fold`` and whose lang is not
    null; predicts from the text alone. A text that is null or has no letter is ``und`` with score 0;
    one without a known trigram gets the language whose name comes first, with score 0; if there is
    nothing to learn from, every text is ``und``. Of more than ``MOST_LANGUAGES`` names the most frequent
    are learned. Rows that repeat are rows of their own; no rows give no rows; further columns are ignored.
    """
    spark = ready(docs.sparkSession)
    held = fold("doc_id", folds) == held_fold
    model = learn(needed(docs, ["doc_id", "text", "lang"]).filter(~held))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                names, scores, _ = shared.value.predict(batch.column(1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = needed(docs, ["doc_id", "text"]).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float = 0.2) -> DataFrame:
    """The documents with a language, with the columns they came with.

    Rejected are texts without a letter and those of whose trigrams the share that belongs to the best
    language is less than ``least_score`` of that share in the language's own learning texts.
    """
    spark = ready(docs.sparkSession)
    held = fold("doc_id", 3) == 1
    shared = spark.sparkContext.broadcast(learn(needed(docs, ["doc_id", "text", "lang"]).filter(~held)))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at):
                names, _, scores = shared.value.predict(batch.column(at))
                keep = (np.array(names, object) != UNDECIDED) & (scores >= least_score)
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
