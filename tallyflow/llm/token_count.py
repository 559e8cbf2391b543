"""Token counts by byte-pair merging with a heap and a linked list; no ids come out.

A piece of text starts as its bytes. The adjacent pair of lowest rank (the leftmost of equal ones) is
popped and merged until no pair has a rank. The count is the number of bytes less the number of merges.
Equal pieces have equal counts and are merged once for as long as they are remembered.
"""

from __future__ import annotations

import functools
import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyflow.llm.bpe import byte_signs
from tallyflow.llm.common import needed, ready, slices

DEFAULT_VOCABULARY = "byte_bpe_50k.json"

#: Pieces remembered by a worker; what is forgotten is merged again and comes out the same.
REMEMBERED = 400_000

#: Characters of a text that are split into pieces at a time.
SEGMENT = 1 << 20

#: Bytes of a piece from which positions wait in flat arrays by rank instead of as single heap entries.
LONG_PIECE = 1 << 14

#: How byte-level vocabularies of this kind split a text into pieces.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: Signs whose class may differ between versions of Unicode; the library splits texts that hold one.
UNSETTLED = regex.compile("[^\\x00-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]")

#: A place where a piece ends whatever comes before and after: between a letter and a sign that is none.
END = regex.compile("(?<=[A-Za-z\u4e00-\u9fa5])(?=[ \\n!-&(-@\u3001\u3002\uff0c])")


class PieceCounts(dict):
    """Number of tokens of each piece that was asked for."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        odd = [model.get(name) for name in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")]
        plain = (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) == ("ByteLevel", False, True)
        special = [t for t in spec["added_tokens"] if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]]
        if model["type"] != "BPE" or any(odd) or not plain or special or spec["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        self.library = Tokenizer.from_file(path)
        names = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        ids = model["vocab"]
        self.size = max(ids.values()) + 1
        self.of_byte = [ids[sign] for sign in byte_signs()]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {ids[a] * self.size + ids[b]: r for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.made = [ids[a + b] for a, b in pairs]

    def __missing__(self, piece: str) -> int:
        raw = piece.encode()
        found = self.merged_long(raw) if len(raw) >= LONG_PIECE else self.merged(raw)
        if len(raw) < LONG_PIECE:
            self[piece] = found
        return found

    def merged(self, raw: bytes) -> int:
        """Tokens of one piece: a heap of (rank, place) over a list linked both ways."""
        symbols = [self.of_byte[b] for b in raw]
        n = count = len(symbols)
        rank, made, size = self.rank, self.made, self.size
        heap = [(r << 32) | i for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))
                if (r := rank.get(a * size + b)) is not None]
        if not heap:
            return count
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heapq.heappop(heap)
            r, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            # places that were merged away have no symbol; others may have another pair by now
            if symbols[i] < 0 or j >= n or rank.get(symbols[i] * size + symbols[j]) != r:
                continue
            symbols[i], symbols[j] = made[r], -1
            after[i] = k = after[j]
            count -= 1
            if k < n:
                before[k] = i
                if (r := rank.get(symbols[i] * size + symbols[k])) is not None:
                    heapq.heappush(heap, (r << 32) | i)
            if (h := before[i]) >= 0 and (r := rank.get(symbols[h] * size + symbols[i])) is not None:
                heapq.heappush(heap, (r << 32) | h)
        return count

    def merged_long(self, raw: bytes) -> int:
        """The same for a piece of any length: the heap holds ranks, each with the places of its pairs in a flat array.

        A merge makes pairs of later ranks only, so a rank's places are complete when it is popped.
        """
        symbols = np.array(self.of_byte, np.int32)[np.frombuffer(raw, np.uint8)]
        n = count = len(symbols)
        rank, made, size = self.rank, self.made, self.size
        waiting: dict[int, array] = {}
        pairs = symbols[:-1].astype(np.int64) * size + symbols[1:]
        order = np.argsort(pairs, kind="stable")
        cuts = np.flatnonzero(np.diff(pairs[order])) + 1
        for places in np.split(order, cuts):
            if len(places) and (r := rank.get(int(pairs[places[0]]))) is not None:
                waiting[r] = array("i", places.astype(np.int32).tobytes())
        del pairs, order
        symbols = array("i", symbols.tobytes())
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        heap = list(waiting)
        heapq.heapify(heap)

        def wait(i: int, j: int) -> None:
            r = rank.get(symbols[i] * size + symbols[j])
            if r is not None:
                if r not in waiting:
                    waiting[r] = array("i")
                    heapq.heappush(heap, r)
                waiting[r].append(i)

        while heap:
            r = heapq.heappop(heap)
            for i in np.sort(np.frombuffer(waiting.pop(r), np.int32)).tolist():
                j = after[i]
                if symbols[i] < 0 or j >= n or rank.get(symbols[i] * size + symbols[j]) != r:
                    continue
                symbols[i], symbols[j] = made[r], -1
                after[i] = k = after[j]
                count -= 1
                if k < n:
                    before[k] = i
                    wait(i, k)
                if before[i] >= 0:
                    wait(before[i], i)
        return count

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text without special tokens."""
        if UNSETTLED.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return PIECES.findall(text)

    def tokens(self, text: str) -> int:
        """Number of tokens of a whole text; a special token's name is one token."""
        found, parts = 0, [text]
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            found = len(parts) - 1
        for part in parts:
            at = 0
            while at < len(part):
                cut = END.search(part, at + SEGMENT) if len(part) - at > 2 * SEGMENT else None
                end = cut.start() if cut else len(part)
                found += sum(map(self.__getitem__, self.pieces(part[at:end])))
                at = end
                if len(self) > REMEMBERED:
                    self.clear()
        return found


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> PieceCounts:
    """The counts by the vocabulary at ``path``, kept by each worker."""
    return PieceCounts(path)


def token_counts(docs: DataFrame, limit: int = 512, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    Whole texts are counted, without truncation; ``over_limit`` says whether there are more than ``limit``
    tokens. A null text counts as empty and has none. Rows with one doc_id or none stay rows of their
    own; no rows give no rows; further columns are ignored. A worker needs about 20 bytes for each byte
    of the longest piece (a run of letters, of digits, of other signs or of white space).
    """
    ready(docs.sparkSession)
    path = path or public_tokenizers.path(DEFAULT_VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = vocabulary(path)
        for whole in batches:
            for batch in slices(whole, limit=16 << 20):
                texts = pc.fill_null(batch.column(1), "")
                tokens = [counts.tokens(t.as_py()) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(tokens, pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = needed(docs, ["doc_id", "text"]).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
