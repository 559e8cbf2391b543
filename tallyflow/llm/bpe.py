"""BPE encoding by speculation: propose, verify in bulk, merge exactly only what fails.

Greedy longest matches propose the tokens of a word. A proposal is the true encoding if each token is
what its own characters encode to and no merge would cross the border of two adjacent tokens. The
second test depends on the two tokens alone, so all distinct new pairs of a batch are tested together
with numpy and remembered. Words that fail are merged exactly.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tallyflow.llm.common import chunks, needed, ready, slices

DEFAULT_VOCABULARY = "word_bpe_49k.json"

#: Entries of each of a memo's two halves. What a full memo forgets is encoded again and comes out the same.
MEMO_WORDS = 200_000

NEVER = 1 << 40

#: How letters, digits and other signs part within a word, as the vocabulary's file has it.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte in byte-level vocabularies.

    Bytes that print as one character stand for themselves; the others take signs from U+0100 on.
    """
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    signs = {b: chr(b) for b in plain}
    for b in range(256):
        signs.setdefault(b, chr(256 + len(signs) - len(plain)))
    return [signs[b] for b in range(256)]


SIGNS = str.maketrans({b: s for b, s in enumerate(byte_signs())})


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def unpacked(raw: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


class Memo:
    """A bounded store: when the newer half is full it becomes the older one, and what is used again moves on."""

    def __init__(self, size: int = MEMO_WORDS):
        self.size, self.new, self.old = size, {}, {}

    def missing(self, keys: list[str]) -> list[str]:
        """Keys that are not held; the others are safe until the next ``put``."""
        new, old = self.new, self.old
        return [k for k in keys if k not in new and k not in old]

    def put(self, found: dict) -> None:
        self.new.update(found)

    def take(self, keys: list[str]) -> list:
        """Values of keys that are held."""
        new, old, out = self.new, self.old, []
        for k in keys:
            value = new.get(k)
            if value is None:
                value = new[k] = old[k]
            out.append(value)
        if len(new) > self.size:
            self.old, self.new = new, {}
        return out


class WordBpe:
    """A word-level BPE vocabulary with an end-of-word suffix, read from a ``tokenizers`` file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or spec["post_processor"] or spec["decoder"]:
            raise ValueError(f"{path} is not a word-level BPE vocabulary")
        self.library = Tokenizer.from_file(path)
        self.suffix = model["end_of_word_suffix"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (max([*self.vocabulary.values(), *self.special.values()]) + 1)
        for name, number in [*self.vocabulary.items(), *self.special.items()]:
            self.names[number] = name
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = self.vocabulary
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        size = len(self.names)
        self.rank_of = {a * size + b: rank for (a, b), (rank, _) in self.merges.items()}
        self.result = [ids[a + b] for a, b in pairs]
        self.longest = max(map(len, ids))
        self._spines(pairs)
        self.known_pairs: dict[int, bool] = {}
        self.chunk_memo, self.word_memo = Memo(), Memo()

    def _spines(self, pairs: list[tuple[str, str]]) -> None:
        """Of each token the nodes on its left and right border, each with the rank of the merge that ends it."""
        ids, size = self.vocabulary, len(self.names)
        made = {}
        for rank, (a, b) in enumerate(pairs):
            made.setdefault(ids[a + b], (rank, ids[a], ids[b]))
        def border(side: int) -> tuple[np.ndarray, np.ndarray]:
            rows = []
            for token in range(size):
                node, ends, row = token, NEVER, []
                while True:
                    row.append((node, ends))
                    if node not in made:
                        break
                    ends, node = made[node][0], made[node][side]
                rows.append(row)
            depth = max(map(len, rows))
            nodes, limits = np.full((size, depth), -1, np.int64), np.zeros((size, depth), np.int64)
            for token, row in enumerate(rows):
                nodes[token, : len(row)] = [n for n, _ in row]
                limits[token, : len(row)] = [e for _, e in row]
            return nodes, limits

        self.right_nodes, self.right_ends = border(2)
        self.left_nodes, self.left_ends = border(1)
        keys = np.array([a * size + b for a, b in self.merges], np.int64)
        ranks = np.array([r for r, _ in self.merges.values()], np.int64)
        order = np.argsort(keys)
        self.merge_keys, self.merge_ranks = keys[order], ranks[order]
        # a token can be proposed if its own signs merge to it
        self.proposable = {
            name: number for name, number in ids.items()
            if (number not in made and len(name.removesuffix(self.suffix)) <= 1) or (
                number in made and self._merge(self._signs(name)) == [number])
        }

        inner = {name: number for name, number in self.proposable.items() if not self._final(name)}
        self.ends = {n.removesuffix(self.suffix): i for n, i in self.proposable.items() if self._final(n)}
        self.proposable = inner
        # the longest token that starts with two signs
        self.reach: dict[str, int] = {}
        for name in inner:
            self.reach[name[:2]] = max(len(name), self.reach.get(name[:2], 1))

    def _final(self, name: str) -> bool:
        return name.endswith(self.suffix) and len(name) > len(self.suffix)

    def _signs(self, name: str) -> list[int]:
        """Ids of the single signs of a word or token, the last with the suffix if the name has it."""
        ids = self.vocabulary
        if name.endswith(self.suffix) and len(name) > len(self.suffix):
            body = name[: -len(self.suffix)]
            return [*(ids[c] for c in body[:-1]), ids[body[-1] + self.suffix]]
        return [ids[c] for c in name]

    def _merge(self, symbols: list[int]) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost of equal ones."""
        if len(symbols) > 40:
            return self._merge_long(symbols)
        rank_of, result, size = self.rank_of, self.result, len(self.names)
        ranks = [rank_of.get(a * size + b, NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
        while ranks and (lowest := min(ranks)) < NEVER:
            i = ranks.index(lowest)
            symbols[i : i + 2] = [result[lowest]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of.get(symbols[i - 1] * size + symbols[i], NEVER)
            if i < len(ranks):
                ranks[i] = rank_of.get(symbols[i] * size + symbols[i + 1], NEVER)
        return symbols

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The same with a queue of pairs, for words of any length."""
        merges, n = self.merges, len(symbols)
        after = list(range(1, n)) + [-1]
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if found := merges.get((symbols[i], symbols[i + 1])):
                heap.append((found[0], i, symbols[i], symbols[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue
            symbols[i], symbols[j] = merges[left, right][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (found := merges.get((symbols[a], symbols[b]))):
                    heapq.heappush(heap, (found[0], a, symbols[a], symbols[b]))
        return [s for s in symbols if s >= 0]

    def _propose(self, word: str) -> list[int]:
        """Greedy longest matches; every sign is a token with and without the suffix, so there is always one."""
        known, reach, ends, n = self.proposable, self.reach, self.ends, len(word)
        found, at = [], 0
        while at < n:
            if (token := ends.get(word[at:]) if n - at <= self.longest else None) is not None:
                found.append(token)
                break
            end = min(n - 1, at + reach.get(word[at : at + 2], 1))
            while (token := known.get(word[at:end])) is None:
                end -= 1
            found.append(token)
            at = end
        return found

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the border of each pair of tokens.

        A merge of two border nodes happens if its rank comes before the rank at which the left node
        is taken by its own token, and not after the one at which the right node is.
        """
        good, size = np.ones(len(left), bool), len(self.names)
        for i in range(self.right_nodes.shape[1]):
            a, a_ends = self.right_nodes[left, i], self.right_ends[left, i]
            if not (a >= 0).any():
                break
            for j in range(self.left_nodes.shape[1]):
                b, b_ends = self.left_nodes[right, j], self.left_ends[right, j]
                open_ = good & (a >= 0) & (b >= 0)
                if not open_.any():
                    break
                where = np.flatnonzero(open_)
                keys = a[where] * size + b[where]
                at = np.minimum(np.searchsorted(self.merge_keys, keys), len(self.merge_keys) - 1)
                rank = np.where(self.merge_keys[at] == keys, self.merge_ranks[at], NEVER + 1)
                good[where[(rank < a_ends[where]) & (rank <= b_ends[where])]] = False
        return good

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words given in byte signs: proposals, all new pairs verified at once, the rest merged."""
        proposed = [self._propose(w) for w in words]
        lengths = np.array([len(p) for p in proposed], np.int64)
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(lengths.sum()))
        if len(flat) > 1:
            inner = np.ones(len(flat), bool)
            inner[np.cumsum(lengths) - 1] = False
            first = np.flatnonzero(inner)
            keys = flat[first] * len(self.names) + flat[first + 1]
            distinct, back = np.unique(keys, return_inverse=True)
            known = self.known_pairs
            fresh = np.array([k for k in distinct.tolist() if k not in known], np.int64)
            if len(fresh):
                if len(known) > 2_000_000:
                    known.clear()
                    fresh = distinct
                known.update(zip(fresh.tolist(), self._compatible(*np.divmod(fresh, len(self.names))).tolist(), strict=True))
            bad = ~np.fromiter((known[k] for k in distinct.tolist()), bool, len(distinct))[back]
            owner = np.repeat(np.arange(len(words)), lengths)[first[bad]]
            for i in set(owner.tolist()):
                proposed[i] = self._merge(self._signs(words[i] + self.suffix))
        return proposed

    def parts(self, chunk: str) -> list[str | int]:
        """A piece of text without ASCII white space as words in byte signs, and ids of special tokens."""
        if "<" in chunk and self.cut.search(chunk):
            out: list[str | int] = []
            for piece in self.cut.split(chunk):
                out.extend([self.special[piece]] if piece in self.special else self.parts(piece) if piece else [])
            return out
        if chunk.isascii() and chunk.isprintable():
            return PARTS.findall(chunk.lower())
        if max(chunk) < "\u0250":  # no composition, no special case: the same in every Unicode version
            return [w.encode().decode("latin-1").translate(SIGNS) for w in PARTS.findall(chunk.lower())]
        library = self.library
        return [w for w, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(chunk))]

    def encode_chunks(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces of text without ASCII white space, as unsigned little-endian 32-bit numbers.

        Pieces encode apart from each other.
        """
        missing = self.chunk_memo.missing(pieces)
        if missing:
            split = [self.parts(c) for c in missing]
            words = list(dict.fromkeys([w for parts in split for w in parts if isinstance(w, str)]))
            new = self.word_memo.missing(words)
            if new:
                self.word_memo.put(dict(zip(new, map(packed, self.encode_words(new)), strict=True)))
            ids = dict(zip(words, self.word_memo.take(words), strict=True))
            self.chunk_memo.put({
                c: ids[parts[0]] if len(parts) == 1 and isinstance(parts[0], str)
                else b"".join([packed([w]) if isinstance(w, int) else ids[w] for w in parts])
                for c, parts in zip(missing, split, strict=True)})
        return self.chunk_memo.take(pieces)

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Texts as (offsets, codes, ids of each distinct piece)."""
        offsets, codes, words = chunks(texts)
        return offsets, codes, self.encode_chunks(words.to_pylist())

    def encode(self, text: str | None) -> list[int]:
        """Ids of one text."""
        _, codes, ids = self.encode_batch(pa.array([text], pa.string()))
        return unpacked(b"".join([ids[c] for c in codes.tolist()]))

    def decode(self, ids: list[int]) -> str:
        """The names of the tokens with a space between, as the library decodes a file without a decoder."""
        return " ".join([self.names[i] for i in ids])


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> WordBpe:
    """The vocabulary at ``path``, read once in each worker."""
    return WordBpe(path)


def digests(bpe: WordBpe, texts: pa.Array) -> list[tuple[int, str, str]]:
    """Of each text: number of ids, digest of the ids as text, digest of the decoded text."""
    offsets, codes, ids = bpe.encode_batch(texts)
    lists = [unpacked(i) for i in ids]
    numbers = ["".join([f"{t} " for t in i]).encode() for i in lists]
    names = ["".join([f"{bpe.names[t]} " for t in i]).encode() for i in lists]
    lengths = np.array([len(i) for i in lists], np.int64)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = codes[a:b].tolist()
        out.append((
            int(lengths[codes[a:b]].sum()),
            hashlib.sha256(b"".join([numbers[c] for c in own])[:-1]).hexdigest(),
            hashlib.sha256(b"".join([names[c] for c in own])[:-1]).hexdigest(),
        ))
    return out


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Texts are encoded whole and decoded again. A null text counts as empty and has no ids; digests
    are then those of the empty text. Rows with one doc_id or none stay rows of their own; no rows
    give no rows; further columns are ignored.
    """
    ready(docs.sparkSession)
    path = path or public_tokenizers.path(DEFAULT_VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        kinds = (pa.int64(), pa.string(), pa.string())
        for whole in batches:
            for batch in slices(whole, limit=16 << 20):
                columns = zip(*digests(bpe, batch.column(1)), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return needed(docs, ["doc_id", "text"]).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id and its ids as an array; null texts have an empty one."""
    ready(docs.sparkSession)
    path = path or public_tokenizers.path(DEFAULT_VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for whole in batches:
            for batch in slices(whole, limit=16 << 20):
                offsets, codes, ids = bpe.encode_batch(batch.column(1))
                flat = np.frombuffer(b"".join([ids[c] for c in codes.tolist()]), "<i4")
                lengths = np.array([len(i) // 4 for i in ids], np.int64)
                ends = np.concatenate([[0], np.cumsum(lengths[codes])])[offsets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return needed(docs, ["doc_id", "text"]).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_ids(ids: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of ``encode_ids``: doc_id and the decoded text; null ids give a null text."""
    ready(ids.sparkSession)
    path = path or public_tokenizers.path(DEFAULT_VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            texts = [None if i is None else bpe.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = ids.schema["doc_id"].dataType.simpleString()
    return needed(ids, ["doc_id", "ids"]).mapInArrow(run, f"doc_id {kind}, text string")
