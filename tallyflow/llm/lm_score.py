"""Language-model scores of texts: a causal self-attention model over subword ids, trained in numpy.

Texts become blocks: a block holds each of its distinct words once, the words' subword ids, and its
texts as word numbers. All statistics come from blocks, so a frequent word is counted once for each
block, not once for each place. Words meet in buckets by a hash; a bucket adds up the counts its words
have in all blocks and hands them back to each block.

- Word counts of all learning texts give the unigram base; they meet the blocks again by word.
- Subword counts over all learning texts give the classes (the commonest ids are classes of their own,
  the others fall in bands of equal mass); counts of pairs of ids give a prior for the next class and
  the ids' chances in their class after the id before. All pairs stay in a table; a block meets those
  inside its words there.
- The attention model adds to that prior what the wider context tells about the next class. Every task
  trains on the windows of its blocks' learning texts from the same start, and the parameters are averaged
  by the number of windows; that AVERAGES times, with other windows each time until all were used once.
- Scoring slides windows over every text that overlap by OVERLAP ids; each id is scored once, in the
  first window that holds it.
- Ids that begin a word have classes of their own. At a word's start the attention model predicts the
  class of its first id; within the class a word seen before has its discounted share, and the discount
  goes to words spelled out, whose further ids and end the attention model predicts in turn.

The model's vocabulary is a tokenizer's; each word is encoded with a blank before it, byte by byte, so
different texts have different ids. An end id follows every text.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import chunks, fold, needed, ready, slices, stored

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of text in a block, about; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Bytes of text for each bucket of words, as a bucket is held by one task; and the least number of buckets.
BUCKET_BYTES, BUCKETS = 64 << 20, 128
#: Ids that are classes of their own as context, and bands of the others.
OWN_CONTEXT, BANDS = 496, 16
#: The same as prediction: ids that begin a word (and the end id), and those that go on with it.
OWN_START, START_BANDS, OWN_INNER, INNER_BANDS = 64, 16, 24, 8
STARTS = OWN_START + START_BANDS
NEXT = STARTS + OWN_INNER + INNER_BANDS
DEPTH = 16
WINDOW, OVERLAP = 32, 8
#: Windows scored together (their arrays fit a core's cache), and windows looked up together.
STEP, LOOKUP = 64, 2048
#: Training: windows of a step, averages. Each average is over the windows with one remainder by their number.
TRAIN_STEP, AVERAGES = 32, 2
#: Weight, in counts, of the classes' shares in the prior.
SMOOTHING = 20.0
#: Taken off the count of a word seen before, for the words not seen.
DISCOUNT = 0.75

#: A block is a row without bucket that holds its texts, and a row for each bucket of its words.
BLOCK_SCHEMA = (
    "block long, bucket int, doc_ids array<{kind}>, learning binary, sizes binary, codes binary, pieces binary, "
    "lengths binary, words array<string>, places binary, learned binary, firsts binary"
)
TEXTS = ["block", "learning", "sizes", "codes", "pieces", "lengths"]


def pack_numbers(values: np.ndarray, kind: str) -> bytes:
    """Whole numbers in little space: their bytes by rank, compressed."""
    raw = np.ascontiguousarray(values.astype(kind))
    planes = raw.view(np.uint8).reshape(-1, raw.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_numbers(raw: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


@functools.lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """The tokenizer at ``path``, read once in each worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def word_starts(path: str) -> np.ndarray:
    """Whether each id, and the end id after them, begins a word."""
    tokens = encoding(path)
    begins = [tokens.decode_single_token_bytes(i).startswith(b" ") for i in range(tokens.max_token_value + 1)]
    return np.array([*begins, True])


def encode_words(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths) of words, each with a blank before it.

    Words are encoded in one go and parted where an id begins with a blank, which no word has inside.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    encode = encoding(path).encode_ordinary
    ids = np.array(encode(" " + " ".join(words)), np.int64)
    begins = np.flatnonzero(word_starts(path)[ids])
    if len(begins) != len(words):  # a word that joins its neighbour; the words are encoded one by one
        each = [encode(" " + w) for w in words]
        return np.array([t for i in each for t in i], np.int64), np.array([len(i) for i in each], np.int64)
    return ids, np.diff(np.append(begins, len(ids)))


def spread(pieces: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's ids, the same in every block."""
    place = np.arange(len(pieces)) - np.repeat(begins, lengths)
    mixed = (pieces.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ** (place % 50 + 1).astype(np.uint64)
    sums = np.add.reduceat(mixed, begins) if len(begins) else np.zeros(0, np.uint64)
    return sums ^ (sums >> np.uint64(29))


def make_blocks(path: str, buckets: int = BUCKETS):
    """Rows (doc_id, text, learning) as blocks."""
    names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]

    def block_rows(batch: pa.RecordBatch, block: int) -> Iterator[pa.RecordBatch]:
        offsets, codes, words = chunks(pc.ascii_lower(batch.column(1)))
        # the commonest words have the smallest numbers; what stands nowhere (the empty word) goes
        times = np.bincount(codes, minlength=len(words))
        order = np.argsort(-times, kind="stable")[: int((times > 0).sum())]
        rank = np.zeros(len(words), np.int32)
        rank[order] = np.arange(len(order))
        codes, words = rank[codes], words.take(pa.array(order))
        pieces, lengths = encode_words(words.to_pylist(), path)
        begins = np.cumsum(lengths) - lengths
        learning = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        learned = np.bincount(codes[np.repeat(learning, np.diff(offsets))], minlength=len(words))
        bucket = (spread(pieces, begins, lengths) % np.uint64(buckets)).astype(np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
        own = [by_bucket[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        firsts = pieces[begins]

        def rows(n: int, kinds: dict[str, pa.DataType], **columns) -> pa.RecordBatch:
            schema = pa.schema([(c, kinds.get(c, pa.binary())) for c in names])
            made = [columns[f.name] if isinstance(columns.get(f.name), pa.Array)
                    else pa.array(columns.get(f.name, [None] * n), f.type) for f in schema]
            return pa.RecordBatch.from_arrays(made, schema=schema)

        kinds = {"block": pa.int64(), "bucket": pa.int32(), "doc_ids": pa.list_(batch.schema.field(0).type),
                 "words": pa.list_(pa.string())}
        yield rows(
            1, kinds, block=[block], doc_ids=[batch.column(0).to_pylist()], learning=[learning.tobytes()],
            sizes=[pack_numbers(np.diff(offsets), "<i4")], codes=[pack_numbers(codes, "<i4")],
            pieces=[pack_numbers(pieces, "<u2")], lengths=[pack_numbers(lengths, "<i4")])
        yield rows(
            buckets, kinds, block=[block] * buckets, bucket=list(range(buckets)),
            words=pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words.take(pa.array(by_bucket))),
            places=[pack_numbers(o, "<i4") for o in own], learned=[pack_numbers(learned[o], "<i4") for o in own],
            firsts=[pack_numbers(firsts[o], "<u2") for o in own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for whole in batches:
            for batch in slices(whole, 1, BLOCK_BYTES):
                yield from block_rows(batch, TaskContext.get().partitionId() << 32 | number)
                number += 1

    return run


@dataclass
class Streams:
    """A block's texts end to end: every text is an end id, its ids, an end id.

    ``starts`` are the texts' first places and one more; ``inside`` tells the places of pieces and
    ``source`` which piece of the block's words stands there.
    """

    ids: np.ndarray
    starts: np.ndarray
    inside: np.ndarray
    source: np.ndarray
    words: np.ndarray
    codes: np.ndarray
    pieces: np.ndarray
    begins: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, row: dict, end_id: int, only_learning: bool = False) -> Streams:
        words, codes = unpack_numbers(row["sizes"], "<i4").astype(np.int64), unpack_numbers(row["codes"], "<i4")
        pieces, lengths = unpack_numbers(row["pieces"], "<u2"), unpack_numbers(row["lengths"], "<i4").astype(np.int64)
        begins = np.cumsum(lengths) - lengths
        if only_learning:
            learning = np.frombuffer(row["learning"], bool)
            codes, words = codes[np.repeat(learning, words)], words[learning]
        each = lengths[codes]
        text_of = np.repeat(np.arange(len(words)), words)
        sizes = np.bincount(text_of, weights=each, minlength=len(words)).astype(np.int64) + 2
        starts = np.concatenate([[0], np.cumsum(sizes)])
        total = np.cumsum(each)
        source = np.arange(total[-1] if len(total) else 0) + np.repeat(begins[codes] - (total - each), each)
        inside = np.ones(starts[-1], bool)
        inside[starts[:-1]] = False
        inside[starts[1:] - 1] = False
        ids = np.full(starts[-1], end_id, np.int32)
        ids[inside] = pieces[source]
        return cls(ids, starts, inside, source, words, codes, pieces.astype(np.int64), begins, lengths)


@dataclass
class Classes:
    """Classes of ids as context and as prediction, and each id's share of its class."""

    context: np.ndarray
    next: np.ndarray
    share: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, begins: np.ndarray) -> Classes:
        """From the counts of all ids, of which the last is the end id, and whether each begins a word.

        Ids never seen have half a count each.
        """
        mass = counts + 0.5
        rank = np.append(mass[:-1], np.inf)

        def grouped(members: np.ndarray, own: int, bands: int) -> np.ndarray:
            order = members[np.argsort(-rank[members], kind="stable")]
            groups = np.arange(len(order))
            rest = mass[order[own:]]
            groups[own:] = own + np.minimum((np.cumsum(rest) - rest) * bands // max(rest.sum(), 1), bands - 1)
            out = np.empty(len(counts), np.int32)
            out[order] = groups
            return out

        every = np.arange(len(counts))
        context = grouped(every, OWN_CONTEXT, BANDS)
        following = np.where(
            begins, grouped(every[begins], OWN_START, START_BANDS), STARTS + grouped(every[~begins], OWN_INNER, INNER_BANDS))
        total = np.bincount(following, weights=mass, minlength=NEXT)
        return cls(context, following, mass / total[following])


def _cells(name: str, cells: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64)), pa.array(counts.astype(np.int64))], [name, "n"])


def count_ids(end_id: int):
    """(id, n) over the learning texts of blocks, by the times of their words; the end id counts once for each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                learning, words = np.frombuffer(row["learning"], bool), unpack_numbers(row["sizes"], "<i4")
                pieces, lengths = unpack_numbers(row["pieces"], "<u2"), unpack_numbers(row["lengths"], "<i4")
                codes = unpack_numbers(row["codes"], "<i4")[np.repeat(learning, words)]
                times = np.repeat(np.bincount(codes, minlength=len(lengths)), lengths)
                counts = np.bincount(pieces, weights=times, minlength=end_id + 1).astype(np.int64)
                counts[end_id] = np.count_nonzero(learning)
                yield _cells("id", np.flatnonzero(counts), counts[counts > 0])

    return run


def count_pairs(end_id: int):
    """(pair, n) of ids that follow each other in the learning texts of blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stream = Streams.of(row, end_id, True)
                last = np.ones(len(stream.ids), bool)
                last[stream.starts[1:] - 1] = False
                at = np.flatnonzero(last)
                pairs = stream.ids[at].astype(np.int64) * (end_id + 1) + stream.ids[at + 1]
                yield _cells("pair", *np.unique(pairs, return_counts=True))

    return run


def word_pairs(end_id: int):
    """(block, pair) of ids that follow each other within the words of blocks, each pair of a block once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pieces, lengths = unpack_numbers(row["pieces"], "<u2").astype(np.int64), unpack_numbers(row["lengths"], "<i4")
                later = np.ones(len(pieces), bool)
                later[np.cumsum(lengths) - lengths] = False
                at = np.flatnonzero(later)
                pairs = np.unique(pieces[at - 1] * (end_id + 1) + pieces[at])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), row["block"])), pa.array(pairs)], ["block", "pair"])

    return run


@dataclass
class Following:
    """Chances of ids in their class after the id before: counts of pairs, smoothed by the ids' shares.

    ``groups`` are sorted numbers before * classes + class after, ``mass`` the counts of all pairs of each
    and ``kinds`` how many pairs these are; ``pairs`` and ``counts`` are the pairs at hand.
    """

    classes: Classes
    groups: np.ndarray
    mass: np.ndarray
    kinds: np.ndarray
    pairs: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, classes: Classes, pairs: np.ndarray, counts: np.ndarray) -> Following:
        """From all pairs; ``pairs`` are sorted numbers before * ids + after."""
        before, after = np.divmod(pairs, len(classes.next))
        groups, back = np.unique(before * NEXT + classes.next[after], return_inverse=True)
        mass = np.bincount(back, weights=counts, minlength=len(groups))
        return cls(classes, groups, mass, np.bincount(back, minlength=len(groups)), pairs, counts)

    def knowing(self, pairs: np.ndarray, counts: np.ndarray) -> Following:
        """The same with other pairs at hand, in any order."""
        order = np.argsort(pairs, kind="stable")
        return replace(self, pairs=pairs[order], counts=counts[order])

    def logs(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Log chance of each id in its class after the one before."""
        def find(keys: np.ndarray, wanted: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
            if not len(keys):
                return [np.zeros(len(wanted)) for _ in values]
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return [np.where(keys[at] == wanted, v[at], 0.0) for v in values]

        # each pair once and in order, so that neighbours are found near each other
        pairs, back = np.unique(before.astype(np.int64) * len(self.classes.next) + after, return_inverse=True)
        before, after = np.divmod(pairs, len(self.classes.next))
        [known] = find(self.pairs, pairs, self.counts)
        mass, kinds = find(self.groups, before * NEXT + self.classes.next[after], self.mass, self.kinds)
        return np.log((known + (kinds + 1) * self.classes.share[after]) / (mass + kinds + 1))[back]


def smoothed(table: np.ndarray, classes: Classes, mass: np.ndarray) -> np.ndarray:
    """Log chances of the next class after each id, drawn to those after the id's context class, and these to all."""
    groups = np.zeros((OWN_CONTEXT + BANDS, table.shape[1]), np.float32)
    np.add.at(groups, classes.context, table)
    groups = (groups + SMOOTHING * (mass / mass.sum())) / (groups.sum(1, keepdims=True) + SMOOTHING)
    total = table.sum(1, keepdims=True)
    chances = (table + SMOOTHING * groups[classes.context]) / (total + SMOOTHING)
    return np.log(np.maximum(chances, 1e-30)).astype(np.float32)


def shapes() -> dict[str, tuple[int, ...]]:
    d, n = DEPTH, NEXT
    return {"embed": (OWN_CONTEXT + BANDS, d), "place": (WINDOW, d), "query": (d, d), "key": (d, d),
            "value": (d, d), "skip": (d, d), "out": (d, n)}


def initial(seed: int = 4) -> np.ndarray:
    """Parameters at the start, end to end; the output is zero, so that the model is its prior."""
    draw = np.random.default_rng(seed)
    parts = []
    for name, shape in shapes().items():
        scale = {"out": 0.0, "embed": 1.0, "place": 0.3}.get(name, shape[0] ** -0.5)
        parts.append((draw.standard_normal(shape) * scale).ravel())
    return np.concatenate(parts).astype(np.float32)


@functools.cache
def _layout() -> list[tuple[str, tuple[int, ...], slice]]:
    """(name, shape, place among all) of the parameters."""
    ends = np.cumsum([np.prod(shape) for shape in shapes().values()]).tolist()
    return [(name, shape, slice(at, end)) for (name, shape), at, end in zip(shapes().items(), [0, *ends], ends, strict=False)]


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    return {name: flat[at].reshape(shape) for name, shape, at in _layout()}


#: Which places a place sees: itself and those before it.
SEEN = np.tril(np.ones((WINDOW, WINDOW), np.float32))
#: Exponentials are taken as powers of two, which numpy makes in half the time.
LOG2E, LN2 = float(np.log2(np.e)), float(np.log(2))
#: Products with these sum up rows: once for each column; all classes, and those that begin a word.
ONES = np.ones((max(WINDOW, NEXT), DEPTH), np.float32)
STARTING = np.ascontiguousarray(np.stack([np.ones(NEXT), np.arange(NEXT) < STARTS], 1), np.float32)
#: Where the gradient of each context class stands.
EMBED_CELLS = np.arange((OWN_CONTEXT + BANDS) * DEPTH).reshape(-1, DEPTH)


def projections(p: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Weights of query, key, value and skip, the query's scaled for attention in powers of two."""
    return p["query"] * p["query"].dtype.type(DEPTH**-0.5 * LOG2E), p["key"], p["value"], p["skip"]


def _through(m: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """States of windows times weights, as one product."""
    return (m.reshape(-1, m.shape[-1]) @ weights).reshape(*m.shape[:-1], weights.shape[-1])


def _turned(m: np.ndarray) -> np.ndarray:
    """Transposed matrices end to end, as products of small matrices are quicker so."""
    return np.ascontiguousarray(np.swapaxes(m, -1, -2))


def attend(p: dict[str, np.ndarray], context: np.ndarray, skip: int = 0, made: tuple[np.ndarray, ...] | None = None) -> tuple:
    """What the way back needs, and last the hidden state at the places of windows of context classes after the first ``skip``."""
    query, key, value, direct = made or projections(p)
    x = p["embed"].take(context, axis=0)
    x += p["place"]
    later = np.ascontiguousarray(x[:, skip:])
    q, k, v = _through(later, query), _through(x, key), _through(x, value)
    a = q @ _turned(k)
    # far beyond any trained value; keeps the plain exponential finite
    if a.size and a.max() > 60 * LOG2E:
        np.minimum(a, 60 * LOG2E, out=a)
    np.exp2(a, out=a)
    a *= SEEN[skip:]
    total = _through(a, ONES[:WINDOW])
    mean = a @ v
    mean /= total
    h = _through(later, direct)
    h += mean
    return x, q, k, v, a, total, mean, np.tanh(h, out=h)


def _high(out: np.ndarray) -> bool:
    """Whether logits could be too large for a plain exponential: states are bounded and the prior is at most 0."""
    return DEPTH * max(out.max(), -out.min()) > 60 and np.abs(out).sum(0).max() > 60


def _logits(out: np.ndarray, prior: np.ndarray, before: np.ndarray, hidden: np.ndarray, twos: bool) -> np.ndarray:
    """Logits of the next class at every place, in powers of two; ``twos`` says whether the prior is in these."""
    logits = hidden @ (out * out.dtype.type(LOG2E))
    own = prior.take(before, axis=0)
    if not twos:
        own *= own.dtype.type(LOG2E)
    logits += own
    return logits


def log_chances(p: dict[str, np.ndarray], prior: np.ndarray, before: np.ndarray, hidden: np.ndarray, target: np.ndarray, twos: bool = False) -> tuple:
    """Log probability at every place of the target class, and of any class that begins a word."""
    logits = _logits(p["out"], prior, before, hidden, twos)
    at = logits.ravel().take(np.arange(0, logits.size, NEXT) + target.ravel()).reshape(before.shape)
    at *= at.dtype.type(LN2)
    if _high(p["out"]):
        np.minimum(logits, 60 * LOG2E, out=logits)
    np.exp2(logits, out=logits)
    total, start = np.log(logits.reshape(-1, NEXT) @ STARTING + 1e-30).T
    return at - total.reshape(at.shape), (start - total).reshape(at.shape)


def gradient(
    p: dict[str, np.ndarray], prior: np.ndarray, before: np.ndarray, context: np.ndarray, target: np.ndarray, scored: np.ndarray,
    twos: bool = False,
) -> tuple[np.ndarray, float]:
    """Gradient of the mean loss over scored places, end to end, and that loss."""
    x, q, k, v, a, total, mean, h = attend(p, context)
    flat = lambda m: m.reshape(-1, m.shape[-1])
    kind, out = h.dtype.type, p["out"]
    chances = _logits(out, prior, before, h, twos)
    if _high(out):
        chances -= chances.max(-1, keepdims=True)
    every, own = chances.ravel(), np.arange(0, chances.size, NEXT) + target.ravel()
    taken = every.take(own)
    np.exp2(chances, out=chances)
    mass = flat(chances) @ ONES[:NEXT, 0]
    # places that are not scored weigh nothing
    weights = scored.ravel() / kind(max(1, np.count_nonzero(scored)))
    loss = float((np.log(mass) - taken * kind(LN2)) @ weights)
    # rows are divided by their mass on the narrow side
    every[own] -= mass
    weights /= mass
    share = np.repeat(weights, DEPTH).reshape(h.shape)
    d_hidden = chances @ _turned(out)
    d_hidden *= share
    share *= h
    g = {"out": (share.transpose(0, 2, 1) @ chances).sum(0)}
    d_h = h * h
    np.subtract(1, d_h, out=d_h)
    d_h *= d_hidden
    # a weight's gradient is that of its share less the mean of these
    d_v = d_h / total
    d_a = d_v @ _turned(v)
    mean *= d_v
    d_a -= _through(mean, ONES[:WINDOW].T)
    d_a *= a
    d_q, d_k, d_v = d_a @ k, d_a.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ d_v
    inputs = flat(x).T
    # query came scaled, and key met it so
    query, key = p["query"] * kind(DEPTH**-0.5), p["key"] * kind(LN2)
    g["query"], g["key"] = inputs @ flat(d_q) * kind(DEPTH**-0.5), inputs @ flat(d_k) * kind(LN2)
    g["value"], g["skip"] = inputs @ flat(d_v), inputs @ flat(d_h)
    d_x = _through(d_q, _turned(query))
    d_x += _through(d_k, _turned(key))
    d_x += _through(d_v, _turned(p["value"]))
    d_x += _through(d_h, _turned(p["skip"]))
    g["place"] = d_x.sum(0)
    g["embed"] = np.bincount(EMBED_CELLS.take(context, axis=0).ravel(), weights=d_x.ravel(), minlength=EMBED_CELLS.size)
    return np.concatenate([g[name].ravel() for name in shapes()], dtype=np.float32, casting="same_kind"), loss


def cut(starts: np.ndarray, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts: (first place, end of the text's places, text) of each.

    A text of n ids has n + 1 places to predict from. The first window scores all its places, each
    further one those after its first ``overlap``.
    """
    places = np.diff(starts) - 1
    step = WINDOW - overlap
    many = 1 + np.maximum(0, -(-(places - WINDOW) // step))
    text = np.repeat(np.arange(len(places)), many)
    order = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    return starts[:-1][text] + order * step, starts[1:][text] - 1, text


def _windows(ids: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(id, id to predict, whether there is one) at the places of windows."""
    found = ids.take(first[:, None] + np.arange(WINDOW + 1), mode="clip")
    return found[:, :-1], found[:, 1:], np.arange(WINDOW) < (end - first)[:, None]


def _gradients(
    classes: Classes, prior: np.ndarray, ids: np.ndarray, first: np.ndarray, end: np.ndarray, flat: np.ndarray
) -> Iterator[np.ndarray]:
    """The gradient of each step's windows by the parameters as they then are; the prior is in powers of two."""
    for at in range(0, len(first), LOOKUP):
        before, target, real = _windows(ids, first[at : at + LOOKUP], end[at : at + LOOKUP])
        context, target = classes.context.take(before).astype(np.intp), classes.next.take(target).astype(np.intp)
        before = before.astype(np.intp)
        for k in range(0, len(before), TRAIN_STEP):
            some = slice(k, k + TRAIN_STEP)
            yield gradient(unpack(flat), prior, before[some], context[some], target[some], real[some], twos=True)[0]


def train(end_id: int, classes: Classes, prior: np.ndarray, start: np.ndarray, turn: int):
    """Rows (place, value, windows): a task's trained parameters times its number of windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = start.copy()
        mean, square = np.zeros_like(flat), np.zeros_like(flat)
        steps = seen = 0
        twos = prior * np.float32(LOG2E)
        for batch in batches:
            for row in batch.to_pylist():
                stream = Streams.of(row, end_id, True)
                if len(stream.starts) < 2:
                    continue
                # end to end, so that each place is learned from once
                first, end, _ = cut(stream.starts, 0)
                chosen = np.random.default_rng(row["block"] * AVERAGES + turn).permutation(
                    np.arange(turn, len(first), AVERAGES))
                for change in _gradients(classes, twos, stream.ids, first[chosen], end[chosen], flat):
                    steps += 1
                    mean += 0.1 * (change - mean)
                    change *= change
                    square += 0.01 * (change - square)
                    rate = 0.02 / (1 + steps / 100)
                    root = np.sqrt(square / (1 - 0.99**steps))
                    root += 1e-8
                    root *= (1 - 0.9**steps) / rate
                    np.divide(mean, root, out=root)
                    flat -= root
                seen += len(chosen)
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat))), pa.array(flat.astype(np.float64) * seen), pa.array(np.full(len(flat), seen))],
                ["place", "value", "windows"])

    return run


@dataclass
class Model:
    """All that scoring needs; ``mass`` and ``kinds`` are the learning words of each first class."""

    end_id: int
    classes: Classes
    following: Following
    prior: np.ndarray
    parameters: np.ndarray
    mass: np.ndarray
    kinds: np.ndarray

    def class_logs(self, stream: Streams) -> tuple[np.ndarray, np.ndarray]:
        """Log chances, by the attention model, of the class at every place but the first of a text, and of a word's start."""
        p = unpack(self.parameters)
        made = projections(p)
        first, end, text = cut(stream.starts)
        new = np.concatenate([[True], text[1:] != text[:-1]]) if len(text) else np.zeros(0, bool)
        out, starting = np.zeros(len(stream.ids), np.float32), np.zeros(len(stream.ids), np.float32)
        prior = self.prior * np.float32(LOG2E)
        for group, skip in ((np.flatnonzero(new), 0), (np.flatnonzero(~new), OVERLAP)):
            for at in range(0, len(group), LOOKUP):
                some = group[at : at + LOOKUP]
                before, target, real = _windows(stream.ids, first[some], end[some])
                context, before = self.classes.context.take(before).astype(np.intp), before[:, skip:].astype(np.intp)
                target, real = self.classes.next.take(target[:, skip:]).astype(np.intp), real[:, skip:]
                found, start = np.empty((2, *before.shape), np.float32)
                for k in range(0, len(some), STEP):
                    step = slice(k, k + STEP)
                    hidden = attend(p, context[step], skip, made)[-1]
                    found[step], start[step] = log_chances(p, prior, before[step], hidden, target[step], twos=True)
                places = (first[some][:, None] + np.arange(skip + 1, WINDOW + 1))[real]
                out[places], starting[places] = found[real], start[real]
        return out, starting

    def score(self, stream: Streams, counts: np.ndarray) -> np.ndarray:
        """log10 probability of each text of a block; ``counts`` are those of its words in the learning texts."""
        logs, starting = self.class_logs(stream)
        codes, pieces, begins, n = stream.codes, stream.pieces, stream.begins, len(stream.words)
        text = np.repeat(np.arange(n), stream.words)
        closing = stream.starts[1:] - 1
        # the end of a text stands where a word could start
        total = (logs - starting)[closing] + np.log(self.classes.share[self.end_id])
        if len(codes):
            # within a word, what follows what does not depend on the text
            spelled = np.log(self.classes.share[pieces])
            later = np.ones(len(pieces), bool)
            later[begins] = False
            at = np.flatnonzero(later)
            spelled[at] = self.following.logs(pieces[at - 1], pieces[at])
            lengths = stream.lengths[codes]
            at = np.cumsum(lengths) - lengths
            places = np.flatnonzero(stream.inside)
            opening = logs[places[at]] - starting[places[at]]
            inner = logs[places] + spelled[stream.source]
            inner[at] = spelled[begins[codes]]
            chain = np.add.reduceat(inner, at) + starting[places[at + lengths - 1] + 1]
            group = self.classes.next[pieces[begins]]
            mass = np.maximum(self.mass[group], 1e-300)
            with np.errstate(divide="ignore"):
                seen = np.log(np.maximum(counts - DISCOUNT, 0) / mass)
                left = np.where(self.mass[group] > 0, np.log(DISCOUNT * self.kinds[group] / mass), 0.0)
            total += np.bincount(text, weights=opening + np.logaddexp(seen[codes], left[codes] + chain), minlength=n)
        return total / np.log(10)


def count_words(classes: Classes):
    """A bucket's words of all blocks: each block gets the counts of its words that were learned.

    The row without block sums up the bucket: learned words and their counts by the class of their first id.
    """
    schema = pa.schema([("block", pa.int64()), ("places", pa.binary()), ("counts", pa.binary())])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        words = pa.concat_arrays(rows.column("words").chunks).flatten().dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False)
        blocks = rows.column("block").to_pylist()
        places, learned, firsts = (
            [unpack_numbers(r, kind) for r in rows.column(name).to_pylist()]
            for name, kind in (("places", "<i4"), ("learned", "<i4"), ("firsts", "<u2")))
        total = np.bincount(codes, weights=np.concatenate(learned), minlength=len(words.dictionary))
        first = np.zeros(len(words.dictionary), np.int64)
        first[codes] = np.concatenate(firsts)
        group = classes.next[first[total > 0]]
        out = [{"block": None, "places": np.bincount(group, weights=total[total > 0], minlength=NEXT).tobytes(),
                "counts": np.bincount(group, minlength=NEXT).astype(float).tobytes()}]
        at = 0
        for block, own in zip(blocks, places, strict=True):
            c = total[codes[at : at + len(own)]]
            at += len(own)
            out.append({"block": block, "places": pack_numbers(own[c > 0], "<i4"), "counts": pack_numbers(c[c > 0], "<i8")})
        return pa.Table.from_pylist(out, schema)

    return run


def learn_classes(texts: DataFrame, path: str) -> Classes:
    """Classes of the ids of all learning texts; one number for each id comes to the driver."""
    end_id = encoding(path).max_token_value + 1
    seen = np.zeros(end_id + 1)
    for number, n in texts.mapInArrow(count_ids(end_id), "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        seen[number] = n
    return Classes.of(seen, word_starts(path))


def learn_pairs(texts: DataFrame, end_id: int) -> DataFrame:
    """The table (pair, n) of all pairs of ids in the learning texts."""
    pairs = texts.mapInArrow(count_pairs(end_id), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return stored(pairs, "pairs")


def block_pairs(texts: DataFrame, pairs: DataFrame, end_id: int) -> DataFrame:
    """(block, pair, n) of the learned pairs inside the words of each block."""
    # the same join on every size
    return texts.mapInArrow(word_pairs(end_id), "block long, pair long").join(pairs.hint("merge"), "pair").select("block", "pair", "n")


def learn(texts: DataFrame, pairs: DataFrame, classes: Classes, mass: np.ndarray, kinds: np.ndarray) -> Model:
    """The model of all learning texts, without pairs at hand; what comes to the driver has a bound: ids x classes."""
    end_id = len(classes.next) - 1
    # the next class after every id: at most one row for each id and class
    names = pairs.select(F.floor(F.col("pair") / (end_id + 1)).alias("before"), F.pmod("pair", F.lit(end_id + 1)).alias("after"), "n")
    after = names.groupBy("before", _lookup(classes.next, "after").alias("class")).agg(
        F.sum("n").alias("n"), F.count("*").alias("kinds")).toPandas()
    before, following, n = (after[c].to_numpy(np.int64) for c in ("before", "class", "n"))
    table = np.zeros((end_id + 1, NEXT), np.float32)
    table[before, following] = n
    prior = smoothed(table, classes, table.sum(0) + 0.5)
    # within words only ids that go on with one follow
    groups = before * NEXT + following
    order = np.argsort(groups, kind="stable")
    order = order[following[order] >= STARTS]
    none = np.zeros(0, np.int64)
    spelled = Following(classes, groups[order], n[order].astype(float), after["kinds"].to_numpy(np.int64)[order], none, none)
    parameters = initial()
    for turn in range(AVERAGES):
        sums = texts.mapInArrow(train(end_id, classes, prior, parameters, turn), "place long, value double, windows long")
        sums = sums.groupBy("place").agg(F.sum("value").alias("value"), F.sum("windows").alias("windows"))
        for place, value, windows in sums.collect():
            parameters[place] = value / windows
    return Model(end_id, classes, spelled, prior, parameters, mass, kinds)


def _lookup(values: np.ndarray, column: str) -> Column:
    """The value of an id."""
    return F.element_at(F.from_json(F.lit(str(values.tolist())), "array<int>"), (F.col(column) + 1).cast("int"))


def scores(docs: DataFrame, folds: int = 5, held_fold: int = 1, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words in lower case (A-Z only) between ASCII white space, and one end; a null text is
    empty and has the end alone. The base is the smoothed unigram of all learning texts, those outside
    the held-out fold. Without learning texts counts are zero and the model is its smoothing. Rows that
    repeat are rows of their own; no rows give no rows; further columns are ignored.
    """
    spark = ready(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = fold("doc_id", folds) == held_fold
    rows = needed(docs, ["doc_id", "text"]).select("doc_id", "text", (~held).alias("learning"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(BUCKETS, size // BUCKET_BYTES)
    blocks = stored(rows.mapInArrow(make_blocks(path, buckets), BLOCK_SCHEMA.format(kind=kind)), "blocks")
    texts = blocks.filter("bucket IS NULL").select(*TEXTS)
    classes = learn_classes(texts, path)
    words = blocks.filter("bucket IS NOT NULL").select("block", "bucket", "words", "places", "learned", "firsts")
    counts = words.groupBy("bucket").applyInArrow(count_words(classes), "block long, places binary, counts binary")
    counts = stored(counts, "words")
    # a row for each bucket
    sums = counts.filter("block IS NULL").collect()
    mass = sum((np.frombuffer(r["places"], np.float64) for r in sums), np.zeros(NEXT))
    kinds = sum((np.frombuffer(r["counts"], np.float64) for r in sums), np.zeros(NEXT))
    ends = rows.filter("learning").count()
    total, distinct = int(mass.sum()) + ends, int(kinds.sum()) + (ends > 0)
    pairs = learn_pairs(texts, len(classes.next) - 1)
    model = spark.sparkContext.broadcast(learn(texts, pairs, classes, mass, kinds))
    scale, end_base = float(np.log10(total + 0.5 * (distinct + 1))), float(np.log10(ends + 0.5))

    def run(blocks: pa.Table, known: pa.Table) -> pa.Table:
        ids = blocks.schema.field("doc_ids").type.value_type
        found = {"doc_id": pa.array([], ids), "n_tokens": np.zeros(0, np.int64), "n_known": np.zeros(0, np.int64),
                 "base_score": np.zeros(0), "score": np.zeros(0)}
        of_words, of_pairs = (known.filter(pc.is_valid(known.column(name))) for name in ("places", "pair"))
        following = model.value.following.knowing(*(of_pairs.column(name).to_numpy() for name in ("pair", "n")))
        for row in blocks.to_pylist():
            stream = Streams.of(row, model.value.end_id)
            codes, size = stream.codes, stream.words + 1
            c = np.zeros(len(stream.lengths))
            for places, counts in zip(of_words.column("places").to_pylist(), of_words.column("counts").to_pylist(), strict=True):
                c[unpack_numbers(places, "<i4")] = unpack_numbers(counts, "<i8")
            text, n = np.repeat(np.arange(len(size)), stream.words), len(size)
            base = np.bincount(text, weights=np.log10(c + 0.5)[codes], minlength=n)
            has = np.bincount(text, weights=(c > 0)[codes], minlength=n).astype(np.int64)
            found = {
                "doc_id": pa.array(row["doc_ids"], ids), "n_tokens": size, "n_known": has + (ends > 0),
                "base_score": base + end_base - size * scale, "score": replace(model.value, following=following).score(stream, c)}
        return pa.table(found)

    whole = blocks.filter("bucket IS NULL").select("doc_ids", *TEXTS)
    known = counts.filter("block IS NOT NULL").select(F.col("block").alias("of_block"), "places", "counts").unionByName(
        block_pairs(texts, pairs, len(classes.next) - 1).withColumnRenamed("block", "of_block"), allowMissingColumns=True)
    found = whole.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(
        run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return found.select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        "base_score", "score")
