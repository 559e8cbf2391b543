"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel of two words counts the subsequences of three signs they share, gaps included, each
weighted by ``DECAY`` to the length it spans in either word; it is normalised by the words' own kernels.
A gapped or spelled-out insult, or one with signs put in, still shares most subsequences with the
plain one.

A text is a bag of its words, and its decision is that of its worst word. Landmarks are words of the
learning texts: those that set toxic texts apart and the commonest others. The machine is linear in the
landmarks' Nyström features, and is trained on labelled texts by subgradients of the hinge loss of the
bags. Scores are calibrated on the learning texts.

As every landmark is a word, the trained decision is one weight for each subsequence of three signs;
words of a batch are scored together by looking those up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import chunks, fold, needed, ready, slices

DECAY = 0.7
#: Subsequences span at most this many signs.
SPAN = 7
#: Longer words are cut into windows of this many signs, half of each shared with the next.
WIDTH = 24
#: Signs the kernel tells apart: none, a to z, and classes of all other letters.
SIGNS = 40
LANDMARKS = 96
#: Labelled texts of each class that the machine is fitted on, chosen by a hash of their id.
FIT_ROWS = 1500
ROUNDS = 600
#: Words whose subsequences are held at once.
PART = 2048
#: A word of so many toxic learning texts and of no other one is taken for a toxic text of its own.
TELLING = 5
SEED = 7

#: Signs that stand for a letter of similar shape.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
_PLAIN = str.maketrans(LOOKALIKES)


def plain(word: str) -> str:
    """A word in lower case: letters only, with look-alikes inside it read as letters."""
    word = word.lower()
    if word.isalpha():
        return word
    core = word.strip("!|$@.,;:?()[]{}\"'`*#&%+-_=~<>/\\")
    if any(c.isalpha() for c in core):
        core = core.translate(_PLAIN)
    return "".join([c for c in core if c.isalpha()])


def sign(char: str) -> int:
    """1 to 26 for a to z, a class above them for any other letter."""
    code = ord(char) - 96
    return code if 1 <= code <= 26 else 27 + ord(char) % (SIGNS - 27)


def windows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(signs of each window in rows of WIDTH, the word each window is of) of plain words."""
    rows, owner = [], []
    for i, word in enumerate(words):
        if len(word) <= WIDTH:
            rows.append(word)
            owner.append(i)
        else:
            for at in range(0, len(word) - WIDTH // 2, WIDTH // 2):
                rows.append(word[at : at + WIDTH])
                owner.append(i)
    joined = "".join([r.ljust(WIDTH, "\0") for r in rows])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), WIDTH).astype(np.int64)
    code = points - 96
    signs = np.where((code >= 1) & (code <= 26), code, np.where(points == 0, 0, 27 + points % (SIGNS - 27)))
    return signs.astype(np.int32), np.array(owner, np.int64)


def subsequences(signs: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """(number of the subsequence at each place, weight) for every shape of a gapped subsequence of three."""
    for total in range(2, SPAN):
        for first in range(1, total):
            a, b, c = signs[:, : WIDTH - total], signs[:, first : WIDTH - total + first], signs[:, total:]
            yield np.where(c > 0, (a * SIGNS + b) * SIGNS + c, 0), DECAY ** (total + 1)


def own_kernels(signs: np.ndarray) -> np.ndarray:
    """The kernel of each window with itself."""
    shapes = list(subsequences(signs))
    numbers = np.concatenate([s for s, _ in shapes], axis=1)
    weights = np.concatenate([np.full(s.shape[1], w) for s, w in shapes])
    order = np.argsort(numbers, axis=1, kind="stable")
    sorted_numbers, sorted_weights = np.take_along_axis(numbers, order, 1), weights[order]
    sorted_weights[sorted_numbers == 0] = 0
    # equal subsequences of a window add up before they are squared
    ends = np.ones(numbers.shape, bool)
    ends[:, :-1] = sorted_numbers[:, 1:] != sorted_numbers[:, :-1]
    sums = np.cumsum(sorted_weights, axis=1)
    flat, at = sums[ends], np.nonzero(ends)[0]
    before = np.concatenate([[0.0], flat[:-1]])
    before[np.concatenate([[True], at[1:] != at[:-1]])] = 0
    return np.bincount(at, weights=(flat - before) ** 2, minlength=len(signs))


def weighted(signs: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum over a window's subsequences of their rows in ``table``."""
    out = np.zeros((len(signs), *table.shape[1:]), np.float64)
    for numbers, weight in subsequences(signs):
        out += weight * table[numbers].sum(axis=1)
    return out


def subsequence_table(signs: np.ndarray) -> np.ndarray:
    """The normalised subsequence weights of windows, a column for each; row 0 stands for none."""
    table = np.zeros((SIGNS**3, len(signs)), np.float32)
    for numbers, weight in subsequences(signs):
        columns = np.broadcast_to(np.arange(len(signs))[:, None], numbers.shape)
        np.add.at(table, (numbers.ravel(), columns.ravel()), weight)
    table[0] = 0
    return table / np.maximum(np.sqrt(own_kernels(signs)), 1e-9).astype(np.float32)


def kernel(words: list[str], others: list[str]) -> np.ndarray:
    """The normalised kernel of plain words (their first windows) with other ones."""
    signs = windows([w[:WIDTH] for w in words])[0]
    table = subsequence_table(windows([w[:WIDTH] for w in others])[0])
    return weighted(signs, table) / np.maximum(np.sqrt(own_kernels(signs)), 1e-9)[:, None]


@dataclass
class ToxicityModel:
    """A weight for each subsequence, the decision's offset, and the calibration of decisions."""

    table: np.ndarray
    offset: float
    slope: float
    shift: float

    def words(self, words: list[str]) -> np.ndarray:
        """The decision on each plain word, which is that of its worst window."""
        out = np.full(len(words), self.offset)
        for start in range(0, len(words), PART):
            part = words[start : start + PART]
            signs, owner = windows(part)
            value = weighted(signs, self.table) / np.maximum(np.sqrt(own_kernels(signs)), 1e-9)
            np.maximum.at(out, owner + start, value + self.offset)
        return out

    def scores(self, decisions: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decisions + self.shift, -30, 30)))


def spelled(offsets: np.ndarray, codes: np.ndarray, single: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(text, codes) of runs of three or more one-letter words, which may spell one word."""
    if not single.any():
        return
    flags = single[codes]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    begins = flags & np.concatenate([[True], ~flags[:-1] | (text[1:] != text[:-1])])
    ends = flags & np.concatenate([~flags[1:] | (text[1:] != text[:-1]), [True]])
    for a, b in zip(np.flatnonzero(begins).tolist(), np.flatnonzero(ends).tolist(), strict=True):
        if b - a >= 2:
            yield int(text[a]), codes[a : b + 1]


class Bags:
    """Texts as bags of plain words."""

    def __init__(self, texts: pa.Array):
        offsets, codes, raw = chunks(texts)
        forms = [plain(w) for w in raw.to_pylist()]
        self.words = list(dict.fromkeys(forms))
        number = {w: i for i, w in enumerate(self.words)}
        of_code = np.array([number[f] for f in forms], np.int64)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        owners, members = [text], [of_code[codes]]
        single = np.array([len(f) == 1 for f in forms], bool)
        for where, run in spelled(offsets, codes, single):
            word = "".join([forms[c] for c in run.tolist()])
            if word not in number:
                number[word] = len(self.words)
                self.words.append(word)
            owners.append(np.array([where]))
            members.append(np.array([number[word]]))
        self.size = len(offsets) - 1
        self.text, self.member = np.concatenate(owners), np.concatenate(members)

    @classmethod
    def of(cls, bags: list[list[str]]) -> Bags:
        """From the words of each text."""
        out = cls(pa.array([], pa.string()))
        number: dict[str, int] = {}
        out.member = np.array([number.setdefault(w, len(number)) for words in bags for w in words], np.int64)
        out.text = np.repeat(np.arange(len(bags)), [len(words) for words in bags])
        out.words, out.size = list(number), len(bags)
        return out

    def lists(self) -> list[list[str]]:
        """The distinct words of each text, in an order that does not depend on other texts."""
        self.distinct()
        cuts = np.searchsorted(self.text, np.arange(self.size + 1)).tolist()
        return [sorted([self.words[m] for m in self.member[a:b].tolist()]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def distinct(self) -> None:
        """Each word of a text once."""
        pairs = np.unique(self.text * max(1, len(self.words)) + self.member)
        self.text, self.member = np.divmod(pairs, max(1, len(self.words)))

    def worst(self, decisions: np.ndarray, least: float) -> np.ndarray:
        """The largest decision among the words of each text; ``least`` without words."""
        out = np.full(self.size, least)
        np.maximum.at(out, self.text, decisions[self.member])
        return out


def _landmarks(bags: Bags, labels: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Words that set toxic texts apart, none much like one chosen before; the commonest others; telling words."""
    n = len(bags.words)
    toxic = np.bincount(bags.member, weights=labels[bags.text], minlength=n)
    clean = np.bincount(bags.member, weights=1 - labels[bags.text], minlength=n)
    share = (toxic + 0.5) / (labels.sum() + 1) / ((clean + 0.5) / ((1 - labels).sum() + 1))
    usable = np.array([len(w) >= 3 for w in bags.words], bool)
    gain = np.where(usable & (share > 3), toxic * np.log(np.maximum(share, 1e-9)), 0)
    ranked = [i for i in np.argsort(-gain, kind="stable")[: 40 * LANDMARKS].tolist() if gain[i] > 0]
    chosen: list[int] = []
    if ranked:
        signs = windows([bags.words[i][:WIDTH] for i in ranked])[0]
        scale = np.maximum(np.sqrt(own_kernels(signs)), 1e-9)
        closest = np.zeros(len(ranked))
        for place in range(len(ranked)):
            if len(chosen) == LANDMARKS // 2:
                break
            if closest[place] < 0.8:
                chosen.append(ranked[place])
                like = weighted(signs, subsequence_table(signs[place : place + 1]))[:, 0] / scale
                closest = np.maximum(closest, like)
    common = np.where(usable & (share < 1.2), clean, 0)
    others = [i for i in np.argsort(-common, kind="stable")[: LANDMARKS - len(chosen)].tolist() if common[i] > 0]
    telling = np.flatnonzero(usable & (clean == 0) & (toxic >= TELLING) & (share > 3))
    return chosen, others, telling.tolist()


def fit(texts: list[str], labels: list[int]) -> ToxicityModel:
    """The machine fitted to labelled texts; without both labels it finds nothing toxic."""
    return fit_bags(Bags(pa.array(texts, pa.string())), labels)


def fit_bags(bags: Bags, labels: list[int]) -> ToxicityModel:
    """The same for texts as bags of words."""
    y = np.array(labels, np.float64)
    bags.distinct()
    chosen, others, telling = _landmarks(bags, y) if len(set(labels)) == 2 else ([], [], [])
    if not chosen:
        base = float(np.clip(y.mean() if len(y) else 0.0, 0.01, 0.49))
        return ToxicityModel(np.zeros(SIGNS**3), -1.0, 1.0, 1 + float(np.log(base / (1 - base))))
    marks = [bags.words[i] for i in chosen + others]
    table = subsequence_table(windows([w[:WIDTH] for w in marks])[0])
    # Nyström: features whose inner products are the kernel projected on the landmarks
    among = kernel(marks, marks)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    root = vectors * (1 / np.sqrt(np.maximum(values, 1e-3)))
    signs, owner = windows(bags.words)
    features = np.empty((len(signs), len(marks)), np.float32)
    for at in range(0, len(signs), PART):
        part = signs[at : at + PART]
        near = weighted(part, table) / np.maximum(np.sqrt(own_kernels(part)), 1e-9)[:, None]
        features[at : at + PART] = near @ root
    bags.text = np.concatenate([bags.text, bags.size + np.arange(len(telling))])
    bags.member = np.concatenate([bags.member, np.array(telling, np.int64)])
    real, y = bags.size, np.concatenate([y, np.ones(len(telling))])
    # bags over windows
    of_word = np.argsort(owner, kind="stable")
    first, count = np.searchsorted(owner[of_word], np.arange(len(bags.words))), np.bincount(owner, minlength=len(bags.words))
    times = count[bags.member]
    bag = np.repeat(bags.text, times)
    inside = np.arange(len(bag)) - np.repeat(np.cumsum(times) - times, times)
    item = of_word[np.repeat(first[bags.member], times) + inside]
    order = np.argsort(bag, kind="stable")
    bag, item = bag[order], item[order]
    filled, starts = np.unique(bag, return_index=True)
    target = 2 * y[filled] - 1
    own = target[filled >= real]
    cost = np.where(target > 0, 0.5 / max(1, (target > 0).sum() - len(own)), 0.5 / max(1, (target < 0).sum()))
    cost[filled >= real] = 0.25 / max(1, len(own))
    # start: near a toxic landmark is toxic, near another one is not
    start = np.concatenate([np.ones(len(chosen)), -np.ones(len(others))])
    weights, offset = (root.T @ start) * 0.5, -0.5
    kept, kept_offset = np.zeros_like(weights), 0.0
    strength, averaged = 1e-4, 0
    for round_ in range(ROUNDS):
        decision = features @ weights.astype(np.float32)
        value = decision[item] + offset
        peak = np.maximum.reduceat(value, starts)
        hit = value == np.repeat(peak, np.diff([*starts, len(value)]))
        where = np.flatnonzero(hit)
        worst = item[where[np.unique(bag[where], return_index=True)[1]]]
        loss = (target * peak < 1) * cost * target
        step = 20.0 / (1 + round_ / 50)
        weights = weights * (1 - step * strength) + step * (loss @ features[worst])
        offset += step * loss.sum() * 0.5
        if round_ >= ROUNDS // 2:
            kept, kept_offset, averaged = kept + weights, kept_offset + offset, averaged + 1
    weights, offset = kept / averaged, kept_offset / averaged
    value = features @ weights + offset
    peak = np.maximum.reduceat(value[item], starts)
    slope, shift = _calibrated(peak[filled < real], y[filled[filled < real]])
    return ToxicityModel(table.astype(np.float64) @ (root @ weights), float(offset), slope, shift)


def _calibrated(decisions: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the decisions, each class weighing the same.

    The slope is positive, so that a larger decision never scores lower.
    """
    positives = max(1, labels.sum())
    negatives = max(1, len(labels) - labels.sum())
    target = np.where(labels > 0, (positives + 1) / (positives + 2), 1 / (negatives + 2))
    weight = np.where(labels > 0, 0.5 / positives, 0.5 / negatives)
    slope, shift = 2.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(slope * decisions + shift, -30, 30)))
        error, curve = weight * (p - target), weight * p * (1 - p)
        gradient = np.array([error @ decisions + 1e-6 * slope, error.sum()])
        second = np.array([[curve @ decisions**2 + 1e-4, curve @ decisions], [curve @ decisions, curve.sum() + 1e-4]])
        move = np.linalg.solve(second, gradient)
        slope, shift = max(0.1, slope - float(np.clip(move[0], -1, 1))), shift - float(np.clip(move[1], -1, 1))
        if np.abs(move).max() < 1e-6:
            break
    return slope, shift


def text_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, toxic, text) with the distinct words of the whole text in place of the text."""
    for whole in batches:
        for batch in slices(whole, 2):
            words = pa.array(Bags(batch.column(2)).lists(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), words], ["doc_id", "toxic", "words"])


def learning_bags(docs: DataFrame, labels: DataFrame, folds: int, held_fold: int, rows: int) -> tuple[Bags, list[int]]:
    """Up to ``rows`` labelled texts of each class outside the held-out fold, those of the smallest hash.

    The distinct words of the whole texts come to the driver.
    """
    known = needed(labels, ["doc_id", "toxic"]).filter("toxic IS NOT NULL AND doc_id IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(fold("doc_id", folds) != held_fold)
    hashed = F.xxhash64(F.col("doc_id").cast("long"), F.lit(SEED))
    # the ids of the sample, then their texts: at most 2 x rows of them
    sample = [known.filter(F.col("toxic") == label).orderBy(hashed, "doc_id").limit(rows) for label in (0, 1)]
    sample = sample[0].unionByName(sample[1]).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    texts = needed(docs, ["doc_id", "text"]).filter("text IS NOT NULL").join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    found = texts.mapInArrow(text_bags, f"doc_id {kind}, toxic int, words array<string>").collect()
    found = sorted(found, key=lambda r: r["doc_id"])
    return Bags.of([r["words"] for r in found]), [r["toxic"] for r in found]


def _trained(docs: DataFrame, labels: DataFrame, folds: int, held_fold: int, rows: int):
    spark = ready(docs.sparkSession)
    return spark.sparkContext.broadcast(fit_bags(*learning_bags(docs, labels, folds, held_fold, rows)))


#: Words kept with their decision in a worker; a full memo starts anew, which costs time and changes nothing.
MEMO_WORDS = 300_000


def _scores(model: ToxicityModel, memo: dict[str, float], texts: pa.Array) -> np.ndarray:
    bags = Bags(texts)
    new = [w for w in bags.words if w not in memo]
    if len(memo) + len(new) > MEMO_WORDS:
        memo.clear()
        new = bags.words
    memo.update(zip(new, model.words(new).tolist(), strict=True))
    decisions = np.fromiter((memo[w] for w in bags.words), np.float64, len(bags.words))
    return model.scores(bags.worst(decisions, model.offset))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, rows: int = FIT_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Fitted on up to ``rows`` labelled texts of each class outside the held-out fold; texts are fitted and
    scored whole, by their words alone. A null or empty text has the score of a text without words. Of several labels of a doc_id the largest counts; rows without a
    label or id teach nothing. Without labels of both classes nothing is found toxic. Rows that repeat
    are rows of their own; no rows give no rows; further columns are ignored.
    """
    model = _trained(docs, labels, folds, held_fold, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for whole in batches:
            for batch in slices(whole):
                scores = _scores(model.value, memo, batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = needed(docs, ["doc_id", "text"]).mapInArrow(run, f"doc_id {kind}, score double")
    return found.select(
        "doc_id", (fold("doc_id", folds) == held_fold).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with the columns they came with."""
    model, at = _trained(docs, labels, 5, 0, FIT_ROWS), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for whole in batches:
            for batch in slices(whole, at):
                yield batch.filter(pa.array(_scores(model.value, memo, batch.column(at)) < 0.5))

    return docs.mapInArrow(run, docs.schema)
