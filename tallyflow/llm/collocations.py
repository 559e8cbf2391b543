"""Phrase collocations: exact counts of all frequent phrases by counting quotient filters.

1. Texts become shards: the words of some megabytes of one language, as codes into their own dictionary,
   with breaks where pieces end. A phrase of n words can only be frequent if both phrases of n - 1 words
   in it are, so each level counts nothing else; that loses no frequent phrase.
2. Shards count their words in blocks by a hash of the word. Blocks of all shards meet, sums decide which
   words are frequent, and each shard gets the ids of its frequent words back.
3. At each further level a shard counts its phrases in filters of packed word ids, one for each block of
   the permuted space. Filters of a block merge by their sorted remainders; each gets back one bit for
   each of its phrases: frequent or not. Phrases themselves never return, and nothing is broadcast.
4. The frequent phrases (all parts of a candidate are among them) are joined to score cuts.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.llm import phrase_filter
from tallyflow.llm.common import needed, ready, slices, stored

#: Bytes of text from which a shard ends with its piece, and that a task holds of all languages.
SHARD_BYTES, HELD_BYTES = 8 << 20, 24 << 20

#: Bytes of text for each block of words, and words for each block of phrases.
WORD_BLOCK_BYTES, PHRASE_BLOCK_WORDS = 32 << 20, 1 << 21

#: What ends a piece, what ends a word, and letters in lower case.
SIGNS = bytes.maketrans(b".,;:!?\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n\n\n\n\n\n\n\n\n abcdefghijklmnopqrstuvwxyz")

# states of shards and what they counted stand in one table, in columns of their own
SHARDS = "shard long, lang string, codes binary, ranks binary, n long, block int, at int, size int, words array<string>, counts array<int>"
COUNTED = "shard long, lang string, places binary, pairs binary, base binary, n int, block int, at int, size int, " \
    "occupied binary, run_ends binary, remainders binary, counts binary"
# likewise what goes back to shards and what was found
WORDS = "shard long, at int, size int, frequent binary, ids binary, lang string, word string, id long, f long"
MERGED = "shard long, at int, size int, frequent binary, lang string, ids array<long>, f long"


@dataclass(frozen=True)
class Packing:
    """Bits of a word id, and of the blocks that phrases are dealt to."""

    width: int
    blocks: int

    def of(self, n: int) -> tuple[int, int]:
        """For phrases of n words: bits of the block, and bits of the first lane."""
        first = phrase_filter.first_bits(n, self.width)
        return min(self.blocks, first - 1), first


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
             "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers that are not negative in as few bytes as the largest needs, byte by byte, compressed."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return struct.pack("<QB", len(values), width) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def spread(raw: bytes) -> np.ndarray:
    """The numbers of ``squeezed``."""
    n, width = struct.unpack_from("<QB", raw)
    planes = np.frombuffer(pa.decompress(raw[9:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8")[:, 0].astype(np.int64)


def coded(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, how often each occurs, and the words in order as codes with -1 where a piece ends.

    ``data`` has blanks between words and line feeds between pieces.
    """
    signs = np.frombuffer(data, np.uint8)
    inside = (signs != 32) & (signs != 10)
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
    if not len(starts):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.concatenate([np.cumsum(inside)[starts] - 1, [inside.sum()]]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(signs[inside].tobytes())])
    words = words.dictionary_encode()
    codes = words.indices.to_numpy().astype(np.int64)
    piece = np.cumsum(signs == 10)[starts]
    counts = np.bincount(codes, minlength=len(words.dictionary))
    return words.dictionary, counts, np.insert(codes, np.flatnonzero(np.diff(piece)) + 1, -1)


def cut(data: bytes, size: int) -> Iterator[bytes]:
    """Runs of whole pieces of about ``size`` bytes (one piece, if that is longer)."""
    at = 0
    while at < len(data):
        end = data.find(b"\n", at + size)
        end = len(data) if end < 0 else end + 1
        yield data[at:end]
        at = end


def _shard(shard: int, lang: str, data: bytes, blocks: int) -> pa.RecordBatch | None:
    """The rows of a shard: its codes, and its words with their counts by block."""
    words, counts, codes = coded(data)
    if not len(words):
        return None
    block = np.fromiter((zlib.crc32(w) % blocks for w in words.to_pylist()), np.int64, len(words))
    order = np.argsort(block, kind="stable")
    # codes by frequency are small numbers; ``ranks`` has them in the order of the blocks
    rank = np.empty(len(order) + 1, np.int64)
    rank[np.argsort(-counts, kind="stable")], rank[-1] = np.arange(len(order)), -1
    ranks = rank[order]
    words, counts, block = words.take(pa.array(order)).cast(pa.large_string()).cast(pa.string()), counts[order], block[order]
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
    rows = [{"codes": squeezed(rank[codes] + 1), "ranks": squeezed(ranks), "n": int(counts.sum()), "size": len(words)}]
    rows += [{"block": int(block[a]), "at": a, "size": b - a, "words": words.slice(a, b - a).to_pylist(), "counts": counts[a:b].tolist()}
             for a, b in zip(cuts, cuts[1:], strict=False)]
    return pa.RecordBatch.from_pylist([{"shard": shard, "lang": lang, **r} for r in rows], _arrow(SHARDS))


def shards(docs: DataFrame, blocks: int, size: int = SHARD_BYTES, held: int = HELD_BYTES) -> DataFrame:
    """The texts as shards of one language each; ``n`` is the number of words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting, total = TaskContext.get().partitionId() << 32, {}, 0

        def finish(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for data in cut(b"\n".join(waiting.pop(lang)), size):
                if rows := _shard(number, lang, data, blocks):
                    yield rows
                    number += 1

        for whole in batches:
            for batch in slices(whole, limit=size):
                texts, langs = pc.fill_null(batch.column(1), ""), batch.column(0)
                for lang in langs.unique().to_pylist():
                    own = b"\n".join(texts.filter(pc.equal(langs, lang)).cast(pa.binary()).to_pylist()).translate(SIGNS)
                    waiting.setdefault(lang, []).append(own)
                    total += len(own)
                    # a language that fills a shard, or the largest of too many
                    while waiting and (total > held or sum(map(len, waiting.get(lang, ()))) >= size):
                        largest = max(waiting, key=lambda k: sum(map(len, waiting[k])))
                        total -= sum(map(len, waiting[largest]))
                        yield from finish(largest)
        for lang in list(waiting):
            yield from finish(lang)

    return needed(docs, ["lang", "text"]).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, SHARDS)


def _merge_words(least: int, blocks: int):
    """Words of one block from all shards: the frequent ones get ids, which go back to the shards that hold them."""
    def run(rows: pa.Table) -> pa.Table:
        words, counts = rows["words"].combine_chunks(), rows["counts"].combine_chunks()
        sizes = rows["size"].to_numpy()
        langs = rows["lang"].combine_chunks().take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        # a word holds no blank
        names = pc.binary_join_element_wise(words.flatten(), langs, " ").dictionary_encode()
        place = names.indices.to_numpy()
        total = np.zeros(len(names.dictionary), np.int64)
        np.add.at(total, place, counts.flatten().to_numpy())
        frequent = np.flatnonzero(total >= least)
        named = sorted(zip(names.dictionary.take(pa.array(frequent)).to_pylist(), frequent.tolist(), strict=True))
        ids = np.zeros(len(total), np.int64)
        ids[[k for _, k in named]] = np.arange(1, len(named) + 1) * blocks + rows["block"][0].as_py()
        out, at = [], 0
        for shard, first, size in zip(rows["shard"].to_pylist(), rows["at"].to_pylist(), sizes.tolist(), strict=True):
            own = ids[place[at : at + size]]
            at += size
            if own.any():
                out.append({"shard": shard, "at": first, "size": size, "frequent": np.packbits(own > 0).tobytes(),
                            "ids": squeezed(own[own > 0])})
        for name, k in named:
            word, lang = name.split(" ", 1)
            out.append({"lang": lang, "word": word, "id": int(ids[k]), "f": int(total[k])})
        return pa.Table.from_pylist(out, _arrow(WORDS))

    return run


def _marked(found: pa.Table, size: int) -> np.ndarray:
    """Which of a shard's words or phrases are frequent, from the rows that came back for it."""
    kept = np.zeros(size, bool)
    for row in found.select(["at", "size", "frequent"]).to_pylist():
        kept[row["at"] : row["at"] + row["size"]] = np.unpackbits(np.frombuffer(row["frequent"], np.uint8), count=row["size"])
    return kept


def _numbered(kept: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Places by the number of what is kept, -1 for all others; a run of those is one."""
    number = np.append(np.where(kept, np.cumsum(kept) - 1, -1), -1)[places]
    return number[(number >= 0) | np.concatenate([[False], number[:-1] >= 0])] if len(number) else number


def _phrases(base: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Phrases of one word more than those of ``base``, of which a pair has the first and the second."""
    first, second = np.divmod(pairs, max(1, len(base)))
    return np.hstack([base[first], base[second][:, -1:]])


def _counted(shard: int, lang: str, places: np.ndarray, base: np.ndarray, packing: Packing, last: bool) -> pa.Table:
    """A shard's phrases of one word more than those of ``base``: its state, unless it is the last level, and its filters.

    ``places`` has the frequent phrase at each place. A longer one counts if the phrases that begin at its
    place and one later are both frequent.
    """
    at = np.flatnonzero((places[:-1] >= 0) & (places[1:] >= 0))
    if not len(at):
        return _arrow(COUNTED).empty_table()
    pairs, back, counts = np.unique(places[at] * len(base) + places[at + 1], return_inverse=True, return_counts=True)
    lanes = phrase_filter.pack(_phrases(base, pairs), packing.width)
    order = phrase_filter.in_order(lanes)
    lanes, counts = lanes[order], counts[order].astype(np.int64)
    bits, first = packing.of(base.shape[1] + 1)
    blocks = phrase_filter.block_of(lanes, bits, first)
    cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
    rows = [{"block": int(blocks[a]), "at": a, "size": b - a, **phrase_filter.encode(lanes[a:b], counts[a:b], bits, first)}
            for a, b in zip(cuts, cuts[1:], strict=False)]
    if not last:
        following = np.full(len(places), -1, np.int64)
        following[at] = back
        rows.append({"places": squeezed(_numbered(np.ones(len(pairs), bool), following) + 1),
                     "pairs": squeezed(np.diff(pairs, prepend=0)), "base": squeezed(base.ravel()), "size": len(pairs)})
    return pa.Table.from_pylist([{"shard": shard, "lang": lang, "n": base.shape[1] + 1, **r} for r in rows], _arrow(COUNTED))


def _pairs_of_words(packing: Packing, last: bool):
    """A shard and the ids of its frequent words to its filters of two words."""
    def run(shard: pa.Table, found: pa.Table) -> pa.Table:
        if not shard.num_rows or not found.num_rows:
            return _arrow(COUNTED).empty_table()
        row = shard.to_pylist()[0]
        found = found.sort_by("at")
        ids = np.concatenate([spread(r) for r in found["ids"].to_pylist()])
        kept, ranks = _marked(found, row["size"]), spread(row["ranks"])
        # ids come in the order of the blocks, codes are ranks
        by_rank = np.zeros(row["size"], np.int64)
        by_rank[ranks[kept]] = ids
        places = _numbered(by_rank > 0, spread(row["codes"]) - 1)
        return _counted(row["shard"], row["lang"], places, by_rank[by_rank > 0][:, None], packing, last)

    return run


def _next_level(packing: Packing, last: bool):
    """A shard's state and the bits of its frequent phrases to its filters of one word more."""
    def run(state: pa.Table, found: pa.Table) -> pa.Table:
        if not state.num_rows or not found.num_rows:
            return _arrow(COUNTED).empty_table()
        row = state.to_pylist()[0]
        base = spread(row["base"]).reshape(-1, row["n"] - 1)
        grams = _phrases(base, np.cumsum(spread(row["pairs"])))
        kept = np.zeros(len(grams), bool)
        kept[phrase_filter.in_order(phrase_filter.pack(grams, packing.width))] = _marked(found, len(grams))
        places = _numbered(kept, spread(row["places"]) - 1)
        return _counted(row["shard"], row["lang"], places, grams[kept], packing, last)

    return run


def _merge_phrases(n: int, packing: Packing, least: int):
    """Filters of one block from all shards: the frequent phrases, and for each filter that holds some which they are."""
    def run(rows: pa.Table) -> pa.Table:
        rows, (bits, first) = rows.to_pylist(), packing.of(n)
        parts = [phrase_filter.decode(r["block"], r["occupied"], r["run_ends"], r["remainders"], r["counts"], bits, first,
                                      phrase_filter.lanes_of(n, packing.width), r["size"]) for r in rows]
        lanes, total, place = phrase_filter.merged([p[0] for p in parts], [p[1] for p in parts])
        frequent = total >= least
        holder = np.empty(len(lanes), np.int64)
        holder[place] = np.repeat(np.arange(len(rows)), [r["size"] for r in rows])
        out, at = [], 0
        for r in rows:
            own = frequent[place[at : at + r["size"]]]
            at += r["size"]
            if own.any():
                out.append({"shard": r["shard"], "at": r["at"], "size": r["size"], "frequent": np.packbits(own).tobytes()})
        ids = phrase_filter.unpack(lanes[frequent], n, packing.width).astype(np.int64).tolist()
        out += [{"lang": rows[h]["lang"], "ids": i, "f": f}
                for h, i, f in zip(holder[frequent].tolist(), ids, total[frequent].tolist(), strict=True)]
        return pa.Table.from_pylist(out, _arrow(MERGED))

    return run


def frequent_phrases(docs: DataFrame, least: int, longest: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All phrases of up to ``longest`` words that occur at least ``least`` times in their language.

    Gives (lang, ids, f), the words (lang, id, word), and the number of words (lang, n).
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = 1 + size // WORD_BLOCK_BYTES
    counted = stored(shards(docs, blocks), "shards")
    totals = counted.filter("block IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    every = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    held = counted.filter("block IS NOT NULL").select("shard", "lang", "block", "at", "size", "words", "counts")
    found = stored(held.groupBy("block").applyInArrow(_merge_words(least, blocks), WORDS), "words")
    words = found.filter("f IS NOT NULL").select("lang", "word", "id", "f")
    largest = words.agg(F.coalesce(F.max("id"), F.lit(1))).first()[0]
    packing = Packing(largest.bit_length(), (every // PHRASE_BLOCK_WORDS).bit_length())
    phrases = [words.select("lang", F.array("id").alias("ids"), "f")]
    states = counted.filter("block IS NULL").select("shard", "lang", "codes", "ranks", "size")
    back = found.filter("frequent IS NOT NULL").select("shard", "at", "size", "frequent", "ids")
    advance = _pairs_of_words(packing, longest == 2)
    for n in range(2, longest + 1):
        counted = stored(states.groupBy("shard").cogroup(back.groupBy("shard")).applyInArrow(advance, COUNTED), f"counted-{n}")
        filters = counted.filter("block IS NOT NULL").select(
            "shard", "lang", "block", "at", "size", "occupied", "run_ends", "remainders", "counts")
        found = stored(filters.groupBy("block").applyInArrow(_merge_phrases(n, packing, least), MERGED), f"merged-{n}")
        phrases.append(found.filter("f IS NOT NULL").select("lang", "ids", "f"))
        states = counted.filter("block IS NULL").select("shard", "lang", "places", "pairs", "base", "n", "size")
        back = found.filter("frequent IS NOT NULL").select("shard", "at", "size", "frequent")
        advance = _next_level(packing, n + 1 == longest)
    return stored(reduce(DataFrame.unionByName, phrases), "phrases"), words.select("lang", "id", "word"), totals


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, share: int = 100, top: int = 2000) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words
    ``[^\\x20\\x09]+``; a null text has none, a null language is ``und``. Candidates are phrases of 2 to
    ``longest`` words that occur at least ``least`` times inside pieces, overlaps included. The score of a
    cut is floor(1000 * a * n / (l * r)), in decimals of 38 digits; the lowest one counts, of equal ones
    the cut after fewer words. A candidate goes if it lies inside a longer one with at least ``share``
    percent of its occurrences; as counts fall with length, the phrases one word longer decide that.
    Ties are ordered by a, then by the phrase's bytes. Copies of rows count as often as they stand there;
    texts without candidates and empty tables give no rows; further columns are ignored.
    """
    ready(docs.sparkSession)
    phrases, words, totals = frequent_phrases(docs, least, longest)
    candidates = phrases.filter(F.size("ids") > 1)
    cuts = candidates.withColumnRenamed("f", "a").withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)))
    cuts = cuts.withColumns({"left": F.slice("ids", F.lit(1), F.col("k")),
                             "right": F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k"))})
    cuts = cuts.join(phrases.select("lang", F.col("ids").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(phrases.select("lang", F.col("ids").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("(1000 * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0))) DIV (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))")
    scored = cuts.join(totals, "lang").withColumn("score", score)
    lowest = scored.groupBy("lang", "ids").agg(
        F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.array(F.slice("ids", F.lit(1), F.size("ids") - 1), F.slice("ids", F.lit(2), F.size("ids") - 1))
    inside = candidates.filter(F.size("ids") > 2).select("lang", F.explode(inner).alias("ids"), "f").groupBy(
        "lang", "ids").agg(F.max("f").alias("longer"))
    kept = lowest.join(inside, ["lang", "ids"], "left").filter(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    kept = kept.select("lang", "ids", "a", "cut.l", "cut.r", "n", "cut.score")
    # all that tie with the last are named before bytes decide
    near = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    kept = stored(kept.withColumn("rank", F.rank().over(near)).filter(F.col("rank") <= top).drop("rank"), "best")
    spelled = kept.select("lang", "ids", F.posexplode("ids").alias("k", "id")).join(words, ["lang", "id"])
    spelled = spelled.groupBy("lang", "ids").agg(F.concat_ws(" ", F.transform(
        F.array_sort(F.collect_list(F.struct("k", "word"))), lambda w: w["word"])).alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.join(spelled, ["lang", "ids"]).withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL for the rows of ``collocations`` over the table ``documents``.
COLLOCATION_SQL = """
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                      'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents
    ), listed AS (
        SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces
    ), totals AS (
        SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM listed GROUP BY lang
    ), phrases AS MATERIALIZED (
        SELECT lang, phrase, count(*) AS f FROM (
            SELECT lang, unnest(list_transform(range(1, len(words) - size + 2), lambda i: words[i : i + size - 1])) AS phrase
            FROM listed, range(1, 6) sizes(size) WHERE len(words) >= size
        ) GROUP BY lang, phrase HAVING count(*) >= 100
    ), cuts AS (
        SELECT p.lang, p.phrase, p.f AS a, k, x.f AS l, y.f AS r, n,
               CAST((1000::HUGEINT * p.f * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
        FROM phrases p, range(1, 5) cuts(k), phrases x, phrases y, totals t
        WHERE k < len(p.phrase) AND x.lang = p.lang AND y.lang = p.lang AND t.lang = p.lang
          AND x.phrase = p.phrase[1 : k] AND y.phrase = p.phrase[k + 1 :]
    ), scored AS (
        SELECT lang, phrase, a, n, min({'score': score, 'k': k, 'l': l, 'r': r}) AS cut FROM cuts GROUP BY lang, phrase, a, n
    ), inside AS (
        SELECT lang, phrase[i : i + size - 1] AS phrase, max(f) AS longer
        FROM phrases, range(2, 5) sizes(size), range(1, 5) starts(i)
        WHERE size < len(phrase) AND i + size - 1 <= len(phrase) GROUP BY 1, 2
    ), ranked AS (
        SELECT s.lang, array_to_string(s.phrase, ' ') AS phrase, a, cut.l AS l, cut.r AS r, n, cut.score AS score,
               row_number() OVER (PARTITION BY s.lang ORDER BY cut.score DESC, a DESC,
                                  encode(array_to_string(s.phrase, ' '))) AS rank
        FROM scored s LEFT JOIN inside i ON s.lang = i.lang AND s.phrase = i.phrase
        WHERE longer IS NULL OR 100 * longer < 100 * a
    )
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
