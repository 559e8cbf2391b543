import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from checks.compare import difference, oracle_connection
from tallyflow.llm import phrase_filter
from tallyflow.llm.centroids import assign, cluster
from tallyflow.llm.collocations import Packing, collocations, frequent_phrases, shards, spread, squeezed
from tallyflow.llm.queries import LLM_ORACLE, LLM_QUERIES
from tallyflow.llm.token_count import LONG_PIECE, PieceCounts, token_counts

SETTINGS = settings(max_examples=60, deadline=None)
PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTS = PieceCounts(PATH)

# names that the operators use inside
CLASHING = ["sums", "rows", "distance", "inertia", "name", "cluster", "v", "x"]

# ---------------------------------------------------------------- token counts

SIGNS = ["a", "b", "e", "the", " of", " ", "  ", "\n", "\r\n", "\t", "'s", "'", "’", "é", "ß", "1", "²",
         "½", "中", "文", "。", " ", "\u0085", " ", "　", "\x1c", "\x00", "<|endoftext|>",
         "<|endoftext", "!", "…", "—", "€", "\U0001f600", "́", "ا", "Ω", "д", "​",
         " ", "ﬁ", "\U00031350"]


def library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@SETTINGS
@given(st.lists(st.sampled_from(SIGNS) | st.characters(codec="utf-8"), max_size=30).map("".join))
def test_counts_are_the_librarys(text):
    assert COUNTS.tokens(text) == library(text)


@pytest.mark.parametrize("text", [
    "a" * 40_000, "ab" * 20_000, " " * 30_000, "".join(random.Random(1).choices("acgt", k=50_000)),
    "x" + "<|endoftext|>" * 3 + " y", "".join(random.Random(2).choices("abcdefghijklmnopqrstuvwxyzé", k=LONG_PIECE)),
])
def test_long_pieces_and_special_names(text):
    assert COUNTS.tokens(text) == library(text)


@SETTINGS
@given(st.text("abcdeths", min_size=1, max_size=200))
def test_both_forms_of_merging_agree(piece):
    assert COUNTS.merged(piece.encode()) == COUNTS.merged_long(piece.encode())


def test_long_texts_are_cut_where_pieces_end(monkeypatch):
    monkeypatch.setattr("tallyflow.llm.token_count.SEGMENT", 50)
    text = " ".join(random.Random(3).choices(["don't", "I'll", "naïve,", "x", "中文。中", "12th", "(a)", "\n\n"], k=4000))
    assert PieceCounts(PATH).tokens(text) == library(text)


def test_token_counts_of_odd_rows(odd_docs, no_docs, rows):
    found = rows(token_counts(odd_docs, limit=9))
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    expected = [(i, len((t or "").encode()), library(t), library(t) > 9) for i, t in docs]
    assert found == sorted(expected, key=lambda r: tuple((v is not None, str(v)) for v in r))
    assert token_counts(no_docs).collect() == []


def test_token_counts_of_the_sample(spark, sample):
    found = {r.doc_id: r for r in LLM_QUERIES["op11_token_counts"](spark, "/root/testdata/sf0.001").collect()}
    docs = sample("documents").collect()
    assert len(found) == len(docs)
    for d in docs:
        r = found[d.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((d.text or "").encode()), library(d.text), library(d.text) > 512)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        PieceCounts(public_tokenizers.path("word_bpe_49k.json"))


# ---------------------------------------------------------------- collocations


@SETTINGS
@given(st.integers(2, 5), st.sampled_from([1, 2, 5, 13, 18, 21, 22, 32, 33]), st.integers(0, 6), st.data())
def test_phrase_filters_lose_nothing(n, width, blocks, data):
    """Phrases of several filters come back with their summed counts, whatever the permutation did."""
    ids = data.draw(st.lists(st.integers(0, 2**width - 1), min_size=5, max_size=60))
    bits, first = Packing(width, blocks).of(n)
    lane_count = phrase_filter.lanes_of(n, width)
    ids += ids[:5]  # some phrases repeat
    grams = [tuple(ids[i : i + n]) for i in range(len(ids) - n + 1)]
    parts = data.draw(st.integers(1, 3))
    blocks = defaultdict(list)
    for p in range(parts):
        own = Counter(grams[p::parts])
        if not own:
            continue
        table = np.array(list(own), np.int64)
        lanes, counts = phrase_filter.pack(table, width), np.array(list(own.values()), np.int64)
        order = phrase_filter.in_order(lanes)
        lanes, counts = lanes[order], counts[order]
        block = phrase_filter.block_of(lanes, bits, first)
        assert (np.diff(block) >= 0).all()
        for b in set(block.tolist()):
            here = block == b
            coded = phrase_filter.encode(lanes[here], counts[here], bits, first)
            blocks[b].append(phrase_filter.decode(b, **coded, bits=bits, first=first, lanes=lane_count, size=int(here.sum())))
    found = Counter()
    for filters in blocks.values():
        lanes, counts, place = phrase_filter.merged([f[0] for f in filters], [f[1] for f in filters])
        assert (lanes[place] == np.concatenate([f[0] for f in filters])).all()
        found.update(dict(zip(map(tuple, phrase_filter.unpack(lanes, n, width).tolist()), counts.tolist(), strict=True)))
    assert found == Counter(grams)


@SETTINGS
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=20), st.integers(1, 64))
def test_the_permutation_is_invertible(values, bits):
    x = np.array(values, np.uint64) & np.uint64((1 << bits) - 1)
    assert (phrase_filter.unmix(phrase_filter.mix(x, bits), bits) == x).all()
    assert (phrase_filter.mix(x, bits) >> np.uint64(bits - 1) <= 1).all()


def phrase_counts(docs):
    """All phrases of up to five words by language, and the words of each language."""
    counts, n = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, 6):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return counts, n


def brute_collocations(docs, least, top):
    counts, n = phrase_counts(docs)
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            inside = any(a == b and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
                         for q, b in candidates.items())
            if not inside:
                s, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def random_docs(seed, count, words):
    pick = random.Random(seed)
    out = []
    for i in range(count):
        run = pick.choices(words, k=pick.randint(0, 40))
        text = "".join(w + pick.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " "]) for w in run)
        out.append((i, text, pick.choice(["en", "de", None])))
    return out


@pytest.mark.parametrize(("least", "top", "block"), [(3, 2000, 1 << 19), (2, 7, 16), (5, 50, 200)])
def test_collocations_equal_brute_force(spark, rows, monkeypatch, least, top, block):
    monkeypatch.setattr("tallyflow.llm.collocations.PHRASE_BLOCK_WORDS", block)
    monkeypatch.setattr("tallyflow.llm.collocations.WORD_BLOCK_BYTES", 8 * block)
    words = ["The", "the", "cat", "sat", "on", "mat", "Äpfel", "New", "York", "a!b", "it's"]
    docs = random_docs(least, 120, words) + [(500 + i, "hot copy of a New York minute, and more", "en") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    found = [tuple(r) for r in collocations(df, least=least, top=top).collect()]
    assert sorted(found) == brute_collocations([(d[2], d[1]) for d in docs], least, top)


def test_frequent_phrases_over_small_shards(spark, monkeypatch):
    """Shards of a few pieces each give the counts of the whole."""
    docs = random_docs(9, 80, ["x", "y", "z", "longer"])
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    monkeypatch.setattr("tallyflow.llm.collocations.shards", lambda d, blocks: shards(d, blocks, size=64, held=200))
    monkeypatch.setattr("tallyflow.llm.collocations.PHRASE_BLOCK_WORDS", 64)
    monkeypatch.setattr("tallyflow.llm.collocations.WORD_BLOCK_BYTES", 500)
    phrases, words, totals = frequent_phrases(df, 4)
    names = {(r.lang, r.id): r.word for r in words.collect()}
    found = {(r.lang, tuple(names[r.lang, i] for i in r.ids)): r.f for r in phrases.collect()}
    counts, n = phrase_counts([(d[2], d[1]) for d in docs])
    assert found == {(lang, p): f for lang, c in counts.items() for p, f in c.items() if f >= 4}
    assert {r.lang: r.n for r in totals.collect()} == dict(n)


def test_large_products_are_exact(spark):
    """Scores whose products pass 64 bits."""
    df = spark.createDataFrame([(3_000_000_000, 9_000_000_000_000, 3_000_000_001, 3_000_000_007)], "a long, n long, l long, r long")
    found = df.select(F.expr("(1000 * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0))) DIV "
                             "(CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))")).first()[0]
    assert found == 1000 * 3_000_000_000 * 9_000_000_000_000 // (3_000_000_001 * 3_000_000_007)


def test_collocations_of_odd_rows(odd_docs, no_docs):
    found = [tuple(r) for r in collocations(odd_docs, least=2).collect()]
    docs = [(r.lang, r.text) for r in odd_docs.collect()]
    assert sorted(found) == brute_collocations(docs, 2, 2000)
    assert collocations(no_docs, least=1).collect() == []
    assert collocations(odd_docs.withColumn("text", F.lit(None).cast("string")), least=1).collect() == []


@SETTINGS
@given(st.lists(st.integers(0, 2**40), max_size=50))
def test_squeezed_numbers_come_back(values):
    assert spread(squeezed(np.array(values, np.int64))).tolist() == values


# ---------------------------------------------------------------- centroids


def brute_assign(vectors, centroids):
    distances = ((vectors[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    return distances.argmin(1), distances.min(1)


@SETTINGS
@given(st.integers(1, 20), st.integers(1, 6), st.integers(1, 40), st.sampled_from([2, 50, 1 << 27]), st.integers(0, 10**6))
def test_the_walk_finds_the_nearest(k, dimensions, n, spread, seed):
    pick = np.random.default_rng(seed)
    vectors = pick.integers(-spread, spread + 1, (n, dimensions))
    centroids = pick.integers(-spread, spread + 1, (k, dimensions))
    centroids[k // 2] = centroids[0]  # a tie
    found = assign(vectors, centroids)
    expected = brute_assign(vectors, centroids)
    assert (found[0] == expected[0]).all() and (found[1] == expected[1]).all()


def brute_cluster(rows, clusters, rounds, dimensions):
    kept = [(i, [int(np.floor(64 * np.float64(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=name)[:clusters]]
    vectors = np.array([v for _, v in kept], np.int64)
    for _ in range(rounds):
        found, _ = brute_assign(vectors, np.array(centroids))
        centroids = [[sum(c) // len(own) for c in zip(*own, strict=True)] if (own := vectors[found == k].tolist()) else old
                     for k, old in enumerate(centroids)]
    found, distance = brute_assign(vectors, np.array(centroids))
    own = Counter()
    for k, d in zip(found.tolist(), distance.tolist(), strict=True):
        own[k] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, k, d, own[k], sum(own.values()), sha[k])
            for (i, _), k, d in zip(kept, found.tolist(), distance.tolist(), strict=True)]


@pytest.mark.parametrize(("count", "clusters"), [(300, 16), (9, 16), (60, 3)])
def test_clusters_equal_brute_force(spark, rows, count, clusters):
    pick = np.random.default_rng(count)
    data = [(i, pick.normal(0, 1, 8).round(2).tolist()) for i in range(count)]
    data += [(None, data[0][1]), (0, data[0][1]), (1, data[1][1])]  # no id, a repeated row
    data += [(1000, None), (1001, []), (1002, [1.0] * 7), (1003, [None] + [1.0] * 7), (1004, [float("nan")] * 8),
             (1005, [float("inf")] + [0.0] * 7), (1006, [-0.0, 0.004, -0.004, 1e-300, 0.0, 0.0, 0.0, 0.0])]
    extra = ", ".join(f"{c} int" for c in CLASHING)
    df = spark.createDataFrame([(*r, *range(len(CLASHING))) for r in data],
                               f"vec_id long, embedding array<double>, {extra}").repartition(3)
    found = rows(cluster(df, clusters=clusters, dimensions=8))
    expected = brute_cluster(data, clusters, 3, 8)
    assert found == sorted(expected, key=lambda r: tuple((v is not None, str(v)) for v in r))


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    found = cluster(df)
    assert found.collect() == []
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_distances_beyond_a_long_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="do not fit a long"):
        cluster(df).collect()


@pytest.mark.parametrize("name", ["op12_collocations", "op13_centroids"])
def test_query_equals_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    assert difference(LLM_QUERIES[name](spark, folder), oracle_connection(folder), LLM_ORACLE[name]) == ""


def test_digits_of_the_vocabulary_file():
    """The ranks that the counts use are the file's, the first of equal pairs."""
    merges = json.load(open(PATH, encoding="utf-8"))["model"]["merges"]
    assert len(COUNTS.rank) == len({tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges})
