"""Scoring, search and classifiers: brute force, held-out accuracy, and odd rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyflow.llm import ann, langid, lm_score, toxicity
from tallyflow.llm.common import chunks, slices

SETTINGS = settings(max_examples=40, deadline=None)


def remainder(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w]


@SETTINGS
@given(st.lists(st.none() | st.text(st.sampled_from("ab \t\n\x0b\x1c é"), max_size=12), max_size=12))
def test_chunks_cut_at_ascii_blanks(texts):
    offsets, codes, words = chunks(pa.array(texts, pa.string()))
    found = [[words[c].as_py() for c in codes[a:b]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert found == [words_of(t) for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["i", "t"])
    assert [i for s in slices(batch, 1, 9) for i in s.column(0).to_pylist()] == list(range(len(texts)))


def brute_base(rows):
    counts = Counter()
    for doc_id, text in rows:
        if remainder(doc_id, 5) != 1:
            counts.update([*words_of(text), None])
    total, kinds = sum(counts.values()), len(counts)
    for doc_id, text in rows:
        tokens = [*words_of(text), None]
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in tokens)
        yield doc_id, remainder(doc_id, 5) == 1, len(tokens), sum(counts[t] > 0 for t in tokens), total, round(base, 6)


def test_language_model_base_equals_brute_force(odd_docs, no_docs, sample):
    docs = odd_docs.select("doc_id", "text").unionByName(sample("documents").select("doc_id", "text"))
    found = lm_score.scores(docs).collect()
    assert Counter((*tuple(r)[:5], round(r.base_score, 6)) for r in found) == Counter(
        brute_base([(r.doc_id, r.text) for r in docs.collect()]))
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)
    assert lm_score.scores(no_docs).count() == 0
    assert len(lm_score.scores(odd_docs).collect()) == odd_docs.count()


def test_language_model_without_learning_texts(odd_docs):
    only = [i for i in range(60) if remainder(i, 5) == 1]
    found = lm_score.scores(odd_docs.withColumn("doc_id", F.lit(only[0]).cast("long"))).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in found)


@SETTINGS
@given(st.lists(st.text(st.sampled_from("abc'!?12 é\u00a0\u3000ß"), min_size=1, max_size=8).map(lambda t: t.replace(" ", "x")), max_size=15))
def test_words_encode_together_as_apart(words):
    path = lm_score.public_tokenizers.path(lm_score.VOCABULARY)
    each = [lm_score.encoding(path).encode_ordinary(" " + w) for w in words]
    ids, lengths = lm_score.encode_words(words, path)
    assert ids.tolist() == [t for i in each for t in i] and lengths.tolist() == [len(i) for i in each]


def test_windows_score_each_place_once():
    """Windows cover every place, and only in the first of two that hold it."""
    sizes = [2, 3, 33, 34, 35, 57, 58, 59, 200]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    first, end, text = lm_score.cut(starts)
    seen = Counter()
    for i in range(len(first)):
        new = i == 0 or text[i] != text[i - 1]
        for k in range(0 if new else lm_score.OVERLAP, lm_score.WINDOW):
            if first[i] + k < end[i]:
                seen[first[i] + k] += 1
    assert seen == Counter(p for a, b in zip(starts[:-1], starts[1:], strict=True) for p in range(a, b - 1))


def test_attention_sees_no_future_and_chances_add_up():
    draw = np.random.default_rng(3)
    flat = lm_score.initial() + draw.standard_normal(len(lm_score.initial())).astype(np.float32) * 0.1
    p = lm_score.unpack(flat)
    prior = np.log(draw.dirichlet(np.ones(lm_score.NEXT), 20)).astype(np.float32)
    before = draw.integers(0, 20, (2, lm_score.WINDOW))
    hidden = lm_score.attend(p, before)[-1]
    other = before.copy()
    other[:, 20:] = 3
    assert np.allclose(hidden[:, :20], lm_score.attend(p, other)[-1][:, :20], atol=1e-5)
    every = [lm_score.log_chances(p, prior, before, hidden, np.full(before.shape, c))[0] for c in range(lm_score.NEXT)]
    assert np.allclose(np.exp(every).sum(0), 1, atol=1e-4)
    starting = lm_score.log_chances(p, prior, before, hidden, before)[1]
    assert np.allclose(np.exp(every[: lm_score.STARTS]).sum(0), np.exp(starting), atol=1e-4)


def test_places_that_are_context_only_change_no_state():
    """States after the first places of a window, asked alone, are those of the whole window, whose projections may be made before."""
    draw = np.random.default_rng(6)
    flat = lm_score.initial() + draw.standard_normal(len(lm_score.initial())).astype(np.float32) * 0.1
    p = lm_score.unpack(flat)
    context = draw.integers(0, 20, (3, lm_score.WINDOW))
    whole = lm_score.attend(p, context)[-1]
    for skip in (0, lm_score.OVERLAP):
        assert np.allclose(lm_score.attend(p, context, skip, lm_score.projections(p))[-1], whole[:, skip:], atol=1e-6)


def test_gradient_equals_differences():
    draw = np.random.default_rng(2)
    flat = (lm_score.initial() + draw.standard_normal(len(lm_score.initial())) * 0.2).astype(np.float64)
    prior = np.zeros((20, lm_score.NEXT))
    before = draw.integers(0, 20, (3, lm_score.WINDOW))
    target = draw.integers(0, lm_score.NEXT, before.shape)
    scored = draw.random(before.shape) < 0.8

    def loss(x):
        return lm_score.gradient(lm_score.unpack(x), prior, before, before, target, scored)[1]

    change, _ = lm_score.gradient(lm_score.unpack(flat), prior, before, before, target, scored)
    used = np.flatnonzero(np.abs(change) > 1e-3)
    for i in draw.choice(used, 12, replace=False):
        step = np.zeros_like(flat)
        step[i] = 1e-4
        assert (loss(flat + step) - loss(flat - step)) / 2e-4 == pytest.approx(change[i], rel=0.05, abs=1e-4)


def test_training_uses_each_window_once(monkeypatch):
    """Over all averages, and in small blocks too, every window of the learning texts is trained on once."""
    end_id = 6
    begins = np.array([True, True, False, False, False, False, True])
    classes = lm_score.Classes.of(np.array([9.0, 5, 4, 3, 2, 1, 4]), begins)
    prior = np.zeros((end_id + 1, lm_score.NEXT), np.float32)
    draw, used = np.random.default_rng(5), []
    cut_windows = lm_score._windows
    monkeypatch.setattr(lm_score, "_windows", lambda ids, first, end: used.extend(first.tolist()) or cut_windows(ids, first, end))
    for sizes in ([3], [40, 2, 0, 700], [5000]):
        learning = np.array([True] * len(sizes) + [False])
        total = sum(sizes) + 9
        row = {
            "block": 1, "learning": learning.tobytes(), "sizes": lm_score.pack_numbers(np.array([*sizes, 9]), "<i4"),
            "codes": lm_score.pack_numbers(draw.integers(0, 2, total), "<i4"),
            "pieces": lm_score.pack_numbers(np.array([0, 1, 2]), "<u2"), "lengths": lm_score.pack_numbers(np.array([1, 2]), "<i4"),
        }
        used.clear()
        seen = 0
        for turn in range(lm_score.AVERAGES):
            for batch in lm_score.train(end_id, classes, prior, lm_score.initial(), turn)(iter([pa.RecordBatch.from_pylist([row])])):
                seen += batch.column(2)[0].as_py()
        starts = lm_score.Streams.of(row, end_id, True).starts
        every, end, _ = lm_score.cut(starts, 0)
        assert sorted(used) == every.tolist() and seen == len(every)
        # end to end: each place to predict from lies in one window
        places = [p for a, b in zip(every.tolist(), end.tolist(), strict=True) for p in range(a, min(a + lm_score.WINDOW, b))]
        assert places == [p for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True) for p in range(a, b - 1)]


def test_rare_pairs_of_a_large_corpus_are_found(spark):
    """A pair seen once counts beside billions of others, in its block and in what its group leaves to ids not seen."""
    path = lm_score.public_tokenizers.path(lm_score.VOCABULARY)
    end_id = lm_score.encoding(path).max_token_value + 1
    counts = np.ones(end_id + 1)
    classes = lm_score.Classes.of(counts, lm_score.word_starts(path))
    starts, inner = np.flatnonzero(lm_score.word_starts(path))[:3], np.flatnonzero(~lm_score.word_starts(path))
    a, b, (x, y, z) = starts[0], starts[1], inner[classes.next[inner] == lm_score.NEXT - 1][:3]
    size = end_id + 1
    every = {int(a * size + x): 1, int(a * size + y): 5 * 10**9, int(b * size + x): 10**10, int(x * size + b): 3}
    pairs = spark.createDataFrame(list(every.items()), "pair long, n long")

    def row(block, words):
        return (block, b"\0" * len(words), *(lm_score.pack_numbers(np.array(v), kind) for v, kind in (
            ([1] * len(words), "<i4"), (range(len(words)), "<i4"), ([t for w in words for t in w], "<u2"), ([len(w) for w in words], "<i4"))))

    texts = spark.createDataFrame([row(1, [[a, x], [a, x, y], [a, z], [x], [b]]), row(2, [[b, x], [a, y]])],
                                  "block long, learning binary, sizes binary, codes binary, pieces binary, lengths binary")
    found = sorted(tuple(r) for r in lm_score.block_pairs(texts, pairs, end_id).collect())
    assert found == sorted([(1, int(a * size + x), 1), (2, int(b * size + x), 10**10), (2, int(a * size + y), 5 * 10**9)])
    model = lm_score.learn(texts, pairs, classes, np.zeros(lm_score.NEXT), np.zeros(lm_score.NEXT))
    logs = model.following.knowing(np.array([r[1] for r in found]), np.array([r[2] for r in found])).logs(
        np.array([a, a, b]), np.array([x, z, z]))
    share = classes.share[[x, z, z]]
    assert np.allclose(np.exp(logs), [(1 + 3 * share[0]) / (5 * 10**9 + 4), 3 * share[1] / (5 * 10**9 + 4), 2 * share[2] / (10**10 + 2)])


def test_model_chances_of_words_add_up():
    """Summed over all words of one or two ids the chances stay below one, and known words have most of them."""
    end_id, size = 6, 7
    begins = np.array([True, True, False, False, False, False, True])
    classes = lm_score.Classes.of(np.array([9.0, 5, 4, 3, 2, 1, 4]), begins)
    pairs = np.array([0 * size + 2, 0 * size + 3, 1 * size + 2])
    following = lm_score.Following.of(classes, pairs, np.array([3.0, 2, 4]))
    prior = lm_score.smoothed(np.zeros((size, lm_score.NEXT), np.float32), classes,
                              np.bincount(classes.next, weights=np.ones(size), minlength=lm_score.NEXT))
    words = [[a] for a in (0, 1)] + [[a, b] for a in (0, 1) for b in (2, 3, 4, 5)]
    counts = np.array([5.0, 0] + [2] + [0] * 7)
    mass, kinds = np.zeros(lm_score.NEXT), np.zeros(lm_score.NEXT)
    for w, c in zip(words, counts, strict=True):
        mass[classes.next[w[0]]] += c
        kinds[classes.next[w[0]]] += c > 0
    model = lm_score.Model(end_id, classes, following, prior, lm_score.initial(), mass, kinds)
    row = {
        "sizes": lm_score.pack_numbers(np.ones(len(words)), "<i4"), "codes": lm_score.pack_numbers(np.arange(len(words)), "<i4"),
        "pieces": lm_score.pack_numbers(np.array([t for w in words for t in w]), "<u2"),
        "lengths": lm_score.pack_numbers(np.array([len(w) for w in words]), "<i4"),
    }
    chances = 10 ** model.score(lm_score.Streams.of(row, end_id), counts)
    # every text is one word and the end; the end has one chance after any word, as the prior is flat
    end = np.exp(prior[0, classes.next[end_id]]) / np.exp(prior[0, : lm_score.STARTS]).sum()
    start = 1 - end
    assert 0.6 < chances.sum() / end / start <= 1 + 1e-6


@SETTINGS
@given(st.integers(1, 120), st.integers(0, 3))
def test_graph_search_equals_brute_force_on_small_shards(n, seed):
    draw = np.random.default_rng(seed)
    vectors, queries = draw.standard_normal((n, 8)), draw.standard_normal((5, 8))
    found = ann.search(ann.build(vectors), vectors, queries, min(5, n), beam=200)
    expected = np.argsort(ann.squared(queries, vectors), axis=1, kind="stable")[:, : min(5, n)]
    assert np.mean([len(set(a) & set(b)) / len(b) for a, b in zip(found, expected, strict=True)]) >= 0.95


@pytest.mark.parametrize(("clusters", "spread"), [(1, 1.0), (60, 0.05), (100, 0.05), (800, 0.05), (100, 0.3)])
def test_recall_on_a_full_shard(clusters, spread):
    """A shard of the production size, even and clustered: queries beside the stored vectors."""
    draw = np.random.default_rng(clusters)
    centres = draw.standard_normal((clusters, 64))
    vectors = centres[draw.integers(0, clusters, ann.SHARD_ROWS)] + spread * draw.standard_normal((ann.SHARD_ROWS, 64))
    queries = centres[draw.integers(0, clusters, 100)] + spread * draw.standard_normal((100, 64))
    found = ann.search(ann.build(vectors), vectors, queries, 10)
    expected = np.argsort(ann.squared(queries, vectors), axis=1, kind="stable")[:, :10]
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found.tolist(), expected.tolist(), strict=True)])
    assert recall >= (0.9 if clusters == 1 else 0.95), recall


def test_recall_over_several_shards(spark):
    """Clustered vectors dealt to four shards, through the whole operator."""
    draw = np.random.default_rng(3)
    centres = draw.standard_normal((40, 32))
    vectors = centres[draw.integers(0, 40, 4000)] + 0.05 * draw.standard_normal((4000, 32))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    found = {(r.query_id, r.vec_id) for r in ann.nearest(df, 100, 10, shard_rows=1000).collect()}
    queries = np.arange(0, 4000, 100)
    gaps = ann.squared(vectors[queries], vectors)
    gaps[np.arange(len(queries)), queries] = np.inf
    expected = {(int(q), int(i)) for q, near in zip(queries, np.argsort(gaps, axis=1)[:, :10], strict=True) for i in near}
    assert len(found & expected) >= 0.95 * len(expected)


def brute_nearest(rows, every, k):
    points = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            points[i] = min(points.get(i, v), v)
    size = Counter(map(len, points.values())).most_common(1)[0][0]
    points = {i: v for i, v in points.items() if len(v) == size}
    for q in points:
        if q % every == 0:
            ranked = sorted((math.dist(points[q], v), i) for i, v in points.items() if i != q)[:k]
            yield from ((q, rank + 1, i, round(d, 9)) for rank, (d, i) in enumerate(ranked))


def test_nearest_of_odd_vectors(spark):
    draw = np.random.default_rng(9)
    rows = [(i, draw.standard_normal(4).astype(np.float32).tolist()) for i in range(60)]
    rows += [(i, [1.0, 0.0, 0.0, 0.5]) for i in range(100, 140)]
    rows += [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, None, 0.0, 0.0]), (204, [1.0, float("nan"), 0.0, 0.0]),
             (205, [float("inf"), 0.0, 0.0, 0.0]), (206, [1.0, 2.0]), (None, [1.0] * 4), rows[0], (3, [9.0] * 4)]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "vec_id long, embedding array<float>, vector string, shard int")
    df = df.repartition(3)
    found = [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in ann.nearest(df, 10, 5, shard_rows=20).collect()]
    assert sorted(found) == sorted(brute_nearest(rows, 10, 5))
    assert ann.nearest(df.filter("1 = 0")).count() == 0
    assert ann.nearest(df.filter("vec_id = 10"), 10).count() == 0


def test_recall(sample):
    df = sample("embeddings")
    rows = [(r.vec_id, list(r.embedding)) for r in df.select("vec_id", "embedding").collect()]
    found = {(r.query_id, r.vec_id) for r in ann.nearest(df, 10).collect()}
    expected = {(q, i) for q, _, i, _ in brute_nearest(rows, 10, 10)}
    assert len(found & expected) >= 0.95 * len(expected)


@SETTINGS
@given(st.sets(st.integers(0, 2**63 - 1), max_size=60), st.sampled_from([1, 5, 8, 20, 64, 65, 200]))
def test_filters_return_every_language_that_has_a_trigram(grams, languages):
    grams = np.array(sorted(grams), np.uint64)
    has = np.random.default_rng(len(grams)).random((len(grams), languages)) < 0.3
    which, own = np.nonzero(has)
    model = langid.LanguageFilter.of([str(i) for i in range(languages)], grams[which], own)
    found = model.lookup(grams)
    for i in range(languages):
        assert (model.has(found, i).astype(bool) >= has[:, i]).all()


def plain_languages(docs, texts):
    """Predictions by plain trigram sets: the share of a text's trigrams that each language has."""
    def grams(text):
        out = Counter()
        for word in re.split("[ \t\n-\r]+", text.lower()):
            shown = " " + "".join(c if c.isalpha() else " " for c in word) + " "
            out.update(shown[i - 1 : i + 2] for i in range(1, len(shown) - 1) if shown[i].isalpha())
        return out

    counts = defaultdict(Counter)
    for lang, text in docs:
        if lang is not None and text is not None:
            counts[lang] += grams(text)
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    typical = {lang: {g for g, s in own.items() if counts[lang][g] >= 2 and s >= 0.2 * max(o.get(g, 0) for o in share.values())}
               for lang, own in share.items()}
    out = []
    for text in texts:
        own = grams(text or "")
        total = sum(own.values())
        scores = {lang: sum(n for g, n in own.items() if g in t) / total for lang, t in sorted(typical.items())} if total else {}
        out.append(scores)
    return out


def test_languages_equal_plain_sets(sample):
    """All predictions against exact sets: the filter's false hits are few and corrected."""
    docs = sample("documents").collect()
    found = {r.doc_id: r for r in langid.identify(sample("documents")).collect()}
    plain = plain_languages([(r.lang, r.text) for r in docs if remainder(r.doc_id, 3) != 1], [r.text for r in docs])
    for r, scores in zip(docs, plain, strict=True):
        own = found[r.doc_id]
        if not scores:
            assert (own.lang_pred, own.score) == ("und", 0)
        else:
            best = max(scores.values())
            assert scores[own.lang_pred] >= best - 0.02 and abs(own.score - best) < 0.02


def made_up(spark, languages, words, letters, seed):
    """Texts of languages that use their own letters."""
    pick = np.random.default_rng(seed)
    rows = []
    for k in range(languages):
        own = pick.choice(letters, 8 if languages > 1 else len(letters), replace=False)
        rows += [(len(rows) + j, " ".join("".join(map(chr, pick.choice(own, 5))) for _ in range(words)), f"l{k:03d}") for j in range(6)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_a_hundred_languages(spark):
    docs = made_up(spark, 100, 60, np.arange(0x3041, 0x30fa), 4)
    found = {r.doc_id: r for r in langid.identify(docs).collect()}
    held = [(found[r.doc_id].lang_pred, r.lang) for r in docs.collect() if found[r.doc_id].held_out]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.9


def test_names_beyond_the_most_frequent_are_not_learned(spark):
    docs = made_up(spark, 5, 20, np.arange(0x3041, 0x30fa), 5)
    rare = docs.filter("lang <> 'l004' OR doc_id % 6 = 0")
    model = langid.learn(rare, most_languages=4)
    assert model.languages == ["l000", "l001", "l002", "l003"]


@pytest.mark.parametrize("words", [100, 3000])
def test_flat_scripts_are_kept_at_every_size(spark, words):
    """A script of many signs without frequent trigrams: its clean texts stay, whatever the size of the corpus."""
    pick = np.random.default_rng(6)
    signs = np.arange(0x4e00, 0x4e00 + 1500)
    phrases = ["".join(map(chr, pick.choice(signs, 12))) for _ in range(2 * words)]
    rows = [(i, " ".join(pick.choice(phrases, words // 10)), "zh") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.keep_identified(docs).count() >= 0.95 * len(rows)


def test_languages_held_out(sample):
    docs = sample("documents")
    found = {r.doc_id: r for r in langid.identify(docs).collect()}
    held = [r for r in docs.collect() if found[r.doc_id].held_out]
    assert all(found[r.doc_id].held_out == (remainder(r.doc_id, 3) == 1) for r in docs.select("doc_id").collect())
    assert np.mean([found[r.doc_id].lang_pred == r.lang for r in held]) > 0.95
    assert langid.keep_identified(docs).count() >= 0.99 * docs.count()


def test_languages_of_odd_rows(odd_docs, no_docs):
    found = langid.identify(odd_docs).collect()
    texts = [r.text for r in odd_docs.select("text").collect()]
    lettered = sum(any(c.isalpha() for c in t or "") for t in texts)
    assert Counter(r.lang_pred for r in found) == {"en": lettered, "und": len(texts) - lettered}
    assert all(0 <= r.score <= 1 for r in found)
    assert langid.identify(no_docs).count() == 0
    unknown = langid.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unknown} == {"und"}
    kept = langid.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns
    assert 0 < kept.count() <= lettered


def brute_kernel(a, b):
    def signature(word):
        out = Counter()
        signs = [toxicity.sign(c) for c in word]
        for i in range(len(signs)):
            for j in range(i + 1, len(signs)):
                for k in range(j + 1, min(len(signs), i + toxicity.SPAN)):
                    out[signs[i], signs[j], signs[k]] += toxicity.DECAY ** (k - i + 1)
        return out
    x, y = signature(a), signature(b)
    own = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y[k] for k, v in x.items()) / own if own else 0.0


WORD = st.text(st.sampled_from("abcdeéß"), min_size=1, max_size=toxicity.WIDTH)


@SETTINGS
@given(st.lists(WORD, min_size=1, max_size=6), st.lists(WORD, min_size=1, max_size=4))
def test_kernel_equals_brute_force(words, others):
    found = toxicity.kernel(words, others)
    assert np.allclose(found, [[brute_kernel(a, b) for b in others] for a in words], atol=1e-4)


def made_texts(draw, n, insult):
    clean = ["the", "house", "river", "garden", "walked", "quiet", "morning", "stone", "window", "bread", "simple", "light"]
    out = []
    for _ in range(n):
        words = draw.choice(clean, 12).tolist()
        if insult:
            words[draw.integers(12)] = draw.choice(["blockhead", "nitwit", "scoundrel"])
        out.append(" ".join(words))
    return out


def test_toxicity_tolerates_gaps_and_inserted_signs():
    draw = np.random.default_rng(1)
    model = toxicity.fit(made_texts(draw, 120, False) + made_texts(draw, 120, True), [0] * 120 + [1] * 120)
    texts = ["you nitwit", "you n.i.t.w.i.t", "you nitxwit", "you n1tw!t", "you n i t w i t !", "a scound-rel", "a scoundzrel",
             "", None, "the quiet garden", "bread and stone", "1234 --"]
    found = toxicity._scores(model, {}, pa.array(texts, pa.string()))
    assert (found[:7] >= 0.5).all() and (found[7:] < 0.5).all() and ((found >= 0) & (found <= 1)).all()


def test_toxicity_learns_from_the_end_of_long_texts(spark):
    draw = np.random.default_rng(4)
    ids = [i for i in range(120) if remainder(i, 5) != 0]
    padding = " ".join(made_texts(draw, 300, False))
    rows = [(i, f"{padding} {text}", i % 2) for i in ids for text in made_texts(draw, 1, i % 2 == 1)]
    new = [(1000, "you nitwit", 0), (1001, "the quiet garden", 0)]
    assert min(r[1].find(w) for r in rows for w in ("blockhead", "nitwit", "scoundrel") if w in r[1]) > 20_000
    df = spark.createDataFrame(rows + new, "doc_id long, text string, toxic int")
    found = toxicity.toxicity(df.select("doc_id", "text"), df.filter("doc_id < 1000").select("doc_id", "toxic")).collect()
    assert {r.doc_id: r.predicted for r in found} == {r[0]: r[2] for r in rows} | {1000: 1, 1001: 0}


def test_toxicity_held_out(sample):
    docs, labels = sample("documents"), sample("labels")
    found = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) and r.predicted == (r.score >= 0.5) for r in found.values())
    known = [(found[r.doc_id].predicted, r.toxic) for r in labels.collect() if r.doc_id in found]
    assert np.mean([p == t for p, t in known]) > 0.9
    assert toxicity.keep_civil(docs, labels).count() == sum(not r.predicted for r in found.values())


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (9, 0, 0), (None, 1, 0)], "doc_id long, toxic int, text int")
    for own in (labels, labels.filter("1 = 0"), labels.withColumn("toxic", F.lit(1))):
        found = toxicity.toxicity(odd_docs, own).collect()
        assert len(found) == odd_docs.count() and all(0 <= r.score <= 1 for r in found)
        assert toxicity.toxicity(no_docs, own).count() == 0
    assert toxicity.keep_civil(odd_docs, labels.filter("1 = 0")).columns == odd_docs.columns


def test_language_model_in_powers_of_two_and_by_words():
    """A prior in powers of two gives the chances and gradients of the same prior in natural logs; ids counted by words are those in texts."""
    draw = np.random.default_rng(8)
    p = lm_score.unpack(lm_score.initial() + draw.standard_normal(len(lm_score.initial())).astype(np.float32) * 0.1)
    prior = np.log(draw.dirichlet(np.ones(lm_score.NEXT), 20)).astype(np.float32)
    before = draw.integers(0, 20, (3, lm_score.WINDOW))
    target, scored = draw.integers(0, lm_score.NEXT, before.shape), draw.random(before.shape) < 0.8
    twos = prior * np.float32(lm_score.LOG2E)
    hidden = lm_score.attend(p, before)[-1]
    for a, b in zip(lm_score.log_chances(p, prior, before, hidden, target),
                    lm_score.log_chances(p, twos, before, hidden, target, twos=True), strict=True):
        assert np.allclose(a, b, atol=1e-5)
    (a, loss), (b, same) = (lm_score.gradient(p, table, before, before, target, scored, twos=t) for table, t in ((prior, False), (twos, True)))
    assert np.allclose(a, b, atol=1e-6) and math.isclose(loss, same, rel_tol=1e-5)
    # what is not scored weighs nothing
    other = np.where(scored, target, (target + 1) % lm_score.NEXT)
    assert np.allclose(lm_score.gradient(p, prior, before, before, other, scored)[0], a, atol=1e-6)
    row = {"learning": np.array([True, False, True, True]).tobytes()} | {
        name: lm_score.pack_numbers(np.array(values), kind) for name, values, kind in (
            ("sizes", [2, 1, 0, 3], "<i4"), ("codes", [0, 1, 2, 1, 1, 0], "<i4"), ("pieces", [4, 0, 4, 2], "<u2"), ("lengths", [1, 2, 1], "<i4"))}
    [found] = lm_score.count_ids(6)(iter([pa.RecordBatch.from_pylist([row])]))
    stream = lm_score.Streams.of(row, 6, True)
    assert dict(zip(*(c.to_pylist() for c in found.columns), strict=True)) == Counter(stream.ids[stream.inside].tolist()) | {6: 3}
