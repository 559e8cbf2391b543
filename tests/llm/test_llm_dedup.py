import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyflow.llm import quotient, simhash
from tallyflow.llm.exact_dedup import exact_classes, exact_dedup

SETTINGS = settings(max_examples=40, deadline=None)


@SETTINGS
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 40), max_size=200), st.integers(1, 5))
def test_filters_merge_without_loss(values, parts):
    """Filters of parts, block by block, hold what a count of everything holds."""
    expected = defaultdict(int)
    merged = defaultdict(list)
    for k in range(parts):
        part = np.array(values[k::parts], np.uint64)
        seen, counts = quotient.summed(part, np.ones(len(part), np.int64))
        for block in set(quotient.block_of(seen).tolist()):
            own = quotient.block_of(seen) == block
            merged[block].append(quotient.decode(block, **quotient.encode(seen[own], counts[own])))
    for v in values:
        expected[v] += 1
    found = {}
    for filters in merged.values():
        seen, counts = quotient.summed(np.concatenate([f[0] for f in filters]), np.concatenate([f[1] for f in filters]))
        found |= dict(zip(seen.tolist(), counts.tolist(), strict=True))
    assert found == dict(expected)


def brute_classes(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for doc_id, text in rows:
        ids = [i for i in groups[text or ""] if i is not None]
        keep = max(ids) if ids else None
        sha = hashlib.sha256((text or "").encode()).hexdigest()
        out.append((doc_id, keep, len(groups[text or ""]), doc_id == keep, sha))
    return out


def order(rows):
    return sorted(rows, key=str)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("hashed", [None, "7", "length(text)"])
def test_exact_classes_of_odd_rows(odd_docs, hashed):
    """Also where different texts share a fingerprint: bytes decide."""
    found = [tuple(r) for r in exact_classes(odd_docs, hashed and F.expr(hashed)).collect()]
    assert order(found) == order(brute_classes(pairs(odd_docs)))


def test_exact_dedup_keeps_one_of_each_text(odd_docs):
    kept = exact_dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [t or "" for _, t in pairs(kept)]
    assert len(texts) == len(set(texts)) and set(texts) == {t or "" for _, t in pairs(odd_docs)}
    assert max(i for i, t in pairs(kept) if t and t.startswith("word")) == 6


def test_nothing_gives_nothing(no_docs):
    assert exact_classes(no_docs).count() == 0
    assert exact_dedup(no_docs).count() == 0
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.keep_one(no_docs).count() == 0


def brute_fingerprint(text, shingle=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w]
    if not words:
        return 0
    pieces = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=4):
    prints = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = defaultdict(list)
    for g, (doc_id, _) in zip(group, rows, strict=True):
        least[g] += [doc_id] * (doc_id is not None)
    return [(d, f"{p:016x}", min(least[g], default=None)) for (d, _), p, g in zip(rows, prints, group, strict=True)]


def test_near_duplicates_equal_brute_force(odd_docs, sample):
    docs = odd_docs.select("doc_id", "text").unionByName(
        sample("documents").select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    found = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert order(found) == order(brute_components(pairs(docs)))


def test_near_duplicates_ignore_further_columns(odd_docs):
    found = [tuple(r) for r in simhash.near_duplicates(odd_docs).collect()]
    assert order(found) == order(brute_components(pairs(odd_docs)))
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    components = {c for _, _, c in found}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == components


@pytest.mark.parametrize("radius", [2, 3, 4])
def test_masks_hide_every_set_of_bits(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    draw = np.random.default_rng(radius)
    for _ in range(3000):
        bits = sum(1 << int(b) for b in draw.choice(64, radius, replace=False))
        assert any(m & bits == 0 for m in masks)


@pytest.mark.parametrize("compared", [10_000, 3])
def test_links_of_crowded_buckets(spark, compared):
    """A ball of many fingerprints near each other, compared or spread over their neighbours."""
    draw = np.random.default_rng(5)
    centre = int(draw.integers(0, 2**62))
    values = sorted({centre ^ sum(1 << int(b) for b in draw.choice(64, 5, replace=False)) for _ in range(60)})
    values = [simhash.signed(v) for v in values]
    df = spark.createDataFrame([(v,) for v in values], "value long")
    found = simhash.components(simhash.links(df, 4, compared)).collect()
    roots = dict.fromkeys(values) | {r["node"]: r["root"] for r in found}
    array = np.array(values, np.int64)
    near = np.bitwise_count(array.view(np.uint64)[:, None] ^ array.view(np.uint64)[None, :]) <= 4
    expected = simhash.spanning(len(values), *np.nonzero(np.triu(near, 1)))
    assert [roots[v] if roots[v] is not None else v for v in values] == array[expected].tolist()


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    df = spark.createDataFrame(chain + star, "low long, high long")
    found = {r["node"]: r["root"] for r in simhash.components(df).collect()}
    assert found == dict.fromkeys(range(1, 41), 0) | dict.fromkeys(range(101, 160), 100)
