"""Sharding, packing, encoding and archives."""

import bisect
import gzip
import hashlib
import os
import struct
import zlib
from collections import Counter, defaultdict, deque

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyflow.llm import bpe, packing, sharding, warc

SETTINGS = settings(max_examples=60, deadline=None)
PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@SETTINGS
@given(st.lists(st.integers(0, 9), min_size=12, max_size=12), st.integers(0, 5))
def test_walk_places_every_row_within_bounds(counts, seed):
    owners = np.random.default_rng(seed).integers(0, 4, 12).tolist()
    owners[:4] = range(4)
    placed = sharding.walk(counts, owners, 4)
    ranks, slots = defaultdict(set), defaultdict(set)
    for arc, first, last, shard, slot in placed:
        for k in range(last - first + 1):
            assert first + k not in ranks[arc] and slot + k not in slots[shard]
            ranks[arc].add(first + k)
            slots[shard].add(slot + k)
    assert all(ranks[a] == set(range(1, n + 1)) for a, n in enumerate(counts))
    sizes = [len(slots[s]) for s in range(4)]
    assert max(sizes) - min(sizes) <= 1 and all(slots[s] == set(range(sizes[s])) for s in range(4))


def test_arcs_follow_the_ring(spark):
    points = sharding.ring_points(5, 20)
    starts = [p for p, _ in points]
    values = [-(2**63), 2**63 - 1, 0, -1, *starts, *[s + 1 for s in starts], *[s - 1 for s in starts]]
    df = spark.createDataFrame([(v,) for v in values], "p long")
    found = {r.p: r.arc for r in df.select("p", sharding.arc_of(F.col("p"), points).alias("arc")).collect()}
    assert found == {v: next((i for i, s in enumerate(starts) if s >= v), 0) for v in values}


def test_shards_of_odd_rows(odd_docs, no_docs):
    found = sharding.shard_rows(odd_docs, 5).collect()
    texts = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    expected = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == expected
    sizes = Counter(r.shard for r in found)
    assert max(sizes.values()) - min(sizes[s] for s in range(5)) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(n))
    assert all(r.moved == (r.shard != r.home_shard) and r.grown_shard is None for r in found)
    assert sharding.shard_rows(no_docs).count() == 0


def simulated_ring(positions, shards, nodes):
    """Counter of (home shard, shard) when single rows walk the ring: home while there is room, then clockwise, oldest first."""
    points = sharding.ring_points(shards, nodes)
    starts, owners = [p for p, _ in points], [s for _, s in points]
    room = [len(positions) // shards + (s < len(positions) % shards) for s in range(shards)]
    found, over = Counter(), defaultdict(int)
    for arc in sorted(bisect.bisect_left(starts, p) % len(points) for p in positions):
        home = owners[arc]
        if room[home]:
            room[home] -= 1
            found[home, home] += 1
        else:
            over[arc] += 1
    waiting = deque()
    for lap in range(2):
        for arc, shard in enumerate(owners):
            waiting.extend([owners[arc]] * (over[arc] if lap == 0 else 0))
            while waiting and room[shard]:
                room[shard] -= 1
                found[waiting.popleft(), shard] += 1
    assert not waiting
    return found


@pytest.mark.parametrize("hot", [False, True])
def test_shards_equal_a_simulated_ring(spark, sample, hot):
    """Every row, shard by shard; with ``hot`` a third of the rows are copies of one."""
    docs = sample("documents").select("doc_id", "text")
    if hot:
        docs = docs.unionByName(docs.limit(1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(100)))).drop("n"))
    found = sharding.shard_rows(docs, 7, 16).collect()
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    positions = [r.p for r in docs.select(F.xxhash64("doc_id", crc).alias("p")).collect()]
    assert Counter((r.home_shard, r.shard) for r in found) == simulated_ring(positions, 7, 16)
    for shard, n in Counter(r.shard for r in found).items():
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(n))


def test_shards_use_no_python(sample):
    plan = sharding.shard_rows(sample("documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_few_rows_move(sample):
    found = sharding.shard_rows(sample("documents"), 8, 256).collect()
    assert sum(r.moved for r in found) < 0.3 * len(found)


TEXT = st.text(st.sampled_from("abcdeghinorstuy'!?.1é Ωß\t\n<|>") | st.characters(codec="utf-8"), max_size=60) | st.lists(
    st.sampled_from(["th", "in", "er", "an", "ing", "ed", "s", "e", "tion", "a", " ", "<|endoftext|>"]), max_size=12).map("".join)


@SETTINGS
@given(st.lists(TEXT, max_size=20))
def test_encoding_equals_the_library(texts):
    model = bpe.vocabulary(PATH)
    for text in texts:
        expected = LIBRARY.encode(text, add_special_tokens=False).ids
        assert model.encode(text) == expected
        assert model.decode(expected) == LIBRARY.decode(expected, skip_special_tokens=False)


def test_long_words_and_memo_turnover():
    model = bpe.WordBpe(PATH)
    model.chunk_memo, model.word_memo = bpe.Memo(3), bpe.Memo(3)
    for text in ["a" * 3000, "thinthinan" * 400, "ab cd ef gh ij kl", "ab cd zz", "kl ab"]:
        assert model.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digests_of_documents(odd_docs, no_docs, sample):
    docs = odd_docs.select("doc_id", "text").unionByName(sample("documents").select("doc_id", "text"))
    found = Counter(tuple(r) for r in bpe.encode_digests(docs).collect())
    expected = Counter()
    for r in docs.collect():
        ids = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        expected[r.doc_id, len(ids), digest(" ".join(map(str, ids))), digest(LIBRARY.decode(ids, skip_special_tokens=False))] += 1
    assert found == expected
    assert Counter(r.n_tokens for r in bpe.encode_digests(odd_docs).collect()) == Counter(
        len(LIBRARY.encode(r.text or "", add_special_tokens=False).ids) for r in odd_docs.select("text").collect())
    assert bpe.encode_digests(no_docs).count() == 0


def test_encode_and_decode_round_trip(odd_docs):
    ids = bpe.encode_ids(odd_docs)
    texts = sorted(str(r.text) for r in bpe.decode_ids(ids).collect())
    expected = [LIBRARY.encode(r.text or "", add_special_tokens=False).ids for r in odd_docs.select("text").collect()]
    assert texts == sorted(LIBRARY.decode(e, skip_special_tokens=False) for e in expected)


def test_least_squares_is_nonnegative_and_close():
    draw = np.random.default_rng(1)
    matrix = draw.random((12, 30))
    wanted = np.maximum(0, draw.standard_normal(30))
    x = packing.nonnegative_least_squares(matrix, matrix @ wanted, 3000)
    assert (x >= 0).all() and np.allclose(matrix @ x, matrix @ wanted, atol=1e-2)


@SETTINGS
@given(st.lists(st.integers(0, 30), min_size=17, max_size=17), st.sampled_from([1, 4, 16]))
def test_plan_uses_every_piece_once(histogram, grain):
    histogram[0] = 0
    used = np.zeros(17, np.int64)
    for repeats, members in packing.plan(np.array(histogram), grain=grain):
        assert sum(length * each for length, each in members) <= 16 and repeats > 0
        for length, each in members:
            used[length] += repeats * each
    assert used.tolist() == histogram


@pytest.mark.parametrize("lengths", [[1], [12], [17], range(1, 13), range(1, 300), range(1, 4097)])
def test_plan_pads_little(lengths):
    """Short, equal and mixed lengths take at most a twentieth more sequences than their ids need."""
    histogram = np.bincount(np.random.default_rng(1).choice(list(lengths), 20_000), minlength=4097)
    sequences = sum(repeats for repeats, _ in packing.plan(histogram))
    assert sequences <= 1.05 * -(-int((histogram * np.arange(4097)).sum()) // 4096)


def check_pieces(found, docs, window):
    ids = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids[r.doc_id, tuple([*LIBRARY.encode(r.text or "", add_special_tokens=False).ids, 2])] += 1
    expected = Counter()
    for (doc_id, own), n in ids.items():
        for at in range(0, len(own), window):
            part = own[at : at + window]
            expected[doc_id, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), len(own)] += n
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == expected
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return sum(r.length for r in found) / len(sequences) / window


def test_packing_of_odd_rows(odd_docs, no_docs):
    check_pieces(packing.pack(odd_docs, window=64, grain=4).collect(), odd_docs, 64)
    assert packing.pack(no_docs).count() == 0


def test_packing_pads_little(sample):
    docs = sample("documents")
    assert check_pieces(packing.pack(docs).collect(), docs, 4096) > 0.93


def pages(spark, rows):
    schema = "page_id long, url string, html string, digest int, payload int, tied int, n int, copy int, record_id int"
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], schema).repartition(3)


BIG, OTHER = "<p>" + "ä" * 600 + "\r\n\r\nWARC/1.1\r\n</p>", "y" * 1000

PAGES = [(1, "http://a/ b\r\nX: 1", BIG), (2, None, BIG), (3, "http://c", "x" * 999), (4, "http://d", "x" * 999),
         (5, "http://e", OTHER), (5, "http://e", OTHER), (5, "http://e", OTHER), (6, "http://f", None), (7, "", ""),
         (None, "http://g", BIG), (9, "http://h", "\x00퟿"), (10, "http://i", "z" * 300_000)]


def brute_pages(rows):
    best = {}
    for p, u, h in rows:
        best[h or ""] = max(best.get(h or "", (-1, "")), (-1 if p is None else p, u or ""))
    out, used = Counter(), set()
    for p, u, h in rows:
        body = (h or "").encode()
        mine = (-1 if p is None else p, u or "") == best[h or ""] and (h or "") not in used
        if mine:
            used.add(h or "")
        response = len(body) < 1000 or mine
        out[p, len(body), hashlib.sha1(body).hexdigest(), "response" if response else "revisit",
            None if response else best[h or ""][0]] += 1
    return out


def test_archives_of_odd_pages(spark, folder):
    df = pages(spark, PAGES)
    path = f"{folder}/warc"
    assert Counter(tuple(r) for r in warc.archive_pages(df, path).collect()) == brute_pages(PAGES)
    back = warc.read_archive(spark, path, payloads=True).filter("record_type = 'response'").collect()
    stored = Counter((r.page_id, r.payload) for r in back)
    assert stored[2, BIG] == 1 and stored[1, BIG] == 0 and stored[5, OTHER] == 1 and stored[9, "\x00퟿"] == 1
    assert warc.archive_pages(df.filter("1 = 0"), f"{folder}/none").count() == 0


def test_archives_are_rewritten(spark, folder):
    """Archives with every payload, and archives with revisits, come out the same without repeats."""
    records = warc.page_records(pages(spark, [p for p in PAGES if p[0] != 5]))
    warc.write_archive(warc.resolve(records, small=1 << 40), f"{folder}/full")
    warc.rewrite_archive(spark, f"{folder}/full", f"{folder}/once")
    warc.rewrite_archive(spark, f"{folder}/once", f"{folder}/twice")
    for name in ("once", "twice"):
        headers = warc.resolved_headers(warc.read_archive(spark, f"{folder}/{name}"))
        found = Counter(tuple(r) for r in headers.select(
            "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
        assert found == brute_pages([p for p in PAGES if p[0] != 5])


def test_parser_reads_members_and_refuses_fragments():
    record = (b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 23\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody\r\n\r\n")
    both = gzip.compress(record) + gzip.compress(record)
    assert [p for _, _, p in warc.parse(both)] == [b"body", b"body"]
    with pytest.raises(ValueError):
        list(warc.parse(gzip.compress(record[:70])))
    with pytest.raises(ValueError):
        list(warc.parse(gzip.compress(b"x" + record)))


def test_archives_are_read_by_ranges(spark, folder):
    """A file splits at any byte: every record is read once, also where a payload holds the end mark itself."""
    rows = [(i, f"http://s/{i}", f"<p>{i}</p>" * (i * 37 % 61)) for i in range(200)]
    warc.write_archive(warc.resolve(warc.page_records(pages(spark, rows)).coalesce(1)), f"{folder}/split")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for size in ("211", "997", "4096"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            back = warc.read_archive(spark, f"{folder}/split", payloads=True)
            assert back.rdd.getNumPartitions() > 3
            found = Counter((r.page_id, r.payload) for r in back.filter("record_type = 'response'").collect())
            assert found == Counter((i, h) for i, _, h in rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_a_member_never_holds_the_end_mark():
    noise = bytes(zlib.crc32(struct.pack("<I", i)) & 255 for i in range(70_000))
    for body in (warc.END, noise + warc.END + noise, warc.END * 1000, b""):
        packed = warc.member(b"head", body)
        assert warc.END not in packed and gzip.decompress(packed + warc.END) == b"head" + body


def foreign(kind, ident, block, *lines, http=True):
    head = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: " + ident, *lines,
            *[b"Content-Type: application/http; msgtype=response"] * http, b"Content-Length: %d" % len(block)]
    return gzip.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_foreign_archives_keep_what_they_hold(spark, folder):
    """Other types, encodings, statuses, dates and unresolved revisits stay; repeats become revisits."""
    body = b"<p>\xe4\xf6\xfc\xff</p>" * 200
    found, moved = b"HTTP/1.1 404 Not Found\r\nX-A: \xe9\r\n\r\n", b"HTTP/1.1 200 Fine\r\nServer: s\r\n\r\n"
    records = [
        foreign(b"warcinfo", b"<i>", b"software: x\r\n", http=False),
        foreign(b"request", b"<q>", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", b"WARC-Target-URI: http://a"),
        foreign(b"response", b"<1>", found + body, b"WARC-Target-URI: http://a", b"WARC-Date: 2020-01-01T00:00:00Z"),
        foreign(b"response", b"<2>", moved + body, b"WARC-Target-URI: http://b", b"WARC-Date: 2021-02-03T04:05:06Z",
                b"WARC-IP-Address: 10.0.0.1"),
        foreign(b"revisit", b"<3>", moved, b"WARC-Target-URI: http://c", b"WARC-Refers-To: <1>"),
        foreign(b"revisit", b"<4>", moved, b"WARC-Target-URI: http://d", b"WARC-Refers-To: <gone>"),
        foreign(b"resource", b"<5>", body, b"WARC-Target-URI: file:///x", http=False),
    ]
    os.makedirs(f"{folder}/foreign")
    with open(f"{folder}/foreign/a.warc.gz", "wb") as file:
        file.write(b"".join(records))
    warc.rewrite_archive(spark, f"{folder}/foreign", f"{folder}/ours")
    rows = {r.record_id: r for r in warc.read_records(spark, f"{folder}/ours").collect()}
    assert set(rows) == {"<i>", "<q>", "<1>", "<2>", "<3>", "<4>", "<5>"}
    assert {k: r.record_type for k, r in rows.items()} == {
        "<i>": "warcinfo", "<q>": "request", "<1>": "revisit", "<2>": "response", "<3>": "revisit", "<4>": "revisit",
        "<5>": "resource"}
    assert bytes(rows["<2>"].payload) == body and bytes(rows["<5>"].payload) == body and not rows["<1>"].payload
    assert bytes(rows["<1>"].http) == found and bytes(rows["<2>"].http) == moved
    assert rows["<1>"].date == "2020-01-01T00:00:00Z" and rows["<2>"].rest == "WARC-IP-Address: 10.0.0.1\r\n"
    assert rows["<1>"].refers_to_record == "<2>" and rows["<3>"].refers_to_record == "<2>"
    assert rows["<4>"].refers_to_record == "<gone>" and bytes(rows["<i>"].payload) == b"software: x\r\n"
