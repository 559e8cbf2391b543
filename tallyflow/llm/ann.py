"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard.

Distinct vectors are dealt to shards by a hash of their bytes; copies hang on their vector. A shard's
graph has levels drawn from the usual geometric distribution; at each level a node links to up to
``links`` diverse neighbours (a candidate is taken if it is nearer to the node than to any neighbour
taken before) and gets links back, thinned by the same rule. The graph is kept as flat arrays: one
array of neighbour numbers per level, rows of fixed width.

Every query visits every shard and walks down the levels with a beam, wider at the lowest one; the
shards' results are merged by distance. Shards are of a set size and stay where they are: the queries, which
are fewer, are sent to them and stream past in blocks, so a task holds one shard and one block.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.llm.common import needed, ready, stored

#: Distinct vectors of a shard, queries of a block.
SHARD_ROWS = 8192
BLOCK_ROWS = 1024
LINKS = 16
CANDIDATES = 64
BEAM = 128
#: Beam of the upper levels, all of which enters the next one.
ENTRIES = 32

EMPTY = -1


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of the rows of a to the rows of b."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def _diverse(vectors: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, distances: np.ndarray, width: int) -> np.ndarray:
    """Up to ``width`` candidates of each node, nearest first, none nearer to one taken before than to the node.

    Places that stay free go to the nearest candidates passed over.
    """
    n, many = candidates.shape
    taken = np.full((n, width), EMPTY, np.int64)
    count = np.zeros(n, np.int64)
    passed = np.zeros((n, many), bool)
    for c in range(many):
        item, distance = candidates[:, c], distances[:, c]
        live = (item != EMPTY) & (count < width)
        if not live.any():
            break
        rows = np.flatnonzero(live)
        chosen = taken[rows]
        gap = ((vectors[item[rows]][:, None, :] - vectors[np.maximum(chosen, 0)]) ** 2).sum(-1)
        gap[chosen == EMPTY] = np.inf
        good = gap.min(axis=1) > distance[rows]
        taken[rows[good], count[rows[good]]] = item[rows[good]]
        count[rows[good]] += 1
        passed[rows[~good], c] = True
    for c in range(many):
        rows = np.flatnonzero(passed[:, c] & (count < width))
        taken[rows, count[rows]] = candidates[rows, c]
        count[rows] += 1
    return taken


def _level(vectors: np.ndarray, members: np.ndarray, width: int, candidates: int) -> np.ndarray:
    """Links of one level's members (positions in ``members``), both ways, at most twice ``width`` each."""
    own, n = vectors[members], len(members)
    k = min(candidates, n - 1)
    near = np.full((n, max(k, 0)), EMPTY, np.int64)
    far = np.full((n, max(k, 0)), np.inf, np.float32)
    if k > 0:
        for at in range(0, n, 512):
            gaps = squared(own[at : at + 512], own)
            gaps[np.arange(len(gaps)), np.arange(at, at + len(gaps))] = np.inf
            some = np.argpartition(gaps, k - 1, axis=1)[:, :k]
            part = np.take_along_axis(gaps, some, 1)
            order = np.argsort(part, axis=1, kind="stable")
            near[at : at + 512] = np.take_along_axis(some, order, 1)
            far[at : at + 512] = np.take_along_axis(part, order, 1)
    out = np.full((n, width), EMPTY, np.int64)
    for at in range(0, n, 1024):
        out[at : at + 1024] = _diverse(own, np.arange(at, min(n, at + 1024)), near[at : at + 1024], far[at : at + 1024], width)
    # links back, of the nearest ones, thinned to twice the width by the same rule
    a, b = np.repeat(np.arange(n), width), out.ravel()
    a, b = a[b != EMPTY], b[b != EMPTY]
    pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
    a, b = np.divmod(pairs, n)
    gap = ((own[a] - own[b]) ** 2).sum(1)
    order = np.lexsort((b, gap, a))
    a, b, gap = a[order], b[order], gap[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    keep = place < 4 * width
    near, far = np.full((n, 4 * width), EMPTY, np.int64), np.full((n, 4 * width), np.inf, np.float32)
    near[a[keep], place[keep]], far[a[keep], place[keep]] = b[keep], gap[keep]
    links = np.full((n, 2 * width), EMPTY, np.int64)
    for at in range(0, n, 1024):
        links[at : at + 1024] = _diverse(own, np.arange(at, min(n, at + 1024)), near[at : at + 1024], far[at : at + 1024], 2 * width)
    return links


def build(vectors: np.ndarray, width: int = LINKS, candidates: int = CANDIDATES, seed: int = 6) -> dict:
    """The graph of a shard's vectors: for each level its members and their flat neighbour array."""
    vectors = vectors.astype(np.float32)
    n = len(vectors)
    draws = np.random.default_rng(seed).random(n)
    tops = np.floor(-np.log(np.maximum(draws, 1e-12)) / math.log(width)).astype(int)
    levels = []
    for level in range(int(tops.max()) + 1 if n else 0):
        members = np.flatnonzero(tops >= level)
        levels.append((members.astype(np.int32), _level(vectors, members, width, candidates).astype(np.int32)))
    return {"levels": levels}


def _beam(
    vectors: np.ndarray, queries: np.ndarray, links: np.ndarray, entries: np.ndarray, beam: int,
) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes each query meets on one level, nearest first, and their squared distances.

    All queries walk together from their ``entries``: each expands its nearest open node until none is open.
    """
    n, q = len(vectors), len(queries)
    rows = np.arange(q)
    items, scores = np.full((q, beam), EMPTY, np.int64), np.full((q, beam), np.inf, np.float32)
    first = np.where(entries == EMPTY, n, entries)[:, :beam]
    seen = np.zeros((q, n + 1), bool)
    seen[rows[:, None], first] = True
    gap = ((vectors[np.minimum(first, n - 1)] - queries[:, None, :]) ** 2).sum(-1)
    items[:, : first.shape[1]], scores[:, : first.shape[1]] = first, np.where(first < n, gap, np.inf)
    done = ~np.isfinite(scores)
    while True:
        ahead = np.where(done, np.inf, scores)
        pick = ahead.argmin(1)
        live = np.flatnonzero(np.isfinite(ahead[rows, pick]))
        if not len(live):
            break
        done[live, pick[live]] = True
        near = links[items[live, pick[live]]].astype(np.int64)
        near = np.where(near == EMPTY, n, near)
        fresh = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        gap = ((vectors[np.minimum(near, n - 1)] - queries[live][:, None, :]) ** 2).sum(-1)
        gap = np.where(fresh & (near < n), gap, np.inf)
        every = np.concatenate([scores[live], gap], 1)
        order = np.argsort(every, axis=1, kind="stable")[:, :beam]
        scores[live] = np.take_along_axis(every, order, 1)
        items[live] = np.take_along_axis(np.concatenate([items[live], near], 1), order, 1)
        done[live] = np.take_along_axis(
            np.concatenate([done[live], ~np.isfinite(gap)], 1), order, 1) | ~np.isfinite(scores[live])
    order = np.argsort(scores, axis=1, kind="stable")
    scores = np.take_along_axis(scores, order, 1)
    return np.where(np.isfinite(scores), np.take_along_axis(items, order, 1), EMPTY), scores


def search(graph: dict, vectors: np.ndarray, queries: np.ndarray, found: int, beam: int = BEAM, entries: int = ENTRIES) -> np.ndarray:
    """Up to ``found`` positions near each query, all queries walking together; EMPTY where there are fewer.

    The upper levels keep a small beam as well, and the lowest level is entered at all its nodes, so that
    a query between clusters is not lost in one of them.
    """
    n, q = len(vectors), len(queries)
    vectors, queries = vectors.astype(np.float32), queries.astype(np.float32)
    if n == 0 or q == 0:
        return np.full((q, found), EMPTY, np.int64)
    nodes = np.full((q, 1), graph["levels"][-1][0][0], np.int64)
    for members, links in reversed(graph["levels"][1:]):
        place = np.full(n + 1, EMPTY, np.int64)
        place[members] = np.arange(len(members))
        at, _ = _beam(vectors[members], queries, links, place[nodes], min(entries, len(members)))
        nodes = np.where(at == EMPTY, EMPTY, members[np.maximum(at, 0)])
    at, _ = _beam(vectors, queries, graph["levels"][0][1], nodes, max(beam, found, nodes.shape[1]))
    return at[:, :found]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part, components in double precision.

    Left out are rows without vec_id and vectors null, empty, zero, holding null or non-finite
    components, or of another length than most (the smaller length on a tie). Of rows with one vec_id
    the smallest vector counts.
    """
    vector = F.transform("embedding", lambda x: x.cast("double"))
    rows = needed(vectors, ["vec_id", "embedding"]).select("vec_id", vector.alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = rows.filter(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)).filter(
        finite & F.exists("vector", lambda x: x != 0))
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = stored(rows, "vectors")
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"))
    common = sizes.orderBy(F.desc("n"), "size").limit(1).collect()
    return rows.filter(F.size("vector") == (common[0]["size"] if common else 0))


def _packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def index_shards(distinct: DataFrame, shards: int, links: int = LINKS, candidates: int = CANDIDATES) -> DataFrame:
    """One row per shard: its graph and its vectors. ``distinct`` has vector_key and vector."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vector_key")
        vectors = np.stack(rows["vector"].to_list())
        return pd.DataFrame([{
            "shard": int(rows["shard"].iloc[0]), "graph": pickle.dumps(build(vectors, links, candidates)),
            "vectors": _packed(vectors), "keys": _packed(rows["vector_key"].to_numpy(np.int64)), "size": len(rows)}])

    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("vector_key", F.lit(6)), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(run, "shard int, graph binary, vectors binary, keys binary, size int")


HITS = pa.schema([("query_id", pa.int64()), ("vector_key", pa.int64()), ("score", pa.float64())])


def visit(found: int, beam: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a shard followed by its queries to the ``found`` nodes near each query, in blocks of queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, graph, vectors, keys = None, None, None, None
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            heads = np.flatnonzero(~np.asarray(batch.column("graph").is_null().to_numpy(zero_copy_only=False)))
            for start, end in zip([0, *heads], [*heads, batch.num_rows], strict=True):
                if start < end and batch.column("graph")[int(start)].is_valid:
                    row = batch.slice(int(start), 1).to_pylist()[0]
                    number, graph = row["shard"], pickle.loads(row["graph"])
                    vectors = np.frombuffer(row["vectors"], np.float64).reshape(row["size"], -1)
                    keys = np.frombuffer(row["keys"], np.int64)
                    start += 1
                # the queries of a shard without vectors meet nothing
                mine = start + np.flatnonzero(shards[start:end] == number)
                for at in range(0, len(mine), BLOCK_ROWS):
                    asked = batch.take(pa.array(mine[at : at + BLOCK_ROWS]))
                    points = asked.column("vector").flatten().to_numpy().reshape(asked.num_rows, -1)
                    near = search(graph, vectors, points, min(found, len(keys)), beam)
                    q, place = np.nonzero(near != EMPTY)
                    hit = near[q, place]
                    score = np.sqrt(((vectors[hit] - points[q]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays(
                        [asked.column("query_id").take(pa.array(q)), pa.array(keys[hit]), pa.array(score)], schema=HITS)

    return run


def nearest(
    vectors: DataFrame, every: int = 100, k: int = 10, shard_rows: int = SHARD_ROWS, beam: int = BEAM,
) -> DataFrame:
    """The k nearest rows found for each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score.

    Candidates are all rows but the query's own; the score is the Euclidean distance in double precision
    of the original vectors, ties go to the smaller vec_id. Rows that take no part: see ``usable``. Equal
    vectors are one node of a graph with the k + 1 smallest of their ids, which is all that k results can
    use. Without queries or candidates there are no rows; further columns are ignored.
    """
    spark = ready(vectors.sparkSession)
    rows = stored(usable(vectors).withColumn("vector_key", F.xxhash64("vector")), "usable")
    order = Window.partitionBy("vector_key", "vector").orderBy("vec_id")
    first = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    # equal vectors share a key; different vectors with one key are told apart by a number
    groups = first.groupBy("vector_key", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    groups = stored(groups.withColumn("vector_key", F.xxhash64("vector_key", F.element_at("ids", 1))), "nodes")
    count = groups.count()
    shards = max(1, -(-count // shard_rows))
    index = stored(index_shards(groups.select("vector_key", "vector"), shards), "graphs")
    queries = rows.filter(F.pmod(F.col("vec_id"), F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "vector")
    # where shards are fewer than the cores, several copies of each share its queries
    lanes = max(1, -(-spark.sparkContext.defaultParallelism // shards))
    lane = F.pmod(F.xxhash64("query_id"), F.lit(lanes)).cast("int")
    asked = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), lane.alias("lane"),
        F.col("query_id").cast("long").alias("query_id"), "vector")
    there = index.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    rows_by_shard = there.unionByName(asked, allowMissingColumns=True).repartition("shard", "lane")
    # k + 1: one of the nodes may hold the query alone
    hits = rows_by_shard.sortWithinPartitions("shard", "lane", F.col("graph").isNull()).mapInArrow(
        visit(k + 1, beam), "query_id long, vector_key long, score double")
    hits = stored(hits, "hits").join(groups.select("vector_key", F.explode("ids").alias("vec_id")), "vector_key")
    hits = hits.filter(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return hits.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k).select(
        F.col("query_id").cast("long").alias("query_id"), "rank", F.col("vec_id").cast("long").alias("vec_id"), "score")
