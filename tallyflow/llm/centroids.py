"""Centroid clustering with the threshold algorithm.

Each dimension has a list of the centroids sorted by their value. A vector walks all lists outward from
its own value, nearest entry first; a centroid met for the first time gets its exact distance. The
squared gaps at the frontier, summed over the dimensions, bound every centroid not met yet from below,
so the walk ends when that sum strictly exceeds the best exact distance (at a tie a smaller number may
still come), or when every centroid is met.

Vectors stay where they are: a round is one pass over them that returns a row of sums for each task and
centroid. Only centroids (``clusters`` rows) meet in the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import needed, ready, stored

#: Largest scaled component: with it a squared distance of 64 components still fits a long.
LARGEST = 1 << 27

#: Vectors that walk together.
WALKING = 2048

FAR = np.int64(1) << np.int64(40)


def integers(vectors: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, v) of the vectors with exactly ``dimensions`` components, none null or non-finite; v = floor(scale * x)."""
    rows = needed(vectors, ["vec_id", "embedding"]).withColumn("x", F.transform("embedding", lambda x: x.cast("double")))
    good = (F.size("x") == dimensions) & F.forall(
        "x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    large = F.exists("x", lambda x: F.abs(x) > F.lit(LARGEST / scale))
    values = F.when(large, F.raise_error(F.lit(f"a component exceeds {LARGEST / scale:g}: its distances do not fit a long")).cast(
        "array<int>")).otherwise(F.transform("x", lambda x: F.floor(F.lit(float(scale)) * x).cast("int")))
    return rows.filter(F.coalesce(good, F.lit(False))).select("vec_id", values.alias("v"))


def assign(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each vector's nearest centroid (the smallest of equally near ones) and the squared distance."""
    k, dimensions = centroids.shape
    order = np.argsort(centroids, axis=0, kind="stable")
    lists = np.sort(centroids, axis=0)
    # one entry more at both ends, farther than any other
    lists = np.vstack([np.full(dimensions, -FAR), lists, np.full(dimensions, FAR)])
    column = np.arange(dimensions)
    right = np.stack([np.searchsorted(lists[:, d], vectors[:, d]) for d in range(dimensions)], axis=1)
    left = right - 1
    exact = np.full((len(vectors), k), np.iinfo(np.int64).max)
    met = np.zeros((len(vectors), k), bool)
    walking = np.arange(len(vectors))
    while len(walking):
        own = vectors[walking]
        below, above = own - lists[left, column], lists[right, column] - own
        down = below <= above
        gap = np.where(down, below, above)
        found = order[np.where(down, left, right) - 1, column]
        new = np.zeros((len(walking), k), bool)
        np.put_along_axis(new, found, True, axis=1)
        new &= ~met[walking]
        row, number = np.nonzero(new)
        met[walking[row], number] = True
        exact[walking[row], number] = ((own[row] - centroids[number]) ** 2).sum(1)
        open_ = ((gap ** 2).sum(1) <= exact[walking].min(1)) & ~met[walking].all(1)
        left, right = (left - down)[open_], (right + ~down)[open_]
        walking = walking[open_]
    return exact.argmin(1), exact.min(1)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for at in range(0, batch.num_rows, WALKING):
        part = batch.slice(at, WALKING)
        yield part.column(0), part.column(1).flatten().to_numpy().astype(np.int64).reshape(part.num_rows, -1)


def cluster_sums(rows: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Of each centroid that is nearest to a vector: how many are, and their sum."""
    dimensions = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, own in _blocks(batch):
                cluster, _ = assign(own, centroids)
                counts += np.bincount(cluster, minlength=len(centroids))
                np.add.at(sums, cluster, own)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))],
            ["cluster", "rows", "sums"])

    parts = rows.mapInArrow(run, "cluster int, rows long, sums array<long>")
    total = parts.groupBy("cluster").agg(F.sum("rows").alias("rows"), F.array(
        *[F.sum(F.col("sums")[d]) for d in range(dimensions)]).alias("sums"))
    # a row for each centroid at most
    return {r["cluster"]: (r["rows"], list(r["sums"])) for r in total.collect()}


def nearest_centroids(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, own in _blocks(batch):
                cluster, distance = assign(own, centroids)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def first_centroids(rows: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The ``clusters`` vectors with the smallest sha256 of ``seed:vec_id``; of repeated ids the smaller vector first."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    chosen = rows.withColumn("name", F.sha2(name, 256)).orderBy("name", "v").limit(clusters).collect()
    return np.array([r["v"] for r in chosen], np.int64)


def moved(centroids: np.ndarray, sums: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    """The floor of the mean of each centroid's vectors; one without vectors stays."""
    out = centroids.copy()
    for number, (count, total) in sums.items():
        out[number] = [t // count for t in total]
    return out


def cluster(
    vectors: DataFrame, clusters: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64, seed: int = 1,
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors with exactly ``dimensions`` components, none null or non-finite; the others, and a
    null array, have no row. All arithmetic is on integers and exact. A component beyond ``LARGEST /
    scale`` ends the job with an error, as its squared distances do not fit a long. With fewer vectors
    than ``clusters`` there are as many centroids as vectors; equal vectors may be several centroids, of
    which the smallest number takes all. A null vec_id counts as the empty text in the choice of the
    first centroids; rows that repeat are rows of their own. No vectors give no rows; further columns
    are ignored.
    """
    ready(vectors.sparkSession)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = stored(integers(vectors, dimensions, scale), "integers")
    centroids = first_centroids(rows, clusters, seed)
    if not len(centroids):
        return rows.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia",
                               "'' AS centroid_sha256").filter("1 = 0")
    for _ in range(rounds):
        centroids = moved(centroids, cluster_sums(rows, centroids))
    assigned = stored(nearest_centroids(rows, centroids), "assigned")
    # a row for each centroid at most
    inertia = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    at = F.col("cluster") + 1
    return assigned.select(
        F.col("vec_id").cast(kind).alias("vec_id"), "cluster", "distance",
        F.element_at(F.array(*[F.lit(inertia.get(c, 0)).cast("long") for c in range(len(names))]), at).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        F.element_at(F.array(*map(F.lit, names)), at).alias("centroid_sha256"),
    )


def cluster_sql(clusters: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64, seed: int = 1) -> str:
    """DuckDB SQL for the rows of ``cluster`` over the table ``embeddings``."""
    steps = [f"""
        kept AS MATERIALIZED (
            SELECT vec_id, row_number() OVER () AS place,
                   list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE len(embedding) = {dimensions}
              AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE))))
        ), c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY name, v) - 1 AS cluster, v FROM (
                SELECT sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS name, v FROM kept
                ORDER BY name, v LIMIT {clusters}))"""]
    for r in range(rounds + 1):
        steps.append(f"""
        a{r} AS MATERIALIZED (
            SELECT place, vec_id, v, best.distance, best.cluster FROM (
                SELECT place, any_value(k.vec_id) AS vec_id, any_value(k.v) AS v,
                       min({{'distance': list_sum(list_transform(list_zip(k.v, c.v),
                            lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'cluster': c.cluster}}) AS best
                FROM kept k, c{r} c GROUP BY place))""")
        if r < rounds:
            steps.append(f"""
        c{r + 1} AS MATERIALIZED (
            SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
                SELECT cluster, list((total - ((total % n) + n) % n) // n ORDER BY place) AS v FROM (
                    SELECT cluster, i AS place, sum(v[i])::BIGINT AS total, count(*) AS n
                    FROM a{r}, range(1, {dimensions + 1}) dims(i) GROUP BY cluster, i)
                GROUP BY cluster) m USING (cluster))""")
    return f"""
        WITH {','.join(steps)}
        SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, distance,
               CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(distance) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster"""
