"""Centroid clustering of vectors in whole numbers, pruned by a table of distances to pivots.

The distances of every vector to a few fixed pivots are taken once and stored beside the vector. In each
round the same distances are known for the centroids, and by the triangle inequality the difference of the
two bounds the distance between vector and centroid from below. A vector's nearest centroid by that bound
is measured first; only centroids whose bound doesn't exceed that distance are measured as well, in whole
numbers. Bounds are floating-point numbers lowered by SLACK, far above their rounding error, so no
centroid that is nearest, or as near with a smaller number, is ever left out.

A vector is kept if it has DIMENSIONS components, none null, NaN or infinite; others have no row in the result.
Each repeated row is a vector of its own. Vectors without id are kept and clustered, but can't be a first
centroid or pivot; of first centroids with the same id the vectors decide the order. With fewer vectors than
centroids there are fewer centroids. An empty table gives an empty result. Components must stay
within LARGEST, so that squared distances fit into 64 bits; a vector beyond ends the job with an error.
Other columns are not read.

To the driver come the first centroids, CANDIDATES vectors from which pivots are chosen (a documented
sample; any pivots give the same result) and in each round one sum for each centroid and component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineward.llm.common import written

DIMENSIONS = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
# Pivots, and vectors among which they are chosen.
PIVOTS = 16
CANDIDATES = 256
# Largest whole number of a component: 64 squared differences of twice this stay below 2^63.
LARGEST = 1 << 27
# How much bounds are lowered; distances up to 2^31 are off by less than 10^-6.
SLACK = 1e-4
# Vectors that are measured at once.
ROWS = 4096

TABLE = "vec_id long, vector binary, pivots binary"


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """``(vec_id, embedding)`` of the vectors that are kept, components as doubles."""
    value = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where((F.size("embedding") == DIMENSIONS) & finite)


def floored(embedding: np.ndarray) -> np.ndarray:
    out = np.floor(embedding * SCALE)
    if out.size and np.abs(out).max() > LARGEST:
        raise ValueError(f"a component times {SCALE} exceeds {LARGEST}; its squared distance may not fit 64 bits")
    return out.astype(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS)


def _smallest(kept: DataFrame, name: str, count: int) -> np.ndarray:
    """The whole numbers of the ``count`` vectors whose hashed ids come first."""
    order = F.sha2(F.concat(F.lit(f"{name}:"), F.col("vec_id").cast("string")), 256)
    first = kept.where("vec_id is not null").orderBy(order, "embedding").limit(count).collect()
    return floored(np.array([r["embedding"] for r in first], np.float64).reshape(-1, DIMENSIONS))


def squared(vectors: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances of every vector to each of a few others."""
    out = np.empty((len(vectors), len(others)), np.int64)
    for i, other in enumerate(others):
        apart = vectors - other
        out[:, i] = np.einsum("ij,ij->i", apart, apart)
    return out


def distant(candidates: np.ndarray, count: int) -> np.ndarray:
    """Pivots far from each other: each is the candidate farthest from those before it."""
    chosen = candidates[:1]
    nearest = squared(candidates, chosen)[:, 0] if len(chosen) else np.zeros(0)
    while 0 < len(chosen) < min(count, len(candidates)) and nearest.max() > 0:
        farthest = candidates[nearest.argmax()][None]
        chosen = np.concatenate([chosen, farthest])
        nearest = np.minimum(nearest, squared(candidates, farthest)[:, 0])
    return chosen


def pivot_table(pivots: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Vectors as whole numbers with their distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                vectors = floored(_matrix(rows.column(1)))
                distances = np.sqrt(squared(vectors, pivots).astype(np.float64))
                yield pa.record_batch(
                    {
                        "vec_id": rows.column(0),
                        "vector": _binary(vectors.astype("<i4")),
                        "pivots": _binary(distances.astype("<f8")),
                    }
                )

    return run


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _array(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def nearest(vectors: np.ndarray, distances: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each vector's nearest centroid (ties: the smaller number), its squared distance, and how many distances
    to centroids were measured."""
    to_pivots = np.sqrt(squared(centroids, pivots).astype(np.float64))
    bound = np.zeros((len(vectors), len(centroids)))
    for i in range(len(pivots)):
        np.maximum(bound, np.abs(distances[:, i : i + 1] - to_pivots[:, i]), out=bound)
    bound = np.maximum(bound - SLACK, 0)
    guess = bound.argmin(axis=1)
    apart = vectors - centroids[guess]
    best = np.einsum("ij,ij->i", apart, apart)
    bound *= bound
    may = bound <= best[:, None] * (1 + 1e-9)
    may[np.arange(len(vectors)), guess] = False
    exact = np.full(bound.shape, np.iinfo(np.int64).max)
    exact[np.arange(len(vectors)), guess] = best
    measured = len(vectors)
    for c in range(len(centroids)):
        rows = np.flatnonzero(may[:, c])
        measured += len(rows)
        apart = vectors[rows] - centroids[c]
        exact[rows, c] = np.einsum("ij,ij->i", apart, apart)
    cluster = exact.argmin(axis=1)
    return cluster, exact[np.arange(len(vectors)), cluster], measured


def _blocks(batches: Iterator[pa.RecordBatch], pivots: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            vectors = _array(rows.column("vector"), "<i4", DIMENSIONS).astype(np.int64)
            yield rows, vectors, _array(rows.column("pivots"), "<f8", pivots)


def sums(centroids: np.ndarray, pivots: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each centroid the number and the sum of a task's vectors that are nearest to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(centroids), np.int64)
        total = np.zeros(centroids.shape, np.int64)
        measured = 0
        for _, vectors, distances in _blocks(batches, len(pivots)):
            cluster, _, some = nearest(vectors, distances, centroids, pivots)
            measured += some
            counts += np.bincount(cluster, minlength=len(centroids))
            for c in np.unique(cluster):
                total[c] += vectors[cluster == c].sum(axis=0)
        found = np.flatnonzero(counts)
        yield pa.record_batch(
            {
                "cluster": pa.array(found, pa.int32()),
                "count": pa.array(counts[found], pa.int64()),
                "sums": pa.array(total[found].tolist(), pa.list_(pa.int64())),
            }
        )

    return run


def moved(vectors: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of the mean of their vectors; empty ones stay."""
    parts = vectors.mapInArrow(sums(centroids, pivots), "cluster int, count long, sums array<long>")
    exact = "decimal(38,0)"
    each = parts.select("cluster", F.col("count").cast(exact).alias("count"), F.posexplode("sums").alias("at", "part"))
    added = each.groupBy("cluster", "at").agg(F.sum("count").alias("count"), F.sum(F.col("part").cast(exact)).alias("sum"))
    out = centroids.copy()
    for row in added.collect():
        out[row["cluster"], row["at"]] = int(row["sum"]) // int(row["count"])
    return out


def assigned(centroids: np.ndarray, pivots: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, vectors, distances in _blocks(batches, len(pivots)):
            cluster, distance, _ = nearest(vectors, distances, centroids, pivots)
            columns = {"cluster": pa.array(cluster, pa.int32()), "distance": pa.array(distance, pa.int64())}
            yield pa.record_batch({"vec_id": rows.column("vec_id")} | columns)

    return run


def centroid_hash(centroid: np.ndarray) -> str:
    return sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster_vectors(vectors: DataFrame) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` for every kept vector."""
    spark = vectors.sparkSession
    kept = whole_numbers(vectors)
    centroids = _smallest(kept, "1", CENTROIDS)
    pivots = distant(_smallest(kept, "pivot", CANDIDATES), PIVOTS)
    if not len(centroids):  # no vector has an id
        centroids = pivots = np.zeros((1, DIMENSIONS), np.int64)
    stored = written(kept.mapInArrow(pivot_table(pivots), TABLE), "vectors")
    for _ in range(ROUNDS):
        centroids = moved(stored, centroids, pivots)
    found = stored.mapInArrow(assigned(centroids, pivots), "vec_id long, cluster int, distance long")
    found = written(found, "clusters")
    inertia = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    total = sum(r["cluster_inertia"] for r in inertia)
    rows = [(r["cluster"], r["cluster_inertia"], total, centroid_hash(centroids[r["cluster"]])) for r in inertia]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    told = F.broadcast(spark.createDataFrame(rows, schema))  # one row for each centroid
    return found.join(told, "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _oracle() -> str:
    """k-means of the same vectors in SQL."""
    keep = (
        f"WITH e AS (SELECT row_number() OVER () AS row_no, vec_id, embedding FROM embeddings "
        f"WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: isfinite(x))) = {DIMENSIONS}), "
        f"x AS (SELECT row_no, vec_id, list_transform(embedding, "
        f"lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM e), "
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, embedding) - 1 AS c, v FROM "
        f"(SELECT h, embedding, v FROM (SELECT row_no, embedding, sha256('1:' || vec_id) AS h FROM e) "
        f"JOIN x USING (row_no) WHERE h IS NOT NULL ORDER BY h, embedding LIMIT {CENTROIDS}))"
    )
    apart = "list_sum(list_transform(list_zip(x.v, k.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for i in range(ROUNDS + 1):
        keep += (
            f", a{i} AS (SELECT row_no, vec_id, v, c, CAST(d AS BIGINT) AS d FROM "
            f"(SELECT x.row_no, x.vec_id, x.v, k.c, {apart} AS d FROM x CROSS JOIN c{i} k) "
            f"QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY d, c) = 1)"
        )
        if i < ROUNDS:
            keep += (
                f", s{i} AS (SELECT c, i, sum(part) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS part, "
                f"generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY c, i)"
                f", m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v "
                f"FROM s{i} GROUP BY c)"
                f", c{i + 1} AS (SELECT k.c, coalesce(m.v, k.v) AS v FROM c{i} k LEFT JOIN m{i} m USING (c))"
            )
    last = ROUNDS
    return keep + (
        f" SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, "
        f"CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(k.v, ',')) AS centroid_sha256 FROM a{last} JOIN c{last} k USING (c)"
    )


ORACLE = _oracle()
