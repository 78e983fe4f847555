"""Clustering of integer vectors around centroids, with block-norm screening.

A vector is kept with a compressed form, made once: small codes at a step of its own, and per segment of
components the norm of the segment and the norm of what the codes leave out of it. By Cauchy and Schwarz,
segment by segment, codes and norms bound a vector's product with a centroid from above, and so their
distance from below. A vector's distance to the centroid that the codes call nearest is then worked out in
whole numbers; other centroids are only where their bound isn't above it. So all results are exact.

The centroids (``k`` of them) pass through the driver; vectors and what is summed over them stay with the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._shared import durable

#: Components of a segment, the largest code, and the largest component whose distances surely fit a long at 64 components.
SEGMENT, CODE, LARGEST = 8, 7, 1 << 27
ROWS = 4096


def _segment_norms(rows: np.ndarray) -> np.ndarray:
    """The norm of every segment of each row; the last segment may be shorter."""
    cuts = np.arange(0, rows.shape[1], SEGMENT)
    return np.sqrt(np.add.reduceat(np.square(rows.astype(np.float64)), cuts, axis=1))


def compress(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, steps, segment norms and segment norms of what the codes leave out."""
    steps = np.maximum(1, -(-np.abs(vectors).max(axis=1, initial=0) // CODE))
    codes = (2 * vectors + steps[:, None]) // (2 * steps[:, None])  # rounded
    return codes.astype(np.int8), steps, _segment_norms(vectors), _segment_norms(vectors - codes * steps[:, None])


def exact_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows in whole numbers."""
    gaps = vectors - centroids
    return np.einsum("ij,ij->i", gaps, gaps)


def nearest(vectors, codes, steps, norms, rest, centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each vector the nearest centroid (of equals the first), the squared distance, and how many distances were worked out."""
    n = np.arange(len(vectors))
    reach = _segment_norms(centroids).T
    squares = np.square(norms).sum(axis=1)[:, None] + np.square(centroids.astype(np.float64)).sum(axis=1)
    product = (codes.astype(np.float64) @ centroids.T.astype(np.float64)) * steps[:, None]
    first = (squares - 2 * product).argmin(axis=1)
    best = exact_distances(vectors, centroids[first])
    bound = squares - 2 * np.minimum(norms @ reach, product + rest @ reach)
    alive = bound - 1e-9 * squares - 1e-6 <= best[:, None]  # the margin is for rounding
    alive[n, first] = False
    found = np.full(alive.shape, np.iinfo(np.int64).max)
    found[n, first] = best
    row, centroid = np.nonzero(alive)
    for at in range(0, len(row), ROWS):
        r, c = row[at : at + ROWS], centroid[at : at + ROWS]
        found[r, c] = exact_distances(vectors[r], centroids[c])
    cluster = found.argmin(axis=1)
    return cluster, found[n, cluster], alive.sum(axis=1) + 1


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel()))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _compressed(scale: int):
    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            floats = np.floor(scale * _matrix(part.column(1), np.float64))
            if np.abs(floats).max(initial=0) > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST} at this scale: distances would not fit a long")
            vectors = floats.astype(np.int64)
            codes, steps, norms, rest = compress(vectors)
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(vectors), _lists(codes), pa.array(steps), _lists(norms), _lists(rest)], ["id", "vector", "codes", "step", "norms", "rest"])

    return compressed


def _read(part: pa.RecordBatch):
    return _matrix(part.column(1), np.int64), _matrix(part.column(2), np.int8), part.column(3).to_numpy(), _matrix(part.column(4), np.float64), _matrix(part.column(5), np.float64)


def _summed(centroids: np.ndarray):
    """Per task and cluster that it meets: members and the sum of their components."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for part in _parts(batches):
            vectors, *compact = _read(part)
            cluster = nearest(vectors, *compact, centroids)[0]
            counts += np.bincount(cluster, minlength=len(centroids))
            np.add.at(sums, cluster, vectors)
        some = np.flatnonzero(counts)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), _lists(sums[some])], ["cluster", "n", "sums"])

    return summed


def _assigned(centroids: np.ndarray):
    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            cluster, distance, tried = nearest(*_read(part), centroids)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(tried.astype(np.int32))], ["id", "cluster", "distance", "n_exact"])

    return assigned


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids' next places: the floor of their members' mean; those without members stay."""
    parts = vectors.mapInArrow(_summed(centroids), "cluster int, n long, sums array<long>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("place", "part")).groupBy("cluster", "place")
    out = centroids.copy()
    for r in each.agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect():  # k times the components at most
        out[r.cluster, r.place] = int(r.total) // r.n
    return out


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector: id, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``, ``n_exact``.

    Kept are vectors of exactly ``size`` components, none of them null, NaN or infinite; a component x
    becomes floor(scale * x). The first centroids are the ``k`` vectors with the smallest SHA-256 of
    ``seed:id`` (a null id is empty; of equal ids the smaller vector comes first). Each of the
    ``rounds`` gives every vector to its nearest centroid, of equally near ones to the first, and moves
    centroids to the floor of the mean; then all are given once more. ``distance`` is squared, the
    inertias are its sums over the cluster and over all; ``centroid_sha256`` is that of the centroid's
    components, joined by commas. ``n_exact`` of the k distances were worked out in full.

    Repeated vectors and ids are rows of their own. With fewer than ``k`` vectors there are fewer
    centroids; a table without any kept vector gives an empty result. Components whose distances might not
    fit a long are an error. Columns other than the two named ones are not read.
    """
    spark = vectors.sparkSession
    if size < 1:
        raise ValueError("vectors need a component at least")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    kept = rows.where(F.expr(f"size(vector) = {size} AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"))
    kind = rows.schema["id"].dataType.simpleString()
    compact = durable(kept.mapInArrow(_compressed(scale), f"id {kind}, vector array<long>, codes array<byte>, step long, norms array<double>, rest array<double>"), "vectors")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = compact.select(rank.alias("rank"), "vector").orderBy("rank", "vector").limit(k).collect()
    if first:
        centroids = np.array([r.vector for r in first], np.int64)
        for _ in range(rounds):
            centroids = _moved(compact, centroids)
        digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
        given = compact.mapInArrow(_assigned(centroids), f"id {kind}, cluster int, distance long, n_exact int")
    else:
        digests = []
        given = compact.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).alias("n_exact"))
    given = durable(given, "clusters", after=(compact,))
    inertia = {r.cluster: r.inertia for r in given.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # k rows at most
    total = sum(inertia.values())
    facts = spark.createDataFrame([(c, i, total, digests[c]) for c, i in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return given.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_exact")
