"""Centroid clustering in integers, with most distances ruled out by PCA-rotated coordinates.

Vectors are scaled to integers, and so are centroids, so that assignments, ties and
floors are exact and the same on every machine. Distances to all centroids are not
computed: the vectors' principal directions are found once, and each vector is stored
with its leading rotated coordinates and the norm of the rest. With p for the former
and r for the latter, |x - c|^2 >= |p(x) - p(c)|^2 + (r(x) - r(c))^2, which is one small matrix
product for a batch. The centroid of the least bound is measured in integers, and
then every centroid whose bound does not exceed that distance; rounding is allowed for
by lowering the bounds. The rotation decides only how much is ruled out, never the result.

The table with rotated coordinates is written once and read by every round. A round is one
pass in which each task sums its vectors by cluster; those sums, as many as there are
clusters, are added by Spark. Only centroids, sums and the moments of the dimensions reach
the driver: k or dim rows each, however many vectors there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Leading rotated coordinates that are stored.
LEAD = 16

#: Vectors whose distances are held in memory together.
BLOCK = 1024

#: Scaled components are below this, so that they are longs.
BOUND = 1 << 62

#: Where components of vectors and centroids are below this, squared distances in longs cannot overflow up to 64 dimensions.
NARROW = 1 << 27

#: By how much of the squared norms bounds are lowered; what rounding can do is some thousand times less.
SLACK = 1e-9


class Rotation(NamedTuple):
    """Principal directions as columns, and the mean that they are taken around."""

    mean: np.ndarray
    directions: np.ndarray

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and the norm of what they leave, of each row."""
        moved = x - self.mean
        lead = moved @ self.directions
        return lead, np.linalg.norm(moved - lead @ self.directions.T, axis=1)


def scaled(column: pa.Array, scale: int, dim: int) -> np.ndarray:
    """Vectors as rows of longs: floor(scale * x) of each component."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values * scale).astype(np.int64).reshape(-1, dim)


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows, in longs where they cannot overflow and in Python's integers where they might."""
    if x.size and (max(np.abs(x).max(), np.abs(y).max()) >= NARROW or x.shape[1] > 64):
        x, y = x.astype(object), y.astype(object)
    return ((x - y) ** 2).sum(axis=1)


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, rotation: Rotation) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row (the smallest of equals) and the squared distance, and how many distances were measured."""
    c_lead, c_rest = rotation(centroids.astype(np.float64))
    own, other = (lead**2).sum(1) + rest**2, (c_lead**2).sum(1) + c_rest**2
    low = (1 - SLACK) * (own[:, None] + other) - 2 * (lead @ c_lead.T + np.outer(rest, c_rest))
    least = exact(x, centroids[low.argmin(1)]).astype(np.float64)
    rows, numbers = np.nonzero(low <= least[:, None])
    found = exact(x[rows], centroids[numbers])
    order = np.lexsort((numbers, found, rows)) if found.dtype != object else np.array(sorted(range(len(rows)), key=lambda i: (rows[i], found[i], numbers[i])), dtype=np.int64)
    first = order[np.unique(rows[order], return_index=True)[1]]
    return numbers[first], found[first], len(rows)


def _kept(embeddings: DataFrame, vector: str, dim: int, scale: int) -> DataFrame:
    """The vectors of dim components, none null or non-finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < BOUND / scale))
    return embeddings.where((F.size(vector) == dim) & whole)


def _moments(vectors: DataFrame, vector: str, dim: int, scale: int) -> tuple[int, np.ndarray, np.ndarray]:
    """How many vectors there are, their sum, and the sum of their outer products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            x = scaled(batch.column(0), scale, dim).astype(np.float64)
            x = np.hstack([x, np.ones((len(x), 1))])
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"i": list(range(dim + 1)), "m": total.tolist()})

    parts = vectors.select(vector).mapInArrow(run, "i long, m array<double>")
    rows = parts.groupBy("i").agg(*(F.sum(F.col("m")[j]).alias(f"m{j}") for j in range(dim + 1))).collect()
    total = np.array([r[1:] for r in sorted(rows)], dtype=np.float64)
    return int(total[dim, dim]), total[dim, :dim], total[:dim, :dim]


def _rotation(vectors: DataFrame, vector: str, dim: int, scale: int, lead: int) -> Rotation:
    n, total, products = _moments(vectors, vector, dim, scale)
    mean = total / max(n, 1)
    _, directions = np.linalg.eigh(products / max(n, 1) - np.outer(mean, mean))
    return Rotation(mean, np.ascontiguousarray(directions[:, ::-1][:, :lead]))


def _rotated(vectors: DataFrame, rotation: Rotation, dim: int, scale: int) -> DataFrame:
    """(key, vector, lead, rest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = rotation(scaled(batch.column(1), scale, dim).astype(np.float64))
            ends = pa.array(np.arange(len(lead) + 1, dtype=np.int32) * lead.shape[1])
            made = [pa.ListArray.from_arrays(ends, pa.array(lead.ravel())), pa.array(rest)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=["key", "vector", "lead", "rest"])

    kinds = dict(vectors.dtypes)
    return vectors.mapInArrow(run, f"key {kinds['key']}, vector {kinds['vector']}, lead array<double>, rest double")


def _blocks(batch: pa.RecordBatch, scale: int, dim: int, centroids: np.ndarray, rotation: Rotation) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(vectors, cluster, distance) of a batch, a block at a time."""
    for at in range(0, batch.num_rows, BLOCK):
        part = batch.slice(at, BLOCK)
        x = scaled(part.column("vector"), scale, dim)
        lead = part.column("lead").flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        numbers, found, _ = nearest(x, lead, part.column("rest").to_numpy(zero_copy_only=False), centroids, rotation)
        yield x, numbers, found


def _moved(table: DataFrame, centroids: list[list[int]], rotation: Rotation, dim: int, scale: int) -> list[list[int]]:
    """The centroids after one round: the floor of the mean of each one's vectors; one without vectors stays."""
    now = np.array(centroids, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(now.shape, dtype=object), np.zeros(len(now), dtype=np.int64)
        for batch in batches:
            for x, numbers, _ in _blocks(batch, scale, dim, now, rotation):
                wide = np.abs(x).max() >= 1 << 50
                for c in np.unique(numbers):
                    mine = x[numbers == c]
                    total[c] += (mine.astype(object) if wide else mine).sum(axis=0)
                    n[c] += len(mine)
        used = np.flatnonzero(n)
        sums = pa.array([[Decimal(int(v)) for v in total[c]] for c in used], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), sums], names=["cluster", "n", "s"])

    parts = table.mapInArrow(run, "cluster int, n long, s array<decimal(38,0)>")
    sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(dim)))
    moved = [list(c) for c in centroids]
    for r in sums.collect():
        moved[r.cluster] = [int(v) // r.n for v in r[2:]]
    return moved


def _assigned(table: DataFrame, centroids: list[list[int]], rotation: Rotation, dim: int, scale: int) -> DataFrame:
    now = np.array(centroids, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(numbers, found) for _, numbers, found in _blocks(batch, scale, dim, now, rotation)]
            if parts:
                found = [int(d) if d < 1 << 63 else None for part in parts for d in part[1]]
                numbers = np.concatenate([part[0] for part in parts])
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(numbers, pa.int32()), pa.array(found, pa.int64())], names=["key", "cluster", "distance"])

    return table.mapInArrow(run, f"key {dict(table.dtypes)['key']}, cluster int, distance long")


def cluster(
    embeddings: DataFrame,
    k: int = 40,
    rounds: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    dim: int = 64,
    scale: int = 256,
    seed: str = "2",
    lead: int = LEAD,
) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector of dim finite components.

    The first centroids are the k vectors of smallest SHA-256 of `<seed>:<key>` (rows
    alike in key go by their components, a null key counts as empty text; fewer vectors
    than k are all centroids). Vectors with another number of components, with null or non-finite ones,
    or with one that is no long once scaled, are left out. A distance that exceeds a
    long is null and not part of the inertias; an inertia that exceeds a long is null.
    Repeated rows count each, other columns are ignored, an empty table gives an empty one.
    """
    vectors = _kept(embeddings, vector, dim, scale).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    floors = F.transform("vector", lambda x: F.floor(x.cast("double") * scale))
    centroids = [r[0] for r in vectors.select(floors.alias("floors"), mark.alias("mark")).orderBy("mark", "floors").limit(k).select("floors").collect()]
    empty = "key {}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return embeddings.sparkSession.createDataFrame([], empty.format(dict(vectors.dtypes)["key"])).withColumnRenamed("key", key)
    rotation = _rotation(vectors, "vector", dim, scale, lead)
    table = checkpoint(_rotated(vectors, rotation, dim, scale))
    for _ in range(rounds):
        centroids = _moved(table, centroids, rotation, dim, scale)
    found = checkpoint(_assigned(table, centroids, rotation, dim, scale))
    sums = {r.cluster: int(r.s or 0) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    total = fits(sum(sums.values()))
    tellings = [(c, fits(s), total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    side = found.sparkSession.createDataFrame(tellings, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = found.join(F.broadcast(side), "cluster")  # at most k rows
    return joined.select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
