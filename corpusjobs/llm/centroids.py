"""Centroid clustering: exact integer k-means whose nearest centroids come from a bisector tournament.

For centroids a < b the bisector is the plane 2 (b - a) x = |b|^2 - |a|^2: a vector beyond it is nearer to b, one on it or
before it is not, so that zero favours the smaller number. Normals and thresholds of all pairs are whole numbers that are
made once a round; the tournament of a vector is k - 1 sign tests, each of which eliminates the loser. The distance to the
winner alone is computed, exactly.

Vectors are never shuffled: tasks give one row of sums for each cluster and batch, which are added up by Spark. What is
broadcast and what reaches the driver are the k centroids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

DIMENSIONS = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
LIMB = 32  # bits of the digits by which sums are added up
LONG = (1 << 63) - 1


def fits(dimensions: int) -> int:
    """Below this, components make sign tests and distances that fit into 64 bits."""
    return math.isqrt((1 << 60) // max(1, dimensions))


def kept_vectors(rows: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """(id, x): vectors with exactly `dimensions` components, all finite when multiplied by `scale`, as x is."""
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda v: v * float(scale))
    good = (F.size(x) == dimensions) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.filter(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))


def whole(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    """The floors of a batch's vectors: longs where all of them fit, else Python's whole numbers."""
    x = np.floor(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions))
    if not x.size or np.abs(x).max() < fits(dimensions):
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x.tolist()], object)


class Bisectors:
    """Centroids with the normals and thresholds of all pairs."""

    def __init__(self, centroids: list[list[int]], dimensions: int):
        most = max((abs(v) for c in centroids for v in c), default=0)
        self.centres = np.array(centroids, np.int64 if most < fits(dimensions) else object).reshape(len(centroids), dimensions)
        norms = (self.centres * self.centres).sum(1)
        self.normals = 2 * (self.centres[None, :, :] - self.centres[:, None, :])
        self.thresholds = norms[None, :] - norms[:, None]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of each vector."""
        winner = np.zeros(len(x), np.int64)
        for challenger in range(1, len(self.centres)):
            for holder in range(challenger):  # vectors with one holder share a bisector
                these = np.flatnonzero(winner == holder)
                if len(these):
                    beyond = x[these] @ self.normals[holder, challenger] > self.thresholds[holder, challenger]
                    winner[these[beyond.astype(bool)]] = challenger
        off = x - self.centres[winner]
        return winner, (off * off).sum(1)


def assigned(vectors: DataFrame, centroids: list[list[int]], dimensions: int) -> DataFrame:
    """(id, cluster, distance) of every vector; a distance that is no long is null."""
    table = Bisectors(centroids, dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, distance = table.nearest(whole(batch, dimensions))
                far = pa.array([v if v <= LONG else None for v in distance.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), far], ["id", "cluster", "distance"])

    return vectors.mapInArrow(run, "id long, cluster int, distance long")


def moved(vectors: DataFrame, centroids: list[list[int]], dimensions: int) -> list[list[int]]:
    """The centroids after one round: the exact floors of the means of their vectors; those without any stay.

    A task adds up what it has; its sums travel as digits of 32 bits, whose sums are longs.
    """
    table = Bisectors(centroids, dimensions)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}  # count, then components
        for batch in batches:
            if batch.num_rows:
                x = whole(batch, dimensions)
                cluster, _ = table.nearest(x)
                for c in np.unique(cluster).tolist():
                    own = cluster == c
                    more = [int(own.sum()), *(int(v) for v in x[own].sum(0).tolist())]
                    total[c] = [a + b for a, b in zip(total[c], more, strict=True)] if c in total else more
        out: list[tuple[int, int, int, int]] = []
        for c, values in total.items():
            for i, v in enumerate(values):
                limb = 0
                while not -(1 << LIMB) < v < 1 << LIMB:
                    out.append((c, i, limb, v & ((1 << LIMB) - 1)))
                    v, limb = v >> LIMB, limb + 1
                out.append((c, i, limb, v))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["cluster", "i", "limb", "value"])

    digits = vectors.mapInArrow(sums, "cluster int, i int, limb int, value long")
    total = [[0] * (dimensions + 1) for _ in centroids]
    for r in digits.groupBy("cluster", "i", "limb").agg(F.sum("value").alias("value")).collect():  # some digits for each component of each centroid
        total[r.cluster][r.i] += r.value << (LIMB * r.limb)
    return [[v // t[0] for v in t[1:]] if t[0] else c for c, t in zip(centroids, total, strict=True)]


def clusters(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) of every kept vector; centroid is its components, comma-joined.

    Null vectors, those of another length and those with a null or non-finite component are left out. The first centroids
    are the k kept vectors with the smallest hashes of their ids; a null id has none and starts no cluster, but is
    assigned. Rows with equal ids are vectors of their own, ordered by their components where both start a cluster. With
    fewer vectors than k there are as many clusters; an empty table gives no rows. Of equally near centroids the smaller
    number wins. Components of any size are exact; a distance or sum that is no long is null. Other columns are not read.
    """
    spark = rows.sparkSession
    vectors = kept_vectors(rows, id_col, vector_col, dimensions, scale)
    named = vectors.withColumn("h", F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")).cast("binary"), 256)).filter("h IS NOT NULL")
    first = named.orderBy("h", "x").limit(k).select("x").collect()
    centroids = [[math.floor(v) for v in r.x] for r in first]
    if not centroids:
        vectors = vectors.limit(0)
    for _ in range(rounds if centroids else 0):
        centroids = moved(vectors, centroids, dimensions)
    found = cut(assigned(vectors, centroids, dimensions))
    distance = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r.cluster: r for r in found.groupBy("cluster").agg(distance.alias("s"), (F.count("distance") == F.count("*")).alias("all")).collect()}  # a row for each centroid
    told = {c: int(r.s) if r.all and r.s <= LONG else None for c, r in sums.items()}
    total = sum(int(r.s) for r in sums.values() if r.all) if all(r.all for r in sums.values()) else None
    inertia = F.lit(total if total is not None and total <= LONG else None).cast("long").alias("inertia")
    made = spark.createDataFrame([(c, v, ",".join(map(str, centroids[c]))) for c, v in told.items()], "cluster int, cluster_inertia long, centroid string")
    return found.join(F.broadcast(made), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", inertia, "centroid")  # at most k rows
