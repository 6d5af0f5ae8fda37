"""Centroid clustering of whole-number vectors by annulus search.

Norms differ by no more than vectors do. So with the centroids sorted by norm, only those
in the annulus of a vector's norm plus or minus an upper bound of its distance can be its
nearest: two binary searches find them, and they alone are compared, exactly. The bound is
the exact distance to the centroid that was the vector's nearest in the first round, which
is stored with the vector; wherever that centroid has moved since, the bound holds.

A round is one pass over the packed vectors. A task adds up its own vectors by centroid, so
it sends one row a centroid; the driver holds the centroids only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import whole_vectors as W
from tidemark.llm.shared import written


class Annulus:
    """Centroids sorted by norm."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        square = (centroids * centroids).sum(axis=1)
        self.order = np.argsort(square, kind="stable")
        self.norm = np.sqrt(square[self.order].astype(np.float64))

    def distance(self, x: np.ndarray, k: np.ndarray | int) -> np.ndarray:
        return ((x - self.centroids[k]) ** 2).sum(axis=1)

    def nearest(self, x: np.ndarray, hint: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(nearest centroid, the smaller number of equals; squared distance; how many distances were taken). hint may be any centroid."""
        best, label = self.distance(x, hint), hint.copy()
        norm = np.sqrt((x * x).sum(axis=1).astype(np.float64))
        # Wider than the bound by more than doubles may err, so ties on the boundary are inside.
        reach = np.sqrt(best.astype(np.float64)) * (1 + 1e-9) + norm * 1e-9 + 1e-3
        first, last = np.searchsorted(self.norm, norm - reach, "left"), np.searchsorted(self.norm, norm + reach, "right")
        taken = len(x)
        for place, k in enumerate(self.order):
            rows = np.flatnonzero((first <= place) & (place < last) & (hint != k))
            taken += len(rows)
            d = self.distance(x[rows], k)
            better = (d < best[rows]) | (d == best[rows]) & (k < label[rows])
            best[rows[better]], label[rows[better]] = d[better], k
        return label, best, taken

    def by_norm(self, x: np.ndarray) -> np.ndarray:
        """For each vector, the centroid whose norm is the first not below its own: a first hint."""
        norm = np.sqrt((x * x).sum(axis=1).astype(np.float64))
        return self.order[np.minimum(np.searchsorted(self.norm, norm), len(self.order) - 1)]


def seeds(table: DataFrame, clusters: int, salt: int, dimension: int) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``salt:id``, in that order; equal ids by their components, a missing id last."""
    named = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    first = table.select("vector", named.alias("h")).orderBy(F.col("h").asc_nulls_last(), "vector").limit(clusters).collect()
    return np.array([np.frombuffer(r.vector, "<i4") for r in first], np.int64).reshape(-1, dimension)


def cluster(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
    clusters: int = 8, rounds: int = 10, dimension: int = 64, salt: int = 3,
) -> tuple[DataFrame, np.ndarray]:
    """(rows (id, cluster, distance, cluster_inertia, inertia, centroid_sha256), final centroids).

    A row for every vector of ``dimension`` components, none of them null or not finite;
    others have no row. Components become floor(1024 * x); one beyond 131,072 raises, as its
    square would not fit. Of equally near centroids the smaller number wins, centroids
    without vectors stay where they are, and fewer vectors than ``clusters`` make fewer
    centroids. Null and repeated ids are carried, repeated rows each have a row, an empty
    table gives no rows, other columns are ignored.
    """
    spark = vectors.sparkSession
    table = W.packed(vectors, id_column, vector_column, dimension)
    centroids = seeds(table, clusters, salt, dimension)
    k = len(centroids)

    def label(shared, hinted: bool):
        def run(batches):
            for batch in batches:
                x = W.matrix(batch["vector"], "<i4", dimension).astype(np.int64)
                hint = np.asarray(batch["hint"]).astype(np.int64) if hinted else shared.value.by_norm(x)
                found, distance, _ = shared.value.nearest(x, hint)
                if hinted:
                    yield pa.RecordBatch.from_arrays([batch["id"], pa.array(found, pa.int32()), pa.array(distance, pa.int64())], ["id", "cluster", "distance"])
                else:
                    yield pa.RecordBatch.from_arrays([batch["id"], batch["vector"], pa.array(found, pa.int32())], ["id", "vector", "hint"])

        return run

    if k:
        shared = spark.sparkContext.broadcast(Annulus(centroids))
        table = written(table.mapInArrow(label(shared, False), "id long, vector binary, hint int"), "hinted")
    else:
        table = table.withColumn("hint", F.lit(0))
    for _ in range(rounds if k else 0):
        shared = spark.sparkContext.broadcast(Annulus(centroids))

        def keyed(batch, shared=shared):
            x = W.matrix(batch["vector"], "<i4", dimension).astype(np.int64)
            return shared.value.nearest(x, np.asarray(batch["hint"]).astype(np.int64))[0], x

        centroids = W.moved(centroids, W.grouped_sums(table.select("vector", "hint"), k, dimension, keyed))
    shared = spark.sparkContext.broadcast(Annulus(centroids))
    found = table.mapInArrow(label(shared, True), "id long, cluster int, distance long")
    found = written(found, "clusters")
    inertia = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, inertia.get(c, 0), sum(inertia.values()), digest[c]) for c in range(k)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = found.join(F.broadcast(facts), "cluster")
    return out.select(F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids
