"""Approximate vector search by an inverted file: cells of similar vectors, of which a query probes a few."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that cells are fitted on, at most; rows of a piece of a cell.
SAMPLE, PIECE = 20_000, 1 << 16


class Cells:
    """Unit-length centres. A vector belongs to the cell whose centre it has the largest product with."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n best cells of each vector, best first; equal ones by number."""
        return np.argsort(-(x @ self.centres.T), axis=1, kind="stable")[:, :n]


def fit(vectors: DataFrame, key: str, vector: str, cells: int, sample: int = SAMPLE) -> Cells:
    """Cells by k-means on at most ``sample`` vectors, those with the least hashes of their keys; vectors without length are left out."""
    some = vectors.where(F.col(vector).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(vector).cast("array<double>").alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    some = some.withColumn("size", size).where("size > 0").orderBy("h").limit(sample)
    unit = some.select(array_to_vector(F.transform("v", lambda x: x / F.col("size"))).alias("features")).coalesce(1).persist()
    try:
        if unit.isEmpty():
            return Cells(np.zeros((1, 1)))
        return Cells(np.array(KMeans(k=cells, seed=21, maxIter=10).fit(unit).clusterCenters()))
    finally:
        unit.unpersist()


def _celled(rows: DataFrame, vector: str, cells: Cells, n: int) -> DataFrame:
    """Rows with an array of their n best cells and the vector scaled to length one; those without a length go."""

    def run(batches):
        for batch in batches:
            v = batch["v"].to_numpy(zero_copy_only=False)
            x = np.stack(v).astype(np.float32) if len(v) else np.zeros((0, cells.centres.shape[1]), np.float32)
            size = np.linalg.norm(x, axis=1)
            good = np.flatnonzero(size > 0)
            x = x[good] / size[good, None]
            yield pa.RecordBatch.from_arrays(
                [batch["id"].take(pa.array(good)), pa.array(list(cells.nearest(x, n).astype(np.int32)), pa.list_(pa.int32())), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "cells", "unit"])

    named = rows.where(F.col(vector).isNotNull()).select(F.col(rows.columns[0]).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    return named.mapInArrow(run, "id long, cells array<int>, unit binary")


def index(vectors: DataFrame, key: str, vector: str, cells: Cells) -> DataFrame:
    """Rows (id, cell, unit): every vector in its cell."""
    return _celled(vectors.select(key, vector), vector, cells, 1).select("id", F.col("cells")[0].alias("cell"), "unit")


def search(indexed: DataFrame, queries: DataFrame, query: str, vector: str, cells: Cells, k: int, probes: int) -> DataFrame:
    """Rows (query, id, score, rank): the k best of each query among the vectors of its ``probes`` best cells, by cosine.

    With as many probes as cells the search is exact. A large cell is cut into pieces of
    about PIECE rows, and a query goes to every piece of its cells; a vector is sent once.
    """
    sizes = indexed.groupBy("cell").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))  # one row a cell
    held = indexed.join(F.broadcast(sizes), "cell").select("cell", F.pmod(F.xxhash64("id"), "pieces").cast("int").alias("piece"), "id", "unit")
    asked = _celled(queries.select(query, vector), vector, cells, probes).select("id", "unit", F.explode("cells").alias("cell"))
    asked = asked.join(F.broadcast(sizes), "cell").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("cell", "piece", "id", "unit")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        q, own = (np.asarray(t["id"]) for t in (left, right))
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(q) and len(own):
            a, x = (np.frombuffer(b"".join(t["unit"].to_pylist()), np.float32).reshape(t.num_rows, -1) for t in (left, right))
            for at in range(0, len(q), 256):
                scores = np.round((a[at : at + 256] @ x.T).astype(np.float64), 6)
                for j, s in enumerate(scores):
                    some = np.flatnonzero(s >= np.partition(s, -k)[-k]) if len(s) > k else np.arange(len(s))
                    top = some[np.lexsort((own[some], -s[some]))][:k]
                    rows.append((np.full(len(top), q[at + j]), own[top], s[top]))
        out = [np.concatenate(c) for c in zip(*rows)] if rows else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query": pa.array(out[0], pa.int64()), "id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    shape = T.StructType([T.StructField("query", T.LongType()), T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())])
    found = asked.groupBy("cell", "piece").cogroup(held.groupBy("cell", "piece")).applyInArrow(best, shape)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def probes_for(indexed: DataFrame, vectors: DataFrame, key: str, vector: str, cells: Cells, k: int, target: float = 0.95, sample: int = 128) -> int:
    """The least number of probes by which at most ``sample`` vectors, those with the least hashes, find the target's share of their exact k best.

    Clustered vectors need few; vectors that are all about equally far apart need most of the cells.
    """
    some = vectors.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key)).limit(sample).select(key, vector)
    order = _celled(some, vector, cells, len(cells.centres)).select(F.col("id").alias("query"), F.posexplode("cells").alias("place", "cell"))
    exact = search(indexed, some, key, vector, cells, k, probes=len(cells.centres)).select("query", "id")
    places = exact.join(indexed.select("id", "cell"), "id").join(order, ["query", "cell"]).groupBy("place").count().collect()  # at most one row a cell
    held, total = 0, sum(r["count"] for r in places)
    for r in sorted(places):
        held += r["count"]
        if held >= target * total:
            return r["place"] + 1
    return len(cells.centres)


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Rows (query, hits, strict, ties): of a query's exact k best, how many were found; its share; and the share of those found that score no less than the k-th best."""
    floor = exact.groupBy("query").agg(F.min("score").alias("floor"), F.count("*").alias("n"))
    both = exact.select("query", "id", F.lit(1).alias("hit"))
    rows = floor.join(found.join(both, ["query", "id"], "left"), "query", "left")
    good = F.count_if(F.round(F.col("score"), 5) >= F.round("floor", 5))
    return rows.groupBy("query", "n").agg(F.count("hit").alias("hits"), good.alias("good")).select("query", "hits", (F.col("hits") / F.col("n")).alias("strict"), F.least(F.lit(1.0), F.col("good") / F.col("n")).alias("ties"))
