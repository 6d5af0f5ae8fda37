"""Vector search: exact top-k under filters, fan-out over fields, pooling, recall."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(a: Column) -> Column:
    """Whether the squared norm is near one."""
    return dot(a, a).between(0.9, 1.1)


#: Queries of a block and vectors of a slice; a cell holds one block against one slice.
BLOCK, SLICE, LEAST_SLICES, STEP = 2048, 1 << 16, 8, 256


def nearest(vectors: DataFrame, queries: DataFrame | list[tuple[int, list[float]]], key: str, vector: str, k: int, floor: float | None = None) -> DataFrame:
    """Rows (query, key, score, rank): the k nearest of each query among the (already filtered) vectors.

    Queries are rows (query, vector column). Blocks of them meet slices of the vectors in
    cells by a keyed shuffle: each batch of a cell is one matrix product for every STEP
    queries and passes on its own k best of each query, so what is ranked grows with the
    number of batches, not of rows. A task holds one block of queries.
    """
    spark = vectors.sparkSession
    if isinstance(queries, list):
        queries = spark.createDataFrame(queries, T.StructType([T.StructField("query", T.LongType()), T.StructField(vector, T.ArrayType(T.DoubleType()))]))
    blocks = max(1, -(-queries.count() // BLOCK))
    slices = max(LEAST_SLICES, -(-vectors.count() // SLICE))

    def side(rows: DataFrame, name: str, own: str, many: int, other: str, others: int, last: bool) -> DataFrame:
        rows = rows.select(F.col(name).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.lit(last).alias("held"))
        return rows.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(many)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    both = side(queries, "query", "block", blocks, "slice", slices, False).unionByName(side(vectors, key, "slice", slices, "block", blocks, True))
    both = both.repartition(min(blocks * slices, 1 << 15), "block", "slice").sortWithinPartitions("block", "slice", "held").select("block", "slice", "held", "id", "v")

    def best(ids, asked, own, x):
        size = np.linalg.norm(x, axis=1)
        rows = []
        for at in range(0, len(ids), STEP):
            scores = np.round((x @ asked[at : at + STEP].T) / np.where(size > 0, size, np.nan)[:, None], 9)
            scores[np.isnan(scores)] = -np.inf
            for j in range(scores.shape[1]):
                top = np.lexsort((own, -scores[:, j]))[:k]
                top = top[scores[top, j] >= (-1e9 if floor is None else floor)]
                rows.append((np.full(len(top), ids[at + j]), own[top], scores[top, j]))
        q, i, s = (np.concatenate(c) for c in zip(*rows))
        return pa.RecordBatch.from_pydict({"query": pa.array(q, pa.int64()), key: pa.array(i, pa.int64()), "score": pa.array(s)})

    def score(batches):
        cell, ids, asked, whole = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            tags = np.stack([np.asarray(batch["block"]), np.asarray(batch["slice"]), batch["held"].to_numpy(zero_copy_only=False)], axis=1).astype(np.int64)
            cuts = [0, *(np.flatnonzero((tags[1:] != tags[:-1]).any(axis=1)) + 1), len(tags)]
            own, v = np.asarray(batch["id"]), batch["v"].to_numpy(zero_copy_only=False)
            for i, j in zip(cuts, cuts[1:]):
                if tuple(tags[i, :2]) != cell:
                    cell, ids, asked, whole = tuple(tags[i, :2]), [], [], None
                x = np.stack(v[i:j])
                if not tags[i, 2]:
                    ids.append(own[i:j])
                    asked.append(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300))
                elif ids:
                    whole = whole or (np.concatenate(ids), np.concatenate(asked))
                    yield best(*whole, own[i:j], x)

    shape = T.StructType([T.StructField("query", T.LongType()), T.StructField(key, T.LongType()), T.StructField("score", T.DoubleType())])
    found = both.mapInArrow(score, shape)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key)).cast("bigint")
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mean_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """The mean of each key's vectors, scaled to length one, place by place."""
    places = rows.select(key, F.posexplode(vector).alias("place", "x")).groupBy(key, "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = places.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("mean"))
    return whole.select(key, F.transform("mean", lambda x: x / norm(F.col("mean"))).alias("mean"))


def packed(vector: str) -> Column:
    """Little-endian 32-bit floats in base64, exact to the bit."""

    @F.pandas_udf("string")
    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, "<f4").tobytes()).decode("ascii"))

    return run(vector)


def unpacked(text: str) -> Column:
    """The floats of ``packed``; null where the text is no base64 of whole floats."""

    def one(t):
        try:
            return None if t is None else np.frombuffer(base64.b64decode(t, validate=True), "<f4")
        except ValueError:
            return None

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(text)
