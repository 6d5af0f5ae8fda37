"""Passages that end where the meaning of neighbouring sentences moves apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Where a sentence ends, and the share of a document's distances that make no boundary.
SENTENCE_END, PERCENTILE = r"(?<=[.?!])\s+", 0.95


def sentences(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, place, sentence, context) of whole texts; the context adds the neighbours. Null and blank texts have none."""
    parts = F.filter(F.split(text, SENTENCE_END), lambda s: s != "")
    flat = rows.select(key, F.posexplode(parts).alias("place", "sentence"))
    own = Window.partitionBy(key).orderBy("place")
    return flat.withColumn("context", F.concat_ws(" ", F.lag("sentence").over(own), "sentence", F.lead("sentence").over(own)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 minus the cosine of two arrays, to nine places; 1 where one of them is zero, null where one is null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.round(F.when(size == 0, 1.0).otherwise(1 - dot(a, b) / size), 9)


def chunks(rows: DataFrame, key: str, vector: str, percentile: float = PERCENTILE) -> DataFrame:
    """Rows (key, chunk, sentences, body) of ``sentences`` with a vector each, whatever model made it.

    A chunk ends before a sentence that lies farther from the one before it than the given
    percentile of the document's distances; so equal distances make no boundary. Sentences
    stay in order and none is lost. A task holds one document's sentences at most at a time.
    """
    own = Window.partitionBy(key).orderBy("place")
    gap = rows.withColumn("__d", cosine_distance(F.lag(vector).over(own), F.col(vector))).drop(vector)
    bound = F.round(F.percentile("__d", F.lit(percentile)).over(Window.partitionBy(key)), 9)
    begins = gap.withColumn("__b", F.coalesce((F.col("__d") > bound).cast("int"), F.lit(0)))
    numbered = begins.withColumn("chunk", F.sum("__b").over(own))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "sentence"))), lambda x: x["sentence"]), " ")
    return numbered.groupBy(key, "chunk").agg(F.count("*").alias("sentences"), body.alias("body"))
