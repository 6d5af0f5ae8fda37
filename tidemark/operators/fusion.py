"""Fusing and reordering ranked lists."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONSTANT, DEPTH = 60, 100


def rrf(legs: list[DataFrame], key: str, by: list[str] | None = None) -> DataFrame:
    """Reciprocal rank fusion of the first DEPTH of each leg (key, rank); ties by key."""
    by = by or []
    rows = functools.reduce(DataFrame.unionByName, [x.where(F.col("rank") <= DEPTH).select(*by, key, "rank") for x in legs])
    score = F.round(F.sum(F.lit(1.0) / (CONSTANT + F.col("rank"))), 12).alias("score")
    return rows.groupBy(*by, key).agg(score).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), key)).cast("bigint"))


def boosted(legs: list[tuple[DataFrame, float]], key: str, by: list[str]) -> DataFrame:
    """Sums of the legs' boosted scores, in decimals, so that no order of summing shows."""
    rows = functools.reduce(DataFrame.unionByName, [x.select(*by, key, (F.col("score") * b).cast("decimal(38,12)").alias("score")) for x, b in legs])
    return rows.groupBy(*by, key).agg(F.sum("score").cast("double").alias("score"))


def with_tail(head: DataFrame, tail: DataFrame, key: str, by: list[str]) -> DataFrame:
    """The head in its order, then the tail's rows that the head lacks."""
    rest = tail.join(head.select(*by, key), [*by, key], "left_anti").select(*by, key, "rank", F.lit(1).alias("segment"))
    rows = head.select(*by, key, "rank", F.lit(0).alias("segment")).unionByName(rest)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("segment", "rank", key)).cast("bigint")).drop("segment")


def reranked(rows: DataFrame, score: str, by: list[str], window: int) -> DataFrame:
    """The scored rows of the first ``window`` exchange their places by score; all others stay.

    Rows without a score keep their place, and so do rows beyond the window.
    """
    takes = F.col(score).isNotNull() & (F.col("rank") <= window)
    marked = rows.withColumn("__takes", takes)
    own = Window.partitionBy(*by, "__takes")
    marked = marked.withColumn("__slot", F.row_number().over(own.orderBy("rank"))).withColumn("__order", F.row_number().over(own.orderBy(F.desc(score), "rank")))
    slots = marked.where("__takes").select(*by, F.col("__slot").alias("__order"), F.col("rank").alias("__new"))
    moved = marked.where("__takes").join(slots, [*by, "__order"]).withColumn("rank", F.col("__new")).drop("__new")
    return moved.unionByName(marked.where("not __takes")).drop("__takes", "__slot", "__order")
