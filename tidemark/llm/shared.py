"""Small helpers that the corpus operators share: sizes, joins that spread hot keys, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.storage import cut, shared_folder

__all__ = ["components", "cut", "partitions", "shared_folder", "spread_join", "text_bytes", "written"]

#: Rounds after which components() gives up; each round at least halves the stars' depth.
ROUNDS = 200
#: Rows that one task joins without trouble: tables of no more are joined as they are.
ONE_TASK = 1 << 17


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as a table in the shared folder and read back; lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, column: str) -> int:
    """Bytes of text in a column: one narrow aggregate, so that partitions can be sized by it."""
    return int(df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0)


def spread_join(rows: DataFrame, facts: DataFrame, key: str, spread: str, total: int) -> DataFrame:
    """Joins rows with facts, which has one row a key and, as ``n``, how many of the total rows the key has.

    A key with more than a fourth of a task's fair share of the rows is split into pieces by
    a hash of ``spread``. Such keys number at most four times the partitions, so they may be
    broadcast whatever the tables' size.
    """
    if total <= ONE_TASK:
        return rows.join(facts.drop("n"), key)
    share = -(-total // (4 * partitions(rows.sparkSession)))
    pieces = F.ceil(F.col("n") / share).cast("int")
    hot = facts.where(F.col("n") > share).select(key, pieces.alias("__pieces"))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("__piece", F.pmod(F.xxhash64(spread), F.coalesce("__pieces", F.lit(1))).cast("int")).drop("__pieces")
    right = facts.withColumn("__piece", F.explode(F.sequence(F.lit(0), F.greatest(pieces, F.lit(1)) - 1))).drop("n")
    return left.join(right, [key, "__piece"]).drop("__piece")


def _with_least(rows: DataFrame, total: int) -> DataFrame:
    """Rows (a, b) with the least b of their a as ``m``.

    Where a hub may have more than some 64 MB of rows the minima are cut: then both sides are
    dealt for the join alone, and Spark splits a partition that a hub makes large.
    """
    least = rows.groupBy("a").agg(F.min("b").alias("m"))
    return rows.join(cut(least) if total > 32 * ONE_TASK else least, "a")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node either has one edge to a lesser node or only edges from greater ones."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 0 and up + down > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), component the least node.

    Alternates the large-star and small-star steps, each a grouped minimum that is joined
    back, until the edges are stars; raises if ROUNDS do not do. Each step is cut by itself:
    a plan of both holds each of them several times, with as many jobs, and what the driver
    keeps of plans, jobs and tasks takes its memory, however small the tables are.
    Nodes without an edge do not appear, and a null or a loop is no edge.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    total = edges.count()  # no step makes more edges
    for k in range(ROUNDS):
        if k and _are_stars(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = cut(_with_least(both, 2 * total).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")))
        small = _with_least(large, total).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = cut(small.distinct())
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
