"""Facets, totals, timelines and pages of results."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def terms(rows: DataFrame, field: str, size: int | None = None, facet: str | None = None) -> DataFrame:
    """Values of a field (an array's elements count once each) by count, then value; empty ones do not count."""
    kind = dict(rows.dtypes)[field]
    value = F.explode(F.array_distinct(field)) if kind.startswith("array") else F.col(field)
    out = rows.select(value.alias("value")).where("value is not null and value <> ''").groupBy("value").agg(F.count("*").alias("n"))
    out = out.orderBy(F.desc("n"), "value").limit(size) if size is not None else out
    return out.select(F.lit(facet or field).alias("facet"), "value", "n", F.lit(False).alias("approximate"))


def multi_select(rows: DataFrame, filters: dict[str, list], facets: list[str], size: int | None = None) -> DataFrame:
    """Facets that each leave out the filter on their own field."""

    def branch(field: str) -> DataFrame:
        own = [F.col(f).isin(v) for f, v in filters.items() if f != field]
        return terms(rows.where(functools.reduce(Column.__and__, own)) if own else rows, field, size)

    return functools.reduce(DataFrame.unionByName, map(branch, facets))


def composite(rows: DataFrame, field: str, after: str | None, size: int) -> DataFrame:
    """Values in order with exact counts, a page at a time from a cursor."""
    out = rows.where(F.col(field) != "")
    out = out.where(F.col(field) > after) if after is not None else out
    return out.groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n")).orderBy("value").limit(size)


def named_counts(rows: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """A count for each named predicate, in one pass."""
    one = rows.agg(*[F.count_if(p).alias(k) for k, p in predicates.items()])
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, predicates)), F.array(*map(F.col, predicates)))).alias("label", "n"))


def year_histogram(rows: DataFrame, when: str, first: int, last: int) -> DataFrame:
    """Rows by year from first to last, years without rows too."""
    years = rows.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    found = rows.select(F.year(when).alias("year")).where(F.col("year").between(first, last)).groupBy("year").agg(F.count("*").alias("n"))
    return years.join(F.broadcast(found), "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"))


def total(rows: DataFrame, most: int = 1001) -> DataFrame:
    """The number of rows up to a threshold, and whether it is exact; reads no further than it must."""
    found = rows.limit(most + 1).agg(F.count("*").alias("n"))
    return found.select(F.least("n", F.lit(most)).cast("bigint").alias("value"), F.when(F.col("n") > most, "gte").otherwise("eq").alias("relation"))


def ranked(rows: DataFrame, *order: Column, window: int = 1000) -> DataFrame:
    """The first rows of an order, with their rank from 1; the window bounds what one task holds."""
    top = rows.orderBy(*order).limit(window)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def page(rows: DataFrame, *order: Column, offset: int, limit: int, window: int = 1000) -> DataFrame:
    """Rows offset + 1 to offset + limit of the window, with flags of what follows."""
    limit = min(limit, max(0, window - offset))
    top = ranked(rows, *order, window=offset + limit + 1)
    more = F.max("rank").over(Window.partitionBy()) > offset + limit
    top = top.withColumn("has_more", more).where(F.col("rank").between(offset + 1, offset + limit))
    end = offset + limit
    following = F.when(F.col("has_more") & F.lit(end < window), F.lit(end).cast("bigint"))
    return top.withColumn("next_offset", following).withColumn("limit_reached", F.col("has_more") & F.col("next_offset").isNull())


def groups(hits: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """Groups of ranked hits: the first hit stands for its group, groups in order of it."""
    out = hits.groupBy(key).agg(F.min_by(F.struct(*[c for c in hits.columns if c != key]), rank).alias("head"), F.count("*").alias("matches"))
    return out.select(key, "head.*", "matches")


def first_of(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def top_of(rows: DataFrame, keys: list[str], size: int, *order: Column) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__n", n).where(F.col("__n") <= size).drop("__n")


def with_defaults(rows: DataFrame, defaults: dict) -> DataFrame:
    """The named columns with defaults for nulls; raises on columns that are not named."""
    if unknown := sorted(set(rows.columns) - set(defaults)):
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    given = [F.col(c) if c in rows.columns else F.lit(None) for c in defaults]
    return rows.select(*(x.alias(c) if d is None else F.coalesce(x, F.lit(d)).alias(c) for x, (c, d) in zip(given, defaults.items())))
