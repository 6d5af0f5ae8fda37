"""Latest states, versions, upserts and gaps: row sets that stand for what changes over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import cut


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The newest row of each key; a grouped maximum, so copies combine before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    led = [*order, *[c for c in rest if c not in order]]
    return rows.groupBy(*keys).agg(F.max(F.struct(*led)).alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def upsert(stored: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """Rows by key, the higher version wins and a stored one at equal versions."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    n = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(version), "__new"))
    return both.withColumn("__n", n).where("__n = 1").drop("__n", "__new")


def create_only(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The new rows whose key is not stored yet, one for each key."""
    return new.dropDuplicates(key).join(stored.select(*key).distinct(), key, "left_anti")


def swapped(stored: DataFrame, changes: DataFrame, key: str, read: list[str]) -> DataFrame:
    """Compare and swap: each change with whether the columns it read are unchanged, nulls alike."""
    now = stored.select(key, *[F.col(c).alias(f"__{c}") for c in read])
    same = F.lit(True)
    for c in read:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return changes.join(now.withColumn("__there", F.lit(True)), key, "left").withColumn("applied", F.coalesce(F.col("__there") & same, F.lit(False))).drop("__there", *[f"__{c}" for c in read])


def islands(rows: DataFrame, keys: list[str], order: list[str], flag: str) -> DataFrame:
    """Runs of equal flags in order: a number for each run of a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = (~F.col(flag).eqNullSafe(F.lag(flag).over(w))).cast("int")
    return rows.withColumn("__step", step).withColumn("run", F.sum("__step").over(w)).drop("__step")


def collisions(left: DataFrame, right: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys of both sides with added, removed, same or changed."""
    a, b = left.select(key, F.col(digest).alias("__a")), right.select(key, F.col(digest).alias("__b"))
    state = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__a") == F.col("__b"), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, state.alias("state"))


def lineage(rows: DataFrame, key: str, parent: str, most: int) -> DataFrame:
    """Rows (key, depth): the steps from each row to its root, a row without a parent among the keys.

    The depth is null for rows that reach no root in ``most`` steps, as those on a cycle.
    Every round doubles the steps that all open rows have taken; rows at a root leave the
    joins, so that a root with many descendants does not gather them. Keys are unique.
    """
    known = rows.select(F.col(key).alias("at")).distinct()
    step = rows.select(F.col(key).alias("k"), F.col(parent).alias("at")).join(known, "at", "left_semi").withColumn("steps", F.lit(1).cast("bigint"))
    roots = rows.select(F.col(key).alias("k")).join(step.select("k"), "k", "left_anti").withColumn("depth", F.lit(0).cast("bigint"))
    done, open_ = cut(roots), cut(step)
    for _ in range(most.bit_length()):
        ended = open_.join(done.select(F.col("k").alias("at"), F.col("depth").alias("rest")), "at")
        done_now = ended.select("k", (F.col("steps") + F.col("rest")).alias("depth"))
        onward = open_.select(F.col("k").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"))
        rest = open_.join(done.select(F.col("k").alias("at")), "at", "left_anti").join(onward, "at").select("k", F.col("next").alias("at"), (F.col("steps") + F.col("more")).alias("steps"))
        done, open_ = cut(done.union(done_now)), cut(rest)
    found = done.where(F.col("depth") <= most)
    return rows.select(F.col(key).alias("k")).join(found, "k", "left").select(F.col("k").alias(key), "depth")


def manifest_problems(entries: DataFrame, files: DataFrame, scopes: list[str]) -> DataFrame:
    """Rows (id, problem) of manifest entries (id, path, parent, size, sha256) against files (id, size, sha256).

    An entry may have several: its path is used twice, it lies outside of the scopes, its parent is no
    entry, its file is missing, or the file has another size or digest.
    """
    paths = entries.groupBy("path").agg(F.count("*").alias("uses"))
    parents = entries.select(F.col("id").alias("parent")).distinct().withColumn("known", F.lit(True))
    found = files.select("id", F.col("size").alias("found_size"), F.col("sha256").alias("found_sha256"))
    rows = entries.join(paths, "path").join(parents, "parent", "left").join(found, "id", "left")
    outside = ~F.exists(F.array(*map(F.lit, scopes)), lambda s: F.startswith("path", s))
    checks = [
        (F.col("uses") > 1, "path used twice"), (outside, "outside scope"), (F.col("parent").isNotNull() & F.col("known").isNull(), "no parent"),
        (F.col("found_sha256").isNull(), "missing"), (F.col("found_size") != F.col("size"), "size"), (F.col("found_sha256") != F.col("sha256"), "digest"),
    ]
    problems = F.array_compact(F.array(*[F.when(c, n) for c, n in checks]))
    return rows.select("id", F.explode(problems).alias("problem"))


def whole_batches(decisions: DataFrame, current: DataFrame, most: int) -> DataFrame:
    """Rows (batch, accepted, stale): a batch of (batch, id, sha256) counts only as a whole.

    It is refused if it has over ``most`` decisions, an id twice, or a digest that is not the current one.
    """
    now = current.select("id", F.col("sha256").alias("now"))
    rows = decisions.join(now, "id", "left").withColumn("old", ~F.coalesce(F.col("now") == F.col("sha256"), F.lit(False)))
    once = rows.groupBy("batch", "id").agg(F.count("*").alias("n"), F.count_if("old").alias("stale"))
    sums = once.groupBy("batch").agg(F.sum("n").alias("n"), F.count("*").alias("ids"), F.sum("stale").alias("stale"))
    return sums.select("batch", ((F.col("n") <= most) & (F.col("n") == F.col("ids")) & (F.col("stale") == 0)).alias("accepted"), "stale")
