"""Mixing sources to target weights by systematic sampling of whole documents.

Sources share the corpus's words by weight. A source's target stops at ``most`` times its
own size, and the excess goes to the others by weight, until no target is above. Every
document of a source then has the same expected number of copies, target / size. Their
running sum over the source's documents, moved by one random offset, crosses whole numbers;
a document is emitted once for each that it crosses. Documents stand in the order of their
size, so what is taken differs from the target by little more than one document.

All is exact: targets are fractions of whole numbers, and a running sum is a rank times a
fraction. Ranks are counted in ranges of the order, not in groups: rows are dealt by ranges
that end inside sources and inside ties, each task numbers its own, and the ranges' sizes
are added up. So a source with a third of all rows is spread over a third of the tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, partitions, spread_join, written

WHITE = r"[^\x20\x09-\x0D]+"
#: Bits of the random offset of a source.
OFFSET_BITS = 20
#: Rounds after which sharing() gives up; a round caps all sources that are above.
ROUNDS = 10_000


def numbered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """A written table of the rows with ``rank``, from 0, in the given order; ties in any order.

    Nothing but the number of rows of each range is gathered.
    """
    rows = rows.withColumn("__tie", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    table = written(dealt.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part, own = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = table.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))  # one row a range
    return table.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn("rank", F.col("__before") + own).drop("__part", "__at", "__before")


def sharing(sources: DataFrame, most: int) -> tuple[int, int]:
    """The words that a weight of 1 stands for, as (numerator, denominator), once the sources above ``most`` times their size are capped.

    sources has a row a source, with ``words`` and ``weight``. The level only rises from round to round, and a capped source stays so.
    """
    total = int(sources.agg(F.sum(F.col("words").cast("decimal(38,0)"))).first()[0] or 0)
    level = (0, 1)
    for _ in range(ROUNDS):
        capped = above(level, most)
        row = sources.agg(
            F.sum(F.when(capped, most * F.col("words").cast("decimal(38,0)"))), F.sum(F.when(~capped, F.col("weight").cast("decimal(38,0)"))),
        ).first()
        if not row[1]:
            return level
        now = (total - int(row[0] or 0), int(row[1]))
        if now[0] * level[1] == level[0] * now[1]:
            return level
        level = now
    raise RuntimeError(f"shares did not settle in {ROUNDS} rounds")


def above(level: tuple[int, int], most: int) -> Column:
    """Whether a source's weight asks for more than ``most`` times its words."""
    return F.col("weight") * F.lit(level[0]).cast("decimal(38,0)") > F.col("words") * F.lit(most * level[1]).cast("decimal(38,0)")


def mix(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
    weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: int = 12, carry: Sequence[str] = (),
) -> DataFrame:
    """Rows (id, source, size, source_size, target, copies, taken, *carry), one for every row of docs.

    size is the number of words, source_size and target those of the row's source, copies
    how often the mix takes the row and taken the words of that. Sources in the order of
    their code points, a missing source last as one of its own, have the weights in turn.

    Null and empty texts have size 0. Null and repeated ids are carried and repeated rows
    drawn each for itself.
    A source without words takes none, an empty table gives no rows, and columns named in
    carry come out as they are, unless their names clash with those above: that raises.
    The same rows and seed give the same mix in any partitioning.
    """
    names = ["size", "source_size", "target", "copies", "taken"]
    if clash := set(carry) & {*names, id_column, source_column}:
        raise ValueError(f"columns {sorted(clash)} clash with the result's own")
    size = F.coalesce(F.regexp_count(text_column, F.lit(WHITE)), F.lit(0)).cast("long")
    held = [F.struct(*carry).alias("carry")] if carry else []
    rows = docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), size.alias("size"), F.xxhash64(text_column).alias("t"), *held)
    rows = rows.withColumn("key", F.to_json(F.struct("source"))).withColumn("h", F.md5(F.col("id").cast("string")))
    rows = numbered(rows, F.col("source").asc_nulls_last(), "size", "h", "id", "t").drop("h", "t")

    sources = rows.groupBy("source", "key").agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min("rank").alias("first"))
    sources = numbered(cut(sources), F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    sources = cut(sources.select("key", "words", "n", "first", weight.alias("weight"), F.coalesce("source", F.lit("")).alias("name")))
    level = sharing(sources, most)
    whole = "decimal(38,0)"
    capped, some = above(level, most), F.col("words") > 0
    # Expected copies of a document are a / b; a cap makes them exactly ``most``.
    a = F.when(~some, F.lit(0)).when(capped, F.lit(most)).otherwise(F.col("weight") * F.lit(level[0]).cast(whole)).cast(whole)
    b = F.when(capped | ~some, F.lit(1)).otherwise(F.col("words") * F.lit(level[1]).cast(whole)).cast(whole)
    target = F.when(capped, (most * F.col("words")).cast("double")).otherwise(F.col("weight").cast("double") * float(level[0]) / float(level[1]))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "name")), 1, OFFSET_BITS // 4), 16, 10).cast("long")
    facts = sources.select("key", F.col("words").alias("source_size"), target.alias("target"), a.alias("a"), b.alias("b"), "first", "n", draw.alias("draw"))
    rows = spread_join(rows, facts, "key", "rank", rows.count())

    own = F.col("rank") - F.col("first")
    rows = rows.withColumn("copies", (_div(own + 1) - _div(own)).cast("long"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return rows.select(F.col("id").alias(id_column), F.col("source").alias(source_column), "size", "source_size", "target", "copies", taken, *(["carry.*"] if carry else []))


def _div(rank: Column) -> Column:
    """Whole numbers that the running sum of a source has crossed before a rank, moved by its offset draw / 2^OFFSET_BITS."""
    unit, whole = F.lit(1 << OFFSET_BITS).cast("decimal(38,0)"), "decimal(38,0)"
    top = rank.cast(whole) * F.col("a") * unit + F.col("draw").cast(whole) * F.col("b")
    return F.call_function("div", top.cast(whole), (F.col("b") * unit).cast(whole))


def emitted(mixed: DataFrame) -> DataFrame:
    """A row for every copy that the mix takes, with ``copy`` from 1."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
